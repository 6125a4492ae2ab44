"""Reading deliveries, stored tables and the stream of deliveries."""

import pytest
from pyspark.sql import functions as F

from checks import queries as q
from fieldcount import session
from fieldcount.sources import ingest, store
from fieldcount.streaming.append import append_stream, batch_writer


def write_csv(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_snake_names_are_unique():
    assert ingest.snake_names(["Last Name, First Name", "SP 1", "sp-1", "YEAR"]) == [
        "last_name_first_name",
        "sp_1",
        "sp_1_2",
        "year",
    ]


def test_csv_is_typed_and_bad_numbers_are_null(spark, tmp_path):
    write_csv(tmp_path / "in" / "a.csv", "YEAR,DIRECT,SP 1\n99,N,32\n0,S,x\n")
    df = ingest.read_counts(spark, str(tmp_path / "in"))
    assert df.dtypes == [("year", "int"), ("direct", "string"), ("sp_1", "int")]
    assert sorted(map(tuple, df.collect())) == [(0, "S", None), (99, "N", 32)]


def test_deliveries_are_read_by_header_name(spark, tmp_path):
    write_csv(tmp_path / "in" / "a.csv", "YEAR,MONTH,TRANSECT,SP1,N\n2000,5,10,32,1.5\n")
    write_csv(tmp_path / "in" / "b.csv", "YEAR,TRANSECT,MONTH,SP1,EXTRA\n2001.0,20,6,33.5,7\n")
    write_csv(tmp_path / "in" / "c.csv", "TRANSECT,YEAR\n")
    got = ingest.read_counts(spark, str(tmp_path / "in"))
    assert dict(got.dtypes) == {
        "year": "int", "month": "int", "transect": "int", "sp1": "int", "n": "double", "extra": "double"
    }
    columns = ["year", "month", "transect", "sp1", "n", "extra"]
    wanted = [(2000, 5, 10, 32, 1.5, None), (2001, 6, 20, None, None, 7.0)]
    assert sorted(map(tuple, got.select(columns).collect())) == wanted
    some = ingest.read_counts(spark, str(tmp_path / "in"), ["Month", "TRANSECT", "other"])
    assert sorted(map(tuple, some.collect())) == [(5, 10, None), (6, 20, None)]


def test_catalog_and_year_files(spark, tmp_path):
    write_csv(tmp_path / "2023_air_wetlands.csv", "year,typ1\n2023,5\n")
    write_csv(tmp_path / "2022_air_wetlands.csv", "year,typ1\n2022,6\n")
    write_csv(tmp_path / "2023_waterfowl.csv", "year,typ1\n2023,7\n")
    write_csv(tmp_path / "wsds22.csv", "year,typ1\n2022,8\n")
    rows = ingest.file_catalog(spark, str(tmp_path)).collect()
    assert sorted((r.file_name, r.file_type, r.file_year) for r in rows) == [
        ("2022_air_wetlands.csv", "air_wetlands", 2022),
        ("2023_air_wetlands.csv", "air_wetlands", 2023),
        ("2023_waterfowl.csv", "waterfowl", 2023),
        ("wsds22.csv", "wsds", 2022),
    ]
    df = ingest.read_year_files(spark, str(tmp_path), "air_wetlands", 2023, ["year", "typ1"])
    assert [tuple(r) for r in df.collect()] == [(2023, 5.0, "2023_air_wetlands.csv")]


def test_stored_years_are_pruned(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(300).select((F.col("id") % 3 + 2000).cast("int").alias("year"), "id")
    store.write_partitioned(rows, f"{path}/counts", "year")
    df = ingest.load_table(spark, path, "counts", [2001])
    assert df.count() == 100
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan or "PartitionFilters: [year" in plan


def test_output_of_a_year_is_replaced_not_added(spark, tmp_path):
    path = f"{tmp_path}/out"
    for year, n in ((2000, 5), (2001, 7), (2001, 3)):
        store.write_output(spark.range(n), path, year)
    counts = spark.read.parquet(path).groupBy("analysis_year").count().collect()
    assert {r.analysis_year: r["count"] for r in counts} == {2000: 5, 2001: 3}


def test_table_append_takes_new_years_only(spark, sf, tmp_path):
    path = f"{tmp_path}/table"
    rows = q.view(spark, sf, "year_batches")
    store.append_to_table(rows.filter("year <= 1998"), path, "early")
    for _ in range(2):
        store.append_to_table(rows, path, "all")
    assert spark.read.parquet(path).count() == rows.count()
    refused = {(r.delivery, r.n) for r in store.rejected(spark, path).groupBy("delivery").agg(F.sum("n").alias("n")).collect()}
    assert refused == {("all", rows.filter("year <= 1998").count())}


def test_appends_look_at_the_ledger_only(spark, tmp_path):
    """Rows that cannot be read do not matter to an append, and trouble is not taken for absence."""
    path = f"{tmp_path}/table"
    store.append_to_table(delivery(spark, 2000, 3), path, "one")
    for file in (tmp_path / "table").rglob("*.parquet"):
        file.write_bytes(b"no parquet")
    store.append_to_table(delivery(spark, 2001, 2), path, "two")
    assert spark.read.parquet(f"{path}/year=2001").count() == 2
    other = tmp_path / "other"
    other.mkdir()
    (other / "x.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        store.append_to_table(delivery(spark, 2000, 1), str(other), "one")
    assert not (tmp_path / "other_years").exists()


def delivery(spark, year, n):
    return spark.range(n).select(F.lit(year).alias("year"), "id")


def years(spark, path):
    rows = spark.read.parquet(path).groupBy("year").count().collect()
    return {r.year: r["count"] for r in rows}


def test_stream_takes_each_year_once(spark, tmp_path):
    source, table, progress = (f"{tmp_path}/{n}" for n in ("in", "table", "progress"))

    def arrive(df):
        df.write.mode("append").parquet(source)
        stream = spark.readStream.schema("year int, id long").parquet(source)
        append_stream(stream, table, progress).awaitTermination()

    arrive(delivery(spark, 2000, 4))
    arrive(delivery(spark, 2001, 5).union(delivery(spark, 2000, 9)))
    assert years(spark, table) == {2000: 4, 2001: 5}


def test_stream_batch_repeats_after_a_loss(spark, tmp_path):
    """The batch dies after its years were settled and before its rows were written."""
    table = f"{tmp_path}/table"
    batch = delivery(spark, 2000, 6)
    write = batch_writer(table, "s")
    store.write_partitioned(
        spark.createDataFrame([(2000, "s-0", "s-0")], store.LEDGER), store.ledger_path(table), "part"
    )
    for _ in range(2):
        write(batch, 0)
    assert years(spark, table) == {2000: 6}
    write(delivery(spark, 2000, 9), 1)
    batch_writer(table, "another stream")(delivery(spark, 2000, 9), 0)
    assert years(spark, table) == {2000: 6}
    assert sorted(r.n for r in store.rejected(spark, table).collect()) == [9, 9]


def test_parts_of_a_delivery_belong_together(spark, tmp_path):
    table = f"{tmp_path}/table"
    write = batch_writer(table, "s", delivery_col="file")
    part = lambda n, name: delivery(spark, 2000, n).withColumn("file", F.lit(name))
    write(part(6, "a"), 0)
    write(part(3, "a").union(part(5, "b")), 1)
    write(part(3, "a").union(part(5, "b")), 1)
    assert years(spark, table) == {2000: 9}
    assert [(r.delivery, r.n) for r in store.rejected(spark, table).collect()] == [("b", 5)]


def test_stream_respects_years_stored_before_it(spark, tmp_path):
    table = f"{tmp_path}/table"
    store.append_to_table(delivery(spark, 1999, 3), table, "first")
    batch_writer(table, "s")(delivery(spark, 1999, 8).union(delivery(spark, 2000, 2)), 0)
    assert years(spark, table) == {1999: 3, 2000: 2}


def test_replace_mode_overwrites_the_year(spark, tmp_path):
    table = f"{tmp_path}/table"
    write = batch_writer(table, "s", mode="replace")
    write(delivery(spark, 2000, 6).union(delivery(spark, 2001, 1)), 0)
    write(delivery(spark, 2000, 9), 1)
    assert years(spark, table) == {2000: 9, 2001: 1}
    with pytest.raises(ValueError):
        batch_writer(table, "s", mode="merge")


def test_new_years_keep_rows_without_a_year(spark):
    existing = spark.range(1990, 1995).select(F.col("id").cast("int").alias("year"))
    incoming = spark.createDataFrame([(1990,), (1996,), (None,)], "year int")
    assert sorted(str(r.year) for r in store.new_years(existing, incoming).collect()) == ["1996", "None"]


def test_a_cluster_needs_a_shared_folder():
    for master in ("local", "local[8]", "local[*]"):
        session.refuse_own_disk("file:/tmp/warehouse", master)
    session.refuse_own_disk("hdfs://name/warehouse", "yarn")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://host"):
        for folder in ("file:/tmp/warehouse", "/tmp/warehouse"):
            with pytest.raises(ValueError):
                session.refuse_own_disk(folder, master)
