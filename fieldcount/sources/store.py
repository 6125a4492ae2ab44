"""Stage results and year-by-year tables as partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.utils import AnalysisException


def write_partitioned(df: DataFrame, path: str, column: str) -> None:
    """Write by partition value; a partition present in ``df`` replaces the stored one.

    ``rebalance`` gathers a value's rows into few files and still splits a hot value over
    several tasks. Replacing makes a rerun after a failure safe.
    """
    (
        df.hint("rebalance", column)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(column)
        .parquet(path)
    )


def write_output(df: DataFrame, path: str, analysis_year: int) -> None:
    """Keep a stage result under its analysis year."""
    (
        df.withColumn("analysis_year", F.lit(analysis_year))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("analysis_year")
        .parquet(path)
    )


def read_output(
    spark: SparkSession, path: str, analysis_year: int, schema: StructType
) -> DataFrame:
    """One analysis year of a stage result. The schema is given: a result may be empty."""
    whole = StructType([*schema.fields, StructField("analysis_year", IntegerType())])
    stored = spark.read.schema(whole).parquet(path)
    return stored.filter(F.col("analysis_year") == analysis_year).drop("analysis_year")


#: One row per year of a table: the delivery that brought it.
LEDGER = "year int, delivery string, part string"


def ledger_path(table: str) -> str:
    return f"{table.rstrip('/')}_years"


def rejects_path(table: str) -> str:
    return f"{table.rstrip('/')}_rejects"


def read_or_none(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame | None:
    """A stored table, or None where nothing is stored; any other trouble is an error."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def new_years(existing: DataFrame, incoming: DataFrame, year_col: str = "year") -> DataFrame:
    """The incoming rows of years that are not stored yet; rows without a year count as new."""
    stored = existing.select(year_col).distinct()
    return incoming.join(stored, year_col, "left_anti").select(*incoming.columns)


def append_year(existing: DataFrame, incoming: DataFrame, year_col: str = "year") -> DataFrame:
    """``existing`` plus the incoming rows of years it does not hold. Applied twice, the
    second time adds nothing."""
    return existing.unionByName(
        new_years(existing, incoming, year_col), allowMissingColumns=True
    )


def take_in(incoming: DataFrame, table: str, part: str, delivery: Column, year_col: str = "year") -> None:
    """Store what ``incoming`` brings of years that are new or that its delivery brought before.

    The ledger beside the table decides; stored rows are not read. A year belongs to the delivery
    that brought it first (of several in one call, the first by name), and later parts of that
    delivery are added. Rows of other deliveries go to the table of rejects. Rows without a year
    are never refused. Years are settled before rows are written, and a part replaces only itself,
    so a call that is repeated after a failure ends the same.
    """
    spark = incoming.sparkSession
    tagged = incoming.withColumn("delivery", delivery)
    path, own = ledger_path(table), F.col("part") == part
    ledger = read_or_none(spark, path, LEDGER)
    if ledger is None and read_or_none(spark, table) is not None:
        raise ValueError(f"{table} was stored without a ledger of its years")
    if ledger is None or ledger.filter(own).isEmpty():
        years = (
            tagged.filter(F.col(year_col).isNotNull())
            .groupBy(F.col(year_col).cast("int").alias("year"))
            .agg(F.min("delivery").alias("delivery"))
        )
        if ledger is not None:
            years = years.join(ledger.select("year"), "year", "left_anti")
        write_partitioned(years.withColumn("part", F.lit(part)), path, "part")
    owners = spark.read.schema(LEDGER).parquet(path).select(
        F.col("year").alias("owned_year"), F.col("delivery").alias("owner")
    )
    judged = tagged.join(owners, tagged[year_col].cast("int") == owners["owned_year"], "left")
    accepted = F.col("owner").isNull() | F.col("owner").eqNullSafe(F.col("delivery"))
    rows = judged.filter(accepted).select(*incoming.columns, F.lit(part).alias("part"))
    (
        rows.hint("rebalance", year_col)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(year_col, "part")
        .parquet(table)
    )
    refused = judged.filter(~accepted).select(*incoming.columns, "delivery", F.lit(part).alias("part"))
    write_partitioned(refused, rejects_path(table), "part")


def append_to_table(incoming: DataFrame, path: str, delivery: str, year_col: str = "year") -> None:
    """``append_year`` against a stored table, for a delivery of that name: only years that are
    new, or that this delivery brought before, are written. Given again, a delivery replaces its
    own rows."""
    take_in(incoming, path, delivery, F.lit(delivery), year_col)


def rejected(spark: SparkSession, path: str, year_col: str = "year") -> DataFrame:
    """How many rows of which year and delivery a table has refused."""
    refused = read_or_none(spark, rejects_path(path))
    if refused is None:
        return spark.createDataFrame([], f"{year_col} int, delivery string, n long")
    return refused.groupBy(year_col, "delivery").agg(F.count("*").alias("n"))
