"""Typed reads: CSV deliveries, file catalogs and stored tables."""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text columns of a count delivery, and the deliveries' file kinds.
TEXT_COLUMNS = ("direct", "side")
FILE_TYPES = ("air_wetlands", "waterfowl", "ground", "airwet", "wsds")
# The columns that hold whole numbers, and the slots of species codes.
INTEGER_COLUMNS = ("year", "month", "day", "transect", "grd", "wetype")
SPECIES_SLOT = re.compile(r"sp_?\d+")


def snake_names(names: Iterable[str]) -> list[str]:
    """Unique snake_case names; a repeat gets ``_2``, ``_3``, ..."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        base = re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_") or "x"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out


def read_counts(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str] | None = None,
    text_columns: Sequence[str] = TEXT_COLUMNS,
) -> DataFrame:
    """CSV deliveries with a header, read by the names in it.

    Codes and dates are integers, the named text columns text, all others doubles; a value that
    is no such number becomes NULL. Files may order their columns differently or lack some: a
    column that a file lacks is NULL in its rows. Names compare in snake_case. ``columns``
    chooses the columns of the result.
    """
    first = spark.read.text(paths)
    return _read_by_header(first, columns, text_columns)


def _read_by_header(
    lines: DataFrame, columns: Sequence[str] | None, text_columns: Sequence[str], named: bool = False
) -> DataFrame:
    """One reader for each different header among the files of ``lines``.

    The first line is looked up in each file's first block; what reaches the driver is a list of
    the files, which the driver has from listing them anyway. A file without a line is left out.
    """
    spark = lines.sparkSession
    tops = (
        lines.select("value", "_metadata.file_path", "_metadata.file_block_start")
        .filter("file_block_start = 0")
        .withColumn("line", F.monotonically_increasing_id())
        .groupBy("file_path")
        .agg(F.min_by("value", "line").alias("header"))
    )
    files: dict[str, list[str]] = defaultdict(list)
    for row in tops.collect():
        files[row["header"]].append(row["file_path"])
    wanted = snake_names(columns) if columns is not None else None
    parts = []
    for header in sorted(files):
        names = snake_names(next(csv.reader([header.removeprefix("\ufeff")])))
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
        raw = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema).csv(files[header])
        if wanted is not None:
            raw = raw.select(*[F.col(c) if c in names else F.lit(None).cast("string").alias(c) for c in wanted], *_file(named))
        else:
            raw = raw.select(*names, *_file(named))
        parts.append(type_counts(raw, [*text_columns, "file_name"]))
    if not parts:
        fields = [*(wanted or []), *(["file_name"] if named else [])]
        return type_counts(
            spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in fields])),
            [*text_columns, "file_name"],
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _file(named: bool) -> list[Column]:
    return [_delivery(F.col("_metadata.file_path")).alias("file_name")] if named else []


def type_counts(df: DataFrame, text_columns: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    df = df.toDF(*snake_names(df.columns))

    def typed(name: str) -> Column:
        if name in text_columns:
            return F.col(name)
        number = F.col(name).try_cast("double")
        if name in INTEGER_COLUMNS or SPECIES_SLOT.fullmatch(name):
            number = F.when(number == F.floor(number), number).try_cast("int")
        return number.alias(name)

    return df.select(*map(typed, df.columns))


def _delivery(path: Column) -> Column:
    """Name of the file, or of the folder when the file is one part of a written folder; a
    ``column=`` in front of the folder's name is left out."""
    return F.regexp_extract(path, r"(?:^|/)(?:[^/=]+=)?([^/=]+?)(?:/part-[^/]*)?$", 1)


def _file_type(name: Column, types: Sequence[str]) -> Column:
    return F.nullif(F.regexp_extract(name, "(" + "|".join(types) + ")", 1), F.lit(""))


def _file_year(name: Column) -> Column:
    """Four digits before an underscore, or two before the extension."""
    leading = F.regexp_extract(name, r"(\d{4})_", 1)
    trailing = F.regexp_extract(name, r"(\d{2})\.[^.]*$", 1)
    text = F.when(leading != "", leading).when(trailing != "", F.concat(F.lit("20"), trailing))
    return text.cast("int")


def file_catalog(
    spark: SparkSession, path: str, types: Sequence[str] = FILE_TYPES
) -> DataFrame:
    """Name, kind and year of every delivery below ``path``; files are listed, not read."""
    name = F.col("file_name")
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(_delivery(F.col("path")).alias("file_name"))
        .distinct()
        .select(name, _file_type(name, types).alias("file_type"), _file_year(name).alias("file_year"))
    )


def read_year_files(
    spark: SparkSession,
    path: str,
    file_type: str,
    year: int,
    columns: Sequence[str] | None = None,
    types: Sequence[str] = FILE_TYPES,
    text_columns: Sequence[str] = TEXT_COLUMNS,
) -> DataFrame:
    """The deliveries of one kind and year, by the names in their headers, each row with the name
    of its delivery. The filter is on file metadata alone: other files are not opened."""
    name = _delivery(F.col("_metadata.file_path"))
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .text(path)
        .filter((_file_type(name, types) == file_type) & (_file_year(name) == year))
    )
    return _read_by_header(lines, columns, text_columns, named=True)


def load_table(
    spark: SparkSession,
    root: str,
    name: str,
    years: Sequence[int] | None = None,
    columns: Sequence[str] | None = None,
    year_col: str = "year",
) -> DataFrame:
    """A stored table, limited to some years (pruned when partitioned by year) and columns."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{name}")
    if years is not None:
        df = df.filter(F.col(year_col).isin(*years))
    return df.select(*columns) if columns is not None else df


def null_policy(
    df: DataFrame,
    zero_cols: Sequence[str] = (),
    required_cols: Sequence[str] = (),
    sentinel_cols: Sequence[str] = (),
    sentinel: str = ".",
) -> DataFrame:
    """Drop rows without a required value, zero-fill counts, read text numbers with a
    missing-value mark."""
    if required_cols:
        df = df.dropna(subset=list(required_cols))
    if zero_cols:
        df = df.fillna(0, subset=list(zero_cols))
    numbers = {
        c: F.nullif(F.col(c), F.lit(sentinel)).try_cast("double") for c in sentinel_cols
    }
    return df.withColumns(numbers) if numbers else df


def wide_series_to_long(
    df: DataFrame,
    labels: Mapping[str, str],
    id_col: str = "year",
    exclude_years: Sequence[int] = (),
) -> DataFrame:
    """One column per species to ``(year, species, n)`` with the species relabelled.

    A year in ``exclude_years`` is dropped before the rows multiply.
    """
    if exclude_years:
        df = df.filter(~F.col(id_col).isin(*exclude_years))
    renamed = df.select(id_col, *[F.col(c).alias(label) for c, label in labels.items()])
    return renamed.unpivot(id_col, list(labels.values()), "species", "n")
