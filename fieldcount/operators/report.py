"""Values of the report tables, from the small stage tables (one row per year and key)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcount.design import (
    GROUND,
    PRIORITY_TITLE_ORDER,
    PRIORITY_TITLES,
    SurveyDesign,
    lookup,
)
from fieldcount.functions.columns import (
    comma_text,
    decimal_text,
    pct_change,
    percent_text,
)
from fieldcount.operators.summaries import latest_years

# Wetland measures and the species of the comparison table, in report order.
WETLAND_MEASURES = (
    "i_ii_vi",
    "iii",
    "iv_v",
    "vii_viii",
    "non_linear",
    "stream",
    "ditch",
    "linear",
)
TABLE_SPECIES = (
    "mallard",
    "blue-winged teal",
    "wood duck",
    "other ducks",
    "total ducks",
    "canada goose",
)


def last_n_surveys(df: DataFrame, n: int = 10) -> DataFrame:
    """Rows since the n-th latest survey year, that is, of the n latest distinct years."""
    return df.join(latest_years(df, n), "year", "left_semi")


def pct_change_previous(
    df: DataFrame,
    measures: Sequence[str] = WETLAND_MEASURES,
    keys: Sequence[str] = ("region",),
) -> DataFrame:
    """Percent change of every measure from the previous survey to the latest, per key."""
    by_year = Window.partitionBy(*keys).orderBy("year")
    changes = [pct_change(F.col(m), F.lag(m).over(by_year)).alias(m) for m in measures]
    return (
        df.select(
            *keys,
            "year",
            *changes,
            F.lag("year").over(by_year).alias("_before"),
            F.lead("year").over(by_year).alias("_after"),
        )
        .filter(F.col("_after").isNull() & F.col("_before").isNotNull())
        .drop("_before", "_after")
    )


def recent_mean(
    df: DataFrame,
    n: int = 10,
    measures: Sequence[str] = WETLAND_MEASURES,
    keys: Sequence[str] = ("region",),
) -> DataFrame:
    """Mean of the last ``n`` complete rows per key, labelled with the years it spans."""
    latest = Window.partitionBy(*keys).orderBy(F.desc("year"))
    kept = df.dropna().withColumn("_rank", F.row_number().over(latest)).filter(F.col("_rank") <= n)
    label = F.concat(
        F.lit(f"{n}-year mean ("), F.min("year"), F.lit("-"), F.max("year"), F.lit(")")
    )
    return kept.groupBy(*keys).agg(label.alias("label"), *[F.avg(m).alias(m) for m in measures])


def long_term_mean(
    df: DataFrame,
    current: int,
    measures: Sequence[str] = WETLAND_MEASURES,
    keys: Sequence[str] = ("region",),
) -> DataFrame:
    """Mean of all complete rows before the current year, per key."""
    past = df.dropna().filter(F.col("year") < current)
    return past.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in measures])


def pct_change_long_term(
    df: DataFrame,
    current: int,
    measures: Sequence[str] = WETLAND_MEASURES,
    keys: Sequence[str] = ("region",),
) -> DataFrame:
    """Percent change of the current year from the long-term mean, in one aggregate."""
    complete = F.lit(True)
    for c in df.columns:
        complete = complete & F.col(c).isNotNull()
    past = complete & (F.col("year") < current)
    now = F.col("year") == current
    return df.groupBy(*keys).agg(
        *[
            pct_change(F.max(F.when(now, F.col(m))), F.avg(F.when(past, F.col(m)))).alias(m)
            for m in measures
        ]
    )


def wetland_summary_table(
    df: DataFrame,
    current: int,
    n: int = 10,
    design: SurveyDesign = SurveyDesign(),
    measures: Sequence[str] = WETLAND_MEASURES,
) -> DataFrame:
    """Recent years, changes and means as text, in table order (``row_order``, ``label``)."""

    def rows(part: DataFrame, order: int, label: Column, as_text) -> DataFrame:
        return part.select(
            "region",
            F.lit(order).alias("row_order"),
            label.alias("label"),
            *[as_text(F.col(m)).alias(m) for m in measures],
        )

    table = rows(last_n_surveys(df, n), 1, F.col("year").cast("string"), decimal_text)
    # The labels of the table's last rows.
    for part in (
        rows(
            pct_change_previous(df, measures),
            2,
            F.lit("% Change from previous year"),
            percent_text,
        ),
        rows(
            long_term_mean(df, current, measures),
            3,
            F.lit(f"Long-term mean ({design.first_year}--{current - 1})"),
            decimal_text,
        ),
        rows(
            pct_change_long_term(df, current, measures),
            4,
            F.lit("% Change from long-term mean"),
            percent_text,
        ),
        rows(recent_mean(df, n, measures), 5, F.col("label"), decimal_text),
    ):
        table = table.unionByName(part)
    return table


def _magnitude(change: Column) -> Column:
    return percent_text(F.abs(F.bround(change, 1)))


def _direction(change: Column, down: str, up: str) -> Column:
    return F.when(F.bround(change, 1) < 0, F.lit(down)).otherwise(F.lit(up))


def change_narrative(
    df: DataFrame,
    current: int,
    measures: Sequence[str] = ("non_linear", "linear"),
    keys: Sequence[str] = ("region",),
) -> DataFrame:
    """Size and direction of the wetland changes, one wide row per stratum."""
    previous = pct_change_previous(df, measures, keys).drop("year")
    long_term = pct_change_long_term(df, current, measures, keys)

    def columns(part: DataFrame, since: str) -> DataFrame:
        texts = []
        for m in measures:
            texts.append(_magnitude(F.col(m)).alias(f"percent_change_{since}_{m}"))
            texts.append(_direction(F.col(m), "down", "up").alias(f"direction_{since}_{m}"))
        return part.select(*keys, *texts)

    return columns(previous, "previous").join(columns(long_term, "long_term"), list(keys))


def trend_narrative(trend: DataFrame, current: int) -> DataFrame:
    """The latest trend estimate of each species and how it moved, as text."""
    by_year = Window.partitionBy("species").orderBy("year")
    with_previous = trend.withColumn("previous", F.lag("mean").over(by_year))
    latest = with_previous.groupBy("species").agg(
        F.max_by(F.struct("mean", "lcl", "ucl", "previous"), "year").alias("now"),
        F.avg(F.when(F.col("year") < current, F.col("mean"))).alias("past"),
    )
    year_change = pct_change(F.col("now.mean"), F.col("now.previous"))
    long_change = pct_change(F.col("now.mean"), F.col("past"))
    return latest.select(
        "species",
        comma_text(F.col("now.mean")).alias("mean"),
        comma_text(F.col("now.lcl")).alias("lower"),
        comma_text(F.col("now.ucl")).alias("upper"),
        _magnitude(year_change).alias("deviation_previous_year"),
        _direction(year_change, "lower", "higher").alias("direction_previous_year"),
        _magnitude(long_change).alias("deviation_long_term_mean"),
        _direction(long_change, "lower", "higher").alias("direction_long_term_mean"),
        comma_text(F.col("now.previous")).alias("previous_year_mean"),
    )


def _species_columns(species: Sequence[str]) -> dict[str, tuple[str, str]]:
    """Column name -> (species, value column) of the comparison table."""
    names = {s: s.replace("-", "_").replace(" ", "_") for s in species}
    return {
        f"{kind}_{names[s]}": (s, value)
        for s in species
        for kind, value in (("survey_n", "n"), ("ssm_n", "mean"))
    }


def survey_vs_trend_wide(trend: DataFrame, species: Sequence[str] = TABLE_SPECIES) -> DataFrame:
    """One row per year with the survey and the trend value of every species."""
    return trend.groupBy("year").agg(
        *[
            F.max(F.when(F.col("species") == s, F.col(value))).alias(name)
            for name, (s, value) in _species_columns(species).items()
        ]
    )


def survey_vs_trend_table(
    trend: DataFrame,
    current: int,
    n: int = 10,
    years_before: int = 1,
    species: Sequence[str] = TABLE_SPECIES,
    design: SurveyDesign = SurveyDesign(),
) -> DataFrame:
    """Yearly values, means and changes as text, in table order.

    The recent mean starts ``years_before`` years before the last ``n`` rows.
    """
    columns = list(_species_columns(species))
    wide = survey_vs_trend_wide(trend, species)
    past = F.col("year") < current

    def rows(part: DataFrame, order: int, label: Column, texts: list[Column]) -> DataFrame:
        return part.select(
            F.lit(order).alias("row_order"),
            label.alias("label"),
            *[t.alias(c) for t, c in zip(texts, columns)],
        )

    def means(part: DataFrame, *extra: Column) -> DataFrame:
        return part.agg(*extra, *[F.avg(c).alias(c) for c in columns])

    commas = [comma_text(F.col(c)) for c in columns]
    recent_years = (
        latest_years(wide, n)
        .agg((F.min("year") - years_before).alias("start"), F.max("year").alias("last"))
        .filter(F.col("start").isNotNull())
        .select(F.explode(F.sequence("start", "last")).alias("year"), "start")
    )
    recent = means(wide.join(recent_years, "year"), F.max("start").alias("start"))
    recent_label = F.concat(
        F.lit(f"{n}-year mean ("), F.col("start"), F.lit(f"--{current})")
    )
    last_two = (
        wide.join(latest_years(wide, 2), "year", "left_semi")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            *[
                pct_change(F.max_by(c, "year"), F.min_by(c, "year")).alias(c)
                for c in columns
            ],
        )
        .filter(F.col("_rows") == 2)
    )
    long_change = wide.agg(
        *[
            pct_change(
                F.max(F.when(F.col("year") == current, F.col(c))), F.avg(F.when(past, F.col(c)))
            ).alias(c)
            for c in columns
        ]
    )
    percents = [percent_text(F.col(c)) for c in columns]
    # The labels of the table's last rows.
    parts = (
        rows(
            means(wide.filter(past)),
            2,
            F.lit(f"Long-term mean ({design.first_year}--{current - 1})"),
            commas,
        ),
        rows(recent, 3, recent_label, commas),
        rows(
            last_two,
            4,
            F.lit("% change from previous year"),
            [F.coalesce(p, F.lit("")) for p in percents],
        ),
        rows(
            long_change,
            5,
            F.lit(f"% change from {design.first_year}--{current - 1}"),
            [F.coalesce(p, F.lit("NA%")) for p in percents],
        ),
    )
    table = rows(wide, 1, F.col("year").cast("string"), commas)
    for part in parts:
        table = table.unionByName(part)
    return table


def recent_species_table(
    trend: DataFrame, species: str = "trumpeter swan", start_year: int = 2010
) -> DataFrame:
    """Survey and modelled estimates of one species since a year, as text."""
    kept = trend.filter((F.col("species") == species) & (F.col("year") >= start_year))
    return kept.select(
        "year",
        comma_text(F.col("n")).alias("survey_estimate"),
        comma_text(F.col("mean")).alias("model_estimate"),
    )


def estimate_table(estimates: DataFrame, design: SurveyDesign = SurveyDesign()) -> DataFrame:
    """Stratum rows and a statewide row per species group, in table order, as text."""
    state = F.grouping("region") == 1
    sets = [["species", "region"], ["species"]]

    def stratum_only(c: str) -> Column:
        return F.when(~state, F.max(c)).alias(c)

    rolled = estimates.groupingSets(sets, "species", "region").agg(
        state.alias("is_state"),
        stratum_only("area"),
        stratum_only("b"),
        stratum_only("r"),
        F.sum("pop_est").alias("pop_est"),
        F.sqrt(F.sum("pop_var")).alias("pop_se_1"),
    )
    order = {g: i for i, g in enumerate(PRIORITY_TITLE_ORDER, start=1)}
    label = F.when(F.col("is_state"), "Statewide total").otherwise(
        design.region_label(F.col("region"))
    )
    stratum_order = F.when(F.col("is_state"), len(design.strata) + 1).otherwise(F.col("region"))
    return rolled.select(
        lookup(F.col("species"), order).alias("species_order"),
        stratum_order.alias("stratum_order"),
        lookup(F.col("species"), PRIORITY_TITLES).alias("species"),
        label.alias("stratum"),
        comma_text(F.col("area")).alias("area"),
        decimal_text(F.col("b"), 3).alias("density"),
        decimal_text(F.col("r"), 3).alias("correction"),
        comma_text(F.col("pop_est")).alias("estimate"),
        comma_text(F.col("pop_se_1")).alias("standard_error"),
    )


def figure_series(
    df: DataFrame,
    measures: Mapping[str, str],
    keys: Sequence[str] = (),
    missing_years: Sequence[int] = SurveyDesign.missing_years,
) -> DataFrame:
    """Long ``(keys, year, series, value)`` rows for drawing, with a NULL row per series in
    each year without a survey so that lines break there."""
    renamed = df.select(*keys, "year", *[F.col(c).alias(label) for c, label in measures.items()])
    long = renamed.unpivot([*keys, "year"], list(measures.values()), "series", "value")
    if not missing_years:
        return long
    found = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    gaps = found.select(
        *keys, F.explode(F.array(*[F.lit(y) for y in missing_years])).alias("year")
    ).select(
        *keys,
        "year",
        F.explode(F.array(*[F.lit(s) for s in measures.values()])).alias("series"),
        F.lit(None).cast("double").alias("value"),
    )
    return long.unionByName(gaps)


def observer_list(
    counts: DataFrame,
    observers: DataFrame,
    columns: Sequence[str] = ("observer1", "observer2"),
    platform: str = "grd",
) -> DataFrame:
    """The ground observers of each year with their names, ``Last, First`` taken apart."""
    name = F.split("full_name", ",")
    last, first = name.getItem(0), F.ltrim(name.getItem(1))
    codes = (
        counts.filter(F.col(platform) == GROUND)
        .select("year", *columns)
        .unpivot("year", list(columns), "observer", "code")
        .select("year", "code")
        .distinct()
        .filter(F.col("code").isNotNull())
    )
    return codes.join(observers, "code", "left").select(
        "year",
        "code",
        last.alias("last_name"),
        first.alias("first_name"),
        F.concat(first, F.lit(" "), last).alias("name"),
    )


def observer_text(listed: DataFrame) -> DataFrame:
    """One line per year naming its observers by last name; codes without a name drop out.
    ``listed`` holds a year's distinct observers, a short list by nature."""
    named = listed.filter(F.col("last_name").isNotNull())
    people = F.array_sort(F.collect_set(F.struct("last_name", "first_name", "name")))
    return named.groupBy("year").agg(
        F.array_join(people.getField("name"), ", ").alias("observers")
    )


def survey_year_count(
    df: DataFrame, keys: Sequence[str], since: int | None = None, value: str | None = None
) -> DataFrame:
    """Distinct survey years per key, from a year on, not counting years without a value."""
    kept = df if since is None else df.filter(F.col("year") >= since)
    kept = kept if value is None else kept.filter(F.col(value).isNotNull())
    return kept.groupBy(*keys).agg(F.count_distinct("year").alias("n_years"))
