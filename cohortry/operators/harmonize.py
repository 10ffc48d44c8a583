"""Harmonisation of yearly tables whose columns and codings changed."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.operators.prefix import RANGE_ROWS, exact_quantiles

# The linear proxy for a haemoglobin level from a haematocrit.
PROXY_SLOPE, PROXY_INTERCEPT = 0.344, -0.56


def temporal_split(year: Column, train_to: int, test_from: int) -> Column:
    """Development years, later test years, and NULL for the gap between."""
    return F.when(year <= train_to, "train").when(year >= test_from, "test")


def backfill_casetype(casetype: Column, emergency: Column, elective: Column) -> Column:
    """Case type of early years from the two old flags.

    An elective flag of No on a case that is no emergency stays Elective: the
    early years do not tell urgent cases apart.
    """
    by_flag = (F.when(emergency == "Yes", "Emergent").when(emergency == "No", "Elective")
               .when(elective == "Yes", "Elective"))
    return F.coalesce(casetype, by_flag)


def flag_from_casetype(flag: Column, casetype: Column, value: str) -> Column:
    """A discontinued Yes/No flag of later years from the case type."""
    return F.coalesce(flag, F.when(casetype == value, "Yes")
                      .when(casetype.isNotNull(), "No"))


def linear_proxy(value: Column, source: Column, slope: float = PROXY_SLOPE,
                 intercept: float = PROXY_INTERCEPT) -> Column:
    """The measured value, else a straight line through another measurement."""
    return F.coalesce(value, source * F.lit(slope) + F.lit(intercept))


def proxy_fit(df: DataFrame, value: str, source: str, slope: float = PROXY_SLOPE,
              intercept: float = PROXY_INTERCEPT, keys: Sequence[str] = (),
              range_rows: int = RANGE_ROWS) -> DataFrame:
    """How good the proxy is on rows with both: fitted line, R2, absolute errors."""
    keys = list(keys)
    pairs = df.where(F.col(value).isNotNull() & F.col(source).isNotNull()).withColumn(
        "err", F.abs(F.col(value) - (F.col(source) * F.lit(slope) + F.lit(intercept))))
    if not keys:
        keys = ["all"]
        pairs = pairs.withColumn("all", F.lit(1))
    fit = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.regr_slope(value, source).alias("slope"),
        F.regr_intercept(value, source).alias("intercept"),
        F.regr_r2(value, source).alias("r2"))
    errs = exact_quantiles(pairs, keys, "err", [0.5, 0.9], range_rows).groupBy(*keys).agg(
        F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).alias("abs_err_p50"),
        F.max(F.when(F.col("prob") == 0.9, F.col("quantile"))).alias("abs_err_p90"))
    out = fit.join(errs, keys)
    return out.drop("all") if keys == ["all"] else out


def rename_check(df: DataFrame, old: tuple[str, int], new: tuple[str, int], year: str,
                 probs: Sequence[float] = (0.05, 0.5, 0.95),
                 range_rows: int = RANGE_ROWS) -> DataFrame:
    """Two names, two adjacent years, one scale? Their quantiles side by side."""
    (old_col, old_year), (new_col, new_year) = old, new
    # One pass: each row yields a value for whichever name its year used.
    named = df.where(F.col(year).isin(old_year, new_year)).select(
        F.when(F.col(year) == old_year, "old").otherwise("new").alias("name"),
        F.when(F.col(year) == old_year, F.col(old_col)).otherwise(F.col(new_col)).alias("value"))
    q = exact_quantiles(named, ["name"], "value", probs, range_rows)
    return q.groupBy("prob").agg(
        F.max(F.when(F.col("name") == "old", F.col("quantile"))).alias("old_value"),
        F.max(F.when(F.col("name") == "new", F.col("quantile"))).alias("new_value"))


def union_years(tables: Iterable[DataFrame]) -> DataFrame:
    """Stacks yearly tables; a column a year lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def recorded_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, n_rows, n_recorded): all columns in one pass over the data."""
    wide = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(F.col(c)).alias(f"_n_{i}") for i, c in enumerate(columns)])
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"_n_{i}").alias("n_recorded"))
               for i, c in enumerate(columns)]
    return wide.select(*keys, "n_rows", F.inline(F.array(*entries)))


def model_columns(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with at least one recorded value in the training rows."""
    return recorded_counts(train, columns).select(
        "column", "n_recorded", (F.col("n_recorded") > 0).alias("in_model"))


def mask_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sets columns to missing in every cohort; an unknown name is an error."""
    unknown = sorted(set(columns) - set(df.columns))
    if unknown:
        raise ValueError(f"cannot mask columns that are not there: {unknown}")
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in columns})


def availability_by_year(df: DataFrame, columns: Sequence[str], year: str,
                         derivable: Mapping[str, str] | None = None) -> DataFrame:
    """(column, years_present, n_years, availability) from the values themselves.

    ``derivable`` names the columns a rule can fill: 'partially' or 'fully'.
    """
    counts = recorded_counts(df, columns, [year])
    seen = F.when(F.col("n_recorded") > 0, F.col(year))
    # At most one row per column and year arrives here.
    per = counts.groupBy("column").agg(
        F.sort_array(F.collect_set(seen)).alias("years"), F.count_distinct(year).alias("all_years"))
    kind = F.when(F.size("years") == F.col("all_years"), "present in all years")
    for c, how in (derivable or {}).items():
        kind = kind.when(F.col("column") == c, f"{how} derivable")
    return per.select(
        "column",
        F.array_join(F.col("years").cast("array<string>"), ",").alias("years_present"),
        F.size("years").cast("long").alias("n_years"),
        kind.otherwise("absent in some years").alias("availability"))


def crosswalk_pct(df: DataFrame, groups: Mapping[str, Sequence[str]], cohort: str) -> DataFrame:
    """(difference, cohort, pct_observed): mean recorded share of a group's columns."""
    member = [(g, c) for g, cols in groups.items() for c in cols]
    counts = recorded_counts(df, sorted({c for _, c in member}), [cohort])
    entries = F.array(*[F.struct(F.lit(g).alias("difference"), F.lit(c).alias("member"))
                        for g, c in member])
    pct = counts.select(cohort, "column", "n_rows", "n_recorded", F.inline(entries)).where(
        F.col("member") == F.col("column"))
    return pct.groupBy("difference", cohort).agg(
        F.avg(100.0 * F.col("n_recorded") / F.col("n_rows")).alias("pct_observed"))


def apply_rules(df: DataFrame) -> DataFrame:
    """The six derivation rules on the prespecified field names.

    All read the columns as recorded, so no rule builds on another's result and
    their order does not matter. Absent columns count as missing.
    """
    kinds = {"CASETYPE": "string", "EMERGNCY": "string", "ELECTSURG": "string",
             "PRHEMOGLOBIN": "double", "PRHCT": "double", "HEMO": "double",
             "PRHEMO_A1C": "double"}
    raw = df.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in df.columns})
    c = {k: F.col(k) for k in kinds}
    return raw.withColumns({
        "CASETYPE": backfill_casetype(c["CASETYPE"], c["EMERGNCY"], c["ELECTSURG"]),
        "EMERGNCY": flag_from_casetype(c["EMERGNCY"], c["CASETYPE"], "Emergent"),
        "ELECTSURG": flag_from_casetype(c["ELECTSURG"], c["CASETYPE"], "Elective"),
        "PRHEMOGLOBIN": linear_proxy(c["PRHEMOGLOBIN"], c["PRHCT"]),
        "HEMO": F.coalesce(c["HEMO"], c["PRHEMO_A1C"]),
        "PRHEMO_A1C": F.coalesce(c["PRHEMO_A1C"], c["HEMO"])})


def split_types(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns by stored type, in schema order."""
    keep = list(columns) if columns is not None else df.columns
    numeric = [c for c in keep if isinstance(df.schema[c].dataType, T.NumericType)]
    return numeric, [c for c in keep if c not in numeric]
