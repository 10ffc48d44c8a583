"""Preprocessing fitted once and applied unchanged to later and other cohorts.

A fitted state is two tables: ``numeric`` (column, median, mean, std) and
``levels`` (column, mode, level, pos, freq, mu, sd). Fitting reads all columns
together: one pass for the medians, one for mean and spread, one for the levels.
"""

from __future__ import annotations

from collections.abc import Sequence
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.functions.missing import nan_to_null, normalise_missing
from cohortry.operators.harmonize import split_types
from cohortry.operators.prefix import RANGE_ROWS, exact_quantiles, running_totals, split_points
from cohortry.session import BROADCAST_BYTES, pinned, settle
from cohortry.sources.tables import require_columns

VIEWS = ("linear", "matrix", "tree", "embed")
# Fixed values of the feature contract.
ONEHOT_MAX_LEVELS = 30
MAX_VOCAB = 1000
ALL_MISSING = "__all_missing__"

LEVELS_SCHEMA = ("column string, mode string, level string, pos long, freq double, mu double, "
                 "sd double")


# --- fitting -------------------------------------------------------------------

def _stacked(df: DataFrame, columns: Sequence[str], kind: str, extra: Sequence[Column] = ()):
    """(column, value, extra..) rows for all columns at once."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value"))
               for c in columns]
    return df.select(*extra, F.inline(F.array(*entries))).where(F.col("value").isNotNull())


def fit_numeric(df: DataFrame, columns: Sequence[str], exact: bool = True,
                range_rows: int = RANGE_ROWS, accuracy: int = 10_000) -> DataFrame:
    """(column, median, mean, std): mean and sample std are those of the column
    after its missing values became the median. An all-missing column gets median
    0, a constant one std 1.

    With ``exact=False`` the medians are approximate, within 1/accuracy of the
    middle rank, and the value counts are not shuffled.
    """
    columns = list(columns)
    df = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in columns])
    if exact:
        med = {r["column"]: r["quantile"] for r in exact_quantiles(
            _stacked(df, columns, "double"), ["column"], "value", [0.5], range_rows).collect()}
    else:
        row = df.agg(*[F.percentile_approx(c, 0.5, accuracy).alias(c) for c in columns]).first()
        med = row.asDict()
    med = {c: 0.0 if med.get(c) is None else med[c] for c in columns}
    filled = {c: F.coalesce(F.col(c), F.lit(med[c])) for c in columns}
    wide = df.agg(*[F.struct(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")).alias(c)
                    for c, x in filled.items()])
    std = {c: F.coalesce(F.nullif(F.col(f"`{c}`.std"), F.lit(0.0)), F.lit(1.0)) for c in columns}
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(med[c]).alias("median"),
                 F.col(f"`{c}`.mean").alias("mean"), std[c].alias("std")) for c in columns])))


def level_counts(df: DataFrame, columns: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """(column, level, n, first): how often and where first each value occurs."""
    return _stacked(df, columns, "string", [F.col(row_id)]).groupBy(
        "column", F.col("value").alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.min(row_id).alias("first"))


def _state_rows(df: DataFrame, mode: str, **cols: Column) -> DataFrame:
    fields = [x.split() for x in LEVELS_SCHEMA.split(", ")]
    known = {"column": F.col("column"), "mode": F.lit(mode), "level": F.col("level"), **cols}
    return df.select(*[known.get(c, F.lit(None)).cast(t).alias(c) for c, t in fields])


def _by_count() -> Window:
    """Falling count; of equal counts the level seen first comes first."""
    return Window.partitionBy("column").orderBy(F.desc("n"), "first")


def fit_linear_levels(df: DataFrame, columns: Sequence[str], row_id: str = "row_id",
                      max_levels: int = ONEHOT_MAX_LEVELS) -> DataFrame:
    """One-hot levels of columns with few values, relative frequencies of the rest."""
    counts = pinned(level_counts(df, columns, row_id))
    n_rows = df.count()
    per = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_levels"), F.sum("n").alias("n_known"))
    both = counts.join(settle(per), "column")
    few = _state_rows(
        both.where(F.col("n_levels") <= max_levels).withColumn(
            "pos", F.row_number().over(_by_count()) - 1), "onehot", pos=F.col("pos"))

    # Mean and population spread over all fit rows, a missing one counting as 0.
    # Deviations are summed around the mean: the frequencies are tiny numbers.
    many = pinned(both.where(F.col("n_levels") > max_levels).withColumn(
        "freq", F.col("n") / F.col("n_known")))
    means = settle(many.groupBy("column").agg(
        (F.sum(F.col("freq") * F.col("n")) / n_rows).alias("mu")))
    centred = many.join(means, "column")
    off = F.col("freq") - F.col("mu")
    rest = (F.lit(n_rows) - F.max("n_known")) * F.max("mu") * F.max("mu")
    sd = F.sqrt((F.sum(F.col("n") * off * off) + rest) / n_rows)
    spread = settle(centred.groupBy("column").agg(sd.alias("sd")))
    return few.unionByName(_state_rows(
        centred.join(spread, "column"), "freq", freq=F.col("freq"), mu=F.col("mu"),
        sd=F.coalesce(F.nullif(F.col("sd"), F.lit(0.0)), F.lit(1.0))))


def fit_codes(df: DataFrame, columns: Sequence[str], row_id: str = "row_id",
              placeholder: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All levels, numbered from 0 in the order they first appear.

    The numbering is a running count over ``first``, so a column with very many
    levels is not ordered in one task.
    """
    counts = pinned(level_counts(df, columns, row_id))
    points = split_points(counts, "first", range_rows)
    ranked = running_totals(counts.withColumn("one", F.lit(1).cast("long")), ["column"], "first",
                            {"one": F.col("one")}, points=points)
    out = _state_rows(ranked, "codes", pos=F.col("cum_one") - 1)
    if not placeholder:
        return out
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    empty = names.join(out.select("column").distinct(), "column", "left_anti").withColumn(
        "level", F.lit(ALL_MISSING))
    return out.unionByName(_state_rows(empty, "codes", pos=F.lit(0)))


def fit_vocab(df: DataFrame, columns: Sequence[str], row_id: str = "row_id",
              max_vocab: int = MAX_VOCAB) -> DataFrame:
    """The most frequent levels of each column, numbered from 1; 0 is unknown.

    Spark drops later ranks before the shuffle, so each task sends at most
    ``max_vocab`` levels of a column.
    """
    counts = level_counts(df, columns, row_id)
    ranked = counts.withColumn("pos", F.row_number().over(_by_count())).where(
        F.col("pos") <= max_vocab)
    return _state_rows(ranked, "vocab", pos=F.col("pos"))


# --- the fitted state ------------------------------------------------------------

STATE_HEAD = ("version string, published long, view string, num_cols array<string>, "
              "cat_cols array<string>, has_numeric boolean")


@dataclass
class PrepState:
    view: str
    num_cols: list[str]
    cat_cols: list[str]
    numeric: DataFrame | None
    levels: DataFrame
    _cache: dict = field(default_factory=dict, repr=False)

    def numbers(self) -> dict[str, tuple[float, float, float]]:
        """column -> (median, mean, std); one row per column."""
        if "numbers" not in self._cache:
            self._cache["numbers"] = {} if self.numeric is None else {
                r["column"]: (r["median"], r["mean"], r["std"]) for r in self.numeric.collect()}
        return self._cache["numbers"]

    def sizes(self) -> dict[str, dict]:
        """column -> mode, number of levels, mu, sd, bytes; one row per column."""
        if "sizes" not in self._cache:
            rows = self.levels.groupBy("column").agg(
                F.first("mode").alias("mode"), F.count(F.lit(1)).alias("n"),
                F.max("mu").alias("mu"), F.max("sd").alias("sd"),
                F.sum(F.octet_length("level") + 32).alias("bytes")).collect()
            self._cache["sizes"] = {r["column"]: r.asDict() for r in rows}
        return self._cache["sizes"]

    def onehot_levels(self) -> dict[str, list[str]]:
        """column -> levels in order; at most ``ONEHOT_MAX_LEVELS`` a column."""
        if "onehot" not in self._cache:
            out: dict[str, list[str]] = {}
            rows = self.levels.where(F.col("mode") == "onehot").orderBy("column", "pos").collect()
            for r in rows:
                out.setdefault(r["column"], []).append(r["level"])
            self._cache["onehot"] = out
        return self._cache["onehot"]

    def small_columns(self) -> set[str]:
        """The columns whose levels are broadcast: the smallest ones that fit the budget of
        bytes together, as measured when the state was fitted."""
        size = {c: x["bytes"] or 0 for c, x in self.sizes().items() if x["mode"] != "onehot"}
        out, used = set(), 0
        for c in sorted(size, key=size.get):
            used += size[c]
            if used > BROADCAST_BYTES:
                break
            out.add(c)
        return out

    def lookup(self, column: str, value: str) -> DataFrame:
        """(level, value) of one column, broadcast only within the budget of bytes."""
        rows = self.levels.where(F.col("column") == column).select(
            F.col("level").alias(column), F.col(value).alias("_value"))
        return F.broadcast(rows) if column in self.small_columns() or (
            column not in self.sizes()) else rows

    def feature_names(self) -> list[str]:
        if self.view != "linear":
            return self.num_cols + self.cat_cols
        names = list(self.num_cols)
        for c in self.cat_cols:
            if self.sizes().get(c, {}).get("mode") == "freq":
                names.append(f"{c}__freq")
            else:
                names += [f"{c}={v}" for v in self.onehot_levels().get(c, [])]
        return names

    def cardinalities(self) -> list[int]:
        """Embedding table sizes: known levels and the unknown one."""
        return [self.sizes().get(c, {}).get("n", 0) + 1 for c in self.cat_cols]

    def transform(self, df: DataFrame, keep: Sequence[str] = ("row_id",)) -> DataFrame:
        """The view's features of any table with the fitted columns. Fits nothing."""
        require_columns(df, self.num_cols + self.cat_cols)
        df = normalise_missing(df)
        if self.view == "tree":
            numbers = {c: nan_to_null(F.col(c).cast("string").try_cast("double"))
                       for c in self.num_cols}
        elif self.view == "matrix":
            numbers = {c: imputed(c, self.numbers()[c][0]) for c in self.num_cols}
        else:
            numbers = {c: scaled(c, *self.numbers()[c]) for c in self.num_cols}
        out = df.select(*keep, *[x.alias(c) for c, x in numbers.items()],
                        *[F.col(c).cast("string").alias(c) for c in self.cat_cols])
        for c in self.cat_cols:
            out = getattr(self, f"_{self.view}")(out, c)
        return out.select(*keep, *[F.col(f"`{c}`") for c in self.feature_names()])

    def _joined(self, df: DataFrame, c: str, value: str) -> DataFrame:
        return df.join(self.lookup(c, value), c, "left")

    def _linear(self, df: DataFrame, c: str) -> DataFrame:
        size = self.sizes().get(c, {})
        if size.get("mode") == "freq":
            f = F.coalesce(F.col("_value"), F.lit(0.0))
            return self._joined(df, c, "freq").withColumn(
                f"{c}__freq", (f - F.lit(size["mu"])) / F.lit(size["sd"])).drop("_value")
        return df.withColumns({
            f"{c}={v}": F.when(F.col(c) == v, 1.0).otherwise(0.0)
            for v in self.onehot_levels().get(c, [])})

    def _matrix(self, df: DataFrame, c: str) -> DataFrame:
        return self._joined(df, c, "pos").withColumn(
            c, F.coalesce("_value", F.lit(-1)).cast("int")).drop("_value")

    def _embed(self, df: DataFrame, c: str) -> DataFrame:
        return self._joined(df, c, "pos").withColumn(
            c, F.coalesce("_value", F.lit(0)).cast("int")).drop("_value")

    def _tree(self, df: DataFrame, c: str) -> DataFrame:
        known = F.col("_value").isNotNull()
        return self._joined(df, c, "pos").withColumn(c, F.when(known, F.col(c))).drop("_value")

    # --- saved state -------------------------------------------------------------

    def save(self, path: str) -> None:
        """Writes a new version beside the older ones and then publishes it: a reader sees
        the state before or after, never a mixture."""
        spark = self.levels.sparkSession
        version = uuid.uuid4().hex
        if self.numeric is not None:
            self.numeric.write.parquet(f"{path}/{version}/numeric")
        self.levels.write.parquet(f"{path}/{version}/levels")
        spark.createDataFrame(
            [(version, time.time_ns(), self.view, self.num_cols, self.cat_cols,
              self.numeric is not None)], STATE_HEAD).coalesce(1).write.mode("append").json(
            f"{path}/head")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "PrepState":
        """The version published last."""
        head = spark.read.schema(STATE_HEAD).json(f"{path}/head").orderBy(
            F.desc("published"), "version").first()
        numeric = spark.read.parquet(f"{path}/{head.version}/numeric") if head.has_numeric else None
        return PrepState(head.view, list(head.num_cols), list(head.cat_cols), numeric,
                         spark.read.parquet(f"{path}/{head.version}/levels"))


def imputed(c: str, median: float) -> Column:
    return F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(median))


def scaled(c: str, median: float, mean: float, std: float) -> Column:
    return (imputed(c, median) - F.lit(mean)) / F.lit(std)


def fit(view: str, df: DataFrame, columns: Sequence[str] | None = None, row_id: str = "row_id",
        max_levels: int = ONEHOT_MAX_LEVELS, max_vocab: int = MAX_VOCAB,
        exact: bool = True) -> PrepState:
    """Fits one view on the given rows; the state tables are pinned."""
    if view not in VIEWS:
        raise ValueError(f"unknown view: {view}")
    keep = list(columns) if columns is not None else [c for c in df.columns if c != row_id]
    num, cat = split_types(df, keep)
    numeric = None if view == "tree" or not num else pinned(fit_numeric(df, num, exact))
    if not cat:
        levels = df.sparkSession.createDataFrame([], LEVELS_SCHEMA)
    elif view == "linear":
        levels = fit_linear_levels(df, cat, row_id, max_levels)
    elif view == "embed":
        levels = fit_vocab(df, cat, row_id, max_vocab)
    else:
        levels = fit_codes(df, cat, row_id, placeholder=view == "tree")
    return PrepState(view, num, cat, numeric, pinned(levels))


def fit_transform(view: str, train: DataFrame, test: DataFrame,
                  columns: Sequence[str], row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Fit on one table and apply to both."""
    state = fit(view, train, columns, row_id)
    return state.transform(train, [row_id]), state.transform(test, [row_id])


def state_differences(a: PrepState, b: PrepState) -> DataFrame:
    """(part, n_diff): 0 everywhere if two states are the same.

    Levels must agree exactly, numeric statistics within 1e-8 + 1e-5 * |b|.
    """
    def apart(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        far = F.abs(x - y) > F.lit(1e-8) + F.lit(1e-5) * F.abs(y)
        return F.coalesce(far, x.isNull() != y.isNull())

    def count(part: str, left: DataFrame, right: DataFrame, keys, exact, near) -> DataFrame:
        on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
        both = left.alias("a").join(right.alias("b"), on, "full")
        bad = F.col(f"a.{keys[0]}").isNull() | F.col(f"b.{keys[0]}").isNull()
        for c in exact:
            bad = bad | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        for c in near:
            bad = bad | apart(c)
        return both.agg(F.count_if(bad).alias("n_diff")).select(F.lit(part).alias("part"), "n_diff")

    spark = a.levels.sparkSession
    head = int((a.view, a.num_cols, a.cat_cols) != (b.view, b.num_cols, b.cat_cols))
    out = spark.createDataFrame([("contract", head)], "part string, n_diff long")
    out = out.unionByName(count("levels", a.levels, b.levels, ["column", "level"],
                                ["mode", "pos"], ["freq", "mu", "sd"]))
    if a.numeric is not None and b.numeric is not None:
        return out.unionByName(count("numeric", a.numeric, b.numeric, ["column"], [],
                                     ["median", "mean", "std"]))
    one_sided = int((a.numeric is None) != (b.numeric is None))
    return out.unionByName(spark.createDataFrame([("numeric", one_sided)],
                                                 "part string, n_diff long"))
