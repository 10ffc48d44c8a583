"""Rows as text passages under a token budget.

One partition of the fields serves all rows, so that no row's text depends on
how its own values happened to fill a passage.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions.text import JOIN, PREFIX, field_text, passage, value_text, word_count
from cohortry.operators.harmonize import mask_columns

# The encoder's window, and the share of it a passage may plan for.
MAX_TOKENS, BUDGET, PREFIX_TOKENS = 512, 480, 6
SPECIAL_TOKENS = 2
Counter = Callable[[Column], Column]


def require_labels(columns: Sequence[str], labels: Mapping[str, str]) -> None:
    unlabelled = [c for c in columns if c not in labels]
    unused = [c for c in labels if c not in columns]
    if unlabelled or unused:
        raise ValueError(f"columns without a label {unlabelled}; labels without a column {unused}")


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) for the keys only one of two tables has."""
    return left.join(right, key, "left_anti").select(key, F.lit("left").alias("side")).unionByName(
        right.join(left, key, "left_anti").select(key, F.lit("right").alias("side")))


def texts_of_columns(df: DataFrame, columns: Sequence[str]
                     ) -> tuple[DataFrame, dict[str, Column]]:
    """The table with its number texts, and one text column per field.

    The numbers go through one function over one array: written out per column,
    the generated code of a wide table would be too large to be compiled well.
    """
    floating = [c for c in columns if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    values = {c: value_text(F.col(c), df.schema[c].dataType) for c in columns if c not in floating}
    if floating:
        numbers = F.array(*[F.col(c).cast("double") for c in floating])
        df = df.withColumn("_numbers", F.transform(
            numbers, lambda x: value_text(x, T.DoubleType())))
        values.update({c: F.col("_numbers")[i] for i, c in enumerate(floating)})
    return df, values


def sentences(df: DataFrame, labels: Mapping[str, str], mask: Sequence[str] = (),
              row_id: str = "row_id") -> DataFrame:
    """(row_id, text): all labelled columns in label order, masked ones as missing."""
    columns = list(labels)
    df, values = texts_of_columns(mask_columns(df, mask), columns)
    return df.select(row_id, passage(labels, values, columns).alias("text"))


def passages(df: DataFrame, labels: Mapping[str, str], groups: Sequence[Sequence[str]],
             mask: Sequence[str] = (), keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """(keep.., chunk, text): one passage per field group, each with the prefix."""
    df, values = texts_of_columns(mask_columns(df, mask), [c for g in groups for c in g])
    texts = F.array(*[passage(labels, values, g) for g in groups])
    return df.select(*keep, F.posexplode(texts).alias("chunk", "text"))


def field_costs(df: DataFrame, labels: Mapping[str, str], mask: Sequence[str] = (),
                counters: Sequence[Counter] = (word_count,)) -> DataFrame:
    """(pos, column, cost): the most tokens a field takes in any row under any
    counter, with its joiner. All fields in one pass; nothing is exploded."""
    columns = list(labels)
    df, values = texts_of_columns(mask_columns(df, mask), columns)

    def cost(c: str) -> Column:
        text = F.concat(field_text(labels[c], values[c]), F.lit(JOIN))
        counts = [k(text) for k in counters]
        return F.max(F.greatest(*counts) if len(counts) > 1 else counts[0])

    wide = df.agg(*[cost(c).alias(f"c{i}") for i, c in enumerate(columns)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"), F.col(f"c{i}").alias("cost"))
        for i, c in enumerate(columns)])))


def pack(costs: DataFrame, budget: int = BUDGET, overhead: int = PREFIX_TOKENS,
         keys: Sequence[str] = ()) -> DataFrame:
    """(keys, pos, column, cost, chunk): contiguous groups filled up to the budget.

    A fold over the fields in order: a new group starts where the next field
    would burst the running one, and a group is never empty. The list has one
    entry per column of a table.
    """
    fields = F.sort_array(F.collect_list(F.struct("pos", "column", "cost")))
    start = F.struct(F.lit(overhead).cast("long").alias("used"), F.lit(0).alias("chunk"),
                     F.array().cast("array<int>").alias("chunks"))

    def step(state: Column, f: Column) -> Column:
        burst = (F.size(state["chunks"]) > 0) & (state["used"] + f["cost"] > budget)
        chunk = F.when(burst, state["chunk"] + 1).otherwise(state["chunk"])
        used = F.when(burst, F.lit(overhead).cast("long")).otherwise(state["used"]) + f["cost"]
        return F.struct(used.alias("used"), chunk.alias("chunk"),
                        F.array_append(state["chunks"], chunk).alias("chunks"))

    packed = costs.groupBy(*keys).agg(fields.alias("fields")).select(
        *keys, "fields", F.aggregate("fields", start, step, lambda s: s["chunks"]).alias("chunks"))
    return packed.select(*keys, F.inline(F.arrays_zip("fields", "chunks"))).select(
        *keys, "fields.pos", "fields.column", "fields.cost", F.col("chunks").alias("chunk"))


def plan_groups(plan: DataFrame) -> list[list[str]]:
    """The groups of a plan as column lists; one row per column of a table."""
    out: dict[int, list[str]] = {}
    for r in plan.orderBy("pos").collect():
        out.setdefault(r["chunk"], []).append(r["column"])
    return [out[k] for k in sorted(out)]


def describe(plan: DataFrame, overhead: int = PREFIX_TOKENS) -> DataFrame:
    """(chunk, first_field, last_field, n_fields, worst_tokens)."""
    return plan.groupBy("chunk").agg(
        F.min_by("column", "pos").alias("first_field"),
        F.max_by("column", "pos").alias("last_field"), F.count(F.lit(1)).alias("n_fields"),
        (F.sum("cost") + overhead).alias("worst_tokens"))


def save_plan(plan: DataFrame, path: str, masked: Sequence[str]) -> None:
    """Writes a plan with the columns that were masked when it was made."""
    plan.withColumn("masked", F.col("column").isin(*masked) if masked else F.lit(False)
                    ).write.mode("overwrite").parquet(path)


def plan_differences(spark: SparkSession, path: str, masked: Sequence[str],
                     columns: Sequence[str]) -> DataFrame:
    """(column, problem): where a saved plan does not fit the configured masking and columns.

    A plan for other columns or another masking has other costs; it must be made anew.
    """
    plan = spark.read.parquet(path).select("column", F.col("masked").alias("was"))
    now = spark.createDataFrame([(c, c in masked) for c in columns], "column string, now boolean")
    problem = (F.when(F.col("was").isNull(), "not in the plan")
               .when(F.col("now").isNull(), "not configured")
               .when(F.col("was") != F.col("now"), "masked differently"))
    return plan.join(now, "column", "full").select("column", problem.alias("problem")).where(
        F.col("problem").isNotNull())


def check_plan(spark: SparkSession, path: str, masked: Sequence[str],
               columns: Sequence[str]) -> None:
    """Refuses a saved plan that does not fit; see ``plan_differences``."""
    bad = plan_differences(spark, path, masked, columns).collect()  # a row per column at most
    if bad:
        raise ValueError(f"the plan was made under another setting; recalibrate: "
                         f"{sorted((r['column'], r['problem']) for r in bad)}")


def truncation_audit(chunks: DataFrame, keys: Sequence[str], max_tokens: int = MAX_TOKENS,
                     counter: Counter = word_count, special: int = SPECIAL_TOKENS) -> DataFrame:
    """(keys, n_chunks, longest, n_over, headroom) of passages in ``text``."""
    counted = chunks.select(*keys, (counter(F.col("text")) + special).alias("tokens"))
    return counted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.max("tokens").alias("longest"),
        F.count_if(F.col("tokens") > max_tokens).alias("n_over"),
        (F.lit(max_tokens) - F.max("tokens")).alias("headroom"))


def fields_present(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, n_rows, mean_fields): recorded fields per row."""
    present = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.avg(present).alias("mean_fields"))


def first_rows(df: DataFrame, k: int, row_id: str = "row_id") -> DataFrame:
    return df.orderBy(row_id).limit(k)


def prefix_tokens(spark, counters: Sequence[Counter] = (word_count,),
                  special: int = SPECIAL_TOKENS) -> int:
    """What the prefix and the encoder's own marks cost."""
    row = spark.range(1).select(*[c(F.lit(PREFIX)).alias(f"c{i}") for i, c in enumerate(counters)])
    return max(row.first()) + special
