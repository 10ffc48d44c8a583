"""Mixing sources to token targets by entropy balancing.

Each document gets a rate r in [0, cap] that stays as near to 1 as possible in relative entropy
while the words of every source add up to its target. The dual has one number per source:
r = min(cap, exp(lambda * z)) with z the document's size over its source's mean size. Newton
steps on the logarithm of the constraint solve it; a bracket keeps a step inside where clipping
bends the curve.

All documents of a source with one size have one rate, so the steps run over counts per (source,
size), a table much smaller than the corpus, and are ordinary joins and sums. Rates are rounded
into copies along the order of sizes: the running sum of the fractions decides, so a source's
words miss its target by about one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm.common import NO_ID, WORD, free_name, running_offsets, table, written
from cohortry.session import pinned

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
# A rate's fixed-point unit: sums of rates are whole numbers, the same in any order.
UNIT = 1 << 24
# Rows of equal source and size that are numbered together.
NUMBERED_ROWS = 400
MAX_STEPS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, skey): skey is the source as a key that is never null."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source"),
        word_count(F.col("text")).alias("size"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")).alias("skey"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   cap: int = CAP) -> DataFrame:
    """(skey, sid, docs, source_size, target) per source.

    Sources in code-point order, null last, take the weights in turn and share ``share`` of
    all words; what lies above ``cap`` times a source's size goes to the others by weight.
    """
    per = sizes.groupBy("source", "skey").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ranked = running_offsets(per.withColumn("one", F.lit(1).cast("long")),
                             [F.col("source").asc_nulls_last()], ["one"], "sources")
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    s = written(ranked.select(
        "skey", F.col("before_one").alias("sid"), "docs", "source_size",
        kinds[(F.col("before_one") % len(weights)).cast("int")].alias("weight")), "weights")
    most = F.col("source_size") * float(cap)
    wanted = share * (s.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:  # the level only rises; each round adds a capped source or ends
        above = F.col("weight") * level > most
        full, weight, n = s.agg(F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight"))),
                                F.count_if(above)).first()
        if n == capped or not weight:
            break
        level, capped = (wanted - (full or 0.0)) / weight, n
    return s.select("skey", "sid", "docs", "source_size",
                    F.least(F.col("weight") * level, most).alias("target"))


def _rate(lam: Column, z: Column, cap: int) -> Column:
    return F.when(lam * z >= F.lit(float(cap)), float(cap)).otherwise(
        F.least(F.exp(lam * z), F.lit(float(cap))))


def solve(hist: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """(sid, mean, lam) of the dual. ``hist``: (sid, size, n), sizes above zero.

    A target of ``cap`` times the size gives the upper end of the bracket, where every rate
    is clipped; a target of zero gives a lambda so low that every rate is zero.
    """
    words, goal = F.col("source_size"), F.col("target")
    mean = words / F.col("docs")
    top = mean * F.log(F.lit(float(cap))) * 1.0001
    state = pinned(targets.where(words > 0).select(
        "sid", "source_size", "target", mean.alias("mean"),
        F.when(goal >= words * float(cap), top).when(goal <= 0, -800.0 * mean)
        .otherwise(0.0).alias("lam"),
        F.when(goal > words, 0.0).otherwise(-800.0 * mean).alias("lo"),
        F.when(goal > words, top).otherwise(0.0).alias("hi"),
        ((goal >= words * float(cap)) | (goal <= 0)).alias("done")))
    for _ in range(MAX_STEPS):
        open_ = state.where("NOT done").select("sid", "mean", "lam")
        z = F.col("size") / F.col("mean")
        rate = _rate(F.col("lam"), z, cap)
        words_at = F.round(rate * UNIT).cast("decimal(18,0)") * (F.col("size") * F.col("n"))
        slope = F.when(rate < cap, rate * z * F.col("size") * F.col("n")).otherwise(0.0)
        sums = hist.join(open_, "sid").groupBy("sid").agg(
            (F.sum(words_at.cast("decimal(38,0)")).cast("double") / UNIT).alias("g"),
            F.sum(slope.cast("decimal(38,6)")).cast("double").alias("dg"))
        step = F.col("lam") - F.log(F.col("g") / F.col("target")) * F.col("g") / F.col("dg")
        high = F.col("g") > F.col("target")
        moved = state.join(pinned(sums), "sid", "left").withColumns({
            "hi": F.when(high, F.col("lam")).otherwise(F.col("hi")),
            "lo": F.when(high, F.col("lo")).otherwise(F.coalesce(F.when(
                F.col("g").isNotNull(), F.col("lam")), F.col("lo")))})
        inside = step.isNotNull() & (step > F.col("lo")) & (step < F.col("hi"))
        near = (F.abs(F.col("g") - F.col("target")) <= 0.25 + 1e-7 * F.col("target")) | (
            F.col("hi") - F.col("lo") <= 1e-11)
        state = pinned(moved.select(
            "sid", "source_size", "target", "mean",
            F.when(F.col("done") | near, F.col("lam")).otherwise(F.round(
                F.when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2), 12)).alias("lam"),
            "lo", "hi", (F.col("done") | F.coalesce(near, F.lit(False))).alias("done")))
        if state.where("NOT done").isEmpty():
            break
    return state.select("sid", "mean", "lam")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, rate, copies), one per row of docs.

    size is the number of words, 0 for null or empty text, which has rate 1 and one copy.
    copies is at most ``cap``; taken is copies * size. Null sources are one source, the last.
    Repeated rows are separate rows of their source. An empty table gives no rows.
    """
    sizes = written(sized(docs), "sizes")
    targets = written(source_targets(sizes, weights, share, cap), "targets")
    placed = sizes.join(targets.select("skey", "sid"), "skey")
    hist = written(placed.groupBy("sid", "size").agg(F.count(F.lit(1)).alias("n")), "hist")
    duals = solve(hist.where("size > 0"), targets, cap)

    rate = F.coalesce(_rate(F.col("lam"), F.col("size") / F.col("mean"), cap), F.lit(1.0))
    rated = hist.join(duals, "sid", "left").withColumn("rate", rate).withColumns({
        "whole": F.floor("rate").cast("long"),
        "part": F.round((F.col("rate") - F.floor("rate")) * UNIT).cast("long")}).withColumn(
        "mass", F.col("part") * F.col("n")).drop("lam", "mean")
    cum = running_offsets(rated, [F.col("sid"), F.col("size")], ["mass"], "rates")
    cells = written(cum.withColumn("buckets", F.ceil(F.col("n") / NUMBERED_ROWS)), "cells")

    # Rows of one (source, size) are numbered in buckets of bounded size.
    cell = ["sid", "size"]
    rows = placed.join(cells.select(*cell, "buckets", "rate", "whole", "part", "before_mass"),
                       cell).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), "buckets"))
    rows = written(rows, "rated")
    counts = rows.groupBy(*cell, "bucket").agg(F.count(F.lit(1)).alias("in_bucket"))
    earlier = Window.partitionBy(*cell).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.withColumn("start", F.coalesce(F.sum("in_bucket").over(earlier),
                                                           F.lit(0))), "starts")
    seat = F.row_number().over(Window.partitionBy(*cell, "bucket").orderBy("doc_id"))
    last = F.col("before_mass") + F.col("part") * (F.col("start") + F.col("seat"))
    copies = F.col("whole") + F.floor((last + UNIT // 2) / UNIT) - F.floor(
        (last - F.col("part") + UNIT // 2) / UNIT)
    # With its seat a row is told from others of its id; the seats are written with it.
    taken = rows.join(starts.drop("in_bucket"), [*cell, "bucket"]).withColumn(
        "seat", seat).withColumn("copies", F.least(copies, F.lit(cap)).cast("long"))
    taken = _nudged(_nudged(written(taken, "copies"), targets), targets)
    return taken.join(targets.drop("docs", "skey"), "sid").select(
        "doc_id", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")


def _nudged(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """In each source, one row is rounded the other way: the one whose size is nearest to the
    words that are missing or too many, if that brings the sum nearer to the target. Of rows
    that share an id, or have none, it is still one."""
    sums = rows.groupBy("sid").agg(F.sum(F.col("copies") * F.col("size")).alias("now"))
    miss = written(targets.select("sid", "target").join(sums, "sid").select(
        "sid", (F.col("target") - F.col("now")).alias("miss")), "misses")
    up, size, gap = F.col("miss") > 0, F.col("size"), F.abs(F.col("miss"))
    free = (F.col("part") > 0) & F.when(up, F.col("copies") == F.col("whole")).otherwise(
        F.col("copies") > F.col("whole"))
    off = F.abs(gap - size)
    row = ["size", "bucket", "seat"]
    pick = rows.join(miss, "sid").where(free & (off < gap)).groupBy("sid").agg(
        F.min(F.struct(off.alias("off"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"),
                       *row)).alias("p"),
        F.max(F.when(up, 1).otherwise(-1)).alias("move"))
    picked = written(pick.select("sid", *[f"p.{c}" for c in row], "move"), "nudges")
    return rows.join(picked, ["sid", *row], "left").select(
        *[c for c in rows.columns if c != "copies"],
        (F.col("copies") + F.coalesce("move", F.lit(0))).alias("copies"))


def repeat_rows(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; rows repeated with one id
    share the decision of one of them, the largest."""
    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    k, times, turn = (free_name(docs, c) for c in ("_key", "_times", "_turn"))
    copies = written(mix(docs, **settings).groupBy(key.alias(k)).agg(
        F.max("copies").cast("int").alias(times)), "copies")
    # One row of copies per document: always by shuffle, as in every large corpus.
    return docs.withColumn(k, key).join(copies.where(F.col(times) > 0).hint("merge"), k).withColumn(
        turn, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
