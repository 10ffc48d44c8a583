"""What the resampling step sends to its tasks, and the weights it makes there."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortry.functions import hashing
from cohortry.operators import bootstrap


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_dealt_by_one_number(spark):
    rows = spark.createDataFrame(
        [(None if i % 3 else "main", "m", f"y{i % 2}", i, i % 5 == 0, i / 7) for i in range(60)],
        "cohort string, model string, label string, row_id long, y_true boolean, score_raw double")
    sums = bootstrap.draw_sums(rows.withColumn("y_true", F.col("y_true").cast("int")), 4)
    dealt = [x for x in _plan(sums).splitlines() if "REPARTITION_BY_NUM" in x]
    assert dealt and all("hashpartitioning(_unit" in x for x in dealt)
    got = {(r.cohort, r.label): r.n for r in sums.groupBy("cohort", "label").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(c, y): 4 for c in (None, "main") for y in ("y0", "y1")}


def test_weights_of_any_draws_are_those_of_the_columns(spark):
    rows = spark.range(70).select(*[hashing.row_lane(F.col("id"), i).alias(f"l{i}") for i in (0, 1)],
                                  F.explode(F.array(*[F.lit(d) for d in (3, 8, 1003)])).alias("d"))
    got = rows.select("l0", "l1", "d", hashing.poisson_weight(
        hashing.draw_hash(F.col("l0"), F.col("l1"), F.col("d"))).alias("w")).toPandas()
    for d, part in got.groupby("d"):
        w = bootstrap.draw_weights(part.l0.to_numpy(), part.l1.to_numpy(), np.array([d]))
        assert (w[:, 0] == part.w.to_numpy()).all()


def test_weights_of_a_key_are_made_once_for_all_its_cells(monkeypatch):
    n, cells, rng = 70, 3, np.random.default_rng(5)
    lanes = rng.integers(0, hashing.PRIME, (2, n))
    keys = np.repeat(np.arange(n), cells)
    y, flag = rng.integers(0, 2, n * cells), rng.integers(0, 2, n * cells).astype(float)
    unit = np.tile(np.arange(cells), n)
    flag[unit == 2] = np.nan  # a cell without the rule
    score = rng.random(n * cells)
    batches = pa.table({"_unit": unit, "score_raw": score, "y_true": y, "f": flag,
                        "_l0": lanes[0][keys], "_l1": lanes[1][keys]}).to_batches(max_chunksize=40)
    made, maker = [], bootstrap._weight_maker

    def spy(first, n_draws):
        make = maker(first, n_draws)
        return lambda a, b: made.append(len(a)) or make(a, b)
    monkeypatch.setattr(bootstrap, "_weight_maker", spy)

    def sums():
        out = pa.Table.from_batches(bootstrap._key_sums(5, ["f"])(iter(batches))).to_pandas()
        return out.groupby(["_unit", "draw"]).agg(
            {"lo": "min", "hi": "max", **{c: lambda x: x.sum(skipna=False)
                                          for c in ("wp", "wn", "hit_p0", "hit_n0")}})
    got = sums()
    assert n <= sum(made) <= n + len(batches)
    w = bootstrap.draw_weights(lanes[0], lanes[1], np.arange(5))[keys]
    for (u, d), r in got.iterrows():
        at = unit == u
        assert (r.lo, r.hi) == (score[at].min(), score[at].max())
        assert (r.wp, r.wn) == ((w[:, d] * y)[at].sum(), (w[:, d] * (1 - y))[at].sum())
        hits = [(w[:, d] * flag * x)[at].sum() for x in (y, 1 - y)]
        assert [r.hit_p0, r.hit_n0] == hits or u == 2 and np.isnan([r.hit_p0, r.hit_n0]).all()
    with monkeypatch.context() as m:  # units that a batch has again take no more room
        m.setattr(bootstrap, "SUM_BYTES", cells * 4 * 4 * 5)
        assert len(list(bootstrap._key_sums(5, ["f"])(iter(batches)))) == cells
    for limit, value in (("SUM_ROWS", 20), ("SUM_BYTES", 1)):  # sums that leave in parts
        with monkeypatch.context() as m:
            m.setattr(bootstrap, limit, value)
            assert sums().equals(got)
