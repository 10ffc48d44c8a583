"""Bootstrap intervals from resamples that all metrics and models share.

A resample draws every row a Poisson(1) number of times, computed from the row
key and the draw number. So no table of resamples exists, tasks agree without
talking, and models scored on the same rows get the same draws. The size of a
draw varies around n, unlike a draw of exactly n rows; that is the usual form
for distributed data and gives the same spread for large n.

Rows are never repeated per draw. They are spread by (cell, score range);
inside a range the weights of all draws are made and summed with numpy, and only
a few sums per range and draw leave the task. Spark adds the ranges up. Where there
is more than one range, the sums above a range are made first, with the rows spread
by key: the weights of a key are made once for all its cells.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions import hashing
from cohortry.functions.rates import RATE_METRICS, rates
from cohortry.operators.joins import null_safe_join, null_safe_left
from cohortry.operators.prefix import in_ranges, sampled_quantiles
from cohortry.operators.ranking import CELL, known_score
from cohortry.session import pinned, settle

N_DRAWS = 1000
CI = (0.025, 0.975)
# Rows of one group, and of one task, about.
RANGE_ROWS = 500_000
TASK_ROWS = 50_000
# Weights that numpy holds at once: few enough to stay in a core's cache.
ROWS_AT_ONCE, DRAWS_AT_ONCE = 64, 1000
# Weights up to this one are counted for all rows, the few above are looked up.
COMMON = 5
# Sums of the rows of a key are kept up to this many bytes in a task; and up to this many rows of
# a group, as whole numbers in 32-bit floats are exact to 2 ** 24 and a weight is at most 12.
SUM_BYTES, SUM_ROWS = 512 << 20, 1_000_000
# Tasks a core that sum the rows of keys.
KEY_TASKS = 2
# Runs of draws that share their products; eight, so that weights can be looked at by eights.
RUNS = 8
_CELL, _RANGE, _SALT, _UNIT = "_cell", "_range", "_salt", "_unit"


# --- the part that runs inside a task -----------------------------------------

def _weight_maker(first: int, n_draws: int) -> Callable:
    """A function of (lane0, lane1) of at most ``ROWS_AT_ONCE`` rows that gives rows x draws: how
    often each row is drawn in the draws from ``first`` on. It writes into one buffer, so a result
    lasts until the next call."""
    prime, short = np.uint64(hashing.PRIME), np.uint32(hashing.PRIME)
    # A draw's first hash is that of an earlier one and a product of the row and the distance: a
    # run of draws is made by products, the others are sums with one product for a run. Numbers
    # below PRIME are widened with their sign, which is never set: that takes half the time.
    run = math.ceil(n_draws / RUNS)

    def factors(of) -> np.ndarray:
        return np.array([x % hashing.PRIME for x in of], np.uint64)

    in_run = factors((d * hashing.MIX_C + 1) * hashing.MIX_C for d in range(first, first + run))
    to_run = factors(i * run * hashing.MIX_C ** 2 for i in range(RUNS))
    cuts = np.array([c for c in hashing.poisson_cuts() if c <= hashing.PRIME], np.uint32)
    shape = (ROWS_AT_ONCE, RUNS * run)
    buffers = [np.empty(shape, t) for t in (np.int64, np.uint32, np.uint32, np.uint8, np.bool_)]

    def make(lane0: np.ndarray, lane1: np.ndarray) -> np.ndarray:
        wide, h, g, w, over = (x[:len(lane0)] for x in buffers)

        def below_prime():
            # For less than two primes: the difference wraps around where h is below one.
            np.minimum(h, np.subtract(h, short, out=g), out=h)

        def mix(bits: int):
            np.bitwise_xor(h, np.right_shift(h, np.uint32(bits), out=g), out=h)

        start = (lane0[:, None] * in_run + lane1[:, None]) % prime
        steps = lane0[:, None] * to_run % prime
        np.add(start.astype(np.uint32)[:, None, :], steps.astype(np.uint32)[:, :, None],
               out=h.reshape(len(h), RUNS, run))
        below_prime()
        for bits, by in ((15, hashing.MIX_A), (13, hashing.MIX_B)):
            mix(bits)
            np.copyto(wide, h.view(np.int32))
            np.multiply(wide, np.int64(by), out=wide)
            # Below PRIME ** 2, so bits above 31 and the rest add up to less than two primes.
            np.multiply(h, np.uint32(by), out=h)
            np.copyto(g.view(np.int32), np.right_shift(wide, np.int64(31), out=wide),
                      casting="unsafe")
            np.add(np.bitwise_and(h, short, out=h), g, out=h)
            below_prime()
        mix(16)
        w.fill(0)
        for cut in cuts[:COMMON]:
            np.add(w, np.greater_equal(h, cut, out=over).view(np.uint8), out=w)
        np.greater_equal(h, cuts[COMMON], out=over)
        rare = np.flatnonzero(over.reshape(-1).view(np.uint64) != 0)  # eight at once: few have one
        w.reshape(-1, 8)[rare] = np.searchsorted(cuts, h.reshape(-1, 8)[rare], side="right")
        out = g.view(np.float32)
        np.copyto(out, w)
        return out[:, :n_draws]
    return make


def draw_weights(lane0: np.ndarray, lane1: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Rows x draws: how often each row is drawn. Equals the column expressions
    ``draw_hash`` and ``poisson_weight``."""
    first, lanes = int(min(draws)), [x.astype(np.uint64) for x in (lane0, lane1)]
    make = _weight_maker(first, int(max(draws)) + 1 - first)
    out = np.empty((len(lane0), len(draws)))
    for a in range(0, len(out), ROWS_AT_ONCE):
        out[a:a + ROWS_AT_ONCE] = make(*(x[a:a + ROWS_AT_ONCE] for x in lanes))[:, draws - first]
    return out


def _lane(table: pa.Table, name: str) -> np.ndarray:
    if table.column(name).null_count:
        raise ValueError("a row key is NULL: it has no weights")
    return table.column(name).to_numpy().astype(np.uint64)


def _sums(table: pa.Table, n_draws: int, flags: Sequence[str] = (),
          before: tuple[np.ndarray, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Sums of a group per draw: weights of positives and negatives, all and flagged, the area
    and the precision, with ``before`` ranked above.

    Sums of weights are whole numbers, exact as a product of small blocks. Area and precision
    change at the scores of positives alone, so only there the running sums are looked at.
    """
    s, y, l0, l1 = (*(table.column(c).to_numpy() for c in ("score_raw", "y_true")),
                    *(_lane(table, c) for c in ("_l0", "_l1")))
    order = np.argsort(-s, kind="stable")
    s, y, l0, l1 = s[order], y[order].astype(np.float32), l0[order], l1[order]
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    ends = np.r_[starts[1:], len(s)]
    held = np.add.reduceat(y != 0, starts, dtype=np.int64) > 0
    starts, ends = starts[held], ends[held]
    marks = [table.column(f).to_numpy()[order] for f in flags]
    known = [np.nan_to_num(m) for m in marks]
    factors = np.stack([np.ones_like(y), y, *[x for m in known for x in (m * y, m * (1 - y))]]
                       ).astype(np.float32)
    sums = np.zeros((len(factors), n_draws))
    area, prec = np.zeros(n_draws), np.zeros(n_draws)
    above = np.zeros((2, n_draws)) if before is None else np.stack(before)
    row = np.arange(ROWS_AT_ONCE)

    for lo in range(0, n_draws, DRAWS_AT_ONCE):
        part = slice(lo, min(lo + DRAWS_AT_ONCE, n_draws))
        make = _weight_maker(part.start, part.stop - part.start)
        run, (above_p, above_n) = sums[:, part], above[:, part]
        # Positives and negatives above the last score that has begun and not ended.
        open_p = open_n = np.zeros((0, run.shape[1]))
        for a in range(0, len(s), ROWS_AT_ONCE):
            b = min(a + ROWS_AT_ONCE, len(s))
            w = make(l0[a:b], l1[a:b])
            begun = starts[slice(*np.searchsorted(starts, (a, b)))]
            ended = ends[slice(*np.searchsorted(ends, (a, b), side="right"))]
            if len(begun) + len(ended):
                upto = row[:b - a] < (np.r_[begun, ended] - a)[:, None]
                tp = run[1] + (upto * y[a:b]) @ w
                fp = run[0] + upto.astype(np.float32) @ w - tp
                k, n = len(begun), len(ended)
                from_p, from_n = np.r_[open_p, tp[:k]], np.r_[open_n, fp[:k]]
                p, reached, below = tp[k:] - from_p[:n], tp[k:] + above_p, fp[k:] + above_n
                below += reached
                prec[part] += np.divide(p * reached, below, out=np.zeros_like(p),
                                        where=below > 0).sum(axis=0)
                area[part] -= (p * (fp[k:] + from_n[:n])).sum(axis=0) / 2
                open_p, open_n = from_p[n:], from_n[n:]
            run += factors[:, a:b] @ w

    wp, wn = sums[1], sums[0] - sums[1]
    out = {"draw": np.arange(n_draws, dtype=np.int64), "wp": wp, "wn": wn, "area": area + wp * wn, "prec": prec}
    for i, m in enumerate(marks):
        # A rule that the cell does not have flags nothing and gives no number.
        gap = np.nan if np.isnan(m).any() else 0.0
        out[f"hit_p{i}"], out[f"hit_n{i}"] = sums[2 * i + 2] + gap, sums[2 * i + 3] + gap
    return out


def _range_sums(n_draws: int, flags: Sequence[str], names: Sequence[str]) -> Callable:
    def run(key, table):
        out = _sums(table, n_draws, flags)
        return pa.table({_UNIT: np.full(n_draws, key[0].as_py()), **{c: out[c] for c in names}})
    return run


def _key_sums(n_draws: int, flags: Sequence[str]) -> Callable:
    """Sums of the rows of a task per unit and draw, and the lowest and highest score of a unit.

    Rows come in the order of their keys. The weights of a key are made once, and added to the sums
    of every unit that has one of its rows. A unit leaves when its sums may grow beyond what they
    hold exactly, and all do when they take too many bytes: so one may leave in parts.
    """
    n_sums = 2 + 2 * len(flags)
    parts = [slice(lo, min(lo + DRAWS_AT_ONCE, n_draws)) for lo in range(0, n_draws, DRAWS_AT_ONCE)]
    draws = np.arange(n_draws, dtype=np.int64)
    most = max(1, SUM_BYTES // (4 * n_sums * n_draws))

    def run(batches):
        makers = [_weight_maker(x.start, x.stop - x.start) for x in parts]
        held: dict[int, tuple[np.ndarray, list]] = {}

        def leave(unit: int) -> pa.RecordBatch:
            sums, (lo, hi, _, gaps) = held.pop(unit)
            total, wp, *hits = sums.astype(np.float64)
            for i in gaps:  # a rule that the cell does not have gives no number
                hits[2 * i][:] = hits[2 * i + 1][:] = np.nan
            return pa.RecordBatch.from_pydict({
                _UNIT: np.full(n_draws, unit), "draw": draws, "lo": np.full(n_draws, lo),
                "hi": np.full(n_draws, hi), "wp": wp, "wn": total - wp,
                **{f"hit_{'pn'[j % 2]}{j // 2}": x for j, x in enumerate(hits)}})

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            unit, s, y = (table.column(c).to_numpy() for c in (_UNIT, "score_raw", "y_true"))
            lanes = [_lane(table, c) for c in ("_l0", "_l1")]
            marks = [table.column(f).to_numpy() for f in flags]
            known = [np.nan_to_num(m) for m in marks]
            factors = [np.ones(len(y)), y, *[x for m in known for x in (m * y, m * (1 - y))]]
            units, of, times = np.unique(unit, return_inverse=True, return_counts=True)
            new = np.r_[True, (lanes[0][1:] != lanes[0][:-1]) | (lanes[1][1:] != lanes[1][:-1])]
            first, row = np.flatnonzero(new), np.cumsum(new) - 1
            full = [u for u, k in zip(units.tolist(), times.tolist())
                    if u in held and held[u][1][2] + k > SUM_ROWS]
            if held and len(held.keys() | set(units.tolist())) > most:
                full = list(held)
            yield from map(leave, full)
            lows, highs = np.full(len(units), np.inf), np.full(len(units), -np.inf)
            np.minimum.at(lows, of, s)
            np.maximum.at(highs, of, s)
            gaps = [set(of[np.isnan(m)].tolist()) for m in marks]
            for j, u in enumerate(units.tolist()):
                if u not in held:
                    held[u] = (np.zeros((n_sums, n_draws), np.float32),
                               [math.inf, -math.inf, 0, set()])
                about = held[u][1]
                about[:3] = min(about[0], lows[j]), max(about[1], highs[j]), about[2] + int(times[j])
                about[3].update(i for i, g in enumerate(gaps) if j in g)
            sums = [held[u][0] for u in units.tolist()]
            # Per factor the rows that it does not leave out, and where each block of keys begins.
            blocks = range(0, len(first), ROWS_AT_ONCE)
            bounds = np.r_[first[::ROWS_AT_ONCE], len(row)]
            terms = []
            for f in factors:
                at = np.flatnonzero(f)
                terms.append((of[at].tolist(), (row[at] % ROWS_AT_ONCE).tolist(), f[at].tolist(),
                              np.searchsorted(at, bounds).tolist()))
            for x, make in zip(parts, makers):
                views = [[m[k, x] for m in sums] for k in range(n_sums)]
                for b, lo in enumerate(blocks):
                    keys = first[lo:lo + ROWS_AT_ONCE]
                    w = list(make(lanes[0][keys], lanes[1][keys]))
                    for view, (into, rows, by, cut) in zip(views, terms):
                        part = slice(cut[b], cut[b + 1])
                        for u, r, c in zip(into[part], rows[part], by[part]):
                            np.add(view[u], w[r] if c == 1 else w[r] * np.float32(c), out=view[u])
        yield from map(leave, list(held))
    return run


def _range_inside(n_draws: int) -> Callable:
    def run(key, rows, before):
        names = ["draw", "area", "prec"]
        out = {"draw": np.zeros(0, np.int64), "area": np.zeros(0), "prec": np.zeros(0)}
        if rows.num_rows and before.num_rows:
            at = np.argsort(before.column("draw").to_numpy())
            out = _sums(rows, n_draws, before=tuple(
                before.column(c).to_numpy()[at] for c in ("before_p", "before_n")))
        return pa.table({_UNIT: np.full(len(out["draw"]), key[0].as_py()),
                         **{c: out[c] for c in names}})
    return run


# --- the Spark part -----------------------------------------------------------

def numbered_cells(pred: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """(keys, _cell) with a number for each cell, and the rows of all cells. Rows are dealt and
    sorted by one number then, in place of texts that are equal for whole groups."""
    sizes = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy(*(keys or [F.lit(0)]))  # one row per cell
    cells = settle(sizes.withColumn(_CELL, F.row_number().over(order).cast("long")))
    return cells.drop("_n"), cells.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]


def range_plan(df: DataFrame, value: str, range_rows: int = RANGE_ROWS,
               n: int | None = None) -> tuple[list[float], dict[int, int], int]:
    """(cut points, {range number: salts}, rows) so that no group exceeds its share.

    A score that holds several shares by itself gets a range of its own. Ties
    need no order among them, so that range can be salted into smaller groups.
    """
    n = df.count() if n is None else n
    if n <= range_rows:
        return [], {}, n
    cuts = sampled_quantiles(df, value, math.ceil(n / range_rows), n)
    seen = Counter(cuts)
    hot = {c: k for c, k in seen.items() if k > 1}
    points = sorted(set(seen) | {float(np.nextafter(c, math.inf)) for c in hot})
    return points, {points.index(c) + 1: k + 1 for c, k in hot.items()}, n


def draw_sums(pred: DataFrame, n_draws: int = N_DRAWS, flags: Sequence[str] = (),
              keys: Sequence[str] = CELL, row_id: str = "row_id",
              range_rows: int = RANGE_ROWS) -> DataFrame:
    """(cell, draw, pos, neg, rank_sum, prec_sum, hit_p<i>, hit_n<i>).

    Missing scores rank below all others, as in the point estimates. Row keys that are not
    whole numbers are hashed first.

    One row per cell and draw: what every metric of a draw is computed from. The
    0/1 columns in ``flags`` mark the rows that a fixed rule flags.
    """
    keys = list(keys)
    pred = pred.withColumn("score_raw", known_score(F.col("score_raw")))
    cells, n_rows = numbered_cells(pred, keys)
    points, salts, n_rows = range_plan(pred, "score_raw", range_rows, n_rows)
    lane_key = F.col(row_id)
    if not isinstance(pred.schema[row_id].dataType, T.IntegralType):
        lane_key = F.xxhash64(lane_key)
    laned = _with_cell(pred, cells, keys).select(
        _CELL, "score_raw",
        F.col("y_true").cast("int").alias("y_true"), *[F.col(f).cast("double").alias(f) for f in flags],
        hashing.row_lane(lane_key, 0).alias("_l0"),
        hashing.row_lane(lane_key, 1).alias("_l1"))
    salt = F.lit(0).cast("long")
    if salts:
        table = F.create_map(*[F.lit(x) for kv in salts.items() for x in kv])
        salt = F.coalesce(F.col("_l0") % F.try_element_at(table, F.col(_RANGE)), salt)
    # The work is rows times draws, which the bytes of a shuffle do not tell: the number of
    # tasks is set here, as adaptive execution would merge them into a few.
    parts = max(pred.sparkSession.sparkContext.defaultParallelism, math.ceil(n_rows / TASK_ROWS))
    ranges_, salts_ = len(points) + 1, max(salts.values(), default=1)
    unit = ((F.col(_CELL) * ranges_ + F.col(_RANGE)) * salts_ + F.col(_SALT)).alias(_UNIT)
    own = {_CELL: F.expr(f"{_UNIT} div {ranges_ * salts_}"),
           _RANGE: F.expr(f"{_UNIT} div {salts_} % {ranges_}")}
    rows = in_ranges(laned, "score_raw", points, _RANGE).withColumn(_SALT, salt).select(
        unit, "score_raw", "y_true", *flags, "_l0", "_l1").repartition(parts, _UNIT)

    hits = [f"hit_{c}{i}" for i in range(len(flags)) for c in "pn"]

    def schema(names: Sequence[str]) -> T.StructType:
        return T.StructType([T.StructField(c, T.LongType()) for c in (_UNIT, "draw")] + [
            T.StructField(c, T.DoubleType()) for c in names])

    group = [_CELL, "draw"]
    made = ["draw", "pos", "neg", "rank_sum", "prec_sum", *hits]
    if not points:
        names = ["wp", "wn", "area", "prec", *hits]
        sums = rows.groupBy(_UNIT).applyInArrow(
            _range_sums(n_draws, list(flags), ["draw", *names]), schema(names)).withColumns(own)
        hit_sums = [F.sum(F.nanvl(F.col(h), F.lit(None))).alias(h) for h in hits]
        out = sums.groupBy(*group).agg(
            F.sum("wp").alias("pos"), F.sum("wn").alias("neg"), F.sum("area").alias("rank_sum"),
            F.sum("prec").alias("prec_sum"), *hit_sums)
        return out.join(cells, _CELL).select(*keys, *made)

    # The sums of a task are units times draws, however few rows it has: tasks are as many as keep
    # the cores at work. A unit that lacks a rule for some rows has no number for it.
    # Pinned, because three later steps read it: a few numbers per range and draw.
    keyed = in_ranges(laned, "score_raw", points, _RANGE).withColumn(
        _SALT, F.lit(0).cast("long")).select(unit, "score_raw", "y_true", *flags, "_l0", "_l1")
    tasks = KEY_TASKS * pred.sparkSession.sparkContext.defaultParallelism
    sums = keyed.repartition(tasks, "_l0", "_l1").sortWithinPartitions("_l0", "_l1").mapInArrow(
        _key_sums(n_draws, list(flags)), schema(["lo", "hi", "wp", "wn", *hits])).withColumns(own)
    ranges = pinned(sums.groupBy(_CELL, _RANGE, "draw").agg(
        (F.min("lo") == F.max("hi")).alias("tied"), F.sum("wp").alias("wp"),
        F.sum("wn").alias("wn"), *[F.nanvl(F.sum(h), F.lit(None)).alias(h) for h in hits]))
    steps = Window.partitionBy(*group).orderBy(F.desc(_RANGE)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # The own area of a tied range is half the product.
    tied, zero = F.col("tied"), F.lit(0.0)
    placed = ranges.withColumns({
        "before_p": F.sum("wp").over(steps) - F.col("wp"),
        "before_n": F.sum("wn").over(steps) - F.col("wn"),
        "area": F.when(tied, F.col("wp") * F.col("wn") / 2).otherwise(zero)})

    before = placed.where(~tied).withColumn(_SALT, F.lit(0).cast("long")).select(
        unit, "draw", "before_p", "before_n").repartition(parts, _UNIT)
    inside = rows.groupBy(_UNIT).cogroup(before.groupBy(_UNIT)).applyInArrow(
        _range_inside(n_draws), f"{_UNIT} long, draw long, area double, prec double"
    ).withColumns(own)
    inside = inside.groupBy(*group).agg(
        F.sum("area").alias("inside_area"), F.sum("prec").alias("inside"))
    reached = F.col("before_p") + F.col("wp")
    tied_prec = F.when(tied & (F.col("wp") > 0), F.col("wp") * reached / (
        reached + F.col("before_n") + F.col("wn")))
    totals = placed.groupBy(*group).agg(
        F.sum("wp").alias("pos"), F.sum("wn").alias("neg"),
        F.sum(F.col("area") + F.col("before_p") * F.col("wn")).alias("rank_sum"),
        F.sum(tied_prec).alias("between"), *[F.sum(h).alias(h) for h in hits])
    return totals.join(inside, group, "left").withColumns({
        "rank_sum": F.col("rank_sum") + F.coalesce("inside_area", zero),
        "prec_sum": F.coalesce("inside", zero) + F.coalesce("between", zero),
    }).join(cells, _CELL).select(*keys, *made)


def _with_cell(pred: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return null_safe_join(pred, cells, keys) if keys else pred.crossJoin(cells)


def _usable() -> Column:
    return (F.col("pos") > 0) & (F.col("neg") > 0)


def rank_draws(sums: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """(cell, draw, auroc, auprc), NULL where a draw has only one class."""
    return sums.select(
        *keys, "draw",
        F.when(_usable(), F.col("rank_sum") / (F.col("pos") * F.col("neg"))).alias("auroc"),
        F.when(_usable(), F.col("prec_sum") / F.col("pos")).alias("auprc"))


def rule_draws(sums: DataFrame, rules: Sequence[str], keys: Sequence[str] = CELL) -> DataFrame:
    """(cell, rule, draw, rates): the flags of a rule are the same in every draw.

    ``rules`` names the flag columns that went into ``draw_sums``, in order.
    """
    entries = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"hit_p{i}").alias("tp"),
                                 F.col(f"hit_n{i}").alias("fp")) for i, r in enumerate(rules)])
    per_rule = sums.select(*keys, "draw", "pos", "neg", F.inline(entries)).where(
        F.col("tp").isNotNull())
    tp, fp = F.col("tp"), F.col("fp")
    each = rates(tp, fp, F.col("pos") - tp, F.col("neg") - fp)
    return per_rule.select(*keys, "rule", "draw",
                           *[F.when(_usable(), each[m]).alias(m) for m in RATE_METRICS])


def long_draws(draws: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, draw, metric, value)."""
    return draws.unpivot([*keys, "draw"], list(metrics), "metric", "value")


def intervals(draws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ci_lo, ci_hi, boot_std, n_boot_valid) of long draws.

    Unusable draws are left out; fewer than two usable draws give no interval.
    A group holds one value per draw, so the exact percentile is cheap here.
    """
    ok = draws.where(F.col("value").isNotNull() & ~F.isnan("value"))
    stats = ok.groupBy(*keys).agg(
        F.percentile("value", F.array(*[F.lit(q) for q in CI])).alias("q"),
        F.stddev_samp("value").alias("sd"), F.count(F.lit(1)).alias("n"))
    every = draws.select(*keys).distinct()
    enough = F.col("n") >= 2
    return null_safe_left(every, stats, keys).select(
        *keys, F.when(enough, F.col("q")[0]).alias("ci_lo"),
        F.when(enough, F.col("q")[1]).alias("ci_hi"), F.when(enough, F.col("sd")).alias("boot_std"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_boot_valid"))


def paired_differences(draws: DataFrame, baseline: str,
                       metrics: Sequence[str] = ("auroc", "auprc")) -> DataFrame:
    """(cohort, label, model, metric, mean_diff, interval): each model less the
    baseline model, draw by draw, as the draws are shared."""
    base = draws.where(F.col("model") == baseline).select(
        "cohort", "label", "draw", *[F.col(m).alias(f"base_{m}") for m in metrics])
    others = draws.where(~F.col("model").eqNullSafe(F.lit(baseline)))
    diff = null_safe_join(others, base, ["cohort", "label", "draw"]).select(
        *CELL, "draw", *[(F.col(m) - F.col(f"base_{m}")).alias(m) for m in metrics])
    rows = long_draws(diff, CELL, metrics)
    mean = rows.groupBy(*CELL, "metric").agg(F.avg("value").alias("mean_diff"))
    return null_safe_join(intervals(rows, [*CELL, "metric"]), mean, [*CELL, "metric"])
