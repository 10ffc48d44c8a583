"""Language-model scores from a probabilistic suffix tree over words.

Symbols are the frequent words, one class for each shape of the other words, and the end of a
text. A context of up to ``depth`` symbols is a state of the tree if it is frequent and its
next-symbol counts diverge from what its suffix predicts by more than a description of them
costs; contexts of three symbols and more are looked for behind states only. Distributions are
smoothed towards those of the suffix. A token's probability is that of its symbol in the longest
suffix state, times that of the word in its class.

Frequent means N ** 0.6 / ``SYMBOLS``, ``STATES`` or ``ENTRIES`` of N training tokens. No share of
the tokens is asked for, so ever rarer words and contexts are told apart as the corpus grows.

Words are counted over the whole training corpus. Every task reduces its rows to distinct words
first. A document needs the counts of its words, and the vocabulary grows with the corpus, so it
is not broadcast: documents are dealt into chunks of bounded size, a word asks for its count once
per task with the list of chunks that hold it, and each chunk meets its own answers. The tree has
at most ``STATES`` * N ** 0.4 states and ``ENTRIES`` * N ** 0.4 entries per depth, so it can be
sent to every task: a text of a thousand times the tokens has a tree of 16 times the bound.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import NO_ID, fold, table, texts, written
from cohortry.session import settle

FOLDS, HELD = 7, 2
SYMBOLS, STATES, ENTRIES, POWER = 16, 256, 1024, 0.6
PRIOR = 8.0  # counts that the suffix's distribution is worth
DEPTH = 3
CHUNK_CHARS, MIN_CHUNKS = 16_000_000, 32
# What a task tokenizes at once, how many tokens it sorts at once, and how many with contexts.
GROUP_CHARS, TASK_TOKENS, CONTEXT_TOKENS = 2_000_000, 3_000_000, 1_000_000
END = b"\x20"  # no word holds a space
CLASSES = 5 * 4 * 2
SIGN = np.uint64(1 << 63)
_TAIL = np.ones(256, np.int64) * 4
for _set, _kind in ((range(97, 123), 0), (range(128, 256), 0), (b".!?", 1), (b",;:", 2),
                    (range(48, 58), 3)):
    for _c in _set:
        _TAIL[_c] = _kind


def least(total: float, per: int) -> float:
    """How often something occurs among ``total`` tokens to be frequent."""
    return max(2.0, total ** POWER / per)


# --- inside tasks -----------------------------------------------------------------

def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


END_HASH = int(hash_words([END])[0])


class Tokens:
    """The tokens of some texts, one after the other: lower-cased words (A-Z only), and one end
    after each text.

    ``hashes`` and ``classes`` have an entry per token, ``starts`` the first token of each text.
    A class comes from a word's last byte, its length and whether all its bytes are ASCII.
    """

    def __init__(self, texts_: list[str]):
        words, sizes = [], []
        for t in texts_:
            own = t.encode().lower().split()
            words += own
            words.append(END)
            sizes.append(len(own) + 1)
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.hashes = hash_words(words)
        buf = np.frombuffer(b"\n".join(words), np.uint8)
        ends = np.r_[np.flatnonzero(buf == 10), len(buf)].astype(np.int32)
        begins = np.r_[0, ends[:-1] + 1]
        high = np.r_[0, np.cumsum(buf > 127, dtype=np.int32)]
        shape = np.searchsorted([4, 7, 11], ends - begins, side="right")
        self.classes = ((_TAIL[buf[ends - 1]] * 4 + shape) * 2
                        + (high[ends] == high[begins])).astype(np.int16)


def _first(code: np.ndarray, kinds: int) -> np.ndarray:
    """The first place of each of the codes 0 .. ``kinds`` - 1, all of which occur."""
    first = np.empty(kinds, np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)  # of equal ones the last write stays
    return first


def _text_groups(column, *others):
    """The texts of a batch in groups of bounded size, with the same rows of other columns."""
    held, size, lo = [], 0, 0
    for i, t in enumerate(column):
        held.append(t.as_py())
        size += len(held[-1]) + 1
        if size >= GROUP_CHARS:
            yield held, *[o[lo:i + 1] for o in others]
            held, size, lo = [], 0, i + 1
    if held:
        yield held, *[o[lo:] for o in others]


def _word_table(h, c, train, cls):
    """Distinct words of these tokens with their training count and list of chunks."""
    code, words = pd.factorize(h)
    n = np.bincount(code[train], minlength=len(words))
    span = int(c.max()) + 1
    pairs = np.sort(pd.unique(code * np.int64(span) + c))
    offsets = np.searchsorted(pairs, np.arange(len(words) + 1) * np.int64(span)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(words), pa.array(cls[_first(code, len(words))].astype(np.int32)), pa.array(n),
         pa.ListArray.from_arrays(pa.array(offsets), pa.array((pairs % span).astype(np.int32)))],
        names=["word", "cls", "n", "chunks"])


def _word_batches(batches):
    """(word, cls, n, chunks): distinct words, how often they occur in training rows, and the
    chunks whose rows hold them; of ``TASK_TOKENS`` tokens or more at a time."""
    held, size = [], 0
    for b in batches:
        chunk = b.column("chunk").to_numpy()
        train = ~b.column("held_out").to_numpy(zero_copy_only=False)
        for group, c, tr in _text_groups(b.column("text"), chunk, train):
            t = Tokens(group)
            held.append((t.hashes, np.repeat(c, t.sizes), np.repeat(tr, t.sizes), t.classes))
            size += len(t.hashes)
            if size >= TASK_TOKENS:
                yield _word_table(*[np.concatenate(x) for x in zip(*held)])
                held, size = [], 0
    if held:
        yield _word_table(*[np.concatenate(x) for x in zip(*held)])


class Alphabet:
    """Symbol numbers: classes first, then the end, then the frequent words."""

    def __init__(self, frequent: np.ndarray):
        self.words = pd.Index(np.sort(frequent))
        self.size = CLASSES + 1 + len(self.words)

    def symbols(self, tokens: Tokens) -> np.ndarray:
        h = tokens.hashes
        at, known = _found(self.words, h)
        out = np.where(known, CLASSES + 1 + at, tokens.classes)
        out[h == END_HASH] = CLASSES
        return out


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two whole numbers (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def contexts(sym: np.ndarray, starts: np.ndarray, size: int, depth: int) -> list[np.ndarray]:
    """For each token the codes of its contexts of 0, 1 .. ``depth`` symbols; before the first
    token of a text stands the end. Codes are exact up to two symbols and hashes beyond."""
    out, earlier = [np.zeros(len(sym), np.int64)], sym.astype(np.int64)
    for k in range(1, depth + 1):
        earlier = np.r_[CLASSES, earlier[:-1]]
        earlier[starts] = CLASSES
        out.append(earlier if k == 1 else earlier * np.int64(size) + out[1] if k == 2
                   else _mixed(out[-1], earlier))
    return out


def pair_codes(k: int, ctx: np.ndarray, sym: np.ndarray, size: int) -> np.ndarray:
    """One number for a context of k symbols and the next one: exact up to one symbol, else a
    hash, because three symbols of a large alphabet exceed 64 bits."""
    return ctx * np.int64(size) + sym if k < 2 else _mixed(ctx, sym)


def _found(keys: pd.Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where x stands among distinct keys (-1: nowhere), and whether it is there; by a hash table
    that the index makes once a task."""
    at = keys.get_indexer(x)
    return at, at >= 0


def _counted(k: int, ctx: np.ndarray, sym: np.ndarray, size: int):
    """The first places of the distinct (context, next symbol) and how often each occurs."""
    code, kinds = pd.factorize(pair_codes(k, ctx, sym, size))
    return _first(code, len(kinds)), np.bincount(code, minlength=len(kinds))


def _symbol_batches(alphabet: Alphabet, batches):
    """(symbols, starts) of ``CONTEXT_TOKENS`` tokens or more at a time."""
    held, starts, size = [], [], 0
    for b in batches:
        for (group,) in _text_groups(b.column("text")):
            t = Tokens(group)
            held.append(alphabet.symbols(t).astype(np.int32))
            starts.append(t.starts + size)
            size += len(t.hashes)
            if size >= CONTEXT_TOKENS:
                yield np.concatenate(held).astype(np.int64), np.concatenate(starts)
                held, starts, size = [], [], 0
    if size:
        yield np.concatenate(held).astype(np.int64), np.concatenate(starts)


def _gram_batches(alphabet: Alphabet):
    """(depth, ctx, sym, n): the next symbols of all contexts of up to two symbols."""
    def run(batches):
        for sym, starts in _symbol_batches(alphabet, batches):
            for k, ctx in enumerate(contexts(sym, starts, alphabet.size, 2)):
                first, n = _counted(k, ctx, sym, alphabet.size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), k, np.int32)), pa.array(ctx[first]),
                     pa.array(sym[first].astype(np.int32)), pa.array(n)],
                    names=["depth", "ctx", "sym", "n"])
    return run


def _deeper_batches(alphabet: Alphabet, k: int, states: np.ndarray, often: np.ndarray):
    """(ctx, up, sym, n): the next symbols of contexts of k symbols whose suffix ``up`` is one of
    the ``states``.

    ``often`` has the frequent runs of three symbols. A context whose oldest three are
    not among them is not frequent, so it is not counted.
    """
    often, states = pd.Index(often), pd.Index(states)

    def run(batches):
        for sym, starts in _symbol_batches(alphabet, batches):
            every = contexts(sym, starts, alphabet.size, k)
            back = k - 2
            begin = np.repeat(starts, np.diff(np.r_[starts, len(sym)]))
            place = np.arange(len(sym)) - back
            _, run_of_three = _found(often, pair_codes(2, every[2], sym, alphabet.size))
            may = (place < begin) | run_of_three[place]
            _, behind = _found(states, every[k - 1])
            may &= behind
            ctx, up, sym = every[k][may], every[k - 1][may], sym[may]
            first, n = _counted(k, ctx, sym, alphabet.size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ctx[first]), pa.array(up[first]),
                 pa.array(sym[first].astype(np.int32)), pa.array(n)],
                names=["ctx", "up", "sym", "n"])
    return run


class Tree:
    """The states and entries of the tree as sorted arrays, and symbol probabilities."""

    def __init__(self, base: np.ndarray, states, entries, size: int):
        self.base, self.size = base, size  # probabilities without context
        # Per depth: (ctx, n, rest) and (code, n).
        self.states = [s and (pd.Index(s[0]), *s[1:]) for s in states]
        self.entries = [e and (pd.Index(e[0]), *e[1:]) for e in entries]

    def log10(self, sym: np.ndarray, starts: np.ndarray) -> np.ndarray:
        p = self.base[sym]
        for k, ctx in enumerate(contexts(sym, starts, self.size, len(self.states) - 1)):
            if k == 0 or not len(self.states[k][0]):
                continue
            codes, n, rest = self.states[k]
            at, here = _found(codes, ctx)
            at, here = at[here], np.flatnonzero(here)
            pair, cnt = self.entries[k]
            own = np.zeros(len(here))
            if len(pair):
                e, known = _found(pair, pair_codes(k, ctx[here], sym[here], self.size))
                own[known] = cnt[e[known]]
            p[here] = (own + (rest[at] + PRIOR) * p[here]) / (n[at] + PRIOR)
        return np.log10(p)


def _score_chunk(total: int, distinct: int, alphabet: Alphabet, tree: Tree,
                 in_class: np.ndarray):
    floor = total + 1 * (distinct + 1)

    def run(key, docs, counts):
        word = counts.column("word").to_numpy()
        code, words = pd.factorize(word)
        c, words = counts.column("c").to_numpy()[_first(code, len(words))], pd.Index(words)
        out: list[list] = [[], [], [], []]
        for (group,) in _text_groups(docs.column("text")):
            t = Tokens(group)
            at, known = _found(words, t.hashes)
            n = np.where(known, c[at], 0)
            sym = alphabet.symbols(t)
            inside = np.where(sym < CLASSES, np.log10((n + 1) / in_class[t.classes]), 0.0)
            score = tree.log10(sym, t.starts) + inside
            for col, x in zip(out, (t.sizes, np.add.reduceat((n > 0).astype(np.int64), t.starts),
                                    np.add.reduceat(np.log10((n + 1) / floor), t.starts),
                                    np.add.reduceat(score, t.starts))):
                col.append(x)
        n_tokens, n_known, base, score = (np.concatenate(x) if x else np.zeros(0) for x in out)
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"),
            "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "train_tokens": pa.array(np.full(len(n_tokens), total), pa.int64()),
            "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})
    return run


# --- the Spark part -----------------------------------------------------------------

def _retained(grams: DataFrame, upper: DataFrame, total: float) -> tuple[DataFrame, DataFrame]:
    """The states (depth, ctx, total) among the contexts of ``grams`` (depth, ctx, up, sym, n), and
    their entries (depth, ctx, sym, n). ``upper`` has the next symbols of the suffixes, with the
    share q of each: (depth, up, sym, q), depth that of the longer context."""
    sums = written(grams.groupBy("depth", "ctx").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        .where(F.col("total") >= least(total, STATES)), "sums")
    told = F.col("n") * F.log((F.col("n") / F.col("total")) / F.col("q"))
    gained = written(grams.join(sums, ["depth", "ctx"]).join(upper, ["depth", "up", "sym"]),
                     "divergence")
    states = written(gained.groupBy("depth", "ctx").agg(
        F.sum(told).alias("gain"), F.first("total").alias("total"), F.first("kinds").alias("kinds"))
        .where(F.col("gain") > 0.5 * F.col("kinds") * F.log(F.col("total") + 1.0))
        .select("depth", "ctx", "total"), "states")
    entries = written(gained.where(F.col("n") >= least(total, ENTRIES)).select(
        "depth", "ctx", "sym", "n").join(states.select("depth", "ctx"), ["depth", "ctx"]), "entries")
    return states, entries


def _of_frequent_pairs(grams: DataFrame, size: int, n: float) -> DataFrame:
    """``grams`` (depth, ctx, sym, n, ..) without contexts of two symbols that occur less than n
    times: but for two ends, which stand before a text, such a context is no more frequent than
    its second symbol is after its first. Later joins and sums then see few rows."""
    pairs = grams.where((F.col("depth") == 1) & (F.col("n") >= n)).select(
        (F.col("ctx") * size + F.col("sym")).alias("ctx"))
    ends = grams.sparkSession.createDataFrame([(CLASSES * size + CLASSES,)], "ctx long")
    frequent = settle(pairs.unionByName(ends).distinct())
    return grams.where("depth < 2").unionByName(
        grams.where("depth = 2").join(frequent, "ctx", "left_semi").select(*grams.columns))


def _arrays(k: int, states: DataFrame, entries: DataFrame, size: int):
    """The states and entries of one depth as sorted arrays; see ``Tree``."""
    s = states.where(F.col("depth") == k).select("ctx", "total").toPandas().sort_values("ctx")
    e = entries.where(F.col("depth") == k).select("ctx", "sym", "n").toPandas()
    ctx, totals = s["ctx"].to_numpy(np.int64), s["total"].to_numpy(np.float64)
    of, n = e["ctx"].to_numpy(np.int64), e["n"].to_numpy(np.float64)
    code = pair_codes(k, of, e["sym"].to_numpy(np.int64), size)
    code, order = np.unique(code, return_index=True)
    held = np.bincount(np.searchsorted(ctx, of), weights=n, minlength=len(ctx)) if len(
        ctx) else np.zeros(0)
    return (ctx, totals, totals - held), (code, n[order])


def fit_tree(train: DataFrame, alphabet: Alphabet, depth: int = DEPTH) -> Tree:
    """Counts over all rows of ``train``; states and entries are chosen in Spark, and only
    those come to the driver. See the module for their bound."""
    size = alphabet.size
    grams = written(train.select("text").mapInArrow(
        _gram_batches(alphabet), "depth int, ctx long, sym int, n long").groupBy(
        "depth", "ctx", "sym").agg(F.sum("n").alias("n")), "grams")
    base_n = np.zeros(size)
    for r in grams.where("depth = 0").collect():
        base_n[r["sym"]] = r["n"]
    total = base_n.sum()

    # What the suffix predicts: the base for one symbol, the shorter context's counts for two.
    sums = grams.where("depth < 2").groupBy("depth", "ctx").agg(F.sum("n").alias("total"))
    upper = written(grams.join(sums, ["depth", "ctx"]).select(
        (F.col("depth") + 1).alias("depth"), F.col("ctx").alias("up"), "sym",
        (F.col("n") / F.col("total")).alias("q")), "suffixes")
    up = F.when(F.col("depth") == 2, F.col("ctx") % size).otherwise(F.lit(0)).cast("long")
    grams = grams.where(F.col("depth").between(1, depth)).withColumn("up", up)
    if depth > 1:
        grams = _of_frequent_pairs(grams, size, least(total, STATES))
    kept, entries = _retained(grams, upper, total)
    often = np.zeros(0, np.int64)
    if depth > 2:  # as many as there may be states of three symbols
        runs = grams.where((F.col("depth") == 2) & (F.col("n") >= least(total, STATES))).select(
            "ctx", "sym").toPandas()
        often = np.unique(pair_codes(2, runs["ctx"].to_numpy(np.int64),
                                     runs["sym"].to_numpy(np.int64), size))
    states, pairs = [None], [None]
    for k in range(1, depth + 1):
        if k > 2:  # one more pass over the texts, for what stands behind the states
            if not len(states[k - 1][0]):
                break
            upper = written(grams.where(F.col("depth") == k - 1).join(kept, ["depth", "ctx"]).select(
                F.lit(k).alias("depth"), F.col("ctx").alias("up"), "sym",
                (F.col("n") / F.col("total")).alias("q")), "suffixes")
            grams = written(train.select("text").mapInArrow(
                _deeper_batches(alphabet, k, states[k - 1][0], often),
                "ctx long, up long, sym int, n long").groupBy("ctx", "up", "sym").agg(
                F.sum("n").alias("n")).withColumn("depth", F.lit(k)), "grams")
            kept, entries = _retained(grams, upper, total)
        own, next_ = _arrays(k, kept, entries, size)
        states.append(own)
        pairs.append(next_)
    return Tree((base_n + 1) / (total + size), states, pairs, size)


def scores(docs: DataFrame, folds: int = FOLDS, held: int = HELD,
           chunk_chars: int = CHUNK_CHARS, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learned from the rows outside the held-out fold; repeated rows count as often as they
    occur. Null text is empty text: one token, the end. A null doc_id is hashed as empty text
    for the fold. An empty table gives no rows; without training rows every token is unknown.
    """
    rows = texts(docs).withColumn("held_out", fold(F.col("doc_id"), folds) == held)
    chars = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    chunks = max(MIN_CHUNKS, math.ceil(chars / chunk_chars))
    # Chunks are drawn by id and text, so rows that share an id do not share a chunk.
    chunk = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(NO_ID)), "text"), F.lit(chunks)).cast("int")
    rows = rows.withColumn("chunk", chunk)

    asked = written(rows.mapInArrow(
        _word_batches, "word long, cls int, n long, chunks array<int>"), "words")
    vocab = written(asked.groupBy("word").agg(F.sum("n").alias("c"), F.min("cls").alias("cls"))
                    .where("c > 0"), "vocabulary")
    total, distinct = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    most = least(total, SYMBOLS)
    frequent = vocab.where((F.col("c") >= most) & (F.col("word") != END_HASH)).select("word")
    alphabet = Alphabet(frequent.toPandas()["word"].to_numpy(np.int64))
    in_class = np.ones(CLASSES)
    for r in vocab.where((F.col("c") < most) & (F.col("word") != END_HASH)).groupBy("cls").agg(
            F.sum(F.col("c") + 1).alias("m")).collect():
        in_class[r["cls"]] += r["m"]
    tree = fit_tree(rows.where("NOT held_out"), alphabet, depth)

    answers = asked.select("word", "chunks").join(vocab.select("word", "c"), "word").select(
        F.explode("chunks").alias("chunk"), "word", "c")
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _score_pairs(total, distinct, alphabet, tree, in_class),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double")


def _score_pairs(*model):
    run = _score_chunk(*model)

    def pairs(key, docs, counts):
        if not counts.num_rows:  # nothing learned: no word has a count
            counts = pa.table({"word": pa.array([END_HASH], pa.int64()),
                               "c": pa.array([0], pa.int64())})
        return run(key, docs, counts)
    return pairs


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
