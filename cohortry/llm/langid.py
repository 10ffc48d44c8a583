"""Language identification by the nearest centroid.

Texts are TF-IDF vectors of byte n-grams, normalised. Each language has several centroids, from
spherical k-means over its texts, and a text takes the language of the centroid with the largest
cosine. Texts farther from every centroid than almost all learned ones are marked as rejected.

Document frequencies are counted over all training rows. Centroids are fitted on a bounded
sample (``PER_LANG`` texts of each language). The model has a fixed size per language.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm.common import fold, table
from cohortry.llm.features import byte_grams
from cohortry.session import settle

BITS, GRAMS = 13, (1, 2, 3)
PER_LANG, CENTROIDS, FOLDS, REJECT_SHARE = 400, 4, 3, 0.001
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
# ASCII bytes that are no letters count as one space.
_PLAIN = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def counts(text: str) -> np.ndarray | None:
    """How often each hashed n-gram occurs; None for a text without letters."""
    if not _LETTER.search(text):
        return None
    words = text.lower().encode().translate(_PLAIN).split()
    buf = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    return np.bincount(np.concatenate([byte_grams(buf, n, BITS) for n in GRAMS]),
                       minlength=1 << BITS)


def vector(text: str, idf: np.ndarray) -> np.ndarray | None:
    c = counts(text)
    if c is None:
        return None
    v = np.log1p(c) * idf
    size = np.sqrt(v @ v)
    return v / size if size > 0 else v


def _frequency_batches(batches):
    n, df = 0, np.zeros(1 << BITS, np.int64)
    for b in batches:
        for t in b.column("text"):
            c = counts(t.as_py())
            if c is not None:
                df += c > 0
                n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.r_[at, -1], pa.int32()), pa.array(np.r_[df[at], n], pa.int64())],
        names=["gram", "n"])


def inverse_frequencies(train: DataFrame) -> np.ndarray:
    """Over all rows of ``train``: each task sums its own rows before the shuffle. What
    reaches the driver is one number per hashed n-gram."""
    sums = train.select("text").mapInArrow(_frequency_batches, "gram int, n long").groupBy(
        "gram").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(1 << BITS), 0
    for r in sums:
        if r["gram"] < 0:
            n = r["n"]
        else:
            df[r["gram"]] = r["n"]
    return np.log((1.0 + n) / (1.0 + df)) + 0.1


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Unit centroids; started from rows far from those chosen before."""
    k = min(k, len(x))
    centres, near = [x[0]], x @ x[0]
    for _ in range(k - 1):
        centres.append(x[int(np.argmin(near))])
        near = np.maximum(near, x @ centres[-1])
    c = np.array(centres)
    for _ in range(rounds):
        of = np.argmax(x @ c.T, axis=1)
        for j in range(k):
            if (of == j).any():
                m = x[of == j].mean(axis=0)
                c[j] = m / max(np.sqrt(m @ m), 1e-12)
    return c


def fit(train: DataFrame, per_lang: int = PER_LANG, k: int = CENTROIDS):
    """(languages of the centroids, centroids, idf, rejection bound) from rows (doc_id, text,
    lang). Centroids come from ``per_lang`` rows of a language at most, chosen by a hash of id and
    text. Without usable rows there are no centroids."""
    known = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    idf = inverse_frequencies(known)
    # About a quarter more rows than wanted pass by their share, then each task and the whole keep
    # the first ones: ids that repeat, or are null, cannot make the sample larger.
    share = known.groupBy("lang").agg((F.lit(1.25 * per_lang) / F.count(F.lit(1))).alias("share"))
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 30))
    first = Window.partitionBy("lang").orderBy("place")
    chosen = known.join(settle(share), "lang").withColumn("place", place).where(
        F.col("place") < F.col("share") * (1 << 30)).withColumn(
        "nth", F.row_number().over(first)).where(F.col("nth") <= per_lang)

    def batches(source):
        for b in source:
            rows = [None if (c := counts(t.as_py())) is None else np.flatnonzero(c)
                    for t in b.column("text")]
            vals = [None if (c := counts(t.as_py())) is None else c[c > 0]
                    for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("lang"), b.column("place"), pa.array(rows, pa.list_(pa.int32())),
                 pa.array(vals, pa.list_(pa.int32()))], names=["lang", "place", "ids", "counts"])

    got = chosen.select("text", "lang", "place").mapInArrow(
        batches, "lang string, place long, ids array<int>, counts array<int>").toPandas()
    got = got[got["ids"].notna()].sort_values(["lang", "place"], kind="stable")
    langs, centres, own = [], [], []
    for lang, rows in got.groupby("lang", sort=True):
        x = np.zeros((len(rows), 1 << BITS), np.float32)
        for i, (ids, cnt) in enumerate(zip(rows["ids"], rows["counts"])):
            x[i, ids] = np.log1p(cnt) * idf[ids]
        x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
        c = spherical_kmeans(x, k)
        own.append((x @ c.T).max(axis=1))
        langs += [lang] * len(c)
        centres.append(c)
    if not langs:
        return [], np.zeros((0, 1 << BITS), np.float32), idf, 0.0
    bound = float(np.quantile(np.concatenate(own), REJECT_SHARE))
    return langs, np.concatenate(centres), idf, bound


def identify(docs: DataFrame, model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row, from its whole text.

    score is the largest cosine. Null texts and texts without a letter are ``und`` with
    score 0 and rejected; so is every text if nothing was learned. Other rejected texts keep
    the nearest language, so that a caller may decide. Ties go to the first language in
    code-point order.
    """
    langs, centres, idf, bound = model
    sent = docs.sparkSession.sparkContext.broadcast((centres.astype(np.float32), idf))

    def batches(source):
        c, weight = sent.value
        for b in source:
            lang, score, far = [], [], []
            for t in b.column("text"):
                t = t.as_py()
                v = vector(t, weight) if t is not None and langs else None
                if v is None:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    far.append(True)
                    continue
                cos = c @ v.astype(np.float32)
                best = int(np.argmax(cos))
                lang.append(langs[best])
                score.append(min(1.0, max(0.0, float(cos[best]))))
                far.append(bool(cos[best] < bound))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(far, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(batches, "doc_id long, lang_pred string, score double, rejected boolean")


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): learned outside the held-out fold of
    ``docs``, for all rows. A null doc_id is hashed as empty text; empty tables give no rows."""
    held = fold(F.col("doc_id"), FOLDS) == 1
    model = fit(docs.where(~held).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score",
                                        "rejected")


def op10_centroid_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(table(spark, sf_dir, "documents"))
