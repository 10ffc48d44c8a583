from collections import Counter, defaultdict

import numpy as np
from helpers import SF, classes, documents, fingerprint, odd_rows, rows_of

import corpus_pipeline
from cohortry.llm import mixing, pieces, quality, simhash
from cohortry.llm.common import table


def test_stages_do_what_they_say(spark):
    docs = table(spark, SF, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    frames, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF).cache()
        frames[name] = at
    good = {r["doc_id"] for r in quality.scored(docs, table(spark, SF, "labels")).collect()
            if r["predicted"]}
    assert {r["doc_id"] for r in frames["quality"].collect()} == good
    last = defaultdict(int)
    for i in good:
        last[rows[i]] = max(last[rows[i]], i)
    assert sorted(r["doc_id"] for r in frames["exact_dedup"].collect()) == sorted(last.values())
    ids = sorted(last.values())
    of = classes([fingerprint(rows[i]) for i in ids], lambda a, b: (a ^ b).bit_count() <= 4)
    assert sorted(r["doc_id"] for r in frames["near_dedup"].collect()) == sorted(
        ids[c] for c in set(of))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(frames["near_dedup"]).collect()}
    count = Counter(r["doc_id"] for r in frames["mix"].collect())
    assert dict(count) == {i: c for i, c in copies.items() if c}
    for name, f in frames.items():
        if name != "encode":
            assert f.columns == docs.columns
    p = pieces.Pieces.load()
    out = frames["encode"].collect()
    assert Counter(r["doc_id"] for r in out) == count
    assert all(p.decode(r["ids"]) == rows[r["doc_id"]] for r in out)


def test_rows_of_one_id_are_decided_one_by_one(spark, monkeypatch):
    base = [" ".join(f"g{p}w{k}" for k in range(60)) for p in range(4)]
    bad = " ".join(["junk"] * 60)
    rows = [(i, t) for i in (None, 5) for t in (base[0], bad, base[1])] + [(6, base[2]), (7, None)]
    weights = np.zeros(quality.DIMS)
    seen = quality.Distinct(quality.BITS)
    weights[quality.grams(bad, seen)] = -1.0
    for t in base:
        weights[quality.grams(t, seen)] = 1.0
    monkeypatch.setattr(quality, "fit", lambda *_: (weights, 0.0))
    docs = documents(spark, rows)
    good = quality.keep_good(docs, no_labels(spark))
    assert good.columns == docs.columns
    assert rows_of(good, "doc_id", "text") == sorted([r for r in rows if r[1] != bad], key=repr)
    # Near copies with and without an id: one of each group stays.
    near = [(None, base[0]), (None, base[0]), (None, base[0].upper()), (None, base[1]),
            (5, base[1].upper()), (5, base[2]), (5, base[3]), (9, base[3]), (3, base[2].upper())]
    got = rows_of(simhash.keep_one(documents(spark, near)), "doc_id", "text")
    assert [i for i, _ in got].count(None) == 2 and len(got) == 4
    assert sorted(t.lower() for _, t in got) == sorted(base)
    assert (3, base[2].upper()) in got and (5, base[3]) in got


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_run_on_odd_tables(spark, tmp_path):
    for name, rows in (("odd", odd_rows()), ("empty", [])):
        sf = str(tmp_path / name)
        documents(spark, rows).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (4, 0, 0), (9, 1, None)],
                              "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        out = corpus_pipeline.run(spark, sf).collect()
        assert (len(out) > 0) == bool(rows) and all(r["lossless"] for r in out)


def test_entry_has_all_text_queries():
    import __spark_entry__ as e
    names = set(e.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {
        f"op{i}" for i in range(1, 14)}
