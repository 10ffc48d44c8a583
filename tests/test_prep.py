import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.operators import prep
from cohortry.operators.prefix import RANGE_ROWS

COLS = ["a", "b", "empty", "const", "c", "many", "none"]
SCHEMA = ("row_id long, a double, b double, empty double, const double, c string, many string,"
          " none string")


@pytest.fixture(scope="module")
def pdf():
    r = np.random.default_rng(1)
    n = 500
    return pd.DataFrame({
        "row_id": np.arange(n), "a": np.where(r.random(n) < 0.2, np.nan, r.normal(5, 2, n)),
        "b": np.round(r.random(n), 1), "empty": np.nan, "const": 3.0,
        "c": r.choice(["x", "y", "z", None], n), "many": [f"v{int(k)}" for k in r.integers(0, 60, n)],
        "none": None}).astype({"none": object})


@pytest.fixture(scope="module")
def df(spark, pdf):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) and i > 4 else v
                  for i, v in enumerate(r)) for r in pdf.itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(8).cache()


@pytest.mark.parametrize("range_rows", [RANGE_ROWS, 50])
def test_numeric_statistics(df, pdf, range_rows):
    got = {r["column"]: r for r in prep.fit_numeric(
        df, ["a", "b", "empty", "const"], range_rows=range_rows).collect()}
    for c in ("a", "b"):
        filled = pdf[c].fillna(pdf[c].median())
        assert got[c].median == pytest.approx(pdf[c].median())
        assert got[c]["mean"] == pytest.approx(filled.mean())
        assert got[c].std == pytest.approx(filled.std())
    assert (got["empty"].median, got["empty"]["mean"], got["empty"].std) == (0, 0, 1)
    assert (got["const"].median, got["const"].std) == (3, 1)


def test_approximate_median_is_close(df, pdf):
    got = prep.fit_numeric(df, ["a"], exact=False).first()
    assert got.median == pytest.approx(pdf.a.median(), abs=0.05)


def test_linear_view(df, pdf):
    state = prep.fit("linear", df, COLS)
    counts = pdf.c.value_counts()
    first = {v: pdf.index[pdf.c == v][0] for v in counts.index}
    order = sorted(counts.index, key=lambda v: (-counts[v], first[v]))
    assert state.feature_names() == ["a", "b", "empty", "const", *[f"c={v}" for v in order],
                                     "many__freq"]
    new = df.sparkSession.createDataFrame(
        [(1, 2.0, None, float("nan"), 3.0, order[0], "v1", None),
         (2, None, 0.5, 1.0, 4.0, "unseen", "unseen", "q"),
         (3, None, 0.5, 1.0, 4.0, None, None, None)], SCHEMA)
    out = {r.row_id: r for r in state.transform(new).collect()}
    freq = pdf.many.value_counts(normalize=True)
    f = pdf.many.map(freq)
    assert out[1]["many__freq"] == pytest.approx((freq["v1"] - f.mean()) / f.std(ddof=0))
    assert out[2]["many__freq"] == out[3]["many__freq"] == pytest.approx(-f.mean() / f.std(ddof=0))
    assert [out[1][f"c={v}"] for v in order] == [1.0, 0.0, 0.0]
    assert all(out[k][f"c={v}"] == 0.0 for k in (2, 3) for v in order)
    assert out[1]["empty"] == 0.0 and out[1]["const"] == 0.0 and out[2]["const"] == 1.0


def test_matrix_codes_follow_first_appearance(df, pdf):
    state = prep.fit("matrix", df, COLS)
    seen = {v: i for i, v in enumerate(pdf.many.unique())}
    out = state.transform(df).toPandas().sort_values("row_id")
    assert out.many.tolist() == pdf.many.map(seen).tolist()
    assert (out["none"] == -1).all() and (out.c[pdf.c.isna().to_numpy()] == -1).all()


def test_codes_do_not_depend_on_ranges(df):
    a, b = (sorted(map(tuple, prep.fit_codes(df, ["c", "many"], range_rows=r).collect()), key=str)
            for r in (RANGE_ROWS, 7))
    assert a == b


def test_tree_view_keeps_known_levels(df):
    state = prep.fit("tree", df, COLS)
    levels = {(r["column"], r["level"]) for r in state.levels.collect()}
    assert ("none", prep.ALL_MISSING) in levels
    new = df.sparkSession.createDataFrame([(1, "7.5", "bad", "x", "zzz")],
                                          "row_id long, a string, b string, c string, many string")
    out = state.transform(new.withColumns({
        "empty": F.lit(None).cast("double"), "const": F.lit(1.0), "none": F.lit("w")})).first()
    assert (out.a, out.b, out.c, out.many, out["none"]) == (7.5, None, "x", None, None)


def test_vocab_is_capped_and_zero_is_unknown(df, pdf):
    state = prep.fit("embed", df, ["c", "many"], max_vocab=10)
    assert state.cardinalities() == [4, 11]
    out = state.transform(df).toPandas().sort_values("row_id")
    top = pdf.many.value_counts()
    assert set(out.many) == set(range(11))
    assert (out.many[(pdf.many == top.index[0]).to_numpy()] == 1).all()


def test_missing_column_and_unknown_view_are_errors(df):
    state = prep.fit("matrix", df, ["a", "c"])
    with pytest.raises(KeyError, match="c"):
        state.transform(df.drop("c"))
    with pytest.raises(ValueError, match="unknown view"):
        prep.fit("other", df, ["a"])


def test_lookup_is_broadcast_only_when_small(df, monkeypatch):
    state = prep.fit("matrix", df, ["many"])
    hint = "ResolvedHint (strategy=broadcast)"
    assert hint in state.lookup("many", "pos")._jdf.queryExecution().analyzed().toString() or \
        "broadcast" in state.lookup("many", "pos")._jdf.queryExecution().toString().lower()
    monkeypatch.setattr(prep, "BROADCAST_BYTES", 5)
    assert "broadcast" not in state.lookup("many", "pos")._jdf.queryExecution().toString().lower()
