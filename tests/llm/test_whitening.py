import math
import random

import numpy as np
import pytest

from locuspark.llm import whitening as W


def table(seed=1, n=90, d=20):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    rows = [(i, [float(np.float32(x)) for x in v], "n") for i, v in enumerate(base)]
    rows += [(1000 + i, rows[5][1], "n") for i in range(40)] + [(3, rows[8][1], "n"), (3, rows[8][1], "n"), (None, rows[9][1], "n")]
    return rows + [(2000, None, "n"), (2001, [1.0] * (d - 1) + [None], "n"), (2002, [math.nan] * d, "n"), (2003, [math.inf] + [0.0] * (d - 1), "n"), (2004, [], "n"), (2005, [1.0], "n")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string").repartition(3)


def plain(rows, d):
    xs = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v, _ in rows if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    return xs, n, sums, values[::-1], vectors[:, ::-1]


def test_equals_plain_python(spark):
    rows = table()
    xs, n, sums, values, vectors = plain(rows, 20)
    got = W.whiten(frame(spark, rows)).collect()
    assert len(got) == 16 * len(xs) and {r["n"] for r in got} == {n}
    want, sign = {}, {}
    for i, x in xs:
        dev = [n * a - s for a, s in zip(x, sums, strict=True)]
        white = (np.array(dev, float) / n) @ vectors[:, :16] / np.sqrt(values[:16])
        for c in range(16):
            want.setdefault((i, c + 1), []).append((sum(v * v for v in dev), float(white[c])))
    for key in want:
        own = [r for r in got if (r["vec_id"], r["component"]) == key]
        assert len(own) == len(want[key])
        for r, (deviation, white) in zip(sorted(own, key=lambda r: r["deviation"]), sorted(want[key]), strict=True):
            assert r["deviation"] == deviation and abs(abs(r["whitened"]) - abs(white)) < 1e-7
            if abs(white) > 1e-6:
                assert sign.setdefault(key[1], np.sign(white * r["whitened"])) == np.sign(white * r["whitened"])
            assert abs(r["explained"] - values[key[1] - 1] / values.sum()) < 1e-9 and r["identity_error"] < 1e-8


def test_few_dimensions_and_no_spread(spark):
    got = W.whiten(frame(spark, [(i, [1.0 * i, 2.0 * i, 5.0], "n") for i in range(9)])).collect()
    assert len(got) == 27 and {r["component"] for r in got} == {1, 2, 3}
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got) and all(r["identity_error"] < 1e-9 for r in got)
    one = W.whiten(frame(spark, [(1, [3.0, 4.0], "n")])).collect()
    assert [(r["whitened"], r["deviation"], r["explained"], r["identity_error"]) for r in one] == [(None, 0, 0.0, None)] * 2


def test_very_large_entries(spark):
    rows = [(i, [random.Random(i).uniform(-1e30, 1e30), float(i)], "n") for i in range(8)]
    got = W.whiten(frame(spark, rows)).collect()
    assert len(got) == 16 and all(r["deviation"] is None for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None, "n"), (2, [math.nan], "n")]])
def test_nothing_left(spark, rows):
    out = W.whiten(frame(spark, rows))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_string_ids(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [2.0, 7.0]), (None, [5.0, 1.0])], "n string, v array<double>")
    out = W.whiten(df, "n", "v")
    assert out.columns[:3] == ["n", "component", "n_"] and {r["n"] for r in out.collect()} == {"a", "b", None}
