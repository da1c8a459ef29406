"""Whitening against exact fractions and numpy on one matrix."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tessella.llm import queries as llm
from tessella.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, w int, vector string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, "a", 1, "b") for i, v in rows], schema)


def brute(vectors):
    """(x, n, S, V) with every covariance as a fraction of whole numbers."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * r[j] - s[j] for j in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    return x, n, s, y, v


def check(got, ids, vectors, components=32):
    x, n, s, y, v = brute(vectors)
    d = len(s)
    e, p = np.linalg.eigh(v)
    e, p = e[::-1], p[:, ::-1]
    k = min(d, components)
    assert len(got) == len(ids) * k
    seen = {}
    for r in got:
        seen.setdefault(r.vec_id, []).append(r)
    centred = np.array([[float(Fraction(r[j], n)) for j in range(d)] for r in y])
    by_id = {}
    for i, vid in enumerate(ids):
        by_id.setdefault(vid, []).append(i)
    signs = None
    for vid, rows in seen.items():
        assert sorted(r.component for r in rows) == sorted(list(range(1, k + 1)) * len(by_id[vid]))
        if len(by_id[vid]) > 1:
            continue
        i = by_id[vid][0]
        assert {r.n for r in rows} == {n} and {r.deviation for r in rows} == {sum(c * c for c in y[i])}
        rows.sort(key=lambda r: r.component)
        w = np.array([r.whitened for r in rows])
        want = centred[i] @ p[:, :k] / np.sqrt(e[:k])
        signs = np.where(np.abs(want) > 1e-3, np.sign(w * want), 0) if signs is None else np.where(signs == 0, np.where(np.abs(want) > 1e-3, np.sign(w * want), 0), signs)
        assert np.allclose(w, np.where(signs == 0, w, signs * want), atol=1e-6)
        assert np.allclose([r.explained for r in rows], e[:k] / np.trace(v), rtol=1e-9)
        assert rows[0].identity_error < 1e-9


@pytest.mark.parametrize("dims, n", [(5, 40), (40, 300)])
def test_whitening_equals_exact_fractions(spark, dims, n):
    rng = np.random.default_rng(dims)
    mix = rng.normal(size=(dims, dims))
    vectors = [np.float32(v).tolist() for v in rng.normal(size=(n, dims)) @ mix * 3 + rng.normal(size=dims)]
    vectors[3] = vectors[4] = vectors[5]
    bad = [(900, None), (901, [None] + [0.5] * (dims - 1)), (902, [float("nan")] + [0.5] * (dims - 1)), (903, [0.5] * (dims - 1) + [float("inf")]), (904, []), (905, [1.0] * (dims + 1))]
    ids = [*range(n - 2), None, 7]
    rows = list(zip(ids, vectors, strict=True))
    out = whitening.whiten(frame(spark, rows[:9] + bad + rows[9:]))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(out.collect(), ids, vectors)


def test_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    vectors = [r.embedding for r in rows]
    check(llm.QUERIES["op11_whitening"](spark, sf_dir).collect(), [r.vec_id for r in rows], vectors)


def test_numbers_that_no_long_holds(spark):
    """Squares over 2**63 are summed as whole numbers; what is no long is left out."""
    vectors = [[3e14, 1.0], [-2e14, 2.0], [1e14, -5.0], [0.0, 4.5]]
    rows = [*enumerate(vectors), (9, [1e300, 0.0])]
    got = whitening.whiten(frame(spark, rows, SCHEMA.replace("float", "double"))).collect()
    assert {r.vec_id for r in got} == {0, 1, 2, 3} and {r.n for r in got} == {4} and {r.deviation for r in got} == {None}
    _, _, _, _, v = brute(vectors)
    z = [[math.floor(64 * c) for c in r] for r in vectors]
    centre, squares = [sum(r[j] for r in z) // 4 for j in (0, 1)], {}
    y = [[r[j] - centre[j] for j in (0, 1)] for r in z]
    for i, j in ((0, 0), (1, 1), (0, 1)):
        squares[i, j] = sum((r[i] if i == j else r[i] + r[j]) ** 2 for r in y)
    rest = [sum(r[j] for r in y) for j in (0, 1)]
    assert (whitening.covariance(squares, rest, 4) == v).all()


def test_exact_sums_of_any_size():
    for top in (3, 1 << 20, 1 << 40, 1 << 60):
        x = np.random.default_rng(1).integers(-top, top, (50, 3))
        assert whitening._exact_sum(x) == [sum(map(int, c)) for c in x.T]
        assert whitening._exact_sum(x, 2) == [sum(int(a) ** 2 for a in c) for c in x.T]


def test_no_variance_and_nothing(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    got = whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(0, None, 0.0, None)] * 4
    got = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [3.0, 4.0])])).collect()
    assert {(r.component, r.whitened is None) for r in got} == {(1, False), (2, True)} and abs(abs(got[0].whitened) - 1) < 1e-12
    assert max(r.identity_error for r in got) < 1e-12
