"""Whitening and vector codes against plain numpy and SQL."""

import hashlib
import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from edge_data import SF
from pagelens.llm import codes, queries, whitening

VECTORS = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, code STRING, size INT, x INT"


def _rows(spark, vectors, ids=None, labels=None):
    ids = list(range(len(vectors))) if ids is None else ids
    labels = [None] * len(vectors) if labels is None else labels
    rows = [(i, v, k, "other", 3, 4) for i, v, k in zip(ids, vectors, labels)]
    return spark.createDataFrame(rows, VECTORS).repartition(3)


def _odd_vectors(dims=4):
    return [None, [1.0, None] + [0.0] * (dims - 2), [math.nan] * dims, [math.inf] + [0.0] * (dims - 1)]


# --- op11 -----------------------------------------------------------------------------


def _symmetric(seed, dims, spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return (q * spectrum) @ q.T


@pytest.mark.parametrize(
    "spectrum",
    [
        np.arange(1, 13.0),
        10.0 ** -np.arange(12),
        np.r_[np.ones(6), np.full(6, 2.0)],
        np.r_[np.zeros(9), 1.0, 2.0, 3.0],
        np.full(12, 7.0),
        1e150 * np.arange(12, 0, -1.0),
        np.r_[-5.0, 5.0, np.zeros(10)],
    ],
)
def test_divide_and_conquer_gives_the_leading_eigenvectors(spectrum):
    a = _symmetric(3, 12, spectrum)
    a = (a + a.T) / 2
    values, axes = whitening.principal(a, 4)
    size = np.abs(a).max()
    assert np.abs(values - np.sort(np.linalg.eigvalsh(a))[::-1][:4]).max() <= 1e-13 * size
    assert np.abs(axes @ axes.T - np.eye(4)).max() < 1e-14
    assert np.abs(a @ axes.T - axes.T * values).max() <= 1e-13 * size


def test_polar_factor_is_orthogonal_and_has_the_signs():
    a = _symmetric(1, 9, np.r_[-3.0, -2, -1e-9, 1e-9, 1, 2, 3, 4, 5])
    u = whitening.polar((a + a.T) / 2)
    assert np.abs(u @ u - np.eye(9)).max() < 1e-13
    assert round(np.trace(u)) == 3


def _expected(vectors, ids):
    good = [
        (i, [math.floor(256 * float(c)) for c in v])
        for i, v in zip(ids, vectors)
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=np.float64)
    n, sums = len(fit), fit.sum(0)
    apart = fit - sums / n
    e, q = np.linalg.eigh(apart.T @ apart / n)
    return good, n, sums, e[::-1], q[:, ::-1], np.trace(apart.T @ apart / n)


def _check_whitened(got, vectors, ids):
    good, n, sums, e, q, trace = _expected(vectors, ids)
    k = min(4, len(sums))
    assert len(got) == len(good) * k
    for c in range(1, k + 1):
        mine = sorted((r.vec_id, r.whitened, r.deviation) for r in got if r.component == c)
        theirs = sorted(
            (i, float((np.array(x) - sums / n) @ q[:, c - 1] / math.sqrt(e[c - 1])),
             sum((n * a - int(s)) ** 2 for a, s in zip(x, sums)))
            for i, x in good
        )
        sign = math.copysign(1, sum(a[1] * b[1] for a, b in zip(mine, theirs)))
        for a, b in zip(mine, theirs):
            assert a[0] == b[0] and a[2] == b[2] and abs(a[1] - sign * b[1]) < 1e-9
        shares = {r.explained for r in got if r.component == c}
        assert len(shares) == 1 and abs(shares.pop() / (e[c - 1] / trace) - 1) < 1e-9
    assert {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_of_the_small_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = queries.QUERIES["op11_qdwh_whitening"](spark, SF).collect()
    _check_whitened(got, [r.embedding for r in table], [r.vec_id for r in table])


def test_whitening_of_odd_rows(spark):
    random = np.random.default_rng(2)
    # A hot vector, a repeated id, NULL id, coordinates far from zero, unlike spreads.
    vectors = (random.normal(size=(60, 5)) * [9, 4, 2, 1, 0.5] + [0, 0, 1000, 0, -7]).tolist()
    vectors += [vectors[0]] * 40 + _odd_vectors(5)
    ids = [*range(99), 7, *range(200, 204)]
    got = whitening.whiten(_rows(spark, vectors, ids)).collect()
    single = [r for r in got if r.vec_id != 7]
    assert len(got) - len(single) == 8
    keep = [(i, v) for i, v in zip(ids, vectors) if i != 7]
    good, n, *_ = _expected(vectors, ids)
    assert {r.n for r in got} == {n} == {60}
    # The two rows of one id carry two vectors; the others are as numpy has them.
    renamed = [1000 if p == 99 else i for p, i in enumerate(ids)]
    _check_whitened(whitening.whiten(_rows(spark, vectors, renamed)).collect(), vectors, renamed)
    assert len(single) == 4 * (len(keep) - 4)


def test_whitening_without_variance_and_of_short_and_huge_vectors(spark):
    same = whitening.whiten(_rows(spark, [[1.0, 2.0]] * 3)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, None, None, None)] * 6
    line = whitening.whiten(_rows(spark, [[0.0, 1.0, 5.0], [1.0, 1.0, 5.0], [3.0, 1.0, 5.0]])).collect()
    assert sorted({r.component for r in line}) == [1, 2, 3]
    assert all((r.whitened is None) == (r.component > 1) for r in line)
    mixed = whitening.whiten(_rows(spark, [[], [2.0], [3.0], [1.0, 1.0], [2.0, 5.0], [9.0, 4.0]])).collect()
    assert sorted((r.vec_id, r.component) for r in mixed) == [(1, 1), (2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (5, 1), (5, 2)]
    huge = whitening.whiten(_rows(spark, [[3e38, 1.0], [-3e38, 2.0], [0.0, 3.0]])).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge if r.vec_id < 2)
    assert whitening.whiten(_rows(spark, [])).collect() == []
    assert whitening.whiten(_rows(spark, _odd_vectors())).collect() == []


def test_covariance_is_exact_whatever_the_partitions(spark):
    random = np.random.default_rng(4)
    vectors = (random.normal(size=(200, 3)) + [1e6, 0, -1e5]).tolist()
    rows = _rows(spark, vectors)
    models = [
        whitening.fitted(
            codes.with_integers(rows.repartition(p), "embedding", 256, ["vec_id"]).select("size", "x").distinct()
        )[3]
        for p in (1, 5)
    ]
    assert models[0].trace == models[1].trace and (models[0].axes == models[1].axes).all()
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors]
    n, trace = len(x), Fraction(0)
    for d in range(3):
        s = sum(r[d] for r in x)
        trace += Fraction(sum((n * r[d] - s) ** 2 for r in x), n**3)
    assert models[0].trace == float(trace)


# --- op13 -----------------------------------------------------------------------------


def _plain_codes(vectors, ids, labels, parts=4, entries=256, rounds=4):
    """Every part against every entry."""
    good = [
        (i, k, [math.floor(1024 * float(np.float32(c))) for c in v])
        for i, v, k in zip(ids, vectors, labels)
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    order = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    size = len(good[0][2])
    cut = [(p * size // parts, (p + 1) * size // parts) for p in range(parts)]
    books = [[r[2][a:b] for r in order[:entries]] for a, b in cut]

    def near(part, book):
        return min((sum((x - e) ** 2 for x, e in zip(part, entry)), j) for j, entry in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            held = {}
            for _, _, x in good:
                held.setdefault(near(x[a:b], books[p])[1], []).append(x[a:b])
            for j, some in held.items():
                books[p][j] = [sum(c) // len(some) for c in zip(*some)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    found = []
    for i, k, x in good:
        best = [near(x[a:b], books[p]) for p, (a, b) in enumerate(cut)]
        found.append((i, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), k))
    sums = {}
    for *_, error, k in found:
        sums[k] = sums.get(k, 0) + error
    fits = lambda v: v if v < 2**63 else None
    return sorted(((i, c, fits(e), fits(sums[k]), digest) for i, c, e, k in found), key=repr)


def _coded(rows, **how):
    return sorted((tuple(r) for r in codes.compress(rows, **how).collect()), key=repr)


@pytest.mark.parametrize("spread", [0.003, 1.0, 1e6])
def test_codes_equal_plain_assignment(spark, spread):
    """Few different parts and ties, plain ones, and ones beyond exact doubles."""
    random = np.random.default_rng(8)
    vectors = (random.normal(size=(90, 8)) * spread).astype(np.float32).tolist()
    vectors += [vectors[3]] * 30 + _odd_vectors(8)
    ids = [*(199 - np.arange(120)).tolist(), 300, 301, 302, 303]
    labels = [i % 3 or None for i in range(124)]
    rows = _rows(spark, vectors, ids, labels)
    for entries in (7, 256):
        got = _coded(rows, entries=entries, rounds=3)
        assert got == _plain_codes(vectors, ids, labels, entries=entries, rounds=3)


def test_nearest_is_exact_on_shared_prefixes():
    random = np.random.default_rng(1)
    values = np.unique(random.integers(-3, 4, size=(3000, 6)), axis=0)
    entries = random.integers(-3, 4, size=(40, 6))
    index, distance = codes.nearest(values, entries)
    plain = ((values[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (index == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()
    wide = codes.nearest(values.astype(object) * 10**15, entries.astype(object) * 10**15)
    assert (wide[0] == index).all()


def test_codes_of_odd_tables(spark):
    assert _coded(_rows(spark, [])) == [] == _coded(_rows(spark, _odd_vectors()))
    one = _coded(_rows(spark, [[1.5, -0.25, 3.0]], [None]))
    assert [r[1:4] for r in one] == [("00000000", 0, 0)]
    # Two lengths: each has its own codebook, one of them not a multiple of four.
    mixed = _coded(_rows(spark, [[], [1.0] * 5, [2.0] * 5, [1.0] * 4], [4, 3, 2, 1], [1, 1, 2, 2]))
    assert [r[:3] for r in mixed] == [(1, "00000000", 0), (2, "00000000", 0), (3, "01010101", 0), (4, "00000000", 0)]
    assert len({r[4] for r in mixed}) == 3
    huge = _coded(_rows(spark, [[3e38] * 4, [-3e38] * 4, [1.0] * 4], labels=[1, 1, 2]), entries=1, rounds=1)
    assert huge[0][2] is None and huge[0][3] is None


def test_small_table_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    answer = con.sql(codes.codes_sql())
    got = queries.QUERIES["op13_trie_vector_codes"](spark, SF).select(*answer.columns)
    assert sorted(map(tuple, got.collect())) == sorted(answer.fetchall())


def test_a_hot_label_and_null_labels_are_summed(spark):
    vectors = np.random.default_rng(5).normal(size=(50, 4)).tolist()
    labels = [None if i % 2 else 1 for i in range(50)]
    got = codes.compress(_rows(spark, vectors, labels=labels), entries=3).collect()
    for parity in (0, 1):
        some = [r for r in got if r.vec_id % 2 == parity]
        assert {r.label_error for r in some} == {sum(r.error for r in some)}
