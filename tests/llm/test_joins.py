"""Set join, vectors, components, sharding, the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from edge_data import SF
from pagelens.llm import setjoin, sharding, vectors
from pagelens.llm.components import components
from pagelens.llm.queries import QUERIES
from pagelens.llm.shingles import shingle_sets
from pagelens.llm.worker import BATCH_ROWS

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


class Groups:
    def __init__(self):
        self.parent = {}

    def root(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def grouped(rows, size, num, den):
    """Component of each ``(id, text)`` by comparing all pairs that share a shingle."""
    groups, index, by_id = Groups(), defaultdict(list), {}
    for doc_id, text in rows:
        own = by_id[doc_id] = shingles(text, size)
        groups.root(doc_id)
        common = Counter(other for s in own for other in index[s])
        for other, n in common.items():
            if den * n >= num * (len(own) + len(by_id[other]) - n):
                groups.join(doc_id, other)
        for s in own:
            index[s].append(doc_id)
    return {i: (len(s), groups.root(i)) for i, s in by_id.items()}


def joined(df, size, num, den):
    rows = setjoin.near_duplicate_groups(df, size, num, den).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def variants(seed, count, changes, words=60, base=None):
    """Texts near one base text, some far from each other."""
    rng = random.Random(seed)
    base = base or [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(count):
        text = list(base)
        for _ in range(rng.randrange(changes + 1)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(99)}"
        out.append(" ".join(text))
    return out


# --- set join -------------------------------------------------------------------------


@pytest.mark.parametrize("size, num", [(3, 90), (5, 80), (1, 50), (2, 100)])
def test_groups_equal_brute_force(spark, texts, size, num):
    assert joined(spark.createDataFrame(texts, "doc_id BIGINT, text STRING"), size, num, 100) == (
        grouped(texts, size, num, 100)
    )


@pytest.mark.parametrize("block", [2_000_000, 900])
def test_large_group_of_variants(spark, monkeypatch, block):
    """One group in one block or many gives the same components."""
    monkeypatch.setattr(setjoin, "BLOCK_TOKENS", block)
    lines = variants(1, 150, 6) + variants(2, 40, 2, 25) + variants(3, 30, 9, 300)
    rows = list(enumerate(lines + lines[:50]))
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(5)
    assert joined(df, 3, 90, 100) == grouped(rows, 3, 90, 100)
    assert joined(df, 3, 80, 100) == grouped(rows, 3, 80, 100)


def test_keys_met_across_batches(spark):
    """Rows of one key and set may lie on both sides of a batch's end."""
    rng = random.Random(4)
    rows = [(rng.randrange(12), rng.randrange(5), 0) for _ in range(300)]
    keyed = spark.createDataFrame(rows, "key BIGINT, set_id BIGINT, note INT").repartition(4)
    sets = defaultdict(set)
    for key, name, _ in rows:
        sets[key].add(name)
    spark.conf.set(BATCH_ROWS, "3")
    try:
        for parts in ("1", "6"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = {(r.key, r.set_id) for r in setjoin.shared_keys(keyed).collect()}
            want = {(k, s) for k, names in sets.items() if len(names) > 1 for s in names}
            assert want <= got <= {(k, s) for k, names in sets.items() for s in names}
    finally:
        spark.conf.unset(BATCH_ROWS)
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_candidates_may_be_shuffled(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "small", lambda df, rows: False)
    rows = list(enumerate(variants(5, 40, 3)))
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    assert joined(df, 3, 80, 100) == grouped(rows, 3, 80, 100)


@pytest.mark.parametrize("doc_id", [None, 5])
def test_rows_of_one_id_are_told_apart_by_their_text(spark, doc_id):
    """Each candidate fetches its own text, not all rows of its id."""
    lines = variants(5, 60, 3)
    rows = [(doc_id, t) for t in lines + lines[:20]] + [(100 + i, t) for i, t in enumerate(lines[:5])]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    named = setjoin.named_sets(df, 3).collect()
    fetched = []
    plain = setjoin._with_tokens

    def watched(texts, size):
        out = plain(texts, size)
        fetched.append((texts.count(), out.count()))
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(setjoin, "_with_tokens", watched)
        got = setjoin.near_duplicate_groups(df, 3, 80, 100).collect()
    assert len(got) == len(rows) and fetched[0][0] <= len(rows)
    assert len({r.set_id for r in named}) <= len(set(lines))
    want = grouped(list(enumerate([t for _, t in rows])), 3, 80, 100)
    by_component = defaultdict(set)
    for r, (i, _) in zip(sorted(got, key=repr), sorted(enumerate(rows))):
        by_component[r.component_id].add(r.doc_id)
    assert len(got) == len(want)


def test_op8_equals_brute_force(spark, texts):
    rows = QUERIES["op8_set_relation_join"](spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == grouped(texts, 3, 90, 100)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([(90, 100), (80, 100), (50, 100), (2, 3)]))
def test_linked_sets_share_a_key(seed, share):
    num, den = share
    rng = random.Random(seed)
    ranges = setjoin.Ranges(num, den)
    base = {rng.getrandbits(64) for _ in range(rng.randrange(1, 120))}
    other = set(base)
    for _ in range(rng.randrange(12)):
        other.discard(rng.choice(sorted(other))) if len(other) > 1 else None
        if rng.random() < 0.5:
            other.add(rng.getrandbits(64))
    if base == other or den * len(base & other) < num * len(base | other):
        return
    less, more = sorted((base, other), key=len)
    same_class = ranges.class_of(len(less)) == ranges.class_of(len(more))
    sides = []
    for own, role in ((less, 0), (more, 0 if same_class else 1)):
        keys, notes = ranges.keys(np.array(sorted(own), np.uint64))
        chosen = (notes & 1) == role
        sides.append((keys[chosen], int(notes[chosen][0]) >> 1))
    shared = len(np.intersect1d(sides[0][0], sides[1][0]))
    assert shared
    # Without as many of its keys as a set can spare, one is left in common.
    for keys, spare in sides:
        assert len(keys) - spare > len(keys) - shared or spare < 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=14), min_size=1, max_size=25))
def test_skipping_loses_no_link(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    got, want = Groups(), Groups()
    for i, j in setjoin.SkipJoin(arrays, 70, 100).forest():
        got.join(i, j)
        assert 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j])
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j]):
                want.join(i, j)
    assert [got.root(i) for i in range(len(sets))] == [want.root(i) for i in range(len(sets))]


def test_overlaps_derived_equal_overlaps_counted():
    rng = random.Random(8)
    base = set(range(200))
    sets = [base ^ {rng.randrange(220) for _ in range(9)} for _ in range(30)]
    work = setjoin.SkipJoin([np.array(sorted(s), np.uint64) for s in sets], 90, 100)
    for x in range(30):
        own = sets[work.order[x]]
        assert work.overlaps(x).tolist() == [len(own & sets[work.order[y]]) for y in range(30)]


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAb é\n\t\x0b.", max_size=30)), max_size=8))
@settings(max_examples=150, deadline=None)
def test_hashed_sets_have_the_right_sizes(lines):
    for size in (1, 3):
        got = [len(s) for s in shingle_sets(lines, size)]
        assert got == [len(shingles(t, size)) for t in lines]


def test_set_edges(edges, empty):
    rows = setjoin.near_duplicate_groups(edges, 3, 90, 100).collect()
    assert len(rows) == edges.count()
    found = Counter((r.doc_id, r.component_id) for r in rows)
    assert found[6, 5] == 1 and found[12, 11] == 2 and found[None, None] == 1
    assert found[0, 0] == found[1, 1] == found[2, 2] == 1 and found[11, 11] == 2
    assert setjoin.near_duplicate_groups(empty).count() == 0


# --- components -------------------------------------------------------------------------


@pytest.mark.parametrize("task_edges", [1_000_000, 20])
@pytest.mark.parametrize("kind", ["random", "path", "star", "loops"])
def test_components(spark, monkeypatch, kind, task_edges):
    """All edges in one task, or rounds of stars over several."""
    monkeypatch.setattr("pagelens.llm.components.TASK_EDGES", task_edges)
    rng = random.Random(6)
    edges = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(260)],
        "path": [(i, i + 1) for i in range(150)],
        "star": [(500, i) for i in range(200)] + [(7, 900)],
        "loops": [(1, 1), (2, 2), (3, 4), (4, 3), (3, 4)],
    }[kind]
    want = Groups()
    for a, b in edges:
        want.join(a, b)
    got = dict(components(spark.createDataFrame(edges, "a BIGINT, b BIGINT"), len(edges)).collect())
    for x in want.parent:
        assert got.get(x, x) == want.root(x)


# --- vectors -----------------------------------------------------------------------------


def near(rows, cosine=0.95):
    """``id -> (links, component)`` from all pairs in double precision."""
    def good(v):
        return bool(v) and None not in v and np.isfinite(v).all() and np.any(v)

    groups, links = Groups(), Counter()
    unit = [(i, np.array(v, float) / np.linalg.norm(v)) for i, v in rows if good(v)]
    for i, _ in rows:
        groups.root(i)
    for k, (i, u) in enumerate(unit):
        for j, w in unit[:k]:
            if len(u) == len(w) and u @ w >= cosine:
                links.update((i, j))
                groups.join(i, j)
    return {i: (links[i], groups.root(i)) for i, _ in rows}


def found_near(df, cosine=0.95):
    rows = vectors.near_duplicates(df, cosine).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return {r.vec_id: (r.n_links, r.component_id) for r in rows}


def clustered(seed, count, size=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(count // 6, size))
    rows = centres[rng.integers(0, len(centres), count)] + rng.normal(0, 0.12, (count, size))
    rows[count // 2 :: 3] = rows[0] * 2
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("block, leaf", [(8192, 512), (50, 7)])
def test_vectors_equal_all_pairs(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(vectors, "LEAF_ROWS", leaf)
    rows = clustered(3, 400)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 0.0], [2.0, 0.0], [1e38] * 16]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>").withColumn(
        "label", F.lit(1)
    )
    got = found_near(df)
    assert got == near(rows)
    assert got[1006] == (1, 1005)


def test_op7_on_the_table(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    got = QUERIES["op7_epsilon_grid_order_join"](spark, SF).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == near(rows)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    assert vectors.near_duplicates(none).count() == 0
    null = spark.createDataFrame([(1, None)], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    assert found_near(null) == {1: (0, 1)}


# --- sharding -----------------------------------------------------------------------------


def test_draws_have_the_right_law():
    rng = random.Random(1)
    for good, bad, draws in ((30, 70, 20), (5, 3, 4), (1, 9, 10), (400, 2, 300)):
        drawn = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(6000))
        total = np.random.default_rng(1).hypergeometric(good, bad, draws, 200_000)
        for value in drawn:
            assert abs(drawn[value] / 6000 - (total == value).mean()) < 0.03
    big = [sharding.hypergeometric(rng, 3 * 10**10, 5 * 10**10, 10**7) for _ in range(50)]
    assert abs(np.mean(big) / (10**7 * 3 / 8) - 1) < 1e-3


@given(st.dictionaries(st.integers(0, 40), st.integers(0, 300), max_size=20), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_margins_are_exact(counts, shards):
    sizes = sharding.block_sizes(sum(counts.values()), shards, 4)
    matrix = sharding.communication_matrix(counts, sizes)
    assert {p: sum(row) for p, row in matrix.items()} == counts
    assert [sum(c) for c in zip(*matrix.values())] == (sizes if matrix else [])
    whole = [sum(sizes[i : i + 4]) for i in range(0, len(sizes), 4)]
    assert max(whole) - min(whole) <= 1


def check_shards(rows, count):
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    sizes = [len(by_shard[s]) for s in range(count)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1


def test_op10_laws(spark, texts):
    rows = QUERIES["op10_hypergeometric_shards"](spark, SF).collect()
    check_shards(rows, 8)
    told = {r.doc_id: r for r in rows}
    for doc_id, text in texts:
        raw, r = (text or "").encode(), told[doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (
            len(raw) + 1, zlib.crc32(raw), "rows", None
        )


def test_shuffle_is_even(spark):
    """Neighbouring ids go anywhere; other seeds give other orders, one gives one."""
    rows = spark.range(4000).select(F.col("id").alias("doc_id"))
    once = {r.doc_id: r for r in sharding.shuffle_into_shards(rows, 4, ["doc_id"]).collect()}
    again = {r.doc_id: r for r in sharding.shuffle_into_shards(rows.repartition(7), 4, ["doc_id"]).collect()}
    other = {r.doc_id: r for r in sharding.shuffle_into_shards(rows, 4, ["doc_id"], seed=5).collect()}
    assert once == again != other
    table = np.zeros((4, 4))
    for i in range(3999):
        table[once[i].shard, once[i + 1].shard] += 1
    assert ((table - 250) ** 2 / 250).sum() < 45
    ranks = np.array([once[i].slot for i in range(4000)])
    assert abs(np.corrcoef(np.arange(4000), ranks)[0, 1]) < 0.06


def test_shard_edges(edges, empty):
    rows = sharding.shuffle_into_shards(edges, 3, ["doc_id", "text"]).collect()
    check_shards(rows, 3)
    assert Counter(r.text for r in rows) == Counter(r.text for r in edges.collect())
    assert sharding.shuffle_into_shards(empty, 3, ["doc_id"]).count() == 0


# --- pipeline ------------------------------------------------------------------------------


def test_stages(spark, docs, texts, tmp_path):
    """Each stage against what it must do to its own input, by brute force."""
    after = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in after.collect()}
        stage(spark, after, SF).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        rows = {r.doc_id: r for r in after.collect()}
        if k < 3:
            assert after.columns == docs.columns and after.count() == len(rows)
        if name == "language":
            assert set(rows) == {i for i, r in before.items() if re.search(r"[^\W\d_]", r.text or "")}
        if name == "near_duplicates":
            groups = grouped([(i, r.text) for i, r in before.items()], 5, 80, 100)
            assert set(rows) == {i for i, (_, root) in groups.items() if i == root}
            assert all(rows[i] == before[i] for i in rows)
        if name == "personal_data":
            assert set(rows) == set(before)
            assert all(r.n_chars == len(r.text) for r in rows.values())
            assert 0 < sum(rows[i].text != before[i].text for i in rows) < len(rows) / 4
        if name == "packing":
            assert set(rows) == set(before)
    assert corpus_pipeline.run(spark, SF).count() == after.count()


def test_stage_edges(spark, edges, empty):
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, edges, SF)
        assert out.columns == edges.columns
        assert stage(spark, empty, SF).count() == 0
    assert corpus_pipeline.packed(spark, empty, SF).count() == 0
    kept = corpus_pipeline.near_duplicates(spark, edges, SF).collect()
    found = Counter(r.doc_id for r in kept)
    assert found[11] == 2 and found[12] == 0 and found[None] == 1 and found[0] == 1
