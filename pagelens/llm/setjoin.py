"""Jaccard join of word shingle sets with set-relation skipping.

Within a task the join keeps, for each token in the prefix of a set, an index
list sorted by position, so that a probe reads only the run of positions the
position filter allows. A set whose candidates are all in its own component is
skipped. Where overlaps are needed they come for all sets at once, and from the
overlaps of the set before it when the two differ little: only the lists of the
tokens they do not share are read.

What tasks get is decided by keys. Two sets that link differ in a bounded
number of tokens, so of that many token ranges plus one at least one is equal;
a key names the content of one range. Sets that share a key form candidate
groups. Rows are sorted by key and set over all tasks, so no group is ever
collected and a frequent key is split; keys of passages that many sets hold are
left out wherever a set has enough others. A candidate group is then joined in blocks
of bounded token count; blocks are paired in two rounds, and the second takes
only pairs that are not yet in one component.

Equal sets are one set with a name of 64 bits (odds of a wrong meeting: pairs
of different sets over 2**64). Links between copies need no work.

Defined results: NULL text and text without words have no shingles and link
with nothing; a NULL ``doc_id`` never is the least of a component unless all
are NULL; rows with one ``doc_id`` and different texts are each joined by their
own text; an empty table gives no rows; extra columns are ignored.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelens.llm.components import components
from pagelens.llm.shingles import mix, set_id, shingle_sets
from pagelens.llm.worker import document_batches
from pagelens.operators.shared import cut, small

# Tokens of a block; two blocks meet in a task.
BLOCK_TOKENS = 500_000
# Greatest number of tokens asked of a range.
MOST_TOKENS = 8
# Sets that may have a key before it counts as common.
COMMON_SETS = 8
# Candidate sets sent to every task instead of a shuffle of texts.
BROADCAST_ROWS = 200_000


class Ranges:
    """Token ranges by set size, for links of at least ``num / den``.

    Class ``c`` holds the sizes up to ``tops[c]``; a set and a larger partner
    are in one class or in adjoining ones, and both take the ranges of the
    smaller one's class. At most ``apart(c)`` tokens of such a pair differ, and
    at most ``differ(size, larger)`` for a set of that size in that role.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.tops = [0]
        self._plans: dict[int, tuple[int, int]] = {}

    def class_of(self, size: int) -> int:
        while self.tops[-1] < size:
            top = self.tops[-1]
            self.tops.append(max(top + 1, top * self.den // self.num))
        return int(np.searchsorted(self.tops, size))

    def apart(self, c: int) -> int:
        return self.tops[c] * (self.den - self.num) // self.num

    def differ(self, size: int, larger: bool) -> int:
        lost = (self.den - self.num) * size
        return 2 * lost // (self.den + self.num) if larger else lost // self.num

    def plan(self, c: int) -> tuple[int, int]:
        """Ranges of class ``c`` and the least tokens of a range with a key.

        The more tokens a range must hold, the less do sets meet that only
        share a passage. Nearly every set must have more such ranges than
        tokens that may differ, and a few to spare for common passages.
        """
        found = self._plans.get(c)
        if found is None:
            need = self.apart(c) + 1
            self.class_of(self.tops[c] + 1)
            low, high = self.tops[c - 1] + 1, self.tops[c]
            roles = [(low, False), (high, False), (self.tops[c + 1], True)]
            counts = np.arange(need, max(need + 2, 3 * low // 2 + 2))
            found = need, 0
            for tokens in range(MOST_TOKENS, 0, -1):
                enough = np.ones(len(counts), dtype=bool)
                for size, larger in roles:
                    mean = size / counts
                    below = sum(mean**i / math.factorial(i) for i in range(tokens))
                    few = counts * np.exp(-mean) * below
                    wanted = self.differ(size, larger) + 1
                    enough &= counts - few - np.sqrt(few) >= wanted + 2
                if enough.any():
                    found = int(counts[np.argmax(enough)]), tokens
                    break
            self._plans[c] = found
        return found

    def keys(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of a set with their notes, as the smaller and as the larger.

        If one set of a pair has more ranges of enough tokens than tokens that
        differ, one of them is the same in both, and both name it. A set with
        fewer names all its ranges, empty ones too: two such sets have at least
        one equal range of any kind. The note is twice the number of keys that
        the set could do without (-1 if none), plus one in the larger role.
        """
        own = self.class_of(len(hashes))
        out, notes = [np.empty(0, np.uint64)], [np.empty(0, np.int32)]
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
        high = hashes >> np.uint64(32)
        for c, larger in ((own, False), (own - 1, True)):
            if c < 1 or self.apart(c) == 0:
                continue
            k, least = self.plan(c)
            place = ((high * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
            sizes = np.bincount(place, minlength=k)
            ends = np.cumsum(sizes)
            content = sums[ends] - sums[ends - sizes]
            name = np.arange(k, dtype=np.uint64) + np.uint64(c << 32)
            keys = mix(content + mix(name))
            full = sizes >= least
            spare = int(full.sum()) - self.differ(len(hashes), larger) - 1
            if spare >= 0:
                keys = keys[full]
            out.append(keys)
            notes.append(np.full(len(keys), 2 * max(spare, -1) + larger, np.int32))
        return np.concatenate(out), np.concatenate(notes)


def named_sets(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, set_id`` of every row; ``set_id`` is NULL if empty.

    ``text_id`` names the row's text: with ``doc_id`` it finds the row again.
    """

    def run(batches):
        for batch in batches:
            found = [
                (len(s), set_id(s) if len(s) else None)
                for s in shingle_sets(batch.column(1).to_pylist(), size)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([s for _, s in found], pa.int64()),
                    batch.column(2),
                ],
                names=["doc_id", "n_shingles", "set_id", "text_id"],
            )

    schema = "doc_id bigint, n_shingles bigint, set_id bigint, text_id bigint"
    return docs.select(
        F.col("doc_id").cast("long"), "text", F.xxhash64("text")
    ).mapInArrow(run, schema)


def range_keys(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """``key, set_id, note``; a task names each set once, so copies cost little."""

    def run(batches):
        ranges = Ranges(num, den)
        seen: set[int] = set()
        parts: list[tuple] = []
        held = 0

        def rows():
            columns = [pa.array(np.concatenate(c)) for c in zip(*parts)]
            return pa.RecordBatch.from_arrays(columns, names=["key", "set_id", "note"])

        for batch in batches:
            for hashes in shingle_sets(batch.column(0).to_pylist(), size):
                if not len(hashes):
                    continue
                name = set_id(hashes)
                if name in seen:
                    continue
                seen.add(name)
                keys, notes = ranges.keys(hashes)
                parts.append((keys.view(np.int64), np.full(len(keys), name, np.int64), notes))
                held += len(keys)
                if held >= 200_000:
                    yield rows()
                    parts, held = [], 0
        if parts:
            yield rows()

    return docs.select("text").mapInArrow(run, "key bigint, set_id bigint, note int")


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The rows whose key another set may have, each once.

    Rows are range partitioned by key and set, so that the rows of a frequent
    key lie in several tasks, and read in order, so that no key is gathered.
    The first and last row of a partition stay whatever they are.
    """

    def run(batches):
        kept = None  # the last set of the last key and whether it met another

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            first = kept is None
            if not first:
                columns = [np.concatenate([[k], c]) for k, c in zip(kept[0], columns)]
            key, name = columns[0], columns[1]
            same = np.zeros(len(key) + 1, dtype=bool)
            same[1:-1] = (key[1:] == key[:-1]) & (name[1:] != name[:-1])
            met = same[:-1] | same[1:]
            met[0] |= first or kept[1]
            # A set that several tasks named is one run of equal rows.
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
            runs = np.flatnonzero(fresh)
            any_met = np.logical_or.reduceat(met, runs)
            chosen = runs[:-1][any_met[:-1]]
            kept = [c[runs[-1]] for c in columns], bool(any_met[-1])
            yield _key_rows([c[chosen] for c in columns])
        if kept is not None:
            yield _key_rows([np.array([v]) for v in kept[0]])

    spark = keyed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        keyed.repartitionByRange(parts, "key", "set_id")
        .sortWithinPartitions("key", "set_id")
        .mapInArrow(run, keyed.schema)
    )


def _key_rows(columns) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "set_id", "note"]
    )


def key_neighbours(keyed: DataFrame) -> tuple[DataFrame, int]:
    """Edges ``(a, b)`` that connect all sets which may link, and their bound.

    A key of more than ``COMMON_SETS`` sets is that of a passage, or of a large
    group of near copies. A set that has enough other keys does without its
    common ones: one of the others is still shared with every partner. Which
    keys are common is one count over all sets, so both sides of a pair agree.
    """
    rows = cut(shared_keys(keyed).distinct())
    sets = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("sets"), F.min("set_id").alias("a")
    )
    met = cut(rows.join(sets.filter("sets > 1"), "key"))
    common = F.col("sets") > COMMON_SETS
    spare = met.filter(common).groupBy("set_id", "note").agg(
        (F.count(F.lit(1)) <= F.floor(F.col("note") / 2)).alias("spares")
    )
    kept = (
        met.join(spare, ["set_id", "note"], "left")
        .filter(~common | ~F.coalesce("spares", F.lit(False)))
        .select("key", F.col("set_id").alias("b"))
    )
    least = kept.groupBy("key").agg(F.min("b").alias("a"))
    edges = kept.join(least, "key").filter("a <> b").select("a", "b")
    return edges, met.count()


class SkipJoin:
    """Exact join of the sets of one task; returns a spanning forest.

    ``sets`` are arrays of distinct hashes. Sets are renumbered by size, tokens
    by how many sets hold them, rare ones first.
    """

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        self.order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        chosen = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in chosen], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        tokens = np.concatenate(chosen) if chosen else np.empty(0, np.uint64)
        _, token, held = np.unique(tokens, return_inverse=True, return_counts=True)
        rank_of = np.empty(len(held), np.int64)
        rank_of[np.argsort(held, kind="stable")] = np.arange(len(held))
        owner = np.repeat(np.arange(len(chosen)), self.sizes)
        self.rank = rank_of[token]
        by_rank = np.lexsort((self.rank, owner))
        self.rank = self.rank[by_rank]
        self.held = held[np.argsort(held, kind="stable")]
        # All lists: the sets of each token.
        in_lists = np.argsort(self.rank, kind="stable")
        self.lists = owner[in_lists]
        self.list_starts = np.concatenate([[0], np.cumsum(self.held)])
        # Index lists of prefix tokens, sorted by position.
        position = np.arange(len(tokens)) - np.repeat(self.starts[:-1], self.sizes)
        need = -(-self.sizes * num // den)
        self.prefix = np.maximum(self.sizes - need + 1, 0)
        index = np.flatnonzero(position < self.prefix[owner])
        index = index[np.lexsort((position[index], self.rank[index]))]
        self.index_set, self.index_pos = owner[index], position[index]
        self.index_starts = np.searchsorted(
            self.rank[index], np.arange(len(held) + 1)
        )
        self.label = np.arange(len(chosen))
        self._known: tuple[int, np.ndarray] | None = None

    def tokens(self, x: int) -> np.ndarray:
        return self.rank[self.starts[x] : self.starts[x + 1]]

    def candidates(self, x: int) -> np.ndarray:
        """Earlier sets that pass prefix, position and size filter."""
        size = int(self.sizes[x])
        # A partner y of size at most |x| shares at least this many tokens.
        least = -(-size * self.num // self.den)
        mine, theirs = size - least, size - least
        found = []
        for i, t in enumerate(self.tokens(x)[: self.prefix[x]].tolist()):
            a, b = self.index_starts[t], self.index_starts[t + 1]
            if b - a < 2:
                continue
            run = self.index_pos[a:b]
            low, high = np.searchsorted(run, [i - mine, i + theirs + 1])
            found.append(self.index_set[a + low : a + high])
        if not found:
            return np.empty(0, np.int64)
        near = np.unique(np.concatenate(found))
        near = near[near < x]
        return near[self.sizes[near] * self.den >= size * self.num]

    def _add(self, counts: np.ndarray, tokens: np.ndarray, sign: int) -> None:
        a, n = self.list_starts[tokens], self.held[tokens]
        total = int(n.sum())
        if total:
            at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(total)
            counts += sign * np.bincount(self.lists[at], minlength=len(counts))

    def overlaps(self, x: int) -> np.ndarray:
        """Overlap of ``x`` with every set, derived from the last answer."""
        tokens = self.tokens(x)
        if self._known is not None:
            other, counts = self._known
            theirs = self.tokens(other)
            gained = np.setdiff1d(tokens, theirs, assume_unique=True)
            lost = np.setdiff1d(theirs, tokens, assume_unique=True)
            if len(gained) + len(lost) < len(tokens):
                counts = counts.copy()
                self._add(counts, gained, 1)
                self._add(counts, lost, -1)
                self._known = x, counts
                return counts
        counts = np.zeros(len(self.sizes), np.int64)
        self._add(counts, tokens, 1)
        self._known = x, counts
        return counts

    def forest(self) -> list[tuple[int, int]]:
        edges = []
        for x in range(len(self.sizes)):
            near = self.candidates(x)
            near = near[self.label[near] != self.label[x]]
            if not len(near):
                continue
            both = self.overlaps(x)[near]
            union = self.sizes[near] + self.sizes[x] - both
            for y in near[both * self.den >= union * self.num].tolist():
                if self.label[y] != self.label[x]:
                    edges.append((self.order[x], self.order[y]))
                    self.label[self.label == self.label[x]] = self.label[y]
        return edges


def _with_tokens(rows: DataFrame, size: int) -> DataFrame:
    """Replaces ``text`` by ``tokens``; drops rows of another set.

    A task names each set once, so copies of a text are not kept.
    """
    kept = [c for c in rows.columns if c != "text"]
    chosen = rows.select("text", *kept)

    def run(batches):
        at = 1 + kept.index("set_id")
        seen: set[int] = set()
        for batch in batches:
            named = batch.column(at).to_pylist()
            fresh = []
            for name in named:
                fresh.append(name not in seen)
                seen.add(name)
            batch = batch.filter(pa.array(fresh))
            named = [name for name, new in zip(named, fresh) if new]
            sets = list(shingle_sets(batch.column(0).to_pylist(), size))
            right = [len(s) > 0 and set_id(s) == n for s, n in zip(sets, named)]
            tokens = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [tokens, *batch.columns[1:]], names=["tokens", *kept]
            ).filter(pa.array(right))

    schema = chosen.drop("text").schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return chosen.mapInArrow(run, f"tokens binary, {fields}")


def _joined(sets: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Verified edges of the block pairs ``(bucket, i, j)``."""
    sides = pairs.select(
        "bucket", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")
    )

    def run(key, part):
        names = part.column("set_id").to_numpy()
        hashes = [np.frombuffer(t, np.uint64) for t in part.column("tokens").to_pylist()]
        _, first = np.unique(names, return_index=True)
        edges = SkipJoin([hashes[i] for i in first], num, den).forest()
        chosen = names[first]
        a = chosen[[x for x, _ in edges]] if edges else np.empty(0, np.int64)
        b = chosen[[y for _, y in edges]] if edges else np.empty(0, np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    shipped = sides.join(sets, ["bucket", "block"]).select(
        "bucket", "i", "j", "set_id", "tokens"
    )
    return shipped.groupBy("bucket", "i", "j").applyInArrow(run, "a bigint, b bigint")


def linked_sets(
    docs: DataFrame, named: DataFrame, size: int, num: int, den: int
) -> DataFrame:
    """``set_id, root`` of every set with a link to a different set."""
    spark = docs.sparkSession
    groups = components(*key_neighbours(range_keys(docs, size, num, den)))
    # Of each set one row, with an id where any has one.
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id", "n_shingles")
    one_each = (
        named.filter(F.col("set_id").isNotNull())
        .groupBy("set_id")
        .agg(F.min(row).alias("row"))
        .select("set_id", "row.doc_id", "row.text_id", F.col("row.n_shingles").alias("n"))
    )
    candidates = cut(
        one_each.join(groups.withColumnRenamed("id", "set_id"), "set_id")
    )
    weights = candidates.groupBy("root").agg(F.sum("n").alias("w")).withColumn(
        "blocks", F.ceil(F.col("w") / F.lit(BLOCK_TOKENS)).cast("int")
    )
    # Groups of one block share buckets of about a block's tokens.
    light = weights.filter("blocks = 1").agg(F.sum("w")).first()[0] or 0
    buckets = int(light // BLOCK_TOKENS) + 1
    bucket = F.when(
        F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(buckets))
    ).otherwise(F.xxhash64("root"))
    heavy = F.when(F.col("blocks") == 1, F.lit(False)).otherwise(F.lit(True))
    placed = cut(
        candidates.join(weights, "root").select(
            "doc_id",
            "text_id",
            "set_id",
            F.struct(heavy.alias("heavy"), bucket.alias("of")).alias("bucket"),
            F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int").alias("block"),
            "blocks",
        )
    )
    texts = docs.select(
        F.col("doc_id").cast("long").alias("__doc"), F.xxhash64("text").alias("__text"), "text"
    )
    lookup = F.broadcast(placed) if small(placed, BROADCAST_ROWS) else placed
    same = (F.col("__text") == F.col("text_id")) & F.col("__doc").eqNullSafe(F.col("doc_id"))
    sets = cut(
        _with_tokens(
            texts.join(lookup, same).select(
                "text", "set_id", "bucket", "block", "blocks"
            ),
            size,
        )
    )
    shape = placed.groupBy("bucket").agg(F.max("blocks").alias("blocks"))
    near = shape.select(
        "bucket",
        "blocks",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"),
    ).select(
        "bucket",
        F.least("x", F.pmod(F.col("x") + 1, "blocks")).alias("i"),
        F.greatest("x", F.pmod(F.col("x") + 1, "blocks")).alias("j"),
    ).distinct()
    edges = cut(_joined(sets, near, num, den))
    far = _unsettled(spark, placed, shape, near, edges)
    if far is not None:
        edges = edges.unionByName(cut(_joined(sets, far, num, den)))
    return components(edges, edges.count()).withColumnRenamed("id", "set_id")


def _unsettled(spark: SparkSession, placed, shape, near, edges) -> DataFrame | None:
    """Further block pairs whose sets are not all in one component yet."""
    many = shape.filter("blocks > 2")
    if many.isEmpty():
        return None
    roots = components(edges, edges.count()).withColumnRenamed("id", "set_id")
    by_block = (
        placed.filter("blocks > 2")
        .join(roots, "set_id", "left")
        .groupBy("bucket", "block")
        .agg(
            F.min(F.coalesce("root", "set_id")).alias("low"),
            F.max(F.coalesce("root", "set_id")).alias("high"),
        )
    )
    pairs = many.select(
        "bucket", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")
    ).select(
        "bucket", "i", F.explode(F.sequence("i", F.col("blocks") - 1)).alias("j")
    ).filter("i < j").join(near, ["bucket", "i", "j"], "left_anti")
    left = by_block.select("bucket", F.col("block").alias("i"), F.col("low").alias("li"), F.col("high").alias("hi"))
    right = by_block.select("bucket", F.col("block").alias("j"), F.col("low").alias("lj"), F.col("high").alias("hj"))
    return (
        pairs.join(left, ["bucket", "i"])
        .join(right, ["bucket", "j"])
        .filter("not (li = hi and lj = hj and li = lj)")
        .select("bucket", "i", "j")
    )


def near_duplicate_groups(
    docs: DataFrame, size: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Two rows link when ``den * intersection >= num * union``.
    """
    document_batches(docs.sparkSession)
    named = cut(named_sets(docs, size))
    roots = linked_sets(docs, named, size, num, den)
    least = named.filter(F.col("set_id").isNotNull()).groupBy("set_id").agg(
        F.min("doc_id").alias("least")
    )
    rooted = least.join(roots, "set_id", "left").select(
        "set_id", "least", F.coalesce("root", "set_id").alias("root")
    )
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = rooted.join(groups, "root").select("set_id", "component_id")
    return named.join(of_set, "set_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def groups_sql(size: int, num: int, den: int) -> str:
    """The same by comparing all pairs that share a shingle, for small tables."""
    return rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
shingle AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {size}
        THEN [array_to_string(w[i : i + {size} - 1], ' ') FOR i IN range(1, len(w) - {size} + 2)]
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s
    FROM words),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
met AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
    FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
    SELECT a, b FROM met JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
    WHERE {den} * n_both >= {num} * (x.n + y.n - n_both)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, least(d.doc_id, coalesce(min(b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN reach ON a = d.doc_id GROUP BY d.doc_id
"""
