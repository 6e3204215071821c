"""Vector code compression: a codebook per part, found through tries.

Components become integers, a vector is cut into consecutive parts, and each
part position has a codebook of up to ``ENTRIES`` entries. The distinct parts
of all vectors, with their numbers, are sorted and dealt by range, so a task
holds one interval of the trie that they form. The trie is walked depth first:
a node's squared distances to all entries are those of its parent plus one
dimension, so vectors that agree in leading dimensions share them. A leaf takes
the least of them; its part, times its number, goes into the entry's sums. Only
sums leave a task, one row for each entry at most.

The driver holds the codebooks (``ENTRIES`` rows of a vector's length for each
vector length); every round is one pass over the distinct parts.

Defined results: rows whose vector is NULL or holds a NULL or non-finite
component are left out; integers beyond 64 bits take the nearest bound; vectors
of different lengths have codebooks of their own; where the length is no
multiple of the parts, part ``p`` ends before component ``(p + 1) * length /
parts``, rounded down; with fewer rows than entries the codebook is as small;
ties of ``vec_id`` are ordered by vector and a NULL id comes last; repeated
rows count as often as they occur; an error beyond 64 bits is NULL; an empty
table gives no rows; other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pagelens.llm.numbers import finite, floored, rows_by_size
from pagelens.operators.shared import cut, small

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
# Leaves whose remaining dimensions are added together; bounds a task's memory.
LEAVES = 1024
BROADCAST_LABELS = 100_000
LONG = 1 << 63


def borders(size: int, parts: int) -> list[tuple[int, int]]:
    """First and last-but-one component of each part."""
    return [(p * size // parts, (p + 1) * size // parts) for p in range(parts)]


def _numbers(values: np.ndarray, entries: np.ndarray):
    """Both as doubles where all distances are exact in them, else as integers
    of any size."""
    most = max(
        [abs(int(f(x))) for x in (values, entries) if x.size for f in (np.min, np.max)],
        default=0,
    )
    kind = np.float64 if values.shape[1] * 4 * most * most < 1 << 53 else object
    return values.astype(kind), entries.astype(kind)


def nearest(values: np.ndarray, entries: np.ndarray):
    """Nearest entry of each row and its squared distance.

    ``values`` are distinct and in lexicographic order: the leaves of a trie in
    depth-first order. A node is an interval of rows and the dimensions they
    share; ``sums`` holds its squared distance to every entry.
    """
    values, entries = _numbers(values, entries)
    count, dims = values.shape
    index = np.zeros(count, dtype=np.int64)
    distance = np.zeros(count, dtype=values.dtype)
    # Leaves by the depth at which they part from all others.
    waiting: dict[int, list] = {}

    def settle(depth: int) -> None:
        rows = np.concatenate([r for r, _ in waiting[depth]])
        sums = np.repeat(
            np.stack([s for _, s in waiting[depth]]),
            [len(r) for r, _ in waiting.pop(depth)],
            axis=0,
        )
        rest, ends = values[rows, depth:], entries[:, depth:]
        if dims > depth:
            sums = sums + (rest * rest).sum(axis=1)[:, None]
            sums = sums - 2 * (rest @ ends.T) + (ends * ends).sum(axis=1)
        best = sums.argmin(axis=1)
        index[rows] = best
        distance[rows] = sums[np.arange(len(rows)), best]

    def leaves(rows: np.ndarray, depth: int, sums: np.ndarray) -> None:
        held = waiting.setdefault(depth, [])
        held.append((rows, sums))
        if sum(len(r) for r, _ in held) >= LEAVES:
            settle(depth)

    nodes = [(0, count, 0, np.zeros(len(entries), dtype=values.dtype))]
    while nodes:
        low, high, depth, sums = nodes.pop()
        if high - low == 1:
            leaves(np.array([low]), depth, sums)
            continue
        # Sorted, so the rows share a value if the first and the last do.
        while values[low, depth] == values[high - 1, depth]:
            sums = sums + (values[low, depth] - entries[:, depth]) ** 2
            depth += 1
        at = values[low:high, depth]
        edges = np.flatnonzero(at[1:] != at[:-1]) + low + 1
        begins, ends = np.append(low, edges), np.append(edges, high)
        alone = ends - begins == 1
        for some in np.array_split(begins[alone], -(-int(alone.sum()) // LEAVES) or 1):
            if len(some):
                leaves(some, depth, sums)
        for a, b in zip(begins[~alone][::-1].tolist(), ends[~alone][::-1].tolist()):
            nodes.append((a, b, depth, sums))
    for depth in list(waiting):
        settle(depth)
    return index, distance


def with_integers(vectors: DataFrame, vector: str, scale: int, keep: list) -> DataFrame:
    """Usable rows with their components as integers ``x`` and their ``size``."""
    good = vectors.filter(finite(vector))
    return good.select(
        *keep, floored(vector, scale).alias("x"), F.size(vector).alias("size")
    )


def distinct_parts(rows: DataFrame, parts: int) -> DataFrame:
    """``size, p, part, many``: each distinct part once, sorted and in ranges."""
    pieces = []
    for p in range(parts):
        begin, end = (F.floor(F.col("size") * q / parts) for q in (p, p + 1))
        piece = F.slice("x", (begin + 1).cast("int"), (end - begin).cast("int"))
        pieces.append(F.struct(F.lit(p).alias("p"), piece.alias("part")))
    order = ["size", "p", "part"]
    counted = (
        rows.select("size", F.explode(F.array(*pieces)).alias("piece"))
        .groupBy("size", "piece.p", "piece.part")
        .agg(F.count(F.lit(1)).alias("many"))
    )
    return cut(counted.repartitionByRange(*order).sortWithinPartitions(*order))


def first_entries(rows: DataFrame, row_id: str, parts: int, entries: int) -> dict:
    """The parts of the rows with the least ids, by ``(size, p)``."""
    order = Window.partitionBy("size").orderBy(F.col(row_id).asc_nulls_last(), "x")
    first = (
        rows.select("size", row_id, "x")
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= entries)
        .select("size", "place", "x")
        .collect()
    )
    books: dict = {}
    for row in sorted(first, key=lambda r: (r.size, r.place)):
        for p, (begin, end) in enumerate(borders(row.size, parts)):
            books.setdefault((row.size, p), []).append(row.x[begin:end])
    return {
        (size, p): np.array(book, dtype=object).reshape(len(book), -1)
        for (size, p), book in books.items()
    }


def _lists(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def entry_sums(counted: DataFrame, books: dict) -> DataFrame:
    """Per task and entry: how many parts are nearest to it, and their sums."""

    def run(batches):
        totals: dict = {}
        for batch in batches:
            size = batch.column("size").to_numpy()
            p = batch.column("p").to_numpy()
            edges = np.flatnonzero((size[1:] != size[:-1]) | (p[1:] != p[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(size)]):
                if a == b:
                    continue
                key = int(size[a]), int(p[a])
                book = books[key]
                part = batch.column("part").slice(a, b - a)
                values = _lists(part, book.shape[1])
                many = batch.column("many").slice(a, b - a).to_numpy()
                index, _ = nearest(values, book)
                number, sums = totals.setdefault(
                    key, (np.zeros(len(book), object), np.zeros(book.shape, object))
                )
                order = np.argsort(index, kind="stable")
                used, starts = np.unique(index[order], return_index=True)
                number[used] += np.add.reduceat(many[order], starts)
                most = int(np.abs(values.astype(np.float64)).max(initial=0))
                kind = np.int64 if most * int(many.sum()) < 1 << 62 else object
                weighted = values.astype(kind) * many.astype(kind)[:, None]
                if book.shape[1]:
                    sums[used] += np.add.reduceat(weighted[order], starts, axis=0)
        rows = [
            (size, p, k, int(number[k]), [str(v) for v in sums[k]])
            for (size, p), (number, sums) in totals.items()
            for k in np.flatnonzero(number).tolist()
        ]
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
            names = ["size", "p", "entry", "many", "sums"]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "size int, p int, entry int, many bigint, sums array<string>"
    return counted.mapInArrow(run, schema)


def moved(books: dict, counted: DataFrame) -> dict:
    """Every entry becomes the mean of its parts, rounded down; unused ones stay."""
    width = max((book.shape[1] for book in books.values()), default=0)
    sums = [
        F.sum(F.get("sums", F.lit(d)).cast("decimal(38,0)")).alias(f"sum_{d}")
        for d in range(width)
    ]
    found = (
        entry_sums(counted, books)
        .groupBy("size", "p", "entry")
        .agg(F.sum("many").alias("many"), *sums)
        .collect()
    )
    books = {key: book.copy() for key, book in books.items()}
    for row in found:
        book = books[row.size, row.p]
        for d in range(book.shape[1]):
            book[row.entry, d] = int(row[f"sum_{d}"]) // row.many
    return books


def codebooks(
    rows: DataFrame,
    row_id: str,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> dict:
    """Entries by ``(size, p)`` after all rounds."""
    books = first_entries(rows, row_id, parts, entries)
    counted = distinct_parts(rows, parts)
    for _ in range(rounds):
        books = moved(books, counted)
    return books


def digests(books: dict) -> dict[int, str]:
    """SHA-256 of the entries of each vector length, in order."""
    texts: dict[int, list] = {}
    for (size, p), book in sorted(books.items(), key=lambda item: item[0]):
        texts.setdefault(size, []).extend(str(v) for v in book.ravel())
    return {
        size: hashlib.sha256(",".join(text).encode()).hexdigest()
        for size, text in texts.items()
    }


def encode(rows: DataFrame, books: dict, keep: list[str], parts: int = PARTS) -> DataFrame:
    """``keep``, ``code``, ``error`` and ``codebooks_sha256`` of each row."""
    known = digests(books)

    def run(batches):
        for batch in batches:
            code = np.zeros((batch.num_rows, parts), dtype=np.int64)
            error = np.zeros(batch.num_rows, dtype=object)
            digest = np.zeros(batch.num_rows, dtype=object)
            for size, at, values in rows_by_size(batch, "x"):
                digest[at] = known[size]
                for p, (begin, end) in enumerate(borders(size, parts)):
                    leaf, of = np.unique(
                        values[:, begin:end], axis=0, return_inverse=True
                    ) if end > begin else (values[:1, :0], np.zeros(len(at), np.int64))
                    index, distance = nearest(leaf, books[size, p])
                    code[at, p] = index[of.ravel()]
                    error[at] += np.array([int(d) for d in distance], object)[of.ravel()]
            text = ["".join(f"{k:02x}" for k in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in keep],
                    pa.array(text, pa.string()),
                    pa.array([e if e < LONG else None for e in error], pa.int64()),
                    pa.array(digest.tolist(), pa.string()),
                ],
                names=[*keep, "code", "error", "codebooks_sha256"],
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    schema = f"{kept}, code string, error bigint, codebooks_sha256 string"
    return rows.select(*keep, "x").mapInArrow(run, schema)


def compress(
    vectors: DataFrame,
    row_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """``row_id, code, error, label_error, codebooks_sha256`` of each usable row.

    ``label_error`` is the sum over rows of an equal label; NULL ones are equal.
    """
    rows = with_integers(vectors, vector, scale, [row_id, label])
    books = codebooks(rows, row_id, parts, entries, rounds)
    coded = cut(encode(rows, books, [row_id, label], parts))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    # A sum with an unknown part is unknown.
    known = F.when(F.count("error") == F.count(F.lit(1)), total).try_cast("bigint")
    sums = coded.groupBy(F.col(label).alias("__label")).agg(known.alias("label_error"))
    sums = F.broadcast(sums) if small(sums, BROADCAST_LABELS) else sums
    return coded.join(sums, F.col(label).eqNullSafe(F.col("__label")), "left").select(
        row_id, "code", "error", "label_error", "codebooks_sha256"
    )


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same with every part against every entry, for small tables."""
    steps = [
        f"""
kept AS (
    SELECT vec_id, label, list_transform(embedding,
        lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE list_count(embedding) = len(embedding)
      AND len(list_filter(embedding, lambda c: NOT isfinite(c))) = 0),
parts AS (
    SELECT vec_id, p, x[p * len(x) // {parts} + 1:(p + 1) * len(x) // {parts}] AS part
    FROM kept, range({parts}) t(p)),
leaves AS (SELECT p, part, CAST(part AS DOUBLE[]) AS v, count(*) AS many FROM parts GROUP BY p, part),
book0 AS (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS entry, part AS e
    FROM parts QUALIFY entry < {entries})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""
near{r} AS MATERIALIZED (
    SELECT p, part, any_value(many) AS many, min(struct_pack(d := d, entry := entry)) AS best FROM (
        SELECT l.p, part, many, entry, CAST(list_inner_product(v, v)
            - 2 * list_inner_product(v, CAST(e AS DOUBLE[]))
            + list_inner_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[])) AS BIGINT) AS d
        FROM leaves l JOIN book{r} b ON l.p = b.p)
    GROUP BY p, part)"""
        )
        if r < rounds:
            steps.append(
                f"""
mean{r} AS (
    SELECT p, entry, list(m ORDER BY i) AS e FROM (
        SELECT p, best.entry AS entry, i,
            (sum(part[i] * many) - ((sum(part[i] * many) % sum(many)) + sum(many)) % sum(many)) // sum(many) AS m
        FROM near{r}, range(1, len(part) + 1) t(i) GROUP BY p, best.entry, i)
    GROUP BY p, entry),
book{r + 1} AS MATERIALIZED (
    SELECT p, entry, coalesce(m.e, b.e) AS e FROM book{r} b LEFT JOIN mean{r} m USING (p, entry))"""
            )
    return f"""
WITH {",".join(steps)},
coded AS (
    SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY p) AS code,
        CAST(sum(best.d) AS BIGINT) AS error
    FROM parts JOIN near{rounds} USING (p, part) GROUP BY vec_id),
digest AS (
    SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, entry)) AS codebooks_sha256
    FROM book{rounds})
SELECT vec_id, code, error,
    CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest
"""
