"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are rotated to their principal dimensions and sorted by the cells
of a grid of width epsilon on the leading ones (two unit vectors of cosine c
lie sqrt(2 - 2c) apart, so partners are in the same or adjoining cells of every
dimension). The sequence is dealt into blocks; blocks whose boxes are further
apart than epsilon are skipped, and inside a task two intervals are joined by
halving the longer one until they are provably distant or small, when their
cosines are computed in double precision.

Equal vectors are joined as one with their number. A task returns the links of
each vector as a sum and a spanning forest of the links it found, never the
pairs, so a large group costs its members and not their square.

Defined results: a vector that is NULL, empty, zero or holds a NULL or
non-finite component links with nothing; vectors of different lengths do not
link; repeated rows (same id, same vector) link as copies; an empty table gives
no rows; extra columns are ignored. The rotation is fitted on at most
``FIT_ROWS`` vectors; it decides only which blocks can be skipped.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pagelens.llm.components import components
from pagelens.operators.shared import cut

COSINE = 0.95
FIT_ROWS = 4096
GRID_DIMS = 3
BLOCK_ROWS = 8192
LEAF_ROWS = 512


def usable(vector: str = "embedding"):
    v = F.col(vector)

    def plain(x):
        d = x.cast("double")
        return x.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(math.inf))

    return F.coalesce(
        F.forall(v, plain) & F.exists(v, lambda x: x != 0), F.lit(False)
    )


def unit(vectors: list) -> np.ndarray:
    """Rows scaled to length one; scaled first so that squares stay finite."""
    x = np.array(vectors, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_rotations(distinct: DataFrame, rows: int = FIT_ROWS) -> dict[int, np.ndarray]:
    """Principal directions for each vector length in a bounded sample."""
    sample = (
        distinct.select("embedding")
        .orderBy(F.xxhash64("embedding"))
        .limit(rows)
        .collect()
    )
    by_size: dict[int, list] = {}
    for (vector,) in sample:
        by_size.setdefault(len(vector), []).append(vector)
    rotations = {}
    for size, vectors in by_size.items():
        x = unit(vectors)
        _, axes = np.linalg.eigh((x - x.mean(0)).T @ (x - x.mean(0)))
        rotations[size] = axes[:, ::-1]
    return rotations


def _rotate(x: np.ndarray, rotations: dict) -> np.ndarray:
    axes = rotations.get(x.shape[1])
    return x if axes is None else x @ axes


def keyed(distinct: DataFrame, rotations: dict, width: float, dims: int) -> DataFrame:
    """Adds the grid cells on the leading dimensions and a place inside."""
    names = [f"c{i}" for i in range(dims)]

    def run(batches):
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("embedding")).to_pylist()
            cells = np.zeros((len(vectors), dims), dtype=np.int32)
            place = np.zeros(len(vectors))
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                y = _rotate(unit([vectors[i] for i in at]), rotations)
                k = min(dims, y.shape[1])
                cells[at, :k] = np.floor(y[:, :k] / width)
                place[at] = y[:, min(k, y.shape[1] - 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(sizes.astype(np.int32)),
                    *[pa.array(cells[:, i]) for i in range(dims)],
                    pa.array(place),
                ],
                names=[*batch.schema.names, "size", *names, "place"],
            )

    added = [T.StructField(n, T.IntegerType()) for n in ["size", *names]]
    schema = [*distinct.schema.fields, *added, T.StructField("place", T.DoubleType())]
    return distinct.mapInArrow(run, T.StructType(schema))


def boxes(blocks: DataFrame, rotations: dict) -> DataFrame:
    """Bounding box of each block in rotated dimensions, per vector length."""

    def run(key, part):
        y = _rotate(unit(part.column("embedding").to_pylist()), rotations)
        return pa.table(
            {
                "block": pa.array([key[0].as_py()], pa.int32()),
                "size": pa.array([key[1].as_py()], pa.int32()),
                "lo": pa.array([y.min(0).tolist()], pa.list_(pa.float64())),
                "hi": pa.array([y.max(0).tolist()], pa.list_(pa.float64())),
            }
        )

    schema = "block int, size int, lo array<double>, hi array<double>"
    return blocks.groupBy("block", "size").applyInArrow(run, schema)


def near_blocks(box: DataFrame, width: float) -> DataFrame:
    """Pairs of blocks whose boxes are at most ``width`` apart.

    Blocks meet on cells of the first dimension, where the sequence is sorted
    and boxes are narrow; the distance of the whole boxes decides.
    """

    def cells(side: str, reach: int):
        first = F.floor(F.element_at("lo", 1) / width).cast("int") - reach
        last = F.floor(F.element_at("hi", 1) / width).cast("int") + reach
        return box.select(
            F.col("block").alias(side),
            F.col("size"),
            F.col("lo").alias(f"lo_{side}"),
            F.col("hi").alias(f"hi_{side}"),
            F.explode(F.sequence(first, last)).alias("cell"),
        )

    apart = F.zip_with(
        F.zip_with("lo_a", "hi_b", lambda x, y: x - y),
        F.zip_with("lo_b", "hi_a", lambda x, y: x - y),
        lambda p, q: F.greatest(p, q, F.lit(0.0)),
    )
    distance = F.aggregate(apart, F.lit(0.0), lambda s, d: s + d * d)
    met = cells("a", 0).join(cells("b", 1), ["size", "cell"]).filter("a <= b")
    return (
        met.filter(distance <= width * width * (1 + 1e-9))
        .select("size", "a", "b")
        .distinct()
    )


class _Joiner:
    """Joins two sorted intervals; keeps link sums and a forest."""

    def __init__(self, cosine, x, y, many, width):
        self.cosine, self.x, self.y, self.many = cosine, x, y, many
        self.reach = width * width * (1 + 1e-9)
        self.links = np.zeros(len(x), dtype=np.int64)
        self.parent = np.arange(len(x))
        self.forest: list[tuple[int, int]] = []
        self._boxes: dict = {}

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def box(self, a, b):
        found = self._boxes.get((a, b))
        if found is None:
            part = self.y[a:b]
            found = self._boxes[a, b] = part.min(0), part.max(0)
        return found

    def distant(self, a, b, c, d) -> bool:
        (lo, hi), (low, high) = self.box(a, b), self.box(c, d)
        gap = np.maximum(np.maximum(lo - high, low - hi), 0)
        return float(gap @ gap) > self.reach

    def join(self, a, b, c, d):
        same = (a, b) == (c, d)
        if a >= b or c >= d or (not same and self.distant(a, b, c, d)):
            return
        if b - a <= LEAF_ROWS and d - c <= LEAF_ROWS:
            self.leaf(a, b, c, d, same)
        elif same:
            m = (a + b) // 2
            self.join(a, m, a, m)
            self.join(a, m, m, b)
            self.join(m, b, m, b)
        elif b - a >= d - c:
            m = (a + b) // 2
            self.join(a, m, c, d)
            self.join(m, b, c, d)
        else:
            m = (c + d) // 2
            self.join(a, b, c, m)
            self.join(a, b, m, d)

    def leaf(self, a, b, c, d, same):
        near = self.x[a:b] @ self.x[c:d].T >= self.cosine
        if same:
            np.fill_diagonal(near, False)
        if not near.any():
            return
        self.links[a:b] += near @ self.many[c:d]
        if not same:
            self.links[c:d] += self.many[a:b] @ near
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            mine = self.root(a + i)
            for j in (np.flatnonzero(near[i]) + c).tolist():
                other = self.root(j)
                if other != mine:
                    self.forest.append((a + i, j))
                    self.parent[max(mine, other)] = mine = min(mine, other)


def joined(placed: DataFrame, pairs: DataFrame, rotations, cosine, width) -> DataFrame:
    """Link sums ``(rep, links)`` and forest rows ``(rep, peer)`` of all pairs."""
    sides = pairs.select(
        "size", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block")
    )
    shipped = sides.join(placed, ["size", "block"]).select(
        "size", "a", "b", "block", "rep", "many", "place", "embedding",
        *[c for c in placed.columns if c.startswith("c") and c[1:].isdigit()],
    )

    def run(key, part):
        order = [(n, "ascending") for n in part.column_names if n[0] == "c"]
        part = part.sort_by([("block", "ascending"), *order, ("place", "ascending")])
        x = unit(part.column("embedding").to_pylist())
        reps = part.column("rep").to_numpy()
        many = part.column("many").to_numpy()
        block = part.column("block").to_numpy()
        a, b = key[1].as_py(), key[2].as_py()
        work = _Joiner(cosine, x, _rotate(x, rotations), many, width)
        edge = int((block == a).sum())
        if a == b:
            work.join(0, edge, 0, edge)
        else:
            work.join(0, edge, edge, len(x))
        hit = np.flatnonzero(work.links)
        forest = np.array(work.forest, dtype=np.int64).reshape(-1, 2)
        return pa.table(
            {
                "rep": pa.array(np.concatenate([reps[hit], reps[forest[:, 0]]])),
                "links": pa.array(
                    np.concatenate([work.links[hit], np.zeros(len(forest), np.int64)])
                ),
                "peer": pa.array(
                    [None] * len(hit) + reps[forest[:, 1]].tolist(), pa.int64()
                ),
            }
        )

    schema = "rep bigint, links bigint, peer bigint"
    return shipped.groupBy("size", "a", "b").applyInArrow(run, schema)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding")
    good = rows.filter(usable())
    distinct = cut(
        good.groupBy("embedding").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many")
        )
    )
    width = math.sqrt(max(2 - 2 * cosine, 1e-12))
    rotations = fit_rotations(distinct)
    cells = [f"c{i}" for i in range(GRID_DIMS)]
    count = max(1, -(-distinct.count() // BLOCK_ROWS))
    placed = cut(
        keyed(distinct, rotations, width, GRID_DIMS)
        .repartitionByRange(count, "size", *cells, "place", "rep")
        .withColumn("block", F.spark_partition_id())
    )
    pairs = near_blocks(boxes(placed, rotations), width)
    found = cut(joined(placed, pairs, rotations, cosine, width))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    forest = found.filter(F.col("peer").isNotNull()).select(
        F.col("rep").alias("a"), F.col("peer").alias("b")
    )
    roots = components(forest, forest.count()).withColumnRenamed("id", "rep")
    of_rep = (
        distinct.join(links, "rep", "left")
        .join(roots, "rep", "left")
        .select(
            "embedding",
            (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"),
            F.coalesce("root", "rep").alias("component_id"),
        )
    )
    linked = good.join(of_rep, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )


def near_sql(cosine: float = COSINE) -> str:
    """The same by comparing all pairs, for small tables."""
    return f"""
WITH RECURSIVE good AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE list_count(embedding) = len(embedding)
      AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
        ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= {cosine!r}::DOUBLE),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
found AS (
    SELECT v.vec_id, (SELECT count(*) FROM link WHERE a = v.vec_id) AS n_links,
        least(v.vec_id, coalesce((SELECT min(b) FROM reach WHERE a = v.vec_id), v.vec_id)) AS component_id
    FROM embeddings v)
SELECT *, vec_id = component_id AS kept FROM found
"""
