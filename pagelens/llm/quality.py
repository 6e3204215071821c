"""Quality of whole texts by supervised subword embeddings.

Every white-space word and every run of ``MIN_GRAM`` to ``MAX_GRAM`` characters
of it, with its borders marked, has a learned vector found by a hash; so has,
for each distance up to ``REACH``, a word's being the one so many words before.
A text is the mean of all these vectors (and of one end mark's, so that no text
is empty); a softmax over the classes follows. Both layers are trained
by minibatch stochastic gradient descent in numpy, with a falling rate and a
fixed seed.

The fit, the only bounded step, takes the labelled texts with the least hash of
their text: at most ``SAMPLE_ROWS`` of them and at most ``SAMPLE_UNITS``
different words and runs in all, counted text by text. Equal texts count once,
with the label that most of their rows have (ties: the greatest). Their hashes
and numbers, not their texts, go to the driver. Scoring reads all of every
text.

As both layers are linear, a word's part in the score is one number for each
class; a task finds it once for each different word of a slice of texts.

Defined results: a NULL text counts as an empty one; labels other than the
classes, and labels of rows that are not there, teach nothing; without any
labelled text every score is 0.5; texts with equal words have equal scores;
repeated rows are each given their result; an empty table gives no rows; extra
columns are kept.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pagelens.operators.shared import cut

BUCKETS = 1 << 17
DIMS = 16
MIN_GRAM, MAX_GRAM = 3, 5
SAMPLE_ROWS = 6_000
SAMPLE_UNITS = 6_000_000
EPOCHS = 6
BATCH_TEXTS = 16
RATE = 2.0
SEED = 20_240_613
# Characters of text whose words are looked at together.
SLICE_CHARS = 2_000_000
# Words looked at together when their runs are hashed.
SLICE_WORDS = 50_000
END = 0
# Buckets 1 to REACH: a word that stood so many words before.
REACH = 3


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over the buckets behind those of the marks."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return (h % np.uint64(BUCKETS - 1 - REACH)).astype(np.int32) + 1 + REACH


def units(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and its runs, and the number of them by word.

    The words stand side by side in one array of code points, each between two
    marks (lone surrogates are code points like others); a polynomial over a
    window is a run's hash.
    """
    text = "\x02" + "\x03\x02".join(words) + "\x03"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points.astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    base = np.uint64(0x9E3779B97F4A7C15)
    # The whole word: powers count from its own start, so place does not matter.
    owner = np.repeat(np.arange(len(words)), sizes)
    inside = np.arange(len(points)) - (ends - sizes)[owner]
    powers = np.cumprod(np.full(int(sizes.max(initial=1)), base, np.uint64))
    whole = np.add.reduceat(points * powers[inside], ends - sizes)
    found, owners = [_mix(whole)], [np.arange(len(words))]
    left = ends[owner] - np.arange(len(points))
    h = np.zeros(len(points), np.uint64)
    for n in range(1, MAX_GRAM + 1):
        h[: len(points) - n + 1] += points[n - 1 :] * powers[n - 1] if n <= len(powers) else 0
        if n >= MIN_GRAM:
            # The whole word with its marks has been counted.
            at = np.flatnonzero((left >= n) & (sizes[owner] > n))
            found.append(_mix(h[at] * np.uint64(2 * n + 1)))
            owners.append(owner[at])
    found, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return found[order], np.bincount(owners, minlength=len(words))


def _repeats(ids: np.ndarray) -> list[int]:
    """How many words equal the one 1, 2, ... words before."""
    return [int((ids[d:] == ids[:-d]).sum()) for d in range(1, REACH + 1)]


def text_units(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Different buckets of a text and their shares in it."""
    place: dict[str, int] = {}
    ids = [place.setdefault(w, len(place)) for w in (text or "").split()]
    ids = np.array(ids, dtype=np.int64)
    names = list(place)
    often = np.bincount(ids, minlength=len(names))
    found = [np.arange(1 + REACH, dtype=np.int32)]
    weights = [np.array([1, *_repeats(ids)])]
    for begin in range(0, len(names), SLICE_WORDS):
        some, many = units(names[begin : begin + SLICE_WORDS])
        found.append(some)
        weights.append(np.repeat(often[begin : begin + len(many)], many))
    used, of = np.unique(np.concatenate(found), return_inverse=True)
    total = np.bincount(of, np.concatenate(weights))
    return used[total > 0], total[total > 0] / total.sum()


def labelled_texts(
    docs: DataFrame, labels: DataFrame, classes: int = 2, rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``doc_id, class``: one row for each text of the sample.

    ``labels`` has ``doc_id`` and ``class``. The joins carry ids and hashes.
    """
    votes = labels.filter(F.col("class").between(0, classes - 1))
    named = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("name"))
    by_class = [
        F.count_if(F.col("class") == c).cast("long").alias(f"n_{c}") for c in range(classes)
    ]
    each = (
        named.join(votes.select("doc_id", F.col("class").cast("int")), "doc_id")
        .groupBy("name")
        .agg(F.min("doc_id").alias("doc_id"), *by_class)
    )
    most = F.greatest(*[F.struct(F.col(f"n_{c}").alias("n"), F.lit(c).alias("class")) for c in range(classes)])
    return each.orderBy("name").limit(rows).select("doc_id", "name", most["class"].alias("class"))


def training_texts(
    docs: DataFrame,
    labels: DataFrame,
    classes: int = 2,
    rows: int = SAMPLE_ROWS,
    most_units: int = SAMPLE_UNITS,
) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(class, buckets, shares)`` of each text of the sample."""
    sample = labelled_texts(docs, labels, classes, rows)
    named = docs.select(
        "doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("name")
    )
    chosen = named.join(F.broadcast(sample), ["doc_id", "name"]).dropDuplicates(["name"])

    def run(batches):
        for batch in batches:
            found = [text_units(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("name"),
                    batch.column("class"),
                    pa.array([b for b, _ in found], pa.list_(pa.int32())),
                    pa.array([s for _, s in found], pa.list_(pa.float64())),
                ],
                names=["name", "class", "units", "shares"],
            )

    schema = "name string, class int, units array<int>, shares array<double>"
    each = cut(chosen.select("name", "class", "text").mapInArrow(run, schema))
    # Names and sizes of at most ``rows`` texts: one task may add them up.
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, 0)
    held = each.select("name", F.size("units").alias("own")).select(
        "name", F.sum("own").over(before).alias("held")
    )
    within = F.broadcast(held.filter(F.col("held") <= most_units).select("name"))
    kept = each.join(within, "name", "left_semi").orderBy("name")
    table = kept.select("class", "units", "shares").toArrow()
    return [
        (c, u.values.to_numpy(), s.values.to_numpy())
        for c, u, s in zip(table["class"].to_pylist(), table["units"], table["shares"])
    ]


def train(
    texts: list,
    classes: int = 2,
    dims: int = DIMS,
    epochs: int = EPOCHS,
    rate: float = RATE,
    batch: int = BATCH_TEXTS,
    seed: int = SEED,
) -> np.ndarray:
    """Score of every bucket for every class: vectors times the softmax layer."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / dims, 1 / dims, (BUCKETS, dims))
    layer = np.zeros((classes, dims))
    if not texts:
        return vectors @ layer.T
    truth = np.array([c for c, _, _ in texts])
    steps = -(-len(texts) // batch) * epochs
    done = 0
    for _ in range(epochs):
        order = random.permutation(len(texts))
        for begin in range(0, len(order), batch):
            some = order[begin : begin + batch]
            found = [texts[i] for i in some]
            unit = np.concatenate([u for _, u, _ in found])
            share = np.concatenate([s for _, _, s in found])
            of = np.repeat(np.arange(len(some)), [len(u) for _, u, _ in found])
            used, place = np.unique(unit, return_inverse=True)
            mine = vectors[used]
            single = mine @ layer.T
            logits = np.stack(
                [np.bincount(of, share * single[place, c], len(some)) for c in range(classes)],
                axis=1,
            )
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), truth[some]] -= 1
            # The gradient of a text is its shares times its class errors.
            slope = np.stack(
                [np.bincount(place, share * p[of, c], len(used)) for c in range(classes)],
                axis=1,
            )
            step = rate * (1 - done / steps)
            gradient = slope @ layer
            layer -= step * (slope.T @ mine)
            vectors[used] = mine - step * gradient
            done += 1
    return vectors @ layer.T


def _word_parts(words: list[str], scores: np.ndarray):
    """Class scores and number of units of each word."""
    found, many = units(words)
    edges = np.cumsum(many) - many
    return np.add.reduceat(scores[found], edges, axis=0), many


def probabilities(texts: list, scores: np.ndarray) -> np.ndarray:
    """Class probabilities of whole texts."""
    logits = np.empty((len(texts), scores.shape[1]))
    begin = 0
    while begin < len(texts):
        end, held, split = begin, 0, []
        while end < len(texts) and held < SLICE_CHARS:
            held += len(texts[end] or "")
            split.append((texts[end] or "").split())
            end += 1
        place: dict[str, int] = {}
        ids = [
            np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
            for words in split
        ]
        parts, many = np.zeros((0, scores.shape[1])), np.zeros(0, np.int64)
        names = list(place)
        for at in range(0, len(names), SLICE_WORDS):
            p, m = _word_parts(names[at : at + SLICE_WORDS], scores)
            parts, many = np.concatenate([parts, p]), np.concatenate([many, m])
        for i, words in enumerate(ids):
            marks = np.array([1, *_repeats(words)])
            total = marks @ scores[: 1 + REACH] + parts[words].sum(axis=0)
            logits[begin + i] = total / (marks.sum() + many[words].sum())
        begin = end
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def score(
    docs: DataFrame, scores: np.ndarray, positive: int = 1, into: str = "score"
) -> DataFrame:
    """Adds the probability of the class ``positive``."""
    sent = docs.sparkSession.sparkContext.broadcast(scores.astype(np.float32))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(probabilities(texts.tolist(), sent.value)[:, positive])

    return docs.withColumn(into, scored("text"))
