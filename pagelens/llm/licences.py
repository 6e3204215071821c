"""Licence families of paragraphs by sparse word n-gram logistic regression.

The model is trained on short notices of each family and on sentences that only
sound like one (``licence_texts``), as a multinomial regression over word
n-grams of one to four words. Every feature holds an anchor word, so a
paragraph without one scores the bias alone, which says unknown: such
paragraphs need not be scored. Probabilities are calibrated by a temperature on
sentences that training has not seen, about the families and about other things,
and a family must pass a threshold set between the two. A prediction stands only
if a notice of that family, or one of its names, shares enough word pairs with
the paragraph.

Training sees the fixed notices only. Scoring is DataFrame functions: n-grams of
anchored paragraphs meet the weights and the notices in joins whose small sides
have as many rows as the notices have n-grams.

A paragraph is a line; one that ends without a stop goes on in the next line if
that begins with a small letter or a bracket, and comment marks before a line
are no part of it. A paragraph has one family, the most probable. Defined
results: NULL or empty text and text without a
licence give ``none`` with probability 0; several families in a text are all
listed, by name, and ``licence`` is the most probable one (ties by name);
repeated rows are scored alike; an empty table gives no rows; all other columns
are kept (columns beginning with ``__lic`` are used inside).
"""

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from pagelens.llm.licence_texts import ANCHORS, CALLED, HELD_OTHER, NOTICES, OTHER, SAID
from pagelens.operators.shared import cut

GRAMS = 4
# Least share of the smaller side's word pairs in common with a notice.
CONFIRM = 0.6
NONE = "none"
# Comment marks before a line, and line ends inside a sentence.
_MARKS = r"(?m)^[ \t]*+(?:[#*;%]++|//++|--++)[ \t]?"
_WRAPPED = r"(?<![.!?:;\s])[ \t\r]*+\n[ \t]*+(?=[a-z(])"
_ANCHORED = rf"(?i)(?<![A-Za-z0-9])(?:{'|'.join(ANCHORS)})(?![A-Za-z0-9])"


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def grams_of(words: list[str]) -> set[str]:
    """N-grams with an anchor."""
    anchors = set(ANCHORS)
    return {
        " ".join(part)
        for n in range(1, GRAMS + 1)
        for part in (words[i : i + n] for i in range(len(words) - n + 1))
        if anchors.intersection(part)
    }


@dataclass
class Model:
    families: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    threshold: float


def templates() -> dict[str, list[str]]:
    """Texts that confirm a family: its notices and its names."""
    return {family: [*NOTICES[family], *CALLED[family]] for family in NOTICES}


def _altered(words: list[str]) -> list[list[str]]:
    """Variants of a notice: an end cut off, other words around it."""
    out = [words[1:], words[:-1], ["the", "files", *words, "see", "below"]]
    return [v for v in out if grams_of(v)]


def _scores(model_w, model_b, rows):
    return np.array([model_b + sum(model_w[f] for f in row) for row in rows])


def _softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@cache
def trained(rounds: int = 400, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """Full-batch gradient descent; deterministic."""
    families = sorted(NOTICES)
    unknown = len(families)
    samples, target = [], []
    for k, family in enumerate(families):
        for notice in NOTICES[family]:
            words = words_of(notice)
            for variant in (words, *_altered(words)[:1]):
                samples.append(grams_of(variant))
                target.append(k)
    for sentence in OTHER:
        samples.append(grams_of(words_of(sentence)))
        target.append(unknown)
    names = sorted(set().union(*samples))
    at = {name: i for i, name in enumerate(names)}
    x = np.zeros((len(samples), len(names)))
    for i, row in enumerate(samples):
        x[i, [at[f] for f in row]] = 1
    y = np.eye(unknown + 1)[target]
    w, b = np.zeros((len(names), unknown + 1)), np.zeros(unknown + 1)
    # Nothing known speaks for no family.
    b[unknown] = 2.0
    share = y / y.sum(axis=0)[None, :]
    balance = share.sum(axis=1)[:, None] * len(samples) / (unknown + 1)
    for _ in range(rounds):
        gap = (_softmax(x @ w + b) - y) * balance
        w -= rate * (x.T @ gap / len(samples) + decay * w)
    held = [
        (grams_of(words_of(said.format(name))), k)
        for k, family in enumerate(families)
        for name in CALLED[family]
        for said in SAID
    ]
    other = [grams_of(words_of(s)) for s in HELD_OTHER]
    weight = {name: w[i] for name, i in at.items()}

    def rows(features):
        return [[f for f in row if f in weight] for row in features]

    z = _scores(weight, b, rows([f for f, _ in held] + other))
    truth = np.array([k for _, k in held] + [unknown] * len(other))
    # Temperature: the scale with the least log loss on texts not seen.
    loss = {
        t: -np.log(_softmax(z / t)[np.arange(len(z)), truth] + 1e-12).mean()
        for t in np.linspace(0.25, 3, 56)
    }
    heat = min(loss, key=loss.get)
    p = _softmax(z / heat)
    right = p[np.arange(len(held)), truth[: len(held)]]
    wrong = p[len(held) :, :unknown].max(axis=1)
    middle = (np.quantile(right, 0.02) + wrong.max()) / 2
    threshold = float(np.clip(max(middle, wrong.max()), 0.3, 0.8))
    return Model(
        families,
        {n: (v / heat).tolist() for n, v in weight.items()},
        (b / heat).tolist(),
        threshold,
    )


def paragraphs(text: str) -> Column:
    """Lines of a text, wrapped ones put together."""
    bare = F.regexp_replace(text, _MARKS, "")
    return F.split(F.regexp_replace(bare, _WRAPPED, " "), "\n")


def _grams(words, n: int):
    last = F.size(words) - (n - 1)
    return F.when(
        last > 0,
        F.transform(
            F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, n), " ")
        ),
    ).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """Adds ``licence``, ``licences``, ``n_licences`` and ``probability``.

    Columns of those names are replaced.
    """
    spark, model = docs.sparkSession, trained()
    docs = docs.drop("licence", "licences", "n_licences", "probability")
    columns = docs.columns
    none = (
        F.lit(NONE).alias("licence"),
        F.array().cast("array<string>").alias("licences"),
        F.lit(0).cast("long").alias("n_licences"),
        F.lit(0.0).alias("probability"),
    )
    anchored = F.coalesce(F.col("text").rlike(_ANCHORED), F.lit(False))
    held = cut(
        docs.filter(anchored).withColumn("__lic_row", F.monotonically_increasing_id())
    )
    lines = (
        held.select("__lic_row", F.posexplode(paragraphs("text")).alias("at", "line"))
        .filter(F.col("line").rlike(_ANCHORED))
        .withColumn("words", F.regexp_extract_all(F.lower("line"), F.lit("([a-z0-9]+)")))
        .select("__lic_row", "at", "words")
    )
    weights = spark.createDataFrame(
        list(model.weights.items()), "gram string, w array<double>"
    )
    grams = lines.select(
        "__lic_row",
        "at",
        F.explode(
            F.array_distinct(
                F.concat(*[_grams(F.col("words"), n) for n in range(1, GRAMS + 1)])
            )
        ).alias("gram"),
    )
    scored = (
        grams.join(F.broadcast(weights), "gram")
        .groupBy("__lic_row", "at")
        .agg(*[F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(model.bias))])
    )
    logits = F.array(*[F.col(f"s{k}") + model.bias[k] for k in range(len(model.bias))])
    best = F.array_max(logits)
    parts = F.aggregate(logits, F.lit(0.0), lambda s, v: s + F.exp(v - F.col("top")))
    names = F.array(*[F.lit(f) for f in model.families], F.lit(NONE))
    predicted = (
        scored.withColumn("top", best)
        .select(
            "__lic_row",
            "at",
            F.get(names, (F.array_position(logits, F.col("top")) - 1).cast("int")).alias("family"),
            (1 / parts).alias("p"),
        )
        .filter((F.col("family") != NONE) & (F.col("p") >= model.threshold))
    )
    pairs_of = [
        (family, f"{family}/{i}", pair, len(pairs))
        for family, notices in templates().items()
        for i, notice in enumerate(notices)
        for words in [words_of(notice)]
        for pairs in [sorted({" ".join(p) for p in zip(words, words[1:])})]
        for pair in pairs
    ]
    notices = spark.createDataFrame(
        pairs_of, "family string, notice string, pair string, size int"
    )
    pairs = lines.join(predicted, ["__lic_row", "at"]).select(
        "__lic_row", "at", "family", "p", F.array_distinct(_grams(F.col("words"), 2)).alias("pairs")
    )
    confirmed = (
        pairs.select(
            "__lic_row", "at", "family", "p", F.size("pairs").alias("own"), F.explode("pairs").alias("pair")
        )
        .join(F.broadcast(notices), ["family", "pair"])
        .groupBy("__lic_row", "at", "family", "p", "own", "notice", "size")
        .agg(F.count(F.lit(1)).alias("common"))
        .filter(F.col("common") >= CONFIRM * F.least("own", "size"))
        .select("__lic_row", "at", "family", "p")
        .distinct()
    )
    found = confirmed.groupBy("__lic_row").agg(
        F.min(F.struct((-F.col("p")).alias("p"), "family")).alias("first"),
        F.sort_array(F.collect_set("family")).alias("licences"),
        F.count(F.lit(1)).alias("n_licences"),
    )
    hit = held.join(found, "__lic_row", "left").select(
        *columns,
        F.coalesce("first.family", F.lit(NONE)).alias("licence"),
        F.coalesce("licences", none[1]).alias("licences"),
        F.coalesce("n_licences", F.lit(0).cast("long")).alias("n_licences"),
        F.round(F.coalesce(-F.col("first.p"), F.lit(0.0)), 6).alias("probability"),
    )
    return docs.filter(~anchored).select(*columns, *none).unionByName(hit)
