"""I-Match fingerprints of whole texts, with randomised lexicon subsets.

Terms whose share of documents lies in a band make up the lexicon. A text keeps
its distinct terms of the lexicon, sorted; their hash is the classic
fingerprint. For robustness the kept terms are also hashed over ``SUBSETS``
random subsets of the lexicon at four rates, so that texts of any length have
subsets in which they keep a few terms; a change touches only the subsets that
hold a changed term. A term's subsets follow from its SHA-256.

Two fingerprints are as alike as the subsets in which they agree, each weighing
one over the square of the terms kept there (a subset of one term agrees as often
as the texts share terms, larger ones less); subsets empty on both sides say
nothing.

The lexicon's lower bound is a share of the documents, so it holds at most the
mean number of distinct terms a document divided by that share, however large
the corpus is; that is what the plan carries to the tasks.

Everything here is DataFrame functions. Defined results: NULL text counts as
empty; a text without a lexicon term keeps all its terms; one without any term
is hashed as it is; equal texts have equal fingerprints; rows are ordered by
doc_id descending, NULL last, equal ids by text; an empty table gives no rows;
extra columns are ignored.
"""

import hashlib
import json
import zlib

from pyspark.sql import Column, DataFrame, Window, functions as F

# Shares of documents: idf between log(20) and log(500).
BAND = (1 / 500, 1 / 20)
# Bytes of the classic hash and of each subset's.
HASH_CHARS = 8
# (first hex digit, digits, bound, subsets): a term is in a subset if those
# digits of its SHA-256 are below the bound; rates of 1/4, 1/16, 1/64, 1/256.
RATES = ((1, 1, "4", 12), (13, 1, "1", 12), (25, 2, "04", 16), (1, 2, "01", 8))
SUBSETS = tuple(
    (first + i * digits, digits, bound)
    for first, digits, bound, count in RATES
    for i in range(count)
)
# Hex digits read as one number; no subset's digits lie across two of them.
_CHUNK = 12
SEPARATORS = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
_BUCKETS = 1 << 16


def terms(text: Column) -> Column:
    """Distinct terms; a separator at an end leaves an empty string."""
    return F.array_distinct(F.split(F.lower(text), SEPARATORS))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> list[str]:
    """Terms in the band, counted over all documents."""
    low, high = band
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    total = texts.count()
    return [
        row[0]
        for row in texts.select(F.explode(terms(F.col("text"))).alias("term"))
        .filter("term <> ''")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .filter((F.col("df") >= total * low) & (F.col("df") <= total * high))
        .select("term")
        .collect()
    ]


def _places(word: str) -> int:
    """The subsets a word is in, one bit for each."""
    digest = hashlib.sha256(word.encode("utf-8")).hexdigest()
    return sum(
        1 << i
        for i, (first, digits, bound) in enumerate(SUBSETS)
        if digest[first - 1 : first - 1 + digits] < bound
    )


def _bucket_json(words: list[str]) -> str:
    """The lexicon as lists by bucket, so that a lookup reads one short list.

    Each word comes with its subsets, which need not be found for every text.
    """
    lists: list[list[dict]] = [[] for _ in range(_BUCKETS)]
    for word in words:
        lists[zlib.crc32(word.encode("utf-8")) % _BUCKETS].append(
            {"w": word, "m": _places(word)}
        )
    return json.dumps(lists, ensure_ascii=False)


_LISTS = "array<array<struct<w:string,m:bigint>>>"


def _listed(word: Column, lists: Column) -> Column:
    """``w, m`` of a word of the lexicon; null for any other."""
    bucket = F.get(lists, F.crc32(word.cast("binary")) % F.lit(_BUCKETS))
    return F.get(F.filter(bucket, lambda x: x["w"] == word), F.lit(0))


def _hashed(word: Column) -> Column:
    """``w, m`` of any word, from its own digest."""
    chunks = F.struct(
        word.alias("w"),
        *[
            F.conv(F.substring(F.sha2(word, 256), 1 + i * _CHUNK, _CHUNK), 16, 10)
            .cast("bigint")
            .alias(f"c{i}")
            for i in range(5)
        ],
    )

    def places(t):
        bits = F.lit(0).cast("bigint")
        for i, (first, digits, bound) in enumerate(SUBSETS):
            chunk, at = divmod(first - 1, _CHUNK)
            shift, mask = 4 * (_CHUNK - at - digits), 16**digits - 1
            value = F.shiftright(t[f"c{chunk}"], shift).bitwiseAND(F.lit(mask).cast("bigint"))
            bits = bits + F.when(value < int(bound, 16), F.lit(1 << i).cast("bigint")).otherwise(
                F.lit(0).cast("bigint")
            )
        return F.struct(t["w"].alias("w"), bits.alias("m"))

    return F.get(F.transform(F.array(chunks), places), F.lit(0))


def with_marks(rows: DataFrame, text: str, out: str, lists: Column) -> DataFrame:
    """Adds ``out``: per subset the number of kept terms and their hash.

    Steps are columns of their own, so that each is evaluated once.
    """
    part = ["__terms", "__banded", "__kept", "__subsets"]
    kept = (
        rows.withColumn(part[0], terms(F.col(text)))
        .withColumn(part[1], F.transform(part[0], lambda w: _listed(w, lists)))
        .withColumn(part[1], F.filter(part[1], lambda t: t.isNotNull()))
        .withColumn(
            part[2],
            F.sort_array(
                F.when(F.size(part[1]) > 0, F.col(part[1])).otherwise(
                    F.transform(F.filter(part[0], lambda w: w != ""), _hashed)
                )
            ),
        )
    )

    def having(terms_of: str, bits: int) -> Column:
        wanted = F.lit(bits).cast("bigint")
        return F.filter(terms_of, lambda t: t["m"].bitwiseAND(wanted) != 0)

    # Few terms are in any subset of a low rate: these are picked out first.
    chosen, place = [], 0
    for number, (_, _, _, count) in enumerate(RATES):
        inside = range(place, place + count)
        place += count
        part.append(f"__rate{number}")
        kept = kept.withColumn(part[-1], having(part[2], sum(1 << i for i in inside)))
        chosen += [having(part[-1], 1 << i).getField("w") for i in inside]
    subsets = kept.withColumn(part[3], F.array(F.col(part[2]).getField("w"), *chosen))
    marks = F.transform(
        part[3],
        lambda s, i: F.struct(
            F.least(F.size(s), F.lit(255)).alias("n"),
            F.substring(
                F.md5(
                    F.when((i == 0) & (F.size(s) == 0), F.col(text))
                    .otherwise(F.array_join(s, " "))
                    .cast("binary")
                ),
                1,
                HASH_CHARS,
            ).alias("h"),
        ),
    )
    return subsets.withColumn(out, marks).drop(*part)


def fingerprint(marks: Column) -> Column:
    """Two hex digits for the number (255 at most) and the hash, per subset."""
    return F.array_join(
        F.transform(
            marks, lambda m: F.concat(F.lpad(F.lower(F.hex(m["n"])), 2, "0"), m["h"])
        ),
        "",
    )


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; the classic hash counts like a subset."""
    met = F.zip_with(
        a,
        b,
        lambda x, y: F.struct(
            F.when((x["n"] == 0) & (y["n"] == 0), F.lit(0.0))
            .otherwise(1.0 / F.pow(F.greatest(x["n"], y["n"]), F.lit(2)))
            .alias("w"),
            (x["h"] == y["h"]).cast("double").alias("e"),
        ),
    )
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("t"))
    share = F.aggregate(
        met,
        zero,
        lambda acc, m: F.struct(
            (acc["s"] + m["w"] * m["e"]).alias("s"), (acc["t"] + m["w"]).alias("t")
        ),
        lambda acc: F.when(acc["t"] > 0, acc["s"] / acc["t"]),
    )
    same = (F.get(a, F.lit(0))["h"] == F.get(b, F.lit(0))["h"]).cast("double")
    return F.round(F.coalesce(share, same), 6)


def _blocks(docs: DataFrame, count: int) -> tuple[Column, list]:
    """Block of a row by its id, and the blocks with their greatest id.

    Bounds are quantiles of all ids, so blocks are even whatever the ids are.
    """
    shares = [i / count for i in range(1, count)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 10 * count)).first()[0]
    bounds = sorted(set(found or []))
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]

    def below(values):
        array = F.from_json(F.lit(json.dumps(values)), "array<bigint>")
        return F.size(F.filter(array, lambda v: v < F.col("doc_id")))

    # First among the groups by their last bound, then inside one group.
    block = F.lit(0)
    if bounds:
        outer = below([g[-1] for g in groups])
        inner = F.size(
            F.filter(
                F.get(F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>"), outer),
                lambda v: v < F.col("doc_id"),
            )
        )
        block = F.when(outer >= len(groups), F.lit(len(bounds))).otherwise(
            outer * step + inner
        )
    block = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(block).cast("int")
    heads = [
        (r[0], r[1])
        for r in docs.groupBy(block.alias("b")).agg(F.max("doc_id")).collect()
    ]
    return block, sorted(heads, reverse=True)


def with_next(rows: DataFrame, values: list[str], prepare=None) -> DataFrame:
    """Adds ``next_<value>`` of the next row by doc_id descending, in a circle.

    ``prepare`` adds columns to rows before they meet their neighbours.

    Rows are ordered within blocks of neighbouring ids; the first row of each
    block also goes to the end of the block before, so no order over all rows
    is needed and each row is shuffled once.
    """
    spark = rows.sparkSession
    count = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    block, heads = _blocks(rows.select("doc_id"), count)
    lent = rows.withColumn("__block", block).withColumn("__lent", F.lit(False))
    if heads:
        to = [(heads[i - 1][0], head) for i, (_, head) in enumerate(heads)]
        heads_to = spark.createDataFrame(to, "__to int, __head bigint")
        first = (
            rows.join(
                F.broadcast(heads_to), F.col("doc_id").eqNullSafe(F.col("__head"))
            )
            .withColumn("__block", F.col("__to"))
            .withColumn("__lent", F.lit(True))
            .select(lent.columns)
        )
        lent = lent.unionByName(first)
    order = Window.partitionBy("__block").orderBy(
        "__lent", F.desc_nulls_last("doc_id"), "text"
    )
    if prepare is not None:
        lent = prepare(lent)
    for value in values:
        lent = lent.withColumn(f"next_{value}", F.lead(value).over(order))
    return lent.filter(~F.col("__lent")).drop("__block", "__lent")


def edited_text(text: Column, length: Column, donor: Column) -> Column:
    """The last third of the code points replaced by the donor's first ones."""
    changed = F.floor(length / 3).cast("int")
    return F.concat(
        F.substring(text, F.lit(1), length.cast("int") - changed),
        F.substring(donor, F.lit(1), changed),
    )


def compared(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of texts and their edited texts, with the texts."""
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")
    )
    lists = F.from_json(
        F.lit(_bucket_json(lexicon(rows, band))), _LISTS
    )
    paired = with_next(
        rows, ["text", "marks"], lambda lent: with_marks(lent, "text", "marks", lists)
    )
    n_chars = F.char_length("text").cast("long")
    edited = paired.withColumn("n_chars", n_chars).withColumn(
        "edited", edited_text(F.col("text"), F.col("n_chars"), F.col("next_text"))
    ).drop("next_text")
    both = with_marks(edited, "edited", "edited_marks", lists)
    return both.select(
        "doc_id",
        "text",
        "edited",
        "n_chars",
        fingerprint(F.col("marks")).alias("fingerprint"),
        fingerprint(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )


def _subset_sql(first, digits, bound):
    return (
        f"list_filter(kept, lambda w: substr(sha256(w), {first}, {digits}) < '{bound}')"
    )


def _marks_sql(source: str, text: str) -> str:
    """Subquery with marks ``(n, h)`` per subset of ``text`` in ``source``."""
    subsets = ", ".join(["kept", *[_subset_sql(*s) for s in SUBSETS]])
    words = (
        f"list_distinct(list_filter(string_split_regex(lower({text}), "
        f"'{SEPARATORS}'), lambda w: w <> ''))"
    )
    return f"""
        SELECT doc_id, t, [{{n: least(len(s), 255), h: substr(md5(
            CASE WHEN i = 1 AND len(s) = 0 THEN t ELSE array_to_string(s, ' ') END), 1, {HASH_CHARS})}}
            FOR s, i IN subsets] AS marks
        FROM (SELECT doc_id, t, [{subsets}] AS subsets FROM (
            SELECT doc_id, t, list_sort(CASE WHEN len(banded) > 0 THEN banded ELSE words END) AS kept
            FROM (SELECT doc_id, t, words,
                    list_intersect(words, (SELECT list(term) FROM lexicon)) AS banded
                FROM (SELECT doc_id, {text} AS t, {words} AS words FROM {source}))))"""


def _likeness_sql(a: str, b: str) -> str:
    weights = (
        f"[CASE WHEN x.n = 0 AND {b}[i].n = 0 THEN 0.0::DOUBLE ELSE "
        f"1.0::DOUBLE / greatest(x.n, {b}[i].n) ** 2 END FOR x, i IN {a}]"
    )
    hits = (
        f"[CASE WHEN x.h <> {b}[i].h OR (x.n = 0 AND {b}[i].n = 0) THEN 0.0::DOUBLE ELSE "
        f"1.0::DOUBLE / greatest(x.n, {b}[i].n) ** 2 END FOR x, i IN {a}]"
    )
    return (
        f"round(CASE WHEN list_sum({weights}) > 0 THEN list_sum({hits}) / list_sum({weights}) "
        f"ELSE CAST({a}[1].h = {b}[1].h AS DOUBLE) END, 6)"
    )


def _fingerprint_sql(marks: str) -> str:
    return f"array_to_string([printf('%02x', m.n) || m.h FOR m IN {marks}], '')"


COMPARED_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pairs AS (
    SELECT doc_id, text, length(text) AS n_chars,
        coalesce(lead(text) OVER w, first_value(text) OVER w) AS donor,
        coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
    FROM texts WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
changed AS (
    SELECT doc_id, n_chars, next_id, left(text, n_chars - n_chars // 3) || left(donor, n_chars // 3) AS edited
    FROM pairs),
lexicon AS (
    SELECT term FROM (SELECT unnest(list_distinct(string_split_regex(lower(text), '{SEPARATORS}'))) AS term FROM texts)
    WHERE term <> '' GROUP BY term
    HAVING count(*) >= (SELECT count(*) FROM texts) * {BAND[0]!r}::DOUBLE
        AND count(*) <= (SELECT count(*) FROM texts) * {BAND[1]!r}::DOUBLE),
plain AS ({_marks_sql('texts', 'text')}),
other AS ({_marks_sql('changed', 'edited')})
SELECT c.doc_id, c.n_chars, sha256(c.edited) AS edited_sha256,
    {_fingerprint_sql('p.marks')} AS fingerprint,
    {_fingerprint_sql('o.marks')} AS edited_fingerprint,
    {_likeness_sql('p.marks', 'o.marks')} AS near_edited,
    {_likeness_sql('p.marks', 'n.marks')} AS near_next
FROM changed c JOIN plain p USING (doc_id) JOIN other o USING (doc_id) JOIN plain n ON n.doc_id = c.next_id
"""
