"""Personal data replaced by keyed surrogates of the same type and format.

Texts that can hold an entity are matched once with one pattern; the text is
split at the matches and put together again with surrogates in their place. A
surrogate is drawn from a keyed SHA-512 of the entity's normal form, so every
mention of an entity gets the same one, written the way the mention is written.
It keeps what the type asks for: a card number passes its checksum, a phone its
country digit, a name its script and the gender its title tells. Cards are
looked for inside runs of digits; the digits beside a card stay.

A person is found behind a title. Names found so in a text are also replaced
where that same text has them, capitalised, without the title. Names never
titled in their text are not found, nor inflected forms.

Distinct entities must keep distinct surrogates, and no surrogate may be an
entity of the data: the table of entities is checked for both, and those that
lose are drawn again with a raised attempt number until none is left. From the
``WIDE``-th attempt on a surrogate is longer than the entity, by more each time
(an address leaves the private range and then becomes a version 6 one), so that
a form with fewer surrogates than entities does not draw for ever.

Only rows with an entity are checkpointed and joined; all other rows pass in
the scan that tested them. Everything is DataFrame functions.

Defined results: NULL and empty texts and texts without an entity come back as
they are, with no entity; repeated rows are replaced alike; an empty table
gives no rows; all other columns are kept (columns beginning with ``__pii`` are
used inside).
"""

from pyspark.sql import Column, DataFrame, functions as F

from pagelens.operators.shared import cut

DEFAULT_KEY = "pagelens"

# Titles and the gender they tell.
TITLES_M = "Mr|Herr|Señor|Sr|Monsieur|господин|κύριος"
TITLES_F = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Mlle|госпожа|κυρία"
TITLES_ANY = "Dr|Prof"
_TITLES = f"{TITLES_M}|{TITLES_F}|{TITLES_ANY}"
_NAME = r"\p{Lu}[\p{L}'’\-]++"
# A capitalised word, and the ending that is not part of a name.
NAMED = rf"(?<!\p{{L}}){_NAME}"
_OWNS = r"['’][sS]\z"
_ASSIGNED = (
    r"\b(?i:password|passwd|secret|token|api[_\-]?key)(?-i)[ \t]{0,3}[=:][ \t]{0,3}[\"']?"
)

# Attempts that keep to the entity's own form.
WIDE = 3

# Letters of all scripts may stand in an address.
_LOCAL = r"[\p{L}\p{M}\p{N}_.%+\-]"
_LABEL = r"[\p{L}\p{M}\p{N}\-]+"
_HEX = "[0-9A-Fa-f]{1,4}"
# A title, or one that only counts with its stop; then initials, which stay.
_TITLED = rf"(?:(?:{_TITLES})\.?|M\.)[  ](?:\p{{Lu}}\.[  ]?){{0,3}}"

# Kinds in the order in which they are tried at one position.
KINDS = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++@{_LABEL}(?:\.{_LABEL})*\.\p{{L}}{{2,}}",
    "secret": _ASSIGNED + r"[A-Za-z0-9+/_\-]{8,}+",
    "key": r"\b(?:(?:AKIA|ASIA)[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": (
        r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}"
        r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)"
    ),
    "ip6": (
        rf"(?<![\w:.])(?=[A-Fa-f:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}"
        rf"|(?:{_HEX}(?::{_HEX}){{0,5}})?::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\w:])"
    ),
    "phone": (
        r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)"
        r"|(?<![\d\-])(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\-]\d{4}(?![\d\-])"
    ),
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "person": rf"(?<![\p{{L}}]){_TITLED}{_NAME}(?:[  ]{_NAME})?",
}
# Digits with single separators, up to where an entity of another kind begins;
# the cards in them are found by their checksum.
_OTHER = "|".join(KINDS[kind] for kind in ("email", "ip", "phone", "ssn"))
KINDS["card"] = rf"(?<!\d)\d(?:(?:[ \-](?!{_OTHER}))?\d){{12,}}+"
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
# Of two valid lengths at one place the first is taken.
CARD_DIGITS = (16, 19, 18, 17, 15, 14, 13)
# Beginnings and lengths that issuers give out, and how they group the digits.
ISSUED = (
    r"\A(?:4\d{12}(?:\d{3}){0,2}|5[1-5]\d{14}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11}|35\d{14}"
    r"|6(?:011|5\d\d|4[4-9]\d)\d{12}|62\d{14,17}"
    r"|(?:5018|5020|5038|5893|6304|6759|676[1-3])\d{9,15})\z"
)
GROUPED = r"\A(?:\d+|\d{4}([ \-])\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{4}([ \-])\d{6}\2\d{4,5})\z"
# A text without these cannot hold an entity.
SUSPECT = (
    rf"[0-9@]|(?<![\p{{L}}])(?:(?:{_TITLES})\b|M\.)|AKIA|ASIA|ghp_|sk-"
    r"|(?i:passw|secret|token|api[_\-]?key)"
)

# Syllables by hex digit, per script.
SYLLABLES = {
    "latin": "ba de fi ga ho ju ka le mi no pa re si ta vo zu",
    "cyrillic": "ба де фи га хо жу ка ле ми но па ре си та во зу",
    "greek": "βα δε φι γα χο ζου κα λε μι νο πα ρε σι τα βο θου",
}
# Letters of an address by script.
LETTERS = {"cyrillic": "абвгдежзиклмнопрстуфхцчшщ", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
# Endings by script: masculine and open given names, feminine ones, families.
ENDINGS = {
    "latin": ("n", "na", "ser"),
    "cyrillic": ("н", "на", "вич"),
    "greek": ("ς", "να", "κος"),
}


def _matches(text: Column) -> Column:
    """All matches in order; nothing is searched in a text without a suspect."""
    return F.when(
        text.rlike(SUSPECT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    ).otherwise(F.array().cast("array<string>"))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """Checksum of a digit string; valid numbers give a multiple of ten."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda s, d: s + d)


def _part(kind, raw: Column) -> Column:
    named = kind if isinstance(kind, Column) else F.lit(kind).cast("string")
    return F.struct(named.alias("kind"), raw.alias("raw"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cards_by(run: Column, fits) -> Column:
    """A digit run as parts; the leftmost valid cards that fit."""
    least = min(CARD_DIGITS)

    def is_digit(chars, i):
        return F.coalesce(F.get(chars, i).rlike("[0-9]"), F.lit(False))

    def piece(chars, a, z):
        return F.array_join(F.slice(chars, a + 1, z - a), "")

    def is_card(chars, c):
        at_border = ~is_digit(chars, c["a"] - 1) & ~is_digit(chars, c["z"])
        is_run = (c["a"] == 0) & (c["z"] == F.size(chars))
        return _let(
            piece(chars, c["a"], c["z"]),
            lambda raw: fits(raw, at_border, is_run) & (luhn_sum(_digits(raw)) % 10 == 0),
        )

    def candidates(chars, at):
        def of_start(s):
            return F.transform(
                F.filter(F.array(*map(F.lit, CARD_DIGITS)), lambda k: k <= F.size(at) - s),
                lambda k: F.struct(
                    F.get(at, s).alias("a"), (F.get(at, s + k - 1) + 1).alias("z")
                ),
            )

        starts = F.filter(
            F.sequence(F.lit(0), F.size(at) - least),
            lambda s: F.get(chars, F.get(at, s)).rlike("[3-6]"),
        )
        return F.flatten(F.transform(starts, of_start))

    def apart(spans):
        start = F.struct(
            F.lit(0).alias("end"), F.array().cast("array<struct<a:int,z:int>>").alias("spans")
        )
        return F.aggregate(
            spans,
            start,
            lambda acc, c: F.when(
                c["a"] >= acc["end"],
                F.struct(
                    c["z"].alias("end"), F.concat(acc["spans"], F.array(c)).alias("spans")
                ),
            ).otherwise(acc),
            lambda acc: acc["spans"],
        )

    def cut_at(chars, spans):
        def of_span(span, i):
            before = F.coalesce(F.get(spans, i - 1)["z"], F.lit(0))
            return F.array(
                _part(None, piece(chars, before, span["a"])),
                _part("card", piece(chars, span["a"], span["z"])),
            )

        last = F.coalesce(F.get(spans, F.size(spans) - 1)["z"], F.lit(0))
        tail = F.array(_part(None, piece(chars, last, F.size(chars))))
        return F.concat(F.flatten(F.transform(spans, of_span)), tail)

    def parts(chars):
        where = F.filter(
            F.sequence(F.lit(0), F.size(chars) - 1), lambda i: is_digit(chars, i)
        )
        return _let(
            where,
            lambda at: F.when(
                F.size(at) >= least,
                _let(
                    apart(F.filter(candidates(chars, at), lambda c: is_card(chars, c))),
                    lambda spans: cut_at(chars, spans),
                ),
            ).otherwise(F.array(_part(None, piece(chars, F.lit(0), F.size(chars))))),
        )

    return _let(F.split(run, ""), parts)


def _cards(run: Column) -> Column:
    """A digit run as parts: cards with a right checksum, and what is beside them.

    Whole digit groups with an issuer's beginning and length come first, then
    whole groups of any such length, then issuers' numbers amid more digits.
    A checksum alone is right for every tenth number, so these last ones need
    an issuer's length and grouping.
    """
    ranks = (
        lambda raw, at_border, is_run: at_border & _digits(raw).rlike(ISSUED),
        lambda raw, at_border, is_run: at_border
        & (is_run | ~raw.rlike(r"(?:\A|[ \-])\d{1,2}[ \-]")),
        lambda raw, at_border, is_run: raw.rlike(GROUPED) & _digits(raw).rlike(ISSUED),
    )
    parts = F.array(_part(None, run))
    for fits in ranks:
        parts = F.flatten(
            F.transform(
                parts,
                lambda p: F.when(p["kind"].isNull(), _cards_by(p["raw"], fits)).otherwise(
                    F.array(_part(p["kind"], p["raw"]))
                ),
            )
        )
    return F.filter(parts, lambda p: p["raw"] != "")


def _parts(match: Column) -> Column:
    """A match as literal parts (kind NULL) and parts to replace."""

    def is_kind(kind):
        return match.rlike(rf"\A(?:{KINDS[kind]})\z")

    lead = F.regexp_extract(match, rf"\A{_ASSIGNED}", 0)
    title = F.regexp_extract(match, rf"\A{_TITLED}", 0)
    names = F.regexp_replace(match, rf"\A{_TITLED}", "")
    given = F.regexp_extract(names, rf"\A({_NAME})[  ]", 1)
    gap = F.regexp_extract(names, rf"\A{_NAME}([  ])", 1)
    last = F.regexp_extract(names, rf"({_NAME})\z", 1)
    family, owns = F.regexp_replace(last, _OWNS, ""), F.regexp_extract(last, _OWNS, 0)
    gender = (
        F.when(title.rlike(rf"\A(?:{TITLES_F})\b"), "given_f").otherwise("given_m")
    )
    plain = F.array(_part(None, match))
    found = F.when(is_kind("email"), F.array(_part("email", match)))
    found = found.when(
        is_kind("secret"),
        F.array(_part(None, lead), _part("secret", F.regexp_replace(match, rf"\A{_ASSIGNED}", ""))),
    )
    for kind in ("key", "iban", "ip", "ip6", "phone", "ssn"):
        found = found.when(is_kind(kind), F.array(_part(kind, match)))
    found = found.when(is_kind("card"), _cards(match))
    found = found.when(
        is_kind("person") & (given != ""),
        F.array(
            _part(None, title),
            _part(gender, given),
            _part(None, gap),
            _part("family", family),
            _part(None, owns),
        ),
    ).when(
        is_kind("person"),
        F.array(_part(None, title), _part("family", family), _part(None, owns)),
    )
    return found.otherwise(plain)


def _normal(kind: Column, raw: Column) -> Column:
    """What mentions of one entity have in common."""
    return (
        F.when(kind.isin("card", "ssn"), _digits(raw))
        .when(kind == "phone", F.regexp_replace(raw, "[^0-9+]", ""))
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when(kind.isin("email", "ip6", "given_m", "given_f", "family"), F.lower(raw))
        .otherwise(raw)
    )


def _byte(stream: Column, i: Column) -> Column:
    """Byte ``i`` of a 64-byte hex stream; later rounds are shifted."""
    at = F.substring(stream, (i % 64) * 2 + 1, F.lit(2))
    return F.conv(at, 16, 10).cast("int") + F.floor(i / 64).cast("int") * 37


def _pick(alphabet: str, number: Column) -> Column:
    return F.substring(F.lit(alphabet), (number % len(alphabet)).cast("int") + 1, F.lit(1))


def _same_classes(value: Column, stream: Column) -> Column:
    """Digits to digits, letters to letters of their case; hex stays hex."""
    lower = "abcdefghijklmnopqrstuvwxyz"
    hexed = value.rlike(r"\A[0-9a-f]+\z")

    def swap(c, i):
        b = _byte(stream, i)
        return (
            F.when(c.rlike("[0-9]"), _pick("0123456789", b))
            .when(c.rlike("[a-z]") & hexed, _pick("abcdef", b))
            .when(c.rlike("[a-z]"), _pick(lower, b))
            .when(c.rlike("[A-Z]"), _pick(lower.upper(), b))
            # A mark goes with its letter; other letters keep their script.
            .when(c.rlike(r"\p{M}"), F.lit(""))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(LETTERS["cyrillic"], b))
            .when(c.rlike(r"\p{IsGreek}"), _pick(LETTERS["greek"], b))
            .when(c.rlike(r"\p{L}"), _pick(lower, b))
            .when(c.rlike(r"\p{N}"), _pick("0123456789", b))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), swap), "")


def _keyed_digits(stream: Column, length: Column) -> Column:
    numbers = F.transform(
        F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0))),
        lambda i: _pick("0123456789", _byte(stream, i)),
    )
    return F.substring(F.array_join(numbers, ""), F.lit(1), length)


def _name(kind: Column, normal: Column, attempt: Column, stream: Column) -> Column:
    def made(script):
        syllables = F.split(F.lit(SYLLABLES[script]), " ")
        masculine, feminine, family = ENDINGS[script]
        count = F.when(kind == "family", 3).otherwise(2) + attempt
        body = F.array_join(
            F.transform(
                F.sequence(F.lit(0), count - 1),
                lambda i: F.get(syllables, _byte(stream, i) % 16),
            ),
            "",
        )
        end = (
            F.when(kind == "family", family)
            .when(kind == "given_f", feminine)
            .otherwise(masculine)
        )
        return F.concat(body, end)

    return (
        F.when(normal.rlike(r"\p{IsCyrillic}"), made("cyrillic"))
        .when(normal.rlike(r"\p{IsGreek}"), made("greek"))
        .otherwise(made("latin"))
    )


def surrogate(kind: Column, normal: Column, attempt: Column, key: str) -> Column:
    """The surrogate's normal form."""
    stream = F.sha2(
        F.concat_ws("\u0001", F.lit(key), kind, normal, attempt.cast("string")), 512
    )
    size = F.char_length(normal)
    first = F.substring(normal, F.lit(1), F.lit(1))
    more = F.greatest(attempt - (WIDE - 1), F.lit(0)) * 2
    payload = F.concat(first, _keyed_digits(stream, size - 2 + more))
    check = (10 - luhn_sum(F.concat(payload, F.lit("0"))) % 10) % 10
    plus = F.substring(normal, F.lit(1), F.lit(2))
    area = _pick("23456789", _byte(stream, F.lit(63)))
    phone = F.when(
        first == "+", F.concat(plus, area, _keyed_digits(stream, size - 3 + more))
    ).otherwise(F.concat(area, _keyed_digits(stream, size - 1 + more)))
    octets = [(_byte(stream, F.lit(i)) % 256).cast("string") for i in (0, 1, 2)]
    reserved = (240 + _byte(stream, F.lit(3)) % 15).cast("string")
    groups = [F.substring(stream, 4 * i + 3, 4) for i in range(7)]
    ip6 = F.concat_ws(":", F.concat(F.lit("fd"), F.substring(stream, 1, 2)), *groups)
    ip = (
        F.when(attempt < WIDE, F.concat_ws(".", F.lit("10"), *octets))
        .when(attempt < 2 * WIDE, F.concat_ws(".", reserved, *octets))
        .otherwise(ip6)
    )
    email = F.concat(
        _same_classes(F.substring_index(normal, "@", 1), stream),
        F.lit("@"),
        F.translate(F.substring(stream, F.lit(65), 8 + more), "0123456789", "ghijklmnop"),
        F.lit(".example."),
        F.get(F.array(F.lit("com"), F.lit("net"), F.lit("org")), _byte(stream, F.lit(40)) % 3),
    )
    rest = F.substring(normal, F.lit(5), size)
    head = F.substring(normal, F.lit(1), F.lit(4))
    country = F.substring(normal, F.lit(1), F.lit(2))
    tail = F.substring(stream, F.lit(65), more)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "ip6", ip6)
        .when(kind == "phone", phone)
        .when(kind == "card", F.concat(payload, check.cast("string")))
        .when(kind == "ssn", F.concat(F.lit("9"), _keyed_digits(stream, size - 1 + more)))
        .when(kind == "key", F.concat(head, _same_classes(rest, stream), tail))
        .when(
            kind == "iban",
            F.concat(
                country,
                _same_classes(F.substring(normal, F.lit(3), size), stream),
                F.upper(tail),
            ),
        )
        .when(kind == "secret", F.concat(_same_classes(normal, stream), tail))
        .otherwise(_name(kind, normal, attempt, stream))
    )


def _cased(raw: Column, made: Column) -> Column:
    return F.when(F.upper(raw) == raw, F.upper(made)).otherwise(F.initcap(made))


def _named_again(segment: Column, normals: Column, made: Column) -> Column:
    """``text, n``: untitled mentions of the row's own names replaced."""

    def known(word):
        return F.array_position(normals, F.lower(word))

    def swap(word):
        stem = F.regexp_replace(word, _OWNS, "")
        return (
            F.when(known(word) > 0, _cased(word, F.get(made, known(word) - 1)))
            .when(
                known(stem) > 0,
                F.concat(
                    _cased(stem, F.get(made, known(stem) - 1)), F.regexp_extract(word, _OWNS, 0)
                ),
            )
            .otherwise(F.lit(None))
        )

    def joined(words, gaps):
        return _let(
            F.transform(words, swap),
            lambda new: F.struct(
                F.concat(
                    F.array_join(
                        F.transform(
                            words,
                            lambda w, i: F.concat(
                                F.get(gaps, i), F.coalesce(F.get(new, i), w)
                            ),
                        ),
                        "",
                    ),
                    F.element_at(gaps, -1),
                ).alias("text"),
                F.size(F.filter(new, lambda w: w.isNotNull())).alias("n"),
            ),
        )

    return F.when(
        F.size(normals) > 0,
        _let(
            F.regexp_extract_all(segment, F.lit(NAMED), F.lit(0)),
            lambda words: _let(
                F.split(segment, NAMED, -1), lambda gaps: joined(words, gaps)
            ),
        ),
    ).otherwise(F.struct(segment.alias("text"), F.lit(0).alias("n")))


def _written(kind: Column, raw: Column, made: Column) -> Column:
    """The surrogate in the mention's own format."""

    def fill(pattern):
        # The k-th character that fits takes the surrogate's k-th one.
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
        done = F.aggregate(
            F.split(raw, ""),
            start,
            lambda acc, c: F.when(
                c.rlike(pattern),
                F.struct(
                    F.concat(acc["out"], F.substring(made, acc["n"] + 1, F.lit(1))).alias("out"),
                    (acc["n"] + 1).alias("n"),
                ),
            ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["n"].alias("n"))),
        )
        # A longer surrogate goes on behind the mention's own places.
        return _let(
            done,
            lambda d: F.concat(d["out"], F.substring(made, d["n"] + 1, F.char_length(made))),
        )

    return (
        F.when(kind.isNull(), raw)
        .when(kind == "phone", fill("[0-9+]"))
        .when(kind.isin("card", "ssn"), fill("[0-9]"))
        .when(kind == "iban", fill("[A-Z0-9]"))
        .when(kind.isin("given_m", "given_f", "family"), _cased(raw, made))
        .otherwise(made)
    )


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """``kind, normal, made`` with distinct ``made`` per kind, none an entity."""

    def drawn(rows):
        return rows.withColumn(
            "made", surrogate(F.col("kind"), F.col("normal"), F.col("attempt"), key)
        )

    now = cut(drawn(entities.withColumn("attempt", F.lit(0))))
    while True:
        keeper = now.groupBy("kind", "made").agg(
            F.min("normal").alias("keeper"), F.count(F.lit(1)).alias("n")
        )
        taken = now.select("kind", F.col("normal").alias("made"), F.lit(True).alias("real"))
        # Cases with several claimants or an entity of that form.
        clash = (
            keeper.join(taken, ["kind", "made"], "left")
            .filter("n > 1 or real")
            .select("kind", "made", F.when(F.col("real").isNull(), F.col("keeper")).alias("keeper"))
        )
        losers = (
            now.join(clash, ["kind", "made"])
            .filter("keeper is null or normal <> keeper")
            .select("kind", "normal", F.lit(1).alias("lost"))
        )
        if losers.isEmpty():
            return now.select("kind", "normal", "made")
        again = now.join(losers, ["kind", "normal"], "left").withColumn(
            "attempt", F.col("attempt") + F.coalesce("lost", F.lit(0))
        )
        now = cut(drawn(again.select("kind", "normal", "attempt")))


def _union(sets: str) -> Column:
    return F.sort_array(F.array_distinct(F.flatten(F.collect_list(sets))))


def replace_entities(
    docs: DataFrame, key: str = DEFAULT_KEY, into=("n_entities", "kinds")
) -> DataFrame:
    """``text`` with surrogates; adds the number of entities and their kinds.

    Columns of the names in ``into`` are replaced.
    """
    columns = [c for c in docs.columns if c not in into]
    none = F.array().cast("array<string>")
    matched = docs.withColumn("__pii_matches", _matches(F.col("text")))
    clean = docs.filter(
        F.col("text").isNull()
        | ~F.col("text").rlike(SUSPECT)
        | ~F.col("text").rlike(PATTERN)
    ).select(*columns, F.lit(0).cast("long").alias(into[0]), none.alias(into[1]))
    held = cut(
        matched.filter(F.size("__pii_matches") > 0).withColumn(
            "__pii_row", F.monotonically_increasing_id()
        )
    )
    parts = (
        held.select("__pii_row", F.posexplode("__pii_matches").alias("at", "match"))
        .select("__pii_row", "at", F.posexplode(_parts(F.col("match"))).alias("sub", "part"))
        .select(
            "__pii_row",
            "at",
            "sub",
            F.col("part.kind").alias("kind"),
            F.col("part.raw").alias("raw"),
            _normal(F.col("part.kind"), F.col("part.raw")).alias("normal"),
        )
    )
    entities = parts.filter(F.col("kind").isNotNull()).select("kind", "normal").distinct()
    table = surrogate_table(entities, key)
    written = (
        parts.join(table, ["kind", "normal"], "left")
        .withColumn("new", _written(F.col("kind"), F.col("raw"), F.col("made")))
        # The parts of a match first, then the matches of a row.
        .groupBy("__pii_row", "at")
        .agg(
            F.sort_array(F.collect_list(F.struct("sub", "new"))).alias("new"),
            F.count("kind").alias("many"),
            F.collect_set("kind").alias("kinds"),
            F.collect_set(
                F.when(
                    F.col("kind").isin("given_m", "given_f", "family"),
                    F.struct("normal", "kind", "made"),
                )
            ).alias("names"),
        )
        .withColumn("new", F.array_join(F.transform("new", lambda p: p["new"]), ""))
        .groupBy("__pii_row")
        .agg(
            F.sort_array(F.collect_list(F.struct("at", "new"))).alias("__pii_new"),
            F.sum("many").alias("__pii_count"),
            _union("kinds").alias("__pii_kinds"),
            _union("names").alias("__pii_names"),
        )
    )
    # Literal text before each match, and what follows the last one.
    segments = F.split(F.col("text"), PATTERN, -1)
    new_at = F.transform("__pii_new", lambda p: p["new"])
    rebuilt = (
        held.join(written, "__pii_row")
        .withColumn("__pii_normals", F.col("__pii_names.normal"))
        .withColumn("__pii_made", F.col("__pii_names.made"))
        .withColumn(
            "__pii_segments",
            F.transform(
                segments, lambda s: _named_again(s, F.col("__pii_normals"), F.col("__pii_made"))
            ),
        )
        .withColumn("__pii_at", new_at)
        .withColumn(
            "text",
            F.concat(
                F.array_join(
                    F.transform(
                        "__pii_at",
                        lambda new, i: F.concat(F.get("__pii_segments", i)["text"], new),
                    ),
                    "",
                ),
                F.element_at("__pii_segments", -1)["text"],
            ),
        )
        .select(
            *columns,
            F.aggregate(
                "__pii_segments", F.col("__pii_count"), lambda n, s: n + s["n"]
            ).alias(into[0]),
            F.col("__pii_kinds").alias(into[1]),
        )
    )
    return clean.unionByName(rebuilt)
