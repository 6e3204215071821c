"""Phone numbers by a numbering plan: a trie of codes, with lengths and kinds.

The plan is a table of ``code, digits that may follow, lengths, kind``. Its
codes form a trie of digits, which is written out as one pattern: candidates
are walked digit by digit, with the separators people write between groups, and
end where the national number is complete. Plans of other countries are given
the same way.
"""

from pyspark.sql import Column, functions as F

from pagelens.functions import fixed_values as V

_GAP = r"[\s.\-]?"


def _walk(rows: list) -> str:
    """The pattern of a trie node; ``rows`` hold what is left of their codes."""
    branches = []
    for digit in sorted({code[0] for code, *_ in rows if code}):
        below = [(code[1:], *rest) for code, *rest in rows if code[:1] == digit]
        branches.append(digit + _walk(below))
    for code, after, rests in rows:
        if not code:
            first = f"{_GAP}[{after}]" if after else ""
            tails = [rf"(?:{_GAP}\d){{{n - bool(after)}}}(?!\d)" for n in sorted(rests, reverse=True)]
            branches.append(rf"\)?{first}(?:{'|'.join(tails)})")
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


def national(plan: list) -> str:
    """Pattern of a whole national number."""
    return _walk([(code, after, [n - len(code) for n in lengths]) for code, after, lengths, _ in plan])


def pattern(plan: list = V.PHONE_PLAN, country: str = V.COUNTRY_CODE) -> str:
    """Pattern of a number of the plan, national or behind its country code.

    A number behind another country code is not reinterpreted, and the
    nine-digit US postal shape does not count.
    """
    out = rf"(?:\+|(?:{V.DIAL_OUT}){_GAP})"
    foreign = rf"(?<!(?:\+|\b00{_GAP})\d{{1,3}}[\s.\-(]{{0,2}})(?<!\+)"
    return (
        rf"(?<![\d\p{{L}}])(?!{V.ZIP_PLUS_FOUR}(?!\d))"
        rf"(?:{out}?{country}[\s.\-]{{0,2}}\(?|{foreign}\(?){national(plan)}"
    )


def has_phone(text: Column, plan: list = V.PHONE_PLAN, country: str = V.COUNTRY_CODE) -> Column:
    return F.rlike(text, F.lit(pattern(plan, country)))


def phones_in(
    text: Column, plan: list = V.PHONE_PLAN, country: str = V.COUNTRY_CODE
) -> Column:
    """``digits, kind`` of each number in the text; digits are the national ones."""

    def shape(code: str, after: str, lengths: tuple) -> str:
        rests = "|".join(rf"\d{{{n - len(code)}}}" for n in lengths)
        return rf"\A{code}{f'(?=[{after}])' if after else ''}(?:{rests})\z"

    def of(found: Column) -> Column:
        digits = F.regexp_replace(found, r"\D", "")
        bare = F.regexp_replace(digits, rf"\A(?:{V.DIAL_OUT})?{country}(?=\d{{{_least(plan)}}})", "")
        kind, own = F.lit(None).cast("string"), F.lit(None).cast("string")
        # As written first; what is no number then, is one without its prefix.
        for value in (bare, digits):
            for code, after, lengths, name in plan:
                fits = F.rlike(value, F.lit(shape(code, after, lengths)))
                kind, own = F.when(fits, name).otherwise(kind), F.when(fits, value).otherwise(own)
        return F.struct(own.alias("digits"), kind.alias("kind"))

    found = F.regexp_extract_all(text, F.lit(pattern(plan, country)), F.lit(0))
    return F.transform(found, of)


def _least(plan: list) -> int:
    return min(n for _, _, lengths, _ in plan for n in lengths)
