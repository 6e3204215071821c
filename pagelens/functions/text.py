"""Text expressions: addresses, names, accents, evidence.

Patterns that run over whole texts consume their repeated classes
possessively and start only where a run of such characters starts, so their
cost stays linear in the text.
"""

import functools
import sys
import unicodedata

from pyspark.sql import Column, functions as F

from pagelens.functions import fixed_values as V, phones

_WS = r"(?U)^\s+|\s+$"


# Explicit classes for white space and word ends instead of flags, which would
# slow every character test of the address classes.
_LOCAL = V.LOCAL_CHARS
_HOST = V.HOST_CHARS
_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_WORD_END = r"(?![\p{L}\p{N}_])"
_START = rf"(?:(?<!{_LOCAL})|\G)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _WS, "")


def _literal(text: str) -> str:
    return "".join(f"\\{ch}" if not ch.isalnum() else ch for ch in text)


def _any_case(text: str) -> str:
    """Pattern for ``text`` in any case, without a flag."""
    return "".join(
        f"[{ch}{ch.upper()}]" if ch.isalpha() else _literal(ch)
        for ch in text.lower()
    )


def _domain(tld: str) -> str:
    return rf"{_HOST}+{_any_case('.' + tld)}{_WORD_END}"


def email_pattern(tld: str) -> str:
    """SCA-7: an address whose host ends in ``tld`` at a word boundary."""
    return rf"{_START}{_LOCAL}++@{_domain(tld)}"


def _email_prefix(tld: str) -> str:
    return rf"^{_LOCAL}++@{_domain(tld)}"


def _at_pattern(tld: str) -> str:
    bracketed = rf"{_SPACE}*+(?:\[[aA][tT]\]|\([aA][tT]\))"
    spaced = rf"{_SPACE}++[aA][tT]{_SPACE}"
    return rf"{_START}{_LOCAL}++(?:{bracketed}|{spaced}){_SPACE}*+{_domain(tld)}"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def starts_as_email(c: Column, tld: str) -> Column:
    return F.rlike(c, F.lit(_email_prefix(tld)))


def is_email(c: Column, tld: str = "cl") -> Column:
    """The whole value is one address under ``tld``."""
    return F.rlike(
        c,
        F.lit(rf"(?i)^{V.LOCAL_CHARS}++@{V.HOST_CHARS}+\.{_literal(tld)}$"),
    )


def emails_in(text: Column, tld: str) -> Column:
    """SCA-7: every plainly written address, lower-cased."""
    return F.transform(_all(text, email_pattern(tld)), F.lower)


def spelled_out_in(text: Column, tld: str) -> Column:
    """SCA-9: addresses written with ``at``, ``[at]`` or ``(at)``."""
    joined = F.transform(
        _all(text, _at_pattern(tld)),
        lambda m: F.lower(F.regexp_replace(m, rf"(?iU)\s*(?:{V.AT_WORDS})\s*", "@")),
    )
    return F.filter(joined, lambda e: starts_as_email(e, tld))


def written_in(text: Column, tld: str) -> Column:
    """Both written routes, tried only where the text mentions the TLD."""
    none = F.array().cast("array<string>")
    plain = F.when(F.contains(text, F.lit("@")), emails_in(text, tld)).otherwise(none)
    spelled = F.when(
        F.rlike(text, F.lit(rf"[\[(\s\x1c-\xa0\u1680-\u3000][aA][tT]{_SPACE[:-1]}\])]")),
        spelled_out_in(text, tld),
    ).otherwise(none)
    mentioned = F.rlike(text, F.lit(_any_case("." + tld)))
    return F.when(mentioned, F.concat(plain, spelled)).otherwise(none)


def mailto_in(hrefs: Column, tld: str) -> Column:
    """SCA-8: mailto targets cut at ``?``; only their start must be an address."""
    targets = F.transform(
        F.filter(hrefs, lambda h: F.lower(h).startswith("mailto:")),
        lambda h: F.lower(strip(F.substring_index(F.substr(h, F.lit(8)), "?", 1))),
    )
    return F.filter(targets, lambda e: starts_as_email(e, tld))


def payloads_in(html: Column) -> Column:
    """SCA-10: hex payloads anywhere in the raw page."""
    return _all(html, V.PAYLOAD_PATTERN, 1)


def decode_payloads(payloads: Column) -> Column:
    """SCA-11: texts of those payloads that hold an address.

    The first octet is the key of a byte-wise XOR; the rest must be UTF-8.
    """

    well_formed = F.filter(
        payloads, lambda p: F.rlike(p, F.lit(r"(?s)^(?:[0-9a-fA-F]{2})(?:[0-9a-fA-F]{2})++.?$"))
    )
    octets = F.transform(
        well_formed,
        lambda p: F.transform(
            F.regexp_extract_all(p, F.lit("[0-9a-fA-F]{2}"), 0),
            lambda pair: F.conv(pair, 16, 10).cast("int"),
        ),
    )

    def clear(values: Column) -> Column:
        plain = F.transform(
            values, lambda v: F.lpad(F.hex(v.bitwiseXOR(values[0])), 2, "0")
        )
        return F.substr(F.array_join(plain, ""), F.lit(3))

    texts = F.filter(
        F.transform(octets, lambda v: F.unhex(clear(v)).cast("string")), F.is_valid_utf8
    )
    addresses = F.transform(texts, lambda t: strip(F.substring_index(t, "?", 1)))
    return F.filter(addresses, lambda a: F.contains(a, F.lit("@")))


def decoded_in(payloads: Column, tld: str) -> Column:
    """Lower-cased addresses under ``tld`` among a page's payloads."""
    clear = F.transform(decode_payloads(payloads), F.lower)
    return F.filter(clear, lambda e: starts_as_email(e, tld))


# Numeric references to letters, '#', '-', '.' and '/'.
_CODED = (
    r"&#(?:0*+(?:35|4[5-7]|6[5-9]|[789]\d|1[01]\d|12[0-2])(?!\d)"
    r"|[xX]0*+(?:2[3dDeEfF]|[46][1-9a-fA-F]|[57][0-9aA])(?![0-9a-fA-F]))"
)
_NAMED = ("&period", "&num", "&hyphen", "&dash")


def may_hold_email(html: Column, tld: str) -> Column:
    """Necessary condition for any address route, tested before parsing.

    An address needs ``.tld`` or a payload, written out or in character
    references. Plain substring tests come first; they cost far less than a
    pattern and decide almost every page.
    """
    low = F.lower(html)
    test = F.contains(low, F.lit("." + tld.lower()))
    for mark in ("data-cfemail", "email-protection#", *_NAMED):
        test = test | F.contains(low, F.lit(mark))
    return test | (F.contains(html, F.lit("&#")) & F.rlike(html, F.lit(_CODED)))


# --- accents ---------------------------------------------------------------


_HANGUL = range(0xAC00, 0xD7A4)


@functools.cache
def _canonical() -> tuple[str, str, dict[str, str]]:
    """Canonical decomposition without combining marks, by code point.

    Characters with a one-character result, those results, and the few that
    leave several. Marks stand at the end of the first text without a partner
    in the second: ``translate`` drops those. Hangul goes by formula.
    """
    single, several, marks = {}, {}, []
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.category(c) == "Mn":
            marks.append(c)
        elif unicodedata.decomposition(c) and code not in _HANGUL:
            parts = unicodedata.normalize("NFD", c)
            kept = "".join(p for p in parts if unicodedata.category(p) != "Mn")
            if kept != c:
                (single if len(kept) == 1 else several)[c] = kept
    return "".join([*single, *marks]), "".join(single.values()), several


def _jamo(c: Column) -> Column:
    """A Hangul syllable as its two or three letters, by their places."""
    leads, vowels, tails = (
        "".join(map(chr, range(first, first + count)))
        for first, count in ((0x1100, 19), (0x1161, 21), (0x11A8, 27))
    )
    place = F.ascii(c) - _HANGUL.start

    def letter(of: str, at: Column) -> Column:
        return F.substring(F.lit(of), at.cast("int"), F.lit(1))

    tail = place % 28
    return F.concat(
        letter(leads, F.floor(place / 588) + 1),
        letter(vowels, F.floor(place % 588 / 28) + 1),
        F.when(tail > 0, letter(tails, tail)).otherwise(""),
    )


def deaccent(c: Column) -> Column:
    """SCA-17: canonical decomposition, combining marks dropped.

    Plain ASCII comes back at once; characters that become several are looked
    at one by one, only in texts that have them.
    """
    accented, plain, several = _canonical()
    syllable = f"[{chr(_HANGUL.start)}-{chr(_HANGUL[-1])}]"
    rare = f"[{''.join(several)}{syllable[1:]}"
    known = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])

    def apart(ch: Column) -> Column:
        return F.when(F.rlike(ch, F.lit(syllable)), _jamo(ch)).otherwise(
            F.coalesce(F.try_element_at(known, ch), ch)
        )

    letters = F.translate(c, accented, plain)
    spelled = F.array_join(
        F.transform(F.regexp_extract_all(letters, F.lit("(?s)."), F.lit(0)), apart), ""
    )
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(
        F.when(F.rlike(c, F.lit(rare)), spelled).otherwise(letters)
    )


def slug(name: Column) -> Column:
    """SCA-32: lower-case letters and digits, six accents folded."""
    folded = F.translate(F.lower(name), *V.SLUG_ACCENTS)
    return F.regexp_replace(folded, r"[^\p{L}\p{N}]", "")


# --- names -------------------------------------------------------------------


def normalise_name(name: Column) -> Column:
    """SCA-20: ASCII letters of a name after folding seven accents."""
    folded = F.translate(F.lower(name), *V.NAME_ACCENTS)
    return F.regexp_replace(folded, "[^a-z]", "")


def name_pairs(text: Column) -> Column:
    """SCA-18/19: distinct (first, last) pairs in reading order.

    The pair is swapped when only its second word is a known first name.
    """
    known = F.array(*[F.lit(n) for n in V.FIRST_NAMES])

    def pair(match: Column) -> Column:
        words = F.split(match, r"(?U)\s+")
        one, two = words[0], words[1]
        swap = ~F.array_contains(known, one) & F.array_contains(known, two)
        return F.struct(
            F.when(swap, two).otherwise(one).alias("first"),
            F.when(swap, one).otherwise(two).alias("last"),
        )

    found = _all(text, rf"(?U)\b{V.NAME_WORD}\s++{V.NAME_WORD}\b")
    return F.array_distinct(F.transform(found, pair))


def apply_pattern(first: Column, last: Column, pattern: Column | str) -> Column:
    """SCA-21: local part from a template with four tokens."""
    local = F.lit(pattern) if isinstance(pattern, str) else pattern
    for token, value in (
        ("{first}", first),
        ("{last}", last),
        ("{f}", F.left(first, F.lit(1))),
        ("{l}", F.left(last, F.lit(1))),
    ):
        local = F.replace(local, F.lit(token), value)
    return local


# --- evidence ------------------------------------------------------------------


def page_lang(lang: Column) -> Column:
    """SCA-6: ``es_CL`` and `` ES-cl`` are both ``es-cl``."""
    return F.replace(F.lower(strip(lang)), F.lit("_"), F.lit("-"))


def has_valid_rut(text: Column) -> Column:
    """SCA-13: some identifier-shaped text carries its own check character."""

    def checks(candidate: Column) -> Column:
        body = F.regexp_replace(F.substring_index(candidate, "-", 1), r"\.", "")
        size = F.length(body)
        total = F.aggregate(
            F.sequence(F.lit(1), size),
            F.lit(0),
            lambda acc, i: acc
            + F.substr(body, size - i + 1, F.lit(1)).cast("int")
            * (F.pmod(i - 1, F.lit(6)) + 2),
        )
        expected = F.pmod(F.lit(11) - F.pmod(total, F.lit(11)), F.lit(11))
        shown = F.upper(F.right(candidate, F.lit(1)))
        return shown == F.when(expected == 10, "K").otherwise(
            expected.cast("string")
        )

    return F.exists(_all(text, r"(?U)" + V.RUT_CANDIDATE), checks)


def has_cl_phone(text: Column) -> Column:
    """SCA-14: a number of the Chilean plan, national or behind +56.

    The plan's codes, lengths and kinds are those of ``fixed_values``; see
    ``phones`` for the numbers themselves and for other plans.
    """
    return phones.has_phone(text)


def has_lexicon(text: Column, terms: list | None = None) -> Column:
    """SCA-15: some term, word-bounded, in lower-case text without accents."""
    words = "|".join(_literal(t) for t in (terms or V.LEXICON))
    return F.rlike(deaccent(F.lower(text)), F.lit(rf"(?U)\b(?:{words})\b"))


def has_country_path(url_path: Column) -> Column:
    """SCA-16: a path segment scopes the page to the country."""
    return F.exists(
        F.split(url_path, "/"), lambda s: F.rlike(s, F.lit(V.PATH_SEGMENT))
    )


# --- report text -------------------------------------------------------------


def escape_html(c: Column) -> Column:
    """SCA-34: text safe to place in markup."""
    for raw, safe in V.HTML_ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def label(status: Column, labels: dict) -> Column:
    """SCA-33: display label of a status, or the status itself."""
    out = status
    for known, shown in labels.items():
        out = F.when(status == known, shown).otherwise(out)
    return out
