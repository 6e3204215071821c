"""Rows that every operator must take: nulls, empty and very long texts, ties."""

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, "
    "score DOUBLE, set_id STRING, part INT, rank INT, block INT"
)

LONG_WORD = "ab" * 40_000
LONG_TEXT = "the onre thing, " * 12_000
CARD = "4539 1488 0343 6467"

EDGE_TEXTS = [
    None,
    "",
    "  \n ",
    "12 + 3 !!",
    "Aé ß 中文 İΣ́ \U0001f600",
    "One two",
    "one TWO",
    "Mail ana.soto@mail.example.com or +1 (310) 555-4510, card " + CARD + ".",
    "Released under the MIT License.\nThe fishing license is old.",
    LONG_WORD,
    LONG_TEXT,
    "The anre of thing was with the erre onre and more.",
    "The anre of thing was with the erre onre and more.",
]


def edge_rows():
    rows = [
        (i, text, "en" if i % 2 else None, f"s{i % 3}", len(text or ""), 0.5, "x", 1, 2, 3)
        for i, text in enumerate(EDGE_TEXTS)
    ]
    # A repeated row, one id with two texts, a row without an id.
    return [*rows, rows[-1], (11, "another text", *rows[-1][2:]), (None, "no id here", *rows[-1][2:])]
