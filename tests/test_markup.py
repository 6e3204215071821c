"""The tokenizer: what a reader sees, what is hidden, and its cost."""

import time
from urllib.parse import urljoin

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from pagelens.functions import markup
from pagelens.functions.markup import _resolver, read_markup

HIDING = [
    '<div style="display:none">t@a.cl</div>',
    '<div style="DISPLAY : none">t@a.cl</div>',
    '<p style="visibility:hidden">t@a.cl</p>',
    '<p style="opacity:0">t@a.cl</p>',
    '<p style="color:#fff;background-color:#ffffff">t@a.cl</p>',
    '<a style="font-size:0" href="mailto:t@a.cl">t@a.cl</a>',
    '<span style="text-indent:-9999px">t@a.cl</span>',
    '<div aria-hidden="TRUE">t@a.cl</div>',
    "<section hidden>t@a.cl</section>",
    "<div hidden><p>otro <b>t@a.cl</b></p></div>",
    "<td style='width:0px;'>t@a.cl</td>",
    "<td style=border-width:0;>t@a.cl</td>",
]
SHOWN = [
    "<p>t@a.cl</p>",
    '<p style="opacity:0.5">t@a.cl</p>',
    '<p style="opacity:0.0">t@a.cl</p>',
    '<p style="font-size:0.9em">t@a.cl</p>',
    '<p style="width:100px">t@a.cl</p>',
    '<p style="color:#fff;background:#000">t@a.cl</p>',
    '<p style="background-color:white">t@a.cl</p>',
    '<p data-hidden="x">t@a.cl</p>',
    '<p aria-hidden="false">t@a.cl</p>',
    '<input type="hidden" value="x">t@a.cl',
    "<div hidden>x</div>t@a.cl",
]


def visible(html):
    facts = read_markup(html)
    return facts["visible_text"] if facts["visible_text"] is not None else facts["text"]


@pytest.mark.parametrize("html", HIDING)
def test_hidden_text_is_apart(html):
    facts = read_markup(f"<html><body>{html}<p>fin</p></body></html>")
    assert "t@a.cl" not in facts["visible_text"]
    assert any("t@a.cl" in t for t in facts["hidden_texts"])
    assert "fin" in facts["visible_text"]
    assert "t@a.cl" in facts["text"]


@pytest.mark.parametrize("html", SHOWN)
def test_shown_text_stays(html):
    assert "t@a.cl" in visible(f"<html><body>{html}</body></html>")


def test_script_style_and_comments_are_not_text():
    html = (
        "<script>var a='x@s.cl </p>';</script><style>p{}</style><!-- x@c.cl -->"
        "<template>x@t.cl</template><ruby>base<rt>x@r.cl</rt></ruby>ok"
    )
    assert read_markup(html)["text"].split() == ["base", "ok"]


def test_text_pieces_are_joined_with_spaces_and_unescaped():
    assert read_markup("<p>info<b>@</b>a.cl &amp; &#64;</p>")["text"] == "info @ a.cl & @"


def test_hidden_paragraph_ends_at_the_next_block():
    facts = read_markup("<p hidden>trampa<p>visible<div>mas</div>")
    assert facts["visible_text"].split() == ["visible", "mas"]


def test_unclosed_hidden_element_hides_the_rest_of_its_parent():
    facts = read_markup("<div><span hidden>a</div>b")
    assert facts["visible_text"].split() == ["b"]
    assert facts["hidden_texts"] == ["a"]


def test_list_and_table_cells_end_implicitly():
    assert visible("<ul><li hidden>a<li>b</ul>c").split() == ["b", "c"]
    assert visible("<table><tr><td hidden>a<td>b<tr><td>c</table>").split() == ["b", "c"]
    assert visible("<ul><li hidden>a<ul><li>b</ul></ul>c").split() == ["c"]


def test_stray_end_tags_are_ignored():
    assert visible("<div hidden>a</b></i>b</div>c").split() == ["c"]


def test_nested_hidden_regions_are_separate_texts():
    facts = read_markup("<div hidden>a<b hidden>b</b>c</div>d")
    assert facts["hidden_texts"] == ["a c", "b"]


def test_anchors_keep_order_flags_and_resolution():
    html = (
        "<a href=' /x?a=1&amp;b=2 '>1</a><a name=n>2</a><a href>3</a>"
        "<a hidden href=\"mailto:a@b.cl\">4</a><A HREF='//h.cl/y'>5</A>"
        "<a href='../z'>6</a>"
    )
    anchors = read_markup(html, "https://www.a.cl/p/q")["anchors"]
    assert [a["url"] for a in anchors] == [
        "https://www.a.cl/x?a=1&b=2",
        "https://www.a.cl/p/q",
        "mailto:a@b.cl",
        "https://h.cl/y",
        "https://www.a.cl/z",
    ]
    assert [a["hidden"] for a in anchors] == [False, False, True, False, False]
    assert [a["pos"] for a in anchors] == [0, 1, 2, 3, 4]


def test_attributes_may_hold_angle_brackets_and_loose_equals():
    facts = read_markup('<a title="a > b" href = "/x">ok</a><p x= y>z')
    assert facts["anchors"][0]["href"] == "/x"
    assert facts["text"].split() == ["ok", "z"]


def test_payload_attributes():
    facts = read_markup('<span class="__cf_email__" data-cfemail="a5c4">x</span>')
    assert facts["payloads"] == [{"hex": "a5c4", "hidden": False}]


_PIECES = st.lists(
    st.sampled_from(["/", "a", "..", ".", "b.html", "?q=1", "?", "#", "#t", ";x", "ñ", " ", "\\", "//", ":", "%20"]),
    max_size=6,
).map("".join)


@settings(max_examples=400, deadline=None)
@given(_PIECES, st.sampled_from(["https://www.a.cl/p/q?x=1", "http://a.cl", "HTTPS://A.cl:80/x/", "ftp://a.cl/", "/solo", ""]))
def test_resolution_equals_urljoin(href, base):
    assert _resolver(base)(href) == urljoin(base, href.strip())


@pytest.mark.parametrize(
    "html, lang",
    [
        ('<html lang="es-CL"><p>x', "es-CL"),
        ("<!doctype html>\n<HTML LANG=es_cl>", "es_cl"),
        ("<html><p lang=es-CL>x", ""),
        ("<p>x", None),
    ],
)
def test_language(html, lang):
    assert read_markup(html)["lang"] == lang


def test_missing_page():
    assert read_markup(None) is None
    assert read_markup("")["text"] == ""


@pytest.mark.parametrize(
    "html",
    [
        '<a "' * 200_000,
        "<!--" * 200_000,
        '<a href="' * 100_000,
        "<div hidden>" * 50_000,
        "<style>" * 50_000 + "</" * 10_000,
        "<p hidden>" + "<b>" * 50_000 + "<p>" * 50_000,
        "=' <a b='" * 100_000,
        "<" * 300_000,
        "<script>" * 100_000,
    ],
)
def test_cost_is_linear_on_broken_markup(html):
    started = time.perf_counter()
    read_markup(html, "https://a.cl/")
    assert time.perf_counter() - started < 10


def test_implied_ends_do_not_depend_on_depth():
    def address_hidden(depth):
        html = "<ul><li hidden>" + "<b>" * depth + "<li>x@b.cl"
        return "x@b.cl" not in read_markup(html)["visible_text"]

    assert [address_hidden(n) for n in (10, 100, 300, 10_000)] == [False] * 4


def test_pages_of_a_batch_are_read_in_slices(monkeypatch):
    """However many pages a batch has, few are Python objects at one time."""
    made = [f'<a href="/p{i}">t{i}</a>' if i % 7 else None for i in range(200)]
    urls = ["https://a.cl/"] * 200
    sizes, real = [], pa.array

    def counted(values, **kinds):
        values = list(values)
        sizes.append(len(values))
        return real(values, **kinds)

    html, base = real(made), real(urls)
    monkeypatch.setattr(markup.pa, "array", counted)
    assert markup._facts(html).to_pylist() == [read_markup(h) for h in made]
    linked = markup._facts_with_links(html, base).to_pylist()
    assert linked == [read_markup(h, "https://a.cl/") for h in made]
    assert max(sizes) <= 64 and sum(sizes) == 400
