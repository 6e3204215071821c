"""Token operators: word memo, byte BPE, id files, packing."""

import io
import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from edge_data import SF
from pagelens.llm import bytebpe, idfiles, packing, words
from pagelens.llm.queries import QUERIES

LIBRARY = Tokenizer.from_file(words.WORD_TOKENIZER)
LIBRARY.encode_special_tokens = True
RANKS = bytebpe.read_ranks()
PLAIN = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
)
CODER = bytebpe.TreeBpe(RANKS)


def library_ids(text, end):
    found = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return np.array([*found, end], dtype="<u4")


# --- words ---------------------------------------------------------------------


@pytest.mark.parametrize(
    "alphabet", ["aAbÉéİßẞΣσ.,'ś̱hH1 2\n\x1c,.()ſKǅ", ", . aB\n'", "aÀ\xa0\x85\t, .ªµ²"]
)
def test_memo_gives_the_library_s_ids(alphabet):
    rng, encoder = random.Random(7), words.WordEncoder()
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(20))) for _ in range(4000)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids == library_ids(text, 0)[:-1].tobytes(), text


def test_memo_may_turn_over(monkeypatch):
    monkeypatch.setattr(words, "MEMO_PARTS", 20)
    texts = [f"wort{i} the. Of{i % 7}, <|endoftext|>" for i in range(300)]
    encoder = words.WordEncoder()
    got = [ids for at in range(0, 300, 9) for ids in encoder.encode(texts[at : at + 9])]
    assert got == [library_ids(t, 0)[:-1].tobytes() for t in texts]


# --- byte BPE -------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab ", max_size=300)))
def test_tree_equals_plain_merges(text):
    ids = np.frombuffer(CODER.encode(text), "<u4")
    assert ids.tolist() == PLAIN.encode_ordinary(text)
    assert CODER.decode(ids) == text.encode("utf-8")


def test_long_pieces_and_joins():
    rng = random.Random(3)
    for alphabet in ("ab", "=-", "01", "eationing", "aé"):
        for size in (33, 129, 1000, 9000):
            text = "".join(rng.choice(alphabet) for _ in range(size))
            assert np.frombuffer(CODER.encode(text), "<u4").tolist() == PLAIN.encode_ordinary(text)
    raw = b"tionererationing" * 9
    halves = [CODER.merge(raw[:50]), CODER.merge(raw[50:])]
    assert CODER.join(*halves) == CODER.merge(raw) == CODER._merge_long(raw)


def test_op4_on_all_texts(spark, texts):
    rows = {r.doc_id: r for r in QUERIES["op4_tree_byte_bpe"](spark, SF).collect()}
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        ids = np.array(PLAIN.encode_ordinary(text or ""), dtype="<u4")
        assert rows[doc_id][1:] == (
            len(ids), sha256(ids.tobytes()).hexdigest(), sha256((text or "").encode()).hexdigest()
        )


def test_bpe_edges(edges, empty):
    decoded = bytebpe.decode_documents(bytebpe.encode_documents(edges)).collect()
    assert sorted(bytes(r.decoded).decode() for r in decoded) == sorted(
        r.text or "" for r in edges.collect()
    )
    assert bytebpe.decode_documents(bytebpe.encode_documents(empty)).count() == 0


# --- id files --------------------------------------------------------------------


def test_random_access():
    rng = np.random.default_rng(5)
    ids = np.concatenate(
        [rng.integers(0, 300, 5000), rng.integers(0, 1 << 32, 900), [0, 255, 256, 65535, 65536]]
    ).astype(np.uint32)
    rng.shuffle(ids)
    raw = b"".join(idfiles.file_bytes([1, None], ids, np.array([0, 3000, len(ids)])))
    opened = idfiles.IdFile(io.BytesIO(raw))
    assert opened.doc_ids() == [1, None] and opened.starts().tolist() == [0, 3000, len(ids)]
    assert [opened.get(i) for i in range(len(ids))] == ids.tolist()
    for a, b in ((0, len(ids)), (511, 513), (512, 512), (1023, 4097), (5900, len(ids))):
        assert opened.slice(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        opened.get(len(ids))


def test_files_round_trip(spark, docs, texts, tmp_path):
    folder = f"file://{tmp_path}/ids"
    listed = idfiles.write_id_files(docs, folder, file_ids=3000)
    assert listed.count() > 3
    rows = idfiles.read_id_files(listed, folder, with_ids=True).orderBy("start").collect()
    start = 0
    for (doc_id, text), row in zip(texts, rows, strict=True):
        ids = library_ids(text, idfiles.END_ID)
        assert (row.doc_id, row.start, row.n_tokens) == (doc_id, start, len(ids))
        assert bytes(row.ids) == ids.tobytes() and row.ids_crc32 == zlib.crc32(ids.tobytes())
        start += len(ids)


def test_op6_leaves_no_files(spark, texts):
    from pathlib import Path

    from pagelens.operators.shared import shared_folder

    rows = QUERIES["op6_addressable_id_files"](spark, SF).collect()
    assert len(rows) == len(texts)
    folder = shared_folder(spark).removeprefix("file://")
    assert not list(Path(folder).glob("ids-*"))


def test_file_edges(edges, empty, tmp_path):
    rows = idfiles.round_trip(edges, f"file://{tmp_path}/a").orderBy("start").collect()
    want = Counter((r.doc_id, len(library_ids(r.text, 2))) for r in edges.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == want
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    assert rows[0].doc_id is None
    assert idfiles.round_trip(empty, f"file://{tmp_path}/b").count() == 0


# --- packing ---------------------------------------------------------------------


def check_pieces(pieces, documents, window=packing.WINDOW):
    """Pieces cover each document once; sequences are gapless and short enough."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for doc_id, own in by_doc.items():
        left = Counter()
        for p in own:
            left[p.start, p.length, p.ids_crc32, p.doc_tokens] += 1
        want = Counter()
        for text in documents[doc_id]:
            ids = library_ids(text, packing.END_ID)
            for s in range(0, len(ids), window):
                part = ids[s : s + window]
                want[s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
        assert left == want
    assert set(by_doc) == set(documents)
    used = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        used += at
    return 1 - used / (window * max(len(by_sequence), 1))


def test_op9_packs_all_with_little_padding(spark, texts):
    pieces = QUERIES["op9_nnls_packing"](spark, SF).collect()
    assert check_pieces(pieces, {d: [t] for d, t in texts}) < 0.03


def test_packing_edges(edges, empty):
    documents = {}
    for r in edges.collect():
        documents.setdefault(r.doc_id, []).append(r.text)
    check_pieces(packing.pack_documents(edges).collect(), documents)
    check_pieces(packing.pack_documents(edges, window=300).collect(), documents, 300)
    assert packing.pack_documents(empty).count() == 0


def test_pieces_may_carry_ids(edges):
    rows = packing.token_pieces(edges, with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(2)
    columns, target = rng.random((40, 12)), rng.random(12)
    x = packing.nnls(columns, target)
    slope = columns @ (target - x @ columns)
    assert x.min() >= 0 and slope.max() < 1e-6 and np.abs(slope[x > 0]).max() < 1e-6


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 5000), max_size=30))
def test_plan_uses_each_piece_once(histogram):
    plan = packing.solve(histogram, bins=64)
    used = Counter()
    for pattern, times in zip(plan.patterns, plan.repeats):
        assert sum(pattern) <= 64 and times > 0
        for size in pattern:
            used[size] += times
    assert used == Counter(histogram)


def test_ranks_do_not_depend_on_slices(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "LEAST_SLICES", 3)
    some = packing.pack_documents(docs).collect()
    check_pieces(some, {r.doc_id: [r.text] for r in docs.collect()})
