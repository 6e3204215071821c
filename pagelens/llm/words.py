"""Token ids of whole texts by the tokenizers library, with a bounded word memo.

The word tokenizer drops white space and never forms a token across it, so the
ids of a text are the ids of its space-separated parts in order. Parts repeat
heavily; the library encodes each one once while it stays in the memo.
"""

import os

import numpy as np
import public_tokenizers

from pagelens.llm.worker import hold

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

# Parts held per generation of the memo; two generations are held at most.
MEMO_PARTS = 600_000
# Characters of text whose parts are looked up together.
SLICE_CHARS = 2_000_000


def _plain(part: str) -> tuple[str, str]:
    """A part with the same ids before its closing mark, and that mark.

    The tokenizer lowers case letter by letter, and a comma or full stop after
    a letter is a token of its own. Parts with characters from U+0300 on
    (combining marks, sigma) and the dotted capital I are left as they are.
    """
    if max(part, default="") >= "\u0300" or "\u0130" in part:
        return part, ""
    mark = part[-1:]
    if (mark == "," or mark == ".") and part[-2:-1].isalpha():
        plain = part[:-1]
    else:
        plain, mark = part, ""
    if not plain.islower():
        plain = plain.lower()
    return (part, "") if plain == part else (plain, mark)


def _kinds() -> bytes:
    """Per Latin-1 character: space, letter or digit, or other."""
    kinds = bytearray(256)
    for code in range(256):
        c = chr(code)
        space = c in " \t\n\v\f\r\x85\xa0"
        kinds[code] = ord(" " if space else "a" if c.isalnum() else "!")
    return bytes(kinds)


_KINDS = _kinds()


def _parts(text: str) -> list[str]:
    """Space-separated parts with the ids of the text.

    In Latin-1 text without two marks in a row, letters may be lowered and a
    comma or full stop set apart: the tokenizer does the same to each letter,
    and a single mark is a token of its own. That leaves fewer different parts.
    """
    spaced = text.replace("\n", " ")
    try:
        kinds = text.encode("latin-1").translate(_KINDS)
    except UnicodeEncodeError:
        return spaced.split(" ")
    if b"!!" in kinds:
        return spaced.split(" ")
    return spaced.lower().replace(", ", " , ").replace(". ", " . ").split(" ")


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes.

    NULL counts as an empty text. Strings of special tokens inside a text are
    ordinary text.
    """

    def __init__(self, path: str = WORD_TOKENIZER, memo_parts: int | None = None):
        self._limit = memo_parts or MEMO_PARTS
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._lib = Tokenizer.from_file(path)
        self._lib.encode_special_tokens = True
        self._normalizer = self._lib.normalizer
        vocabulary = self._lib.get_vocab(with_added_tokens=False)
        self._closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._memo: dict[str, bytes] = {"": b""}
        self._old: dict[str, bytes] = {}

    def _learn(self, parts: set[str]) -> None:
        """Ids of new parts; words of letters share one call per thousand.

        The tokens of such a word end with the one that carries the word end.
        """
        words = [p for p in parts if p.isalpha() and p.islower() and max(p) < "\u0300"]
        joined = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
        # Normalising does not change these words.
        self._lib.normalizer = None
        found = self._lib.encode_batch_fast(joined, add_special_tokens=False)
        self._lib.normalizer = self._normalizer
        ids = np.concatenate(
            [np.empty(0, "<u4"), *(np.array(x.ids, "<u4") for x in found)]
        ).astype("<u4")
        ends = ((np.flatnonzero(self._closes[ids]) + 1) * 4).tolist()
        if len(ends) == len(words):
            raw = ids.tobytes()
            begin = 0
            for word, end in zip(words, ends):
                self._memo[word] = raw[begin:end]
                begin = end
            parts = parts.difference(words)
        if parts:
            self._learn_any(list(parts))

    def _learn_any(self, parts: list[str]) -> None:
        found = self._lib.encode(parts, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4").tobytes()
        of = np.array(found.word_ids, dtype=np.int64)
        ends = np.cumsum(np.bincount(of, minlength=len(parts))) * 4
        begin = 0
        for part, end in zip(parts, ends.tolist()):
            self._memo[part] = ids[begin:end]
            begin = end

    def _ready(self, fresh: set[str]) -> None:
        """Puts parts that the memo lacks into it."""
        if len(self._memo) + len(fresh) > self._limit:
            self._old, self._memo = self._memo, {"": b""}
        memo, old = self._memo, self._old
        unknown, derived = set(), []
        for part in fresh:
            known = old.get(part)
            if known is not None:
                memo[part] = known
                continue
            plain, mark = _plain(part)
            if plain is part:
                unknown.add(part)
                continue
            derived.append((part, plain, mark))
            if plain not in memo:
                known = old.get(plain)
                if known is None:
                    unknown.add(plain)
                else:
                    memo[plain] = known
        unknown |= {mark for _, _, mark in derived if mark and mark not in memo}
        if unknown:
            self._learn(unknown)
        for part, plain, mark in derived:
            memo[part] = memo[plain] + memo[mark]

    def encode(self, texts: list) -> list[bytes]:
        out: list[bytes] = []
        split: list[list[str]] = []
        held = 0
        for text in texts:
            parts = _parts(text or "")
            split.append(parts)
            held += len(text or "")
            if held >= SLICE_CHARS:
                out += self._join(split)
                split, held = [], 0
        return out + self._join(split) if split else out

    def _join(self, split: list[list[str]]) -> list[bytes]:
        lookup = self._memo.get
        found = [list(map(lookup, parts)) for parts in split]
        gaps = []
        for parts, row in zip(split, found):
            at = -1
            for _ in range(row.count(None)):
                at = row.index(None, at + 1)
                gaps.append((row, at, parts[at]))
        if gaps:
            self._ready({part for _, _, part in gaps})
            memo = self._memo
            for row, at, part in gaps:
                row[at] = memo[part]
        return [b"".join(row) for row in found]


def word_encoder(
    path: str = WORD_TOKENIZER, memo_parts: int | None = None
) -> WordEncoder:
    """The encoder of this worker process, so that tasks share its memo."""
    name = "words", path, memo_parts
    return hold(name, lambda: WordEncoder(path, memo_parts))
