"""Byte-level BPE by monoid tree reduction.

A piece (one match of the split pattern) is encoded by halves. Two encoded
neighbours are joined by encoding a window around their border anew: the last
``k`` tokens of the left and the first ``k`` of the right, ``k`` doubling. The
join is done when the window starts with the left's own token and ends with the
right's own token (or reaches the end of that side). Then every adjacent pair
of the result also stands in a correct encoding, and a sequence whose adjacent
pairs are all stable under the merges is the encoding of its bytes, so tokens
outside the window cannot change. Pieces never merge with each other: joining
them is plain concatenation, and so is decoding.

Defined results: NULL text is encoded as empty, with no ids; repeated rows are
encoded each on their own; an empty table gives no rows; any ``doc_id`` is kept;
extra columns are ignored.
"""

import base64
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from pagelens.llm.worker import document_batches, hold

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
# Bytes merged without a further split, and ids decoded without one.
LEAF_BYTES = 32
LEAF_IDS = 4096
# Pieces per generation of the memo; two generations are held at most.
MEMO_PIECES = 400_000
# Documents returned in one Arrow batch.
OUT_DOCS = 256

_NONE = 1 << 60


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class TreeBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._split = regex.compile(pattern).findall
        self._memo: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _merge_short(self, piece: bytes) -> list[bytes]:
        rank = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
        while pairs:
            best = min(pairs)
            if best == _NONE:
                break
            i = pairs.index(best)
            joined = parts[i] + parts[i + 1]
            parts[i : i + 2] = [joined]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + joined, _NONE)
            if i < len(pairs):
                pairs[i] = rank(joined + parts[i + 1], _NONE)
        return parts

    def _merge_long(self, piece: bytes) -> list[bytes]:
        """The same merges with a heap, for windows that grew large."""
        rank = self.ranks.get
        parts: list = [piece[i : i + 1] for i in range(len(piece))]
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap = []
        for i in range(len(parts) - 1):
            found = rank(piece[i : i + 2])
            if found is not None:
                heap.append((found, i))
        heapify(heap)
        while heap:
            found, i = heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts):
                continue
            joined = parts[i] + parts[j]
            if rank(joined) != found:
                continue
            parts[i], parts[j] = joined, None
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
                found = rank(joined + parts[k])
                if found is not None:
                    heappush(heap, (found, i))
            h = before[i]
            if h >= 0:
                found = rank(parts[h] + joined)
                if found is not None:
                    heappush(heap, (found, h))
        return [p for p in parts if p is not None]

    def merge(self, piece: bytes) -> list[bytes]:
        if len(piece) <= 4 * LEAF_BYTES:
            return self._merge_short(piece)
        return self._merge_long(piece)

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The monoid's operation on encodings of adjacent bytes."""
        if not left or not right:
            return left or right
        k = 1
        while True:
            head, tail = left[-k:], right[:k]
            window = self.merge(b"".join(head) + b"".join(tail))
            stable_left = k >= len(left) or window[0] == head[0]
            stable_right = k >= len(right) or window[-1] == tail[-1]
            if stable_left and stable_right:
                return left[:-k] + window + right[k:]
            k *= 2

    def tree(self, piece: bytes) -> list[bytes]:
        if len(piece) <= LEAF_BYTES:
            return self._merge_short(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one match; a whole match in the vocabulary is that token."""
        raw = piece.encode("utf-8")
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else [self.ranks[t] for t in self.tree(raw)]
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        memo = self._memo
        pieces = self._split(text or "")
        try:
            return b"".join(map(memo.__getitem__, pieces))
        except KeyError:
            pass
        if len(memo) > MEMO_PIECES:
            self._old, self._memo = memo, {}
            memo = self._memo
        long = {}
        for piece in set(pieces).difference(memo):
            ids = self._old.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
            if len(piece) > 4 * LEAF_BYTES:
                long[piece] = ids
            else:
                memo[piece] = ids
        if long:
            return b"".join(long[p] if p in long else memo[p] for p in pieces)
        return b"".join(map(memo.__getitem__, pieces))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids; halves are decoded and concatenated."""
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def coder_of(path: str) -> TreeBpe:
    """The coder of this worker process, so that tasks share its memo."""
    return hold(("bytes", path), lambda: TreeBpe(read_ranks(path)))


def _mapped(df: DataFrame, column: str, out: str, path: str, work) -> DataFrame:
    document_batches(df.sparkSession)

    def run(batches):
        coder = coder_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_DOCS):
                part = batch.slice(at, OUT_DOCS)
                made = [work(coder, v) for v in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(made, pa.binary())],
                    names=[*part.schema.names, out],
                )

    chosen = df.select("doc_id", column)
    fields = [*chosen.schema.fields, T.StructField(out, T.BinaryType())]
    return chosen.mapInArrow(run, T.StructType(fields))


def encode_documents(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian unsigned 32-bit) of whole texts."""

    def work(coder, text):
        return coder.encode(text)

    return _mapped(docs, "text", "ids", path, work).drop("text")


def decode_documents(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """Adds ``decoded``, the bytes of ``ids`` (NULL ids: none)."""

    def work(coder, ids):
        return coder.decode(np.frombuffer(ids or b"", "<u4"))

    return _mapped(encoded, "ids", "decoded", path, work)
