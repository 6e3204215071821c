"""Token-id files of directly addressable codes.

An id is split into bytes. Level 0 holds the low byte of every id and one
continuation bit each; level 1 holds the next byte of the ids whose bit is set,
and so on. A rank directory counts the set bits before every block of 512, so
any id, or any run of ids, is found by one rank a level and nothing else is
decoded.

File layout, little-endian: magic ``PLDAC001``; ``u64`` documents, ids, levels
(3 words); ``u64`` chunks of each of the four levels; per document ``i64``
doc_id, then ``u8`` 1 if doc_id is not NULL, then ``u64`` start (one more than
documents); then per level the chunks (``u8``), the bitmap and the directory
(``u32`` a block). The last level needs no bitmap and has none.

Defined results: NULL text has the end id only; rows are ordered by doc_id
(NULL first), then text; repeated rows are kept; an empty table writes no file
and reads back as no rows; extra columns are ignored.
"""

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pagelens.llm.words import WORD_TOKENIZER, word_encoder
from pagelens.llm.worker import document_batches
from pagelens.operators.shared import cut, taken

MAGIC = b"PLDAC001"
END_ID = 2
BLOCK_BITS = 512
LEVELS = 4
# Ids held in memory before a file is closed.
FILE_IDS = 8_000_000
# Ids read back at once.
READ_IDS = 1_000_000


def _filesystem(path: str):
    return pyarrow.fs.FileSystem.from_uri(path)


def dac_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, bitmap and directory of each level."""
    out = []
    rest = ids
    while True:
        chunks = (rest & 0xFF).astype(np.uint8)
        rest = rest >> 8
        more = rest > 0
        if not more.any():
            out.append((chunks, np.empty(0, np.uint8), np.empty(0, "<u4")))
            return out
        per_block = np.add.reduceat(
            more, np.arange(0, len(more), BLOCK_BITS), dtype=np.int64
        )
        before = np.concatenate([[0], np.cumsum(per_block)[:-1]]).astype("<u4")
        out.append((chunks, np.packbits(more, bitorder="little"), before))
        rest = rest[more]


def file_bytes(doc_ids: list, ids: np.ndarray, starts: np.ndarray):
    """The sections of one file."""
    levels = dac_levels(ids)
    sizes = [len(c) for c, _, _ in levels] + [0] * (LEVELS - len(levels))
    yield MAGIC
    yield np.array([len(doc_ids), len(ids), len(levels), *sizes], "<u8").tobytes()
    yield np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    yield bytes(d is not None for d in doc_ids)
    yield starts.astype("<u8").tobytes()
    for chunks, bits, before in levels:
        yield chunks.tobytes()
        yield bits.tobytes()
        yield before.tobytes()


class IdFile:
    """Random access to one file; ``source`` is a seekable binary file."""

    def __init__(self, source):
        self.source = source
        if self._read(0, 8) != MAGIC:
            raise ValueError("not an id file")
        words = np.frombuffer(self._read(8, 56), "<u8").astype(np.int64).tolist()
        self.docs, self.ids, levels = words[:3]
        at = 64 + 9 * self.docs
        self._starts = at
        at += 8 * (self.docs + 1)
        self.levels = []
        for k, size in enumerate(words[3 : 3 + levels]):
            bits = -(-size // 8) if k < levels - 1 else 0
            blocks = -(-size // BLOCK_BITS) if k < levels - 1 else 0
            self.levels.append((size, at, at + size, at + size + bits))
            at += size + bits + 4 * blocks

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def doc_ids(self) -> list:
        ids = np.frombuffer(self._read(64, 8 * self.docs), "<i8").tolist()
        known = self._read(64 + 8 * self.docs, self.docs)
        return [d if k else None for d, k in zip(ids, known)]

    def starts(self) -> np.ndarray:
        raw = self._read(self._starts, 8 * (self.docs + 1))
        return np.frombuffer(raw, "<u8").astype(np.int64)

    def _bits(self, level: int, first: int, last: int):
        """Continuation bits of ``[first, last)`` and the set bits before."""
        _, _, bitmap, directory = self.levels[level]
        block = first // BLOCK_BITS
        byte = block * BLOCK_BITS // 8
        raw = self._read(bitmap + byte, -(-last // 8) - byte)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
        skip = first - byte * 8
        before = int.from_bytes(self._read(directory + 4 * block, 4), "little")
        before += int(bits[:skip].sum())
        return bits[skip : skip + last - first].astype(bool), before

    def slice(self, first: int, last: int, level: int = 0) -> np.ndarray:
        """Ids ``first`` to ``last`` (exclusive), without decoding any other."""
        if first >= last:
            return np.empty(0, np.uint32)
        _, chunks, _, _ = self.levels[level]
        raw = self._read(chunks + first, last - first)
        out = np.frombuffer(raw, np.uint8).astype(np.uint32)
        if level < len(self.levels) - 1:
            more, before = self._bits(level, first, last)
            high = self.slice(before, before + int(more.sum()), level + 1)
            out[more] |= high << np.uint32(8)
        return out

    def get(self, i: int) -> int:
        if not 0 <= i < self.ids:
            raise IndexError(i)
        return int(self.slice(i, i + 1)[0])


_MANIFEST = (
    "part int, seq int, path string, n_docs bigint, n_ids bigint, n_bytes bigint"
)


def write_id_files(
    docs: DataFrame,
    folder: str,
    end_id: int = END_ID,
    tokenizer: str = WORD_TOKENIZER,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Writes files in doc_id order below ``folder``; returns their list.

    A file counts only if it is in the returned list. Each attempt of a task
    writes under names of its own, so a lost executor or a second attempt
    leaves unlisted files and never a mixed one. The list is checkpointed.
    """
    end = int(end_id).to_bytes(4, "little")
    document_batches(docs.sparkSession)

    def run(batches):
        encoder = word_encoder(tokenizer)
        store, root = _filesystem(folder)
        part = TaskContext.get().partitionId()
        attempt = uuid.uuid4().hex
        held: list[bytes] = []
        names: list = []
        size = seq = 0

        def close():
            nonlocal held, names, size, seq
            starts = np.cumsum([0] + [len(x) // 4 for x in held])
            ids = np.frombuffer(b"".join(held), "<u4")
            path = f"{root}/ids-{part:06d}-{seq:05d}-{attempt}.dac"
            written = 0
            with store.open_output_stream(path) as out:
                for section in file_bytes(names, ids, starts):
                    out.write(section)
                    written += len(section)
            row = pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "seq": pa.array([seq], pa.int32()),
                    "path": [path.removeprefix(root + "/")],
                    "n_docs": [len(names)],
                    "n_ids": [len(ids)],
                    "n_bytes": [written],
                }
            )
            held, names, size, seq = [], [], 0, seq + 1
            return row

        store.create_dir(root, recursive=True)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                encoded = encoder.encode(texts[at : at + 256])
                for doc_id, ids in zip(doc_ids[at : at + 256], encoded):
                    held.append(ids + end)
                    names.append(doc_id)
                    size += len(ids) // 4 + 1
                    if size >= file_ids:
                        yield close()
        if held:
            yield close()

    placed = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange(F.asc_nulls_first("doc_id"))
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    )
    return cut(placed.mapInArrow(run, _MANIFEST))


def with_file_starts(files: DataFrame) -> DataFrame:
    """Adds ``first``: ids in all files before. Sums per part, then over parts."""
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        files.groupBy("part")
        .agg(F.sum("n_ids").alias("__n"))
        .withColumn("__base", F.sum("__n").over(earlier.orderBy("part")))
        .select("part", F.coalesce("__base", F.lit(0)).alias("__base"))
    )
    inside = F.sum("n_ids").over(earlier.partitionBy("part").orderBy("seq"))
    return (
        files.withColumn("__inside", F.coalesce(inside, F.lit(0)))
        .join(parts, "part")
        .withColumn("first", F.col("__base") + F.col("__inside"))
        .drop("__base", "__inside")
    )


_READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_id_files(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of the listed files, read by ranges of whole documents."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def read(path: str, first: int):
        store, root = _filesystem(folder)
        with store.open_input_file(f"{root}/{path}") as source:
            opened = IdFile(source)
            doc_ids, starts = opened.doc_ids(), opened.starts()
            at = 0
            while at < opened.docs:
                stop = np.searchsorted(starts, starts[at] + READ_IDS, side="right") - 1
                stop = min(max(int(stop), at + 1), opened.docs)
                ids = opened.slice(int(starts[at]), int(starts[stop])).astype("<u4")
                cuts = (starts[at : stop + 1] - starts[at]).tolist()
                parts = [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
                columns = [
                    pa.array(doc_ids[at:stop], pa.int64()),
                    pa.array(starts[at:stop] + first),
                    pa.array(np.diff(cuts)),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ] + ([pa.array(parts, pa.binary())] if with_ids else [])
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at = stop

    def run(batches):
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns)):
                yield from read(path, first)

    schema = _READ + (", ids binary" if with_ids else "")
    count = max(1, files.count())
    tasks = min(count, 4 * files.sparkSession.sparkContext.defaultParallelism)
    listed = with_file_starts(files).select("path", "first")
    return listed.repartition(tasks, "path").mapInArrow(run, schema)


def round_trip(docs: DataFrame, folder: str, **options) -> DataFrame:
    """Writes, reads back, keeps the digests and removes the files."""
    return taken(read_id_files(write_id_files(docs, folder, **options), folder), folder)
