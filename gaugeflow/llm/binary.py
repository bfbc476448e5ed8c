"""Token-ID output in binary files of patched frame-of-reference blocks, and reading them back.

File (little-endian): magic ``PFB1``, then segments of about ``SEGMENT`` ids: bytes that follow,
counts of documents and of ids (u64); document ids (i64, the smallest value for null); two coded series, ids per document
and the ids themselves. A series
is: values and blocks (u64), block minimum (u32 each), packed width (u8 each), exceptions per
block (u16 each), start of each block in the payload in 32-bit words (u64 each, the index), payload,
exception places in the block (u16 each), exception values (u32 each). A block has 1024 values in
32 lanes; the block's minimum is subtracted, the rest packed at the width that holds the given
percentile of it; larger values stand in the exception list. The index lets a reader decode a range
of ids without the blocks before it.

Documents are put in ascending order of doc_id (equal ids by text, null first) by a range
partitioning; every partition writes its files in order, so file names sort as the ids do. Files
hold about ``file_ids`` ids (a longer document stays whole). A file is written under a name of its
attempt and renamed, so repeated tasks leave the same files.

Nulls: a null text is empty (the end id alone). An empty table gives no files. Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import id_column, new_folder, on_arrow, require, written
from .tokens import encoder
from .words import text_slices

BLOCK, LANES, SEGMENT = 1024, 32, 1 << 20
NULL_ID = -(1 << 63)
MAGIC = b"PFB1"


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(m, 1024) values of ``width`` bits to (m, 32 * width) words; value k of a lane starts at bit k * width."""
    m = len(values)
    steps, out = values.reshape(m, BLOCK // LANES, LANES), np.zeros((m, width, LANES), np.uint32)
    for k in range(BLOCK // LANES):
        word, shift = divmod(k * width, 32)
        out[:, word] |= steps[:, k] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= steps[:, k] >> np.uint32(32 - shift)
    return out.reshape(m, width * LANES)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    m = len(words)
    lanes, out = words.reshape(m, width, LANES), np.empty((m, BLOCK // LANES, LANES), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for k in range(BLOCK // LANES):
        word, shift = divmod(k * width, 32)
        value = lanes[:, word] >> np.uint32(shift)
        if shift + width > 32:
            value = value | (lanes[:, word + 1] << np.uint32(32 - shift))
        out[:, k] = value & mask
    return out.reshape(m, BLOCK)


def encode_series(values: np.ndarray, percentile: float = 95.0) -> bytes:
    """The coded form of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, np.uint32)
    n = len(values)
    blocks = -(-n // BLOCK)
    full = np.resize(values, blocks * BLOCK) if n else values
    full[n:] = values[-1] if n else 0
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1, initial=0xFFFFFFFF).astype(np.uint32)
    rest = full - low[:, None]
    rank = min(BLOCK - 1, int(BLOCK * percentile / 100))
    typical = np.partition(rest, rank, axis=1)[:, rank] if blocks else np.zeros(0, np.uint32)
    width = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype(np.uint8)
    over = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    which, place = np.nonzero(over)
    starts = np.cumsum(width.astype(np.int64) * LANES) - width.astype(np.int64) * LANES
    payload = np.zeros(int(width.astype(np.int64).sum()) * LANES, np.uint32)
    for w in np.unique(width).tolist():
        if w:
            own = np.flatnonzero(width == w)
            payload[starts[own][:, None] + np.arange(w * LANES)] = _pack(rest[own] & np.uint32((1 << w) - 1), w)
    return b"".join([
        struct.pack("<QQ", n, blocks), low.astype("<u4").tobytes(), width.tobytes(), np.bincount(which, minlength=blocks).astype("<u2").tobytes(),
        starts.astype("<u8").tobytes(), payload.astype("<u4").tobytes(), place.astype("<u2").tobytes(), rest[which, place].astype("<u4").tobytes()])


def decode_series(blob: memoryview, at: int, first: int = 0, last: int | None = None) -> tuple[np.ndarray, int]:
    """Values first .. last - 1 of the series at byte ``at``, and the byte after the series."""
    n, blocks = struct.unpack_from("<QQ", blob, at)
    at += 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(blob, kind, count, at)
        at += got.nbytes
        return got

    low, width, more, starts = take("<u4", blocks), take("u1", blocks), take("<u2", blocks), take("<u8", blocks).astype(np.int64)
    payload = take("<u4", int(width.astype(np.int64).sum()) * LANES)
    place, extra = take("<u2", int(more.astype(np.int64).sum())), take("<u4", int(more.astype(np.int64).sum()))
    last = n if last is None else min(last, n)
    if last <= first:
        return np.zeros(0, np.uint32), at
    a, b = first // BLOCK, -(-last // BLOCK)
    rest = np.zeros((b - a, BLOCK), np.uint32)
    for w in np.unique(width[a:b]).tolist():
        if w:
            own = np.flatnonzero(width[a:b] == w)
            rest[own] = _unpack(payload[starts[a:b][own][:, None] + np.arange(w * LANES)], w)
    edge = np.append(0, np.cumsum(more.astype(np.int64)))
    rest[np.repeat(np.arange(b - a), more[a:b]), place[edge[a] : edge[b]]] = extra[edge[a] : edge[b]]
    return (rest + low[a:b, None]).reshape(-1)[first - a * BLOCK : last - a * BLOCK], at


def encode_segment(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, percentile: float = 95.0) -> bytes:
    body = b"".join([struct.pack("<QQ", len(doc_ids), len(ids)), doc_ids.astype("<i8").tobytes(), encode_series(counts, percentile), encode_series(ids, percentile)])
    return struct.pack("<Q", len(body)) + body


def decode_stream(read: Callable[[int], bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document ids, ids per document and ids of each segment; one segment is held at a time."""
    if read(4) != MAGIC:
        raise ValueError("not a token file")
    while head := read(8):
        size = struct.unpack("<Q", head)[0]
        view = memoryview(read(size))
        if len(view) != size:
            raise ValueError("damaged token file")
        docs, n = struct.unpack_from("<QQ", view, 0)
        doc_ids = np.frombuffer(view, "<i8", docs, 16)
        counts, at = decode_series(view, 16 + 8 * docs)
        ids, _ = decode_series(view, at)
        if len(ids) != n or len(counts) != docs:
            raise ValueError("damaged token file")
        yield doc_ids, counts.astype(np.int64), ids


class _File:
    """A file of the folder, written under a name of the task's attempt and renamed when whole."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.folder, recursive=True)
        self.name, self.docs, self.ids = name, 0, 0
        self.own = f"{self.folder}/.{name}.{TaskContext.get().taskAttemptId()}"
        self.out = self.store.open_output_stream(self.own)
        self.out.write(MAGIC)

    def add(self, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, percentile: float) -> None:
        self.out.write(encode_segment(doc_ids, counts, ids, percentile))
        self.docs, self.ids = self.docs + len(doc_ids), self.ids + len(ids)

    def close(self) -> None:
        self.out.close()
        self.store.move(self.own, f"{self.folder}/{self.name}")


def write_tokens(documents: DataFrame, folder: str, tokenizer: str, end_id: int, partitions: int, file_ids: int = 64 << 20, percentile: float = 95.0) -> DataFrame:
    """Write the files; a table of them: part, number, name, docs, ids."""

    def run(batches):
        known, part, number, file = encoder(tokenizer), TaskContext.get().partitionId(), 0, None
        doc_ids, counts, ids = [], [], []

        def segment():
            nonlocal file
            file = file or _File(folder, f"{part:07d}-{number:05d}.pfb")
            file.add(np.concatenate(doc_ids), np.concatenate(counts), np.concatenate(ids), percentile)
            doc_ids.clear(), counts.clear(), ids.clear()

        for batch in batches:
            for i, j, raw, off in text_slices(batch.column(1)):
                got, n = known.encode(raw, off)
                doc_ids.append(batch.column(0).slice(i, j - i).fill_null(NULL_ID).to_numpy())
                counts.append(n + 1), ids.append(np.insert(got, np.cumsum(n), end_id).astype(np.uint32))
                if sum(map(len, ids)) >= SEGMENT:
                    segment()
                if file and file.ids >= file_ids:
                    file.close()
                    yield ([part], [number], [file.name], [file.docs], [file.ids])
                    number, file = number + 1, None
        if ids:
            segment()
        if file:
            file.close()
            yield ([part], [number], [file.name], [file.docs], [file.ids])

    ordered = require(documents, "doc_id", "text").repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(on_arrow(ordered, run, "part int, number int, name string, docs bigint, ids bigint"), "token-files")


def read_tokens(folder: str, files: DataFrame, partitions: int) -> DataFrame:
    """Every document read back: doc_id, start (ids before it in all files), n_tokens, ids (binary, unsigned 32-bit)."""

    def run(batches):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                before = 0
                with store.open_input_stream(f"{path}/{name}") as source:
                    for doc_ids, counts, ids in decode_stream(source.read):
                        stop = np.cumsum(counts)
                        yield ([name] * len(counts), pa.array(doc_ids, mask=doc_ids == NULL_ID), before + stop - counts, counts, id_column(ids, counts))
                        before += len(ids)

    parts = on_arrow(files.select("name").repartition(partitions, "name"), run, "name string, doc_id bigint, start_in_file bigint, n_tokens bigint, ids binary")
    # one row per file, and the running total over them
    bases = files.select("name", (F.sum("ids").over(Window.orderBy("part", "number")) - F.col("ids")).alias("base"))
    return parts.join(F.broadcast(bases), "name").select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids")


def round_trip(documents: DataFrame, tokenizer: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """Write ``documents`` to a fresh folder below the shared one and read the files back."""
    folder = new_folder(documents.sparkSession, "token-ids")
    partitions = partitions or max(1, documents.rdd.getNumPartitions())
    return read_tokens(folder, write_tokens(documents, folder, tokenizer, end_id, partitions), partitions)
