"""Benchmark decontamination: a broadcast set of normalised test n-grams against all training words.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. A window
is ``width`` consecutive words of an item, or the whole of a shorter item. The sorted hashes of all
windows are broadcast; a document's rolling hashes are looked up at every word, hits are verified
against the window's words, and the hit words and items are returned.

The broadcast holds at most ``block_windows`` windows (about 100 bytes each): a larger benchmark is
searched in as many passes as it takes, each adding to the hits of the pass before.

Nulls: a null text has no words and no hits; a null item id is dropped from the items, its windows
still count as hits. Empty tables give no hits. Repeated items and rows are treated one by one.
Other columns are kept by ``clean``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import on_arrow, require, small_batches, written
from .words import ALNUM, FOLD, shingles, text_slices, words

FOUND = "doc_id bigint, text string, n_words bigint, spans array<bigint>, items array<bigint>"


class Windows:
    """Windows of a set of items: for each width the sorted hashes, and the words and items of each."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int):
        found: dict[int, dict[int, list[tuple[bytes, list[int | None]]]]] = {}
        for item_id, text in items:
            raw, off = np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())])
            starts, ends, counts, h = words(raw, off, ALNUM)
            if not len(h):
                continue
            w = min(width, len(h))
            grams, _ = shingles(h, counts, w)
            parts = [FOLD[raw[a:b]].tobytes() for a, b in zip(starts, ends, strict=True)]
            for k, g in enumerate(grams.tolist()):
                same = found.setdefault(w, {}).setdefault(g, [])
                gram = b" ".join(parts[k : k + w])
                for known, owners in same:
                    if known == gram:
                        owners.append(item_id)
                        break
                else:
                    same.append((gram, [item_id]))
        self.tables = []
        for w, grams in sorted(found.items()):
            keys = np.array(sorted(grams), np.uint64)
            sieve = np.zeros(1 << 20, bool)
            sieve[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((w, keys, sieve, [[(g, sorted({i for i in o if i is not None})) for g, o in grams[k]] for k in keys.tolist()]))

    def search(self, raw: np.ndarray, off: np.ndarray):
        """Words per text; hit spans (text, first word, width); items as a set for each text that has hits."""
        starts, ends, counts, h = words(raw, off, ALNUM)
        first, hits, items = np.cumsum(counts) - counts, [], {}
        folded = None
        for w, keys, sieve, grams in self.tables:
            g, per = shingles(h, np.where(counts >= w, counts, 0), w) if (counts >= w).all() else _long_enough(h, counts, w)
            at = np.flatnonzero(sieve[(g >> np.uint64(44)).astype(np.int64)])
            where = np.minimum(np.searchsorted(keys, g[at]), len(keys) - 1)
            ok = keys[where] == g[at]
            at, where = at[ok], where[ok]
            if not len(at):
                continue
            base = np.cumsum(per) - per
            doc = np.searchsorted(np.cumsum(per), at, "right")
            word = at - base[doc] + first[doc]
            folded = FOLD[raw].tobytes() if folded is None else folded
            for d, k, x in zip(doc.tolist(), word.tolist(), where.tolist(), strict=True):
                text = b" ".join(folded[a:b] for a, b in zip(starts[k : k + w].tolist(), ends[k : k + w].tolist(), strict=True))
                for gram, owners in grams[x]:
                    if gram == text:
                        hits.append((d, k - int(first[d]), w))
                        items.setdefault(d, set()).update(owners)
        return counts, hits, items


def _long_enough(h: np.ndarray, counts: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of texts with at least ``w`` words only."""
    long = counts >= w
    g, per = shingles(h[np.repeat(long, counts)], counts[long], w)
    out = np.zeros(len(counts), np.int64)
    out[long] = per
    return g, out


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    """Union of (first, width) spans as a flat list first, end, first, end, ..."""
    out: list[int] = []
    for a, w in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], a + w)
        else:
            out += [a, a + w]
    return out


def find(documents: DataFrame, benchmark: DataFrame, width: int = 10, block_windows: int = 1 << 20) -> DataFrame:
    """Per document: doc_id, text, n_words, spans (hit words: first, end, first, end, ...), items."""
    spark = documents.sparkSession
    listed = require(benchmark, "item_id", "text")
    # an item has fewer windows than characters
    blocks = max(1, -(-int(listed.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // (6 * block_windows)))
    found = require(documents, "doc_id", "text").select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<bigint>").alias("items"))
    for block in range(blocks):
        part = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.toLocalIterator()])

        def run(batches, shared=shared):
            windows = Windows(shared.value, width)
            for batch in batches:
                for i, j, raw, off in text_slices(batch.column(1)):
                    counts, hits, items = windows.search(raw, off)
                    spans, owners = batch.column(3).slice(i, j - i).to_pylist(), batch.column(4).slice(i, j - i).to_pylist()
                    new: dict[int, list] = {}
                    for d, a, w in hits:
                        new.setdefault(d, []).append((a, w))
                    for d, more in new.items():
                        old = spans[d]
                        spans[d] = _merge([(a, b - a) for a, b in zip(old[::2], old[1::2], strict=True)] + more)
                        owners[d] = sorted(set(owners[d]) | items[d])
                    yield (batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), counts, pa.array(spans, pa.list_(pa.int64())), pa.array(owners, pa.list_(pa.int64())))

        found = on_arrow(found, run, FOUND)
        if block + 1 < blocks:
            found = written(found, "decontamination")
    return found


def n_hit() -> F.Column:
    """Hit words of a row of ``find``."""
    return F.expr("aggregate(spans, 0L, (a, x) -> x - a)")


def items_digest() -> F.Column:
    """sha256 of the items sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",").cast("binary"), 256)


def _without(raw: bytes, spans: list[int]) -> str:
    data, off = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    starts, ends, _, _ = words(data, off, ALNUM)
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]]).decode()


def clean(documents: DataFrame, benchmark: DataFrame, remove: str = "documents", width: int = 10, block_chars: int = 64 << 20) -> DataFrame:
    """The documents without those that hold benchmark windows (``remove="documents"``), or with the hit words cut
    out of their texts and n_chars, if there is one, counted anew (``remove="spans"``). Rows and columns stay otherwise.

    A benchmark of more than ``block_chars`` characters is searched in blocks. Spans of all blocks are found in the texts as given, then cut."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    spark, columns, keep_rows = documents.sparkSession, documents.columns, remove == "spans"
    listed = require(benchmark, "item_id", "text")
    blocks = max(1, -(-int(listed.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // block_chars))
    text_at, chars_at, n = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None, len(columns)
    state = documents.withColumn("__spans", F.array().cast("array<bigint>")) if keep_rows else documents
    wide = state.schema
    for block in range(blocks):
        items = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        shared, last = spark.sparkContext.broadcast([tuple(r) for r in items.toLocalIterator()]), block + 1 == blocks

        def run(batches, shared=shared, last=last):
            windows = Windows(shared.value, width)
            for batch in batches:
                for i, j, raw, off in text_slices(batch.column(text_at)):
                    part = batch.slice(i, j - i)
                    _, hits, _ = windows.search(raw, off)
                    by: dict[int, list] = {}
                    for d, a, w in hits:
                        by.setdefault(d, []).append((a, w))
                    if not keep_rows:
                        good = np.ones(j - i, bool)
                        good[list(by)] = False
                        yield part.filter(pa.array(good))
                        continue
                    spans = part.column(n).to_pylist()
                    for d, more in by.items():
                        spans[d] = _merge([(a, b - a) for a, b in zip(spans[d][::2], spans[d][1::2], strict=True)] + more)
                    if not last:
                        yield part.set_column(n, part.schema.field(n), pa.array(spans, part.column(n).type))
                        continue
                    part = pa.RecordBatch.from_arrays(part.columns[:n], schema=pa.schema([part.schema.field(k) for k in range(n)]))
                    cut = [d for d, x in enumerate(spans) if x]
                    if cut:
                        texts = part.column(text_at).to_pylist()
                        for d in cut:
                            texts[d] = _without(raw[off[d] : off[d + 1]].tobytes(), spans[d])
                        part = part.set_column(text_at, part.schema.field(text_at), pa.array(texts, part.column(text_at).type))
                        if chars_at is not None:
                            chars = part.column(chars_at).to_pylist()
                            for d in cut:
                                chars[d] = len(texts[d])
                            part = part.set_column(chars_at, part.schema.field(chars_at), pa.array(chars, part.column(chars_at).type))
                    yield part

        small_batches(spark)
        state = state.mapInArrow(run, documents.schema if last else wide)
        if not last:
            state = written(state, "decontamination")
    return state
