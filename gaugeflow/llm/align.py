"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Each text gets a space in front and is encoded by a byte-level tokenizer (A, ``tokenizers`` file) and a
piece tokenizer with byte fallback (B, ``sentencepiece`` file, which adds that space itself). In every
batch two ``pandas.merge_asof`` keyed by document find, for each token's start, the other side's token
that covers it; both directions together are all overlaps. Where two overlapping tokens end at the same
byte, a group ends. Links are all pairs of A and B tokens of a group.

Texts are cut into segments before a space that follows a printable ASCII byte and is followed by no
space. No token of either side reaches over such a place, so each distinct segment is encoded
once a worker by the libraries (those beyond ``KEEP`` once a batch).

``link_counts`` counts in how many documents of the corpus an id pair is linked. A chunk of some 16 MB of
text hands on its distinct pairs once each, with the number of its documents that hold them, so neither
a frequent pair nor a long document makes a hot key; the corpus-wide counts come back to the chunk that
asked, never as one table for all.

Nulls: a null or empty text, and one whose token bytes do not give the text back (a U+2581 in it reads
as a space), has no tokens and zero counts. Null ids are kept; repeated rows are documents of their
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import on_arrow, require, written
from .words import span_hashes, text_slices

SLICE, CHUNK = 1 << 21, 1 << 24
#: A group with more pairs than this is first folded to its distinct ids with their numbers.
WIDE = 64
#: Segments a worker keeps (some 100 bytes each).
KEEP = 1 << 19
_SIDES: dict[str, "Side"] = {}
_MEMORY: dict[tuple[str, str], "Segments"] = {}


class Side:
    """A tokenizer: ids of segments (each starts with a space) and the bytes of each id."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True
            byte = {c: b for b, c in enumerate(_byte_letters())}
            vocab = library.get_vocab(with_added_tokens=False)
            pieces = [b""] * (max(library.get_vocab().values()) + 1)
            for word, i in vocab.items():
                pieces[i] = bytes(byte[c] for c in word)
            self.run = lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(model.id_to_piece(i) for i in range(model.get_piece_size()))]
            self.run = lambda texts: model.encode([t[1:] for t in texts], num_threads=1)
        self.pieces = pieces
        self.bits = max(1, (len(pieces) - 1).bit_length())
        self.size = np.array([len(p) for p in pieces], np.int64)
        width = len(str(len(pieces)))
        self.digits = np.frombuffer(b"".join(str(i).encode().ljust(width, b"\0") for i in range(len(pieces))), np.uint8).reshape(-1, width)

    def encode(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids one after the other, ids per segment, and whether a segment's token bytes are the segment."""
        got = self.run([s.decode("utf-8") for s in segments])
        same = np.array([b"".join([self.pieces[i] for i in ids]) == s for ids, s in zip(got, segments, strict=True)], bool)
        counts = np.array([len(ids) for ids in got], np.int64)
        return np.fromiter(chain.from_iterable(got), np.int64, int(counts.sum())), counts, same


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable Latin-1, else the next free code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Segments:
    """Segments a worker has encoded by both sides, known by their 64-bit hash.

    At most ``KEEP`` stay from batch to batch, the first that come, which are the frequent ones; others are encoded anew.
    """

    def __init__(self, sides: tuple[Side, Side]):
        self.sides = sides
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.counts = [[np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2]
        self.same = np.zeros(0, bool)

    def entries(self, hashes: np.ndarray, segments) -> np.ndarray:
        """The entry of each (distinct, ascending) hash; ``segments(places)`` gives the bytes of those not known yet."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        out = np.empty(len(hashes), np.int64)
        out[known] = self.entry[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            texts = segments(new)
            coded = [s.encode(texts) for s in self.sides]
            out[new] = len(self.same) + np.arange(len(new))
            self.flat = [np.concatenate([f, c[0]]) for f, c in zip(self.flat, coded, strict=True)]
            self.counts = [np.concatenate([f, c[1]]) for f, c in zip(self.counts, coded, strict=True)]
            self.same = np.concatenate([self.same, coded[0][2] & coded[1][2]])
            if len(self.same) <= KEEP:
                every = np.concatenate([self.hashes, hashes[new]])
                order = np.argsort(every, kind="stable")
                self.hashes, self.entry = every[order], np.concatenate([self.entry, out[new]])[order]
        return out

    def forget(self) -> None:
        """Drop the entries that are not kept."""
        n = len(self.hashes)
        if n < len(self.same):
            self.flat = [f[: int(c[:n].sum())] for f, c in zip(self.flat, self.counts, strict=True)]
            self.counts, self.same = [c[:n] for c in self.counts], self.same[:n]


def side(path: str) -> Side:
    """The worker's tokenizer for a file; kept between tasks."""
    if path not in _SIDES:
        _SIDES[path] = Side(path)
    return _SIDES[path]


def segments(left: str, right: str) -> Segments:
    """The worker's memory for two tokenizers; kept between tasks."""
    key = left, right
    if key not in _MEMORY:
        _MEMORY[key] = Segments((side(left), side(right)))
    return _MEMORY[key]


class Tokens(NamedTuple):
    """The tokens of one side in a batch: id, document, first byte and the byte after the last (over the batch)."""

    ids: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


class Aligned(NamedTuple):
    """Both sides of a batch; the overlaps (token of A, token of B) in order; the group of each token and the document of each group."""

    a: Tokens
    b: Tokens
    overlaps: tuple[np.ndarray, np.ndarray]
    group_a: np.ndarray
    group_b: np.ndarray
    group_doc: np.ndarray


def _gather(flat: np.ndarray, counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs numbered ``which`` of ``flat``, whose runs have the lengths ``counts``."""
    n = counts[which]
    stop = np.cumsum(n)
    return flat[np.repeat((np.cumsum(counts) - counts)[which] - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)]


def tokenise(raw: np.ndarray, off: np.ndarray, memory: Segments) -> list[Tokens]:
    """Tokens of both sides for the texts in ``raw``; a text that a side does not give back has none on either."""
    full = np.diff(off) > 0
    raw = np.insert(raw, off[:-1][full], 32)
    off = off + np.append(0, np.cumsum(full))
    cut = np.zeros(len(raw), bool)
    cut[1:-1] = (raw[1:-1] == 32) & (raw[:-2] > 32) & (raw[:-2] < 127) & (raw[2:] > 32)
    cut[off[:-1][full]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(raw))[: len(starts)]
    doc = np.searchsorted(off, starts, "right") - 1
    hashes, first, kind = np.unique(span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    blob = raw.tobytes()
    entry = memory.entries(hashes, lambda new: [blob[x:y] for x, y in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])[kind]
    lost = np.zeros(len(off) - 1, bool)
    lost[doc[~memory.same[entry]]] = True
    doc, entry = doc[~lost[doc]], entry[~lost[doc]]
    out = []
    for s, flat, counts in zip(memory.sides, memory.flat, memory.counts, strict=True):
        ids = _gather(flat, counts, entry)
        end = np.cumsum(s.size[ids])
        out.append(Tokens(ids, np.repeat(doc, counts[entry]), end - s.size[ids], end))
    memory.forget()
    return out


def align(a: Tokens, b: Tokens) -> Aligned:
    """Overlaps by an as-of merge in either direction, groups by equal ends."""
    left = pd.DataFrame({"at": a.start, "doc": a.doc, "a": np.arange(len(a.ids))})
    right = pd.DataFrame({"at": b.start, "doc": b.doc, "b": np.arange(len(b.ids))})
    down, up = pd.merge_asof(left, right, on="at", by="doc"), pd.merge_asof(right, left, on="at", by="doc")
    width = max(1, len(b.ids))
    both = np.concatenate([down["a"].to_numpy() * width + down["b"].to_numpy().astype(np.int64), up["a"].to_numpy().astype(np.int64) * width + up["b"].to_numpy()])
    both.sort(kind="stable")
    both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
    of_a, of_b = both // width, both % width
    last = a.end[of_a] == b.end[of_b]
    group = np.cumsum(last) - last
    group_a, group_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    group_a[of_a], group_b[of_b] = group, group
    return Aligned(a, b, (of_a, of_b), group_a, group_b, a.doc[of_a[last]])


def _folded(ids: np.ndarray, group: np.ndarray, wide: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, groups and numbers of tokens in order of the groups; equal ids of a wide group as one."""
    much = wide[group]
    if not much.any():
        return ids, group, np.ones(len(ids), np.int64)
    key, n = np.unique((group[much] << bits) | ids[much], return_counts=True)
    ids, number = np.concatenate([ids[~much], key & ((1 << bits) - 1)]), np.concatenate([np.ones(int((~much).sum()), np.int64), n])
    group = np.concatenate([group[~much], key >> bits])
    order = np.argsort(group, kind="stable")
    return ids[order], group[order], number[order]


def pairs(found: Aligned, sides: tuple[Side, Side]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id pair, links): each document's distinct linked id pairs and how often they are linked."""
    groups = len(found.group_doc)
    wide = np.bincount(found.group_a, minlength=groups) * np.bincount(found.group_b, minlength=groups) > WIDE
    a, ga, na = _folded(found.a.ids, found.group_a, wide, sides[0].bits)
    b, gb, nb = _folded(found.b.ids, found.group_b, wide, sides[1].bits)
    per = np.bincount(gb, minlength=groups)
    times = per[ga]
    x = np.repeat(np.arange(len(a)), times)
    y = np.repeat((np.cumsum(per) - per)[ga] - (np.cumsum(times) - times), times) + np.arange(len(x))
    bits = sides[0].bits + sides[1].bits
    key = (found.group_doc[ga[x]] << bits) | (a[x] << sides[1].bits) | b[y]
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    links = np.add.reduceat((na[x] * nb[y])[order], head) if len(head) else np.zeros(0, np.int64)
    return key[head] >> bits, key[head] & ((1 << bits) - 1), links


def written_groups(found: Aligned, sides: tuple[Side, Side], docs: int) -> list[bytes]:
    """Per document its groups as text: ids of A with commas, ``|``, ids of B, and ``;`` between groups."""
    groups = len(found.group_doc)
    na, nb = np.bincount(found.group_a, minlength=groups), np.bincount(found.group_b, minlength=groups)
    place_a = np.arange(len(found.a.ids)) + (np.cumsum(nb) - nb)[found.group_a]
    place_b = np.arange(len(found.b.ids)) + np.cumsum(na)[found.group_b]
    width = max(s.digits.shape[1] for s in sides)
    text = np.zeros((len(place_a) + len(place_b), width + 1), np.uint8)
    for s, t, place in ((sides[0], found.a, place_a), (sides[1], found.b, place_b)):
        text[place, : s.digits.shape[1]] = s.digits[t.ids]
    text[:, -1] = ord(",")
    stop = np.cumsum(na + nb)
    text[np.cumsum(na + nb) - nb - 1, -1] = ord("|")
    text[stop - 1, -1] = ord(";")
    final = np.flatnonzero(np.append(found.group_doc[1:] != found.group_doc[:-1], True)[:groups])
    text[stop[final] - 1, -1] = 0
    reach = np.zeros(docs, np.int64)
    tokens = np.cumsum((text > 0).sum(axis=1))
    reach[found.group_doc[final]] = tokens[stop[final] - 1]
    reach = np.append(0, np.maximum.accumulate(reach)) if docs else np.zeros(1, np.int64)
    blob = text[text > 0].tobytes()
    return [blob[x:y] for x, y in zip(reach[:-1].tolist(), reach[1:].tolist(), strict=True)]


def _batches(batches: Iterator[pa.RecordBatch], left: str, right: str) -> Iterator[tuple[pa.Array, int, Aligned]]:
    """(document ids, bytes of text, alignment) for slices of some 2 MB of text."""
    memory = segments(left, right)
    for batch in batches:
        for i, j, raw, off in text_slices(batch.column(1), SLICE):
            yield batch.column(0).slice(i, j - i), len(raw), align(*tokenise(raw, off, memory))


def alignments(documents: DataFrame, left: str, right: str) -> DataFrame:
    """Per document: doc_id, a_ids, b_ids, a_group, b_group (the group of each token, from 0 on), over_a and over_b (the overlapping tokens, by number)."""

    def run(batches):
        for doc_ids, _, x in _batches(batches, left, right):
            first = np.searchsorted(x.group_doc, np.arange(len(doc_ids)))
            edges = [np.searchsorted(d, np.arange(len(doc_ids) + 1)) for d in (x.a.doc, x.b.doc, x.a.doc[x.overlaps[0]])]

            def lists(values, edge):
                return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(values, pa.int64()))

            yield [doc_ids, lists(x.a.ids, edges[0]), lists(x.b.ids, edges[1]), lists(x.group_a - first[x.a.doc], edges[0]), lists(x.group_b - first[x.b.doc], edges[1]),
                   lists(x.overlaps[0] - edges[0][x.a.doc[x.overlaps[0]]], edges[2]), lists(x.overlaps[1] - edges[1][x.b.doc[x.overlaps[1]]], edges[2])]

    kinds = ", ".join(f"{c} array<bigint>" for c in ("a_ids", "b_ids", "a_group", "b_group", "over_a", "over_b"))
    return on_arrow(require(documents, "doc_id", "text"), run, f"doc_id bigint, {kinds}")


def _pack(places: np.ndarray, links: np.ndarray) -> bytes:
    """Ascending places as steps, and the links of each, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([np.diff(places, prepend=0), links]).astype("<i8").view("<u4").reshape(-1, 2).T.tobytes()) if len(places) else b""


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not blob:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<u4").reshape(2, -1).T
    steps, links = np.ascontiguousarray(words).view("<i8").reshape(2, -1)
    return np.cumsum(steps), links


_DOC = "doc_id bigint, n_a bigint, n_b bigint, n_overlaps bigint, n_groups bigint, n_links bigint"
_TALLIED = f"{_DOC}, n_best bigint, count_sum bigint, groups_sha256 string"


def link_counts(documents: DataFrame, left: str, right: str) -> DataFrame:
    """Per document the sizes of its alignment and how its links stand in the corpus.

    n_links counts pairs of tokens that share a group. An id pair's count is the number of documents that hold it linked;
    count_sum adds it up over the links; n_best counts links whose count is the highest of their A id. groups_sha256 is the
    digest of the groups in writing, '' without tokens.
    """

    def run(batches):
        sides, part, number, size = (side(left), side(right)), TaskContext.get().partitionId(), 0, 0
        rows, held = [], []

        def chunk():
            keys, place, docs = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            name, edge = (part << 32) + number, np.append(0, np.cumsum([len(k) for k in held]))
            bound = 0
            for doc_ids, columns, links, counts in rows:
                packed, at = [], 0
                for c in counts.tolist():
                    packed.append(_pack(place[edge[0] + bound + at : edge[0] + bound + at + c], links[at : at + c]))
                    at += c
                bound += at
                n = len(doc_ids)
                yield [pa.array([name] * n), pa.array([False] * n), doc_ids, *columns, pa.array(packed, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]
            yield [[name], [True], *[[None]] * 8, [keys], [docs]]

        for doc_ids, n_bytes, x in _batches(batches, left, right):
            n = len(doc_ids)
            doc, pair, links = pairs(x, sides)
            text = written_groups(x, sides, n)
            tally = [np.bincount(d, minlength=n) for d in (x.a.doc, x.b.doc, x.a.doc[x.overlaps[0]], x.group_doc)]
            tally.append(np.bincount(doc, links, minlength=n).astype(np.int64))
            rows.append((doc_ids, [*map(pa.array, tally), pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in text])], links, np.bincount(doc, minlength=n)))
            held.append(pair)
            size += n_bytes
            if size >= CHUNK:
                yield from chunk()
                rows, held, number, size = [], [], number + 1, 0
        if rows:
            yield from chunk()

    chunks = written(on_arrow(require(documents, "doc_id", "text"), run,
                              f"chunk bigint, head boolean, {_DOC}, groups_sha256 string, packed binary, keys array<bigint>, docs array<bigint>"), "alignments")
    docs = chunks.where("not head").select("chunk", *[c.split()[0] for c in _DOC.split(", ")], "groups_sha256", "packed")
    asked = chunks.where("head").select("chunk", F.explode(F.arrays_zip("keys", "docs")).alias("k")).select("chunk", F.col("k.keys").alias("pair"), F.col("k.docs").alias("docs"))
    shift = _bits(right)
    counts = written(asked.groupBy("pair").agg(F.sum("docs").alias("n")), "pair-counts")
    # one row per id of A: as many as its vocabulary has
    best = counts.groupBy(F.shiftright("pair", shift).alias("a")).agg(F.max("n").alias("high"))
    known = counts.join(F.broadcast(best), F.shiftright("pair", shift) == F.col("a")).select("pair", "n", (F.col("n") == F.col("high")).alias("best"))
    answers = asked.select(F.col("chunk").alias("asker"), "pair").join(known, "pair").select("asker", "pair", "n", "best")

    def tally(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        order = np.argsort(theirs["pair"].to_numpy(), kind="stable")
        n, top = theirs["n"].to_numpy()[order], theirs["best"].to_numpy()[order]
        sums, bests = [], []
        for blob in mine["packed"].to_pylist():
            places, links = _unpack(blob)
            sums.append(int(n[places] @ links)), bests.append(int(links[top[places]].sum()))
        columns = [c.split()[0] for c in _DOC.split(", ")]
        return pa.table([*(mine[c] for c in columns), pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), mine["groups_sha256"]], names=[*columns, "n_best", "count_sum", "groups_sha256"])

    return docs.groupBy("chunk").cogroup(answers.groupBy("asker")).applyInArrow(tally, _TALLIED)


def _bits(path: str) -> int:
    return side(path).bits
