"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; a bit is 1 where more than half of the text's word shingles (repeats
included) have it in their XXH64. Two fingerprints link when few enough bits differ.

Anchors are the words of a covering code: bits 0-22 and bits 23-45 each hold a word of the binary Golay
code [23, 12], which covers its 23 bits with radius 3, bits 46-63 are nothing but zeros (radius 18). A
fingerprint's home is the anchor that covers it; the code is perfect, so there is one. A fingerprint
goes to every anchor within covering radius plus threshold, taken by blocks: the bits by which it
exceeds the radius of a block, added over the blocks, are at most the threshold. So it meets each
fingerprint it links with at that one's home, and is compared there with those at home. Two savings
lose nothing: of two homes the pair meets at the lower one alone, and nobody goes to an anchor that is
home to none, which a bitmap of all 2**24 anchors (2 MB, whatever the corpus) tells.

An anchor with many rows is split into squares (parts of those at home, parts of all), each a task of
its own with ``PART`` rows a side. A task gives a spanning forest of its links, not all pairs;
components follow by star contractions. Equal fingerprints are one from the start, so copies never
meet.

Nulls: a null text or one without words has the fingerprint zero, which links like any other; a null
doc_id is never a component's id (null where a component has no other). Rows with one doc_id are
documents of their own. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import on_arrow, partitions_for, require, written

LENGTH, RADIUS, CHECKS = 23, 3, 11
#: Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
PART, STRIDE = 4096, 1 << 16
SPLIT = 12


def _bits_of(shingles: Iterator[bytes], counted: np.ndarray) -> int:
    """Add the set bits of the hashes to ``counted``; the number of hashes."""
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    counted += bits.sum(axis=0, dtype=np.int64)
    return len(h)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of the whole text, worked off ``STRIDE`` shingles at a time."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    edges = np.cumsum([0, *[len(w) + 1 for w in words]])
    width = min(width, len(words))
    starts, ends = edges[: len(words) - width + 1].tolist(), (edges[width:] - 1).tolist()
    counted, n = np.zeros(64, np.int64), 0
    for k in range(0, len(starts), STRIDE):
        n += _bits_of((joined[x:y] for x, y in zip(starts[k : k + STRIDE], ends[k : k + STRIDE], strict=True)), counted)
    return int.from_bytes(np.packbits(2 * counted > n).tobytes(), "big")


def fingerprints(documents: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a long."""

    def run(batches):
        for batch in batches:
            prints = np.fromiter((fingerprint(t, width) for t in (x.as_py() for x in batch.column(1))), np.uint64, batch.num_rows)
            yield [batch.column(0), pa.array(prints.view(np.int64))]

    return on_arrow(require(documents, "doc_id", "text"), run, "doc_id bigint, fp bigint")


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial: the code word's coset."""
    x = x.astype(np.int64)
    for k in range(LENGTH - 1, CHECKS - 1, -1):
        x = np.where(x >> k & 1, x ^ (GOLAY << (k - CHECKS)), x)
    return x


@cache
def _patterns(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All differences to a code word of up to radius + ``reach`` bits, by coset and then by excess over the radius.

    Given are the differences, and per coset where they begin and how many have each excess.
    """
    words = np.array([sum(1 << k for k in c) for w in range(RADIUS + reach + 1) for c in combinations(range(LENGTH), w)], np.int64)
    excess = np.maximum(np.bitwise_count(words).astype(np.int64) - RADIUS, 0)
    coset = _syndrome(words)
    order = np.lexsort((words, excess, coset))
    per = np.bincount(coset[order] * (reach + 1) + excess[order], minlength=(reach + 1) << CHECKS).reshape(-1, reach + 1)
    total = per.sum(axis=1)
    return words[order], np.cumsum(total) - total, per


def _blocks(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << LENGTH) - 1)
    return (fp & mask).astype(np.int64), (fp >> np.uint64(LENGTH) & mask).astype(np.int64)


def _number(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A code word pair as a number below 2**24: the message bits of both."""
    return (first >> CHECKS) << (LENGTH - CHECKS) | second >> CHECKS


def homes(fp: np.ndarray) -> np.ndarray:
    """The anchor that covers each fingerprint."""
    words, begin, _ = _patterns(0)
    return _number(*(x ^ words[begin[_syndrome(x)]] for x in _blocks(fp)))


def anchors(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint, anchor) for every anchor within covering radius plus threshold."""
    words, begin, per = _patterns(threshold)
    first, second = _blocks(fp)
    s, t = _syndrome(first), _syndrome(second)
    upto = np.cumsum(per, axis=1)
    places, found = [], []
    for e in range(threshold + 1):
        n, m = per[s, e], upto[t, threshold - e]
        size = n * m
        at = np.repeat(np.arange(len(fp)), size)
        k = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        x = first[at] ^ words[begin[s][at] + (upto[s, e] - n)[at] + k // m[at]]
        y = second[at] ^ words[begin[t][at] + k % m[at]]
        places.append(at), found.append(_number(x, y))
    return np.concatenate(places), np.concatenate(found)


def _inhabited(prints: DataFrame) -> bytes:
    """A bit for each of the 2**24 anchors: is it a fingerprint's home? 512 rows of 4 KB, whatever the number of fingerprints."""
    low, high = F.col("home") % 32768, F.shiftright("home", 15)
    rows = prints.groupBy(high.alias("page")).agg(F.bitmap_construct_agg(low).alias("bits")).collect()
    out = bytearray(1 << 21)
    for r in rows:
        out[r["page"] * 4096 : r["page"] * 4096 + len(r["bits"])] = r["bits"]
    return bytes(out)


def _visits(prints: DataFrame, threshold: int) -> DataFrame:
    """(anchor, fp, home): each fingerprint at its home and at every inhabited anchor in reach that is numbered below its home."""
    known = prints.sparkSession.sparkContext.broadcast(_inhabited(prints))

    def run(batches):
        lived = np.unpackbits(np.frombuffer(known.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            every, home = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            for k in range(0, len(every), 2048):
                fp, own = every[k : k + 2048], home[k : k + 2048]
                at, anchor = anchors(fp.view(np.uint64), threshold)
                keep = (anchor < own[at]) & lived[anchor]
                at, anchor = at[keep], anchor[keep]
                yield [pa.array(np.concatenate([own, anchor]).astype(np.int32)), pa.array(np.concatenate([fp, fp[at]])), pa.array(np.arange(len(own) + len(at)) < len(own))]

    return on_arrow(prints.select("fp", "home"), run, "anchor int, fp bigint, home boolean")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes of the given links that are not the root, the smallest, of their component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _links(key: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between fingerprints at home and all others of the same key; rows come in the order of their key."""
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    size = np.diff(np.append(begin, len(key)))
    group = np.repeat(np.arange(len(begin)), size)
    host = np.flatnonzero(home)
    todo = size[group[host]]
    kept_a, kept_b, k = [], [], 0
    reach = np.cumsum(todo)
    while k < len(host):
        stop = max(k + 1, int(np.searchsorted(reach, (reach[k - 1] if k else 0) + most, "right")))
        n = todo[k:stop]
        x = np.repeat(host[k:stop], n)
        y = np.repeat(begin[group[host[k:stop]]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        near = (np.bitwise_count(fp[x] ^ fp[y]) <= threshold) & (fp[x] != fp[y])
        a, b = _forest(fp[x[near]], fp[y[near]])
        kept_a.append(a), kept_b.append(b)
        k = stop
    return (np.concatenate(kept_a), np.concatenate(kept_b)) if kept_a else (fp[:0], fp[:0])


def links(prints: DataFrame, threshold: int = 3) -> DataFrame:
    """(a, b): links that join the same distinct fingerprints ``fp`` as all pairs within the threshold would."""

    def settle(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            yield [fp, homes(fp.view(np.uint64)).astype(np.int32)]

    housed = written(on_arrow(prints.select("fp"), settle, "fp bigint, home int"), "homes")
    visits = written(_visits(housed, threshold), "visits")
    held = visits.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > PART)
    # an anchor counts here from PART rows on, so there are at most rows / PART of them; the join shuffles if that is many
    parts = held.select("anchor", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    parts = F.broadcast(parts) if parts.count() <= 1 << 20 else parts
    marked = visits.join(parts, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    whole = F.sequence(F.lit(0), F.col("parts") - 1)
    # square (i, j): those at home of part i against all of part j
    guests = marked.select("anchor", F.explode(whole).alias("i"), F.col("own").alias("j"), "fp", "home", "parts", "own")
    hosts = marked.where("home").select("anchor", F.col("own").alias("i"), F.explode(whole).alias("j"), "fp", "home", "parts", "own").where("j <> own")
    squares = guests.withColumn("home", F.col("home") & (F.col("i") == F.col("own"))).unionByName(hosts).select("anchor", "i", "j", "fp", "home")
    order = ["anchor", "i", "j"]
    rows = squares.repartition(*order).sortWithinPartitions(*order)

    def compare(batches):
        left: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)]
            if left is not None:
                now = [np.concatenate(pair) for pair in zip(left, now, strict=True)]
            change = np.append(True, (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]) | (now[2][1:] != now[2][:-1]))
            last = int(np.flatnonzero(change)[-1])
            if last:
                yield _links(np.cumsum(change)[:last], now[3][:last].view(np.uint64), now[4][:last], threshold)
            left = [x[last:] for x in now]
        if left is not None:
            yield _links(np.zeros(len(left[0])), left[3].view(np.uint64), left[4], threshold)

    def run(batches):
        for a, b in compare(batches):
            yield [a.view(np.int64), b.view(np.int64)]

    return on_arrow(rows, run, "a bigint, b bigint")


def classify(documents: DataFrame, width: int = 3, threshold: int = 3) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id that links lead to, itself included)."""
    docs = written(fingerprints(documents, width), "fingerprints")
    rows = docs.count()
    # null sorts after every id; the fingerprint keeps nodes of one id apart
    node = F.struct(F.col("low").isNull().alias("none"), F.col("low").alias("low"), F.col("fp").alias("fp"))
    each = written(docs.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).select("fp", "n", node.alias("node")), "distinct")
    found = written(links(each, threshold), "links")
    name = each.select("fp", "node")
    ends = found.join(name.withColumnRenamed("node", "u").withColumnRenamed("fp", "a"), "a").join(name.withColumnRenamed("node", "v").withColumnRenamed("fp", "b"), "b")
    roots = components(ends, "u", "v").withColumnRenamed("component", "root")
    ids = each.join(roots, "node", "left").select("fp", "n", F.coalesce("root.low", "node.low").alias("component_id"))
    # fingerprints of more than a thousandth of all rows: a thousand of them at most
    often = F.col("n") * 1000 > F.lit(rows)
    hot = F.broadcast(ids.where(often).select("fp", F.col("component_id").alias("__hot"), F.lit(True).alias("__often")))
    marked = docs.join(hot, "fp", "left")
    rest = marked.where("__often IS NULL").select("doc_id", "fp").join(ids.where(~often).select("fp", "component_id"), "fp")
    done = marked.where("__often").select("doc_id", "fp", F.col("__hot").alias("component_id")).unionByName(rest.select("doc_id", "fp", "component_id"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
