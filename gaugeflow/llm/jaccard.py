"""N-gram Jaccard join: exact links between documents whose shingle sets are similar, and their components.

1. A document's set is its distinct word shingles (lower-cased A-Z), known by 58-bit hashes.
   Documents with equal sets (a 128-bit digest of the set) form one class, which the smallest id
   stands for.
2. Shingles get one global order: counts of documents in a table of hashed slots, summed over all
   documents, give each slot a level; rare levels come first, then the hash. Two sets that link
   share a shingle among the first n - ceil(t n) + 1 of either. These prefixes meet in groups, hashed
   by shingle; rows travel as arrays per batch and group part. Groups of frequent shingles are dealt
   over several parts.
3. In each group every document is paired with the group's leader (the one with the fewest rarer
   shingles before, likely what the others are copies of), so a group of thousands of copies makes
   thousands of pairs and not millions. Pairs that share enough of their
   prefixes are verified exactly: of two sets, one ends its prefix first, and with c shared shingles
   in the prefixes at most c and the rest of that set can agree.
4. Where a document does not link with a leader, that group is searched in full: all pairs across
   components that pass the length bound, and the position bound at their first shared shingle, are
   verified as well, so no link is lost.
5. Before verification every set is sent as a bitmap of four to eight bits a shingle. What one set has in
   bits that the other lacks is not shared, so most pairs that do not link are ruled out without
   their shingles; a pair that could link never is.
6. Verification walks a prefix tree: the sets to compare with one document are laid out in global
   order, each branches off from the one before at their common prefix and takes over the overlap
   counted so far; a branch ends where the overlap so far and the rest's length cannot reach the
   bound any more, and later sets below that point are skipped.

Nulls: a null text is empty; a document without words has an empty set and links with nothing. Rows
with a null id keep a null component. Rows with the same id are one node. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import leave_out, on_arrow, partitions_for, require, written
from .words import shingles, spread, text_slices, words

WIDTH = 5
BITS = 58
SLOTS, BLOCK = 1 << 24, 1 << 18
#: Least overlap as a share of the union, in hundredths.
PERCENT = 75
PART_ROWS = 1_000_000


def _sets(texts: pa.Array, width: int):
    """(row, sorted distinct hashes) of every text of an Arrow array."""
    for i, _, raw, off in text_slices(texts):
        _, _, counts, h = words(raw, off)
        grams, per = shingles(h, counts, width)
        grams >>= np.uint64(64 - BITS)
        stops = np.cumsum(per)
        for k, (a, b) in enumerate(zip((stops - per).tolist(), stops.tolist(), strict=True)):
            if b - a > 1:
                own = np.sort(grams[a:b])
                yield i + k, own[np.append(True, own[1:] != own[:-1])]
            else:
                yield i + k, grams[a:b]


def _digest(own: np.ndarray) -> tuple[int, int]:
    return (int(np.add.reduce(spread(own))) ^ len(own)) - (1 << 63), int(np.bitwise_xor.reduce(spread(own + np.uint64(0x51_7CC1B727220A95)))) - (1 << 63)


def sets_and_slots(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of documents (doc_id, n, d1, d2) and, with ``block`` set, a task's counts of documents per slot, up to 255 each."""

    def run(batches):
        slots = np.zeros(SLOTS, np.uint8)
        for batch in batches:
            n, d1, d2 = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, own in _sets(batch.column(1), width):
                n[row] = len(own)
                if len(own):
                    d1[row], d2[row] = _digest(own)
                    at = (own & np.uint64(SLOTS - 1)).astype(np.int64)
                    slots[at] += slots[at] < 255
            yield (batch.column(0), n, d1, d2, pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary()))
        if slots.any():
            k, none = SLOTS // BLOCK, np.zeros(SLOTS // BLOCK, np.int64)
            yield (pa.nulls(k, pa.int64()), none, none, none, np.arange(k, dtype=np.int32), [slots[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in range(k)])

    return written(on_arrow(require(documents, "doc_id", "text"), run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, block int, counts binary"), "shingle-sets")


def levels(counted: DataFrame) -> np.ndarray:
    """Level of each slot, 0 for the usual ones, then two for each doubling; SLOTS bytes, whatever the corpus."""
    usual = counted.where("block IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / SLOTS

    def run(batches):
        now, total = None, np.zeros(BLOCK, np.int64)
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != now:
                    if now is not None:
                        yield ([now], [_level(total, usual).tobytes()])
                    now, total = block, np.zeros(BLOCK, np.int64)
                total += np.frombuffer(counts.as_buffer(), np.uint8)
        if now is not None:
            yield ([now], [_level(total, usual).tobytes()])

    blocks = counted.where("block IS NOT NULL").select("block", "counts").repartition("block").sortWithinPartitions("block")
    out = np.zeros(SLOTS, np.uint8)
    for block, level in on_arrow(blocks, run, "block int, level binary").toLocalIterator():
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(level, np.uint8)
    return out


def _bound(usual: float) -> float:
    return usual + 4 * math.sqrt(usual) + 2


def _level(total: np.ndarray, usual: float) -> np.ndarray:
    ratio = np.maximum(total / _bound(usual), 1e-9)
    return np.where(ratio > 1, np.minimum(1 + 2 * np.log2(ratio), 31), 0).astype(np.uint8)


def _keys(own: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The set in global order: level above the hash."""
    return np.sort(own | (level[(own & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(BITS)))


def prefix_groups(documents: DataFrame, level, parts: int, usual: float, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Prefix rows of all documents in groups of two documents or more: token, doc_id, leader, n, place, lead_n."""

    def send(batches):
        table = level.value
        for batch in batches:
            ids, seen, rows = batch.column(0), set(), []
            for row, own in _sets(batch.column(1), width):
                doc = ids[row].as_py()
                if doc is None or not len(own) or (same := _digest(own)) in seen:
                    continue
                seen.add(same)
                keys = _keys(own, table)
                size = len(keys) - -(-percent * len(keys) // 100) + 1
                rows.append((keys[:size], doc, len(keys)))
            if not rows:
                continue
            size = np.array([len(r[0]) for r in rows])
            token = np.concatenate([r[0] for r in rows])
            doc, n = np.repeat(np.array([r[1] for r in rows], np.int64), size), np.repeat(np.array([r[2] for r in rows], np.int32), size)
            place = (np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            part = (spread(token) % np.uint64(parts)).astype(np.int64)
            often = token >> np.uint64(BITS)
            if often.any():  # groups of frequent shingles: dealt by document over as many parts as their size asks for
                deals = np.minimum(np.ceil(_bound(usual) * np.exp2(often.astype(np.float64) / 2) / PART_ROWS), parts).astype(np.int64)
                part = (part + (spread(doc.astype(np.uint64)) % np.maximum(deals, 1).astype(np.uint64)).astype(np.int64)) % parts
            order = np.argsort(part, kind="stable")
            part, token, doc, n, place = part[order], token[order], doc[order], n[order], place[order]
            edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            ends = np.append(edges[1:], len(part))
            cut = lambda x: [x[a:b].tobytes() for a, b in zip(edges.tolist(), ends.tolist(), strict=True)]  # noqa: B023, E731
            yield (part[edges], cut(token), cut(doc), cut(n), cut(place))

    def meet(batches):
        for _, columns in _grouped(batches, 1):
            token, doc, n, place = (np.concatenate([np.frombuffer(x, kind) for x in col]) for col, kind in zip(columns, (np.uint64, np.int64, np.int32, np.int32), strict=True))
            # the leader: where the shingle comes earliest, so has the fewest rarer ones of its own before it
            order = np.lexsort((doc, place, token))
            token, doc, n, place = token[order], doc[order], n[order], place[order]
            first = np.append(True, token[1:] != token[:-1])
            number = np.cumsum(first) - 1
            many = np.bincount(number)[number] > 1
            leader, lead_n = doc[np.flatnonzero(first)][number], n[np.flatnonzero(first)][number]
            at = np.flatnonzero(many)
            for k in range(0, len(at), 100_000):
                x = at[k : k + 100_000]
                yield (token[x].view(np.int64), doc[x], leader[x], n[x], place[x], lead_n[x])

    sent = on_arrow(require(documents, "doc_id", "text"), send, "part bigint, token binary, doc binary, n binary, place binary")
    return on_arrow(sent.repartition(parts, "part").sortWithinPartitions("part"), meet, "token bigint, doc_id bigint, leader bigint, n int, place int, lead_n int")


def _grouped(batches, keys: int):
    """(key, columns after the key) of each run of equal keys in rows sorted by them."""
    now, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            key = row[:keys]
            if key != now:
                if held is not None:
                    yield now, held
                now, held = key, [[] for _ in row[keys:]]
            for col, x in zip(held, row[keys:], strict=True):
                col.append(x)
    if held is not None:
        yield now, held


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, most: int = 512) -> DataFrame:
    """Pairs (a, b) with ``inside``: whether their sets link. sets: doc_id, n, keys (big-endian, in global order).

    All b of an a are compared along one prefix tree, ``most`` sets or so to a task.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / most).alias("deals"))
    dealt = pairs.join(many, "a").withColumn("deal", F.pmod(F.xxhash64("b"), F.col("deals"))).select("a", "deal", "b")
    right = dealt.join(sets.select(F.col("doc_id").alias("b"), "keys"), "b").select("a", "deal", F.lit(1).alias("side"), "b", "keys")
    left = dealt.select("a", "deal").distinct().join(sets.select(F.col("doc_id").alias("a"), "keys"), "a").select("a", "deal", F.lit(0).alias("side"), F.col("a").alias("b"), "keys")
    rows = left.unionByName(right).repartition("a", "deal").sortWithinPartitions("a", "deal", "side", "keys", "b")

    def run(batches):
        group, walks = None, []
        for batch in batches:
            out_a, out_b, out = [], [], []
            for a, deal, side, b, keys in zip(*(batch.column(k) for k in range(5)), strict=True):
                own = np.frombuffer(keys.as_buffer(), ">u8").astype(np.uint64)
                if side.as_py() == 0:
                    if (a.as_py(), deal.as_py()) != group:
                        group, walks = (a.as_py(), deal.as_py()), []
                    walks.append(Branches(own, percent))
                elif (a.as_py(), deal.as_py()) == group:
                    out_a.append(group[0]), out_b.append(b.as_py()), out.append(any([w.links(own) for w in walks]))
            yield (out_a, out_b, out)

    return on_arrow(rows, run, "a bigint, b bigint, inside boolean")


class Branches:
    """The prefix tree's current branch: the last set and the overlap with the query after each of its shingles."""

    def __init__(self, query: np.ndarray, percent: int):
        self.query, self.percent = query, percent
        self.path, self.overlap, self.dead = np.zeros(0, np.uint64), np.zeros(1, np.int64), -1

    def links(self, own: np.ndarray) -> bool:
        n, m = len(own), len(self.query)
        need = -(-self.percent * (n + m) // (100 + self.percent))
        shared = min(len(own), len(self.path))
        differ = np.flatnonzero(own[:shared] != self.path[:shared])
        depth = int(differ[0]) if len(differ) else shared
        overlap = self.overlap[: depth + 1]
        step = 64
        while True:
            # best case from here: all that is left on either side agrees
            here = len(overlap) - 1
            last = own[here - 1] if here else np.uint64(0)
            ahead = m - int(np.searchsorted(self.query, last, "right")) if here else m
            if overlap[here] + min(n - here, ahead) < need or here == n:
                break
            block = own[here : here + step]
            at = np.minimum(np.searchsorted(self.query, block), m - 1)
            overlap = np.append(overlap, overlap[here] + np.cumsum(self.query[at] == block))
            step *= 2
        self.path, self.overlap = own[: len(overlap) - 1], overlap
        return len(overlap) - 1 == n and overlap[n] >= need


def _ordered_sets(documents: DataFrame, wanted: DataFrame, level, width: int) -> DataFrame:
    """doc_id, n and ordered keys of the wanted documents. A list of up to two million ids (16 MB) is broadcast."""

    def run(batches):
        for batch in batches:
            keys = [_keys(own, level.value).astype(">u8").tobytes() for _, own in _sets(batch.column(1), width)]
            yield (batch.column(0), [len(k) // 8 for k in keys], keys)

    ids = F.broadcast(wanted) if wanted.count() <= 2_000_000 else wanted
    return written(on_arrow(require(documents, "doc_id", "text").join(ids, "doc_id", "left_semi"), run, "doc_id bigint, n bigint, keys binary"), "ordered-sets")


def _may_link(n: F.Column, m: F.Column, shared: F.Column, percent: int) -> F.Column:
    """Whether sets of n and m shingles with so many shared ones in their prefixes can link."""
    need = F.ceil(F.lit(percent) * (n + m) / (100 + percent))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (shared + F.ceil(F.lit(percent) * F.greatest(n, m) / 100) - 1 >= need)


def join(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_shingles, standing: smallest id with an equal set) and verified links (a, b) between standing ones.

    The links connect exactly the documents that all links of at least ``percent`` connect.
    """
    spark = documents.sparkSession
    counted = sets_and_slots(documents, width)
    listed = counted.where("block IS NULL").select("doc_id", "n", "d1", "d2")
    standing = listed.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("standing"))
    classes = written(listed.join(standing, ["d1", "d2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), "standing"), "classes")
    total = listed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    level = spark.sparkContext.broadcast(levels(counted))
    rows = total * (100 - percent) // 100 + 1
    parts = partitions_for(rows, PART_ROWS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = written(prefix_groups(documents, level, parts, total / SLOTS, width, percent), "prefix-groups")
    stand = classes.where("standing IS NOT NULL").select("doc_id", "standing").distinct()
    led = groups.where("doc_id <> leader").groupBy(F.col("doc_id").alias("x"), F.col("leader").alias("y")).agg(F.count("*").alias("shared"), F.max("n").alias("n"), F.max("lead_n").alias("m"))
    # groups dealt over several parts have a leader in each; these meet under the smallest
    deals = _bound(total / SLOTS) * F.pow(F.lit(2.0), F.shiftright("token", BITS) / 2) / PART_ROWS
    heads = groups.where((F.shiftright("token", BITS) > 0) & (deals > 0.999)).select("token", "leader", "lead_n").distinct()
    tops = heads.groupBy("token").agg(F.min(F.struct("leader", "lead_n")).alias("top"), F.count("*").alias("k")).where("k > 1").select("token", F.col("top.leader").alias("top"), F.col("top.lead_n").alias("top_n"))
    tops = written(heads.join(tops, "token").where("leader <> top"), "part-leaders")
    led = led.unionByName(tops.groupBy(F.col("leader").alias("x"), F.col("top").alias("y")).agg(F.count("*").alias("shared"), F.max("lead_n").alias("n"), F.max("top_n").alias("m")))
    named = led.join(stand.select(F.col("doc_id").alias("x"), F.col("standing").alias("sx")), "x").join(stand.select(F.col("doc_id").alias("y"), F.col("standing").alias("sy")), "y").where("sx <> sy")
    pairs = named.groupBy(F.least("sx", "sy").alias("a"), F.greatest("sx", "sy").alias("b")).agg(F.sum("shared").alias("shared"), F.max(F.greatest("n", "m")).alias("n"), F.min(F.least("n", "m")).alias("m"))
    pairs = written(pairs.withColumn("near", _may_link(F.col("n"), F.col("m"), F.col("shared"), percent)), "pairs")
    checked = _verified(documents, pairs.where("near").select("a", "b"), level, width, percent)
    links = checked.where("inside").select("a", "b")
    failed = pairs.where("NOT near").select("a", "b").unionByName(checked.where("NOT inside").select("a", "b"))
    if failed.head(1):
        more = _apart(groups, tops, stand, links, failed, checked, percent)
        links = links.unionByName(_verified(documents, more, level, width, percent).where("inside").select("a", "b"))
    return classes, links


def _sketches(documents: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """doc_id, n and a bitmap of the hashes of the wanted documents' sets: a power of two bits, four a shingle or more."""

    def run(batches):
        for batch in batches:
            n, bits = [], []
            for _, own in _sets(batch.column(1), width):
                size = 1 << max(6, (4 * len(own)).bit_length())
                field = np.zeros(size, bool)
                field[(own & np.uint64(size - 1)).astype(np.int64)] = True
                n.append(len(own)), bits.append(np.packbits(field, bitorder="little").tobytes())
            yield (batch.column(0), n, bits)

    ids = F.broadcast(wanted) if wanted.count() <= 2_000_000 else wanted
    return written(on_arrow(require(documents, "doc_id", "text").join(ids, "doc_id", "left_semi"), run, "doc_id bigint, n bigint, bits binary"), "sketches")


def _most_shared(n: int, x: np.ndarray, m: int, y: np.ndarray) -> int:
    """Bound of the shingles that sets of n and m share, by their bitmaps: each bit that only one has is a shingle not shared."""
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
    both = int(np.bitwise_count(x & y).sum())
    return min(n - int(np.bitwise_count(x).sum()), m - int(np.bitwise_count(y).sum())) + both


def _sifted(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with ``near``: whether their bitmaps allow a link."""
    of = lambda name, n, bits: sketches.select(F.col("doc_id").alias(name), F.col("n").alias(n), F.col("bits").alias(bits))
    met = pairs.select("a", "b").join(of("a", "n", "x"), "a").join(of("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")

    def run(batches):
        for batch in batches:
            x, y = ([np.frombuffer(z.as_buffer(), np.uint8) for z in batch.column(k)] for k in (4, 5))
            need = lambda n, m: -(-percent * (n + m) // (100 + percent))
            near = [_most_shared(n, u, m, v) >= need(n, m) for n, m, u, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), x, y, strict=True)]
            yield (batch.column(0), batch.column(1), near)

    # rows with the same id are one node: any two of them may link
    return written(on_arrow(met, run, "a bigint, b bigint, near boolean").groupBy("a", "b").agg(F.max("near").alias("near")), "sifted")


def _verified(documents: DataFrame, pairs: DataFrame, level, width: int, percent: int) -> DataFrame:
    ends = lambda x: written(x.select(F.col("a").alias("doc_id")).unionByName(x.select(F.col("b").alias("doc_id"))).distinct(), "ends")
    sifted = _sifted(pairs, _sketches(documents, ends(pairs), width), percent)
    near = sifted.where("near").select("a", "b")
    checked = verify(near, _ordered_sets(documents, ends(near), level, width), percent)
    return written(checked.unionByName(sifted.where("NOT near").select("a", "b", F.lit(False).alias("inside"))), "verified")


def _apart(groups: DataFrame, tops: DataFrame, stand: DataFrame, links: DataFrame, failed: DataFrame, checked: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) still to verify: across components, in the groups where a document did not link with its leader.

    The first prefix shingle that two such documents share is in a group where one of the two lies apart
    from the leader, so no pair is missed.
    """
    of = lambda name, other: stand.select(F.col("doc_id").alias(name), F.col("standing").alias(other))
    comp = components(links)
    label = of("doc_id", "standing").join(comp.withColumnRenamed("node", "standing"), "standing", "left").select("doc_id", "standing", F.coalesce("component", "standing").alias("c"))
    label = written(label, "labels")
    lost = failed.select(F.col("a").alias("s")).unionByName(failed.select(F.col("b").alias("s"))).distinct()
    lost = written(label.join(lost, F.col("standing") == F.col("s"), "left_semi").select("doc_id").distinct(), "lost")
    # groups that hold a document of a failed pair, and in them whether anyone is apart from the leader
    tokens = groups.join(F.broadcast(lost) if lost.count() <= 2_000_000 else lost, "doc_id", "left_semi").select("token").distinct()
    held = groups.join(tokens, "token", "left_semi").select("token", "doc_id", "leader", "n", "place")
    held = held.join(label, "doc_id").join(label.select(F.col("doc_id").alias("leader"), F.col("c").alias("lead_c")), "leader")
    held = held.groupBy("token", "standing", "c").agg(F.max("n").alias("n"), F.max("place").alias("place"), F.max(F.col("c") != F.col("lead_c")).alias("apart"))
    split = tops.join(label.select(F.col("doc_id").alias("leader"), F.col("c").alias("c1")), "leader").join(label.select(F.col("doc_id").alias("top"), F.col("c").alias("c2")), "top").where("c1 <> c2").select("token").distinct().withColumn("split", F.lit(True))
    held = written(held.join(split, "token", "left").withColumn("apart", F.col("apart") | F.coalesce("split", F.lit(False))).drop("split"), "held")
    left = held.where("apart").select("token", F.col("standing").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), F.col("place").alias("ix"))
    right = held.select("token", F.col("standing").alias("y"), F.col("c").alias("cy"), F.col("n").alias("ny"), F.col("place").alias("iy"), F.col("apart").alias("too"))
    sizes = 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")
    # at the first shingle two sets share, all they can share lies behind it on either side
    first = F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy")) >= F.ceil(F.lit(percent) * (F.col("nx") + F.col("ny")) / (100 + percent))
    # both apart: the pair comes once, from the smaller
    met = left.join(right, "token").where((F.col("cx") != F.col("cy")) & sizes & first & (~F.col("too") | (F.col("x") < F.col("y"))))
    more = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return written(more.join(checked.select("a", "b"), ["a", "b"], "left_anti"), "pairs")


def classify(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest id that links lead to, itself included)."""
    classes, links = join(documents, width, percent)
    comp = components(links).select(F.col("node").alias("standing"), "component")
    return classes.join(comp, "standing", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "standing", "doc_id")).alias("component_id"))


def keep_first(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the smallest id, with all its columns; documents without words or id stay."""
    later = classify(documents, width, percent).where("doc_id IS NOT NULL AND component_id <> doc_id")
    return leave_out(documents, written(later.select("doc_id").distinct(), "later"))
