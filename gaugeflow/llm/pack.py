"""Packing: all token ids of a corpus, concatenated and cut into sequences of one length.

Pass one encodes every document once and writes its ids with its place in the partition. The
partitions' totals, one row each, are summed up to global offsets. Pass two is a map: each
document knows its global place and is cut at the multiples of the length. A cut document leaves a
boundary record on either side (``start`` and ``length`` within the document). Only the last
sequence holds padding.

Nulls: a null text is empty (the end id alone). A null id is kept as null. Repeated rows are
documents of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import id_column, on_arrow, require, written
from .tokens import encoder
from .words import text_slices

TOKENS = "part int, start_in_part bigint, doc_id bigint, n bigint, ids binary"


def token_table(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Pass one: (part, start_in_part, doc_id, n, ids), ids as little-endian unsigned 32-bit integers with the end id."""

    def run(batches):
        known, part, place = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, raw, off in text_slices(batch.column(1)):
                ids, counts = known.encode(raw, off)
                n = counts + 1
                stop = np.cumsum(n)
                yield ([part] * (j - i), place + stop - n, batch.column(0).slice(i, j - i), n, id_column(np.insert(ids, np.cumsum(counts), end_id), n))
                place += int(stop[-1])

    return written(on_arrow(require(documents, "doc_id", "text"), run, TOKENS), "tokens")


def pack(tokens: DataFrame, length: int = 4096) -> DataFrame:
    """Pass two: the pieces of all documents.

    Result: doc_id, doc_tokens, start (ids of the document before the piece), length, sequence_id,
    offset (place in the sequence), cut_before and cut_after (the document goes on in the sequence
    before or after), tokens (binary).
    """
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # one row per partition of pass one, so the window and the broadcast hold as many rows as that had tasks
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = tokens.join(F.broadcast(bases), "part").withColumn("at", F.col("base") + F.col("start_in_part"))
    step = F.lit(length).cast("long")

    def piece(seq):
        low, high = F.greatest(F.col("at"), seq * step), F.least(F.col("at") + F.col("n"), (seq + 1) * step)
        start = low - F.col("at")
        return F.struct(
            start.alias("start"), (high - low).alias("length"), seq.alias("sequence_id"), (low - seq * step).alias("offset"),
            (start > 0).alias("cut_before"), (high < F.col("at") + F.col("n")).alias("cut_after"),
            F.substring(F.col("ids"), (start * 4 + 1).cast("int"), ((high - low) * 4).cast("int")).alias("tokens"))

    cuts = F.sequence(F.floor(F.col("at") / step), F.floor((F.col("at") + F.col("n") - 1) / step))
    return placed.select("doc_id", F.col("n").alias("doc_tokens"), F.inline(F.transform(cuts, piece)))


def sequences(pieces: DataFrame, length: int = 4096, pad_id: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, tokens (binary, padded), doc_ids, offsets.

    A group holds the pieces of one sequence, ``length`` ids at most. A sequence is padded to
    ``length`` unless its number of ids is a power of two.
    """
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "tokens")))
    grouped = pieces.groupBy("sequence_id").agg(rows.alias("p"), F.sum("length").alias("n_tokens"))
    pad = int(pad_id).to_bytes(4, "little").hex()
    power = F.expr("(n_tokens & (n_tokens - 1)) = 0")
    filled = F.when(power, F.lit(b"")).otherwise(F.expr(f"unhex(repeat('{pad}', int({length} - n_tokens)))"))
    joined = F.aggregate(F.col("p.tokens"), F.lit(b""), lambda a, b: F.concat(a, b))
    return grouped.select("sequence_id", "n_tokens", F.concat(joined, filled).alias("tokens"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))
