"""Chat formatting in budgeted windows.

Turns are put in order by a range partitioning over (conversation, turn, role, text), so a long
conversation lies over several partitions. Running sums of turn tokens in each partition, and one row
per partition and conversation that goes on from the one before, give every turn its place and the
tokens before it. Spans are turn-aligned: a turn belongs to the window in which its first token
falls, windows being ``room`` tokens long. Every window holds

* the system turn (a first turn with the role system), again in every later window,
* the turns of the span before that begin at most ``history`` tokens before the span, repeated,
* the turns of its span.

Only assistant texts of the own span are under the loss mask; repeated ones are masked. With
``room`` = budget - history - reserve a window keeps to the budget as long as the system turn and
its longest turn together have at most ``reserve`` tokens; longer ones make their window longer.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside texts ``<``, any number of backslashes
and ``|`` gets one more backslash; in roles a backslash is doubled, a line end written as backslash n
and ``<|`` parted by backslash b. So no control string can occur in them and both are read back exactly.

Nulls: a null text or role is empty; a null conversation is a conversation, a null turn comes first.
Ties of turn are ordered by role and text; repeated rows are turns of their own. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import on_arrow, require, written
from .tokens import encoder
from .words import text_slices

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY, RESERVE, OVERHEAD = 2048, 256, 512, 8
NULL_ID = -(1 << 63)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


_ROLE = {"n": "\n", "b": "", "\\": "\\"}


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("<|", "<\\b|")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ROLE[m[1]], role)


def ordered_turns(conversations: DataFrame, tokenizer: str, partitions: int) -> DataFrame:
    """conv_id, ord (place in the conversation), start (tokens of turns before, without the system turn), tokens, role, text."""
    clean = require(conversations, "conv_id", "turn", "role", "text").select(
        F.coalesce("conv_id", F.lit(NULL_ID)).alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    keys = ("conv_id", "turn", "role", "text")

    def run(batches):
        known, part = encoder(tokenizer), TaskContext.get().partitionId()
        conv, place, start = None, 0, 0
        for batch in batches:
            counts = [known.encode(raw, off)[1] for _, _, raw, off in text_slices(batch.column(2))]
            tokens = (np.concatenate(counts) if counts else np.zeros(0, np.int64)) + OVERHEAD
            places, starts = [], []
            for c, n in zip(batch.column(0).to_pylist(), tokens.tolist(), strict=True):
                if c != conv:
                    conv, place, start = c, 0, 0
                places.append(place), starts.append(start)
                place, start = place + 1, start + n
            yield (batch.column(0), [part] * batch.num_rows, places, starts, tokens, batch.column(1), batch.column(2))

    sorted_turns = clean.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).select("conv_id", "role", "text")
    turns = written(on_arrow(sorted_turns, run, "conv_id bigint, part int, place bigint, start bigint, tokens bigint, role string, text string"), "turns")
    segments = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    over = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a partition goes on with one conversation at most, so these are fewer rows than partitions
    bases = segments.select("conv_id", "part", F.sum("n").over(over).alias("n0"), F.sum("t").over(over).alias("t0")).where("n0 IS NOT NULL")
    placed = turns.join(F.broadcast(bases), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("n0", F.lit(0))).alias("ord"), (F.col("start") + F.coalesce("t0", F.lit(0))).alias("start"), "tokens", "role", "text")
    system = placed.where("ord = 0 AND role = 'system'").select(F.col("conv_id"), F.col("tokens").alias("s"))
    joined = placed.join(system, "conv_id", "left")
    return joined.select("conv_id", "ord", F.when(F.col("ord") > 0, F.col("start") - F.coalesce("s", F.lit(0))).otherwise(0).alias("start"), "tokens", "role", "text")


def windows(conversations: DataFrame, tokenizer: str, partitions: int, budget: int = BUDGET, history: int = HISTORY, reserve: int = RESERVE) -> DataFrame:
    """conv_id, window, text, loss (code points under the mask: first, end, first, end, ...), repeated (turns before the own
    span), turns, tokens."""
    room = budget - history - reserve
    if room < history or history < 0:
        raise ValueError("the budget must hold the reserve and twice the history")
    turns = written(ordered_turns(conversations, tokenizer, partitions).withColumn("window", F.floor(F.col("start") / room).cast("long")), "placed-turns")
    first = turns.groupBy("conv_id", "window").agg(F.min("start").alias("first"), F.min("ord").alias("low"))
    own = turns.select("conv_id", "window", "ord", "tokens", "role", "text", F.lit(False).alias("again"))
    after = first.select("conv_id", (F.col("window") - 1).alias("window"), "first")
    back = turns.where("NOT (ord = 0 AND role = 'system')").join(after, ["conv_id", "window"]).where(F.col("first") - F.col("start") <= history)
    back = back.select("conv_id", (F.col("window") + 1).alias("window"), "ord", "tokens", "role", "text", F.lit(True).alias("again"))
    heads = turns.where("ord = 0 AND role = 'system'").select("conv_id", "ord", "tokens", "role", "text")
    head = heads.join(first.where("low > 0").select("conv_id", "window"), "conv_id").select("conv_id", "window", "ord", "tokens", "role", "text", F.lit(True).alias("again"))
    rows = own.unionByName(back).unionByName(head).repartition("conv_id", "window").sortWithinPartitions("conv_id", "window", "ord")

    def run(batches):
        now, parts = None, []
        for batch in batches:
            done = []
            for conv, window, _, tokens, role, text, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, window) != now:
                    if parts:
                        done.append((*now, *_format(parts)))
                    now, parts = (conv, window), []
                parts.append((role, text, tokens, again))
            yield _columns(done)
        if parts:
            yield _columns([(*now, *_format(parts))])

    return on_arrow(rows.select("conv_id", "window", "ord", "tokens", "role", "text", "again"), run, "conv_id bigint, window bigint, text string, loss array<bigint>, repeated int, turns int, tokens bigint")


def _columns(rows: list[tuple]) -> tuple:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    return tuple(pa.array(list(c), pa.list_(pa.int64())) if k == 3 else list(c) for k, c in enumerate(cols))


def _format(parts: list[tuple]) -> tuple:
    out, at, loss = [], 0, []
    for role, text, _, again in parts:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == "assistant" and not again:
            loss += [at + len(head), at + len(head) + len(body)]
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), loss, sum(p[3] for p in parts), len(parts), sum(p[2] for p in parts)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted window."""
    out = []
    for turn in text.split(START)[1:]:
        role, _, body = turn.partition("\n")
        out.append((unescape_role(role), unescape(body[: -len(END) - 1])))
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """From the windows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A conversation's windows stream by in order; only hash states are kept.
    """

    def run(batches):
        now, state = None, None
        for batch in batches:
            done = []
            for conv, text, loss, repeated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append(_result(now, state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for a, b in zip(loss[::2], loss[1::2], strict=True):
                    target = unescape(text[a:b])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(text)
            yield tuple(map(list, zip(*done, strict=True))) if done else ([],) * 6
        if state is not None:
            yield tuple([x] for x in _result(now, state))

    rows = formatted.select("conv_id", "window", "text", "loss", "repeated").repartition("conv_id").sortWithinPartitions("conv_id", "window").select("conv_id", "text", "loss", "repeated")
    return on_arrow(rows, run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _result(conv: int, state: list) -> tuple:
    return (None if conv == NULL_ID else conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
