"""Token ids of whole texts, equal to those of the tokenizers library, for word-wise tokenizers.

The tokenizer named by the path lower-cases, drops white space and encodes each pre-token by
itself. A text may therefore be cut between two ASCII bytes wherever its pre-tokenizer always
cuts: at white space, between letters and other characters, and around digits; not at an
apostrophe (contractions) and not next to a non-ASCII byte (composition). Each distinct piece is
encoded once per worker by the library and kept in a bounded table; texts that hold the string of
a special token go to the library whole. A piece is known by its 64-bit hash.
"""

from __future__ import annotations

import numpy as np

from .words import FOLD, NOT_SPACE, span_hashes, spans

_KIND = np.full(256, 3, np.uint8)
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[39] = 0
_KIND[128:] = 0
_ENCODERS: dict[tuple[str, int], "Encoder"] = {}


def encoder(path: str, slots_log2: int = 20) -> "Encoder":
    """The worker's encoder for a tokenizer file; kept between tasks."""
    key = (path, slots_log2)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, slots_log2)
    return _ENCODERS[key]


class Encoder:
    """Encodes slices of texts.

    ``slots_log2`` bounds the table of known pieces (12 bytes a slot); half as many pieces are kept,
    the first that come, which are the frequent ones. Others are encoded anew in each slice.
    """

    def __init__(self, path: str, slots_log2: int = 20):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread a worker: Spark runs a task on every core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            text = f.read()
        spec = json.loads(text)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        steps = spec.get("normalizer") or {}
        kinds = {s["type"] for s in steps.get("normalizers", [steps])}
        if not suffix or "Lowercase" not in kinds:
            raise ValueError(f"{path}: only lower-casing tokenizers with word ends can be cut into pieces")
        self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1 + len(self.special), bool)
        for piece, i in spec["model"]["vocab"].items():
            self.ends[i] = piece.endswith(suffix)
        self.bits = slots_log2
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.entry = np.full(1 << self.bits, -1, np.int32)
        self.start, self.length, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)
        self.entries = self.used = 0

    def _add(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Append the ids of pieces to the pool; their entry numbers."""
        n = len(lengths)
        while self.entries + n > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        at = np.arange(self.entries, self.entries + n)
        self.start[at], self.length[at] = self.used + np.cumsum(lengths) - lengths, lengths
        self.pool[self.used : self.used + len(flat)] = flat
        self.entries, self.used = self.entries + n, self.used + len(flat)
        return at.astype(np.int32)

    def _encode_pieces(self, pieces: list[str]) -> np.ndarray:
        """Entry number of each piece. Pieces of one pre-token are encoded many at a time and told apart by word ends."""
        plain = np.array([(p.isascii() and "'" not in p) or p.isalpha() for p in pieces], bool)
        order, other = np.flatnonzero(plain), np.flatnonzero(~plain).tolist()
        groups = [order[i : i + 512] for i in range(0, len(order), 512)]
        done, flats, lengths = [], [], []
        for group, got in zip(groups, self.library.encode_batch_fast([" ".join(pieces[i] for i in g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(group):
                done.append(group), flats.append(ids), lengths.append(np.diff(stops, prepend=0))
            else:
                other += group.tolist()
        if other:
            got = [x.ids for x in self.library.encode_batch_fast([pieces[i] for i in other], add_special_tokens=False)]
            done.append(np.array(other)), flats.append(np.array([i for x in got for i in x], np.uint32)), lengths.append(np.array([len(x) for x in got]))
        entries = np.empty(len(pieces), np.int32)
        entries[np.concatenate(done)] = self._add(np.concatenate(flats), np.concatenate(lengths))
        return entries

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other (uint32), and the number of ids of each text."""
        if self._has_special(raw):
            return self._by_library(raw, off)
        kept, used = self.entries, self.used
        kind = _KIND[raw]
        cut = np.zeros(len(raw), bool)
        cut[1:] = (kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        starts, ends, counts = spans(NOT_SPACE[raw], off, cut)
        h = span_hashes(FOLD[raw], starts, ends)
        mask = np.uint64((1 << self.bits) - 1)
        slot = (h & mask).astype(np.int64)
        at = np.where(self.key[slot] == h, self.entry[slot], -1)
        lost = np.flatnonzero(at < 0)
        if len(lost):
            second = ((h[lost] >> np.uint64(self.bits)) & mask).astype(np.int64)
            at[lost] = np.where(self.key[second] == h[lost], self.entry[second], -1)
            lost = lost[at[lost] < 0]
        if len(lost):
            new, first, back = np.unique(h[lost], return_index=True, return_inverse=True)
            blob, where = FOLD[raw].tobytes(), lost[first]
            entries = self._encode_pieces([blob[a:b].decode("utf-8") for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            at[lost] = entries[back]
            for shift in (0, self.bits) if self.entries <= 1 << (self.bits - 1) else ():  # the first free of a piece's two slots
                slot = ((new >> np.uint64(shift)) & mask).astype(np.int64)
                free = self.entry[slot] < 0
                self.key[slot[free]], self.entry[slot[free]] = new[free], entries[free]
                held = self.key[slot] == new
                new, entries = new[~held], entries[~held]
        lengths = self.length[at].astype(np.int64)
        stop = np.cumsum(lengths)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.pool[np.repeat(self.start[at] - (stop - lengths), lengths) + np.arange(total)]
        if self.entries > 1 << (self.bits - 1):
            self.entries, self.used = kept, used
        edge = np.cumsum(counts)
        reach = np.append(0, stop)
        return ids, reach[edge] - reach[edge - counts]

    def _has_special(self, raw: np.ndarray) -> bool:
        blob = raw.tobytes()
        return any(s in blob for s in self.special)

    def _by_library(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blob = raw.tobytes()
        ids: list[np.ndarray] = []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            if any(s in blob[a:b] for s in self.special):
                ids.append(np.array(self.library.encode(blob[a:b].decode("utf-8"), add_special_tokens=False).ids, np.uint32))
            else:
                ids.append(self.encode(raw[a:b], np.array([0, b - a]))[0])
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)
