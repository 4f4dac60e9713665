"""Byte-pair encoding of many distinct words at once, by array operations.

It gives the ids of the ``tokenizers`` library for vocabularies with byte-level symbols and an
end-of-word suffix, whose pre-tokenizer splits letters, single digits and other signs.
"""

from __future__ import annotations

import json

import numpy as np

from quadrille.llm.wordhash import BYTES, SEGMENT, U, _powers, mix

LONGEST = 40  # bytes of a word that arrays hold; longer ones go to the library
NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class Merges:
    """The vocabulary's merge rules: a table from a pair of ids to its rank and its merged id."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.layers = []  # hash tables; each holds what collided in those before
        rank = np.arange(len(pairs), dtype=np.int32)
        bits = 19
        while len(keys):
            slot = self._slot(keys, bits, len(self.layers))
            first = np.unique(slot, return_index=True)[1]
            table, ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
            table[slot[first]], ranks[slot[first]] = keys[first], rank[first]
            self.layers.append((bits, table, ranks))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, rank, bits = keys[rest], rank[rest], 14

    @staticmethod
    def _slot(keys: np.ndarray, bits: int, layer: int) -> np.ndarray:
        factor = U((0x9E3779B97F4A7C15 + 2 * layer * 0x632BE59BD9B4E019) & (1 << 64) - 1 | 1)
        return ((keys.view(U) * factor) >> U(64 - bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 20 | b
        out = np.full(keys.shape, NONE, np.int32)
        for k, (bits, table, ranks) in enumerate(self.layers):
            slot = self._slot(keys, bits, k)
            np.copyto(out, ranks[slot], where=table[slot] == keys)
        return out

    def encode(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``symbols``: a row of byte ids for each word. Returns the ids, row by row, and their counts."""
        n, width = symbols.shape
        ids = symbols.copy()
        left = lengths.astype(np.int64).copy()
        ranks = np.full((n, width), NONE, np.int32)
        if width > 1:
            ranks[:, :-1] = self.ranks(ids[:, :-1], ids[:, 1:])
            ranks[np.arange(width)[None, :] >= left[:, None] - 1] = NONE
        active = np.arange(n)
        work_ids, work_ranks = ids, ranks
        steps = np.arange(width)
        while len(active):
            at = work_ranks.argmin(axis=1)
            rows = np.arange(len(active))
            best = work_ranks[rows, at]
            go = best != NONE
            if not go.all():
                ids[active[~go]] = work_ids[~go]
                active, at, best = active[go], at[go], best[go]
                work_ids, work_ranks = work_ids[go], work_ranks[go]
                rows = np.arange(len(active))
                if not len(active):
                    break
            left[active] -= 1
            # drop the column after each merged place
            source = np.minimum(steps[None, :] + (steps[None, :] > at[:, None]), width - 1)
            work_ids = np.take_along_axis(work_ids, source, 1)
            work_ranks = np.take_along_axis(work_ranks, source, 1)
            work_ids[rows, at] = self.merged[best]
            n_left = left[active]
            for where in (at - 1, at):
                ok = (where >= 0) & (where < n_left - 1)
                r = rows[ok]
                work_ranks[r, where[ok]] = self.ranks(work_ids[r, where[ok]], work_ids[r, where[ok] + 1])
            tail = at >= n_left - 1
            work_ranks[rows[tail], at[tail]] = NONE
            work_ranks[steps[None, :] >= n_left[:, None] - 1] = NONE
        return ids[steps[None, :] < left[:, None]], left


#: Classes of bytes: 0 space, 1 letter, 2 digit, 3 other sign; what follows a lead byte takes its class.
CLASS = np.full(256, 3, np.int8)
CLASS[[9, 10, 13, 32]] = 0
CLASS[97:123] = 1
CLASS[48:58] = 2
CLASS[[0xC3, 0xC5]] = 1


def split_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-case UTF-8 text begin and end."""
    cls = CLASS[buf]
    follows = np.flatnonzero((buf >= 0x80) & (buf < 0xC0))
    for _ in range(2):
        cls[follows] = cls[follows - 1]
    change = np.ones(len(buf), bool)
    change[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == 2)
    at = np.flatnonzero(change)
    ends = np.append(at[1:], len(buf))
    inside = cls[at] != 0
    return at[inside], ends[inside]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _powers()
    total = np.zeros(len(buf) + 1, U)
    np.cumsum(BYTES[buf] * power[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


class BlockEncoder:
    """Ids of blocks of plain text: distinct words of a block are encoded once."""

    def __init__(self, path: str, library):
        with open(path, encoding="utf-8") as f:
            self.merges = Merges(json.load(f))
        self.library = library  # encodes a list of long words

    def encode(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one block: each word's start, its number of ids, and all ids in order."""
        starts, ends = split_words(buf)
        if not len(starts):
            return starts, starts, np.zeros(0, np.int32)
        parts, at = [], 0
        while at < len(starts):  # hash in segments that the table of powers covers
            to = int(np.searchsorted(ends, starts[at] + SEGMENT, "right"))
            if to == at:  # a word longer than that
                word = buf[starts[at] : ends[at]]
                parts.append(mix(np.array([hash_long(word)], U)))
                at += 1
                continue
            base = int(starts[at])
            parts.append(span_hashes(buf[base : int(ends[to - 1])], starts[at:to] - base, ends[at:to] - base))
            at = to
        _, first, back = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        s, n = starts[first], (ends - starts)[first]
        counts = np.zeros(len(first), np.int64)
        pieces, owner = [], []
        low = 0
        for high in (4, 8, 12, 16, 24, LONGEST):
            some = np.flatnonzero((n > low) & (n <= high))
            low = high
            if not len(some):
                continue
            raw = buf[np.minimum(s[some, None] + np.arange(high), len(buf) - 1)]
            symbols = self.merges.inner[raw]
            last = n[some] - 1
            symbols[np.arange(len(some)), last] = self.merges.final[raw[np.arange(len(some)), last]]
            ids, left = self.merges.encode(symbols, n[some])
            counts[some] = left
            pieces.append(ids)
            owner.append(some)
        long = np.flatnonzero(n > LONGEST)
        if len(long):
            got = self.library([buf[a : a + k].tobytes().decode() for a, k in zip(s[long], n[long], strict=True)])
            counts[long] = [len(g) for g in got]
            pieces.append(np.concatenate([np.asarray(g, np.int32) for g in got]))
            owner.append(long)
        order, flat = np.concatenate(owner), np.concatenate(pieces)
        begin = np.zeros(len(first), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        each = counts[back]
        total = np.cumsum(each)
        place = np.arange(int(total[-1])) - np.repeat(total - each, each) + np.repeat(begin[back], each)
        return starts, each, flat[place]


def hash_long(word: np.ndarray) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8).digest(), "little")
