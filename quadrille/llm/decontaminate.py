"""Benchmark decontamination by latent semantic retrieval.

Documents are read as passages: windows of ``width`` words, half overlapping. Their TF-IDF
vectors are over all of the benchmark's words; none is left out for being common, since an item that
many documents hold makes its own words common. A distributed randomised SVD of all passages and items finds a latent space: one pass sums the
sketch of the Gram matrix, from which the Nystrom method gives singular vectors. A second pass
projects every passage and finds items by cosine. Besides, each run of ``run`` words that an item holds (all
of a shorter item) names it wherever it stands word for word, whatever the cosine. The neighbourhoods go on to the longest common
subsequence of words, which tolerates inserted, dropped and changed words. A document holds an item
if the subsequence covers ``share`` of it, or ``weak_share`` and the item's answer stands there word for
word: the answer column if there is one, else the item's last ``answer_words`` words.

Texts are hashed once; all passes read a table of their words as numbers of the benchmark's words.

The benchmark is bounded: at most ``most_items`` items and ``most_terms`` words, else ValueError.
Everything that is broadcast has that bound times the rank. Whole documents are searched.

Defined results: null texts and items match nothing; items of fewer than ``least_words`` words
match word for word only; repeated rows are searched each; rows with a null id match with a
null id; an empty benchmark or table gives an empty result; further columns are ignored. Words are
runs of other than ASCII space, A-Z in lower case, compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import wordhash
from quadrille.llm.common import Scratch

U = np.uint64
BLOCK = 256  # terms in a row of the summed sketch
DENSE = 128  # terms, the benchmark's most frequent ones, whose counts are kept as a matrix
SLOTS = 8192  # half passages that are handled together
COSINES = 4_000_000  # cosines held at once
FOUND = "doc_id long, item_id long, first int, words int, cosine double, lcs double, answer boolean"


@dataclass
class Items:
    """The benchmark, its terms and, once they are counted, weights and latent vectors."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]
    terms: np.ndarray  # sorted hashes
    width: int
    weight: np.ndarray | None = None  # inverse document frequencies, all above 0
    latent: np.ndarray | None = None  # a row for each term, times its weight
    vectors: np.ndarray | None = None  # a row for each item, of length 1

    def table(self) -> np.ndarray:
        """Hashes by number: 0 for all words that neither items nor answers have, the terms, other words of answers."""
        if not hasattr(self, "_table"):
            other = np.setdiff1d(np.concatenate([*self.answers, np.zeros(0, U)]), self.terms)
            self._table = np.concatenate([np.zeros(1, U), self.terms, other])
            self._order = np.argsort(self._table[1:], kind="stable") + 1
            self._sorted = self._table[self._order]
        return self._table

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The words' numbers in the table, in few bytes."""
        table = self.table()
        if not hasattr(self, "_any"):
            self._any = np.zeros(1 << 16, bool)
            self._any[(table[1:] >> U(48)).astype(np.int64)] = True
        out = np.zeros(len(h), np.uint16 if len(table) <= 1 << 16 else np.uint32)
        at = np.flatnonzero(self._any[(h >> U(48)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self._sorted, h[at]), len(self._sorted) - 1)
        out[at] = np.where(self._sorted[k] == h[at], self._order[k], 0)
        return out

    def hashes(self, h: np.ndarray) -> np.ndarray:
        """Hashes of words that are given as hashes or as numbers."""
        return h if h.dtype == U else self.table()[h]

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words that are terms, and which; words are hashes or numbers."""
        if h.dtype != U:
            at = np.flatnonzero((h > 0) & (h <= len(self.terms)))
            return at, h[at].astype(np.int64) - 1
        if not hasattr(self, "_door"):
            self._door = np.zeros(1 << 16, bool)
            self._door[(self.terms >> U(48)).astype(np.int64)] = True
        at = np.flatnonzero(self._door[(h >> U(48)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        same = self.terms[k] == h[at]
        return at[same], k[same]

    def bags(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of all items and how often each has them, end to end; where each item's begin, and its words."""
        if not hasattr(self, "_bags"):
            each = [np.unique(np.searchsorted(self.terms, w), return_counts=True) for w in self.words]
            sizes = np.array([len(k) for k, _ in each])
            self._bags = (*(np.concatenate(x) for x in zip(*each, strict=True)), np.append(0, np.cumsum(sizes)), np.array([len(w) for w in self.words]))
        return self._bags

    def runs(self, run: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each length, ``run`` or that of a shorter item: hashes of the items' runs, sorted, and the items."""
        if not hasattr(self, "_runs"):
            by: dict[int, list] = {}
            for i, w in enumerate(self.words):
                r = wordhash.shingles(w, run)
                by.setdefault(min(run, len(w)), []).append((r, np.full(len(r), i)))
            self._runs = []
            for n, each in sorted(by.items()):
                r, item = (np.concatenate(x) for x in zip(*each, strict=True))
                order = np.argsort(r, kind="stable")
                self._runs.append((n, r[order], item[order]))
        return self._runs

    def named(self, h: np.ndarray, at: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and item of each run of an item that stands in the words; ``at`` are places of terms."""
        inside = np.zeros(len(h) + 1, np.int64)
        inside[at + 1] = 1
        inside = np.cumsum(inside)
        place, item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        h = self.hashes(h)
        for n, r, of in self.runs(run):
            begin = np.flatnonzero(inside[n:] - inside[: max(0, len(h) - n + 1)] == n) if len(h) >= n else np.zeros(0, np.int64)
            here = wordhash.ngrams_at(h, n, begin)
            low = np.searchsorted(r, here)
            some = np.flatnonzero(r[np.minimum(low, len(r) - 1)] == here)
            low, size = low[some], np.searchsorted(r, here[some], "right") - low[some]
            place.append(np.repeat(begin[some], size))
            item.append(of[np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)])
        return np.concatenate(place), np.concatenate(item)

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """The terms whose counts are kept as a matrix, and the place of each term among them (or -1)."""
        if not hasattr(self, "_dense"):
            own, times, _, _ = self.bags()
            often = np.argsort(-np.bincount(own, times, len(self.terms)), kind="stable")[:DENSE]
            place = np.full(len(self.terms), -1)
            place[often] = np.arange(len(often))
            self._dense = often, place
        return self._dense


def slots_of(n: int, step: int) -> int:
    """Half passages of a text of ``n`` words; each but the last begins a passage."""
    return max(2, -(-n // step)) if n else 0


class Block:
    """Texts, or parts of long ones, whose passages are handled together: their half passages are slots."""

    def __init__(self, items: Items, parts: list[tuple[int, int, bool, np.ndarray]]):
        """``parts``: number of the text, its first passage here, whether it has others, and the words."""
        step = items.width // 2
        self.items, self.parts = items, parts
        self.h = np.concatenate([h for *_, h in parts])
        sizes = np.array([len(h) for *_, h in parts])
        slots = np.array([slots_of(n, step) for n in sizes.tolist()])
        self.begin, self.base = np.cumsum(sizes) - sizes, np.cumsum(slots) - slots
        self.slots = int(slots.sum())
        self.passage = np.ones(self.slots, bool)
        self.passage[self.base + slots - 1] = False
        self.at, self.k = items.hits(self.h)
        self.of = np.searchsorted(self.begin, self.at, "right") - 1
        self.half = self.base[self.of] + (self.at - self.begin[self.of]) // step
        often, place = items.dense()
        where = place[self.k]
        common = where >= 0
        self.often = often
        counts = np.bincount(self.half[common] * len(often) + where[common], minlength=self.slots * len(often))
        self.counts = counts.astype(np.float32).reshape(self.slots, len(often))  # of the dense terms, by half
        self.rare_half, self.rare = self.half[~common], self.k[~common]

    def rare_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage, term and count of each pair of a passage with one of the other terms."""
        earlier = self.rare_half - 1
        there = (earlier >= 0) & self.passage[earlier]
        also = self.passage[self.rare_half]
        p, k = np.concatenate([self.rare_half[also], earlier[there]]), np.concatenate([self.rare[also], self.rare[there]])
        size = len(self.items.terms)
        pair, count = np.unique(p * size + k, return_counts=True)
        return pair // size, pair % size, count

    def both(self, halves: np.ndarray) -> np.ndarray:
        """Sums of each half and the next; 0 where no passage begins."""
        out = halves.copy()
        out[:-1] += halves[1:]
        out[~self.passage] = 0
        return out

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """Sums of the terms' rows over each half passage."""
        out = self.counts @ rows[self.often]
        which, begin = rows_of(self.rare_half)
        if len(which):
            out[which] += run_sums(rows, self.rare, begin)
        return out


def blocks(items: Items, each: Iterable[np.ndarray]) -> Iterator[tuple[list[np.ndarray], Block]]:
    """The texts' words with blocks over them. A long text is cut where passages begin, with the half that two
    share in both; its parts are blocks of the same text."""
    step = items.width // 2
    texts, parts, held = [], [], 0
    for h in each:
        if held and held + slots_of(len(h), step) > SLOTS:
            yield texts, Block(items, parts)
            texts, parts, held = [], [], 0
        texts.append(h)
        n = slots_of(len(h), step) - 1
        for a in range(0, n, SLOTS):
            if a:
                yield texts, Block(items, parts)
                parts = []
            parts.append((len(texts) - 1, a, n > SLOTS, h[a * step : (a + SLOTS + 1) * step] if a + SLOTS < n else h[a * step :]))
        held += n + 1
    if parts:
        yield texts, Block(items, parts)


def rows_of(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array and where they begin."""
    begin = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.zeros(0, np.int64)
    return p[begin], begin


def run_sums(rows: np.ndarray, pick: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of ``rows[pick]`` over the runs that begin at these places: the first rows of all runs are added, then
    the second ones of those that have them. A few long runs are summed by themselves."""
    size = np.diff(np.append(begin, len(pick)))
    order = np.argsort(-size, kind="stable")
    first, size = begin[order], size[order]
    out = rows[pick[first]]
    j, m = 1, int(np.searchsorted(-size, -1))  # runs that go on at row j
    while m >= 32:
        out[:m] += rows[pick[first[:m] + j]]
        j += 1
        m = int(np.searchsorted(-size, -j))
    for i in range(m):
        out[i] += rows[pick[first[i] + j : first[i] + size[i]]].sum(axis=0)
    back = np.empty_like(out)
    back[order] = out
    return back


def read_items(benchmark: DataFrame, answer: str | None, width: int, answer_words: int, most_items: int, most_terms: int) -> Items:
    columns = ["item_id", F.col("text").cast("binary").alias("text"), (F.col(answer).cast("binary") if answer else F.lit(None).cast("binary")).alias("answer")]
    rows = benchmark.select(*columns).where("text is not null").limit(most_items + 1).toArrow().to_pylist()
    if len(rows) > most_items:
        raise ValueError(f"the benchmark has over {most_items} items")
    rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
    words = [wordhash.words(r["text"])[0] for r in rows]
    answers = [wordhash.words(r["answer"])[0] if r["answer"] else w[-answer_words:] for r, w in zip(rows, words, strict=True)]
    keep = [i for i, w in enumerate(words) if len(w)]
    terms = np.unique(np.concatenate([words[i] for i in keep])) if keep else np.zeros(0, U)
    if len(terms) > most_terms:
        raise ValueError(f"the benchmark has over {most_terms} distinct words")
    return Items([rows[i]["item_id"] for i in keep], [words[i] for i in keep], [answers[i] for i in keep], terms, width)


def numbered(docs: DataFrame, items: Items, scratch: Scratch) -> DataFrame:
    """``doc_id, words``: the words of each text as numbers, which all passes read."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = list(wordhash.many(b.column("text").to_pylist()))
            k = shared.value.numbers(np.concatenate([*words, np.zeros(0, U)]))
            ends = np.append(0, np.cumsum([len(h) for h in words]) * k.itemsize)
            words = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(k)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), words.cast(pa.binary())], ["doc_id", "words"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return scratch.cut(texts.mapInArrow(local, "doc_id long, words binary"), "numbers")


def words_of(items: Items, b: pa.RecordBatch) -> Iterator[np.ndarray]:
    kind = np.uint16 if len(items.table()) <= 1 << 16 else np.uint32
    return (np.frombuffer(x.as_buffer(), kind) for x in b.column("words"))


def weigh(docs: DataFrame, items: Items) -> np.ndarray:
    """Inverse document frequencies over all passages of the numbered texts."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    size = len(items.terms)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, np.zeros(size, np.int64)
        for b in batches:
            for _, block in blocks(shared.value, words_of(shared.value, b)):
                total += int(block.passage.sum())
                sums += np.bincount(block.rare_pairs()[1], minlength=size)
                sums[block.often] += (block.both(block.counts) > 0).sum(axis=0)
        at = np.append(np.flatnonzero(sums), size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(sums, total)[at])], ["term", "n"])

    rows = docs.mapInArrow(local, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size + 1, np.int64)
    df[rows["term"].to_numpy()] = rows["n"].to_numpy()
    total = max(1, int(df[size]))
    return np.log((2 + total) / (1 + df[:size]))


def _gram(items: Items, each: Iterable[np.ndarray], omega: np.ndarray, scale: float, into: np.ndarray) -> None:
    """Add ``scale`` times the Gram matrix of these texts' passages, times ``omega``."""
    rows = (items.weight[:, None] * omega).astype(np.float32)
    for _, block in blocks(items, each):
        p, k, count = block.rare_pairs()
        norm = np.bincount(p, (count * items.weight[k]) ** 2, block.slots) + block.both(block.counts) ** 2 @ items.weight[block.often] ** 2
        # A passage is two halves, so sums over halves serve two passages each, in both products.
        y = block.both(block.sums(rows))
        y *= np.divide(1, norm, out=np.zeros(len(norm)), where=norm > 0).astype(np.float32)[:, None]
        y[1:] += y[:-1].copy()
        into[block.often] += scale * items.weight[block.often, None] * (block.counts.T @ y)
        order = np.argsort(block.rare, kind="stable")
        terms, begin = rows_of(block.rare[order])
        if len(terms):
            into[terms] += scale * items.weight[terms, None] * run_sums(y, block.rare_half[order], begin)


def latent_space(docs: DataFrame, items: Items, rank: int, item_weight: float, seed: int = 11) -> np.ndarray:
    """Singular vectors of the TF-IDF matrix of all passages and items: a row for each term."""
    size = len(items.terms)
    r = min(rank, size)
    omega = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, r)))[0]
    shared = docs.sparkSession.sparkContext.broadcast((items, omega))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it, om = shared.value
        z = np.zeros((size, r))
        for b in batches:
            _gram(it, words_of(it, b), om, 1.0, z)
        at = [i for i in range(0, size, BLOCK) if z[i : i + BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([z[i : i + BLOCK].tobytes() for i in at], pa.binary())], ["term", "z"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column("term").to_pylist(), b.column("z").to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["term", "z"])

    schema = "term long, z binary"
    rows = docs.mapInArrow(local, schema).repartition("term").mapInArrow(add, schema).toArrow()
    z = np.zeros((size, r))
    for i, raw in zip(rows["term"].to_pylist(), rows["z"].to_pylist(), strict=True):
        z[i : i + BLOCK] += np.frombuffer(raw).reshape(-1, r)
    _gram(items, items.words, omega, item_weight, z)
    shift = 1e-9 * max(np.linalg.norm(z), 1e-12)
    z += shift * omega
    core = omega.T @ z
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > value.max() * 1e-10
    b = z @ (vector[:, good] / np.sqrt(value[good]))
    return np.linalg.svd(b, full_matrices=False)[0]


def common_subsequence(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence, with a row of the table in the bits of an integer."""
    places: dict[int, int] = {}
    of = set(x.tolist())
    y = [w for w in y.tolist() if w in of]
    for i, w in enumerate(y):
        places[w] = places.get(w, 0) | 1 << i
    every = row = (1 << len(y)) - 1
    for w in x.tolist():
        if same := row & places.get(w, 0):
            row = ((row + same) | (row - same)) & every
    return len(y) - row.bit_count()


def holds(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether ``x`` stands in ``y`` as it is."""
    if not len(x) or len(x) > len(y):
        return False
    at = np.flatnonzero(y[: len(y) - len(x) + 1] == x[0])
    return any(np.array_equal(y[i : i + len(x)], x) for i in at)


def possible(items: Items, hits: tuple[np.ndarray, np.ndarray], row: np.ndarray, item: np.ndarray, share: float) -> np.ndarray:
    """Which pairs of passage and item have at least this share of the item's words around the passage."""
    own, times, begin, words = items.bags()
    step = items.width // 2
    names, k = np.unique(hits[1], return_inverse=True)
    place = np.full(len(items.terms), len(names))
    place[names] = np.arange(len(names))

    def enough(i: np.ndarray, present) -> np.ndarray:
        keep = []
        for at in range(0, len(i), 4096):
            some = i[at : at + 4096]
            size = begin[some + 1] - begin[some]
            first = np.cumsum(size) - size
            flat = np.arange(size.sum()) + np.repeat(begin[some] - first, size)
            there = np.add.reduceat(times[flat] * present(place[own[flat]], at, size), first)
            keep.append(there >= share * words[some])
        return np.concatenate(keep)

    # in the whole text, then in the halves around the passage, of which ``after`` has the next with each term
    which = np.unique(item)
    keep = np.isin(item, which[enough(which, lambda x, at, size: x < len(names))])
    for low in np.unique(row[keep] // 256) * 256:
        some = np.flatnonzero(keep & (row >= low) & (row < low + 256))
        reach = -(-words[item[some]] // step)
        base, top = max(0, low - int(reach.max())), low + 258 + int(reach.max())
        inside = slice(*np.searchsorted(hits[0], [base * step, top * step]))
        after = np.full((top - base, len(names) + 1), top, np.int32)
        after[hits[0][inside] // step - base, k[inside]] = hits[0][inside] // step
        after = np.minimum.accumulate(after[::-1], axis=0)[::-1]
        begins, ends = np.maximum(row[some] - reach, base) - base, row[some] + 2 + reach
        part = lambda x, at, size: after[np.repeat(begins[at : at + 4096], size), x] < np.repeat(ends[at : at + 4096], size)  # noqa: B023, E731
        keep[some] = enough(item[some], part)
    return keep


def candidates(items: Items, block: Block, cosine: float, least: float, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Part, passage in it, item and cosine of each pair to be looked at: near by cosine or named by a run of
    words, and with at least this share of the item's words around the passage."""
    x = block.both(block.sums(items.latent))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.float32(1e-30))
    slot, item, near = [], [], []
    for at in range(0, block.slots, max(1, COSINES // len(items.ids))):
        c = x[at : at + max(1, COSINES // len(items.ids))] @ items.vectors.T
        flat = np.flatnonzero((c >= cosine).ravel())
        row, i = np.divmod(flat, len(items.ids))
        slot, item, near = [*slot, row + at], [*item, i], [*near, c.ravel()[flat]]
    place, i = items.named(block.h, block.at, run)
    of = np.searchsorted(block.begin, place, "right") - 1
    end = np.append(block.begin, len(block.h))[of + 1]
    words = np.array([len(w) for w in items.words])
    whole = place + np.minimum(run, words[i]) <= end  # a run does not reach into the next text
    place, i, of = place[whole], i[whole], of[whole]
    last = np.append(block.base, block.slots)[of + 1] - 2
    row = np.minimum(block.base[of] + (place - block.begin[of]) // (items.width // 2), last)
    slot, item, near = np.concatenate([*slot, row]), np.concatenate([*item, i]), np.concatenate([*near, (x[row] * items.vectors[i]).sum(axis=1)])
    pair, first = np.unique(slot * len(items.ids) + item, return_index=True)
    slot, item, near = pair // len(items.ids), pair % len(items.ids), near[first]
    part = np.searchsorted(block.base, slot, "right") - 1
    # Whether the text, and then the halves around the passage, have enough of the item's words; parts of long
    # texts are looked at later.
    own, times, begin, _ = items.bags()

    def enough(i: np.ndarray, has) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for at in range(0, len(i), 4096):
            some = i[at : at + 4096]
            n = begin[some + 1] - begin[some]
            first = np.cumsum(n) - n
            flat = np.arange(n.sum()) + np.repeat(begin[some] - first, n)
            out[at : at + 4096] = np.add.reduceat(times[flat] * has(own[flat], slice(at, at + 4096), n), first) >= least * words[some]
        return out

    cut = np.array([x for _, _, x, _ in block.parts])[part]
    names, number = np.unique(block.k, return_inverse=True)
    place = np.full(len(items.terms), len(names))
    place[names] = np.arange(len(names))
    inside = np.zeros((len(block.parts), len(names) + 1), bool)
    inside[block.of, number] = True
    which, back = np.unique(part * len(items.ids) + item, return_inverse=True)
    of = which // len(items.ids)
    keep = enough(which % len(items.ids), lambda k, at, n: inside[np.repeat(of[at], n), place[k]])[back] | cut
    part, slot, item, near, cut = (x[keep] for x in (part, slot, item, near, cut))
    # Which of 64 slots have each term, as bits; a range of slots lies in two such groups, or is looked at later.
    bits = np.zeros((block.slots // 64 + 2, len(names) + 1), np.uint64)
    where = (block.half >> 6) * bits.shape[1] + number
    order = np.argsort(where, kind="stable")
    which, first = rows_of(where[order])
    if len(which):
        bits.ravel()[which] = np.bitwise_or.reduceat(U(1) << (block.half[order] & 63).astype(U), first)
    flat = bits.ravel()
    reach = -(-words[item] // (items.width // 2))
    low = np.maximum(slot - reach, block.base[part])
    high = np.minimum(slot + 2 + reach, np.append(block.base, block.slots)[part + 1])
    group, size = low >> 6, np.minimum(high - low, 64)
    span = np.where(size == 64, ~U(0), (U(1) << (size.astype(U) & U(63))) - U(1))
    from_ = (low & 63).astype(U)
    one, two = span << from_, np.where(from_ > 0, span >> ((U(64) - from_) & U(63)), U(0))

    def around(k: np.ndarray, at: slice, n: np.ndarray) -> np.ndarray:
        g = np.repeat(group[at] * bits.shape[1], n) + place[k]
        there = (flat[g] & np.repeat(one[at], n)) != 0
        over = np.flatnonzero(np.repeat(two[at] > 0, n))
        there[over] |= (flat[g[over] + bits.shape[1]] & np.repeat(two[at], n)[over]) != 0
        return there

    keep = cut | (high - low > 64) | enough(item, around)
    return part[keep], slot[keep] - block.base[part[keep]], item[keep], near[keep]


def search(items: Items, each: Iterable[np.ndarray], cosine: float, share: float, weak_share: float, least_words: int, run: int) -> Iterator[tuple]:
    """``text, item, first, words, cosine, lcs, answer`` of each item that a text holds, by the texts' numbers."""
    done, best, held, hits = 0, {}, [], None
    step = items.width // 2

    def found() -> Iterator[tuple]:
        for (t, _), x in sorted(best.items()):
            yield (done + t, *x)
        best.clear()

    last: dict[tuple[int, int], int] = {}
    for texts, block in blocks(items, each):
        if texts is not held:
            yield from found()
            done += len(held)
            held, hits = texts, {}
            last.clear()
        part, row, item, near = candidates(items, block, cosine, min(share, weak_share), run)
        for p in np.unique(part).tolist():
            some = np.flatnonzero(part == p)
            t, a, cut, _ = block.parts[p]
            h = texts[t]
            rows, which, keep = row[some] + a, item[some], slice(None)
            if cut:
                if t not in hits:
                    hits[t] = items.hits(h)
                keep = possible(items, hits[t], rows, which, min(share, weak_share))
            for r, i, c in sorted(zip(rows[keep].tolist(), which[keep].tolist(), near[some][keep].tolist(), strict=True)):
                words, start = items.words[i], r * step
                low, high = max(0, start - len(words)), min(len(h), start + items.width + len(words))
                if last.get((t, i), -1) >= start + items.width:
                    continue  # the region looked at before holds this passage
                region = items.hashes(h[low:high])
                last[t, i] = high
                n = common_subsequence(words, region)
                ratio, answer = n / len(words), holds(items.answers[i], region)
                match = holds(words, region) if len(words) < least_words else ratio >= share or (ratio >= weak_share and answer)
                if match and ratio > best.get((t, i), (0,) * 5)[4]:
                    best[t, i] = (i, low, high - low, c, ratio, answer)
    yield from found()


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, answer: str | None = None, width: int = 32, rank: int = 64, cosine: float = 0.4, share: float = 0.7, weak_share: float = 0.5, answer_words: int = 8, least_words: int = 8, run: int = 5, item_weight: float = 100.0, most_items: int = 20_000, most_terms: int = 200_000) -> DataFrame:
    """A row for each document and item that it holds, with the place of the best match."""
    items = read_items(benchmark, answer, width, answer_words, most_items, most_terms)
    if not items.ids:
        return spark.createDataFrame([], FOUND)
    docs = numbered(docs, items, Scratch(spark))
    items.weight = weigh(docs, items)
    items.latent = (items.weight[:, None] * latent_space(docs, items, rank, item_weight)).astype(np.float32)
    vectors = np.zeros((len(items.ids), items.latent.shape[1]))
    for i, w in enumerate(items.words):
        k, count = np.unique(np.searchsorted(items.terms, w), return_counts=True)
        vectors[i] = count @ items.latent[k]
    items.vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)).astype(np.float32)
    shared = spark.sparkContext.broadcast(items)
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.bool_())

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = shared.value
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            found = search(it, words_of(it, b), cosine, share, weak_share, least_words, run)
            out = [(ids[t], it.ids[i], *rest) for t, i, *rest in found]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.mapInArrow(local, FOUND)


def without_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold an item of the benchmark."""
    found = Scratch(spark).cut(contaminated(spark, docs, benchmark, **options).select("doc_id").distinct(), "contaminated")
    return docs.join(found.withColumnRenamed("doc_id", "__found"), docs["doc_id"].eqNullSafe(F.col("__found")), "left_anti")
