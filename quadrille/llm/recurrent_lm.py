"""Scores of whole documents by a gated recurrent language model, and by word counts.

Word counts cover all training texts. The most frequent symbols (words, the end, and one symbol for
all other words) are the model's vocabulary; they are dealt by frequency into classes of
``CLASS`` symbols, and the output is a softmax over classes times one within the class. A word
outside the vocabulary has the probability of the symbol for others times its share, by
smoothed counts, among the words it stands for.

Training is truncated backpropagation over windows of ``STEPS`` words in numpy. Every training text
takes part, once: rounds take disjoint parts of the texts, each task trains on what it holds,
and the weights of all tasks are averaged by tokens after each round. Long texts are cut into
sequences for training. For scoring, the state is carried over windows from a text's first word
to its end.

The counts of the ``FREQUENT`` most frequent words are broadcast (16 bytes each), which settles most
words; the others are joined with the table of counts, summed by text.

Defined results: a null text is empty and holds the end alone; repeated rows and null ids are scored
each, rows with null ids are training rows; without training texts all counts are 0, and the score
is the base score; an empty table gives an empty result; further columns are ignored. Words are
compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import wordhash
from quadrille.llm.common import Scratch
from quadrille.llm.ngram_join import count_words

U = np.uint64
FREQUENT = 200_000
CLASS = 64
HIDDEN = 24
STEPS = 16
SEQUENCE = 512  # words of a training sequence
TOGETHER = 1024  # sequences trained side by side
ROUNDS = (1, 4, 16)  # of 16 parts of the training texts, where each round ends
BLOCK = 4_000_000  # words that a task scores together
CHUNK = 16_384  # weights that are summed together
CHUNKS = "chunk long, tokens long, weights binary"
F4 = np.float32


@dataclass
class Vocabulary:
    """Frequent words with their counts, and the model's symbols among them."""

    words: np.ndarray  # sorted hashes
    counts: np.ndarray
    symbol: np.ndarray  # of each word; the unknown symbol where it has none
    sizes: np.ndarray  # count of each symbol
    end: int
    unknown: int
    texts: int  # count of the end
    total: int  # tokens, N
    distinct: int  # V
    other_total: int  # tokens of words without a symbol
    other_distinct: int

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word in the table, and whether it is there."""
        if not len(self.words) or not len(h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        if not hasattr(self, "_first"):  # where the words with each 18 leading bits begin
            lead = (self.words >> U(46)).astype(np.int64)
            self._first = np.searchsorted(lead, np.arange((1 << 18) + 1)).astype(np.int32)
            self._widest = int(np.diff(self._first).max())
        at = np.minimum(self._first[(h >> U(46)).astype(np.int64)], len(self.words) - 1).astype(np.int64)
        there = self.words[at] == h
        left = np.flatnonzero(self.words[at] < h)
        for _ in range(self._widest - 1):
            if not len(left):
                break
            at[left] = np.minimum(at[left] + 1, len(self.words) - 1)
            w = self.words[at[left]]
            there[left] = w == h[left]
            left = left[(w < h[left]) & (at[left] < len(self.words) - 1)]
        return at, there

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """The text's symbols, from the few words that have one of their own."""
        if not hasattr(self, "_named"):
            named = self.symbol != self.unknown
            self._named = self.words[named], self.symbol[named]
        words, symbol = self._named
        out = np.full(len(h) + 1, self.unknown, np.int32)
        if len(words):
            at = np.minimum(np.searchsorted(words, h), len(words) - 1)
            out[:-1] = np.where(words[at] == h, symbol[at], self.unknown)
        out[-1] = self.end
        return out


def vocabulary(counts: DataFrame, texts: int, symbols: int) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    rows = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    w, n = rows["word"].to_numpy().view(U), rows["n"].to_numpy()
    named = min(len(w), symbols - 2)
    other = int(total - n[:named].sum())
    # symbols in order of frequency: named words, the end and the one for other words
    size = np.concatenate([n[:named], [texts, other]])
    rank = np.argsort(-size, kind="stable")
    number = np.empty(len(size), np.int64)
    number[rank] = np.arange(len(size))
    symbol = np.full(len(w), number[-1], np.int32)
    symbol[:named] = number[:named]
    order = np.argsort(w)
    return Vocabulary(w[order], n[order], symbol[order], size[rank], int(number[-2]), int(number[-1]), texts, int(total + texts), int(distinct + (texts > 0)), other, int(distinct - named))


_ONES: dict[int, np.ndarray] = {}


def _outputs(h: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logits of the states; the rows' maxima are subtracted only where some value is large.

    Outputs begin as logarithms of shares and rarely go far from them. States are within 1, so the weights
    bound all rows at once.
    """
    logits = h @ w
    logits += b
    reach = np.abs(w).sum(0)
    if float((b + reach).max()) > 60 or float(b[0] - reach[0]) < -60:
        if float(np.abs(logits[:, 0]).max()) > 20 or float(logits.max()) > 60:
            logits -= logits.max(1, keepdims=True)
    return logits


def _exponents(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials, in place of the logits, and their sums."""
    p = np.exp(logits, out=logits)
    k = logits.shape[1]
    if k not in _ONES:
        _ONES[k] = np.ones(k, F4)
    return p, p @ _ONES[k]


class Network:
    """Weights: input gates by symbol, recurrent gates, class and word outputs."""

    NAMES = ("x", "u", "b", "wc", "bc", "wo", "bo")

    def __init__(self, sizes: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        v, h = len(sizes), HIDDEN
        c = -(-v // CLASS)
        n = np.full(c * CLASS, 0.0)
        n[:v] = sizes + 0.5
        by_class = n.reshape(c, CLASS)
        with np.errstate(divide="ignore"):
            self.bo = np.maximum(np.log(by_class / by_class.sum(1, keepdims=True)), -1e4).astype(F4)
            self.bc = np.log(by_class.sum(1) / n.sum()).astype(F4)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(F4)
        self.x = normal(v, 3 * h, scale=0.1)
        self.u = normal(h, 3 * h, scale=1 / math.sqrt(h))
        self.b = np.zeros(3 * h, F4)
        self.wc = normal(h, c, scale=0.05)
        self.wo = normal(c, h, CLASS, scale=0.05)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, flat[at : at + old.size].reshape(old.shape).astype(F4))
            at += old.size
        return self

    def step(self, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """New state, and what backpropagation needs."""
        k = HIDDEN
        g = np.take(self.x, ids, axis=0)
        g += self.b
        a = h @ self.u
        zr = g[:, : 2 * k]
        zr += a[:, : 2 * k]
        zr *= F4(0.5)
        np.tanh(zr, out=zr)
        zr += 1
        zr *= F4(0.5)
        z, r, n = zr[:, :k], zr[:, k:], g[:, 2 * k :]
        n += r * a[:, 2 * k :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, a[:, 2 * k :]

    def stepper(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """``step`` for scoring, which gives the new state alone: biases and halves are in the weights."""
        k = HIDDEN
        half = np.repeat(np.array([0.5, 1], F4), [2 * k, k])
        x, u = (self.x + self.b) * half, self.u * half

        def step(ids: np.ndarray, h: np.ndarray) -> np.ndarray:
            g = np.take(x, ids, axis=0)
            a = h @ u
            zr = g[:, : 2 * k] + a[:, : 2 * k]
            np.tanh(zr, out=zr)
            zr += 1
            zr *= F4(0.5)
            n = a[:, 2 * k :]
            n *= zr[:, k:]
            n += g[:, 2 * k :]
            n = np.tanh(n)
            new = h - n
            new *= zr[:, :k]
            new += n
            return new

        return step

    def output(self, h: np.ndarray, target: np.ndarray, slopes: dict | None = None) -> np.ndarray | None:
        """Log-probability of each target; with ``slopes``, the gradients of their negative sum instead."""
        c = target // CLASS
        order = np.argsort(c, kind="stable")
        h, c, word = h[order], c[order], target[order] % CLASS
        rows = np.arange(len(h))
        logits = _outputs(h, self.wc, self.bc)
        own = logits[rows, c] if slopes is None else None
        p, total = _exponents(logits)
        if slopes is None:
            out = own - np.log(total)
        else:
            p *= (1 / total)[:, None]
            p[rows, c] -= 1
            slopes["wc"], slopes["bc"] = h.T @ p, p.sum(0)
            dh = p @ self.wc.T
            slopes["wo"], slopes["bo"] = np.zeros_like(self.wo), np.zeros_like(self.bo)
        bounds = np.searchsorted(c, np.arange(len(self.bc) + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            some = slice(bounds[k], bounds[k + 1])
            hk, at = h[some], (rows[: bounds[k + 1] - bounds[k]], word[some])
            logits = _outputs(hk, self.wo[k], self.bo[k])
            own = logits[at] if slopes is None else None
            p, total = _exponents(logits)
            if slopes is None:
                out[some] += own - np.log(total)
            else:
                p *= (1 / total)[:, None]
                p[at] -= 1
                slopes["wo"][k], slopes["bo"][k] = hk.T @ p, p.sum(0)
                dh[some] += p @ self.wo[k].T
        back = np.empty_like(dh if slopes is not None else out)
        back[order] = dh if slopes is not None else out
        if slopes is None:
            return back
        slopes["h"] = back
        return None


class Trainer:
    """Adagrad over truncated windows."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.tokens = net, rate, 0
        self.past = {k: np.full(getattr(net, k).shape, 1e-3, F4) for k in net.NAMES}

    def _move(self, k: str, g: np.ndarray, rows: np.ndarray | None = None) -> None:
        g = np.clip(g, -1, 1)
        if rows is None:
            self.past[k] += g * g
            getattr(self.net, k)[...] -= self.rate * g / np.sqrt(self.past[k])
        else:
            past = self.past[k][rows] + g * g
            self.past[k][rows] = past
            getattr(self.net, k)[rows] -= self.rate * g / np.sqrt(past)

    def learn(self, sequences: list[np.ndarray], end: int) -> None:
        """Windows over sequences side by side; the state passes from window to window."""
        sequences = sorted(sequences, key=len, reverse=True)
        lengths = np.array([len(s) for s in sequences])
        grid = np.full((len(sequences), int(lengths[0]) + 1), end, np.int32)
        for i, s in enumerate(sequences):
            grid[i, 1 : len(s) + 1] = s
        h = np.zeros((len(sequences), HIDDEN), F4)
        for t in range(0, int(lengths[0]), STEPS):
            active = int(np.searchsorted(-lengths, -t))
            h = self._window(grid[:active, t : t + STEPS + 1], np.minimum(lengths[:active] - t, STEPS), h[:active])

    def _window(self, grid: np.ndarray, lengths: np.ndarray, h: np.ndarray) -> np.ndarray:
        net, k = self.net, HIDDEN
        kept, before = [], []
        steps = min(STEPS, grid.shape[1] - 1)
        counts = [int(np.searchsorted(-lengths, -t)) for t in range(steps)]
        steps = sum(n > 0 for n in counts)
        last = h.copy()
        for t in range(steps):
            n = counts[t]
            before.append(h[:n])
            kept.append(net.step(grid[:n, t], h[:n]))
            h = kept[-1][0]
            last[:n] = h
        states = np.concatenate([x[0] for x in kept])
        target = np.concatenate([grid[: counts[t], t + 1] for t in range(steps)])
        slopes: dict = {}
        net.output(states, target, slopes)
        m = len(target)
        self.tokens += m
        dg = np.empty((m, 3 * k), F4)
        du = np.zeros_like(net.u)
        at, carry = m, np.zeros((0, k), F4)
        for t in reversed(range(steps)):
            n = counts[t]
            at -= n
            d = slopes["h"][at : at + n]
            d[: len(carry)] += carry
            _, z, r, new, an = kept[t]
            prev = before[t]
            g = dg[at : at + n]
            rest = 1 - z
            dz, dr, dn = g[:, :k], g[:, k : 2 * k], g[:, 2 * k :]
            np.multiply(d, rest, out=dn)
            dn *= 1 - new * new
            np.multiply(d, prev - new, out=dz)
            rest *= z
            dz *= rest
            np.multiply(dn, an, out=dr)
            dr *= r * (1 - r)
            da = g.copy()
            da[:, 2 * k :] *= r
            du += prev.T @ da
            carry = da @ net.u.T
            carry += d * z
        scale = F4(1 / math.sqrt(m))
        ids = np.concatenate([grid[: counts[t], t] for t in range(steps)])
        order = np.argsort(ids, kind="stable")
        ordered = ids[order]
        begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        rows = ordered[begin]
        self._move("x", np.add.reduceat(dg[order], begin, axis=0) * scale, rows)
        for name, g in (("u", du), ("b", dg.sum(0)), ("wc", slopes["wc"]), ("bc", slopes["bc"]), ("wo", slopes["wo"]), ("bo", slopes["bo"])):
            self._move(name, g * scale)
        return last


def score_texts(net: Network, texts: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log-probability of each text, a list of symbols that closes with the end."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order])
    total = np.zeros(len(texts))
    if not len(texts):
        return total
    flat = np.concatenate([texts[i] for i in order])
    begin = np.cumsum(lengths) - lengths
    h = np.zeros((len(texts), HIDDEN), F4)
    ids = np.full(len(texts), end, np.int32)
    states, targets, owners, held = [], [], [], 0
    step = net.stepper()
    for t in range(int(lengths[0])):
        n = int(np.searchsorted(-lengths, -t))
        h = step(ids[:n], h[:n])
        ids = flat[begin[:n] + t]
        states.append(h)
        targets.append(ids)
        owners.append(n)
        held += n
        if held > 32_768 or t == lengths[0] - 1:
            p = net.output(np.concatenate(states), np.concatenate(targets))
            at = 0
            for n in owners:
                total[:n] += p[at : at + n]
                at += n
            states, targets, owners, held = [], [], [], 0
    out = np.empty(len(texts))
    out[order] = total
    return out


def average(models: DataFrame) -> tuple[int, np.ndarray] | None:
    """Weights of all tasks ``chunk, tokens, weights``, averaged by tokens. Each chunk of the weights is summed
    apart, so a task holds a chunk and no model, however many tasks trained."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for at in range(0, b.num_rows, 100):
                for chunk, tokens, raw in zip(*(c.to_pylist() for c in b.slice(at, 100).columns), strict=True):
                    part = np.frombuffer(raw, F4).astype(np.float64) * tokens
                    if chunk in sums:
                        sums[chunk][0] += tokens
                        sums[chunk][1] += part
                    else:
                        sums[chunk] = [tokens, part]
        out = [(k, n, (x / n).astype(F4).tobytes()) for k, (n, x) in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 3, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["chunk", "tokens", "weights"])

    rows = models.repartition("chunk").mapInArrow(add, CHUNKS).toArrow().to_pylist()
    if not rows:
        return None
    rows.sort(key=lambda r: r["chunk"])
    return rows[0]["tokens"], np.concatenate([np.frombuffer(r["weights"], F4) for r in rows])


def train(docs: DataFrame, training: Column, v: Vocabulary, rate: float = 0.1) -> Network:
    sc = docs.sparkSession.sparkContext
    net = Network(v.sizes)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS[-1]))
    begin = 0
    for end in ROUNDS:
        shared = sc.broadcast((v, net))

        def local(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocab, start = shared.value
            trainer = Trainer(Network(vocab.sizes).load(start.flat()), rate)
            held: list[np.ndarray] = []
            for b in batches:
                for h in wordhash.many(b.column("text").to_pylist()):
                    s = vocab.symbols(h)
                    held += [s[i : i + SEQUENCE] for i in range(0, len(s), SEQUENCE)]
                    if len(held) >= TOGETHER:
                        trainer.learn(held, vocab.end)
                        held = []
            if held:
                trainer.learn(held, vocab.end)
            if trainer.tokens:
                flat = trainer.net.flat()
                chunks = [flat[i : i + CHUNK].tobytes() for i in range(0, len(flat), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int64()), pa.array([trainer.tokens] * len(chunks), pa.int64()), pa.array(chunks, pa.binary())], ["chunk", "tokens", "weights"])

        some = docs.where(training & (F.coalesce(part, F.lit(0)) >= begin) & (F.coalesce(part, F.lit(0)) < end))
        if found := average(some.select(F.col("text").cast("binary").alias("text")).mapInArrow(local, CHUNKS)):
            net.load(found[1])
        begin = end
    return net


def score_documents(spark: SparkSession, docs: DataFrame, training: Column, *, symbols: int = 4096, rate: float = 0.1) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``."""
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = scratch.cut(count_words(docs.where(training)), "counts")
    v = vocabulary(counts, docs.where(training).count(), symbols)
    net = train(docs, training, v, rate) if v.texts else Network(v.sizes)
    shared = spark.sparkContext.broadcast((v, net))
    names = ["row", "doc_id", "n_tokens", "known", "logs", "other_logs", "n_other", "model", "tail", "tail_n"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocab, model = shared.value
        row = TaskContext.get().partitionId() << 33
        log = np.log10(vocab.counts + 0.5)
        other = vocab.symbol == vocab.unknown
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal row
            scores = score_texts(model, [x[0] for x in held], vocab.end) / math.log(10)
            columns = list(zip(*((row + i, *x[1:-2], float(s), *x[-2:]) for i, (x, s) in enumerate(zip(held, scores, strict=True))), strict=True))
            row += len(held)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for b in batches:
            for doc, h in zip(b.column("doc_id").to_pylist(), wordhash.many(b.column("text").to_pylist()), strict=True):
                at, there = vocab.look_up(h)
                s = np.full(len(h) + 1, vocab.unknown, np.int32)
                s[-1] = vocab.end
                at = at[there]
                s[:-1][there] = vocab.symbol[at] if len(at) else 0
                tail, tail_n = np.unique(h[~there], return_counts=True)
                known = len(at) + (vocab.texts > 0)
                far = at[other[at]] if len(at) else at
                held.append((s, doc, len(h) + 1, known, float(log[at].sum()) + math.log10(vocab.texts + 0.5), float(log[far].sum()), int((s[:-1] == vocab.unknown).sum()), tail.view(np.int64), tail_n.astype(np.int32)))
                size += len(s)
                if size > BLOCK:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    schema = "row long, doc_id long, n_tokens long, known long, logs double, other_logs double, n_other long, model double, tail array<long>, tail_n array<int>"
    scored = scratch.cut(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(local, schema), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.tail_n").alias("k"))
    c = F.coalesce("n", F.lit(0))
    met = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("k") * F.log10(c + 0.5)).alias("more"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("seen"))
    more = F.coalesce("more", F.lit(0.0))
    base = F.col("logs") + more - F.col("n_tokens") * math.log10(v.total + 0.5 * (v.distinct + 1))
    model = F.col("model") + F.col("other_logs") + more - F.col("n_other") * math.log10(v.other_total + 0.5 * (v.other_distinct + 1))
    return scored.join(met, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (model if v.texts else base).alias("score"),
    )
