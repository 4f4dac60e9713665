"""Document quality by pairwise ranking: a Bradley-Terry model on features of the texts.

Preference pairs join a document marked good with one marked bad; the model learns weights by the
logistic loss on differences of their features, so that the better one gets the higher utility. A
threshold on the utilities, the one that sets good and bad rows apart best, is mapped to ``cut`` by the
score.

All labelled training rows take part, each in pairs with every row of the other mark. How a row fares against
all of them depends on its own utility and on the histogram of theirs, so Newton's steps need no table of
pairs: two passes over the features a step, of which sums of fixed size reach the driver. Features
are made once from whole texts and written; the fit and the scoring read them.

Defined results: a null or empty text has the features of no words and gets a score like any other;
rows without a label are only scored; repeated rows are scored each, and all texts of a labelled id have its label; without labels of both kinds
every score is 0.5; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import wordhash
from quadrille.llm.common import Scratch

HASHED = 64  # slots of hashed words
NAMES = ("log_words", "log_bytes", "word_bytes", "upper", "digit", "sign", "space", "line", "high", "distinct", "distinct_lines", "repeat", "sign_end", "single_sign", "log_longest")
WIDTH = len(NAMES) + HASHED
PART = 1 << 20
REACH = 64.0  # utilities beyond it count as this
FINE, COARSE = 4096, 256  # bins of utilities for gradients and for the terms of pairs in the curvature
LEVELS = 1 << 14  # bins for the threshold
SLOTS = 32  # sums that reach the driver

_UPPER, _DIGIT, _SIGN, _HIGH = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SIGN[[39, 44, 45, 46]] = False  # common in prose
_HIGH[128:] = True


def features(text: bytes | None) -> np.ndarray:
    """The text's features: shares and logarithms, in a fixed range whatever its length."""
    out = np.zeros(WIDTH, np.float64)
    text = text or b""
    if not text:
        return out
    n = len(text)
    tally = np.zeros(256, np.int64)
    for at in range(0, n, PART):
        tally += np.bincount(np.frombuffer(text[at : at + PART], np.uint8), minlength=256)
    h, starts, ends = wordhash.words(text)
    m = len(h)
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = len(NAMES)
    out[: 2] = math.log1p(m) / 10, math.log1p(n) / 12
    out[3:9] = [tally[c].sum() / n for c in (_UPPER, _DIGIT, _SIGN, wordhash.SPACE)] + [text.count(b"\n") / n, tally[_HIGH].sum() / n]
    out[10] = len(set(lines)) / max(1, len(lines))
    if m:
        size = ends - starts
        buf = np.frombuffer(text, np.uint8)
        grams = wordhash.ngrams(h, 2)
        out[2] = min(size.mean() / 20, 2)
        out[9] = len(np.unique(h)) / m
        out[11] = 1 - len(np.unique(grams)) / max(1, len(grams)) if len(grams) else 0
        out[12] = _SIGN[buf[ends - 1]].mean()
        out[13] = ((size == 1) & _SIGN[buf[starts]]).mean()
        out[14] = math.log1p(int(size.max())) / 10
        out[k:] = np.sqrt(np.bincount((h >> np.uint64(58)).astype(np.int64), minlength=HASHED) / m)
    return out


def featured(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the features of each row's text, as 32-bit floats."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t).astype(np.float32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.binary())], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(local, "doc_id long, x binary")


def labelled(rows: DataFrame, labels: DataFrame, training, label: str) -> DataFrame:
    """``x, y`` of every row that has a label where ``training`` holds; of several labels the greatest counts."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(training)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    return rows.join(known, "doc_id").select("x", "y")


def vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, WIDTH).astype(np.float64)


def summed(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum over all rows ``x, y`` of a function of blocks of them; None without rows."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), None
        for b in batches:
            if b.num_rows:
                found = of(vectors(b.column("x")), b.column("y").to_numpy())
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part % SLOTS], pa.int32()), pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "part", "total"])

    def together(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted(((r["slot"], r["part"], r["total"]) for b in parts for r in b.to_pylist()), key=lambda r: r[1])
        total = sum(np.frombuffer(r[2], np.float64) for r in held)
        yield pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "total"])

    whole = lambda t: pa.Table.from_batches(together(t.to_batches()))
    found = rows.select("x", "y").mapInArrow(local, "slot int, part int, total binary").groupBy("slot").applyInArrow(whole, "slot int, total binary").toArrow()
    held = sorted(zip(found["slot"].to_pylist(), found["total"].to_pylist(), strict=True))
    return sum(np.frombuffer(t, np.float64) for _, t in held) if held else None


class Ranker:
    """Weights, feature scales, and the line that maps utility to score."""

    def __init__(self, weights: np.ndarray, centre: np.ndarray, scale: np.ndarray, threshold: float, slope: float, cut: float):
        self.weights, self.centre, self.scale = weights, centre, scale
        self.threshold, self.slope, self.shift = threshold, slope, math.log(cut / (1 - cut))

    def utility(self, x: np.ndarray) -> np.ndarray:
        return scaled(x, self.centre, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * (self.utility(x) - self.threshold) + self.shift, -40, 40)
        return 1 / (1 + np.exp(-z))


def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows, good rows, and sums of the features and of their squares."""
    return np.concatenate([[len(y), (y == 1).sum()], x.sum(0), (x * x).sum(0)])


def scaled(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - centre) / scale, -8, 8)


def histogram(x: np.ndarray, y: np.ndarray, *, weights: np.ndarray, centre: np.ndarray, scale: np.ndarray, low: float = -REACH, high: float = REACH, bins: int = FINE) -> np.ndarray:
    """How many bad rows, then good ones, have their utility in each bin; those outside are in the outermost."""
    at = np.clip((scaled(x, centre, scale) @ weights - low) * (bins / (high - low)), 0, bins - 1).astype(np.int64)
    return np.bincount(at + bins * (y == 1), minlength=2 * bins).astype(np.float64)


def _against(others: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """For each bin, the kernel of the distance to the others' bins, summed over them."""
    n = len(others)
    return np.fft.irfft(np.fft.rfft(others, 4 * n) * np.fft.rfft(kernel, 4 * n), 4 * n)[n - 1 : 2 * n - 1]


def _distances(bins: int) -> np.ndarray:
    return np.arange(1 - bins, bins) * (2 * REACH / bins)


def steepness(x: np.ndarray, y: np.ndarray, *, weights: np.ndarray, centre: np.ndarray, scale: np.ndarray, slope: np.ndarray, bend: np.ndarray) -> np.ndarray:
    """The gradient's sum, the rows' own part of the curvature, and sums of scaled features by class and bin.

    ``slope`` and ``bend`` have the loss's derivatives for a bad and a good row of each bin.
    """
    z, good = scaled(x, centre, scale), (y == 1).astype(np.int64)
    at = np.clip((z @ weights + REACH) * (FINE / (2 * REACH)), 0, FINE - 1).astype(np.int64)
    wide = at // (FINE // COARSE)
    g = slope[good, at] @ z
    own = (z * bend[good, wide][:, None]).T @ z
    sums = np.zeros((2 * COARSE, z.shape[1]))
    np.add.at(sums, wide + COARSE * good, z)
    return np.concatenate([g, own.ravel(), sums.ravel()])


def solve(total: Callable[[Callable], np.ndarray | None], *, cut: float = 0.7, rounds: int = 12, penalty: float = 1e-4) -> Ranker | None:
    """Learn from the sums over all labelled rows that ``total`` gives: of all pairs of a good and a bad one, the
    mean logistic loss is brought to its least by Newton's steps."""
    m = total(moments)
    if m is None or not 0 < m[1] < m[0]:
        return None
    width, good, bad = (len(m) - 2) // 2, m[1], m[0] - m[1]
    centre = m[2 : 2 + width] / m[0]
    at = {"centre": centre, "scale": np.sqrt(np.maximum(0, m[2 + width :] / m[0] - centre**2)) + 1e-3}
    chance = lambda d: 1 / (1 + np.exp(np.clip(d, -40, 40)))  # noqa: E731  that the worse wins, by the better one's lead
    fine, far = chance(_distances(FINE)), _distances(COARSE)
    curve = chance(far) * chance(-far)
    pairs = curve[np.arange(COARSE)[:, None] - np.arange(COARSE) + COARSE - 1]
    w = np.zeros(width)
    for _ in range(rounds):
        seen = total(partial(histogram, weights=w, **at)).reshape(2, FINE) / [[bad], [good]]
        wide = seen.reshape(2, COARSE, -1).sum(2)
        # A good row leads a bad one by the difference of their bins; for the bad row the sign is the other way.
        slope = np.stack([_against(seen[1], fine[::-1]) / bad, -_against(seen[0], fine) / good])
        bend = np.stack([_against(wide[1], curve) / bad, _against(wide[0], curve) / good])
        found = total(partial(steepness, weights=w, slope=slope, bend=bend, **at))
        g, own, sums = np.split(found, [width, width + width * width])
        low, high = sums.reshape(2, COARSE, width) / np.array([bad, good])[:, None, None]
        both = high.T @ pairs @ low
        step = np.linalg.solve(own.reshape(width, width) - both - both.T + penalty * np.eye(width), g + penalty * w)
        w = w - step * min(1, 4 / (np.linalg.norm(step) + 1e-12))
        if np.abs(step).max() < 1e-3:
            break
    seen = np.flatnonzero(total(partial(histogram, weights=w, **at)).reshape(2, FINE).sum(0))
    low, high = (float(k * (2 * REACH / FINE) - REACH) for k in (seen[0], seen[-1] + 1))
    counts = total(partial(histogram, weights=w, low=low, high=high, bins=LEVELS, **at)).reshape(2, LEVELS)
    below = np.cumsum(counts, 1) / [[bad], [good]]
    both = below[0] - below[1]  # bad rows caught and good ones kept, below and above each bin's end
    best = np.flatnonzero(both >= both.max() - 1e-12)
    level = lambda k: low + (k + 1) * (high - low) / LEVELS
    threshold = (level(best[0]) + level(best[-1])) / 2
    spread = level(np.searchsorted(below[1], 0.5)) - level(np.searchsorted(below[0], 0.5)) or 1.0
    return Ranker(w, at["centre"], at["scale"], float(threshold), 6 / abs(float(spread)), cut)


def fit(x: np.ndarray, y: np.ndarray, *, cut: float = 0.7) -> Ranker | None:
    """Learn from arrays of features and labels."""
    return solve(lambda of: of(x, y), cut=cut)


def score(rows: DataFrame, model: Ranker | None, cut: float = 0.7) -> DataFrame:
    """``doc_id, score, predicted`` of every row ``doc_id, x``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = m.score(vectors(b.column("x"))) if m is not None else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(local, "doc_id long, score double, predicted int")


def rank_quality(docs: DataFrame, labels: DataFrame, training, *, label: str = "quality", cut: float = 0.7) -> DataFrame:
    """Fit on all labels where ``training`` holds and score all documents."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.cut(featured(docs), "features")
    known = scratch.cut(labelled(rows, labels, training, label), "labelled")
    model = solve(partial(summed, known), cut=cut)
    return scratch.result(score(rows, model, cut))
