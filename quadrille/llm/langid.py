"""Language identification: scripts narrow the candidates, Viterbi labels spans of words.

Training counts byte 4-grams of lower-case letters, by language, in every training text; the sums
form a table of fixed width (``BUCKETS`` hashed grams for each language), so the model is bounded by
the number of languages, which ``most_languages`` limits. Each word has a log-likelihood under each
language. Languages that hardly ever use a word's script (by ranges of code points, which UTF-8
lead bytes tell apart) are no candidates for it. A Viterbi path over the words, with a penalty for
each switch, labels spans; a text's language is the one with most letters on its path, and
the score is its share of them.

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties go to the
language that sorts first; repeated rows are judged each; rows with null ids are training rows;
without any training row every text is ``und``; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import bound_batches

BUCKETS = 1 << 15
SCRIPTS = ("latin", "greek", "cyrillic", "armenian or hebrew", "arabic", "indic", "asian", "han", "hangul", "other")
PIECE = 1 << 20  # bytes of text worked on at once

_SCRIPT = np.zeros(256, np.uint8)
for low, high, k in ((0xCA, 0xCD, 9), (0xCE, 0xCF, 1), (0xD0, 0xD3, 2), (0xD4, 0xD7, 3), (0xD8, 0xDB, 4), (0xDC, 0xDF, 9), (0xE0, 0xE0, 5), (0xE1, 0xE1, 6), (0xE3, 0xE3, 6), (0xE4, 0xE9, 7), (0xEA, 0xED, 8), (0xEE, 0xFF, 9)):
    _SCRIPT[low : high + 1] = k
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def pieces(text: str) -> Iterator[np.ndarray]:
    """Lower-case UTF-8 of the text, cut between words where it is long; a longer word is cut too."""
    buf = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    at = 0
    while at < len(buf):
        to = min(len(buf), at + PIECE)
        if to < len(buf):
            gaps = np.flatnonzero(~_LETTER[buf[at:to]])
            to = at + int(gaps[-1]) + 1 if len(gaps) else to
        yield buf[at:to]
        at = to


def grams(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the 4-gram at each letter byte; each word's start among those and its length; its script."""
    letter = _LETTER[buf]
    padded = np.zeros(len(buf) + 3, np.uint32)
    np.copyto(padded[2:-1], buf, where=letter)
    code = padded[:-3] | padded[1:-2] << np.uint32(8) | padded[2:-1] << np.uint32(16) | padded[3:] << np.uint32(24)
    code = code[letter] * np.uint32(2654435761) >> np.uint32(17)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    starts = np.flatnonzero(first[letter])
    scripts = _SCRIPT[buf[letter]]
    script = np.maximum.reduceat(scripts, starts) if len(starts) else scripts[:0]
    return code, starts, np.diff(np.append(starts, len(code))), script


def count(docs: DataFrame, lang: str) -> DataFrame:
    """``lang, slot, n``: counts of gram buckets, then of words by script, in every text."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name not in sums:
                    sums[name] = np.zeros(BUCKETS + len(SCRIPTS), np.int64)
                for buf in pieces(text):
                    code, _, _, script = grams(buf)
                    sums[name] += np.append(np.bincount(code, minlength=BUCKETS), np.bincount(script, minlength=len(SCRIPTS)))
        for name, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(v[at])], ["lang", "slot", "n"])

    rows = docs.where(F.col("text").isNotNull() & F.col(lang).isNotNull()).select("text", F.col(lang).cast("string").alias("lang"))
    return rows.mapInArrow(local, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


class Model:
    """Log-likelihoods of grams and candidates by script, for the learned languages."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        gram, script = counts[:, :BUCKETS].astype(np.float64), counts[:, BUCKETS:].astype(np.float64)
        self.log = np.ascontiguousarray(np.log((gram + 0.5) / (gram.sum(1, keepdims=True) + 0.5 * BUCKETS)).T.astype(np.float32))
        share = script / np.maximum(script.sum(1, keepdims=True), 1)
        fit = share >= 0.001
        fit[:, ~fit.any(0)] = True  # a script that no language uses rules none out
        self.barred = np.where(fit.T, np.float32(0), np.float32(-60))

    def word_scores(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code, starts, length, script = grams(buf)
        if not len(starts):
            return np.zeros((0, len(self.names)), np.float32), length
        return np.add.reduceat(self.log[code], starts, axis=0) + self.barred[script], length


def path(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The labels, one for each row, with the largest sum of scores less ``penalty`` for each switch."""
    n, k = scores.shape
    best = int(scores.sum(0).argmax())
    if k == 1:
        return np.zeros(n, np.int64)
    # One label throughout is best if no run of words gains more than a switch by leaving it.
    gain = np.cumsum(np.delete(scores, best, 1).max(1) - scores[:, best], dtype=np.float64)
    floor = np.minimum.accumulate(np.append(0.0, gain[:-1]))
    if float((gain - floor).max()) <= penalty:
        return np.full(n, best)
    value, back = steps(None, scores, penalty)
    return trace(int(value.argmax()), back)


def steps(value: np.ndarray | None, scores: np.ndarray, penalty: float, keep: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The best sum for each label after these words, from that before them, and the label before each."""
    n, k = scores.shape
    back = np.zeros((n if keep else 1, k), np.int16)
    own = np.arange(k)
    back[0] = own
    for t in range(n):
        if value is None:
            value = scores[0].astype(np.float64)
            continue
        top = int(value.argmax())
        switch = value[top] - penalty
        stay = value >= switch
        back[t if keep else 0] = np.where(stay, own, top)
        value = np.where(stay, value, switch) + scores[t]
    return value, back


def trace(last: int, back: np.ndarray) -> np.ndarray:
    """The labels of these words, from that of the last and the label before each."""
    out = np.empty(len(back), np.int64)
    out[-1] = last
    for t in range(len(back) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def long_path(parts: list, penalty: float) -> list[np.ndarray]:
    """``path`` over parts of a text, whose scores are made one part at a time by calling ``parts``."""
    best = int(sum(p().sum(0, dtype=np.float64) for p in parts).argmax())
    gain = floor = most = 0.0
    for p in parts:
        scores = p()
        if scores.shape[1] > 1 and len(scores):
            run = gain + np.cumsum(np.delete(scores, best, 1).max(1) - scores[:, best], dtype=np.float64)
            low = np.minimum.accumulate(np.append(min(floor, gain), run[:-1]))
            most, gain, floor = max(most, float((run - low).max())), float(run[-1]), float(low[-1])
    if most <= penalty:
        return [np.full(len(p()), best) for p in parts]
    value, before = None, []
    for p in parts:
        before.append(value)
        if len(scores := p()):
            value, _ = steps(value, scores, penalty, keep=False)
    last, out = int(value.argmax()), []
    for p, start in zip(parts[::-1], before[::-1], strict=True):
        scores = p()
        if len(scores):
            _, back = steps(start, scores, penalty)
            labels = trace(last, back)
            last = int(back[0, labels[0]])
        out.append(labels if len(scores) else np.zeros(0, np.int64))
    return out[::-1]


def label(model: Model, text: str | None, penalty: float) -> tuple[str, float, list[tuple[int, int, str]]]:
    """Language, score, and the spans: first word, number of words, language."""
    if not model.names or not has_letter(text):
        return "und", 0.0, []
    bufs = list(pieces(text))
    if len(bufs) == 1:
        scores, length = model.word_scores(bufs[0])
        labels = path(scores, penalty) if len(scores) else length
    else:  # scores of one piece at a time, made again for each pass
        length = np.concatenate([grams(buf)[2] for buf in bufs])
        labels = np.concatenate(long_path([lambda buf=buf: model.word_scores(buf)[0] for buf in bufs], penalty)) if len(length) else length
    if not len(labels):
        return "und", 0.0, []
    weight = np.bincount(labels, weights=length, minlength=len(model.names))
    top = int(weight.argmax())
    edges = np.append(0, np.flatnonzero(np.diff(labels)) + 1)
    spans = [(int(a), int(b - a), model.names[labels[a]]) for a, b in zip(edges, np.append(edges[1:], len(labels)), strict=True)]
    return model.names[top], float(weight[top] / weight.sum()), spans


def fit(docs: DataFrame, training: Column, lang: str = "lang", most_languages: int = 200) -> Model:
    """Learn from the texts and languages of all rows where ``training`` holds."""
    bound_batches(docs.sparkSession)
    learned = docs.where(training)
    if learned.where(F.col("text").isNotNull() & F.col(lang).isNotNull()).select(lang).distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"over {most_languages} languages; the model holds no more")
    rows = count(learned, lang).toArrow()  # at most most_languages times BUCKETS rows
    names = sorted(set(rows["lang"].to_pylist()))
    table = np.zeros((len(names), BUCKETS + len(SCRIPTS)), np.int64)
    if names:
        place = np.searchsorted(np.array(names), np.array(rows["lang"].to_pylist()))
        table[place, rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return Model(names, table)


def identify(docs: DataFrame, model: Model, penalty: float = 12.0, prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``spans`` after its columns; a prefix keeps their names apart
    from columns of ``docs``, which they replace otherwise."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # most_languages x BUCKETS x 4 bytes at most
    kind = "struct<lang_pred:string,score:double,spans:array<struct<first:int,words:int,lang:string>>>"

    @F.pandas_udf(kind)
    def judged(texts):
        import pandas as pd

        out = [label(shared.value, t, penalty) for t in texts]
        return pd.DataFrame({"lang_pred": [o[0] for o in out], "score": [o[1] for o in out], "spans": [[{"first": a, "words": n, "lang": x} for a, n, x in o[2]] for o in out]})

    added = ("lang_pred", "score", "spans")
    names = [c for c in docs.columns if c not in [prefix + a for a in added]]
    got = docs.select(*names, judged(F.col("text").cast("string")).alias("__judged"))
    return got.select(*names, *(F.col(f"__judged.{a}").alias(prefix + a) for a in added))


def held_out(doc_id: str = "doc_id", n: int = 4, at: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``at`` modulo ``n``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n == at, F.lit(False))
