"""Substring deduplication with a sparse suffix array over documents' words.

Suffixes are retained at minimiser positions: of every ``window`` consecutive word runs of length
``seed`` the one with the least hash is selected, so two texts that share ``seed + window - 1`` words
select the same places in them, wherever these stand. The context of a suffix is all that a run of
``least`` words around its seed can reach. Suffixes are sorted by a hash of their context, and
neighbours of one context are compared. The first suffix of each context stands for the others: where
contexts of a seed differ, each of its runs of ``least`` words is sorted by its hash, and neighbours of
equal runs are compared. So every place of a repeated run but the first has an earlier one to meet.
Matches of two texts on the same diagonal are merged, met with the texts' words, and
extended left and right to their full length. Only matches of at least ``least`` words count.

Sorting spreads a run that very many texts contain over many partitions, and each is compared with its
neighbours alone, so work stays in proportion to the repeated words. Of each match the later place
(by document, then position) is marked; the earlier stays, so the first copy of every passage is kept.

Defined results: words are runs of other than ASCII space, compared with A-Z in lower case and by
64-bit hashes; null and short texts have no matches; rows with equal texts match whole; rows
with null ids, or repeating an id with the same text, are not compared with each other; of an id with
different texts the one with the greatest hash takes part, the others stay as they are; very long texts
take part whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm import wordhash
from quadrille.llm.common import Scratch
from quadrille.llm.components import neighbours
from quadrille.llm.ngram_join import ids_filter, passes

U = np.uint64


def _slide(x: np.ndarray, window: int, of) -> np.ndarray:
    """``of`` over each window, by doubling."""
    width = 1
    while width < window:
        step = min(width, window - width)
        x = of(x[: len(x) - step], x[step:])
        width += step
    return x


def minimisers(h: np.ndarray, seed: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions selected by content, and the hashes of the runs that begin there."""
    runs = wordhash.ngrams(h, seed)
    if not len(runs):
        return np.zeros(0, np.int64), runs
    if len(runs) <= window:
        at = np.array([int(runs.argmin())])
        return at, runs[at]
    n = len(runs) - window + 1
    least = _slide(runs, window, np.minimum)  # of each window
    # A run is selected if it is the least of a window that covers it: the greatest of their minima.
    padded = np.zeros(len(runs) + window - 1, U)
    padded[window - 1 : window - 1 + n] = least
    at = np.flatnonzero(_slide(padded, window, np.maximum) == runs)
    return at, runs[at]


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words, from prefix sums, for long runs."""
    if len(h) < n:
        return np.zeros(0, U)
    power, inverse = wordhash.powers(len(h) + 1)
    total = np.append(U(0), np.cumsum(wordhash.mix(h) * power[:-1], dtype=U))
    return wordhash.mix((total[n:] - total[:-n]) * inverse[: len(h) - n + 1])


def suffixes(docs: DataFrame, seed: int, least: int) -> DataFrame:
    """``seed_hash, context, id, at``: each retained suffix with a hash of what a least match may reach."""
    names = ["seed_hash", "context", "id", "at"]
    reach = least - seed

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = wordhash.words(text)[0]
                if len(h) < least:
                    continue
                at, s = minimisers(h, seed, reach + 1)
                edge = np.zeros(reach, U)  # a context that meets the text's end differs from others
                context = run_hashes(np.concatenate([edge, h, edge]), seed + 2 * reach)[at]
                parts.append((s.view(np.int64), context.view(np.int64), np.full(len(at), doc, np.int64), at.astype(np.int32)))
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(local, "seed_hash long, context long, id long, at int")


def runs_around(places: DataFrame, words: DataFrame, seed: int, least: int) -> DataFrame:
    """``run, id, at``: a hash of each run of ``least`` words that holds the seed at one of ``places``."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, at, w in zip(*(b.column(k).to_pylist() for k in ("id", "places", "words")), strict=True):
                runs = run_hashes(np.frombuffer(w, np.uint32).astype(U), least)
                first = np.unique(np.array(at)[:, None] - np.arange(least - seed + 1))
                first = first[(first >= 0) & (first < len(runs))]
                yield pa.RecordBatch.from_arrays([pa.array(runs[first].view(np.int64)), pa.array(np.full(len(first), i, np.int64)), pa.array(first.astype(np.int32))], ["run", "id", "at"])

    return places.join(words, "id").select("id", "places", "words").mapInArrow(local, "run long, id long, at int")


def words_of(docs: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, words``: the word hashes of the texts with these ids, as bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(ids_filter(ids, "id"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = np.flatnonzero(passes(shared.value, b.column("id").to_numpy()))
            b = b.take(pa.array(some))
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                # 32 bits are enough here: a match holds at least a seed that agrees in 64 bits
                words = [(wordhash.words(t)[0] >> U(32)).astype(np.uint32).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(words, pa.binary())], ["id", "words"])

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    return scratch.cut(texts.mapInArrow(local, "id long, words binary").join(ids, "id", "left_semi").dropDuplicates(["id"]), "words")


def run_length(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading elements are equal."""
    n, done, step = min(len(x), len(y)), 0, 64
    while done < n:
        differ = np.flatnonzero(x[done : min(n, done + step)] != y[done : min(n, done + step)])
        if len(differ):
            return done + int(differ[0])
        done = min(n, done + step)
        step *= 4
    return n


def extended(pairs: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """Matches ``id, first, words, of_doc, of_first`` at full length, from pairs on a diagonal."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for a, c, shift, places, x, y in zip(*(b.column(k).to_pylist() for k in ("a", "b", "shift", "places", "x", "y")), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                done = -1
                for p in sorted(places):
                    if p < done:
                        continue
                    q = p + shift
                    right = run_length(x[p:], y[q:])
                    left = run_length(x[:p][::-1], y[:q][::-1])
                    done = p + right
                    n = left + right
                    own = max(0, least - shift) if a == c else 0  # a text that repeats itself keeps one run
                    if n - own >= (1 if own else least):
                        out.append((c, q - left + own, n - own, a, p - left))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], ["id", "first", "words", "of_doc", "of_first"])

    one = words.select(F.col("id").alias("a"), F.col("words").alias("x"))
    two = words.select(F.col("id").alias("b"), F.col("words").alias("y"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(local, "id long, first int, words int, of_doc long, of_first int")


def disputed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``of_id, hash``: ids with several texts, and the hash of the one that takes part."""
    hashed = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("of_id"))
    h = F.xxhash64(F.col("text").cast("string"))
    return scratch.cut(hashed.agg(F.min(h).alias("low"), F.max(h).alias("hash")).where("low <> hash").select("of_id", "hash"), "disputed")


def takes_part() -> Column:
    return F.col("hash").isNull() | (F.col("hash") == F.xxhash64(F.col("text").cast("string")))


def matches(spark: SparkSession, docs: DataFrame, *, least: int = 50, seed: int = 24, scratch: Scratch | None = None) -> DataFrame:
    """``id, first, words, of_doc, of_first``: repeated runs of words; the later place first."""
    if not 1 < seed <= least:
        raise ValueError("a seed must fit into the least match")
    scratch = scratch or Scratch(spark)
    docs = docs.select("doc_id", "text")
    several = disputed(docs, scratch)
    docs = docs.join(several, docs["doc_id"].cast("long") == F.col("of_id"), "left").where(takes_part()).select("doc_id", "text")
    found = scratch.cut(suffixes(docs, seed, least), "suffixes")
    # seeds that occur once have no neighbours; partial counts drop them before anything is sorted
    often = scratch.cut(found.groupBy("seed_hash").agg(F.count("*").alias("n")).where("n > 1").select("seed_hash"), "often")
    kept = scratch.cut(found.join(often, "seed_hash", "left_semi"), "repeated")
    scratch.drop(found, often)
    words = words_of(docs, kept.select("id").distinct(), scratch)
    firsts = scratch.cut(kept.groupBy("seed_hash", "context").agg(F.min(F.struct("id", "at")).alias("first")), "contexts")
    several_ = firsts.groupBy("seed_hash").agg(F.count("*").alias("n")).where("n > 1").select("seed_hash")
    places = firsts.join(several_, "seed_hash", "left_semi").groupBy("first.id").agg(F.collect_set("first.at").alias("places"))
    runs = scratch.cut(runs_around(places, words, seed, least), "runs")
    near = [neighbours(t, [key], ["id", "at"], ["id", "at"], scratch) for t, key in ((kept, "context"), (runs, "run"))]
    scratch.drop(firsts, kept, runs)
    both = near[0].unionByName(near[1])
    later = (F.col("id_1") > F.col("id_2")) | ((F.col("id_1") == F.col("id_2")) & (F.col("at_1") > F.col("at_2")))
    pick = lambda c, first: F.when(later == first, F.col(f"{c}_2")).otherwise(F.col(f"{c}_1"))
    pairs = both.select(pick("id", True).alias("a"), pick("at", True).alias("p"), pick("id", False).alias("b"), pick("at", False).alias("q"))
    pairs = pairs.where("a <> b or p <> q").select("a", "b", (F.col("q") - F.col("p")).alias("shift"), "p")
    # one row for two texts and a diagonal; its places are at most the minimisers of one text
    pairs = scratch.cut(pairs.groupBy("a", "b", "shift").agg(F.collect_set("p").alias("places")), "pairs")
    scratch.release("neighbours")
    out = scratch.cut(extended(pairs, words, least), "matches")
    scratch.only(out, several)
    return out


def merged(found: DataFrame) -> DataFrame:
    """Overlapping matches of a document joined into spans: ``id, spans``, sorted ``[first, end)``."""
    span = F.struct(F.col("first").alias("first"), (F.col("first") + F.col("words")).alias("end"))
    sorted_ = F.array_sort(F.collect_set(span))
    kind = "array<struct<first:int,end:int>>"

    def step(acc, s):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["first"].alias("first"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= s["first"]), joined).otherwise(F.concat(acc, F.array(s)))

    return found.groupBy("id").agg(sorted_.alias("s")).select("id", F.aggregate("s", F.array().cast(kind), step).alias("spans"))


def repeated_spans(spark: SparkSession, docs: DataFrame, *, least: int = 50, seed: int = 24) -> DataFrame:
    """``doc_id, first, words, of_doc, removed``: every place of a repeated run of words.

    ``removed`` marks the later place of a match, ``of_doc`` the document of the other place; the
    earlier place of each match is listed too, unmarked.
    """
    scratch = Scratch(spark)
    found = matches(spark, docs, least=least, seed=seed, scratch=scratch)
    later = found.select(F.col("id").alias("doc_id"), "first", "words", "of_doc", F.lit(True).alias("removed"))
    earlier = found.select(F.col("of_doc").alias("doc_id"), F.col("of_first").alias("first"), "words", F.col("id").alias("of_doc"), F.lit(False).alias("removed"))
    spans = later.unionByName(earlier).groupBy("doc_id", "first", "words").agg(F.max("removed").alias("removed"), F.min("of_doc").alias("of_doc"))
    return scratch.result(spans.select("doc_id", "first", "words", "of_doc", "removed"))


def without_repeats(spark: SparkSession, docs: DataFrame, *, least: int = 50, seed: int = 24) -> DataFrame:
    """``docs`` with the later places of repeated runs cut out of their texts; the columns stay.

    A text that consists of repeats alone becomes empty. Rows with the same id and text are cut alike.
    """
    scratch = Scratch(spark)
    spans = scratch.cut(merged(matches(spark, docs, least=least, seed=seed, scratch=scratch)), "spans")
    several = disputed(docs, scratch)
    spans = scratch.result(spans.join(several, spans["id"] == several["of_id"], "left").select(F.col("id").alias("__of_id"), F.col("spans").alias("__spans"), F.col("hash").alias("__hash")))

    @F.pandas_udf(T.StringType())
    def cut(texts, spans):
        import pandas as pd

        out = []
        for text, some in zip(texts, spans, strict=True):
            if some is None or text is None or not len(some):
                out.append(text)
                continue
            raw = text.encode("utf-8")
            _, starts, ends = wordhash.words(raw)
            parts, at = [], 0
            for s in some:
                if s["first"] >= len(starts):
                    continue
                parts.append(raw[at : starts[s["first"]]])
                at = int(ends[min(s["end"], len(ends)) - 1])
            out.append(b"".join([*parts, raw[at:]]).strip(b" \t\n\r\x0b\x0c").decode("utf-8"))
        return pd.Series(out)

    joined = docs.join(spans, docs["doc_id"] == F.col("__of_id"), "left")
    own = F.col("__hash").isNull() | (F.col("__hash") == F.xxhash64(F.col("text").cast("string")))
    marked = F.col("__spans").isNotNull() & own  # texts without spans stay out of Python
    text = F.when(marked, cut(F.when(marked, F.col("text").cast("string")), F.col("__spans"))).otherwise(F.col("text").cast("string"))
    return joined.withColumn("text", text).drop("__of_id", "__spans", "__hash")
