"""Quality rules whose thresholds come from mergeable quantile sketches of each language and source.

Everything here is DataFrame functions; no Python runs on the executors.

The sketch is a histogram over integer buckets of bounded relative width (1/32): two sketches
merge by adding the counts of equal buckets, so Spark's partial aggregation builds it and any order
of merging gives the same counts. Thresholds are quartile fences: ``q75 + reach * (q75 - q25)``,
with a least margin for each metric, so a few bad documents cannot move them and an even group
loses nothing. A group with fewer than ``min_rows`` documents uses its language's sketch, and that
one, if small too, the sketch of all documents.

Defined results: a null text has no words and fails the base rules; null languages and sources
form groups of their own; repeated rows are judged each; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrille.llm.common import Scratch

SPACES = r"[\x20\x09-\x0D]+"
#: name: (numerator, denominator, scale, least margin); a document above its group's fence fails.
METRICS = {
    "symbols": ("n_symbols", "word_chars", 10_000, 300),
    "dup_lines": ("n_dup_lines", "n_lines", 10_000, 3_500),
    "repeats": ("n_repeat_words", "n_words", 10_000, 2_500),
    "capitals": ("n_upper", "word_chars", 10_000, 1_500),
    "word_length": ("word_chars", "n_words", 100, 300),
}
LEVELS = (("lang", "source"), ("lang",), ())


def bound(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of three words that occurs twice or more in the list.

    Windows are compared by a 64-bit hash. Sorting keeps it at n log n for any length.
    """

    def count(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")),
        )
        return bound(F.array_sort(windows), covered)

    def covered(s: Column) -> Column:
        last = F.size(s) - 1
        twice = F.filter(
            s,
            lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < last) & (F.get(s, j + 1)["h"] == x["h"])),
        )
        at = F.array_sort(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["at"])).alias("n"), i.alias("at"))
        return F.aggregate(at, zero, step, lambda acc: acc["n"])

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(bound(words, count)).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the counts that the rules are about."""
    text_or = F.coalesce(F.col(text), F.lit(""))
    bare = F.regexp_replace(text_or, SPACES, "")
    words = F.filter(F.split(text_or, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text_or, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    kept = lambda of, chars: F.length(F.regexp_replace(of, f"[^{chars}]+", "")).cast("long")
    counts = F.struct(
        F.length(bare).cast("long").alias("word_chars"),
        kept(text_or, r"#*$%&|<>").alias("n_symbols"),
        kept(text_or, "A-Z").alias("n_upper"),
        bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("line"),
        bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeat"))).alias("word"),
    )
    m = docs.select("doc_id", "lang", "source", counts.alias("m"))
    return m.select(
        "doc_id", "lang", "source", F.col("m.word.n").alias("n_words"), "m.word_chars", "m.n_symbols",
        F.col("m.line.dup").alias("n_dup_lines"), F.col("m.word.repeat").alias("n_repeat_words"),
        F.col("m.line.n").alias("n_lines"), "m.n_upper",
    )


def with_base(m: DataFrame, min_words: int, max_repeat_percent: int) -> DataFrame:
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return m.withColumn("base_failed", failed)


def metric(name: str) -> Column:
    top, bottom, scale, _ = METRICS[name]
    return F.when(F.col(bottom) > 0, F.floor(F.lit(scale) * F.col(top) / F.col(bottom))).otherwise(0).cast("long")


def bucket(v: Column) -> Column:
    """The lower end of the value's bucket: exact below 64, else its six leading bits."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    wide = F.pow(F.lit(2.0), shift).cast("long")
    return (F.floor(v / wide) * wide).cast("long")


def sketch(m: DataFrame) -> DataFrame:
    """Counts by language, source, metric and bucket, of documents that pass the base rules."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), bucket(metric(k)).alias("bucket")) for k in METRICS)))
    return m.where(~F.col("base_failed")).select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count("*").alias("n"))


def fences(s: DataFrame, reach: float) -> DataFrame:
    """For each level, group and metric: the number of documents and the fence, from merged sketches."""
    levels = []
    for i, keys in enumerate(LEVELS):
        named = [F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in LEVELS[0]]
        levels.append(s.select(F.lit(i).alias("level"), *named, "metric", "bucket", "n"))
    merged = levels[0].unionByName(levels[1]).unionByName(levels[2]).groupBy("level", *LEVELS[0], "metric", "bucket").agg(F.sum("n").alias("n"))
    group = W.partitionBy("level", *LEVELS[0], "metric")
    ranked = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "all": F.sum("n").over(group)})
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("bucket")))
    quartiles = ranked.groupBy("level", *LEVELS[0], "metric").agg(F.max("all").alias("rows"), at(1).alias("q25"), at(3).alias("q75"))
    margin = F.create_map(*(F.lit(x) for k, v in METRICS.items() for x in (k, v[3])))[F.col("metric")]
    return quartiles.withColumn("fence", F.col("q75") + F.greatest(F.lit(reach) * (F.col("q75") - F.col("q25")), margin))


def adaptive_rules(spark: SparkSession, docs: DataFrame, *, min_words: int = 50, max_repeat_percent: int = 50, reach: float = 3.0, min_rows: int = 50) -> DataFrame:
    """The counts of each document, ``base_failed`` and ``kept``.

    The table of fences has a row for each language and source, so its size depends on the data;
    it is written first, and Spark broadcasts it only below its threshold of bytes. Beyond that,
    the join is a shuffle whose hot groups adaptive execution splits.
    """
    scratch = Scratch(spark)
    m = scratch.cut(with_base(measure(docs), min_words, max_repeat_percent), "measures")
    f = fences(scratch.cut(sketch(m), "sketch"), reach)
    one = lambda k: F.max(F.when(F.col("metric") == k, F.col("fence"))).alias(k)
    wide = f.groupBy("level", *LEVELS[0]).agg(F.max("rows").alias("rows"), *map(one, METRICS))
    wide = scratch.cut(wide.select("level", *LEVELS[0], "rows", F.struct(*METRICS).alias("fence")), "levels")
    fine, by_lang, whole = (wide.where(F.col("level") == i).withColumn("one", F.lit(1)) for i in range(3))
    chosen = (
        fine.alias("f")
        .join(by_lang.alias("l"), F.col("f.lang").eqNullSafe(F.col("l.lang")), "left")
        .join(whole.alias("w"), F.col("f.one") == F.col("w.one"))
        .select(
            F.col("f.lang").alias("of_lang"),
            F.col("f.source").alias("of_source"),
            F.when(F.col("f.rows") >= min_rows, F.col("f.fence")).when(F.col("l.rows") >= min_rows, F.col("l.fence")).otherwise(F.col("w.fence")).alias("fence"),
        )
    )
    chosen = scratch.cut(chosen, "fences")
    joined = m.join(chosen, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    over = [F.when(metric(k) > F.col(f"fence.{k}"), F.lit(k)) for k in METRICS]
    judged = joined.withColumn("reasons", F.array_compact(F.array(F.when(F.col("base_failed"), F.lit("base")), *over)))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"), "reasons",
    )
