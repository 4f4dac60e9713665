"""Continuous queries as Structured Streaming graphs.

A stateless plan is a filter on the stream. A plan that receives invalidations keeps, for each key, its
partners in the last result: the stored tuples it met, or itself where the plan has no join. Rows of a key
are handled in the order of ``version_ts``; on a batch by windows, on a stream by keyed state. Output rows
are ``kind, key, partner, version_ts``: TUPLE for a match, INVALIDATION when a key (or a join partner) no
longer matches, also where the stream says so itself by a row of that kind, and IDLE_REMOVED, without a
version, when the state of a key is dropped because it was silent for so many watermarks.

The number of watermarks before a row, its generation, is a column ``generation`` of the stream; live
streams may use the micro-batch number for it. On a stream it also drives the timers that drop silent keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrille.functions import boxes as B
from quadrille.operators.filters import Filter, apply_filters, apply_pair_filters
from quadrille.operators.joins import overlap_join
from quadrille.operators.tuples import IDLE_REMOVED, INVALIDATION, TUPLE, WATERMARK
from quadrille.operators.versions import TableConfig, resolve
from quadrille.plans.continuous import ContinuousPlan, Transformation

OUTPUT = "kind string, key string, partner string, version_ts long"


def transformed(df: DataFrame, steps: tuple[Transformation, ...]) -> tuple[DataFrame, Column]:
    """``df`` with its transformed box in ``x_lo_d, x_hi_d``, and whether the steps keep a row.

    Box filters test the original box, also after enlargements.
    """
    n = B.dimensions_of(df)
    out = df.withColumns({f"x_{k}_{d}": F.col(f"{k}_{d}") for d in range(n) for k in ("lo", "hi")})
    kept = F.lit(True)
    for t in steps:
        if t.kind == "key":
            kept = kept & (F.col("key") == t.values[0])
        elif t.kind == "box":
            kept = kept & B.meets_box(t.values[0])
        elif t.kind == "filter":
            kept = kept & F.coalesce(Filter(*t.values).on_tuple(F.col("data"), F.col("key")), F.lit(False))
        else:
            new = {"amount": lambda v: B.padded(n, *v, prefix="x_"), "factor": lambda v: B.enlarged_by_factor(n, *v, prefix="x_"), "metres": lambda v: B.enlarged_by_metres(*v, prefix="x_")}[t.kind](t.values)
            out = out.withColumns({f"x_{k}": v for k, v in new.items()})
    return out, F.coalesce(kept, F.lit(False))


def matched(stream: DataFrame, plan: ContinuousPlan) -> DataFrame:
    """Tuples of the stream with ``matches``: whether a range plan reports them.

    Of a plan that receives invalidations, those of the stream stand among them; they never match.
    """
    is_tuple = F.col("kind") == TUPLE
    live = stream.where((is_tuple & B.meets_box(plan.range)) | ((F.col("kind") == INVALIDATION) & F.lit(plan.invalidations)))
    out, kept = transformed(live, plan.stream_steps)
    for f in plan.stream_filters:
        kept = kept & F.coalesce(f.on_tuple(F.col("data"), F.col("key")), F.lit(False))
    met = B.meets_box(plan.compare, "x_")
    return out.withColumn("matches", is_tuple & kept & (met if plan.positive else ~met))


def watermark_rows(stream: DataFrame, plan: ContinuousPlan) -> DataFrame:
    """Watermarks for the receiver, their key suffixed by the stream's table."""
    return stream.where(F.col("kind") == WATERMARK).select(F.lit(WATERMARK).alias("kind"), F.concat_ws("_", "key", F.lit(plan.stream_table)).alias("key"), F.lit(None).cast("string").alias("partner"), "version_ts")


def continuous_range(stream: DataFrame, plan: ContinuousPlan) -> DataFrame:
    """Batch or streaming: matches, and of a plan that receives invalidations what stopped to match."""
    stream = with_generation(stream)
    flagged = matched(stream, plan)
    if plan.invalidations:
        seen = flagged.select("key", "version_ts", "generation", F.when(F.col("matches"), F.lit("")).alias("partner"))
        out = stateful(seen, stream, plan, joined=False)
    else:
        out = flagged.where("matches").select(F.lit(TUPLE).alias("kind"), "key", F.lit(None).cast("string").alias("partner"), "version_ts")
    return out.unionByName(watermark_rows(stream, plan)) if plan.watermarks else out


def continuous_join(stream: DataFrame, stored: DataFrame, plan: ContinuousPlan, config: TableConfig = TableConfig(), cell: list[float] | None = None) -> DataFrame:
    """Pairs of a stream tuple and the newest stored tuples that its transformed box meets.

    Columns are prefixed by ``l_`` and ``r_``. ``cell`` gives the grid on a stream, whose extents are
    not known beforehand. Of a plan that receives invalidations or watermarks, rows as those of a range
    plan, with the stored tuple's key as ``partner``.
    """
    stream = with_generation(stream)
    live = apply_filters(stream.where(F.col("kind") == TUPLE), list(plan.stream_filters))
    left, kept = transformed(live, plan.stream_steps)
    left = left.where(kept & B.meets_box(plan.range, "x_"))
    right, kept = transformed(resolve(stored, config), plan.stored_steps)
    right = right.where(kept)
    if stream.isStreaming and cell is None:
        raise ValueError("a stream join needs its grid's cell sizes")
    pairs = overlap_join(_by_transformed(left), _by_transformed(right), cell=cell)
    pairs = pairs.select(*(F.col(c) for c in pairs.columns if c[2:5] not in ("lo_", "hi_")))
    pairs = pairs.withColumnsRenamed({c: c[0] + "_" + c[4:] for c in pairs.columns if c[2:4] == "o_"})
    pairs = apply_pair_filters(pairs, list(plan.join_filters), "l_", "r_")
    if not (plan.invalidations or plan.watermarks):
        return pairs
    met = pairs.select(F.col("l_key").alias("key"), F.col("l_version_ts").alias("version_ts"), F.col("l_generation").alias("generation"), F.col("r_key").alias("partner"))
    if plan.invalidations:  # a tuple without partners counts too, and so does an invalidation of the stream
        every = stream.where(F.col("kind").isin(TUPLE, INVALIDATION)).select("key", "version_ts", "generation", F.lit(None).cast("string").alias("partner"))
        out = stateful(met.unionByName(every), stream, plan, joined=True)
    else:
        out = met.select(F.lit(TUPLE).alias("kind"), "key", "partner", "version_ts")
    return out.unionByName(watermark_rows(stream, plan)) if plan.watermarks else out


def with_generation(stream: DataFrame) -> DataFrame:
    return stream.withColumn("generation", (F.col("generation") if "generation" in stream.columns else F.lit(0)).cast("long"))


def _by_transformed(df: DataFrame) -> DataFrame:
    """The transformed box in place of the original one, which is kept as ``o_``."""
    n = B.dimensions_of(df)
    names = [f"{k}_{d}" for d in range(n) for k in ("lo", "hi")]
    rest = [F.col(c) for c in df.columns if c not in names and c[2:] not in names]
    return df.select(*rest, *(F.col(c).alias("o_" + c) for c in names), *(F.col("x_" + c).alias(c) for c in names))


def advance(state: tuple[int, set], rows: list[tuple[int, int, set]], idle_after: int) -> tuple[tuple[int, set], list[tuple]]:
    """One key's state machine. ``state``: generation of the last match, partners in the last result.
    ``rows``: version, generation and partners, in order."""
    last, partners = state
    out: list[tuple] = []
    for version, generation, now in rows:
        if idle_after and partners and generation - last > idle_after:
            out += [(IDLE_REMOVED, p, None) for p in sorted(partners)]
            partners = set()
        out += [(TUPLE, p, version) for p in sorted(now)] + [(INVALIDATION, p, version) for p in sorted(partners - now)]
        last, partners = generation, now
    return (last, partners), out


def is_idle(last: int, now: int, idle_after: int) -> bool:
    """Whether the ``now``-th watermark removes a key that was active last in generation ``last``."""
    return idle_after > 0 and last <= now - idle_after


def stateful(seen: DataFrame, stream: DataFrame, plan: ContinuousPlan, joined: bool) -> DataFrame:
    """What each key's rows ``key, version_ts, generation, partner`` add to the results and take from them.

    ``partner`` is NULL where a row has none. All of ``stream`` tells how many watermarks there were.
    """
    out = _on_stream(seen, stream, plan, joined) if stream.isStreaming else _on_batch(seen, stream, plan, joined)
    return out if joined else out.withColumn("partner", F.lit(None).cast("string"))


def _on_batch(seen: DataFrame, stream: DataFrame, plan: ContinuousPlan, joined: bool) -> DataFrame:
    """The state machine as windows over the rows of a key."""
    none = F.array().cast("array<string>")
    if joined:
        rows = seen.groupBy("key", "version_ts", "generation").agg(F.collect_set("partner").alias("now"))
    else:
        rows = seen.select("key", "version_ts", "generation", F.when(F.col("partner").isNull(), none).otherwise(F.array("partner")).alias("now"))
    w = W.partitionBy("key").orderBy("version_ts", "generation", F.size("now"))
    rows = rows.withColumns({"before": F.coalesce(F.lag("now").over(w), none), "last": F.lag("generation").over(w), "next": F.lead("generation").over(w)})
    gone = F.lit(False)
    silent = F.lit(False)
    if plan.idle_after:
        marks = stream.agg(F.max(F.col("generation") + (F.col("kind") == WATERMARK).cast("long"))).first()[0] or 0
        gone = F.coalesce(F.col("generation") - F.col("last") > plan.idle_after, F.lit(False))
        silent = F.col("next").isNull() & (F.lit(marks) - F.col("generation") > plan.idle_after)
    say = lambda kind, some, version: F.transform(some, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("partner"), version.alias("version_ts")))
    version, never = F.col("version_ts"), F.lit(None).cast("long")
    said = F.concat(
        say(IDLE_REMOVED, F.when(gone, F.col("before")).otherwise(none), never), say(TUPLE, F.col("now"), version),
        say(INVALIDATION, F.when(gone, none).otherwise(F.array_except("before", "now")), version), say(IDLE_REMOVED, F.when(silent, F.col("now")).otherwise(none), never),
    )
    return rows.select("key", F.explode(said).alias("s")).select("s.kind", "key", "s.partner", "s.version_ts")


def _on_stream(seen: DataFrame, stream: DataFrame, plan: ContinuousPlan, joined: bool) -> DataFrame:
    """The state machine on keyed state.

    Generations are the stream's event time, in seconds: a row stands at the half of its own, a
    watermark at the begin of the next. The timer of a key ends when the watermark comes that drops it.
    """
    marks = stream.where(F.col("kind") == WATERMARK).select("key", "version_ts", "generation", F.lit(None).cast("string").alias("partner"), F.lit(True).alias("mark"))
    rows = seen.withColumn("mark", F.lit(False)).unionByName(marks)
    rows = rows.withColumn("clock", F.timestamp_millis(F.col("generation") * 1000 + F.when(F.col("mark"), 1000).otherwise(500)))
    if plan.idle_after:
        rows = rows.withWatermark("clock", "600 milliseconds")
    rows = rows.where(F.when(F.col("clock").isNotNull(), ~F.col("mark")))  # on the clock, else marks are dropped before they are seen

    def on_batch(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = (state.get[0], set(state.get[1])) if state.exists else (0, set())
        if state.hasTimedOut:
            after, out = (0, set()), [(IDLE_REMOVED, p, None) for p in sorted(before[1])]
        else:
            pdf = pd.concat(list(frames))
            pdf = pdf.assign(none=pdf.partner.notna()).sort_values(["version_ts", "generation", "none"], kind="stable")
            parts = (x for _, x in pdf.groupby(["version_ts", "generation"])) if joined else (pdf.iloc[i : i + 1] for i in range(len(pdf)))
            after, out = advance(before, [(int(x.version_ts.iloc[0]), int(x.generation.iloc[0]), set(x.partner.dropna())) for x in parts], plan.idle_after)
        at = int((after[0] + plan.idle_after) * 1000 + 350)
        if plan.idle_after and after[1] and at <= state.getCurrentWatermarkMs():
            out += [(IDLE_REMOVED, p, None) for p in sorted(after[1])]
            after = (0, set())
        if after[1]:
            state.update((after[0], sorted(after[1])))
            if plan.idle_after:
                state.setTimeoutTimestamp(at)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"kind": [k for k, _, _ in out], "key": [key[0]] * len(out), "partner": [p for _, p, _ in out], "version_ts": pd.array([v for _, _, v in out], dtype="Int64")})

    timeout = "EventTimeTimeout" if plan.idle_after else "NoTimeout"
    return rows.select("key", "version_ts", "generation", "partner", "clock").groupBy("key").applyInPandasWithState(on_batch, OUTPUT, "last long, partners array<string>", "append", timeout)


def read_stream(spark, schema, path: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """Files of a folder as a stream; at most so many at once, and none is ever discarded."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def socket_lines(spark, host: str, port: int) -> DataFrame:
    """Text lines of a socket as a stream, for the line formats."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load().withColumn("line_no", F.lit(0).cast("long"))


def state_of(spark, checkpoint: str) -> DataFrame:
    """What a stateful continuous query holds: each key with its partners, from the checkpoint of its stream."""
    state = spark.read.format("statestore").load(checkpoint)
    key, value = (state.select(f"{c}.*").columns for c in ("key", "value"))
    held = "value.groupState" if "groupState" in value else "value"
    return state.select(F.col(f"key.{key[0]}").alias("key"), f"{held}.last", f"{held}.partners")


def run_available(out: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there and return its result from memory; for tests and small results."""
    writer = out.writeStream.format("memory").queryName(name).trigger(availableNow=True).outputMode("append")
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return out.sparkSession.table(name)
