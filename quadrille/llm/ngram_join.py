"""Exact Jaccard join of documents on word n-grams, with prefix filters under several token orders.

Two documents link when their sets of n-grams have a Jaccard similarity of at least
``percent``/100. If they do, then under any fixed order of all n-grams the first
``size - ceil(percent * size / 100) + 1`` of each set share a member. Candidates must pass that test
under every order. All orders put n-grams with rare words first (by counts over the whole
corpus, which a bounded table of the most frequent words carries) and differ in how they rank the
rest, so a passage that many documents share seldom reaches a prefix. Prefixes are kept in the first
order: all that a pair shares stands behind its first shared member, so where that stands bounds the
size of a partner (``reach``), and two sets need only meet at members that reach both sizes.

Links are found up to components, and no group is ever gathered. Only the last join meets members pair
by pair, of different components alone; a row comes out where a link is possible:

1. Rows with equal sets become one class, named by the number of one of its rows.
2. The prefixes' members are sorted by size. Where a chain of rows with one member, each of a size that fits the
   next, is short, all of its pairs that the member reaches are candidates, and the chain is done with. Of longer chains
   neighbours are, and their rows stay for later steps. Candidates are scored by a bound on the symmetric
   difference: sets whose parities differ in more hash slots than
   their sizes allow cannot link. The slots are 1024 at first; of pairs that pass, sets of more members
   are held against each other on as many slots as they have members. Of each class the nearest candidate is verified, after
   the tests under the other orders. This is repeated on the rows that stayed, with another order inside equal
   members. It links most groups of copies in as many rows as they have.
3. Members whose classes still lie in different components are joined, across components only and
   where sizes and parities allow a link: first one class of each component that has the member, of which
   the nearest for each two components is verified, then all that are left. That is exact: any pair that
   was not verified is in one component already, or failed a test that links must pass.

Defined results: a text without words, null or empty, has an empty set and no links; with fewer
words than n the whole sequence is one n-gram; equal rows are one class; rows that repeat an id with
different texts are compared each, and what one of them links with is linked; null ids are left out
of components and get a null component; very long texts take part whole; an empty table gives an empty
result; further columns are ignored. N-grams are compared by 64-bit hashes, whole sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import wordhash
from quadrille.llm.common import Scratch, tasks
from quadrille.llm.components import merged, neighbours

U = np.uint64
FREQUENT = 200_000  # words whose counts are broadcast: 16 bytes each
FLUSH = 2_000_000  # words counted at once by a task
SEEDS = (U(0x243F6A8885A308D3), U(0x13198A2E03707344), U(0xA4093822299F31D0))


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n``: how often each word, by its hash, occurs in all texts."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            w, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

        for b in batches:
            for h in wordhash.many(b.column(0).to_pylist()):
                held.append(h)
                size += len(h)
                if size > FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return docs.select(F.col("text").cast("binary")).mapInArrow(local, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, scratch: Scratch, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and frequency classes (logarithms of counts) of at most ``most`` words."""
    rows = scratch.cut(count_words(docs).where("n > 1").orderBy(F.desc("n"), "word").limit(most), "words").toArrow()
    scratch.release("words")
    w = rows["word"].to_numpy().view(U)
    order = np.argsort(w)
    return w[order], np.minimum(255, 8 * np.log2(rows["n"].to_numpy()[order] + 1)).astype(np.uint8)


def frequency(h: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The frequency class of each word; 0 for words outside the table."""
    w, level = frequent
    if not len(w):
        return np.zeros(len(h), np.uint8)
    at = np.minimum(np.searchsorted(w, h), len(w) - 1)
    return np.where(w[at] == h, level[at], 0).astype(np.uint8)


PARITIES = [f"q{i}" for i in range(16)]
SLOTS = 64 * len(PARITIES)


def parities(members: np.ndarray) -> np.ndarray:
    """1024 bits: whether an odd number of members falls on each slot."""
    odd = (np.bincount((members >> U(54)).astype(np.int64), minlength=1024) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def wide_parities(members: np.ndarray) -> bytes | None:
    """For a set of more than 1024 members, on which 1024 slots fill up: the parities of at least as many slots
    as it has members, a power of two."""
    if len(members) <= SLOTS:
        return None
    width = (len(members) - 1).bit_length()
    odd = np.bincount((members >> U(64 - width)).astype(np.int64), minlength=1 << width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_differing(one: bytes | pa.Buffer, two: bytes | pa.Buffer) -> int:
    """In how many slots two sets' wide parities differ, on the slots of the one that has fewer."""
    x, y = (np.unpackbits(np.frombuffer(q, np.uint8)) for q in sorted((one, two), key=len))
    if len(x) < len(y):  # slots are leading bits of hashes, so neighbours make up a wider slot
        y = np.bitwise_xor.reduce(y.reshape(len(x), -1), axis=1)
    return int(np.count_nonzero(x != y))


def differing(one: str, two: str):
    """In how many slots two sets' parities differ: at most as many as members that only one has."""
    return sum((F.bit_count(F.col(f"{one}{q}").bitwiseXOR(F.col(f"{two}{q}"))) for q in PARITIES[1:]), F.bit_count(F.col(f"{one}{PARITIES[0]}").bitwiseXOR(F.col(f"{two}{PARITIES[0]}"))))


def near_parity(percent: int, n: str, m: str, one: str, two: str):
    """Whether the parities allow the similarity: they differ at most where the sets do."""
    return (100 + percent) * differing(one, two) <= (100 - percent) * (F.col(n) + F.col(m))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def reach(n, at, percent: int):
    """The largest size of a set that a set of ``n`` members can be similar to, if ``at`` of its members come before the
    first that both have: the others, at most, are shared."""
    return F.floor((100 * n - (100 + percent) * at) / percent)


CHAIN = 8  # rows of a member of which all pairs are formed at once


def chained(tokens: DataFrame, percent: int) -> DataFrame:
    """``token, n, reach, id, other``: candidates, and the rows of ``token, n, reach, id`` that stay, with -1 as ``other``.

    A chain is a run of rows with one token, by size, each of a size that fits the next. Of at most ``CHAIN`` rows all
    pairs whose sizes both rows reach are formed, and no row stays. Of longer chains, and of those at the border of a
    partition, such neighbours are formed and all rows stay.
    """
    names = ["token", "n", "reach", "id"]
    ranged = tokens.select(*names).repartitionByRange(tasks(tokens.sparkSession), "token", "n", "id").sortWithinPartitions("token", "n", "id")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[np.ndarray], other: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (*rows, other)], [*names, "other"])

        held: list[np.ndarray] | None = None  # the last chain, as long as it is short, or its last row
        border = True  # it is the first of the partition
        gone = False  # it is that row, and has been emitted
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(i).to_numpy() for i in range(len(names))]
            if held is not None:
                rows = [np.concatenate(v) for v in zip(held, rows, strict=True)]
            token, n, most, i = rows
            same = (token[1:] == token[:-1]) & (percent * n[1:] <= 100 * n[:-1])
            chain = np.append(0, np.cumsum(~same))
            length = np.bincount(chain)
            long = length > CHAIN
            long[0] |= border or gone
            stays = long[chain]
            open_ = chain == chain[-1]  # may go on in the next batch
            for d in range(1, min(CHAIN, len(i))):
                met = (chain[d:] == chain[:-d]) & (n[d:] <= most[:-d]) & (n[:-d] <= most[d:])
                at = np.flatnonzero(met & (stays[d:] if d == 1 else False) | met & ~stays[d:] & ~open_[d:])
                if len(at):
                    yield emit([v[at] for v in rows], i[at + d])
            stays[0] &= not gone
            if stays.any():
                yield emit([v[stays] for v in rows], np.full(int(stays.sum()), -1))
            gone = bool(long[-1])
            held = [v[-1:] if gone else v[open_] for v in rows]
            border = border and len(length) == 1
        if held is not None and not gone:
            yield emit(held, np.full(len(held[0]), -1))

    return ranged.mapInArrow(local, "token long, n long, reach long, id long, other long")


class Sets:
    """A text's set of n-grams and its prefixes under each order."""

    def __init__(self, n: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]):
        self.n, self.percent, self.frequent = n, percent, frequent

    def prefixes(self, h: np.ndarray, seeds: tuple = SEEDS) -> tuple[np.ndarray, list[np.ndarray]]:
        """The sorted set of the words' n-grams, and its prefix under each seed's order, in that order."""
        if not len(h):
            return h, [h] * len(seeds)
        k = min(self.n, len(h))
        s, first = np.unique(wordhash.ngrams(h, k), return_index=True)
        level = frequency(h, self.frequent)
        m = len(h) - k + 1
        rarest = level[:m]
        for i in range(1, k):
            rarest = np.minimum(rarest, level[i : i + m])
        rarest = rarest[first].astype(U) << U(56)
        size = prefix_size(len(s), self.percent)
        out = []
        for seed in seeds:
            rank = (wordhash.mix(s ^ seed) >> U(8)) | rarest
            first = np.argpartition(rank, size - 1)[:size] if size < len(s) else np.arange(len(s))
            out.append(s[first[np.argsort(rank[first], kind="stable")]])
        return s, out


def fingerprint(members: np.ndarray) -> tuple[U, U]:
    """128 bits that name a set."""
    return wordhash.mix(members).sum(dtype=U), wordhash.mix(members ^ SEEDS[0]).sum(dtype=U)


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(x) for x in arrays])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, arrays[0].dtype if arrays else np.int64)]), kind))


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def signatures(docs: DataFrame, sets) -> DataFrame:
    """``row, doc_id, n, key_1, key_2, q0.., wide, p0``: size, fingerprint, parities and first prefix of each set."""
    names = ["row", "doc_id", "n", "key_1", "key_2", *PARITIES, "wide", "p0"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, s = TaskContext.get().partitionId() << 33, sets.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                n = part.num_rows
                sizes, keys, odd, prefixes = np.zeros(n, np.int64), np.zeros((2, n), U), np.zeros((n, len(PARITIES)), np.int64), []
                wide = []
                for i, h in enumerate(wordhash.many(part.column("text").to_pylist())):
                    members, (p,) = s.prefixes(h, SEEDS[:1])
                    sizes[i], keys[:, i], odd[i] = len(members), fingerprint(members), parities(members)
                    wide.append(wide_parities(members))
                    prefixes.append(p.view(np.int64))
                columns = [pa.array(np.arange(row, row + n)), part.column("doc_id"), pa.array(sizes), *(pa.array(k.view(np.int64)) for k in keys)]
                columns += [pa.array(np.ascontiguousarray(q)) for q in odd.T]
                row += n
                yield pa.RecordBatch.from_arrays([*columns, pa.array(wide, pa.binary()), lists(prefixes, pa.int64())], names)

    schema = "row long, doc_id long, n long, key_1 long, key_2 long, " + ", ".join(f"{q} long" for q in PARITIES) + ", wide binary, p0 array<long>"
    return texts(docs).mapInArrow(local, schema)


KEYS = ["n", "key_1", "key_2"]


def standing(signed: DataFrame, classes: DataFrame, others: DataFrame) -> DataFrame:
    """The rows of ``signed`` that name one of the ``classes``; ``others`` has the ``row`` of those that do not. A bit array of
    fixed size tells most of the first by themselves, so these wide rows need no shuffle."""
    shared = signed.sparkSession.sparkContext.broadcast(ids_filter(others, "row"))

    def local(sure: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(passes(shared.value, b.column("row").to_numpy()) != sure))

        return signed.mapInArrow(rows, signed.schema)

    return local(True).unionByName(local(False).join(classes.select(F.col("id").alias("row")), "row", "left_semi"))


def members_of(docs: DataFrame, wanted: DataFrame, sets, scratch: Scratch) -> DataFrame:
    """``id, members, p1, p2``: whole sets, as sorted 64-bit hashes, and the other orders' prefixes.

    ``wanted`` has ``id, doc_id, n, key_1, key_2``. A bit array of fixed size keeps most other texts out
    before the join.
    """
    wanted = scratch.cut(wanted, "wanted")
    shared = docs.sparkSession.sparkContext.broadcast(ids_filter(wanted, "doc_id"))
    names = ["doc_id", *KEYS, "members", "p1", "p2"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sets.value
        for b in batches:
            b = b.take(pa.array(np.flatnonzero(passes(shared.value, b.column("doc_id").to_numpy()))))
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found, keys, prefixes = [], [], ([], [])
                for h in wordhash.many(part.column("text").to_pylist()):
                    members, ps = s.prefixes(h, SEEDS[1:])
                    found.append(members.tobytes())
                    keys.append((len(members), *fingerprint(members)))
                    for into, p in zip(prefixes, ps, strict=True):  # half a hash can only let more pairs pass
                        into.append((p >> U(32)).astype(np.uint32).view(np.int32))
                n, one, two = (np.array(k, U).view(np.int64) for k in zip(*keys, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(k) for k in (n, one, two)), pa.array(found, pa.binary()), *(lists(p, pa.int32()) for p in prefixes)], names)

    by = ["doc_id", *KEYS]
    found = texts(docs.where("doc_id is not null")).mapInArrow(local, "doc_id long, n long, key_1 long, key_2 long, members binary, p1 array<int>, p2 array<int>")
    out = scratch.cut(found.dropDuplicates(by).join(wanted, by).select("id", "members", "p1", "p2"), "sets")
    shared.unpersist()
    return out


FILTER_BITS = 1 << 23


def ids_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bit array of one megabyte that has the bit of every id; others pass by chance only."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for b in batches:
            bits[_slots(b.column(0).to_numpy())] = True
        words = np.packbits(bits).view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["at", "bits"])

    rows = ids.select(F.col(column).cast("long")).mapInArrow(local, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return words.view(np.uint8)


def _slots(ids: np.ndarray) -> np.ndarray:
    return (wordhash.mix(ids.astype(np.int64).view(U)) % U(FILTER_BITS)).astype(np.int64)


def passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _slots(ids)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``a, b`` that meet under every order, those whose whole sets are similar enough."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("id").alias("a"), F.col("members").alias("x"), F.col("p1").alias("x1"), F.col("p2").alias("x2"))
    two = sets.select(F.col("id").alias("b"), F.col("members").alias("y"), F.col("p1").alias("y1"), F.col("p2").alias("y2"))
    met = pairs.join(one, "a").join(two, "b").where(F.arrays_overlap("x1", "y1") & F.arrays_overlap("x2", "y2"))
    return met.select("a", "b", "x", "y").mapInArrow(local, "a long, b long")


def allowed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b, far, small`` whose wide parities allow a link, with these as ``far``; ``small`` is
    the smaller set's size. Only pairs of which both sets have more than 1024 members are looked at."""
    names = pairs.columns
    schema = pairs.schema

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = np.array([wide_differing(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column("x"), b.column("y"), strict=True)], np.int32)
            keep = (100 + percent) * far.astype(np.int64) <= (100 - percent) * b.column("sizes").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(far) if c == "far" else b.column(c) for c in names], names).filter(pa.array(keep))

    wide = sets.where(F.col("n") > SLOTS)
    long = pairs.where(F.col("small") > SLOTS).join(wide.select(F.col("id").alias("a"), F.col("n").alias("m"), F.col("wide").alias("x")), "a")
    long = long.join(wide.select(F.col("id").alias("b"), "n", F.col("wide").alias("y")), "b").select(*names, "x", "y", (F.col("m") + F.col("n")).alias("sizes"))
    return pairs.where(F.col("small") <= SLOTS).unionByName(long.mapInArrow(local, schema))


def ids_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()


def ngram_components(spark: SparkSession, docs: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``."""
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text")
    sets = spark.sparkContext.broadcast(Sets(n, percent, frequent_words(docs, scratch)))
    signed = scratch.cut(signatures(docs, sets), "signatures")
    narrow = scratch.cut(signed.select("row", "doc_id", *KEYS), "narrow")
    classes = narrow.where("n > 0 and doc_id is not null").groupBy(*KEYS).agg(F.min("row").alias("id"), F.min("doc_id").alias("first"))
    classes = scratch.cut(classes, "classes")
    others = scratch.cut(narrow.select("row").join(classes.select(F.col("id").alias("row")), "row", "left_anti"), "others")
    reps = scratch.cut(standing(signed, classes, others).withColumnRenamed("row", "id"), "reps")
    scratch.drop(signed, others)
    named = reps.select("id", "doc_id", *KEYS)
    tokens = reps.select(F.posexplode("p0").alias("at", "token"), "n", "id")
    tokens = scratch.cut(chained(tokens.withColumn("reach", reach(F.col("n"), F.col("at").cast("long"), percent)), percent), "chains")
    candidates, tokens = tokens.where("other >= 0"), tokens.where("other < 0").drop("other")
    components: DataFrame | None = None

    def settle(pairs: DataFrame) -> None:
        """Verify pairs of classes and join the components of those that link."""
        nonlocal components
        pairs = scratch.cut(pairs, "pairs")
        if components is not None and pairs.isEmpty():
            return
        found = scratch.cut(verified(pairs, members_of(docs, named.join(ids_of(pairs), "id", "left_semi"), sets, scratch), percent), "links")
        scratch.release("pairs", "sets", "wanted")
        components = merged(spark, components, found, scratch)
        scratch.release("links")

    def scored(pairs: DataFrame) -> DataFrame:
        """Those of the pairs ``a, b`` whose parities allow a link, with the number of slots that differ."""
        some = scratch.cut(reps.select("id", "n", *PARITIES).join(ids_of(pairs), "id", "left_semi"), "few")
        side = lambda of, p: some.select(F.col("id").alias(of), *(F.col(c).alias(p + c) for c in ("n", *PARITIES)))
        met = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
        met = met.where(near_parity(percent, "xn", "yn", "x", "y"))
        met = scratch.cut(met.select("a", "b", differing("x", "y").alias("far"), F.least("xn", "yn").alias("small")), "met")
        return allowed(met, reps, percent)

    pairs = candidates.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    possible = scratch.cut(scored(scratch.cut(pairs, "near")), "possible")
    settle(nearest_of_each(possible))
    scratch.release("near", "few", "met")
    # The second round sorts equal members by a hash, and leaves out those with one component.
    again = open_tokens(tokens, components).withColumn("mixed", F.xxhash64("id"))
    near = neighbours(again, ["token"], ["mixed", "id"], ["n", "reach", "id", "c"], scratch).where("c_1 <> c_2 and n_1 <= reach_2 and n_2 <= reach_1")
    pairs = scratch.cut(near.select(F.least("id_1", "id_2").alias("a"), F.greatest("id_1", "id_2").alias("b")).distinct(), "near")
    scratch.release("neighbours")
    settle(nearest_of_each(scratch.cut(scored(pairs), "scored")))
    scratch.release("near", "few", "met", "scored")
    at = lambda side, c: components.select(F.col("node").alias(side), F.col("component").alias(c))
    pending = possible.join(at("a", "c"), "a", "left").join(at("b", "d"), "b", "left")
    settle(pending.where(F.coalesce("c", "a") != F.coalesce("d", "b")).select("a", "b"))
    scratch.release("possible")
    sets_ = reps.select("id", "n", *PARITIES)
    for salt in (1, None):  # one class of each component that has a member, then all
        rest = scratch.cut(open_tokens(tokens, components, salt), "open")
        pairs = scratch.cut(across(rest.select("token", "id", "c", "reach"), ["token"], sets_, percent), "met")
        pairs = scratch.cut(allowed(pairs, reps, percent), "across")
        if salt:
            pairs = nearest(pairs, ["c", "d"])
        settle(pairs.select("a", "b"))
        scratch.release("open", "met", "across")
    groups = classes.join(components.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    groups = scratch.cut(groups, "groups")
    firsts = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    groups = scratch.cut(groups.join(firsts, "component").select(*KEYS, "component_id"), "named")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return scratch.result(narrow.join(groups, KEYS, "left").select("doc_id", F.col("n").alias("n_shingles"), own.cast("long").alias("component_id")))


def open_tokens(tokens: DataFrame, components: DataFrame, salt: int | None = None) -> DataFrame:
    """The members that occur in more than one component, with the component of each class as ``c``; with a
    salt, one class of each component."""
    placed = tokens.join(components.withColumnRenamed("node", "id"), "id", "left").select("token", "n", "reach", "id", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("token")
    rest = placed.join(mixed, "token", "left_semi")
    if salt is None:
        return rest
    return rest.groupBy("token", "c").agg(F.min_by(F.struct("id", "n", "reach"), F.xxhash64(F.lit(salt), "id")).alias("p")).select("token", "p.n", "p.reach", "p.id", "c")


def across(rows: DataFrame, key: list[str], sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, c, d, far, small``: pairs of classes of two components that have a key in common and may link, by
    sizes and parities; ``far`` is the number of slots in which these differ, ``small`` the smaller size. ``sets`` has ``id, n, q0..``.
    Where rows have a ``reach``, each is to reach the other's size."""
    reaches = ["reach"] * ("reach" in rows.columns)
    rows = rows.join(sets, "id")
    side = lambda of, c, p: rows.select(*key, F.col("id").alias(of), F.col("c").alias(c), *(F.col(x).alias(p + x) for x in ("n", *reaches, *PARITIES)))
    fits = 100 * F.least("xn", "yn") >= percent * F.greatest("xn", "yn")
    if reaches:
        fits &= (F.col("xn") <= F.col("yreach")) & (F.col("yn") <= F.col("xreach"))
    met = side("x", "c", "x").join(side("y", "d", "y"), key).where((F.col("c") < F.col("d")) & fits & near_parity(percent, "xn", "yn", "x", "y"))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "c", "d", differing("x", "y").alias("far"), F.least("xn", "yn").alias("small")).distinct()


def nearest(pairs: DataFrame, of: list[str]) -> DataFrame:
    """Of the pairs ``a, b, far`` the nearest of each group."""
    return pairs.groupBy(*of).agg(F.min(F.struct("far", "a", "b")).alias("p")).select("p.a", "p.b")


def nearest_of_each(pairs: DataFrame) -> DataFrame:
    """Of the pairs ``a, b, far`` the nearest of each class, whichever side it is on."""
    return nearest(pairs, ["a"]).union(nearest(pairs, ["b"])).distinct()
