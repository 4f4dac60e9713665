"""Substring deduplication by paragraphs: MinHash banding finds near copies, exact checks link them.

Paragraphs are of two kinds. Lines of at least ``min_words`` words are compared by similarity. Sections
are runs of ``min_words`` words that begin where the content says so, over line ends too: at the text's
first word, and wherever a hash of two words is the least of the ``window`` words that begin around it. So
whatever adjoins a passage, two texts that share ``min_words + window - 1`` words (51 as registered) have
a section in common. A shorter text is one section.

Equal paragraphs (same words) form one class, named by a 64-bit hash of them. Each class of lines has a
MinHash signature over its runs of ``n`` words, cut into bands, whose number and width ``tune_bands`` picks for a
recall at the threshold. Bands are sorted and neighbours are compared; of each class the nearest is verified,
by a bound on the symmetric difference from parities of the sets. Then classes that still lie in different
components are joined across components only, where that bound allows the similarity: first one class of
each component in a band, then all that are left. Only that join meets classes pair by pair, of different
components alone; a row comes out where a link is possible.
Candidates are verified on whole paragraphs by the exact Jaccard similarity of their word runs. Sections are
copies only if equal: of so few words, one changed inside leaves less than the similarity. Components of the links are the
groups; the first paragraph of each (by document, then place) stays.

Defined results: null and empty texts have no paragraphs; equal rows are copies of each other;
rows with null ids are left out; rows that repeat an id count as its further paragraphs; very long texts
take part whole; an empty table gives an empty result; further columns are ignored. Words are compared by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import wordhash
from quadrille.llm.common import Scratch
from quadrille.llm.components import merged, neighbours
from quadrille.llm.ngram_join import PARITIES, across, differing, ids_filter, near_parity, nearest, nearest_of_each, parities, passes
from quadrille.llm.sparse_suffix import minimisers

U = np.uint64
WORDS = 100_000  # words whose signatures are made together


def tune_bands(threshold: float, recall: float, background: float = 0.1, most_false: float = 0.05) -> tuple[int, int]:
    """The fewest bands, and their width, with enough recall at the threshold, whose false candidates at
    the background similarity stay below ``most_false``."""
    for rows in range(1, 17):
        for bands in range(1, 129):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                if 1 - (1 - background**rows) ** bands <= most_false:
                    return bands, rows
                break
    raise ValueError("no banding reaches this recall")


def least_found(min_words: int, window: int) -> int:
    """Any run of so many words that two texts share holds a whole section."""
    return min_words + window - 1


def signatures(members: np.ndarray, begin: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of each set's MinHashes; sets lie end to end and begin at ``begin``."""
    least = np.empty((len(begin), bands * rows), U)
    odd = wordhash.mix(np.arange(1, 2 * bands * rows + 1, dtype=U)).reshape(2, -1)
    high = members >> U(32)
    for at in range(bands * rows):
        least[:, at] = np.minimum.reduceat((members * (odd[0, at] | U(1))) ^ (high * (odd[1, at] | U(1))), begin)
    turn = odd[0, :rows] | U(1)
    return wordhash.mix((least.reshape(-1, bands, rows) * turn).sum(axis=2, dtype=U) + np.arange(bands, dtype=U))


def signature(members: np.ndarray, bands: int, rows: int) -> np.ndarray:
    return signatures(members, np.zeros(1, np.int64), bands, rows)[0]


def lines(text: bytes, starts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and numbers of words of the lines that are long enough."""
    upto = np.searchsorted(starts, np.append(np.flatnonzero(np.frombuffer(text, np.uint8) == 10), len(text)))
    first = np.append(0, upto[:-1])
    size = upto - first
    keep = size >= max(1, min_words)
    return first[keep], size[keep]


def sections(h: np.ndarray, min_words: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and numbers of words of the sections."""
    if len(h) <= min_words:
        return np.zeros(min(1, len(h)), np.int64), np.full(min(1, len(h)), len(h))
    at, _ = minimisers(h, 2, window)
    first = np.append(0, at[(at > 0) & (at <= len(h) - min_words)])
    return first, np.full(len(first), min_words)


def within(size: np.ndarray) -> np.ndarray:
    """0, 1, ... in each of consecutive runs of these sizes."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def paragraph_ids(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each paragraph a hash of its words in their order, from prefix sums."""
    if not len(size):
        return np.zeros(0, np.int64)
    power, inverse = wordhash.powers(len(h) + 1)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(wordhash.mix(h) * power[: len(h)], dtype=U, out=total[1:])
    return wordhash.mix((total[first + size] - total[first]) * inverse[first] + size.astype(U)).view(np.int64)


def line_bands(h: np.ndarray, size: np.ndarray, n: int, bands: int, rows: int) -> np.ndarray:
    """A row of bands for each line; their words lie end to end."""
    runs = size - n + 1
    begin = np.cumsum(size) - size
    members = wordhash.ngrams(h, n)[within(runs) + np.repeat(begin, runs)]
    return signatures(members, np.cumsum(runs) - runs, bands, rows).view(np.int64)


def texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def paragraphs(docs: DataFrame, n: int, min_words: int, window: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, first, words, id, bands``: each paragraph with its class; lines have bands."""
    names = ["doc_id", "first", "words", "id", "bands"]

    def batch(doc: list, first: list, size: list, ids: list, found) -> pa.RecordBatch:
        doc = np.repeat(np.array(doc, np.int64), [len(x) for x in first])
        first, size, ids = (np.concatenate(x) for x in (first, size, ids))
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(ids), found(len(doc))], names)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, whole, cut, words, held = [], ([], [], []), ([], [], []), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if doc:
                h, sizes = np.concatenate(words), np.concatenate(whole[1])
                ends = np.cumsum(sizes)
                parts = np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(ends // WORDS)) + 1)  # bounds memory
                found = [line_bands(h[ends[p[0]] - sizes[p[0]] : ends[p[-1]]], sizes[p], n, bands, rows) for p in parts if len(p)]
                flat = np.concatenate(found).ravel() if found else np.zeros(0, np.int64)
                yield batch(doc, *whole, lambda k: pa.ListArray.from_arrays(pa.array(np.arange(0, k * bands + 1, bands, dtype=np.int32)), pa.array(flat)))
                yield batch(doc, *cut, lambda k: pa.nulls(k, pa.list_(pa.int64())))
            for x in (doc, words, *whole, *cut):
                x.clear()
            held = 0

        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    h, starts, _ = wordhash.words(text)
                    if not len(h):
                        continue
                    a, b_ = lines(text, starts, min_words), sections(h, min_words, window)
                    fresh = ~np.isin(b_[0] << 32 | b_[1], a[0] << 32 | a[1])  # a line that is a section is a line
                    b_ = b_[0][fresh], b_[1][fresh]
                    ids = paragraph_ids(h, np.concatenate([a[0], b_[0]]), np.concatenate([a[1], b_[1]]))
                    doc.append(i)
                    for into, (first, size), own in ((whole, a, ids[: len(a[0])]), (cut, b_, ids[len(a[0]) :])):
                        for x, y in zip(into, (first, size, own), strict=True):
                            x.append(y)
                    words.append(h[np.repeat(a[0], a[1]) + within(a[1])])
                    held += len(h)
                    if held > WORDS:
                        yield from flush()
        yield from flush()

    return texts(docs).mapInArrow(local, "doc_id long, first int, words int, id long, bands array<long>")


def words_of(docs: DataFrame, wanted: DataFrame, n: int, min_words: int, scratch: Scratch) -> DataFrame:
    """``id, tokens, n, q0..``: word hashes of the lines wanted, size and parities of their sets of runs."""
    shared = docs.sparkSession.sparkContext.broadcast(ids_filter(wanted, "doc_id"))
    classes = docs.sparkSession.sparkContext.broadcast(ids_filter(wanted, "id"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.take(pa.array(np.flatnonzero(passes(shared.value, b.column(0).to_numpy()))))
            for at in range(0, b.num_rows, 1000):
                found: dict[int, bytes] = {}
                for text in b.column(1).slice(at, 1000).to_pylist():
                    h, starts, _ = wordhash.words(text)
                    first, size = lines(text, starts, min_words)
                    these = paragraph_ids(h, first, size)
                    for i in np.flatnonzero(passes(classes.value, these)) if len(these) else ():
                        found[int(these[i])] = h[first[i] : first[i] + size[i]].tobytes()
                sets = [wordhash.shingles(np.frombuffer(x, U), n) for x in found.values()]
                odd = np.array([parities(x) for x in sets], np.int64).reshape(-1, len(PARITIES))
                columns = [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary()), pa.array([len(x) for x in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(q)) for q in odd.T)], ["id", "tokens", "n", *PARITIES])

    schema = "id long, tokens binary, n long, " + ", ".join(f"{q} long" for q in PARITIES)
    out = scratch.cut(texts(docs).mapInArrow(local, schema).dropDuplicates(["id"]).join(wanted, "id", "left_semi"), "tokens")
    for x in (shared, classes):
        x.unpersist()
    return out


def similar(x: np.ndarray, y: np.ndarray, n: int, percent: int) -> bool:
    a, b = wordhash.shingles(x, n), wordhash.shingles(y, n)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def line_components(spark: SparkSession, docs: DataFrame, found: DataFrame, scratch: Scratch, n: int, percent: int, min_words: int) -> DataFrame:
    """``node, component``: classes of lines that are near copies."""
    components = None

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [similar(np.frombuffer(x, U), np.frombuffer(y, U), n, percent) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def settle(pairs: DataFrame) -> None:
        nonlocal components
        both = pairs.join(tokens.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(tokens.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
        links = scratch.cut(both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "links")
        components = merged(spark, components, links, scratch)
        scratch.release("links")

    near = neighbours(found.where("bands is not null").select(F.explode("bands").alias("token"), "id"), ["token"], ["id"], ["token", "id"], scratch)
    near = near.where("id_1 <> id_2")
    # Every member of a band that holds two classes has a neighbour of another class.
    members = near.select(F.col("token_1").alias("token"), F.col("id_1").alias("id")).union(near.select("token_2", "id_2")).distinct()
    members = scratch.cut(members, "members")
    pairs = scratch.cut(near.select(F.least("id_1", "id_2").alias("a"), F.greatest("id_1", "id_2").alias("b")).distinct(), "pairs")
    scratch.release("neighbours")
    wanted = scratch.cut(found.where("bands is not null").join(members.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("doc_id").alias("doc_id")), "wanted")
    tokens = words_of(docs, wanted, n, min_words, scratch)
    side = lambda of, p: tokens.select(F.col("id").alias(of), *(F.col(c).alias(p + c) for c in ("n", *PARITIES)))
    met = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(near_parity(percent, "xn", "yn", "x", "y"))
    settle(nearest_of_each(scratch.cut(met.select("a", "b", differing("x", "y").alias("far")), "near")))
    scratch.release("pairs", "wanted", "near")
    for salt in (1, None):  # one class of each component in a band, then all
        rest = scratch.cut(open_members(members, components, salt), "open")
        pairs = scratch.cut(across(rest, ["token"], tokens.select("id", "n", *PARITIES), percent), "pairs")
        if salt:
            pairs = nearest(pairs, ["c", "d"])
        settle(pairs.select("a", "b"))
        scratch.release("open", "pairs")
    return components


def open_members(members: DataFrame, components: DataFrame, salt: int | None) -> DataFrame:
    """Members ``token, id`` of bands with several components, as ``c``; with a salt one of each component."""
    placed = members.join(components.withColumnRenamed("node", "id"), "id", "left").select("token", "id", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("token")
    rest = placed.join(mixed, "token", "left_semi")
    return rest.groupBy("token", "c").agg(F.min_by("id", F.xxhash64(F.lit(salt), "id")).alias("id")) if salt else rest


def paragraph_groups(spark: SparkSession, docs: DataFrame, *, n: int = 5, percent: int = 80, recall: float = 0.9995, min_words: int = 24, window: int = 28) -> DataFrame:
    """``doc_id, first, words, component_id, of_doc, removed`` for every paragraph that has a near copy.

    ``component_id`` is one number for a group, ``of_doc`` the document of the paragraph that stays.
    """
    if min_words < n or window < 2:
        raise ValueError("a paragraph must hold a run of words, a window two boundaries")
    scratch = Scratch(spark)
    found = scratch.cut(paragraphs(docs, n, min_words, window, *tune_bands(percent / 100, recall)), "paragraphs")
    components = line_components(spark, docs, found, scratch, n, percent, min_words)
    scratch.only(found, components)
    classes = found.groupBy("id").agg(F.min(F.struct("doc_id", "first")).alias("at"), F.count("*").alias("n"))
    grouped = classes.join(components.withColumnRenamed("node", "id"), "id", "left").where("n > 1 or component is not null")
    grouped = scratch.cut(grouped.withColumn("component", F.coalesce("component", "id")), "grouped")
    first = grouped.groupBy("component").agg(F.min("at").alias("kept"))
    named = scratch.cut(grouped.select("id", "component").join(first, "component").select("id", "component", "kept"), "named")
    out = found.select("doc_id", "first", "words", "id").join(named, "id").select(
        "doc_id", "first", "words", F.col("component").alias("component_id"), F.col("kept.doc_id").alias("of_doc"),
        ((F.col("doc_id") != F.col("kept.doc_id")) | (F.col("first") != F.col("kept.first"))).alias("removed"),
    )
    return scratch.result(out)
