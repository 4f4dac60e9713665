"""Best-two-fit packing of tokenised documents into sequences of fixed length.

Documents become token ids and an end id; only those longer than a sequence are cut. Pieces are
dealt by a hash into buckets of about ``bucket_rows`` pieces, and each bucket is packed alone:
sequences are filled greedily with the longest piece that fits; when nothing more fits, the
sequence's smallest piece gives way to the two unpacked pieces that fill the widened gap best. A
bucket loses at most part of one sequence against packing all at once, and is as large at any
size of the corpus, so the work is spread evenly.

Defined results: a null text is an empty one, whose piece is the end id alone; repeated rows are
packed each; null ids are kept; an empty table gives an empty result; further columns are ignored.
A text is tokenised whole, so a worker needs memory for its ids, four bytes each.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.bytepair import BlockEncoder
from quadrille.llm.common import Scratch

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"

#: Texts of these characters alone, without apostrophes, are encoded in blocks: lower case agrees
#: between libraries here, composing changes nothing, and words end where a byte's class changes.
_PLAIN = re.compile("[^\t\n\r\x20-\x26\x28-\x7e\xa1-\xa9\xab\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf-\xd6\xd8-\xf6\xf8-\xffŒœ‐-‧€]")
BLOCK = 1 << 22  # characters of plain text encoded together


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    Where the tokenizer lower-cases, drops white space and splits letters, digits and signs, plain
    texts go through ``BlockEncoder``, which gives the same ids. All others, and other tokenizers,
    are encoded by the library.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = tuple(t["content"] for t in spec.get("added_tokens", []))
        self.blocks = BlockEncoder(path, self._ids) if self._splits(spec) else None

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    @staticmethod
    def _splits(spec: dict) -> bool:
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        same = split.get("behavior") == "Removed" and split.get("invert") and split.get("pattern", {}).get("Regex") == pattern
        return kinds == ["NFC", "Replace", "Lowercase"] and bool(same)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> bool:
        return self.blocks is not None and not _PLAIN.search(text) and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK):
                size += len(texts[to])
                to += 1
            yield from self._some(texts[at:to])
            at = to

    def _some(self, texts: list[str]) -> list[bytes]:
        plain = [i for i, t in enumerate(texts) if self._plain(t)]
        out: list[bytes] = [b""] * len(texts)
        if plain:
            parts = [texts[i].lower().encode() for i in plain]
            starts, counts, ids = self.blocks.encode(np.frombuffer(b" ".join(parts), np.uint8))
            edge = np.cumsum([len(x) + 1 for x in parts])  # where each text's words end
            upto = np.append(0, np.cumsum(counts))[np.searchsorted(starts, edge)]
            raw, a = ids.astype("<u4").tobytes(), 0
            for i, b in zip(plain, upto.tolist(), strict=True):
                out[i] = raw[4 * a : 4 * b]
                a = b
        rest = sorted({*range(len(texts))}.difference(plain))
        for i, x in zip(rest, self._ids([texts[i] for i in rest]), strict=True):
            out[i] = array("I", x).tobytes()
        return out


def pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int) -> DataFrame:
    """Each document's ids with the end id, in pieces of at most ``length``."""
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for b in batches:
            rows: list[tuple] = []
            texts = ["" if t is None else t for t in b.column("text").to_pylist()]
            for doc, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def best_two_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, none longer than ``capacity``."""
    waiting: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        waiting.setdefault(n, []).append(i)
    there = 0  # bit n: items of length n wait
    for n in waiting:
        there |= 1 << n
    below = [(1 << (n + 1)) - 1 for n in range(capacity + 1)]
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    left, number = len(lengths), 0

    def take(n: int) -> int:
        nonlocal there
        i = waiting[n].pop()
        if not waiting[n]:
            there ^= 1 << n
        return i

    def fill(bin_: list[tuple[int, int]], gap: int) -> int:
        while (n := (there & below[gap]).bit_length() - 1) > 0:
            bin_.append((n, take(n)))
            gap -= n
        return gap

    while left:
        bin_: list[tuple[int, int]] = []
        gap = fill(bin_, capacity)
        if gap and len(bin_) > 1 and there:
            small, item = bin_[-1]
            wide, best, pair = gap + small, small, None
            a = (there & below[wide - 1]).bit_length() - 1
            while a > 0 and 2 * a > best and best < wide:
                b = (there & below[min(a, wide - a)]).bit_length() - 1
                if b == a and len(waiting[a]) < 2:
                    b = (there & below[a - 1]).bit_length() - 1
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                a = (there & below[a - 1]).bit_length() - 1
            if pair:
                bin_.pop()
                bin_ += [(n, take(n)) for n in pair]
                waiting.setdefault(small, []).append(item)
                there |= 1 << small
                fill(bin_, wide - best)
        at = 0
        for n, i in bin_:
            bins[i], offsets[i] = number, at
            at += n
        left -= len(bin_)
        number += 1
    return bins, offsets


def pack(spark: SparkSession, docs: DataFrame, *, tokenizer: str, length: int = 2048, end_id: int = 0, bucket_rows: int = 20_000) -> DataFrame:
    """A row for each piece: its document, place there, length, checksum, sequence and offset."""
    parts = Scratch(spark).cut(pieces(docs, tokenizer, length, end_id), "pieces")
    n = max(1, -(-parts.count() // bucket_rows))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)).alias("bucket")

    def pack_bucket(t: pa.Table) -> pa.Table:
        order = np.lexsort((t["piece"].to_numpy(), t["doc_id"].to_numpy(zero_copy_only=False)))
        t = t.take(pa.array(order))
        bins, offsets = best_two_fit(t["length"].to_pylist(), length)
        number = (int(t["bucket"][0].as_py()) << 32) + np.asarray(bins, np.int64)
        return t.drop_columns(["bucket"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offsets, pa.int64()))

    return parts.select("*", bucket).groupBy("bucket").applyInArrow(pack_bucket, PACKED)
