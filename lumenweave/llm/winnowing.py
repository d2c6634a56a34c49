"""Benchmark decontamination by winnowing.

A span of ``span`` words holds ``span - gram + 1`` k-grams of ``gram`` words; the
least hash among them is its fingerprint.  Equal spans have equal fingerprints,
so that every shared span of that length is found, while neighbouring spans
mostly share one.  Benchmark fingerprints go to the scan of the documents as a
bitmap of bounded size; where a document's fingerprint may be among them, the
hit is extended to the whole span, whose digest is joined with those of the
benchmark.  Items shorter than a span are one window and are looked up by the
hash of all their words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Byte -> itself if of a word, a space if not; A-Z become a-z.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Odd multipliers of the words of a k-gram, and of the final mixing.
_FACTORS = np.random.default_rng(11).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bits that one row of Spark's bitmap aggregate holds.
_BUCKET = 1 << 15
#: Windows of a document in one output batch, at most about.
_BATCH = 4096


@dataclass(frozen=True)
class WinnowSpec:
    """``max_filter_bits`` bounds the broadcast bitmap; a fuller bitmap lets more through to the join, and changes no result."""

    span: int = 10
    gram: int = 5
    bits_each: int = 64
    max_filter_bits: int = 1 << 27


class _Hashes(dict):
    """Word -> 64-bit hash, begun anew when full; long words are not kept."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= 500_000:
                self.clear()
            self[word] = h
        return h


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8: runs of digits, letters a-z, in lower case, and whatever is not ASCII."""
    return text.translate(_WORD_BYTES).split()


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words."""
    n = len(hashes) - k + 1
    h = np.full(n, _FACTORS[k], np.uint64)
    for i in range(k):
        h += hashes[i : i + n] * _FACTORS[i]
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def fingerprints(hashes: np.ndarray, size: int, spec: WinnowSpec) -> np.ndarray:
    """Of each window of ``size`` words: the least hash of its k-grams, or the hash of all its words where it is no full span."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    if size < spec.span:
        return _grams(hashes, size)
    grams = _grams(hashes, spec.gram)
    n = len(hashes) - size + 1
    least = grams[:n].copy()
    for i in range(1, spec.span - spec.gram + 1):
        np.minimum(least, grams[i : i + n], out=least)
    return least


def _digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _hashed(words: list[bytes], memo: _Hashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def benchmark_windows(items: DataFrame, spec: WinnowSpec = WinnowSpec(), id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (its id as a string), size, mark (fingerprint), digest: the distinct windows of each item; items without words have none."""

    def run(batches):
        memo = _Hashes()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py() or b"")
                size = min(spec.span, len(words))
                if not size:
                    continue
                seen: dict[bytes, int] = {}
                marks = fingerprints(_hashed(words, memo), size, spec)
                for i, mark in enumerate(marks.view(np.int64).tolist()):
                    seen[_digest(words[i : i + size])] = mark
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(seen), pa.string()), pa.array([size] * len(seen), pa.int32()), pa.array(seen.values(), pa.int64()), pa.array(seen.keys(), pa.binary())],
                    names=["item", "size", "mark", "digest"],
                )

    slim = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "item string, size int, mark long, digest binary")


def _bitmap(windows: DataFrame, spec: WinnowSpec) -> np.ndarray:
    """Bits of all fingerprints and digests; put together by Spark, at most ``max_filter_bits`` of them come back."""
    bits = _BUCKET
    n = 2 * windows.count() * spec.bits_each
    while bits < min(n, spec.max_filter_bits):
        bits *= 2
    low = F.conv(F.hex(F.substring("digest", 11, 6)), 16, 10).cast("long")
    places = windows.select(F.explode(F.array(F.col("mark").bitwiseAND(bits - 1), low.bitwiseAND(bits - 1))).alias("at"))
    found = places.groupBy(F.floor(F.col("at") / _BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % _BUCKET).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in found.collect():
        at = row["bucket"] * _BUCKET // 8
        out[at : at + _BUCKET // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _candidates(words: list[bytes], hashes: np.ndarray, sizes: list[int], bitmap: np.ndarray, spec: WinnowSpec) -> dict[tuple[int, bytes], list[int]]:
    """(size, digest) -> starts of the windows whose fingerprint and digest are in the bitmap."""
    mask, found = len(bitmap) * 8 - 1, {}
    for size in sizes:
        at = fingerprints(hashes, size, spec) & np.uint64(mask)
        hit = bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
        for start in np.flatnonzero(hit).tolist():
            digest = _digest(words[start : start + size])
            low = int.from_bytes(digest[-6:], "big") & mask
            if bitmap[low >> 3] >> (low & 7) & 1:
                found.setdefault((size, digest), []).append(start)
    return found


def scan(docs: DataFrame, bitmap: np.ndarray, sizes: list[int], spec: WinnowSpec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_words, windows (size, digest, starts): what each document may share with the benchmark.

    ``row`` tells rows apart, also those of one id; it is good once written.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    kind = pa.list_(pa.struct([("size", pa.int32()), ("digest", pa.binary()), ("starts", pa.list_(pa.int32()))]))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("windows", kind)])

    def run(batches):
        memo, bits, row = _Hashes(), sent.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            out, weight = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py() or b"")
                found = _candidates(words, _hashed(words, memo), sizes, bits, spec)
                out.append((row, doc_id, len(words), [{"size": n, "digest": d, "starts": s} for (n, d), s in found.items()]))
                row, weight = row + 1, weight + 1 + sum(map(len, found.values()))
                if weight > _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, weight = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "row long, doc_id long, n_words long, windows array<struct<size:int,digest:binary,starts:array<int>>>")


def _covered(spans):
    """Places that sorted spans (start, end) cover."""
    start = F.struct(F.lit(0).cast("int").alias("end"), F.lit(0).cast("long").alias("n"))
    add = lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("n"))
    return F.aggregate(spans, start, add, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, spec: WinnowSpec = WinnowSpec()) -> DataFrame:
    """doc_id, n_words, n_hit, spans (start, end of each shared window), n_items, items_sha256: one row per input row.

    Null texts have no words.  Items without words occur nowhere; rows of one item_id are one item of several texts; an
    item of a null id marks words, but is not among the items.  An empty benchmark hits nothing, an empty table of
    documents gives no rows.  Repeated rows and rows of a null id are judged each by its own text.  Further columns of
    either table are not looked at.

    Items that share a window are one list with an id; documents carry ids of lists, and each combination of lists is
    put together once, not once a document.
    """
    spark = docs.sparkSession
    windows = materialize(benchmark_windows(items, spec), "benchmark-windows")
    sizes = [r["size"] for r in windows.select("size").distinct().orderBy("size").collect()]
    lists = windows.groupBy("size", "digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    lists = materialize(lists.withColumn("list_id", F.sha2(F.array_join("items", "\0"), 256)), "benchmark-lists")
    table = materialize(scan(docs, _bitmap(windows, spec), sizes, spec), "winnowed")

    near = table.filter(F.size("windows") > 0).select("row", "doc_id", "n_words", F.explode("windows").alias("w")).select("row", "doc_id", "n_words", "w.*")
    known = lists.select(F.col("size").alias("l_size"), F.col("digest").alias("l_digest"), "list_id")
    joined = near.join(known, (F.col("digest") == F.col("l_digest")) & (F.col("size") == F.col("l_size")), "left")
    spans = F.when(F.col("list_id").isNotNull(), F.transform("starts", lambda s: F.struct(s.alias("start"), (s + F.col("size")).alias("end"))))
    found = joined.select("row", "doc_id", "n_words", "list_id", spans.alias("spans")).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.collect_set("list_id")).alias("lists")
    )
    found = materialize(found.select("*", _covered(F.col("spans")).alias("n_hit"), F.sha2(F.array_join("lists", ","), 256).alias("combination")), "contaminated")

    each = found.filter(F.size("lists") > 0).select("combination", "lists").dropDuplicates(["combination"]).select("combination", F.explode("lists").alias("c_list"))
    one = lists.select("list_id", "items").dropDuplicates(["list_id"])
    parts = each.join(one, F.col("c_list") == F.col("list_id")).select("combination", F.explode("items").alias("item")).distinct()
    named = parts.groupBy(F.col("combination").alias("c_key")).agg(F.array_sort(F.collect_list("item")).alias("names"))
    named = named.select("c_key", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    hit = found.join(named, F.col("combination") == F.col("c_key"), "left").select(
        "doc_id", "n_words", "n_hit", "spans", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256")
    )
    zero = F.lit(0).cast("long")
    free = table.filter(F.size("windows") == 0).select("doc_id", "n_words", zero.alias("n_hit"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), zero.alias("n_items"), none.alias("items_sha256"))
    return hit.union(free)
