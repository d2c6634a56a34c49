"""Hard-negative mining by blocked dense products.

Vectors become whole numbers, so that inner products in float64 are exact below
2^53; blocks that might go beyond are multiplied in Python's integers.  The
anchors go to the tasks in rounds of bounded size.  A task multiplies a block
of anchors with a block of candidates and keeps, per anchor, the first few by
score; what tasks kept is merged by a ranked window.  The first pass finds each
anchor's positives, the second the first negatives within the range of scores
that each positive allows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass(frozen=True)
class MiningSpec:
    """A negative's score lies between ``low`` and ``high`` percent of its positive's.  ``round_bytes`` bounds the anchors of a round."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    round_bytes: int = 48 << 20
    anchor_block: int = 1024
    candidate_block: int = 2048


def whole_vectors(column, scale: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows x width, usable): floor(scale * x) of each component, shorter vectors filled up with 0, longer ones cut at ``width``.

    A row with a null or non-finite component is not usable.
    """
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    row = np.repeat(np.arange(len(lengths)), lengths)
    bad = ~np.isfinite(flat)
    usable = np.bincount(row[bad], minlength=len(lengths)) == 0
    flat[bad] = 0
    width = int(lengths.max(initial=0)) if width is None else width
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width), usable
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out, fits = np.zeros((len(lengths), width)), place < width
    out[row[fits], place[fits]] = flat[fits]
    return out, usable


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b`` as 64-bit integers, exact; an error where one does not fit."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = lambda x: np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    return np.array(exact(a) @ exact(b).T, np.int64)


class First:
    """Of each row the first ``k`` by score, higher first, then by id.  Ids must be offered in ascending order."""

    def __init__(self, rows: int, k: int):
        self.score, self.id = np.full((rows, k), LOWEST), np.full((rows, k), HIGHEST)

    def offer(self, at: slice, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Merge scores (rows ``at`` x ids).  Later ids lose ties, so that what is not above a full row's last is left out."""
        score, own = self.score[at], self.id[at]
        k = score.shape[1]
        r, c = np.nonzero(allowed & (scores > score[:, -1:]))
        if not len(r):
            return
        touched, back = np.unique(r, return_inverse=True)
        rows = np.concatenate([back, np.repeat(np.arange(len(touched)), k)])
        all_scores, all_ids = np.concatenate([scores[r, c], score[touched].ravel()]), np.concatenate([ids[c], own[touched].ravel()])
        order = np.lexsort((all_ids, ~all_scores, rows))  # ~x falls as x grows, without overflow
        rows = rows[order]
        starts = np.searchsorted(rows, np.arange(len(touched)))
        rank = np.arange(len(rows)) - starts[rows]
        best = order[rank < k]
        score[touched], own[touched] = all_scores[best].reshape(-1, k), all_ids[best].reshape(-1, k)

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, score) of what is held."""
        r, c = np.nonzero(self.score != LOWEST)
        return r, self.id[r, c], self.score[r, c]


def _blocks(batches, spec: MiningSpec, width: int):
    """(ids, labels, vectors) of candidates; small blocks first, since they set thresholds that spare work in the later ones."""
    size = 64
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size)
            at, size = at + size, min(2 * size, spec.candidate_block)
            vectors, usable = whole_vectors(part.column(2), spec.scale, width)
            keep = np.flatnonzero(usable)
            yield part.column(0).to_numpy()[keep], part.column(1).to_numpy()[keep], vectors[keep]


def _usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    slim = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    return slim.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")


def _positives(batches, known, spec: MiningSpec):
    ids, labels, vectors = known
    found = First(len(ids), spec.positives)
    for c_ids, c_labels, c_vectors in _blocks(batches, spec, vectors.shape[1]):
        for a in range(0, len(ids), spec.anchor_block):
            at = slice(a, a + spec.anchor_block)
            allowed = (labels[at, None] == c_labels) & (ids[at, None] != c_ids)
            found.offer(at, products(vectors[at], c_vectors), c_ids, allowed)
    return found.kept()


def _negatives(batches, known, positive_scores: np.ndarray, held: np.ndarray, spec: MiningSpec):
    """(anchor, place of the positive, id, score).  ``held``: whether there is a positive at a place."""
    ids, labels, vectors = known
    hundredths = lambda p, share: p // 100 * share + p % 100 * share // 100  # noqa: E731  floor(p * share / 100), without overflow
    low, high = -hundredths(-positive_scores, spec.low), hundredths(positive_scores, spec.high)
    places = [First(len(ids), spec.negatives) for _ in range(spec.positives)]
    for c_ids, c_labels, c_vectors in _blocks(batches, spec, vectors.shape[1]):
        for a in range(0, len(ids), spec.anchor_block):
            at = slice(a, a + spec.anchor_block)
            scores, other = products(vectors[at], c_vectors), (labels[at, None] != c_labels) & (ids[at, None] != c_ids)
            for j, found in enumerate(places):
                found.offer(at, scores, c_ids, other & held[at, j, None] & (scores >= low[at, j, None]) & (scores <= high[at, j, None]))
    for j, found in enumerate(places):
        r, i, s = found.kept()
        yield r, np.full(len(r), j), i, s


def mine(rows: DataFrame, is_anchor, spec: MiningSpec = MiningSpec(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``is_anchor`` takes the id's column.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part.  Vectors of different
    lengths are compared as if filled up with zeros.  Ties go to the smaller id.  Each row is an anchor or a candidate
    of its own; rows with the anchor's own id are never its partners.  Anchors without positives and positives without
    negatives have no rows; an empty table gives none.  Further columns are not looked at.

    The anchors of a round, at most ``round_bytes`` of them, are what is broadcast; more anchors are more rounds.
    """
    spark = rows.sparkSession
    usable = _usable(rows, id_col, vector_col, label_col)
    anchors = materialize(usable.filter(is_anchor(F.col("id"))).withColumn("key", F.monotonically_increasing_id()), "anchors")
    size = anchors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    width = max(1, size["width"] or 0)
    rounds = max(1, -(-size["n"] * width * 8 // spec.round_bytes))
    # Ascending ids within a task let later candidates lose ties at once.
    candidates = usable.sortWithinPartitions("id")
    out = None
    for turn in range(rounds):
        got = anchors.filter(F.pmod(F.xxhash64("key"), F.lit(rounds)) == turn).select("id", "label", "vector").toArrow().combine_chunks()
        batch = (got.to_batches() or [pa.RecordBatch.from_pylist([], got.schema)])[0]
        vectors, fit = whole_vectors(batch.column(2), spec.scale, width)
        keep = np.flatnonzero(fit)
        known = (batch.column(0).to_numpy()[keep], batch.column(1).to_numpy()[keep], vectors[keep])
        mined = _round(spark, candidates, known, spec)
        out = mined if out is None else out.union(mined)
    return out


def _round(spark, candidates: DataFrame, known, spec: MiningSpec) -> DataFrame:
    sent = spark.sparkContext.broadcast(known)

    def first_pass(batches):
        r, i, s = _positives(batches, sent.value, spec)
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], names=["anchor", "id", "score"])

    ranked = lambda df, by, k: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    best = ranked(candidates.mapInArrow(first_pass, "anchor long, id long, score long"), ["anchor"], spec.positives).toArrow()
    n = len(known[0])
    ids, scores, held = np.zeros((n, spec.positives), np.int64), np.zeros((n, spec.positives), np.int64), np.zeros((n, spec.positives), bool)
    at = best["anchor"].to_numpy(), best["rank"].to_numpy() - 1
    ids[at], scores[at], held[at] = best["id"].to_numpy(), best["score"].to_numpy(), True
    found = spark.sparkContext.broadcast((ids, scores, held))

    def second_pass(batches):
        ids, scores, held = found.value
        for r, j, i, s in _negatives(batches, sent.value, scores, held, spec):
            columns = (r, j, sent.value[0][r], ids[r, j], scores[r, j], i, s)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["anchor", "place", "anchor_id", "positive_id", "positive_score", "id", "score"])

    schema = "anchor long, place long, anchor_id long, positive_id long, positive_score long, id long, score long"
    top = ranked(candidates.mapInArrow(second_pass, schema), ["anchor", "place"], spec.negatives)
    return top.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
