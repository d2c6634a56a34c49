"""Lookup of publications by DOI or by title, misspelled titles included.

The score of two titles is the matching-blocks ratio 2M / T, M characters in
matching blocks of T in all.  Blocks are apart by characters that do not match,
so there are at most 1 + (T - 2M) of them, and each block of b characters shares
b - 1 pairs of neighbouring characters: at least 3M - T - 1 pairs are common.
Titles are compared once each, however many rows have them, block by block: a product of
matrices of the pairs that titles have bounds what two of them share, the
longest common subsequence bounds what that leaves, and only titles that may be among the
best are compared exactly.  The work is that of all pairs of different titles, about 2 D operations a pair.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.shared import written

#: Columns of the matrices, and how many of them are for the rarer pairs together.
COLUMNS, RARE = 512, 64
#: Titles of a block at most, blocks of the catalogue at least, and titles that are looked up together.
BLOCK, BLOCKS, AT_ONCE = 16_384, 96, 512
#: Bytes of the tables of one longest-common-subsequence pass, and pairs of titles in it.
TABLE_BYTES, PAIRS = 1 << 25, 1 << 16


def normalized(title: Column) -> Column:
    """Letters and digits in lower case, one space between words; blank is null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(title), r"(?U)[\W_]+", " ")), F.lit(""))


def pairs(title: Column) -> Column:
    """Pairs of neighbouring characters, numbered where they repeat, as an array without repeats."""
    every = F.transform(F.sequence(F.lit(1), F.length(title) - 1), lambda i: F.substring(title, i, F.lit(2)))
    numbered = F.transform(F.array(F.array_sort(every)), lambda s: F.transform(s, lambda x, i: F.concat(x, (i + 1 - F.array_position(s, x)).cast("string"))))
    return F.when(F.length(title) > 1, F.get(numbered, 0)).otherwise(F.array().cast("array<string>"))


def _chars(titles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all titles, the title that each is of, and its place there."""
    size = np.array([len(t) for t in titles], np.int64)
    row = np.repeat(np.arange(len(titles)), size)
    return np.frombuffer("".join(titles).encode("utf-32-le"), np.uint32).astype(np.int64), row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


def _matrix(titles: list[str], columns: dict[str, int]) -> np.ndarray:
    """How many of a title's numbered pairs fall to each column.

    Frequent pairs have a column each and the others share some by a hash, so
    the product of two rows is never less than the number of common pairs.
    """
    chars, row, _ = _chars(titles)
    inside = row[1:] == row[:-1]
    pair, row = ((chars[:-1] << 21) | chars[1:])[inside], row[1:][inside]
    order = np.lexsort((pair, row))
    pair, row = pair[order], row[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])
    at = np.arange(len(pair))
    number = at - np.maximum.accumulate(np.where(new, at, 0))
    frequent = sorted((ord(k[0]) << 42 | ord(k[1]) << 21 | int(k[2:]), c) for k, c in columns.items())
    code, place = (np.array(x, np.int64) for x in zip(*frequent or [(-1, 0)], strict=True))
    own = pair << 21 | number
    hit = np.minimum(np.searchsorted(code, own), len(code) - 1)
    column = np.where(code[hit] == own, place[hit], COLUMNS - RARE + (pair * 31 + number) % RARE)
    return np.bincount(row * COLUMNS + column, minlength=len(titles) * COLUMNS).reshape(len(titles), COLUMNS).astype(np.float32)


def _subsequences(one: list[str], two: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the pairs (i, j), by rows of bits.  ``two`` has a title's code points in a row, then -1."""
    out = np.zeros(len(i), np.int64)
    words = max(1, -(-max(map(len, one)) // 64))
    chars, row, place = _chars(one)
    letters = np.unique(chars)
    step = max(1, TABLE_BYTES // ((len(letters) + 1) * words * 8))
    for start in range(0, len(one), step):
        here = (row >= start) & (row < start + step)
        mask = np.zeros((min(step, len(one) - start), len(letters) + 1, words), np.uint64)
        np.bitwise_or.at(mask, (row[here] - start, np.searchsorted(letters, chars[here]), place[here] >> 6), np.uint64(1) << (place[here] & 63).astype(np.uint64))
        mine = np.flatnonzero((i >= start) & (i < start + step))
        for part in np.array_split(mine, -(-len(mine) // max(1, min(PAIRS, TABLE_BYTES // (words * 8)))) or 1):
            used, back = np.unique(j[part], return_inverse=True)
            text = np.minimum(np.searchsorted(letters, two[used]), len(letters) - 1)
            text = np.where(letters[text] == two[used], text, len(letters))
            a, state = i[part] - start, [np.full(len(part), ~np.uint64(0)) for _ in range(words)]
            for at in range(two.shape[1]):
                found = mask[a, text[back, at]]
                carry = np.zeros(len(part), np.uint64)
                for w in range(words):
                    both = state[w] & found[:, w]
                    total = state[w] + both
                    over = total < both
                    total += carry
                    carry = (over | (total < carry)).astype(np.uint64)
                    state[w] = total | (state[w] & ~found[:, w])
            out[part] = sum(np.bitwise_count(~v).astype(np.int64) for v in state)
    return out


def _best(a: str, others: list[tuple[float, str, int]], least: float, best: int) -> list[tuple[str, float]]:
    """(title, score) of all that may be among the first ``best`` rows; ``others`` have what they score at most, and how many rows have them."""
    out, held = [], []
    for most, b, copies in sorted(others, key=lambda x: -x[0]):
        if len(held) >= best and most < held[best - 1]:
            break
        score = SequenceMatcher(None, a, b, autojunk=False).ratio()
        if score >= least:
            out.append((b, score))
            held = sorted(held + [score] * copies, reverse=True)[:best]
    return [(b, s) for b, s in out if len(held) < best or s >= held[best - 1]]


def compared(wanted: list[str], known: list[str], copies: list[int], columns: dict[str, int], least: float, best: int) -> list[tuple[str, str, float]]:
    """(wanted, known, score): titles of one block with those of another, as far as they may be among the first ``best`` rows."""
    right, m, out = _matrix(known, columns).T.copy(), np.array([len(t) for t in known], np.int64), []
    chars, row, place = _chars(known)
    text = np.full((len(known), m.max()), -1, np.int64)
    text[row, place] = chars
    for start in range(0, len(wanted), AT_ONCE):
        some = wanted[start : start + AT_ONCE]
        n = np.array([len(t) for t in some], np.int64)[:, None]
        common = np.ceil(least * (n + m) / 2 - 1e-9).astype(np.float32)
        i, j = np.nonzero((_matrix(some, columns) @ right >= 3 * common - (n + m + 1).astype(np.float32)) & (np.minimum(n, m) >= common))
        most = 2.0 * _subsequences(some, text, i, j) / (n[i, 0] + m[j])
        near: dict[int, list] = {}
        for x in np.flatnonzero(most >= least):
            near.setdefault(i[x], []).append((most[x], known[j[x]], copies[j[x]]))
        out += [(some[x], b, s) for x, others in near.items() for b, s in _best(some[x], others, least, best)]
    return out


def nearest(wanted: DataFrame, catalogue: DataFrame, least: float, best: int) -> DataFrame:
    """(title, other, score): for each title of ``wanted`` those of ``catalogue`` of the least score that may be among the first ``best`` rows.

    ``wanted`` has each title once, ``catalogue`` too, with the number of its rows as copies.
    """
    frequent = catalogue.select(F.explode(pairs(F.col("title"))).alias("p")).groupBy("p").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p").limit(COLUMNS - RARE)
    columns = {r["p"]: k for k, r in enumerate(frequent.collect())}
    rows = -(-wanted.count() // BLOCK) or 1
    blocks = max(BLOCKS, -(-catalogue.count() // BLOCK))
    at, block = F.pmod(F.xxhash64("title"), F.lit(rows)), F.pmod(F.xxhash64("title"), F.lit(blocks))
    one = wanted.select(at.alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "title", F.lit(0).alias("copies"))
    two = catalogue.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))).alias("row"), block.alias("block"), "title", F.col("copies").cast("int").alias("copies"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = pdf[pdf["copies"] == 0], pdf[pdf["copies"] > 0]
        both = len(mine) and len(theirs)
        found = compared(mine["title"].tolist(), theirs["title"].tolist(), theirs["copies"].tolist(), columns, least, best) if both else []
        return pd.DataFrame(found, columns=["title", "other", "score"])

    # A number of partitions that stays: the tasks are long, but their rows are few.
    return one.union(two).repartition(rows * blocks, "row", "block").groupBy("row", "block").applyInPandas(run, "title string, other string, score double")


def lookup(wanted: DataFrame, catalogue: DataFrame, least: float = 0.88, best: int = 3) -> DataFrame:
    """(id, rank, method, key, score, error): for each wanted row the first ``best`` of the catalogue, or one row with an error.

    Both have id, title and doi.  A DOI that is found, case aside, scores 1 and ends the search; else titles of at least
    the least score are ranked by score, then by id.  A row with neither, or with a title that nothing is near to, has an
    error.  ``key`` is the catalogue's id.
    """
    if not 0.8 < least <= 1:
        raise ValueError("at a least score of 0.8 or below, short titles that differ need not share a pair")
    own = written(wanted.select("id", normalized(F.col("title")).alias("title"), F.nullif(F.lower(F.trim("doi")), F.lit("")).alias("doi")), "wanted")
    known = written(catalogue.select("id", normalized(F.col("title")).alias("title"), F.nullif(F.lower(F.trim("doi")), F.lit("")).alias("doi")), "catalogue")
    by_doi = own.filter("doi IS NOT NULL").join(known.groupBy("doi").agg(F.min("id").alias("key")), "doi").select("id", F.lit("doi").alias("method"), "key", F.lit(1.0).alias("score"))
    left = own.join(by_doi.select("id"), "id", "left_anti")
    titled, listed = left.filter("id IS NOT NULL AND title IS NOT NULL"), known.filter("id IS NOT NULL AND title IS NOT NULL")
    # Of rows with equal titles only the first can be among the best.
    first = listed.withColumn("n", F.row_number().over(Window.partitionBy("title").orderBy("id"))).filter(F.col("n") <= best)
    first = written(first.select(F.col("title").alias("other"), F.col("id").alias("key")), "titles")
    asked = written(titled.select("title").distinct(), "asked")
    counted = written(first.groupBy(F.col("other").alias("title")).agg(F.count("*").alias("copies")), "known")
    near = nearest(asked, counted, least, best).join(first, "other")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("title").orderBy(F.desc("score"), "key"))).filter(F.col("rank") <= best)
    scored = titled.select("id", "title").join(ranked, "title").select("id", F.lit("title").alias("method"), "key", "score", "rank")
    found = written(by_doi.withColumn("rank", F.lit(1)).unionByName(scored), "found")
    error = F.when(F.col("title").isNull(), "no title").otherwise("no title of the least score")
    missed = own.join(found.select("id").distinct(), "id", "left_anti").select("id", F.lit(1).alias("rank"), F.lit(None).cast("string").alias("method"), F.lit(None).cast(found.schema["key"].dataType).alias("key"), F.lit(None).cast("double").alias("score"), error.alias("error"))
    return found.withColumn("error", F.lit(None).cast("string")).unionByName(missed)
