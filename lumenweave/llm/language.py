"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram's vector binds its
letters' vectors, each permuted (rotated) by its place, by elementwise product;
a text's vector bundles (adds up) those of all its trigrams, and a language's
prototype those of its training texts.  A text's language is the prototype of
the greatest cosine.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, worker_state
from .toxicity import id_remainder

DIMENSIONS, GRAM, SEED = 1024, 3, 7
UNKNOWN = "und"


class Space:
    """Vectors of letters and trigrams, made when first met.  Code 0 stands for whatever lies between words."""

    #: Trigram vectors kept before the table starts anew; bounds a worker's memory.
    LIMIT = 40_000

    def __init__(self):
        self.table = np.zeros((self.LIMIT, DIMENSIONS), np.int8)  # pages that are never written take no memory
        self.letters: dict[int, np.ndarray] = {}
        self.at: dict[int, int] = {}
        self.codes = np.zeros(0x110000, np.uint32)
        self.known = np.zeros(0x110000 >> 8, bool)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, dtype=np.int8)
            self.letters[code] = (2 * bits - 1).astype(np.int8)
        return self.letters[code]

    def trigram(self, packed: int) -> np.ndarray:
        parts = [packed >> 42, packed >> 21 & 0x1FFFFF, packed & 0x1FFFFF]
        out = np.ones(DIMENSIONS, np.int8)
        for place, code in enumerate(parts):
            out *= np.roll(self.letter(code), GRAM - 1 - place)
        return out

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """(packed trigrams, counts, whether there is a letter) of a whole text, lower-cased."""
        raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        pages = np.unique(raw >> 8)
        for page in pages[~self.known[pages]].tolist():
            block = np.arange(page << 8, (page + 1) << 8)
            self.codes[block] = [c if chr(c).isalpha() else 0 for c in block.tolist()]
            self.known[page] = True
        codes = np.concatenate([[np.uint32(0)], self.codes[raw], [np.uint32(0)]]).astype(np.int64)
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]  # one gap between words
        if len(codes) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), False
        packed, counts = np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)
        return packed, counts, True

    def bundle(self, packed: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The text's vector."""
        if len(self.at) + len(packed) > self.LIMIT:
            self.at.clear()
        at, rows = self.at, np.empty(len(packed), np.int64)
        for i, p in enumerate(packed.tolist()):
            row = at.get(p)
            if row is None:
                row = at[p] = len(at)
                if row >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[row] = self.trigram(p)
            rows[i] = row
        out = np.zeros(DIMENSIONS, np.float32)
        for a in range(0, len(rows), 1024):
            out += counts[a : a + 1024].astype(np.float32) @ self.table[rows[a : a + 1024]].astype(np.float32)
        return out


def space() -> Space:
    """This worker's vectors; they outlive the task."""
    return worker_state("space", Space)


def unit(v: np.ndarray) -> np.ndarray:
    n = float(np.linalg.norm(v))
    return v / n if n else v


def learn(docs: DataFrame, usable, max_per_language: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototype vectors by language, from documents that ``usable(column)`` admits.

    Fitted on a sample of about ``max_per_language`` documents of each language,
    chosen by a hash of the id; a text counts by its direction, not its length.
    Texts without letters teach nothing.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & usable("doc_id"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    often = [x for x, n in sizes.items() if n > max_per_language]
    limit = F.lit(1 << 30)
    for x in often:
        limit = F.when(F.col("lang") == x, int(max_per_language / sizes[x] * (1 << 30))).otherwise(limit)

    def partial(batches):
        total: dict[str, np.ndarray] = {}
        own = space()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packed, counts, letters = own.grams(text or "")
                if letters:
                    total[lang] = total.get(lang, 0) + unit(own.bundle(packed, counts))
        if total:
            yield pa.RecordBatch.from_pydict({"lang": list(total), "vector": [v.astype("<f4").tobytes() for v in total.values()]})

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        vector = np.sum([np.frombuffer(v, "<f4").astype(float) for v in part["vector"]], axis=0)
        return pd.DataFrame({"lang": [key[0]], "vector": [vector.astype("<f8").tobytes()]})

    # At most a row for each language of each task that has sampled documents.
    partials = known.filter(chance < limit).select("lang", "text").mapInArrow(partial, "lang string, vector binary")
    total = partials.groupBy("lang").applyInPandas(add, "lang string, vector binary")
    return {r["lang"]: unit(np.frombuffer(r["vector"], "<f8")) for r in total.orderBy("lang").collect()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and lang_score, the greatest cosine (0 if negative); columns of these names are replaced.

    A text that is null, empty or without a letter is ``und`` with score 0, as
    is every text where no language was learned.  Ties go to the first language
    in code-point order.  Repeated rows are judged each; an empty table gives no
    rows.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float32) if names else np.zeros((0, DIMENSIONS), np.float32)
    kind = pa.struct([("lang_pred", pa.string()), ("lang_score", pa.float64())])

    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = space()
        for batch in texts:
            preds, scores = [], []
            for text in batch:
                packed, counts, letters = own.grams(text.as_py() or "")
                if not letters or not names:
                    preds.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = matrix @ unit(own.bundle(packed, counts))
                best = int(np.argmax(cosines))
                preds.append(names[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pa.StructArray.from_arrays([pa.array(preds, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))

    # Only the text goes to the Python worker; the other columns wait for its answer in the JVM.
    identified = F.arrow_udf(found, "lang_pred string, lang_score double")
    (name,) = fresh_names(docs, "found")
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "lang_score")]
    out = docs.withColumn(name, identified(F.col(text_col)))
    return out.select(*kept, F.col(f"{name}.lang_pred").alias("lang_pred"), F.col(f"{name}.lang_score").alias("lang_score"))


def not_held_out(column: str):
    return F.coalesce(id_remainder(column, 4) != 2, F.lit(False))
