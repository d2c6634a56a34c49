"""Toxicity by a learned lexicon, misspellings included, and the context of each hit.

Terms (whole words, and stems that any ending may follow) are learned from
labelled documents; whole words are also found misspelled.  At scan time a word is intersected with the lexicon's trie
by a Levenshtein automaton: its state is the row of edit distances between the
trie path so far and the word, transpositions included, and a path is left as
soon as no distance in the row is within the bound.  Each hit is scored in a
window of words around it: quotation marks and words of reporting turn abuse
into quotation, further hits nearby make it likelier.  A logistic model over
these sums gives the score.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_state
from .tokens import slices

#: Words and marks that report speech.
REPORTING = frozenset("said says say wrote writes quote quoted quotes called calls calling reported allegedly insult insults slur slurs word words term terms".split())
QUOTES = "\"“”«»„‘’`"
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”«»„‘’…–—¡¿"
#: Ends the name of a term that is a stem; no word ends in it.
STEM = "\n"


@dataclass(frozen=True)
class ToxicSpec:
    """``max_train`` bounds the labelled documents that are fitted on; ``min_gain`` is a term's least G statistic, where the sample is large enough for it."""

    max_train: int = 20_000
    min_gain: float = 28.0
    min_log_odds: float = 3.0
    stems: tuple[int, ...] = (4, 5, 6, 7)
    window: int = 6
    min_fuzzy: int = 5


class Lexicon:
    """Terms with weights.  A term is (text, is_stem)."""

    def __init__(self, terms: dict[tuple[str, bool], float], spec: ToxicSpec = ToxicSpec(), no_fuzzy: frozenset = frozenset()):
        self.terms, self.spec = terms, spec
        self.words = {t: w for (t, stem), w in terms.items() if not stem}
        self.stems = {t: w for (t, stem), w in terms.items() if stem}
        self.stem_sizes = sorted({len(t) for t in self.stems})
        self.trie: dict = {}
        # A word near a term keeps a half of it at that end, or the halves' middle is swapped; and few letters differ.
        # By the word's length: the halves at either end, by their size, with the letters of the terms that have them.
        self.halves: dict[int, tuple[dict, dict]] = {}
        for (text, stem), _ in terms.items():
            if stem or len(text) < spec.min_fuzzy or (text, stem) in no_fuzzy:
                continue
            node = self.trie
            for c in text:
                node = node.setdefault(c, {})
            node[None] = (text, False)
            m = len(text) // 2
            for t in (text, text[: m - 1] + text[m] + text[m - 1] + text[m + 1 :]):
                for n in (len(t) - 1, len(t), len(t) + 1):
                    heads, tails = self.halves.setdefault(n, ({}, {}))
                    heads.setdefault(m, {}).setdefault(t[:m], set()).add(_letters(text))
                    tails.setdefault(len(t) - m, {}).setdefault(t[m:], set()).add(_letters(text))
        # Whatever is found begins like a term, or like the halves at a head, or ends like those at a tail.
        self.firsts = {t[:2] for t, _ in terms} | {h[:2] for heads, _ in self.halves.values() for at in heads.values() for h in at}
        self.lasts = {t[-2:] for _, tails in self.halves.values() for at in tails.values() for t in at}
        self.memo = _Memo(self._find)

    def _may_be_near(self, word: str) -> bool:
        heads, tails = self.halves.get(len(word), ({}, {}))
        some = [own for k, at in heads.items() if (own := at.get(word[:k]))] + [own for k, at in tails.items() if (own := at.get(word[-k:]))]
        if not some:
            return False
        letters = _letters(word)
        return any((letters ^ x).bit_count() <= 2 for own in some for x in own)

    def near(self, word: str, most: int = 1) -> tuple[str, bool] | None:
        """The term of least distance within ``most`` edits, by walking the trie along the automaton.

        A state is the part of the row of distances that can still matter: those of path and word whose lengths differ
        by at most ``most``.
        """
        best, n, far, width = None, len(word), most + 1, 2 * most + 1
        stack = [(self.trie, 0, tuple(max(j, 0) if j >= 0 else far for j in range(-most, most + 1)), None, "")]
        while stack:
            node, depth, row, before, last = stack.pop()
            if None in node and -most <= n - depth <= most and row[n - depth + most] <= most:
                best = min(best or (far,), (row[n - depth + most], *node[None]))
            depth += 1
            for c, child in node.items():
                if c is None:
                    continue
                new, left = [], far
                for t in range(width):
                    j = depth - most + t
                    if j < 0 or j > n:
                        left = far
                    elif j == 0:
                        left = min(far, depth)
                    else:
                        cost = row[t] if word[j - 1] == c else row[t] + 1
                        if left < cost:
                            cost = min(cost, left + 1)
                        if t + 1 < width and row[t + 1] < cost:
                            cost = min(cost, row[t + 1] + 1)
                        if before is not None and j > 1 and word[j - 1] == last and word[j - 2] == c and before[t] < cost:
                            cost = min(cost, before[t] + 1)
                        left = min(far, cost)
                    new.append(left)
                if min(new) <= most:
                    stack.append((child, depth, tuple(new), row, c))
        return best[1:] if best else None

    def find(self, word: str) -> tuple[tuple[str, bool], bool] | None:
        """(term, exact) of a word as it stands in a text, marks at its ends left aside; or None."""
        return self.memo[word]

    def _find(self, word: str) -> tuple[tuple[str, bool], bool] | None:
        if not word.isalnum():
            word = word.strip(_STRIP)
        if word[:2] not in self.firsts and word[-2:] not in self.lasts:
            return None
        if word in self.words:
            return (word, False), True
        for n in self.stem_sizes:
            if word[:n] in self.stems:
                return (word[:n], True), True
        if len(word) in self.halves and self._may_be_near(word) and (near := self.near(word)):
            return near, False
        return None


class _Memo(dict):
    """A word's find, worked out once; starts anew when full, which bounds a worker's memory."""

    LIMIT = 400_000

    def __init__(self, find):
        super().__init__()
        self.work_out = find

    def __missing__(self, word: str):
        if len(self) >= self.LIMIT:
            self.clear()
        found = self[word] = self.work_out(word)
        return found


def _letters(word: str) -> int:
    """A word's letters as a set of bits."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _opens(word: str) -> bool:
    return word[0] in QUOTES


def _closes(word: str) -> bool:
    bare = word.rstrip(".,!?;:")
    return bare[-1:] in QUOTES and bool(bare)


def _between_marks(left: list[str], own: str, right: list[str]) -> bool:
    """Whether a mark opened to the left of a word, or at it, is closed at the word or to its right, before another opens."""
    is_open = False
    for w in left:
        is_open = (is_open or _opens(w)) and not (_closes(w) and (is_open or len(w.rstrip(".,!?;:")) > 1))
    if not (is_open or _opens(own)):
        return False
    if _closes(own) and (is_open or len(own.rstrip(".,!?;:")) > 1):
        return True
    for w in right:
        if _closes(w):
            return True
        if _opens(w):
            return False
    return False


def hits(text: str, lexicon: Lexicon) -> tuple[int, list[tuple[int, tuple[str, bool], bool, bool, int]]]:
    """(number of words, hits): position, term, exact, quoted, further hits in the window."""
    raw = words_of(text)
    found = [(i, *hit) for i, hit in enumerate(map(lexicon.memo.__getitem__, raw)) if hit]
    if not found:
        return len(raw), []
    places = [i for i, _, _ in found]
    width, out = lexicon.spec.window, []
    for i, term, exact in found:
        around = raw[max(0, i - width) : i + width + 1]
        left, right = raw[max(0, i - width) : i], raw[i + 1 : i + 1 + width]
        quoted = _between_marks(left, raw[i], right) or any(w.strip(_STRIP) in REPORTING for w in around)
        near = bisect_right(places, i + width) - bisect_left(places, i - width)
        out.append((i, term, exact, quoted, near - 1))
    return len(raw), out


NAMES = ("exact", "fuzzy", "quoted", "close", "density")


def features(n_words: int, found: list, lexicon: Lexicon) -> list[float]:
    """Sums of term weights, scaled so that a few hits count as much as many."""
    exact = fuzzy = quoted = close = 0.0
    for _, term, is_exact, is_quoted, near in found:
        weight = lexicon.terms[term]
        if is_quoted:
            quoted += weight
        elif is_exact:
            exact += weight
        else:
            fuzzy += weight
        close += near > 0 and not is_quoted
    return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(close), math.log1p(100 * len(found) / max(1, n_words))]


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(NAMES) + 1))

    def score(self, text: str) -> tuple[float, list]:
        n, found = hits(text, self.lexicon)
        z = self.weights[0] + float(np.dot(self.weights[1:], features(n, found, self.lexicon)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), found


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Newton steps on the log loss with a ridge towards ``prior`` (intercept first, not held)."""
    x = np.column_stack([np.ones(len(x)), x])
    w, hold = prior.astype(float).copy(), np.full(x.shape[1], strength)
    hold[0] = 1e-3
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (p - y) + hold * (w - prior))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


#: Weights before any data: exact hits count, misspelled ones less, quoted ones little.
PRIOR = np.array([-4.0, 3.0, 2.0, 0.3, 0.5, 0.5])


def training_rows(docs: DataFrame, labels: DataFrame, usable, spec: ToxicSpec) -> DataFrame:
    """(doc_id, text, toxic) of at most about ``max_train`` labelled documents, chosen by a hash of the id.

    The ids are at most twice the bound and go to the scan as a broadcast.
    """
    known = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic")).filter(usable("label_id"))
    n = known.count()
    if n > spec.max_train:
        known = known.filter(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int(spec.max_train / n * (1 << 30)))
    return docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "toxic")


def learn_lexicon(rows: DataFrame, spec: ToxicSpec) -> dict[tuple[str, bool], float]:
    """Terms that mark the toxic class: document counts by class, pre-aggregated, then a G test and a least log odds."""
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return {}

    def count(wanted: frozenset | None):
        """Documents with each term; with ``wanted``, of those terms only."""

        def terms_of(word: str) -> tuple[str, ...]:
            bare = word.strip(_STRIP)
            terms = (bare, *[bare[:n] + STEM for n in spec.stems if len(bare) > n]) if len(bare) > 2 else ()
            return terms if wanted is None else tuple(t for t in terms if t in wanted)

        def run(batches):
            seen: Counter = Counter()
            memo = _Memo(terms_of)
            for batch in batches:
                for text in batch.column(0):
                    terms: set[str] = set()
                    for word in set(words_of(text.as_py() or "")):
                        terms.update(memo[word])
                    seen.update(terms)
            some = list(seen.items())
            for at in range(0, len(some), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in some[at : at + 50_000]], t) for k, t in enumerate((pa.string(), pa.int64()))], names=["term", "n"])

        return run

    counted = lambda toxic, wanted: rows.filter(F.col("toxic") == toxic).select("text").mapInArrow(count(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    # A term in fewer toxic documents cannot reach the least gain; there are at most (terms in toxic texts) / least.
    # Of a small sample no term may reach it: half of what a term of all toxic documents, and no other, gains is enough.
    per_document = 2 * math.log((n_pos + n_neg) / n_pos)
    min_gain = min(spec.min_gain, n_pos * per_document / 2)
    least = max(3, math.ceil(min_gain / per_document))
    pos = {r["term"]: r["n"] for r in counted(1, None).filter(F.col("n") >= least).collect()}
    neg = {r["term"]: r["n"] for r in counted(0, frozenset(pos)).collect()}
    share = n_pos / (n_pos + n_neg)
    entropy = lambda o, e: o * math.log(o / e) if o else 0.0
    best = []
    for term, p in pos.items():
        n = neg.get(term, 0)
        odds = math.log((p + 0.5) / (n_pos + 1)) - math.log((n + 0.5) / (n_neg + 1))
        gain = 2 * (entropy(p, (p + n) * share) + entropy(n, (p + n) * (1 - share)))
        if odds >= spec.min_log_odds and gain >= min_gain:
            best.append((-gain, -len(term.rstrip(STEM)), term, odds))
    chosen: dict[tuple[str, bool], float] = {}
    for _, _, name, odds in sorted(best):  # a term that a chosen one covers adds nothing
        term, stem = name.rstrip(STEM), name.endswith(STEM)
        if any((s and term.startswith(t)) or (stem and t.startswith(term)) or t == term for t, s in chosen):
            continue
        chosen[term, stem] = min(8.0, odds)
    return chosen


def learn(docs: DataFrame, labels: DataFrame, usable, spec: ToxicSpec = ToxicSpec()) -> Model:
    """Fit the lexicon and the model on labelled documents that ``usable(column)`` admits.

    Labels without a document or without a verdict teach nothing; of repeated labels of an id the greatest counts;
    null texts are empty.  Where repeated rows make the sample larger than twice its bound, each id teaches once, by
    its least text.  Further columns are not looked at.
    Without toxic or without harmless labels the lexicon is empty and the scores are the prior's.
    """
    rows = training_rows(docs, labels, usable, spec).cache()
    if rows.count() > 2 * spec.max_train:
        every = rows
        rows = every.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).cache()
        rows.count()
        every.unpersist()
    terms = learn_lexicon(rows, spec)

    def measured(lexicon: Lexicon):
        def run(batches):
            for batch in batches:
                out = []
                for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    n, found = hits(text or "", lexicon)
                    fuzzy = sorted({f"{t[0]}\t{int(t[1])}" for _, t, exact, _, _ in found if not exact})
                    out.append((toxic, features(n, found, lexicon), fuzzy))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.list_(pa.float64())), pa.array([o[2] for o in out], pa.list_(pa.string()))], names=["toxic", "x", "fuzzy"])

        return rows.select("text", "toxic").mapInArrow(run, "toxic int, x array<double>, fuzzy array<string>")

    lexicon = Lexicon(terms, spec)
    got = measured(lexicon).collect()
    # Terms whose misspellings turn up in harmless documents are matched exactly only.
    harmless = Counter(t for r in got if not r["toxic"] for t in r["fuzzy"])
    loose = frozenset((t.split("\t")[0], t.split("\t")[1] == "1") for t, n in harmless.items() if n > 0.0005 * len(got))
    if loose:
        lexicon = Lexicon(terms, spec, loose)
        got = measured(lexicon).collect()
    rows.unpersist()
    model = Model(lexicon, PRIOR.copy())
    y = np.array([r["toxic"] for r in got], float)
    if len(y) and 0 < y.sum() < len(y):
        model.weights = fit_logistic(np.array([r["x"] for r in got]), y, PRIOR)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, hits (position, term, exact, quoted): one row per input row, whole texts.

    Null and empty texts have no hits and the score of a text without any.  Repeated rows are scored each; an empty
    table gives no rows; columns other than the two are not looked at, whatever their names.
    """
    lexicon = model.lexicon
    parts = (lexicon.terms, lexicon.spec, frozenset(t for t in lexicon.terms if not _in_trie(lexicon, t)), model.weights)
    kind = pa.list_(pa.struct([("position", pa.int64()), ("term", pa.string()), ("exact", pa.bool_()), ("quoted", pa.bool_())]))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("hits", kind)])

    token = uuid.uuid4().hex

    def run(batches):
        # A worker keeps the lexicon, and what it has found by word, from task to task.
        own = worker_state(("toxicity", token), lambda: Model(Lexicon(*parts[:3]), parts[3]))
        for batch in batches:
            for ids, texts in slices(batch):
                got = [own.score(t) for t in texts]
                found = [[{"position": i, "term": t[0], "exact": e, "quoted": q} for i, t, e, q, _ in f] for _, f in got]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s for s, _ in got]), pa.array(found, kind)], schema=schema)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double, hits array<struct<position:long,term:string,exact:boolean,quoted:boolean>>")


def _in_trie(lexicon: Lexicon, term: tuple[str, bool]) -> bool:
    node = lexicon.trie
    for c in term[0]:
        node = node.get(c)
        if node is None:
            return False
    return node.get(None) == term


def id_remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))
