"""Paragraphs that speak of a table: by its number or by its rows' phrases, all phrases found in one pass over a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are no part of a row's phrase; the note where nothing matches; texts short enough to be used whole.
STOP = (
    "table", "the", "and", "group", "groups", "mean", "sd", "value", "baseline", "follow", "treatment", "control", "after", "from", "with", "for", "were", "was",
    "this", "that", "data", "change", "difference", "score", "total", "number", "patients", "participants",
)
NO_MATCH = "No directly matched Results narrative paragraph; use the supplied table evidence only."
SHORT, LEAST_PHRASE = 12_000, 5
#: Bytes of phrases that go to the tasks at once; more of them are found in several passes.
PHRASE_BYTES = 32 << 20


def row_phrase(label: Column) -> Column:
    """A row label as it is looked for: letters, digits and a few marks in lower case without stop words; null if short."""
    plain = F.lower(F.regexp_replace(label, r"[^A-Za-z0-9%/_ \-]", " "))
    words = F.filter(F.split(F.trim(F.regexp_replace(plain, " +", " ")), " "), lambda w: ~w.isin(*STOP) & (w != ""))
    phrase = F.array_join(words, " ")
    return F.when(F.length(phrase) >= LEAST_PHRASE, phrase)


def caption_phrases(caption: Column) -> Column:
    """Numbers of tables and figures that a caption names, in lower case."""
    return F.transform(F.regexp_extract_all(caption, F.lit(r"(?i)(?:table\s*\d+|fig(?:ure)?\s*\d+)"), 0), F.lower)


_TABLE, _BLANK, _TAG, _SPACE = (re.compile(p, re.I | re.S) for p in (r"<table\b.*?</table>", r"\n\s*\n", r"<[^>]+>", r"\s+"))


def paragraphs(text: str) -> list[str]:
    """A text's paragraphs without tables, tags and runs of white space."""
    parts = (_SPACE.sub(" ", _TAG.sub(" ", p)).strip() for p in _BLANK.split(_TABLE.sub("\n", text)))
    return [p for p in parts if p and not (p.startswith("|") and p.endswith("|"))]


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for p in phrases:
        found.add_word(p, p)
    found.make_automaton()
    return found


def _matched(docs: DataFrame, phrases: dict, key: str) -> DataFrame:
    """(id, key, place, paragraph): paragraphs with a phrase of their study; an automaton a study, built when first needed."""
    sent = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: dict = {}
        for batch in batches:
            ids, places, texts = [], [], []
            for i, study, text in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if study not in built:
                    built[study] = automaton(sent.value[study]) if sent.value.get(study) else None
                if built[study] is None:
                    continue
                for place, p in enumerate(paragraphs(text.as_py() or "")):
                    if next(built[study].iter(p.lower()), None):
                        ids.append(i.as_py())
                        places.append(place)
                        texts.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(places, pa.int32()), pa.array(texts, pa.string())], names=["id", "place", "paragraph"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", key, "text").mapInArrow(run, f"id {kind}, place int, paragraph string")


def relevant(docs: DataFrame, phrases: DataFrame, key: str) -> DataFrame:
    """(id, narrative, n_relevant) of ``docs`` (id, key, text), ids unique, by ``phrases`` (key, phrase).

    narrative: the whole paragraphs with a phrase of the document's key, repeats once, in order; without any, all
    paragraphs of a text of at most ``SHORT`` characters, or a note.  Null and blank texts have an empty narrative.
    Phrases are broadcast in rounds of bounded size, one for all that is usual; each paragraph is read once a round.
    """
    slim = phrases.filter(F.col("phrase").isNotNull() & (F.col("phrase") != "")).select(key, "phrase").distinct()
    size = slim.agg(F.sum(F.octet_length("phrase") + 16)).first()[0] or 0
    rounds = max(1, -(-size // PHRASE_BYTES))
    found = None
    for turn in range(rounds):
        held: dict = {}
        for r in slim.filter(F.pmod(F.xxhash64(key, "phrase"), F.lit(rounds)) == turn).collect():
            held.setdefault(r[key], []).append(r["phrase"])
        some = _matched(docs, held, key)
        found = some if found is None else found.union(some).distinct()
    # The first place of a paragraph counts; those of one document are bounded by its text.
    once = found.groupBy("id", "paragraph").agg(F.min("place").alias("place"))
    joined = once.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "paragraph"))), lambda x: x["paragraph"]), "\n\n").alias("matched"), F.count("*").alias("n"))

    @F.pandas_udf("string")
    def whole(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "\n\n".join(paragraphs(t or "")))

    out = docs.select("id", "text").join(joined, "id", "left")
    blank = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) == ""
    short = F.length("text") <= SHORT
    every = whole(F.when(F.col("matched").isNull() & short, F.col("text")))
    fallback = F.when(~short | (every == ""), NO_MATCH).otherwise(every)
    return out.select("id", F.when(blank, "").otherwise(F.coalesce("matched", fallback)).alias("narrative"), F.coalesce("n", F.lit(0)).alias("n_relevant"))
