"""Text normalization and parsing, column in, column out; all JVM-side but ``nfkc_casefold``."""

from __future__ import annotations

from collections.abc import Iterable
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Texts that mean "not reported", compared in lower case after trimming.
NOT_REPORTED = ("", "nr", "na", "n/a", "none")
#: Further texts that are emptied when records are cleaned.
CLEANED_AWAY = (*NOT_REPORTED, "null", "nan", "not reported")
#: HTML entities that cells contain.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&minus;": "-", "&plusmn;": "±", "&amp;": "&"}
#: Words that open a count or rate of something.
WRAPPERS = ("number", "count", "rate", "percentage", "proportion")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def is_not_reported(c: Column) -> Column:
    """Null, blank, or one of the fixed texts."""
    return c.isNull() | F.lower(strip(c)).isin(*NOT_REPORTED)


def clean_not_reported(c: Column) -> Column:
    """Null where the text says that nothing was reported."""
    return F.when(F.lower(strip(c)).isin(*CLEANED_AWAY), None).otherwise(c)


def key(c: Column) -> Column:
    """Comparison key: lower case, white space collapsed; null if not reported."""
    return F.when(is_not_reported(c), None).otherwise(F.lower(collapse(c)))


def grammatical_key(c: Column) -> Column:
    """``key`` without "number of", and "frequency of x" as "x frequency"."""
    plain = F.regexp_replace(key(c), r"^number of\s+", "")
    return F.regexp_replace(plain, r"^frequency of (.+)$", "$1 frequency")


def first_reported(*columns: Column) -> Column:
    """The first of the columns that reports something."""
    return F.coalesce(*[F.when(~is_not_reported(c), c) for c in columns])


def grouping_key(c: Column) -> Column:
    """Lower case, dashes, underscores and slashes as spaces, other marks but dots dropped; ``nr`` if nothing is left."""
    spaced = F.regexp_replace(F.lower(c), r"[-–—_/]+", " ")
    plain = collapse(F.regexp_replace(spaced, r"[^a-z0-9. ]", ""))
    return F.coalesce(blank_to_null(plain), F.lit("nr"))


def word_key(c: Column) -> Column:
    """Runs of anything but ASCII letters and digits become one space, lower case."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits of more than one character."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0), lambda t: F.length(t) > 1)


def versus(c: Column) -> Column:
    """``vs.`` and ``versus`` as ``vs``."""
    return F.regexp_replace(c, r"(?i)\b(?:vs\.|versus)", "vs")


def contrast_sides(c: Column) -> Column:
    """Two sides of a contrast, or null unless there are exactly two that are not blank."""
    sides = F.transform(F.split(versus(c), r"(?i)\s+vs\s+"), collapse)
    return F.when((F.size(sides) == 2) & ~F.exists(sides, lambda s: s == ""), sides)


def unwrap_statistic(c: Column) -> Column:
    """struct(subject, kind) of "number of x" and the like; kind is null and the subject whole otherwise."""
    pattern = rf"(?i)^({'|'.join(WRAPPERS)}) of (.+)$"
    hit = F.regexp_extract(collapse(c), pattern, 1)
    return F.struct(F.when(hit == "", collapse(c)).otherwise(F.regexp_extract(collapse(c), pattern, 2)).alias("subject"), F.lower(blank_to_null(hit)).alias("kind"))


def clean_cell(c: Column) -> Column:
    """A table cell's text: tags as spaces, entities resolved, minus signs as hyphens, white space collapsed."""
    out = F.regexp_replace(c, "<[^>]*>", " ")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(F.regexp_replace(out, "[−–—]", "-"))


def html_cells(row: Column) -> Column:
    """Cleaned texts of all cells of an HTML table row, in order."""
    return F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), 1), clean_cell)


def pipe_cells(line: Column) -> Column:
    """Cells of a pipe table's line; escaped bars stay."""
    inner = F.regexp_replace(strip(line), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda x: collapse(F.replace(x, F.lit("\\|"), F.lit("|"))))


def caption_id(c: Column) -> Column:
    """``table-2`` from "Table 2. ..."."""
    number = F.regexp_extract(c, r"(?i)\btable\s+([0-9]+)", 1)
    return F.when(number != "", F.concat(F.lit("table-"), number))


def strip_part(c: Column) -> Column:
    """An id without its transport suffix ``#part-N``."""
    return strip(F.regexp_replace(c, r"#part-[0-9]+$", ""))


def study_id(path: Column) -> Column:
    """``YYYY-NN`` from a path, else its stem."""
    pattern = r"(20[0-9]{2})-?0*([0-9]{1,2})"
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    return F.when(F.regexp_extract(path, pattern, 1) == "", stem).otherwise(F.concat_ws("-", F.regexp_extract(path, pattern, 1), F.lpad(F.regexp_extract(path, pattern, 2), 2, "0")))


def dois(c: Column) -> Column:
    """All DOIs, lower case, trailing punctuation dropped, first occurrences in order."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"10\.[0-9]{4,9}/[^\s\"<>]+"), 0)
    return F.array_distinct(F.transform(found, lambda d: F.regexp_replace(d, r"[.,;:)\]]+$", "")))


def emails(c: Column) -> Column:
    """E-mail addresses, with spaces around @ and dots repaired, first occurrences in order."""
    joined = F.regexp_replace(F.regexp_replace(c, r"\s*@\s*", "@"), r"(?<=@[\w.-]{0,64})\s*\.\s*(?=[a-z])", ".")
    return F.array_distinct(F.regexp_extract_all(F.lower(joined), F.lit(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"), 0))


def analysis_set(c: Column) -> Column:
    """ITT, PP, FAS, LOCF or MMRM, the first named; else NR."""
    named = F.regexp_extract(F.upper(c), r"\b(ITT|PP|FAS|LOCF|MMRM)\b", 1)
    return F.coalesce(blank_to_null(named), F.lit("NR"))


def keyword_category(c: Column, rules: Iterable[tuple[str, Iterable[str]]], other: str = "other") -> Column:
    """The first category one of whose words the text has."""
    out = F.lit(other)
    for name, words in reversed(list(rules)):
        out = F.when(F.lower(c).rlike("|".join(words)), F.lit(name)).otherwise(out)
    return out


def keyword_window(c: Column, words: Iterable[str], radius: int) -> Column:
    """The text around the first keyword, by the order of the words, that occurs."""
    places = [F.instr(F.lower(c), w) for w in words]
    at = F.coalesce(*[F.when(p > 0, p) for p in places])
    return F.substring(c, F.greatest(at - radius, F.lit(1)), at + radius - F.greatest(at - radius, F.lit(1)))


@F.pandas_udf(StringType())
def nfkc_casefold(values: pd.Series) -> pd.Series:
    """NFKC, case folding and collapsed white space; Spark has no built-in for the first two."""
    # One text at a time: forms of a whole batch would lie in memory beside each other.
    return values.map(lambda x: " ".join(normalize("NFKC", x).casefold().split()), na_action="ignore")
