"""Table and study vocabulary: headers, statistics, roles, codes; what a cell says by its shape."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import NUMBER
from .text import blank_to_null, collapse

#: Patterns in table headers, those that weigh two more, and patterns of statistics.
HEADER_TERMS = (
    r"\boutcome\b", r"\bgroup\b", r"\barm\b", r"\bvariable\b", r"\bcharacteristic\b", r"\bbaseline\b", r"\bweek", r"\bmonth", r"\bmean\b", r"\bsd\b", r"\bse\b",
    r"\bp(?:\s*value)?\b", r"\bci\b", r"\blsmd\b", r"\bestimate\b", r"\bconfidence\b", r"\bpatient number", r"\bintensity\b", r"\bquestionnaire\b", r"\bitems?\b",
    r"\btreatment\b", r"\bfollow[- ]?up\b", r"\bn\s*=",
)
STRONG_TERMS = r"n\s*=|significance|real\s+acupuncture|sham\s+acupuncture"
STATISTICS = (("median", "median"), ("mean", "mean"), ("risk ratio|\\brr\\b", "risk_ratio"), ("odds ratio|\\bor\\b", "odds_ratio"), ("n \\(%\\)|events?", "event_count"), ("percent|%", "percentage"), ("change", "change"))
#: Statistic and analysis names as written, and their code.
STATISTIC_NAMES = {
    "mean": "mean", "mean value": "mean", "arithmetic mean": "mean", "median": "median", "event count": "event_count", "event_count": "event_count", "events": "event_count",
    "proportion": "proportion", "percentage": "percentage", "percent": "percentage", "change": "change", "change from baseline": "change", "other": "other",
    "mean difference": "mean_difference", "md": "mean_difference", "risk ratio": "risk_ratio", "rr": "risk_ratio", "odds ratio": "odds_ratio", "or": "odds_ratio",
}
ANALYSIS_NAMES = {"itt": "ITT", "intention-to-treat": "ITT", "intention to treat": "ITT", "pp": "PPS", "pps": "PPS", "per-protocol": "PPS", "per protocol": "PPS", "fas": "FAS", "full analysis set": "FAS", "mitt": "mITT", "modified itt": "mITT", "modified intention-to-treat": "mITT", "modified intention to treat": "mITT"}
#: What relations between arms are called.
RELATIONS = {"between": "BETWEEN_GROUP", "between-group": "BETWEEN_GROUP", "vs": "BETWEEN_GROUP", "within": "WITHIN_GROUP", "within-group": "WITHIN_GROUP", "change": "WITHIN_GROUP"}


def vocabulary(c: Column, names: dict[str, str], default: str | None = None) -> Column:
    """The code of a name, white space and case aside."""
    k, out = F.lower(collapse(c)), F.lit(default)
    for name, code in names.items():
        out = F.when(k == name, code).otherwise(out)
    return out


def header_score(cell: Column, is_th: Column) -> Column:
    """How much a row's text looks like a header: its tag, its terms, strong ones, and that no number is in it."""
    text = F.lower(collapse(cell))
    points = F.when(is_th, 3).otherwise(0)
    for pattern in HEADER_TERMS:
        points = points + text.rlike(pattern).cast("int")
    points = points + F.when(text.rlike(STRONG_TERMS), 2).otherwise(0) + F.when(text.rlike("[0-9]"), 0).otherwise(1)
    return F.when(text == "", 0).otherwise(points)


def statistic(header: Column, default: str = "other") -> Column:
    """The statistic that a header names; the first rule that fits."""
    out = F.lit(default)
    for pattern, code in reversed(STATISTICS):
        out = F.when(F.lower(header).rlike(pattern), code).otherwise(out)
    return out


def number_shape(c: Column) -> Column:
    """A cell with its numbers as ``#``."""
    return collapse(F.regexp_replace(c, NUMBER, "#"))


def row_kind(cells: Column, count_label: Column, mean_header: Column) -> Column:
    """mean if all cells are pairs and the header says so, event_count if all are n (%) and the label counts; else null."""
    shapes = F.transform(cells, number_shape)
    paired = F.forall(shapes, lambda s: s.rlike(r"^# ?(\(#\)|± ?#)$"))
    counted = F.forall(shapes, lambda s: s.rlike(r"^# ?\(# ?%\)$"))
    return F.when(F.size(cells) == 0, None).when(paired & mean_header, "mean").when(counted & count_label, "event_count")


def grade(c: Column, rules: Iterable[tuple[str, str]], otherwise: str = "NR") -> Column:
    """The code of the first pattern that the text has."""
    out = F.lit(otherwise)
    for pattern, code in reversed(list(rules)):
        out = F.when(F.lower(c).rlike(pattern), code).otherwise(out)
    return out


#: Kinds of control by their description; the first that occurs counts.
CONTROLS = (
    ("non-penetrating|without insertion", "non_invasive_sham"), ("sham|superficial|non-acupoint", "invasive_sham"), ("usual|standard", "usual_care"), ("wait", "waiting_list"), ("placebo", "placebo"),
)


def control_kind(c: Column) -> Column:
    return grade(c, CONTROLS)


def arm_sizes(total: Column) -> tuple[Column, Column]:
    """Halves of an even total; null for odd ones."""
    half = F.when(total % 2 == 0, (total / 2).cast("long"))
    return half, half


def weekly_duration(sessions: Column, per_week: Column, weeks: Column) -> Column:
    """Weeks as told, else sessions over their weekly frequency."""
    return F.coalesce(weeks, F.try_divide(sessions, per_week))


def verbatim(quote: Column, text: Column) -> Column:
    """Whether a quote stands in a text, white space aside, case kept."""
    return F.contains(collapse(text), collapse(quote))


def observation(c: Column, kind: str = "double") -> Column:
    """struct(status, value): not applicable, not reported, present, or a review for what does not convert."""
    low = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    value = c.try_cast(kind)
    status = F.when(low.isin("NA", "N/A", "NOT APPLICABLE"), "NOT_APPLICABLE").when(low.isin("", "NR", "NONE"), "NOT_REPORTED").when(value.isNotNull(), "PRESENT").otherwise("REVIEW_REQUIRED")
    return F.struct(status.alias("status"), F.when(status == "PRESENT", value).alias("value"))


def singleton(c: Column) -> Column:
    """The element of a JSON array of one; null if there are more or none; other texts as they are."""
    values = F.from_json(c, "array<string>")
    return F.when(F.ltrim(c).startswith("["), F.when(F.size(values) == 1, F.get(values, 0))).otherwise(c)


def balanced_json(c: Column) -> Column:
    """The first object or array in a text whose brackets balance, if it parses; null without one.

    Brackets within strings do not count, nor do quotation marks behind a backslash.
    """
    whole, yes = lambda n: F.lit(n).cast("int"), F.lit(True)
    state = lambda **parts: F.struct(*[x.alias(name) for name, x in parts.items()])

    def step(a: Column, ch: Column) -> Column:
        at = a["at"] + 1
        opens = ~a["quoted"] & ch.isin("{", "[")
        closes = ~a["quoted"] & ch.isin("}", "]") & (a["depth"] > 0)
        depth = a["depth"] + opens.cast("int") - closes.cast("int")
        mark = (ch == '"') & ~a["escaped"] & (depth > 0)
        moved = state(
            at=at, depth=depth, quoted=F.when(mark, ~a["quoted"]).otherwise(a["quoted"]), escaped=a["quoted"] & ~a["escaped"] & (ch == "\\"),
            start=F.when((a["start"] == 0) & opens, at).otherwise(a["start"]), stop=F.when(closes & (depth == 0), at).otherwise(whole(0)),
        )
        return F.when(a["stop"] > 0, a).otherwise(moved)

    start = state(at=whole(0), depth=whole(0), quoted=~yes, escaped=~yes, start=whole(0), stop=whole(0))
    ends = F.aggregate(F.split(c, ""), start, step, lambda a: F.when(a["stop"] > 0, F.struct(a["start"], a["stop"])))
    found = F.transform(F.array(ends), lambda e: F.substring(c, e["start"], e["stop"] - e["start"] + 1))
    return F.get(F.transform(found, lambda x: F.when(F.try_parse_json(x).isNotNull(), x)), 0)


def suffix_number(c: Column) -> Column:
    """The number at the end of an id, leading zeros aside."""
    return blank_to_null(F.regexp_extract(c, r"0*([0-9]+)$", 1)).try_cast("int")
