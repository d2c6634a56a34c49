"""Feature rows of studies, told from their text by rules: windows of evidence, codes, first captures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a window: half of it before the keyword, all of it from there on.
RADIUS = 220


@dataclass(frozen=True)
class Code:
    """A code where the source holds any of ``any`` and all of ``every``."""

    code: str
    any: tuple[str, ...] = ()
    every: tuple[str, ...] = ()


@dataclass(frozen=True)
class Feature:
    """The first code that fits the source (``text`` or a window), else ``otherwise``."""

    name: str
    codes: tuple[Code, ...]
    otherwise: str = "NR"
    source: str = "text"


#: Keywords of windows in order, and rules of method features.
WINDOWS = {
    "random_sequence_text": (
        "centralised telephone", "centralized telephone", "fax randomisation service", "randomisation service", "randomization service", "random allocation sequence", "computer-generated", "random number table", "randomly assigned",
    ),
    "allocation_concealment_text": ("independent clinical trials unit", "allocation was concealed", "allocation process", "opaque sealed envelopes", "sealed opaque envelopes", "concealed"),
}
METHODS = (
    Feature("random_sequence_code", (Code("central_service", ("centralised", "centralized", "telephone", "fax", "service")), Code("computer", ("computer", "sas", "random allocation sequence")), Code("random_number_table", ("random number",))), source="random_sequence_text"),
    Feature("allocation_concealment_code", (Code("central_service", ("central", "independent clinical trials unit", "concealed")), Code("sealed_opaque_envelope", every=("opaque", "sealed"))), source="allocation_concealment_text"),
    Feature("participant_blinding_code", (Code("yes", ("blinded to participants", "participants were blinded")),), "unclear"),
    Feature("outcome_assessor_blinding_code", (Code("yes", every=("outcome assessor", "blind")),), "unclear"),
    Feature("statistician_blinding_code", (Code("yes", every=("data analyst", "blind")),), "unclear"),
    Feature("sample_size_calculation", (Code("reported", ("sample size",)),)),
    Feature("primary_analysis_set", (Code("intention_to_treat", ("intention-to-treat",)),)),
    Feature("missing_data_method", (Code("LOCF", ("last observation", "locf")), Code("mixed_model", ("mixed model", "mmrm")))),
    Feature("protocol_registration", (Code("reported", ("trial registration",)),)),
    Feature("ethics_approval", (Code("reported", ("ethics",)),)),
    Feature("consent_reported", (Code("reported", ("informed consent",)),)),
)
METHOD_CAPTURES = {"target_sample_size": (r"(?i)sample size[^.]{0,80}?(\d{2,4})",)}
#: Rules of metadata features, and patterns of captures in order.
METADATA = (
    Feature("study_design", (Code("randomized controlled trial", ("randomised controlled", "randomized controlled")), Code("randomized trial", ("randomized", "randomised")))),
    Feature("setting", (Code("primary care", ("primary care",)), Code("hospital", ("hospital",)))),
    Feature("acute_or_chronic", (Code("chronic", ("chronic", "fibromyalgia", "chronic fatigue")), Code("acute", ("acute",)))),
    Feature("surgical_or_procedural", (Code("procedural", ("surgery", "procedure", "abortion")),), "non_surgical"),
    Feature("conflict_of_interest", (Code("none_declared", ("competing interests none declared", "conflict of interest none", "no competing interests", "no conflicts of interest")), Code("reported", ("competing interests", "conflict of interest")))),
)
METADATA_CAPTURES = {
    "funding": (r"(?i)funded by\s+([^.;]{3,220})", r"(?i)supported by\s+([^.;]{3,220})", r"(?i)grant(?:s)? from\s+([^.;]{3,220})"),
    "recruitment_start": (r"(?i)(?:recruited|recruitment)[^.;]{0,80}?from\s+([A-Za-z]+\s+\d{4})",),
    "recruitment_end": (r"(?i)(?:recruited|recruitment)[^.;]{0,120}?to\s+([A-Za-z]+\s+\d{4})",),
    "center_count": (r"(?i)Conducted in (\w+) primary care centres", r"(?i)conducted in (\d+)\s+(?:centres|centers|hospitals|sites)"),
}
#: Regexes of countries in the order in which a text is searched.
COUNTRY = r"\b(China|Korea|Spain|United States|USA|Germany|Australia|Turkey|Iran|Brazil|Japan|Taiwan|Hong Kong)\b"


def window(text: Column, words: tuple[str, ...]) -> Column:
    """The text around the first of ``words`` that occurs, by their order, ending in one full stop; NR without any."""
    low = F.lower(text)
    at = F.coalesce(*[F.when(F.instr(low, w) > 0, F.instr(low, w)) for w in words])
    start = F.greatest(at - RADIUS // 2, F.lit(1))
    piece = F.regexp_replace(F.substring(text, start, at + RADIUS - start), r"\s+", " ")
    return F.when(at.isNotNull(), F.concat(F.regexp_replace(piece, r"^[ .]+|[ .]+$", ""), F.lit("."))).otherwise("NR")


def coded(feature: Feature, source: Column) -> Column:
    """The feature's code by a source in lower case."""
    out = F.lit(feature.otherwise)
    for c in reversed(feature.codes):
        fits = F.lit(True)
        for w in c.every:
            fits = fits & F.contains(source, F.lit(w))
        if c.any:
            some = F.lit(False)
            for w in c.any:
                some = some | F.contains(source, F.lit(w))
            fits = fits & some
        out = F.when(fits, c.code).otherwise(out)
    return out


def captured(text: Column, patterns: tuple[str, ...], otherwise: str = "NR") -> Column:
    """The first group of the first pattern that matches, its ends trimmed."""
    found = [F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns]
    return F.coalesce(*found, F.lit(otherwise))


def method_features(text: Column) -> dict[str, Column]:
    """Columns of a study's methods; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    windows = {n: window(text, words) for n, words in WINDOWS.items()}
    low = {"text": F.lower(text)} | {n: F.lower(w) for n, w in windows.items()}
    return windows | {f.name: coded(f, low[f.source]) for f in METHODS} | {n: captured(text, p) for n, p in METHOD_CAPTURES.items()}


def metadata_features(text: Column) -> dict[str, Column]:
    """Columns of a study's metadata; the count of centres as a number where it is written as three."""
    text = F.coalesce(text, F.lit(""))
    found = {f.name: coded(f, F.lower(text)) for f in METADATA} | {n: captured(text, p) for n, p in METADATA_CAPTURES.items()}
    found["center_count"] = F.when(F.lower(found["center_count"]) == "three", "3").otherwise(found["center_count"])
    return found | {"country": captured(text, (COUNTRY,))}
