"""What an extractor answers, as JSON text, folded into typed columns; malformed parts become null, never an error."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import interval_of
from .text import strip

#: Categories of tables, and other names for them.
TABLE_CATEGORIES = ("outcome", "safety", "subgroup", "sensitivity", "baseline", "flow", "other", "unknown")
CATEGORY_NAMES = {
    "clinical_outcome": "outcome", "clinical_outcomes": "outcome", "results": "outcome", "endpoint": "outcome", "adverse_event": "safety", "adverse_events": "safety",
    "participant_characteristics": "baseline", "baseline_characteristics": "baseline", "participant_flow": "flow", "consort_flow": "flow", "administrative": "other",
}
#: Roles of arms, and other names for them.
ROLES = ("intervention", "control", "comparator", "other", "NR")
ROLE_NAMES = {"treatment": "intervention", "treatment_group": "intervention", "experimental": "intervention", "reference": "control", "control_group": "control", "comparator_group": "comparator"}
#: States of a record's annotation, and other names for them.
ANNOTATIONS = ("none", "conflict", "unresolved", "not_checked")
ANNOTATION_NAMES = {"gold_conflict": "conflict", "no_conflict": "none", "unknown": "unresolved"}
#: Names under which an answer may hold a field, the first that is there counting.
CATEGORY_FIELDS, RATIONALE_FIELDS, NESTED_FIELDS = ("table_category", "category", "table_type"), ("rationale", "reason", "explanation"), ("table_classification", "classification")
ARM_TEXTS = {"arm_id": ("arm_id", "id"), "arm_label": ("arm_label", "label", "name")}
ARM_NUMBERS = {
    "n": ("n", "sample_size"), "value": ("value",), "sd": ("sd", "standard_deviation"), "change": ("change",), "estimate": ("estimate", "value", "change"),
    "lower": ("lower", "ci_lower"), "upper": ("upper", "ci_upper"), "event_count": ("event_count", "events"),
}
COUNTS = ("n", "event_count")
RECORD_FIELDS = {
    "normalized_outcome_name": ("normalized_outcome_name", "normalizedOutcomeName", "outcome_name"),
    "normalized_measurement_instrument": ("normalized_measurement_instrument", "normalizedMeasurementInstrument", "measurement_instrument", "instrument"),
    "normalized_timepoint": ("normalized_timepoint", "normalizedTimepoint", "timepoint"),
    "comparison_relation": ("comparison_relation", "comparisonRelation", "comparison"),
}
STATUS_FIELDS = ("annotation_status", "annotationStatus", "conflict_status", "conflictStatus", "status")


def _fold(c: Column, allowed: tuple[str, ...], names: dict[str, str], other: str, key: Column | None = None) -> Column:
    """A name's code where it is allowed; other names are looked up by ``key``."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    found = F.coalesce(F.element_at(known, c if key is None else key), c)
    return F.when(found.isin(*allowed), found).otherwise(other)


def _told(raw: Column, fields: tuple[str, ...], blank: bool = False) -> Column:
    """The first of some fields that is there; ``blank``: empty text, zero and false are passed over too."""
    each = [F.get_json_object(raw, f"$.{f}") for f in fields]
    return F.coalesce(*[F.when(~x.isin("", "0", "0.0", "false", "[]", "{}"), x) if blank else x for x in each])


def table_category(raw: Column) -> Column:
    """struct(category, confidence, rationale) of a classifier's JSON answer, as it stands or nested one level.

    What is no object has the category unknown; a confidence outside 0 to 1 is null.
    """
    inner = F.coalesce(*[F.when(F.ltrim(x).startswith("{"), x) for x in (F.get_json_object(raw, f"$.{f}") for f in NESTED_FIELDS)], raw)
    name = F.translate(F.lower(strip(_told(inner, CATEGORY_FIELDS, blank=True))), "- ", "__")
    sure = F.get_json_object(inner, "$.confidence").try_cast("double")
    reason = strip(_told(inner, RATIONALE_FIELDS, blank=True))
    return F.struct(
        _fold(F.coalesce(name, F.lit("unknown")), TABLE_CATEGORIES, CATEGORY_NAMES, "unknown").alias("category"),
        F.when(sure.between(0, 1), sure).alias("confidence"),
        F.when(reason != "", reason).otherwise("NR").alias("rationale"),
    )


def _arm(item: Column) -> Column:
    """One arm: an object with its fields, or a text that is its label."""
    is_object = F.ltrim(item).startswith("{")
    field = lambda names, blank=False: F.when(is_object, _told(item, names, blank))
    number = lambda name: field(ARM_NUMBERS[name]).try_cast("double")
    role = F.coalesce(strip(field(("role", "arm_role"), blank=True)), F.lit("NR"))
    told = interval_of(F.when(is_object, F.get_json_object(item, "$.confidence_interval")))
    bare = field(("lower", "ci_lower")).isNull() & field(("upper", "ci_upper")).isNull()
    label = F.when(is_object, field(ARM_TEXTS["arm_label"], blank=True)).when(strip(item) != "", strip(item))
    out = [F.coalesce(field(ARM_TEXTS["arm_id"], blank=True), F.lit("NR")).alias("arm_id"), F.coalesce(label, F.lit("NR")).alias("arm_label"), _fold(role, ROLES, ROLE_NAMES, "other", F.lower(role)).alias("role")]
    for name in ARM_NUMBERS:
        x = number(name)
        if name in COUNTS:
            x = F.when(x >= 0, F.floor(x).cast("long"))
        elif name in ("lower", "upper"):
            x = F.when(bare, told[name]).otherwise(x)
        out.append(x.alias(name))
    return F.struct(*out)


def arms(raw: Column) -> Column:
    """Arms of an answer: a list of objects or labels, one object, or one label; null, blank and NR have none."""
    text = F.ltrim(raw)
    items = F.when(text.startswith("["), F.from_json(raw, "array<string>")).when(F.coalesce(strip(raw), F.lit("")).isin("", "NR"), F.array().cast("array<string>")).otherwise(F.array(raw))
    return F.transform(F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull()), _arm)


def annotation(status: Column) -> Column:
    """The state of a record's annotation; what is not known is unresolved."""
    return _fold(F.coalesce(status, F.lit("unresolved")), ANNOTATIONS, ANNOTATION_NAMES, "unresolved")


def _list(raw: Column) -> Column:
    """The texts of a JSON list, or of what stands alone, without blanks and nulls."""
    items = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw))
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def records(raw: Column) -> Column:
    """array<struct> of an answer's records: their index in the source, names (NR if blank), group, gold ids, status, fields in conflict, reason.

    They stand under ``records``, else ``outcomes``; what is no list has none, and
    a record without a whole number as its index is left out.  A null counts as
    a field that is not there.
    """
    held = _told(raw, ("records", "outcomes"))
    items = F.when(F.ltrim(held).startswith("["), F.from_json(held, "array<string>"))
    index = lambda x: F.regexp_extract(F.coalesce(_told(x, ("source_index", "sourceIndex", "index")), F.lit("")), r"^\s*([-+]?[0-9]+)\s*$", 1).try_cast("int")
    kept = F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.ltrim(x).startswith("{") & index(x).isNotNull())
    named = lambda x, fields: F.coalesce(F.nullif(_told(x, fields), F.lit("")), F.lit("NR"))
    return F.transform(
        kept,
        lambda x: F.struct(
            index(x).alias("source_index"),
            *[named(x, fields).alias(n) for n, fields in RECORD_FIELDS.items()],
            F.nullif(_told(x, ("duplicate_group", "duplicateGroup")), F.lit("")).alias("duplicate_group"),
            _list(_told(x, ("gold_row_ids", "goldRowIds", "gold_ids"))).alias("gold_row_ids"),
            annotation(F.nullif(_told(x, STATUS_FIELDS), F.lit(""))).alias("annotation_status"),
            _list(_told(x, ("conflict_fields", "conflictFields"))).alias("conflict_fields"),
            F.coalesce(_told(x, ("conflict_reason", "conflictReason", "reason")), F.lit("")).alias("conflict_reason"),
        ),
    )


def lower_support(raw: pd.Series) -> pd.Series:
    """JSON texts in which every object with a field id and a quote, at any depth, has its source and support type in lower case.

    Answers nest to any depth, for which no built-in has an expression; null and what is no JSON stay as they are.
    """

    def fold(text):
        try:
            top = json.loads(text)
        except (TypeError, ValueError):
            return text
        pending = [top]
        while pending:
            x = pending.pop()
            if isinstance(x, dict):
                if "field_id" in x and "quote" in x:
                    x.update({k: x[k].lower() for k in ("source", "support_type") if isinstance(x.get(k), str)})
                pending.extend(x.values())
            elif isinstance(x, list):
                pending.extend(x)
        return json.dumps(top, ensure_ascii=False, separators=(",", ":"))

    return raw.map(fold)
