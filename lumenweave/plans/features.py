"""Queries over feature rows of studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.functions import features

from .registry import query

#: Sentences that documents get, two each by their number; their own text comes first.
SAID = (
    "A centralised telephone service was used in this randomised controlled trial.", "The list was computer-generated and participants were blinded.", "Opaque sealed envelopes were kept; every outcome assessor was blind.",
    "The allocation was concealed. The sample size was set at 240 patients.", "Ethics committees agreed and informed consent was given in Germany.", "By intention-to-treat; missing values by LOCF. Trial registration: N1.",
    "Funded by the Fund for Care; no competing interests.", "Patients were recruited from May 2010 to June 2012 in a hospital.", "Conducted in three primary care centres, supported by a grant. Chronic pain.", "A mixed model was fitted by a blinded data analyst after surgery.",
)


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _code_sql(feature, source: str) -> str:
    cases = ""
    for c in feature.codes:
        tests = [f"contains({source}, {_quoted(w)})" for w in c.every] + (["(" + " OR ".join(f"contains({source}, {_quoted(w)})" for w in c.any) + ")"] if c.any else [])
        cases += f" WHEN {' AND '.join(tests)} THEN {_quoted(c.code)}"
    return f"CASE{cases} ELSE {_quoted(feature.otherwise)} END AS {feature.name}"


def _window_sql(name: str, words) -> str:
    at = "coalesce(" + ", ".join(f"nullif(strpos(low, {_quoted(w)}), 0)" for w in words) + ")"
    piece = f"regexp_replace(substr(x, greatest({at} - 110, 1), {at} + 220 - greatest({at} - 110, 1)), '\\s+', ' ', 'g')"
    return f"CASE WHEN {at} IS NULL THEN 'NR' ELSE regexp_replace({piece}, '^[ .]+|[ .]+$', '', 'g') || '.' END AS {name}"


def _capture_sql(name: str, patterns) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(x, {_quoted(p)}, 1)), '')" for p in patterns) + f", 'NR') AS {name}"


TEXTS = f"d AS (SELECT doc_id, coalesce(text, '') || ' ' || {list(SAID)}[(doc_id % 10 + 1)::INT] || ' ' || {list(SAID)}[(doc_id // 10 % 10 + 1)::INT] AS x FROM documents), l AS (SELECT *, lower(x) AS low FROM d)"


def _texts(t):
    said = lambda n: F.get(F.array(*map(F.lit, SAID)), n.cast("int"))
    ten = F.floor(F.col("doc_id") / 10) % 10
    return t.documents.select("doc_id", F.concat_ws(" ", F.coalesce("text", F.lit("")), said(F.col("doc_id") % 10), said(ten)).alias("x"))


METHODS_SQL = f"""WITH {TEXTS}, w AS (SELECT doc_id, x, low, {', '.join(_window_sql(n, words) for n, words in features.WINDOWS.items())} FROM l)
SELECT doc_id, md5(random_sequence_text) AS random_sequence_text, md5(allocation_concealment_text) AS allocation_concealment_text, {', '.join(_code_sql(f, 'low' if f.source == 'text' else f'lower({f.source})') for f in features.METHODS)}, {', '.join(_capture_sql(n, p) for n, p in features.METHOD_CAPTURES.items())} FROM w"""


@query("st59_method_features", METHODS_SQL)
def method_features(t):
    """Methods of documents that got two sentences each: windows by digest, codes and the target sample size."""
    found = features.method_features(F.col("x"))
    hashed = lambda n, c: F.md5(c) if n in features.WINDOWS else c
    return _texts(t).select("doc_id", *[hashed(n, c).alias(n) for n, c in found.items()])


METADATA_SQL = f"""WITH {TEXTS}, f AS (SELECT doc_id, {', '.join(_code_sql(f, 'low') for f in features.METADATA)}, {', '.join(_capture_sql(n, p) for n, p in features.METADATA_CAPTURES.items())}, {_capture_sql('country', (features.COUNTRY,))} FROM l)
SELECT * REPLACE (CASE WHEN lower(center_count) = 'three' THEN '3' ELSE center_count END AS center_count) FROM f"""


@query("st61_st65_metadata_features", METADATA_SQL)
def metadata_features(t):
    """Design, setting, funding, recruitment, centres and country of the same documents."""
    return _texts(t).select("doc_id", *[c.alias(n) for n, c in features.metadata_features(F.col("x")).items()])
