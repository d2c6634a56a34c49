"""Scalars against the cases that the reference's contracts name."""

import sys
import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenweave.functions import ids, numbers, text


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [
    ("P<0.001", ("<", 0.001, "<0.001")), ("P = 0.107", ("=", 0.107, "0.107")), ("p ≤ 0.050", ("<=", 0.05, "<=0.05")), ("P=1e-3", ("=", 0.001, "0.001")), ("0.2", ("=", 0.2, "0.2")),
    ("[0.2, 0.3]", None), ("p=2", None), ("nan", None), ("-0.3", None), ("P<0.001; P=0.1", None), ("95% CI (0.1, 0.3)", None), ("P1", None), (None, None),
])
def test_p_value(spark, raw, want):
    got = value(spark, numbers.p_value(F.lit(raw).cast("string")))
    assert (tuple(got) if got else None) == want


EXACT = [("1 month", "1st month"), ("1 month", "first month"), ("1 month", "month 1"), ("3 months", "3rd month"), ("3 months", "3d month"), ("7 weeks", "7th week")]


@pytest.mark.parametrize("a, b, want", [
    *[(*p, "EXACT") for p in EXACT], ("3 months", "3 months after surgery", "COMPATIBLE"), ("baseline", "before treatment", "COMPATIBLE"), ("baseline", "1 month", "CONTRADICTORY"),
    ("1 month", "4 weeks", "CONTRADICTORY"), ("3 months after randomization", "3 months after treatment", "CONTRADICTORY"), ("early visit", "1 month", "UNKNOWN"), ("3 months before surgery", "3 months", "UNKNOWN"), (None, "1 month", "UNKNOWN"),
])
def test_timepoints(spark, a, b, want):
    t = lambda x: numbers.timepoint(F.lit(x).cast("string"))
    assert value(spark, numbers.compare_timepoints(t(a), t(b))) == want


@pytest.mark.parametrize("f, raw, want", [
    (text.key, "  Acupunct   Med ", "acupunct med"), (text.key, " n/A ", None), (text.key, None, None), (text.clean_not_reported, "null", None), (text.clean_not_reported, "0", "0"),
    (text.grammatical_key, "Frequency of CIC", "cic frequency"), (text.grammatical_key, "number of falls", "falls"), (text.grouping_key, "Pain-Score (VAS)/10", "pain score vas 10"), (text.grouping_key, "--", "nr"),
    (text.word_key, " A_b--C! ", "a b c"), (text.caption_id, "see Table 2. Outcomes", "table-2"), (text.caption_id, "Figure 2", None), (text.strip_part, "row-1#part-12 ", "row-1#part-12"), (text.strip_part, "row-1#part-12", "row-1"),
    (text.study_id, "/x/2015-06 trial.pdf", "2015-06"), (text.study_id, "/x/20156.pdf", "2015-06"), (text.study_id, "/x/other.v2.pdf", "other.v2"), (text.analysis_set, "the itt set", "ITT"), (text.analysis_set, None, "NR"),
    (text.clean_cell, "<b>a&nbsp;&lt; b</b> −1", "a < b -1"), (numbers.first_number, "about -1.5 or 2", -1.5), (numbers.first_number, "NR", None), (numbers.non_negative_int, "12.9 kg", 12), (numbers.non_negative_int, "-3", None),
    (text.nfkc_casefold, " ﬁﬁ  Straße ", "fifi strasse"),
])
def test_scalars(spark, f, raw, want):
    assert value(spark, f(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("f, raw, want", [
    (numbers.mean_sd, "1.8 (0.7)", (1.8, 0.7)), (numbers.mean_sd, "1.8±.7", None), (numbers.mean_sd, "12 ± 3", (12.0, 3.0)), (numbers.mean_sd, "12", None), (numbers.interval, "0.1 to 0.3", (0.1, 0.3)), (numbers.interval, "1–2", (1.0, 2.0)),
    (numbers.strict_number, " < 5.0 ", ("<", 5.0)), (numbers.strict_number, "5 kg", None), (text.unwrap_statistic, "Number of falls", ("falls", "number")), (text.unwrap_statistic, "falls", ("falls", None)),
])
def test_struct_scalars(spark, f, raw, want):
    got = value(spark, f(F.lit(raw)))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("f, raw, want", [
    (text.tokens, "A bc, bC 1 22", ["bc", "bc", "22"]), (text.contrast_sides, "A vs. B  c", ["A", "B c"]), (text.contrast_sides, "A vs B vs C", None), (text.contrast_sides, "A vs  ", None), (text.pipe_cells, r"| a | b\|c |", ["a", "b|c"]),
    (text.html_cells, "<tr><th>A</th><td class='x'>1 <b>2</b></td></tr>", ["A", "1 2"]), (text.dois, "see 10.1136/ABC.1, and 10.1136/abc.1.", ["10.1136/abc.1"]),
])
def test_array_scalars(spark, f, raw, want):
    assert value(spark, f(F.lit(raw))) == want


@pytest.mark.parametrize("a, b, relative, want", [(1.0, 1.0000001, 0.0, True), (1.0, 1.1, 0.0, False), (100.0, 101.0, 0.02, True), (float("inf"), 1.0, 0.0, None), (None, 1.0, 0.0, None)])
def test_within(spark, a, b, relative, want):
    assert value(spark, numbers.within(F.lit(a).cast("double"), F.lit(b), relative=relative)) is want


def test_canonical_json(spark):
    got = value(spark, ids.canonical_json(b=F.lit(1), a=F.lit('x"é'), c=F.lit(None).cast("int")))
    assert got == '{"a":"x\\"é","b":1,"c":null}'
    assert value(spark, ids.redact(F.lit("key=abcd abc"), ["abc", "abcd"])) == "key=[redacted] [redacted]"


def test_folding_holds_one_text_at_a_time():
    words = " ".join(f"Wörd{i}ﬁ" for i in range(2000))
    texts = pd.Series([f"{words} {i}" for i in range(200)] + [None])
    tracemalloc.start()
    got = text.nfkc_casefold.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[3] == f"{words} 3".lower().replace("ﬁ", "fi") and got[200] is None
    assert peak < 2.5 * sum(map(sys.getsizeof, texts))
