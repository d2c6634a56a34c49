"""Codes and keys that texts carry: sections, priorities, modules, times, identities, formulas, intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import grade
from .numbers import NUMBER
from .text import blank_to_null, collapse, is_not_reported, strip

#: What titles contain, and the section they name.
TITLES = (
    ("abstract", "abstract"), ("method|participant|intervention|random|statistical", "methods"), ("result|finding", "results"),
    ("discussion", "discussion"), ("reference", "references"), ("funding|competing|contributor", "metadata"),
)
#: What page footers say.
FOOTERS = ("downloaded from", "group.bmj.com", "published by", "copyright", "all rights reserved", "for personal use only")
#: Path prefixes and the names of the modules they belong to.
MODULES = (("metadata", "基础信息"), ("acupuncture", "STRICTA针灸"), ("risk_of_bias", "偏倚风险"), ("outcomes", "统计结局"), ("consort_flow", "CONSORT流程"))
OTHER_MODULE = "整体"
#: Analysis sets as they are written, in the order in which they are listed.
ANALYSES = (
    (r"\bfull\s+analysis\s+set\b|\bfas\b", "FAS"), (r"\bper\s+protocol\b|\bpps\b", "PPS"), (r"\blocf\b|last\s+observation\s+carried\s+forward", "LOCF"),
    (r"\bmmrm\b|mixed\s+model\s+for\s+repeated\s+measures", "MMRM"), (r"\bintention[- ]to[- ]treat\b|\bitt\b", "ITT"), (r"\bavailable[- ]case\b", "available_case"),
)
#: Roles of records by their table's category.
ROLES = {"outcome": "secondary", "safety": "safety", "subgroup": "subgroup", "sensitivity": "sensitivity", "baseline": "baseline", "flow": "administrative"}
#: Times in headers, the first that occurs counts.
HEADER_TIMES = (
    r"\bbefore\s+treatment\b", r"\b[0-9]+(?:\.[0-9]+)?\s*(?:days?|weeks?|months?|years?|hours?)\s*(?:after|post)?\s*treatment?\b",
    r"\bat\s+baseline\b", r"\bbaseline\b", r"\bfollow[- ]?up\b", r"\bend\s+of\s+(?:treatment|study)\b",
    r"\b[0-9]+(?:\.[0-9]+)?\s*(?:days?|weeks?|months?|years?|hours?)\b", r"\bafter\s+treatment\b", r"\bT[0-9]+\b", r"\bpost[- ]?treatment\b",
)
#: Words of arms in headers, and names of statistics, which are no arms.
ARM_WORDS = ("group", "arm", "acupuncture", "sham", "control", "placebo", "intervention", "treatment")
STATISTIC_WORDS = ("mean", "sd", "se", "p-value", "p value", "confidence", "ci", "md", "smd", "or", "rr", "rd", "hr")
#: Number words of counts.
COUNT_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
#: What formulas look like.
FORMULAS = (
    r"\\(?:frac|sqrt|sum|int|prod|alpha|beta|gamma|theta|times|leq|geq|begin|end)", r"\$(?:[^$\n]{2,})\$|\\\((?:[^\n]{2,})\\\)",
    r"[∑∫√≤≥±×÷≈∞]", r"(?i)\b(?:equation|eq\.?|formula)\s*\(?[0-9]*[A-Za-z]?\)?",
)
#: Statistics, times and units within names of outcomes.
NAME_STATISTIC = r"(?i)\b(mean|median|standard deviation|sd|change from baseline|change|proportion|percentage|rate|event count)\b"
NAME_TIME = r"(?i)\b(?:at|after)\s+[0-9]+(?:\.[0-9]+)?\s+(?:week|weeks|month|months|day|days)\b|\b(?:week|weeks|month|months|day|days|follow[- ]up|baseline|T[0-9])\s*(?:[0-9]+(?:\.[0-9]+)?)?\b"
NAME_UNIT = r"(?i)\(([^()]*\b(?:mm|ml|kg|cm|%|times/day|days?)\b[^()]*)\)"
#: A statement that continuous data are means and standard deviations; headers that say so; what rules it out.
REPORTING = r"(?i)\b(?:quantitative|continuous)\s+data\s+(?:were|are)\s+(?:expressed|presented|reported|summari[sz]ed)\s+as\s+(?:the\s+)?mean\s*(?:±|and|\+/-)\s*(?:standard deviation|SD)\b"
MEAN_HEADER = r"(?i)\bmean\s*(?:±|\+/-|\(|and)\s*(?:sd\b|standard deviation\b)"
NO_MEAN = r"(?i)\bmedian\b|\bIQR\b|\bSE\b|\bstandard error\b|\bn\s*\(\s*%\s*\)"


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """A pattern's first group where it first matches, stripped; null where it does not."""
    return F.when(F.rlike(c, F.lit(pattern)), strip(F.regexp_extract(c, pattern, group)))


def title_section(title: Column) -> Column:
    return grade(F.coalesce(title, F.lit("")), TITLES, "unknown")


def comparison_code(intervention: Column, control: Column) -> Column:
    """A sham, B sham beside usual care, C usual care on both sides, D no treatment, E anything else."""
    i, c = F.lower(intervention), F.lower(control)
    sham, both = c.rlike("sham|placebo"), i.contains("usual") & c.contains("usual")
    return F.when(both, F.when(sham, "B").otherwise("C")).when(sham, "A").when(c.rlike("wait|no treatment"), "D").otherwise("E")


def has_footer(c: Column) -> Column:
    return F.lower(c).rlike("|".join(x.replace(".", r"\.") for x in FOOTERS))


def module_of(path: Column) -> Column:
    out = F.lit(OTHER_MODULE)
    for prefix, name in reversed(MODULES):
        out = F.when(path.startswith(prefix), name).otherwise(out)
    return out


def coverage_table_key(c: Column) -> Column:
    """What a retry shares with the request it repeats: no part suffix, narrative range or padding of numbers."""
    text = F.lower(strip(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?s)#part-.*$", "")))
    number = blank_to_null(F.regexp_extract(text, r"table[-_ ]*0*([0-9]+)", 1))
    return F.when(text.startswith("narrative-results"), "narrative-results").when(number.isNotNull(), F.concat(F.lit("table-"), number)).otherwise(text)


def analysis_labels(context: Column) -> Column:
    """All analysis sets that a text names, in a fixed order, joined by slashes; NR for none."""
    low = F.lower(context)
    found = F.array_compact(F.array(*[F.when(low.rlike(pattern), F.lit(name)) for pattern, name in ANALYSES]))
    return F.when(F.size(found) > 0, F.array_join(found, "/")).otherwise("NR")


def record_role(context: Column) -> Column:
    """Primary where the word occurs, else by the table's category, else NR."""
    category = F.lower(strip(F.regexp_extract(context, r"(?im)^TABLE_CATEGORY:\s*([^\n]+)", 1)))
    out = F.lit("NR")
    for name, role in ROLES.items():
        out = F.when(category == name, role).otherwise(out)
    return F.when(context.rlike(r"(?i)\bprimary\b"), "primary").otherwise(out)


def header_time(c: Column) -> Column:
    text = collapse(c)
    return F.coalesce(*[F.when(text.rlike(f"(?i){p}"), F.regexp_extract(text, f"(?i){p}", 0)) for p in HEADER_TIMES], F.lit("NR"))


def header_arm(texts: Column) -> Column:
    """The first of several header texts that names an arm and is no statistic; NR for none."""
    named = F.filter(texts, lambda x: F.lower(x).rlike("|".join(ARM_WORDS)) & ~F.lower(F.trim(x)).isin(*STATISTIC_WORDS))
    return F.coalesce(blank_to_null(collapse(F.get(named, 0))), F.lit("NR"))


def row_cells(quote: Column) -> Column:
    """The cells of a row's quote, in order: tags and bars end cells, row and cell marks and blank cells go."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(quote, F.lit("")), r"(?i)\[/?(?:ROW|CELL)\s*[^\]]*\]", ""), r"(?i)</?(?:td|th|tr)[^>]*>", "|")
    return F.filter(F.transform(F.split(bare, r"\|"), collapse), lambda x: x != "")


def reports_count(count: Column, raw: Column) -> Column:
    """Whether a raw text has just this number: number words count, spaces within digits do not, and 8 is not in 88 or 8.8."""
    text = F.lower(raw)
    for number, word in reversed(list(enumerate(COUNT_WORDS))):
        text = F.regexp_replace(text, rf"\b{word}\b", str(number))
    return F.rlike(F.regexp_replace(text, r"\s+", ""), F.concat(F.lit(r"(?<![\d.])"), count.cast("string"), F.lit(r"(?![\d.])")))


def status_key(status: Column, value: Column) -> Column:
    """struct(status, value): the value, normalized, where present; else the kind of missingness alone."""
    return F.struct(status.alias("status"), F.when(status == "PRESENT", F.lower(collapse(value.cast("string")))).alias("value"))


def time_key(status: Column, text: Column, number: Column, unit: Column) -> Column:
    """``status_key`` of the time's text; where only number and unit are known, those."""
    counted = F.struct(F.lit("PRESENT").alias("status"), F.concat_ws(" ", number.cast("string"), F.lower(collapse(unit))).alias("value"))
    return F.when((status != "PRESENT") & number.isNotNull() & unit.isNotNull(), counted).otherwise(status_key(status, text))


def split_name(name: Column, statistic: Column, time: Column, unit: Column) -> Column:
    """struct(statistic, time, unit, name): what an outcome's name says of them where they are not given, and the name without."""
    s = F.when(statistic.isNull(), first_match(name, NAME_STATISTIC, 0))
    t = F.when(is_not_reported(time), first_match(name, NAME_TIME, 0))
    u = F.when(is_not_reported(unit), first_match(name, NAME_UNIT, 1))
    left = name
    for found, drop in ((s, s), (t, t), (u, F.concat(F.lit("("), u, F.lit(")")))):
        left = F.when(found.isNull(), left).otherwise(F.replace(left, drop, F.lit("")))
    left = F.regexp_replace(F.regexp_replace(left, r"\s{2,}", " "), r"^[ \-,:;()]+|[ \-,:;()]+$", "")
    return F.struct(s.alias("statistic"), t.alias("time"), u.alias("unit"), F.when(F.length(left) >= 3, left).otherwise(name).alias("name"))


def formulas(c: Column) -> Column:
    """array<struct<raw, status>> of the formulas in a text, pattern by pattern; what is LaTeX already is parsed as it stands."""
    raw = F.filter(F.transform(F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in FORMULAS]), strip), lambda x: x != "")
    latex = lambda x: x.startswith("$") | x.contains("\\")
    return F.transform(raw, lambda x: F.struct(x.alias("raw"), F.when(latex(x), "parsed").otherwise("unavailable").alias("status")))


def interval_of(value: Column) -> Column:
    """struct(lower, upper) of an interval told as a JSON list, as an object, or in words."""
    text = F.coalesce(value, F.lit(""))
    number = lambda x: F.regexp_replace(F.regexp_replace(x, "[−–]", "-"), r"\s", "").try_cast("double")
    found = F.regexp_extract_all(text, F.lit(r"[-−–]?\s*[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    field = lambda *names: F.coalesce(*[number(F.get_json_object(text, f"$.{n}")) for n in names])
    is_object, enough = F.ltrim(text).startswith("{"), F.size(found) >= 2
    pick = lambda at, *names: F.when(is_object, field(*names)).when(enough, number(F.get(found, at)))
    return F.struct(pick(0, "lower", "l").alias("lower"), pick(1, "upper", "u").alias("upper"))


def primary_analysis(code: Column, context: Column) -> Column:
    """Code 1 (intention to treat) for an unreported 4, where the context reports the primary outcome so."""
    told = context.rlike(r"(?i)intention-to-treat\s+analysis\s+revealed") & context.rlike(r"(?i)primary\s+outcome")
    return F.when((code == 4) & told, F.lit(1)).otherwise(code)


def reporting_statements(c: Column) -> Column:
    """The sentences that say how continuous data are reported, distinct and sorted."""
    said = F.filter(F.split(c, r"(?<=[.!?])\s+|\n"), lambda x: x.rlike(REPORTING))
    return F.array_sort(F.array_distinct(F.transform(said, strip)))


def mean_of(cell: Column, header: Column, statements: Column, row_label: Column) -> Column:
    """struct(mean, sd, cue) of a cell that its header, or else a statement about the whole text, names a mean; null otherwise.

    A statement licenses only pairs with a plus-minus sign; medians, errors, ranges and shares are never means.
    """
    signed, bracketed = rf"^\s*({NUMBER})\s*(?:±|\+/-)\s*({NUMBER})\s*$", rf"^\s*({NUMBER})\s*\(\s*({NUMBER})\s*\)\s*$"
    part = lambda k: F.coalesce(first_match(cell, signed, k), first_match(cell, bracketed, k))
    allowed = ~F.concat_ws(" ", header, row_label).rlike(NO_MEAN) & ~cell.contains("%") & part(1).isNotNull()
    cue = F.when(header.rlike(MEAN_HEADER), header).when(cell.rlike(signed), F.get(statements, 0))
    return F.when(allowed & cue.isNotNull(), F.struct(part(1).alias("mean"), part(2).alias("sd"), cue.alias("cue")))


def arm_keys(arms: Column) -> Column:
    """Sorted keys of arms (arm_id, label, role): the id, or the label where there is none, and the role."""
    known = lambda x: F.when(is_not_reported(x), None).otherwise(F.lower(collapse(x)))
    one = lambda a: F.concat(F.coalesce(known(a["arm_id"]), known(a["label"]), F.lit("nr")), F.lit("/"), F.coalesce(known(a["role"]), F.lit("nr")))
    return F.array_sort(F.transform(arms, one))


def identity_of(name: Column, instrument: Column, time: Column, analysis: Column, role: Column, relation: Column, arms: Column) -> Column:
    """A record's seven-part identity as one text; what is not reported is the same in all records."""
    known = lambda x: F.coalesce(F.when(is_not_reported(x), None).otherwise(F.lower(collapse(x))), F.lit("nr"))
    return F.to_json(F.array(*[known(x) for x in (name, instrument, time, analysis, role, relation)], F.array_join(arm_keys(arms), "+")))


def matrix_html(rows: Column, header_rows: int = 1) -> Column:
    """An array of rows of cells as an HTML table, short rows padded."""
    width = F.array_max(F.transform(rows, F.size))
    padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    line = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(padded, lambda r, i: F.when(i < header_rows, line(r, "th")).otherwise(line(r, "td"))), ""), F.lit("</table>"))


def matrix_otsl(rows: Column) -> Column:
    """An array of rows of cells with ``C:`` before each cell, bars between cells and newlines between rows."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda x: F.concat(F.lit("C:"), x)), "|")), "\n")


def bibliography_header(doi: Column, year: Column, journal: Column, factor: Column, citations: Column, retracted: Column) -> Column:
    """One line of what is known of a publication, NR for what is not."""
    known = lambda x: F.coalesce(x.cast("string"), F.lit("NR"))
    gone = F.when(retracted, "yes").when(~retracted, "no").otherwise("NR")
    parts = {"DOI": known(doi), "YEAR": known(year), "JOURNAL": known(journal), "IMPACT_FACTOR": known(factor), "CITATION_COUNT": known(citations), "RETRACTED": gone}
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{name}="), x) for name, x in parts.items()])


def same_contrast(status: Column, candidates: Column) -> Column:
    """The contrast of a conflict whose candidates (value, evidence) all say the same ordered pair with evidence; else null."""
    from .text import contrast_sides, versus

    surface = F.array_distinct(F.transform(candidates, lambda x: versus(F.lower(collapse(x["value"])))))
    told = F.forall(candidates, lambda x: x["value"].isNotNull() & (F.size(x["evidence"]) > 0))
    return F.when((status == "SOURCE_CONFLICT") & (F.size(candidates) > 1) & told & (F.size(surface) == 1) & (F.size(contrast_sides(F.get(surface, 0))) == 2), F.get(surface, 0))


def self_hash_holds(content: Column, stated: Column) -> Column:
    """Whether an object's stated SHA-256 is that of the object without it."""
    return F.coalesce(F.sha2(content, 256) == stated, F.lit(False))


def valid_ids(ids: Column) -> Column:
    """Whether a list of ids has no null, empty or repeated one."""
    return F.coalesce(F.forall(ids, lambda x: x.isNotNull() & (x != "")) & (F.size(F.array_distinct(ids)) == F.size(ids)), F.lit(False))


def source_signal(value: Column, evidence: Column, candidates: Column, raw: Column) -> Column:
    """Whether a source says anything of a field: a value, evidence, candidates, or a raw text other than not reported."""
    silent = F.lower(strip(F.coalesce(raw, F.lit("")))).isin("", "nr", "n/r", "not reported", "unresolved")
    return value.isNotNull() | (F.size(evidence) > 0) | (F.size(candidates) > 0) | ~silent
