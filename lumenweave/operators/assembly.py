"""From extracted rows to a graph: arms, comparisons and outcomes, evidence, sets to compare, export; metadata from several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.text import collapse

from .binding import bind_sources, merge_entities


def related_records(arms: DataFrame, study: str) -> DataFrame:
    """(study, intervention, control): a study's comparison, by the arms' roles, else by their places.

    ``arms`` has study, place, name and role; a study of one arm has no control.
    """
    by_role = lambda role: F.min_by("name", F.when(F.col("role") == role, F.col("place")))
    has = lambda role: F.count_if(F.col("role") == role) > 0
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"])
    found = arms.groupBy(study).agg(F.when(has("intervention"), by_role("intervention")).alias("i"), F.when(has("control"), by_role("control")).alias("c"), in_order.alias("names"))
    return found.select(study, F.coalesce("i", F.get("names", 0)).alias("intervention"), F.coalesce("c", F.get("names", 1)).alias("control"))


def two_arms(studies: DataFrame, key: str, columns: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Two rows a study, role intervention and control, with each column's value for either."""
    arm = lambda role, k: F.struct(F.lit(role).alias("role"), *[pair[k].alias(name) for name, pair in columns.items()])
    return studies.select(key, F.explode(F.array(arm("intervention", 0), arm("control", 1))).alias("a")).select(key, "a.*")


def evidence_of(entities: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, place, evidence_id) of the evidence lists of some fields, in the order of the fields."""
    listed = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(f).alias("field"), F.col(f).alias("ids")) for i, f in enumerate(fields)])
    return entities.select(key, F.explode(listed).alias("f")).select(key, "f.field", "f.place", F.explode("f.ids").alias("evidence_id"))


def comparable_sets(parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(kind, item): distinct normalized keys of several kinds of entities, for comparing runs."""
    item = lambda columns: F.concat_ws("|", *[F.coalesce(F.lower(collapse(F.col(c).cast("string"))), F.lit("nr")) for c in columns])
    rows = [frame.select(F.lit(kind).alias("kind"), item(columns).alias("item")).distinct() for kind, (frame, columns) in parts.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def merged_metadata(rows: DataFrame, sources: dict[str, DataFrame], key: str, columns: list[str]) -> DataFrame:
    """``rows`` with columns from the first source, in order, that has them, and ``errors`` of all sources.

    Each source has key, the columns and error; a source that failed has an error and fills nothing.
    """
    out, errors = rows, []
    for name, frame in sources.items():
        out = out.join(frame.select(key, *[F.when(F.col("error").isNull(), F.col(c)).alias(f"_{name}_{c}") for c in columns], F.col("error").alias(f"_{name}_error")), key, "left")
        errors.append(F.when(F.col(f"_{name}_error").isNotNull(), F.concat(F.lit(f"{name}: "), F.col(f"_{name}_error"))))
    filled = [F.coalesce(*[F.col(f"_{name}_{c}") for name in sources]).alias(c) for c in columns]
    return out.select(*rows.columns, *filled, F.array_compact(F.array(*errors)).alias("errors"))


def assemble(records: DataFrame, index: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(results, warnings) of source records (id, label, keys, columns): bound to arms, then merged by arm and keys.

    A label that names no arm, or several, gives a warning and no result.
    """
    bound, warnings = bind_sources(records, index, "id", "label")
    return merge_entities(bound.filter("arm_id IS NOT NULL"), ["arm_id", *keys], columns), warnings


def graph_json(entities: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, graph): one JSON object a key, with a sorted list of each kind of entity; kinds without entities have an empty list."""
    out = None
    for kind, frame in entities.items():
        rows = frame.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in frame.columns if c != key]))).alias(kind))
        out = rows if out is None else out.join(rows, key, "full")
    lists = [F.coalesce(F.to_json(kind), F.lit("[]")) for kind in entities]
    body = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{kind}":'), x) for kind, x in zip(entities, lists, strict=True)]), F.lit("}"))
    return out.select(key, body.alias("graph"))


def tree_digest(files: DataFrame, root: str) -> DataFrame:
    """(digest, n): one SHA-256 of a tree of folders read by ``binaryFile``.

    Each folder's digest is of its own files' names and contents in order of names; the tree's, of all folders' relative
    paths and digests in order of paths.  So no row holds more than one folder's files or all folders.
    """
    relative = F.expr(f"substring(path, locate('{root}', path) + {len(root)})")
    named = files.select(F.regexp_extract(relative, "^(.*/)?([^/]*)$", 1).alias("folder"), F.concat_ws(" ", F.regexp_extract(relative, "([^/]*)$", 1), F.sha2("content", 256)).alias("line"))
    folders = named.groupBy("folder").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("d"), F.count("*").alias("k"))
    return folders.select(F.concat_ws(" ", "folder", "d").alias("line"), "k").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("digest"), F.sum("k").alias("n"))


def field_struct(status: str, value: str, raw: str, evidence: str) -> Column:
    """A field as one struct of status, value, raw text and evidence ids; the value only where it is present, no evidence is an empty list."""
    return F.struct(
        F.col(status).alias("status"), F.when(F.col(status) == "PRESENT", F.col(value)).alias("value"), F.col(raw).alias("raw"),
        F.coalesce(evidence, F.array().cast("array<string>")).alias("evidence"),
    )


def module_contexts(lines: DataFrame, key: str, modules: dict[str, tuple[list[str], str]]) -> DataFrame:
    """(key, one column a module): the module's sections, and lines elsewhere that a pattern picks, in order and each line once.

    ``lines`` has key, line, section and content; ``modules`` gives each module its sections and its pattern.
    """
    wanted = lambda sections, pattern: F.col("section").isin(*sections) | F.col("content").rlike(pattern)
    listed = lambda c: F.array_join(F.array_distinct(F.transform(F.array_sort(c), lambda x: x["content"])), "\n")
    return lines.groupBy(key).agg(*[listed(F.collect_list(F.when(wanted(*m), F.struct("line", "content")))).alias(name) for name, m in modules.items()])
