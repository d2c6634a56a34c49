"""Contracts as rules: one scan a table whatever the number of rules, violations with the ids of their rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.shared import written


@dataclass(frozen=True)
class Check:
    """``holds``: an SQL condition on a row: allowed values, tolerances, what goes with what.  Unknown is no violation."""

    name: str
    table: str
    holds: str


@dataclass(frozen=True)
class Unique:
    """No two rows have the same values, nulls aside; the id of a violation is the values."""

    name: str
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Foreign:
    """A row's values, if none is null, are those of a row of the parent."""

    name: str
    table: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class Reciprocal:
    """Whatever a row lists in ``refs`` lists the row in turn: rows of ``other`` by ``other_key``, their list ``other_refs``."""

    name: str
    table: str
    key: str
    refs: str
    other: str
    other_key: str
    other_refs: str


Rule = Check | Unique | Foreign | Reciprocal


def allowed(name: str, table: str, column: str, *values) -> Check:
    return Check(name, table, f"`{column}` IN ({', '.join(repr(v) for v in values)})")


def _key(*values: Column) -> Column:
    """Values as one text; null if one is."""
    parts = [F.concat(F.length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")) for v in values]
    return F.concat(*parts)


def _fact(kind: str, rule: str, target: str, id_: Column, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(rule).alias("rule"), F.lit(target).alias("target"), id_.cast("string").alias("id"), key.alias("key"))


def _facts(table: str, id_col: str, rules: list[Rule]) -> Column:
    """Whatever a row of a table says to any rule, as an array."""
    id_, one, many, asked = F.col(id_col), [], [], set()
    nothing = F.lit(None).cast("string")
    for r in rules:
        if isinstance(r, Check) and r.table == table:
            one.append(F.when(~F.expr(r.holds), _fact("row", r.name, "", id_, nothing)))
        elif isinstance(r, Unique) and r.table == table:
            one.append(F.when(_key(*map(F.col, r.columns)).isNotNull(), _fact("unique", r.name, "", F.concat_ws("/", *[F.col(c).cast("string") for c in r.columns]), _key(*map(F.col, r.columns)))))
        elif isinstance(r, Foreign):
            target = f"{r.parent}({','.join(r.parent_columns)})"
            if r.table == table:
                one.append(F.when(_key(*map(F.col, r.columns)).isNotNull(), _fact("child", r.name, target, id_, _key(*map(F.col, r.columns)))))
            if r.parent == table and target not in asked:
                asked.add(target)
                one.append(F.when(_key(*map(F.col, r.parent_columns)).isNotNull(), _fact("parent", "", target, nothing, _key(*map(F.col, r.parent_columns)))))
        elif isinstance(r, Reciprocal):
            target = f"{r.name}()"
            if r.table == table:
                many.append(F.transform(F.col(r.refs), _mutual("child", r.name, target, id_, F.col(r.key), back=True)))
            if r.other == table:
                many.append(F.transform(F.col(r.other_refs), _mutual("parent", "", target, nothing, F.col(r.other_key), back=False)))
    facts = F.array_compact(F.array(*one)) if one else None
    for m in many:
        m = F.filter(F.coalesce(m, F.array().cast("array<struct<kind:string,rule:string,target:string,id:string,key:string>>")), lambda x: x["key"].isNotNull())
        facts = m if facts is None else F.concat(facts, m)
    return facts


def _mutual(kind: str, rule: str, target: str, id_: Column, own: Column, back: bool):
    return lambda ref: _fact(kind, rule, target, id_, _key(ref, own) if back else _key(own, ref))


def facts(tables: dict[str, DataFrame], ids: dict[str, str], rules: list[Rule]) -> DataFrame:
    """(kind, rule, target, id, key): what all tables say, each scanned once; foreign keys of one parent share its keys."""
    out = None
    for name, df in tables.items():
        said = _facts(name, ids[name], rules)
        if said is not None:
            some = df.select(F.explode(said).alias("x")).select("x.*")
            out = some if out is None else out.unionByName(some)
    return out


def violations(tables: dict[str, DataFrame], ids: dict[str, str], rules: list[Rule]) -> DataFrame:
    """(rule, id) of every violation, each once.  ``ids`` has the column that names a table's rows.

    Keys are first reduced to distinct ones, task by task, so that a key of very many rows costs no more than another;
    only rows whose key has no parent are looked up again.
    """
    said = written(facts(tables, ids, rules), "contract")
    of_rows = said.filter("kind = 'row'").select("rule", "id")
    twice = said.filter("kind = 'unique'").groupBy("rule", "key").agg(F.count("*").alias("n"), F.first("id").alias("id")).filter("n > 1").select("rule", "id")
    child, parent = said.filter("kind = 'child'"), said.filter("kind = 'parent'").select("target", "key").distinct()
    missing = written(child.select("target", "key").distinct().join(parent, ["target", "key"], "left_anti"), "missing-parents")
    orphans = child.join(missing, ["target", "key"]).select("rule", "id")
    return of_rows.unionByName(twice).unionByName(orphans).distinct()
