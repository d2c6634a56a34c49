"""Nested JSON of any depth as rows, read as Spark's variant type reads it."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

#: A list under this key is counted, not walked into.
COUNTED = "evidence"
#: Texts whose leaves are handed back together.
AT_ONCE = 256


def first_present(value: Column, *names: str) -> Column:
    """Of an object, the value of the first of ``names`` that is a key, as a string; null also where that key's value is null."""
    if any("'" in n and '"' in n for n in names):
        raise ValueError("a variant's path has no way to write a key with both kinds of quotation marks")
    quote = lambda n: '"' if "'" in n else "'"
    found = [F.variant_get(value, f"$[{quote(n)}{n}{quote(n)}]", "variant") for n in names]
    # A key whose value is null gives a variant that holds null, which is something.
    return F.coalesce(*found).cast("string")


class _Number(str):
    """A number that is not whole, as it is written."""


_PLAIN_TEXT = re.compile(r"[ !#-\[\]-~]*").fullmatch
_READ = json.JSONDecoder(parse_float=_Number)
_LONG = 10**18
_SCALARS = {None: "null", True: "true", False: "false"}


def _element(x) -> tuple[str, bool]:
    """A scalar of a list in JSON, and whether Spark would write it otherwise."""
    kind = type(x)
    if kind is int:
        return str(x), not -_LONG < x < _LONG
    if kind is str:
        return (f'"{x}"', False) if _PLAIN_TEXT(x) else (json.dumps(x), True)
    return (x, True) if kind is _Number else (_SCALARS[x], False)


def leaves(text: str) -> list[tuple[str, str, str | None, bool]]:
    """(path, kind, value, again) of a readable text; with ``again`` the value is JSON that Spark has to write."""
    out, open_ = [], [("", "", _READ.raw_decode(text.lstrip(" \t\n\r"))[0])]
    add, later = out.append, open_.append
    while open_:
        path, key, v = open_.pop()
        kind = type(v)
        if kind is dict:
            stem = path + "." if path else ""
            for k, x in v.items():
                of = type(x)
                if of is dict or of is list:
                    later((stem + k, k, x))
                elif of is str:
                    add((stem + k, "value", x, False))
                elif x is None:
                    add((stem + k, "value", None, False))
                else:
                    add((stem + k, "value", *_element(x)))
        elif kind is list:
            kinds = set(map(type, v))
            if key == COUNTED:
                add((path, "evidence", str(len(v)), False))
            elif dict in kinds or list in kinds:
                open_ += [(f"{path}[{i}]", "", x) for i, x in enumerate(v)]
            else:
                parts = [_element(x) for x in v]
                add((path, "list", f"[{','.join([x for x, _ in parts])}]", any([odd for _, odd in parts])))
        else:
            add((path, "value", v, False) if kind is str or v is None else (path, "value", *_element(v)))
    return out


def _texts(values: list[str | None]) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        # Half of a pair of surrogates, which Spark replaces too.
        return pa.array([None if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())


def flatten(rows: DataFrame, keys: list[str], json: str) -> DataFrame:
    """(keys, path, kind, value): a row for each leaf of a JSON text.

    Paths are ``a.b[0].c``.  kind is value for a scalar, whose string form is the value; list for a list without
    objects or lists in it, kept as JSON; evidence for a list under the key ``evidence``, whose length is the value;
    unreadable for a text that is no JSON or has a key twice.  Empty objects and null texts have no leaves.

    What can be read and how values are written is Spark's variant's matter; a text is walked through at once, in one
    pass over the rows that writes nothing out.
    """
    given = rows.filter(F.col(json).isNotNull()).select(*keys, F.when(F.try_parse_json(F.col(json)).isNotNull(), F.col(json)).alias("_text"))
    schema = StructType([*given.select(*keys).schema.fields, *(StructField(c, StringType()) for c in ("path", "kind", "value")), StructField("_again", BooleanType())])

    def run(batches):
        for batch in batches:
            ids = batch.select(keys)
            texts = batch.column(len(keys)).to_pylist()
            for start in range(0, len(texts), AT_ONCE):
                at, found = [], []
                for n, text in enumerate(texts[start : start + AT_ONCE], start):
                    some = [("", "unreadable", None, False)] if text is None else leaves(text)
                    found += some
                    at += [n] * len(some)
                if found:
                    path, kind, value, again = zip(*found, strict=True)
                    held = ids.take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*held.columns, _texts(path), pa.array(kind, pa.string()), _texts(value), pa.array(again, pa.bool_())], names=[f.name for f in schema.fields])

    each = given.mapInArrow(run, schema)
    parsed = F.parse_json(F.when(F.col("_again"), F.col("value")))
    written_again = F.when(F.col("kind") == "list", F.to_json(parsed)).otherwise(parsed.cast("string"))
    return each.select(*keys, "path", "kind", F.when(F.col("_again"), written_again).otherwise(F.col("value")).alias("value"))
