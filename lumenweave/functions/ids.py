"""Canonical JSON and content-addressed ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """A JSON object with sorted keys, compact, null fields written; numbers plain, texts escaped."""
    parts = []
    for name in sorted(fields):
        value = F.to_json(F.struct(fields[name].alias("v")))
        inner = F.coalesce(F.nullif(F.regexp_extract(value, r'(?s)^\{"v":(.*)\}$', 1), F.lit("")), F.lit("null"))
        parts.append(F.concat(F.lit(f'"{name}":'), inner))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def content_id(prefix: str, length: int = 24, **fields: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(canonical_json(**fields), 256), 1, length))


def redact(text: Column, secrets: list[str]) -> Column:
    """The text with every secret replaced."""
    for secret in sorted(filter(None, secrets), key=len, reverse=True):
        text = F.replace(text, F.lit(secret), F.lit("[redacted]"))
    return text
