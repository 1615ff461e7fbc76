"""Read-only SQL for consoles: one statement of an allowed kind, a capped result."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

MAX_ROWS = 5000
_ALLOWED = re.compile(r"(?is)^(?:select|with|values|describe|desc|show|explain\s+(?:extended\s+|formatted\s+|cost\s+)?(?:select|with))\b")
_WRITES = re.compile(r"(?i)\b(?:insert|update|delete|merge|create|drop|alter|truncate|replace|load|cache|uncache|refresh|msck|set|reset|add|grant|revoke|call|use|analyze)\b")


class Refused(ValueError):
    pass


def _bare(sql: str) -> str:
    """Without comments, and with strings and quoted names blanked, so that words in them don't count."""
    out = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", "''", sql)
    return re.sub(r"--[^\n]*|/\*.*?\*/", " ", out, flags=re.S)


def checked(sql: str) -> str:
    """The statement, if it is a single one that only reads."""
    bare = _bare(sql or "").strip().rstrip(";").strip()
    if not bare:
        raise Refused("no statement")
    if ";" in bare:
        raise Refused("one statement only")
    if not _ALLOWED.match(bare):
        raise Refused("only statements that read")
    if bare[:4].lower() in ("sele", "with", "expl") and _WRITES.search(re.sub(r"(?i)\breplace\s*\(", "f(", bare)):
        raise Refused("only statements that read")
    return sql.strip().rstrip(";")


def guarded(spark: SparkSession, sql: str, rows: int = MAX_ROWS) -> tuple[DataFrame, bool]:
    """(result of at most `rows` rows, whether there were more). The statement runs once; its capped result is what the caller gets."""
    d = spark.sql(checked(sql))
    got = d.limit(rows + 1).collect()
    return spark.createDataFrame(got[:rows], d.schema), len(got) > rows
