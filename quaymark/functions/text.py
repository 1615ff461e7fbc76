"""Texts of logs and failures."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest normalised message.
MESSAGE_CHARS = 160


def normalized_message(c: Column) -> Column:
    """Long hexadecimal ids as an ellipsis, digits as #, cut to MESSAGE_CHARS, so that like failures group."""
    ids = F.regexp_replace(c, r"\b[0-9a-fA-F-]{8,}\b", "…")
    return F.substring(F.regexp_replace(ids, r"[0-9]+", "#"), 1, MESSAGE_CHARS)


def log_filter(c: Column, pattern: str) -> Column:
    """Terms as in log consoles: all of them; with ? any of those; with - none; quoted phrases whole. Case counts. Patterns opening with { or [ pass everything."""
    p = (pattern or "").strip()
    if not p or p[0] in "{[":
        return F.lit(True)
    need, some, never = [], [], []
    for sign, quoted, word in re.findall(r'([?-]?)(?:"([^"]*)"|(\S+))', p):
        term = quoted or word
        if term:
            {"?": some, "-": never}.get(sign, need).append(F.contains(c, F.lit(term)))
    ok = F.lit(True)
    for t in need:
        ok = ok & t
    for t in never:
        ok = ok & ~t
    if some:
        one = F.lit(False)
        for t in some:
            one = one | t
        ok = ok & one
    return ok


def flow_of(workflow_id: Column) -> Column:
    """`evproc:<domain>:<key>` is of flow ev:<domain>, `<type>:<key>` of <type>; blank of none."""
    parts = F.split(workflow_id, ":")
    return F.when(F.coalesce(workflow_id, F.lit("")) == "", F.lit(None)).when(workflow_id.startswith("evproc:"), F.concat(F.lit("ev:"), parts[1])).otherwise(parts[0])


def causation_depth(event_id: Column) -> Column:
    """Dotted numeric steps below the root: `a.1.2` has depth 2."""
    tail = F.regexp_extract(event_id, r"((?:\.[0-9]+)*)$", 1)
    return F.length(tail) - F.length(F.replace(tail, F.lit("."), F.lit("")))


def utf16_key(c: Column) -> Column:
    """Sorts as texts do by their UTF-16 code units, which differs from code points where signs beyond the basic plane meet those at its end."""
    return F.hex(F.encode(c, "UTF-16BE"))
