"""JSON values that compare equal however they are spelled."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(text: str) -> str:
    d = Decimal(text)
    if not d:
        return "0"
    sign, digits, exp = d.as_tuple()
    t = "".join(map(str, digits)).rstrip("0")
    return f"{'-' * sign}{t}e{exp + len(digits) - len(t)}"


class _Num(str):
    __slots__ = ()


def canonical(text: str | None) -> str | None:
    """One spelling for each JSON value: sorted keys, no spaces, exact numbers. Text that isn't JSON stays itself, marked."""
    if text is None:
        return None
    try:
        value = json.loads(text, parse_float=_Num, parse_int=_Num, parse_constant=_Num)
    except (ValueError, RecursionError):
        return "\x00" + text

    def spell(v: object) -> str:
        if isinstance(v, dict):
            return "{" + ",".join(f"{json.dumps(k)}:{spell(v[k])}" for k in sorted(v)) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(spell, v)) + "]"
        if isinstance(v, _Num):
            try:
                return _number(v)
            except ArithmeticError:
                return f"\x01{v}"
        return json.dumps(v)

    try:
        return spell(value)
    except RecursionError:
        return "\x00" + text


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


#: Signs whose value the JVM's variant may not hold exactly: numbers with an exponent or of 39 digits and more, halves of surrogate pairs.
_INEXACT = r"[0-9][eE]|[0-9.]{39}|\\u[dD][89a-fA-F]"


def same_json(c: Column | str) -> Column:
    """A spelling inside the JVM under which different values always differ and equal ones mostly agree. For checksums, before `canonical_json`.

    The text is read as the first of two elements of a list, the second being the text's own hash:
    what follows a value that ended early would stand between them. Texts that aren't JSON by that
    test, or hold what the variant can't keep exactly, stay as they are.
    """
    c = F.col(c) if isinstance(c, str) else c
    own = F.xxhash64(c)
    v = F.try_parse_json(F.concat(F.lit("["), c, F.lit(","), own.cast("string"), F.lit("]")))
    whole = (F.try_variant_get(v, "$[1]", "bigint") == own) & F.try_variant_get(v, "$[2]", "variant").isNull()
    return F.when(~c.rlike(_INEXACT) & whole, F.to_json(F.try_variant_get(v, "$[0]", "variant"))).otherwise(c)
