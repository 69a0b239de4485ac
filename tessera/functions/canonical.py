"""Canonical texts of any JSON value, by one scan over its tokens with a stack: as deep as it goes, numbers of any length."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)|(true|false|null)|([\[\]{},:]))')


class Unsigned(ValueError):
    """A value that has no canonical text; the message says why."""


def number(text: str, precision: int) -> str:
    """A number as its nearest double with so many places; minus zero is zero."""
    x = float(text)
    if not math.isfinite(x):
        raise Unsigned(f"{text if len(text) < 40 else text[:37] + '...'} isn't finite")
    return format(round(x, precision) + 0.0, f".{precision}f")


def canonical(text: str, precision: int) -> str:
    """true, false, numbers, strings, null and lists told apart by tags; the outermost object is a list of [key, value] in the order of its keys."""
    if precision < 0:
        raise Unsigned(f"precision must be non-negative; got {precision}")
    tokens, at, end = [], 0, len(text.rstrip(" \t\n\r"))
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise Unsigned(f"invalid JSON at {at}")
        tokens.append((m.lastindex, m[m.lastindex]))
        at = m.end()
    stack: list[list] = []  # open containers: [closing bracket, parts, key of an object's next value]
    out, want = None, "value"  # what may come now: value, value or end, comma or end, key, key or end, colon
    for kind, said in tokens:
        if out is not None:
            raise Unsigned("invalid JSON: more than one value")
        done = None
        if want.startswith("key"):
            if kind == 1:
                stack[-1][2] = json.loads(said)
                if stack[-1][2] in stack[-1][1]:
                    raise Unsigned(f"the key {said} occurs twice")
                want = "colon"
                continue
            if not (said == "}" and want == "key or end"):
                raise Unsigned("invalid JSON: a key is missing")
        if want == "colon":
            if said != ":":
                raise Unsigned("invalid JSON: a colon is missing")
            want = "value"
            continue
        if want == "comma or end" and said == "," and kind == 4:
            want = "key" if stack[-1][0] == "}" else "value"
            continue
        if kind == 4 and said in "]}":
            if not stack or stack[-1][0] != said or want == "value":
                raise Unsigned("invalid JSON: a bracket is out of place")
            _, parts, _ = stack.pop()
            done = f'["l",[{",".join(parts)}]]' if said == "]" else "[" + ",".join(f"[{json.dumps(k, ensure_ascii=False)},{parts[k]}]" for k in sorted(parts)) + "]"
        elif not want.startswith("value"):
            raise Unsigned("invalid JSON: a comma is missing")
        elif said == "[" and kind == 4:
            stack.append(["]", [], None])
            want = "value or end"
            continue
        elif said == "{" and kind == 4:
            if stack:
                raise Unsigned("an object within a value can't be signed")
            stack.append(["}", {}, None])
            want = "key or end"
            continue
        elif kind == 4:
            raise Unsigned("invalid JSON: a value is missing")
        else:
            done = f'["s",{json.dumps(json.loads(said), ensure_ascii=False)}]' if kind == 1 else f'["n","{number(said, precision)}"]' if kind == 2 else '["z",null]' if said == "null" else f'["b",{said}]'
        if not stack:
            out = done
        elif stack[-1][0] == "]":
            stack[-1][1].append(done)
        else:
            stack[-1][1][stack[-1][2]] = done
        want = "comma or end"
    if out is None:
        raise Unsigned("invalid JSON: it ends too early")
    return out


_FIELDS = T.StructType([T.StructField("payload", T.StringType()), T.StructField("error", T.StringType())])


def fields(value: Column, precision: int = 6) -> Column:
    """(payload, error) of JSON texts: one side is null; both are for null."""

    @F.pandas_udf(_FIELDS)
    def run(texts: pd.Series) -> pd.DataFrame:
        known: dict = {None: (None, None)}
        for t in texts:
            if t not in known:
                try:
                    known[t] = (canonical(t, precision), None)
                except ValueError as e:
                    known[t] = (None, str(e))
        return pd.DataFrame([known[t] for t in texts], columns=["payload", "error"])

    return run(value)
