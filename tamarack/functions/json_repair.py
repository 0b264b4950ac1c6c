"""JSON out of replies: fences and thoughts taken off, trailing commas dropped, cut-off structures closed."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: A string, or a comma before a closing bracket; only the comma goes.
_STRING_OR_COMMA = re.compile(r'("(?:[^"\\]|\\.)*"?)|,(?=\s*[}\]])', re.S)


def _without_trailing_commas(text: str) -> str:
    return _STRING_OR_COMMA.sub(lambda m: m[1] or "", text)


def _closed(text: str) -> str:
    """The text with its open string and brackets closed; what follows the last whole element of a cut array is dropped."""
    stack, inside, skip, whole, then = [], False, False, 0, ""
    for i, ch in enumerate(text):
        if skip:
            skip = False
        elif inside:
            skip, inside = ch == "\\", ch != '"'
        elif ch == '"':
            inside = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]" and stack:
            stack.pop()
            whole, then = i + 1, "".join(reversed(stack))
            if not stack:
                return text[: i + 1]
    closers = "".join(reversed(stack))
    tried = [text + ('"' if inside else "") + closers, re.sub(r',\s*("[^"]*"?\s*:?\s*)?$', "", text + ('"' if inside else "")) + closers]
    if whole:
        tried.append(text[:whole] + then)
    for t in tried:
        try:
            json.loads(_without_trailing_commas(t), strict=False)
            return t
        except ValueError:
            continue
    return tried[0]


def repair_json(reply: str | None) -> str | None:
    """The first JSON object or array of a reply as JSON text, or None."""
    if reply is None:
        return None
    text = re.sub(r"<think>.*?(?:</think>|\Z)", " ", reply, flags=re.S)
    fence = re.search(r"```(?:json)?\s*(.*?)(?:```|\Z)", text, re.S)
    text = fence[1] if fence and re.search(r"[{\[]", fence[1]) else text
    start = re.search(r"[{\[]", text)
    if not start:
        return None
    body = _without_trailing_commas(_closed(text[start.start() :]))
    try:
        return json.dumps(json.loads(body, strict=False), ensure_ascii=False, sort_keys=True)
    except ValueError:
        return None


def repaired(c: Column) -> Column:
    """repair_json() of a column, for from_json()."""
    return F.udf(repair_json, T.StringType(), useArrow=True)(c)
