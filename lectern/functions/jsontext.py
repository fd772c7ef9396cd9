"""JSON in free text: the object that a reply holds, and replies that were cut off."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def salvage(reply: str | None) -> str | None:
    """The object in a reply, as compact JSON: the whole, else the one that ends the text, else the last one."""
    body = (reply or "").strip()
    if body.startswith("```"):
        body = body.partition("\n")[2].strip().removesuffix("```").strip()
    found, at, decoder = None, body.find("{"), json.JSONDecoder()
    while at >= 0:
        try:
            value, size = decoder.raw_decode(body[at:])
        except ValueError:
            size = 0
        else:
            found = value
            if not body[at + size :].strip():
                break
        at = body.find("{", at + 1)
    return None if found is None else json.dumps(found, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def closed(reply: str | None) -> str | None:
    """A cut-off reply with its open strings, arrays and objects closed; null if that does not parse.

    One pass notes at each place where the text could end what is open there
    (lists that share their tails); the places are tried from the last.
    """
    body = (reply or "").strip()
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    body = body[start:]
    open_, quoted, escaped, ends = None, False, False, []
    for i, c in enumerate(body):
        if c in ',]}"':
            ends.append((i, open_, quoted))
        if escaped:
            escaped = False
        elif c == "\\" and quoted:
            escaped = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{[":
            open_ = ("}" if c == "{" else "]", open_)
        elif not quoted and c in "}]" and open_:
            open_ = open_[1]
    ends.append((len(body), open_, quoted))
    for end, left, inside in reversed(ends):
        text = (body[:end] + '"' * inside).rstrip().rstrip(",")
        while left:
            text, left = text + left[0], left[1]
        try:
            value = json.loads(text)
        except ValueError:
            continue
        return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return None


def _salvaged(replies: pd.Series) -> pd.Series:
    return replies.map(salvage)


def _closed(replies: pd.Series) -> pd.Series:
    return replies.map(closed)


def json_object(reply: Column) -> Column:
    return F.pandas_udf(_salvaged, "string")(reply)


def json_closed(reply: Column) -> Column:
    return F.pandas_udf(_closed, "string")(reply)
