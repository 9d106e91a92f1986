"""Verdicts out of model replies."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictlake.schemas import STATUSES, VERDICT

MARKS = ("scenario_id", "status", "justification")


def outer_json(reply: Column) -> Column:
    """From the first brace or bracket to the last one that can close it; null without any."""
    return F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))


def _objects(text: str) -> Iterator[object]:
    """Objects in a reply, mended where they have comments, trailing commas, single quotes or Python's literals."""
    decoder, at = json.JSONDecoder(strict=False), 0
    while (at := text.find("{", at)) >= 0:
        try:
            found, end = decoder.raw_decode(text, at)
            yield found
            at = end
            continue
        except ValueError:
            pass
        depth, quote, k, before = 0, "", at, ""  # before: the last character that is no blank
        while k < len(text):  # the matching brace, outside strings
            c = text[k]
            if quote:
                k += c == "\\"
                quote = "" if c == quote else quote
            elif c == '"' or (c == "'" and before and before in "[{,:"):
                quote = c
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    break
            before = before if c.isspace() else c
            k += 1
        part = text[at : k + 1] if depth == 0 else text[at:] + "}" * depth
        part = re.sub(r",(\s*[}\]])", r"\1", re.sub(r"(?m)(^|[\s,{\[])//[^\n]*", r"\1", part))
        for read in (lambda p: json.loads(p, strict=False), lambda p: json.loads(re.sub(r"\bNone\b", "null", re.sub(r"\bTrue\b", "true", re.sub(r"\bFalse\b", "false", p))), strict=False), lambda p: ast.literal_eval(re.sub(r"\bnull\b", "None", re.sub(r"\btrue\b", "True", re.sub(r"\bfalse\b", "False", p))))):
            try:
                yield read(part)
                break
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                continue
        at = k + 1


def verdict_of(reply: str | None) -> str | None:
    """JSON of the first object with a verdict's field, else of the first object that isn't empty, else None."""
    found = [x for x in _objects(reply or "") if isinstance(x, dict) and x]
    best = next((x for x in found if any(m in x for m in MARKS)), found[0] if found else None)
    return None if best is None else json.dumps(best)


@F.pandas_udf(T.StringType())
def verdict_json(replies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """verdict_of, for columns; mending broken JSON has no built-in."""
    for series in replies:
        yield series.map(verdict_of, na_action="ignore")


def read(reply: Column) -> Column:
    """verdict_of for a column of replies. Those whose JSON is whole are read by built-ins; Python gets the others, and nulls."""
    outer = outer_json(reply)
    # built-ins read the first value only: what looks like more than one object goes to Python
    one = outer.startswith("{") & ~outer.rlike(r"\}\s*(?:[^\s,\]}]|,\s*\{)")
    whole = F.when(one & F.try_parse_json(outer).isNotNull() & (F.size(F.json_object_keys(outer)) > 0), outer)
    return F.coalesce(whole, verdict_json(F.when(whole.isNull(), reply)))


def parse(verdict: Column) -> Column:
    """The verdict's struct; null if it isn't JSON."""
    return F.from_json(verdict, VERDICT, {"mode": "PERMISSIVE"})


def is_marked(verdict: Column) -> Column:
    return F.coalesce(F.arrays_overlap(F.json_object_keys(verdict), F.array(*map(F.lit, MARKS))), F.lit(False))


def problem(v: Column) -> Column:
    """Why a parsed verdict is invalid; null if it is valid."""
    uuid = r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"
    return (
        F.when(v.isNull(), "no verdict")
        .when(v["scenario_id"].isNull() | ~v["scenario_id"].rlike(uuid), "scenario_id")
        .when(v["scenario_title"].isNull(), "scenario_title")
        .when(v["status"].isNull() | ~v["status"].isin(*STATUSES), "status")
        .when(v["justification"].isNull(), "justification")
        .when(v["code_reference"].isNull(), "code_reference")
    )


#: Fixed value: what a verdict that no call backs is given as its suggestion.
INCOMPLETE = "Verification incomplete — GitHub API errors prevented full analysis: "


def overridden(status: Column, suggestion: Column, errors: Column, successes: Column) -> Column:
    """status and suggestion: a pass that no tool call backs fails, with the first three errors as the reason."""
    forced = (F.size(errors) > 0) & (successes == 0) & (status == "pass")
    reason = F.concat(F.lit(INCOMPLETE), F.array_join(F.slice(errors, 1, 3), "; "))
    return F.struct(F.when(forced, "fail").otherwise(status).alias("status"), F.when(forced, reason).otherwise(suggestion).alias("suggestion"))
