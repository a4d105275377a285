"""Redaction of event bodies of any depth.

Catalyst has no recursion over JSON of unknown depth, so one Arrow-batched function rewrites the text of each event
from the inside out, as the decoder closes its objects; scanning, filtering and writing stay Spark's.
"""

from __future__ import annotations

import json
import re
from urllib.parse import quote_plus, unquote_plus, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from netlens.functions.redact import MARKER, SENSITIVE_KEY

# Keys whose content is a body.
BODY_KEYS = frozenset(("postData", "body", "postDataEntries", "payloadData", "data"))
HEADER_TEXT = "headersText"

_SENSITIVE = re.compile(SENSITIVE_KEY)


def _body(value: object) -> str:
    return f"[REDACTED {len(value.encode('utf-8'))} bytes]" if isinstance(value, str) else MARKER


def _header_lines(value: object) -> object:
    """Text, or lists of texts, whose lines of sensitive names keep the name only."""
    if isinstance(value, list):
        return [_header_lines(each) for each in value]
    if not isinstance(value, str):
        return value
    names = [line.partition(":")[0] for line in value.splitlines()]
    return "\n".join(f"{name}: {MARKER}" if _SENSITIVE.search(name) else line for name, line in zip(names, value.splitlines()))


def _field(field: str) -> str:
    """One field of a query, encoded anew; a sensitive name gets the marker as its value."""
    name, _, value = (unquote_plus(part) for part in field.partition("="))
    return f"{quote_plus(name)}={quote_plus(MARKER if _SENSITIVE.search(name) else value)}"


def _url(value: object) -> object:
    if not isinstance(value, str):
        return value
    try:
        parts = urlsplit(value)
    except ValueError:
        return value
    return urlunsplit((
        parts.scheme, re.sub("^.*@", MARKER + "@", parts.netloc), parts.path, "&".join(map(_field, filter(None, parts.query.split("&")))), parts.fragment,
    ))


def _members(pairs: list[tuple[str, object]]) -> dict:
    """One JSON object as the decoder closes it: what it holds has been through here already."""
    kept = dict(pairs)
    for name, value in kept.items():
        if _SENSITIVE.search(name):
            kept[name] = MARKER
        elif isinstance(value, str) and name.lower().endswith("url"):
            kept[name] = _url(value)
        elif name in BODY_KEYS:
            kept[name] = _body(value)
        elif name == HEADER_TEXT:
            kept[name] = _header_lines(value)
    return kept


def _clean(text: str) -> str:
    return json.dumps(json.loads(text, object_pairs_hook=_members), ensure_ascii=False, separators=(",", ":"))


def sanitized(value: object) -> object:
    """``value`` without secrets."""
    return json.loads(_clean(json.dumps(value)))


@F.pandas_udf(StringType())
def _sanitize_json(texts: pd.Series) -> pd.Series:
    return texts.map(_clean, na_action="ignore")


def sanitize_json(text: Column) -> Column:
    """Redacted JSON text; the input must be valid JSON or NULL."""
    return _sanitize_json(text)


def sanitize_events(events: DataFrame) -> DataFrame:
    """EVENT rows whose params, result and error carry no secrets, as JSON text in ``value``.

    Only these three parts of a recorded message are rewritten, as the recorder does.
    """
    parts = ("params", "result", "error")
    body = F.col("body")
    members = F.try_variant_get(body, "$", "map<string,variant>")
    cleaned = F.transform_values(members, lambda name, value: F.to_json(value))
    pieces = events.withColumns({"_" + part: sanitize_json(F.element_at(cleaned, F.lit(part))) for part in parts})
    kept = F.transform(
        F.map_entries(F.map_filter(cleaned, lambda name, value: ~name.isin(*parts))),
        lambda item: F.concat(F.lit('"'), item["key"], F.lit('":'), item["value"]),
    )
    new = F.array_compact(
        F.array(*[F.when(F.col("_" + part).isNotNull(), F.concat(F.lit(f'"{part}":'), F.col("_" + part))) for part in parts])
    )
    text = F.concat(F.lit("{"), F.array_join(F.concat(kept, new), ","), F.lit("}"))
    return pieces.select("session_id", "seq", "type", text.alias("value"))
