"""Lenient reading of JSON that a language model wrote, and what is made of it.

Small pure functions for a row each; ``parsed`` applies one to a column.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACTIONS = {"merge", "create", "no_op"}
CLASSES = {"concept", "fact", "event", "source"}
CLOSERS = {"{": "}", "[": "]"}


def strip_fence(text: str) -> str:
    """What stands in a fenced block, if the text is one; else the text."""
    found = re.fullmatch(r"\s*```[A-Za-z]*[ \t]*\n?(.*?)\n?\s*```\s*", text, re.DOTALL)
    return (found[1] if found else text).strip()


def strip_thinking(text: str) -> str:
    """Without <think> parts; an open one hides all that follows."""
    return re.sub(r"<think(?:ing)?>.*?(?:</think(?:ing)?>|\Z)", "", text, flags=re.DOTALL).strip()


def _scan(text: str, start: int) -> tuple[int | None, list[str], bool]:
    """From an opening bracket: the end of its value (None if it is cut off), the closers still owed,
    and whether a string is open."""
    owed: list[str] = []
    quoted = escaped = False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in CLOSERS:
            owed.append(CLOSERS[c])
        elif owed and c == owed[-1]:
            owed.pop()
            if not owed:
                return i + 1, [], False
    return None, owed, quoted


def first_json(text: str) -> str:
    """The first balanced object or array in a text; one that is cut off is closed."""
    text = strip_fence(strip_thinking(text))
    found = re.search(r"[{\[]", text)
    if not found:
        return text
    end, owed, quoted = _scan(text, found.start())
    if end is not None:
        return text[found.start() : end]
    body = text[found.start() :] + ('"' if quoted else "")
    return re.sub(r"[,:\s]+$", "", body) + "".join(reversed(owed))


def leading_items(text: str) -> list:
    """The whole elements at the beginning of an array that is cut off."""
    at = text.find("[")
    if at < 0:
        return []
    decoder, out, at = json.JSONDecoder(), [], at + 1
    while True:
        at = re.compile(r"[\s,]*").match(text, at).end()
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            return out
        out.append(value)


def load(text: str | None) -> Any:
    """The value in a text, as well as can be made out; None if there is none."""
    for attempt in (first_json, strip_fence):
        try:
            return json.loads(attempt(text or ""))
        except ValueError:
            continue
    return leading_items(text or "") or None


def unwrapped(value: Any, *names: str) -> list:
    """The list in a value: itself, under one of the names, or the value alone."""
    if isinstance(value, dict):
        value = next((value[n] for n in names if isinstance(value.get(n), list)), [value])
    return value if isinstance(value, list) else []


def _text(value: Any) -> str:
    return value.strip() if isinstance(value, str) else ""


def concepts(raw: str | None) -> list[dict]:
    """Drafts with a name: name, content, node_class, relation_hints."""
    out = []
    for item in unwrapped(load(raw), "concepts", "items", "results"):
        item = {"name": item} if isinstance(item, str) else item
        if not isinstance(item, dict):
            continue
        content = _text(item.get("content")) or _text(item.get("description"))
        name = _text(item.get("name")) or _text(item.get("title")) or content[:40]
        if name:
            kind = item.get("node_class") if item.get("node_class") in CLASSES else "concept"
            hints = [h for h in item.get("relation_hints") or [] if isinstance(h, str)]
            out.append({"name": name, "content": content or name, "node_class": kind, "relation_hints": hints})
    return out


def _ends(values: Any, key: str) -> list[str]:
    found = [v if isinstance(v, str) else v.get(key) if isinstance(v, dict) else None for v in values or []]
    return [f for f in found if isinstance(f, str) and f]


def decisions(raw: str | None) -> list[dict]:
    """Decisions about drafts; an unknown action does nothing."""
    out = []
    for item in unwrapped(load(raw), "decisions", "items", "results"):
        if not isinstance(item, dict):
            continue
        concept = item.get("concept") if isinstance(item.get("concept"), dict) else {"name": item.get("concept") or item.get("name")}
        out.append(
            {
                "action": item.get("action") if item.get("action") in ACTIONS else "no_op",
                "name": _text(concept.get("name")),
                "target_id": _text(item.get("target_id")) or None,
                "edges_to": _ends(item.get("edges_to"), "target_id"),
                "edges_to_names": _ends(item.get("edges_to_names"), "name"),
                "aliases": [a for a in item.get("aliases_to_add") or [] if isinstance(a, str)],
                "reason": _text(item.get("reason")),
            }
        )
    return out


def communities(raw: str | None) -> list[dict]:
    out = []
    for item in unwrapped(load(raw), "communities", "items"):
        if isinstance(item, dict):
            members = [m for m in item.get("member_ids") or item.get("members") or [] if isinstance(m, str)]
            kind = item.get("strategy") if item.get("strategy") in ("merge", "key_concept", "summarize") else "summarize"
            out.append({"theme": _text(item.get("theme")), "member_ids": members, "strategy": kind, "key_id": _text(item.get("key_concept_id")) or None, "summary": _text(item.get("summary"))})
    return out


def ids(raw: str | None) -> list[str]:
    """Ids from a list, from objects with an id, or from quoted strings; it never fails."""
    value = load(raw)
    found = [v if isinstance(v, str) else v.get("id") if isinstance(v, dict) else None for v in unwrapped(value, "ids", "node_ids", "selected", "result")]
    found = [re.sub(r"^\[?id[:=]\s*|\]$", "", f.strip()) for f in found if isinstance(f, str)]
    return found or ([] if value is not None else re.findall(r'"([^"\\]+)"', raw or ""))


def selection(raw: str | None) -> dict:
    """result and frontier, 1-based; a bare list is both."""
    value = load(raw)
    numbers = lambda v: [n for n in v if isinstance(n, int) and not isinstance(n, bool)] if isinstance(v, list) else []
    if isinstance(value, list):
        return {"result": numbers(value), "frontier": numbers(value)}
    if not isinstance(value, dict):
        raise ValueError("neither object nor list")
    return {"result": numbers(value.get("result")), "frontier": numbers(value.get("frontier"))}


def source_of(value: str | None) -> dict:
    """doc_id, chunk_id, content_hash of a source kept as JSON or as a constructor call's text."""
    try:
        known = json.loads(value or "")
    except ValueError:
        known = dict(re.findall(r"(\w+)='([^']*)'", value or ""))
    known = known if isinstance(known, dict) else {}
    return {k: known.get(k) for k in ("doc_id", "chunk_id", "content_hash")}


def fill(template: str, values: dict[str, str]) -> str:
    """The template with its fields filled in; unchanged if one is missing."""
    try:
        return template.format(**values)
    except (KeyError, IndexError, ValueError):
        return template


def expand_variables(value: Any, variables: dict[str, str]) -> Any:
    """``${NAME}`` and ``${NAME:-default}`` in all strings of a configuration."""
    if isinstance(value, dict):
        return {k: expand_variables(v, variables) for k, v in value.items()}
    if isinstance(value, list):
        return [expand_variables(v, variables) for v in value]
    if not isinstance(value, str):
        return value
    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: variables.get(m[1], m[2] if m[2] is not None else m[0]), value)


_STRINGS = T.ArrayType(T.StringType())
SCHEMAS: dict[Callable, T.DataType] = {
    concepts: T.ArrayType(T.StructType().add("name", T.StringType()).add("content", T.StringType()).add("node_class", T.StringType()).add("relation_hints", _STRINGS)),
    decisions: T.ArrayType(
        T.StructType().add("action", T.StringType()).add("name", T.StringType()).add("target_id", T.StringType()).add("edges_to", _STRINGS).add("edges_to_names", _STRINGS).add("aliases", _STRINGS).add("reason", T.StringType())
    ),
    communities: T.ArrayType(T.StructType().add("theme", T.StringType()).add("member_ids", _STRINGS).add("strategy", T.StringType()).add("key_id", T.StringType()).add("summary", T.StringType())),
    ids: _STRINGS,
    first_json: T.StringType(),
}


def parsed(read: Callable[[str | None], Any], raw: Column) -> Column:
    """A column of what ``read`` makes of each text, in Arrow batches."""
    kind = SCHEMAS[read]

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([read(t or "") for t in texts], dtype=object)

    return F.pandas_udf(run, kind)(raw)
