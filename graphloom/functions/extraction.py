"""Reading a model's extraction of entities and relationships, whatever shape it comes in."""

from __future__ import annotations

import json
import re

# Other names that models give the same thing.
ROOTS = ("extraction", "data", "result")
NODE_NAME = ("name", "trait", "title", "entity")
NODE_CONTEXT = ("isolated_context", "evidence_quote", "context", "description")
REL_KEYS = {
    "source_name": ("source_name", "source", "from", "subject", "head"),
    "target_name": ("target_name", "target", "to", "object", "tail"),
    "relationship_type": ("relationship_type", "type", "relation", "predicate", "rel_type", "description"),
    "natural_language": ("natural_language", "sentence"),
    "reasoning": ("reasoning",),
    "context": ("context",),
}
NODE_LISTS = ("nodes", "entities", "people", "places", "concepts", "events", "traits", "beliefs", "organizations")
REL_LISTS = ("relationships", "relations", "edges", "links")
WORDS = {"very high": 9.0, "high": 8.0, "medium": 6.0, "moderate": 6.0, "low": 4.0, "very low": 2.0}

SCHEMA = "nodes array<struct<name:string,type:string,type_reasoning:string,isolated_context:string>>, relationships array<struct<source_name:string,target_name:string,relationship_type:string,reasoning:string,natural_language:string,context:string,strength:double,confidence:double,relevance:double>>, sentiment string, title string"


def parse_json(text: str):
    """The JSON of an answer: fences off, quotes straight, trailing commas and control signs gone, missing brackets added; None if hopeless."""
    t = re.sub(r"\A\s*```[A-Za-z]*\s*|\s*```\s*\Z", "", text or "")
    t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", t).translate(str.maketrans("“”‘’", "\"\"''"))
    begin = min((i for i in (t.find("{"), t.find("[")) if i >= 0), default=-1)
    if begin < 0:
        return None
    t = re.sub(r",\s*([}\]])", r"\1", t[begin:])
    for candidate in (t, t + _closing(t)):
        try:
            return json.JSONDecoder(strict=False).raw_decode(re.sub(r",\s*([}\]])", r"\1", candidate))[0]
        except ValueError:
            continue
    return None


def _closing(t: str) -> str:
    """What would close the open string, lists and objects."""
    stack, quoted, escaped = [], False, False
    for c in t:
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    return '"' * quoted + "".join(reversed(stack))


def score(value, default: float) -> float:
    if value is None or isinstance(value, bool):
        return default
    if isinstance(value, str):
        if (known := WORDS.get(value.lower().strip())) is not None:
            return known
        try:
            value = float(value)
        except ValueError:
            return default
    if not isinstance(value, int | float) or value != value:
        return default
    value = float(value)
    if 0 <= value <= 1:
        value = round(value * 10, 1)
    return max(1.0, min(10.0, value))


def _text(item: dict, keys) -> str:
    return next((str(item[k]).strip() for k in keys if item.get(k) not in (None, "")), "")


def _node(item) -> tuple[dict | None, list]:
    if isinstance(item, str):
        return ({"name": item.strip(), "type": "thing", "type_reasoning": "", "isolated_context": ""}, []) if item.strip() else (None, [])
    if not isinstance(item, dict):
        return None, []
    name = _text(item, NODE_NAME)
    inner = [r | ({} if _text(r, REL_KEYS["source_name"]) else {"source_name": name}) for k in REL_LISTS for r in item.get(k) or [] if isinstance(r, dict)]
    return {"name": name, "type": _text(item, ("type", "label")) or "thing", "type_reasoning": _text(item, ("type_reasoning",)), "isolated_context": _text(item, NODE_CONTEXT)}, inner


def _relationship(item: dict) -> dict:
    out = {k: _text(item, names) for k, names in REL_KEYS.items()}
    kind = re.sub(r"\s+", "_", re.sub(r"[^a-z0-9 ]", "", out["relationship_type"].lower()).strip()) if " " in out["relationship_type"] else out["relationship_type"]
    return out | {"relationship_type": kind or "relates_to", "confidence": score(item.get("confidence"), 7.0), "strength": score(item.get("strength"), 5.0), "relevance": score(item.get("relevance"), 5.0)}


def coerce(text: str | None) -> dict:
    """nodes, relationships, sentiment, title of an answer; empty lists where it can't be read."""
    data = parse_json(text or "")
    while isinstance(data, dict) and (key := next((k for k in ROOTS if isinstance(data.get(k), dict | list)), None)):
        data = data[key]
    if isinstance(data, list):
        data = {"nodes": data[0], "relationships": data[1]} if len(data) == 2 and all(isinstance(x, list) for x in data) else {"nodes": data}
    data = data if isinstance(data, dict) else {}
    nodes, rels = [], [r for k in REL_LISTS for r in (data.get(k) or []) if isinstance(r, dict)]
    for key in NODE_LISTS:
        for item in data.get(key) or []:
            if isinstance(item, dict) and _text(item, REL_KEYS["source_name"]) and _text(item, REL_KEYS["target_name"]):
                rels.append(item)
                continue
            node, inner = _node(item)
            rels += inner
            if node:
                nodes.append(node)
    title = data.get("title")
    return {"nodes": nodes, "relationships": [_relationship(r) for r in rels], "sentiment": str(data.get("sentiment") or ""), "title": str(title) if title else None}
