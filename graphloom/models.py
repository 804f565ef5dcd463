"""Where models plug in. The defaults need no network and always answer the same."""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections import Counter
from typing import Protocol

import numpy as np

STOP = frozenset("a an and are as at be by did do does for from has have how in is it its of on or that the this to was were what when where which who whose why will with".split())


class ModelHub(Protocol):
    def embed(self, texts: list[str], query: bool = False) -> np.ndarray: ...
    def analyze(self, question: str) -> dict: ...
    def extract(self, note: str) -> str: ...
    def step(self, question: str, documents: list[str], steps: list[dict]) -> str: ...
    def rerank(self, query: str, texts: list[str]) -> list[float]: ...
    def caption(self, name: str, data: bytes) -> str: ...
    def transcribe(self, name: str, data: bytes) -> str: ...
    def title(self, note: str) -> str: ...
    def summarise(self, members: str) -> str: ...


def words(text: str) -> list[str]:
    return [w for w in re.findall(r"\w+", text.lower()) if w not in STOP]


@functools.lru_cache(1 << 18)
def _place(word: str) -> tuple[int, int]:
    h = hashlib.md5(word.encode()).hexdigest()
    return int(h[:6], 16), 1 if int(h[6], 16) >= 8 else -1


class Offline:
    """Rules instead of models: hashed bags of words, capitalised spans, word overlap."""

    def __init__(self, dims: int = 256):
        self.dims = dims

    def embed(self, texts: list[str], query: bool = False) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for i, t in enumerate(texts):
            n = Counter(re.findall(r"\w+", t.lower()))
            found = [(*_place(w), c) for w, c in n.items() if w not in STOP]
            if found:
                place, sign, count = np.array(found).T
                out[i] = np.bincount(place % self.dims, sign * count, self.dims)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)

    def analyze(self, question: str) -> dict:
        names = re.findall(r"[A-Z][\w'.-]*(?:\s+[A-Z][\w'.-]*)*", question)
        names = [n for n in names if n.lower() not in STOP]
        return {"intent": "search", "entities": names, "concepts": [], "keywords": words(question), "expected_entity_types": [], "question_attribute": None}

    def extract(self, note: str) -> str:
        names = list(dict.fromkeys(re.findall(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*", note)))
        sentences = re.split(r"(?<=[.!?])\s+", note)
        nodes = [{"name": n, "type": "thing", "isolated_context": next((s for s in sentences if n in s), "")} for n in names]
        rels = [{"source_name": a, "target_name": b, "relationship_type": "related_to", "natural_language": "appears with", "confidence": 5, "strength": 5, "relevance": 5} for s in sentences for found in [[n for n in names if n in s]] for a, b in zip(found, found[1:], strict=False)]
        return json.dumps({"nodes": nodes, "relationships": rels, "sentiment": "neutral", "title": self.title(note)})

    def step(self, question: str, documents: list[str], steps: list[dict]) -> str:
        if not documents:
            return f"REASONING: nothing is known yet\nNEXT_QUERY: {question}" if not steps else "REASONING: nothing was found\nFINDING: none"
        scores = self.rerank(question, documents)
        best = documents[max(range(len(documents)), key=lambda i: (scores[i], -i))]
        lines = [x for x in re.split(r"(?<=[.!?])\s+|\n", best) if x.strip()]
        over = self.rerank(question, lines)
        line = lines[max(range(len(lines)), key=lambda i: (over[i], -i))]
        return f"REASONING: the document that shares most words with the question\nFINDING: {line}\nANSWER: {line}"

    def rerank(self, query: str, texts: list[str]) -> list[float]:
        q = set(words(query))
        return [len(q & set(words(t))) / max(1, len(q)) for t in texts]

    def caption(self, name: str, data: bytes) -> str:
        return f"[image {name}, {len(data)} bytes]"

    def transcribe(self, name: str, data: bytes) -> str:
        return f"[audio {name}, {len(data)} bytes]"

    def title(self, note: str) -> str:
        return " ".join(note.split()[:6]) or "Untitled Note"

    def summarise(self, members: str) -> str:
        return members.split("\n")[0][:200]
