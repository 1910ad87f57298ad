"""Settings: a tree read by dotted names, with environment values filled in."""

from __future__ import annotations

import copy
import json
import os
import re
from pathlib import Path
from typing import Any

_REFERENCE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")

# Defaults of the pipeline.
DEFAULTS: dict[str, Any] = {
    "chunk": {"tokens": 700, "overlap": 120, "min_tokens": 60, "heading_ratio": 1.15},
    "retrieve": {"dense_top_k": 40, "bm25_top_k": 40, "rrf_k": 60, "multi_query": False, "n_queries": 3, "hyde": False, "neighbor_window": 1, "max_context_tokens": 4500},
    "rerank": {"candidates": 12, "top_k": 8, "min_score": 0.02},
    "grounding": {"answer_threshold": 0.05, "require_citations": True, "require_sentence_citations": False, "verify_answer_claims": True},
    "paper": {"verify_questions": True, "retries": 2, "min_confidence": 0.7},
    "evaluate": {"max_claims": 40},
}


def load_env(path: str) -> None:
    """NAME=value lines; names set in the environment already keep their value."""
    for line in Path(path).read_text().splitlines():
        name, found, value = line.strip().removeprefix("export ").partition("=")
        if found and name and not name.startswith("#"):
            os.environ.setdefault(name.strip(), value.strip().strip("'\""))


def typed(text: str) -> Any:
    """Numbers, booleans, null and JSON as such; anything else stays text."""
    try:
        return json.loads(text.lower() if text.lower() in ("true", "false", "null") else text)
    except ValueError:
        return text


def expand(value: Any) -> Any:
    """``${NAME}`` and ``${NAME:-default}`` filled in; a value that is one reference is typed anew."""
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v) for v in value]
    if not isinstance(value, str) or not _REFERENCE.search(value):
        return value
    filled = _REFERENCE.sub(lambda m: os.environ.get(m[1]) or m[2] or "", value)
    return typed(filled) if _REFERENCE.fullmatch(value) else filled


def parse_overrides(pairs: list[str]) -> dict[str, Any]:
    out = {}
    for p in pairs:
        name, found, value = p.partition("=")
        if not found or not name.strip():
            raise ValueError(f"expected name=value, got {p!r}")
        out[name.strip()] = typed(value.strip())
    return out


class Config:
    def __init__(self, tree: dict[str, Any] | None = None):
        self.tree = expand(copy.deepcopy(DEFAULTS if tree is None else tree))

    @classmethod
    def load(cls, path: str) -> Config:
        text = Path(path).read_text()
        if path.endswith(".json"):
            return cls(json.loads(text))
        import yaml  # only for files in that format

        return cls(yaml.safe_load(text) or {})

    def get(self, name: str, default: Any = None) -> Any:
        node: Any = self.tree
        for part in name.split("."):
            if not isinstance(node, dict) or part not in node:
                return default
            node = node[part]
        return node

    def with_overrides(self, values: dict[str, Any]) -> Config:
        made = Config(self.tree)
        for name, value in values.items():
            node = made.tree
            *path, last = name.split(".")
            for part in path:
                node = node.setdefault(part, {})
            node[last] = value
        return made
