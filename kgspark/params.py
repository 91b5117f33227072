"""Default parameters of the note graph and its evaluation (fixed values where results depend on them).

``settings`` gives those that a deployment may change, from the environment.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

TOP_K, SEARCH_THRESHOLD = 5, 0.3
LINK_THRESHOLD, DELETE_THRESHOLD = 0.5, 0.35
RELATED_LIMIT, ENTITY_LATEST, TYPE_LATEST = 10, 20, 30
MAX_TAGS, CONTEXT_ENTITIES, CONTEXT_PATHS = 5, 10, 5
SEMANTIC_THRESHOLD = 0.75
RELEVANT, BORDERLINE = 0.60, 0.45
KS = (3, 5, 7)
ACTIONS = ("new_root", "child_of", "update_of")
THOUGHT_TYPES = ("fact", "idea", "action", "decision", "risk", "question", "context", "definition")
LINKER_WEIGHTS = {"action_accuracy": 0.35, "depth_consistency": 0.20, "child_precision": 0.20, "structure_similarity": 0.15, "action_kl": 0.10}


@dataclass(frozen=True)
class Settings:
    """Parameters a deployment may change; passed to the operators, which default to the values here."""

    top_k: int = TOP_K
    search_threshold: float = SEARCH_THRESHOLD
    link_threshold: float = LINK_THRESHOLD
    delete_threshold: float = DELETE_THRESHOLD
    related_limit: int = RELATED_LIMIT
    context_hops: int = 1
    entity_latest: int = ENTITY_LATEST
    type_latest: int = TYPE_LATEST
    max_tags: int = MAX_TAGS
    semantic_threshold: float = SEMANTIC_THRESHOLD


def settings(env: Mapping[str, str] | None = None, prefix: str = "KGSPARK_") -> Settings:
    """Settings with what the environment says in upper case under ``prefix``; a value of the wrong kind is an error."""
    env = os.environ if env is None else env
    kinds = {"int": int, "float": float}
    said = {f.name: kinds[str(f.type)](env[prefix + f.name.upper()]) for f in fields(Settings) if env.get(prefix + f.name.upper())}
    return Settings(**said)
