"""Parameters of retrieval, chunking, routing and verification in one place, with a tolerant loader."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class RetrievalConfig:
    vector: bool = True
    bm25: bool = True
    rrf: bool = True
    decomposition: bool = True
    reranker: bool = True
    graph: bool = True
    adaptive_skip: bool = True
    rrf_weights: dict = field(default_factory=lambda: {"bm25": 0.6, "vector": 0.4, "graph": 0.35})
    rrf_k: int = 60
    limit: int = 10
    skip_score: float = 0.03
    skip_candidates: int = 3
    rerank_skip: float = 0.92
    decompose_tokens: int = 15
    decompose_words: int = 3
    chunk_target: int = 1000
    chunk_min: int = 100
    chunk_cap: int = 2000
    research_tokens: int = 500
    chars_a_token: int = 4
    merged_min_chars: int = 200
    split_below: float = 0.70
    cold_start: float = 0.85
    ema_route: float = 0.1
    ema_override: float = 0.2
    gate_threshold: float = 0.70
    gate_margin: float = 0.15
    route_chars: int = 8000
    head_chars: int = 500
    entity_min: int = 2
    entity_max: int = 60
    label_min: int = 20
    label_max: int = 300
    fuzzy_pass: int = 70
    fuzzy_factor: float = 0.55
    min_words: int = 3000
    min_sections: int = 2
    eval_k: int = 10
    recall_k: int = 5
    alert_drop: float = 0.05
    inactive_days: int = 180
    orphan_days: int = 7
    mention_floor: int = 3
    memory_cap: int = 10_000
    memory_keep: int = 8_000
    draft_bytes: int = 50

    @property
    def overfetch(self) -> int:
        return max(40, 4 * self.limit)

    def ablations(self) -> dict[str, RetrievalConfig]:
        """The full configuration, and one with each component switched off."""
        parts = ["vector", "bm25", "rrf", "decomposition", "reranker", "graph"]
        return {"full": self} | {f"no_{p}": dataclasses.replace(self, **{p: False}) for p in parts}


def load_config(text: str | None) -> RetrievalConfig:
    """The configuration of a JSON object laid over the defaults.

    Keys that start with ``$`` are comments, unknown keys are left out, nested weights are merged key by key;
    text that is no JSON object, or a value of a wrong kind, gives the defaults.
    """
    base = RetrievalConfig()
    try:
        got = json.loads(text or "")
        own = {f.name: f for f in fields(RetrievalConfig)}
        put = {}
        for k, v in got.items():
            if k.startswith("$") or k not in own:
                continue
            now = getattr(base, k)
            if isinstance(now, dict):
                put[k] = now | {a: float(b) for a, b in v.items() if not a.startswith("$")}
            elif isinstance(now, bool):
                put[k] = bool(v)
            else:
                put[k] = type(now)(v)
        return dataclasses.replace(base, **put)
    except (ValueError, TypeError, AttributeError):
        return base
