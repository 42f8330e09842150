"""The parameters of the core library and their usual values, in one place; operators take them as arguments."""

from __future__ import annotations

from dataclasses import dataclass

from loomwatch.functions import text as tx
from loomwatch.operators import graph, resolve, stories


@dataclass(frozen=True)
class Settings:
    """What a deployment may change."""

    dedup_window_hours: float = stories.HOURS
    dedup_threshold: float = stories.THRESHOLD
    fuzzy_accept: float = resolve.ACCEPT
    fuzzy_review: float = resolve.REVIEW
    source_article_ids_cap: int = graph.CAP
    poll_failure_threshold: int = 6
    first_run_lookback_hours: float = 24.0
    default_credibility: float = 0.5
    benign_domains: tuple[str, ...] = tx.BENIGN
    retry_base_seconds: float = 1.0
    max_receives: int = 5

    @classmethod
    def of(cls, values: dict) -> Settings:
        """From names and texts, as an environment or a configuration table gives them; unknown names are an error."""
        kinds = {"int": int, "float": float}
        known = {f: t for f, t in cls.__annotations__.items()}
        if unknown := sorted(set(values) - set(known)):
            raise ValueError(f"no such parameters: {', '.join(unknown)}")
        convert = lambda name, v: tuple(x.strip() for x in v.split(",")) if name == "benign_domains" and isinstance(v, str) else kinds.get(known[name], lambda x: x)(v)
        return cls(**{k: convert(k, v) for k, v in values.items()})
