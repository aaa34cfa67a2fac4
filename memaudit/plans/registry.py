"""Registry of re-aimed queries: name -> (spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all():
    # importing the plan modules fills the registry
    from memaudit.plans import q_rarity, q_cards, q_scoring, q_significance, q_codes, q_summaries, q_datasets, q_dates, q_text, q_files  # noqa: F401,E501
    return QUERIES, ORACLES
