"""Every registered query and its SQL oracle, gathered from the query modules."""

from __future__ import annotations

from ledgerline.plans import cohort, exchange, parsing, ranking, rules, summaries, survival, texts
from ledgerline.plans.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cohort", "exchange", "parsing", "ranking", "rules", "summaries", "survival", "texts"]
