"""All queries outside the training-data subpackage, and their SQL."""

from __future__ import annotations

from . import gates, jobs, pages, records, repairs, scores, search

PLANS = (search, scores, gates, records, pages, repairs, jobs)
QUERIES = {name: query for plan in PLANS for name, query in plan.QUERIES.items()}
ORACLES = {name: sql for plan in PLANS for name, sql in plan.ORACLES.items()}

if len(QUERIES) != sum(len(plan.QUERIES) for plan in PLANS):
    raise ValueError("two queries have one name")
