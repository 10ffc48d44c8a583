"""All registered queries and their SQL, collected from the plan modules."""

from __future__ import annotations

from cohortry.plans import (harmonize_plans, model_plans, output_plans, prep_plans, ranking_plans,
                            text_plans, token_plans)

_MODULES = [ranking_plans, harmonize_plans, prep_plans, text_plans, output_plans, model_plans,
            token_plans]

QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
assert len(QUERIES) == sum(len(m.QUERIES) for m in _MODULES), "two queries share a name"
