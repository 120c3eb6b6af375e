"""All registered queries outside the subpackage ``llm``."""

from __future__ import annotations

from tidemark.plans import basics, datasets, dealt, evaluation, modelling, more, relational

REGISTRIES = (relational.R, modelling.R, more.R, basics.R, datasets.R, evaluation.R)
QUERIES = dealt.QUERIES | {k: f for r in REGISTRIES for k, f in r.queries.items()}
SQL = dealt.SQL | {k: s for r in REGISTRIES for k, s in r.sql.items()}
