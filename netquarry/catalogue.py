"""All queries of the engine, by name, and the SQL that they are held against."""

from __future__ import annotations

from netquarry.plans import queries_a, queries_b, queries_c, queries_d, queries_e

FLAGSHIP = "eval_label_metrics"
QUERIES = {**queries_a.QUERIES, **queries_b.QUERIES, **queries_c.QUERIES, **queries_d.QUERIES, **queries_e.QUERIES}
ORACLE = {**queries_a.ORACLE, **queries_b.ORACLE, **queries_c.ORACLE, **queries_d.ORACLE, **queries_e.ORACLE}
