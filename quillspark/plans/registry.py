"""All relational queries and their DuckDB twins by name."""

from quillspark.plans import catalog, changes, grouping, joins, reports, scalar, selection

PLANS = [m.P for m in (selection, joins, grouping, scalar, changes, reports, catalog)]
QUERIES = {name: query for p in PLANS for name, query in p.queries.items()}
ORACLE = {name: text for p in PLANS for name, text in p.oracle.items()}
assert len(QUERIES) == sum(len(p.queries) for p in PLANS), "two queries have one name"
