"""All registered queries and their check SQL."""

from __future__ import annotations

from loglathe import session
from loglathe.plans import flow_queries, parser_queries, table_queries

_GROUPS = [parser_queries, flow_queries, table_queries]


def _configured(run):
    """The query in a session with the settings that the jobs are designed for, whatever ran before."""
    return lambda spark, sf_dir: run(session.configure(spark), sf_dir)


QUERIES = {name: _configured(run) for group in _GROUPS for name, run in group.QUERIES.items()}
ORACLES = {name: sql for group in _GROUPS for name, sql in group.ORACLES.items()}
