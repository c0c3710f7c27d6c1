"""All registered queries and their checking SQL."""

from __future__ import annotations

from scholarweave.plans import builders, graph, ingest, search, serving, streams

AREAS = (builders, ingest, search, graph, serving, streams)


def queries():
    return {name: run for area in AREAS for name, run in area.QUERIES.items()}


def oracle_sql():
    return {name: text for area in AREAS for name, text in area.SQL.items()}
