"""All queries of this library by name, with the SQL that states each in another engine."""

from __future__ import annotations

from . import audit, commands, events, state, streams, text

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _m in (text, commands, events, state, audit, streams):
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL


def flagship(spark, sf_dir):
    return QUERIES["verdict_counts"](spark, sf_dir)
