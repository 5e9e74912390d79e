"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from . import chapter_queries, layout_queries, learning_queries, lesson_queries, metering_queries, reading_queries, streaming_queries, structure_queries, text_queries

MODULES = (text_queries, structure_queries, metering_queries, learning_queries, layout_queries, reading_queries, chapter_queries, streaming_queries, lesson_queries)


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
