"""Loads every module that registers queries."""

import corpus_pipeline
from nearby_engine.llm import queries_free, queries_native, queries_texts  # noqa: F401
from nearby_engine.llm.registry import ORACLES, QUERIES, register

register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["ORACLES", "QUERIES"]
