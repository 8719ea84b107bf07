"""Queries of the engine by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kilojoin.plans import flow_queries, further_queries, mix_queries, optimise_queries, pattern_queries, segment_queries, sequence_queries, signal_queries, table_queries  # noqa: F401
from kilojoin.plans.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["section_energy"](spark, sf_dir)
