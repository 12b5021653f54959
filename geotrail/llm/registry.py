"""The queries of the text problems 6 to 8."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geotrail.llm.encode import token_ids
from geotrail.llm.leaks import leaked_passages
from geotrail.llm.reading import reading_bands


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return token_ids(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item, with the item."""
    found = leaked_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.where("edits = 0").select("doc_id", "item_id")


def p7_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item with at most two edited characters, with the item and the edits."""
    return leaked_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), max_edits=2)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading band of every document with enough prose."""
    return reading_bands(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "graded_texts"))


QUERIES = {"p6_ids": p6_ids, "p7_found": p7_found, "p7_edited": p7_edited, "p8_found": p8_found}
ORACLES: dict[str, str] = {}


def queries() -> dict[str, Callable]:
    """Name to ``(spark, sf_dir) -> DataFrame``."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name to SQL over the same tables; whole texts are beyond SQL here, so the tests hold them against brute force."""
    return dict(ORACLES)
