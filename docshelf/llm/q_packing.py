"""Query of the packing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .packing import pack
from .queries import query


@query("op1_retrieval_packing")
def op1_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
