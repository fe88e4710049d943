"""Words, table access and the shared checkpoint folder of the operators in this subpackage."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..shared import shared_folder

#: A word is a maximal run of characters that are not ASCII white space.
WORD_BREAK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Words of a text in order; an empty array for null, empty and blank texts."""
    body = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WORD_BREAK))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame in the checkpoint folder that all executors share."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
