"""What the training-data operators share: words, settled tables, free column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.functions.lineage import remove, settle, shared_dir

__all__ = ["documents", "free_name", "remove", "settle", "shared_dir", "word_count", "words"]

#: Words are maximal runs of anything but space and the ASCII controls 9 to 13.
GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; null for a null text, empty for a text without words."""
    return F.array_remove(F.split(text, GAP, -1), "")


def word_count(text: Column) -> Column:
    """Number of words as long; 0 for null and for a text without words."""
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def free_name(df: DataFrame, wish: str) -> str:
    """wish, with underscores in front as long as df has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
