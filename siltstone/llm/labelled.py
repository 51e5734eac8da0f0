"""Labelled rows for the classifiers: one label an id, and the fold rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import held_out

#: Rows whose crc32(id as text) mod FOLDS is HELD are never learned from.
FOLDS, HELD = 5, 0


def training_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, label, fold) of the ids outside the held-out fold; of several labels of an id the largest counts."""
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS
    return (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where("id is not null and label is not null")
        .groupBy("id").agg(F.max("label").alias("label"))
        .withColumn("fold", fold.cast("int")).where(F.col("fold") != HELD)
    )


def held(id_col: str) -> Column:
    return held_out(F.col(id_col), FOLDS, HELD)
