"""Write semantics over keyed tables as joins and windows: upsert, insert-ignore, partial update, fill, replace."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of the largest version for each key; of equal versions the new one."""
    every = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*key).orderBy(F.desc(version), F.desc("_new"))
    return every.withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_new", "_place")


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """``old`` and, for each key it lacks, the first new row by ``order``."""
    first = Window.partitionBy(*key).orderBy(order)
    fresh = new.join(old.select(*key), key, "left_anti").withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place")
    return old.unionByName(fresh)


def partial_update(old: DataFrame, new: DataFrame, key: list[str], column: str) -> DataFrame:
    """All keys of both; ``column`` takes the new value where there is one."""
    joined = old.join(new.select(*key, F.col(column).alias("_new")), key, "full")
    return joined.withColumn(column, F.coalesce("_new", column)).drop("_new")


def fill_missing(rows: DataFrame, siblings: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Blank or null columns take the first non-blank sibling value by ``order``."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    firsts = siblings.groupBy(key).agg(*(F.min_by(c, F.when(blank(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in columns))
    out = rows.join(firsts, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(blank(c), blank(f"_{c}")))
    return out.drop(*(f"_{c}" for c in columns))


def replace_children(old: DataFrame, new: DataFrame, parent: str, text: str, least: int = 30) -> DataFrame:
    """Children of the parents in ``new`` are replaced; contents shorter than ``least`` after trimming are left out."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new.where(F.length(F.trim(text)) >= least))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))).where("_place = 1").drop("_place")


def stamp(df: DataFrame, columns: list[str]) -> tuple[int, str]:
    """Rows and a digest of their contents: two tables with equal stamps hold equal rows."""
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    return n, hashlib.sha256(f"{n}:{total}".encode()).hexdigest()


def save_snapshot(df: DataFrame, path: str, columns: list[str]) -> None:
    """Parquet with its stamp beside it; the stamp is written last, so a broken write is never taken for valid."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    n, digest = stamp(df.sparkSession.read.parquet(f"{path}/data"), columns)
    df.sparkSession.createDataFrame([(n, digest)], "n long, digest string").coalesce(1).write.mode("overwrite").parquet(f"{path}/stamp")


def load_snapshot(live: DataFrame, path: str, columns: list[str]) -> DataFrame | None:
    """The snapshot if its stamp equals that of ``live``, else None."""
    spark = live.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/stamp/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    kept = spark.read.parquet(f"{path}/stamp").first()
    return spark.read.parquet(f"{path}/data") if (kept["n"], kept["digest"]) == stamp(live, columns) else None
