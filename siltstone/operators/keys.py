"""Access keys and jobs: look-up, minting, the first admin, job states, polling and liveness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEPALIVE_SECONDS = 3.0


def live(keys: DataFrame) -> DataFrame:
    return keys.where(~F.coalesce("is_revoked", F.lit(False)))


def looked_up(requests: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """``requests`` with the key's record (id, parent_id, is_admin); null for a missing, blank or revoked key."""
    return requests.join(live(keys).where(F.col(key) != "").select(key, "id", "parent_id", "is_admin"), key, "left")


def children(keys: DataFrame) -> DataFrame:
    """(id, children): live keys minted by each live key."""
    minted = live(keys).where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    return live(keys).select("id").join(minted, "id", "left").select("id", F.coalesce("children", F.lit(0)).cast("long").alias("children"))


def mint(requests: DataFrame, keys: DataFrame, request: str = "request", parent: str = "parent_id") -> DataFrame:
    """(request, parent, granted, key): an admin mints without end, another live key has one live child at most.

    Of several requests of a key the first by ``request`` is served.  The new key is random, so only granted rows have one.
    """
    able = live(keys).select(F.col("id").alias(parent), "is_admin").join(children(keys).select(F.col("id").alias(parent), "children"), parent)
    rows = requests.join(able, parent, "left").withColumn("turn", F.row_number().over(Window.partitionBy(parent).orderBy(request)))
    granted = F.coalesce(F.col("is_admin") | (F.col("children") + F.col("turn") <= 1), F.lit(False))
    return rows.select(request, parent, granted.alias("granted")).withColumn("key", F.when(F.col("granted"), F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))))


def bootstrap(keys: DataFrame, admin: DataFrame) -> DataFrame:
    """``keys`` and, if they hold no live admin, the row ``admin``."""
    held = live(keys).where("is_admin").select(F.lit(1).alias("_one")).limit(1)
    return keys.unionByName(admin.withColumn("_one", F.lit(1)).join(held, "_one", "left_anti").drop("_one"))


def job_states(updates: DataFrame, job: str, order: str) -> DataFrame:
    """(job, status, stage, payload, error, created): updates (status, stage, payload, error, ts) merged in order; a job begins pending.

    A null says nothing about its field; done and error are final, so later updates do not count.
    """
    final = F.min(F.when(F.col("status").isin("done", "error"), F.col(order)))
    rows = updates.withColumn("_end", final.over(Window.partitionBy(job))).where(F.col("_end").isNull() | (F.col(order) <= F.col("_end")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return rows.groupBy(job).agg(F.coalesce(last("status"), F.lit("pending")).alias("status"), last("stage"), last("payload"), last("error"), F.min("ts").alias("created"))


def polled(requests: DataFrame, jobs: DataFrame, job: str, now: str, ttl_seconds: int) -> DataFrame:
    """``requests`` with the code and state of their job: 200, or 404 for one that is unknown or older than ``ttl_seconds``."""
    joined = requests.join(jobs.withColumn("_known", F.lit(True)), job, "left")
    alive = F.coalesce(F.col("_known") & (F.timestamp_diff("MICROSECOND", F.col("created"), F.col(now)) <= ttl_seconds * 1_000_000), F.lit(False))
    shown = [F.when(alive, F.col(c)).alias(c) for c in jobs.columns if c not in (job, "created")]
    return joined.select(*requests.columns, F.when(alive, 200).otherwise(404).alias("code"), *shown)


def keepalives(events: DataFrame, key: str, ts: str, order: str, seconds: float = KEEPALIVE_SECONDS) -> DataFrame:
    """(key, order, beats): how many signs of life a silence before an event needs, one every ``seconds``."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts, order))
    silence = F.timestamp_diff("MICROSECOND", before, F.col(ts)) / 1e6
    return events.select(key, order, F.coalesce(F.greatest(F.ceil(silence / seconds) - 1, F.lit(0)), F.lit(0)).cast("long").alias("beats"))
