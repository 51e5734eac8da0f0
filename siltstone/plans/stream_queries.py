"""Registered queries that stream ``events`` in three arrivals, each a run that goes on from the checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.registry import ORACLES, query
from siltstone.sources.store import shared_folder
from siltstone.streaming import processors

ARRIVALS = 3


def arrived(t, rows: DataFrame, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``process`` gives of ``rows`` (with ts), which arrive by time; a last run finds nothing new and adds nothing."""
    folder = f"{shared_folder(t.spark)}/siltstone/streams/{uuid.uuid4().hex}"
    own = processors.with_state_store(t.spark)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    share = F.least(F.floor((F.unix_micros("ts") - low) * ARRIVALS / max(1, (high or 0) - (low or 0))), F.lit(ARRIVALS - 1)) if low is not None else F.lit(0)
    for k in range(ARRIVALS + 1):
        if k < ARRIVALS:
            rows.where(share == k).write.mode("append").parquet(f"{folder}/in")
        stream = own.readStream.schema(rows.schema).parquet(f"{folder}/in")
        processors.run_available(process(stream.withWatermark("ts", "1 hour")), f"{folder}/out", f"{folder}/checkpoint")
    return t.spark.read.parquet(f"{folder}/out")


def key_cache_stream(t):
    """As ``key_cache_invalidate``, by a value state and timers."""
    what = F.when(F.col("event_type") == "purchase", "invalidate").when(F.col("event_type") == "error", "missing").otherwise("")
    rows = t("events").select("user_id", "event_id", "ts", what.alias("what"))
    return arrived(t, rows, lambda s: processors.key_cache_stream(s, "user_id", "ts", "event_id", "what", 43200))


def job_store_stream(t):
    """As ``job_store``, by a map state; of a job's rows the last one counts."""
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error")
    none = F.lit(None).cast("string")
    rows = t("events").select("user_id", "event_id", "ts", F.col("event_type").alias("stage"), status.alias("status"), none.alias("payload"), none.alias("error"))
    states = arrived(t, rows, lambda s: processors.job_stream(s, "user_id", "ts", "event_id"))
    last = states.groupBy("user_id").agg(F.max_by(F.struct("status", "stage"), "upto").alias("s"))
    return last.select("user_id", "s.status", "s.stage")


def keepalive_stream(t):
    """As ``keepalive_beats``, by a value state."""
    rows = t("events").select("user_id", "event_id", "ts")
    return arrived(t, rows, lambda s: processors.keepalive_stream(s, "user_id", "ts", "event_id", 3600)).select("event_id", "beats")


for _stream, _batch in ((key_cache_stream, "key_cache_invalidate"), (job_store_stream, "job_store"), (keepalive_stream, "keepalive_beats")):
    query(ORACLES[_batch])(_stream)
