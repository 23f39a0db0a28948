"""Streaming operators run over a driver table as a finite stream, for checking."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.queries import ORACLES, query
from . import stateful


def _drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows a stream gives until its input is used up, written as files and read back."""
    spark = stream.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    path = f"{shared or tempfile.mkdtemp(prefix='lattice-stream-')}/{uuid.uuid4().hex}"
    out, kept = f"{path}/rows", {"append": "append", "complete": "overwrite"}[mode]
    spark.createDataFrame([], stream.schema).write.parquet(out)
    sink = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(lambda df, _: df.write.mode(kept).parquet(out))
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d)


@query(ORACLES["rate_control_scan"])
def stream_rate_control(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("user_id", "event_id", (F.floor("value").cast("double") * 655360).alias("complexity"))
    return _drain(stateful.rate_control(rows, "user_id", "event_id", "complexity", 500))


@query(
    """WITH RECURSIVE o AS (SELECT user_id, event_id, event_id % 7 = 0 AS intra, floor(value)::BIGINT - 50 AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT user_id, 0::BIGINT AS frame, 0::BIGINT AS n, 0::BIGINT AS buffer FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT o.user_id, o.event_id, o.n, least(greatest(CASE WHEN o.intra THEN o.r ELSE s.buffer + o.r END, -32768), 32767) FROM s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1)
SELECT user_id, frame, buffer FROM s WHERE n > 0"""
)
def stream_temporal_sums(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("user_id", F.col("event_id").alias("frame"), (F.col("event_id") % 7 == 0).alias("intra"), (F.floor("value") - 50).cast("bigint").alias("r"))
    return _drain(stateful.temporal_sums(rows, "user_id", "frame", "intra", "r"))


@query(ORACLES["poc_reorder"])
def stream_poc_reorder(spark: SparkSession, d: str) -> DataFrame:
    """Pictures in one stream, units in another: groups of eight events are written backwards."""
    events = _events(spark, d)
    eight = F.call_function("div", F.col("event_id"), F.lit(8))
    from pyspark.sql import Window

    # Places come from the batch table, as a stream cannot number its rows.
    w = Window.partitionBy("user_id")
    batch = spark.read.parquet(f"{d}/events.parquet")
    places = batch.select("event_id", (F.row_number().over(w.orderBy("event_id")) - 1).cast("long").alias("poc"), (F.row_number().over(w.orderBy(eight, F.desc("event_id"))) - 1).cast("long").alias("decode_idx"))
    rows = events.join(places, "event_id").select("user_id", "poc", "decode_idx", F.length("props").cast("long").alias("size"))
    none = F.lit(None).cast("long")
    both = rows.select("user_id", F.explode(F.array(F.struct(F.col("decode_idx"), "poc", none.alias("size")), F.struct(none.alias("decode_idx"), "poc", "size"))).alias("r"))
    return _drain(stateful.reorder(both.select("user_id", "r.*"), "user_id", "decode_idx", "poc", "size"))


@query("SELECT event_id // 10 AS gop, count(*) AS rows, sum(length(props))::BIGINT AS total FROM events GROUP BY 1")
def stream_gop_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select(F.col("event_id").alias("frame"), F.length("props").cast("bigint").alias("size"))
    return _drain(stateful.gop_totals(rows, "frame", 10, "size"), "complete")
