"""Streaming form of the grid snapshot and the level-1 order flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.sinks import work_folder


def read_stream(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    """Stream of the parquet files of a folder whose names match ``pattern``."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def stream_snap(df: DataFrame, keys: list[str], step_s: int, delay: str) -> DataFrame:
    """Last row per key and time bin over a stream with ``us``.

    ``delay`` is how far rows may be out of order; later ones cannot be used, as their bin's
    state is gone, and ``late_rows`` of the running query counts them.  State is one row of
    primitives per key and open bin, whatever the arrival rate.
    """
    rest = [c for c in df.columns if c not in (*keys, "ts", "d", "ep", "us")]
    timed = df.withColumn("event_time", F.timestamp_micros("us")).withWatermark("event_time", delay)
    bins = timed.groupBy(*keys, F.window("event_time", f"{step_s} seconds").alias("bin"))
    out = bins.agg(*[F.max_by(c, "us").alias(c) for c in rest], F.max("us").alias("us"))
    return out.withColumn("ep", F.unix_seconds(F.col("bin.start"))).drop("bin")


FLOW_SCHEMA = "key string, ep long, bof_1 double, aof_1 double"
STATE_SCHEMA = "day long, bid double, bid_size double, ask double, ask_size double"


def stream_flow(snapped: DataFrame, key: str) -> DataFrame:
    """Bid and ask order flow of level 1 against the previous row of the same key and day.

    The state is the last quote of each key; rows of a micro-batch are ordered in time,
    and closed bins arrive in time order.
    """
    def step(name, batches, state):
        import numpy as np
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values("ep", kind="stable")
        quote = rows[["l1_bid_price", "l1_bid_size", "l1_ask_price", "l1_ask_size"]].to_numpy(float)
        day = (rows["ep"] // 86_400).to_numpy()
        first = state.get if state.exists else (-1, np.nan, np.nan, np.nan, np.nan)
        prev = np.vstack([np.array(first[1:], float), quote[:-1]])
        prev[np.append([first[0]], day[:-1]) != day] = np.nan
        bid, bid_size, ask, ask_size = quote.T
        bid0, size0, ask0, asize0 = prev.T
        bof = np.select([bid > bid0, bid == bid0, bid < bid0], [bid_size, bid_size - size0, -size0], np.nan)
        aof = np.select([ask > ask0, ask == ask0, ask < ask0], [-asize0, ask_size - asize0, ask_size], np.nan)
        state.update((int(day[-1]), *map(float, quote[-1])))
        yield pd.DataFrame({"key": name[0], "ep": rows["ep"].to_numpy(), "bof_1": bof, "aof_1": aof})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return snapped.groupBy(key).applyInPandasWithState(step, FLOW_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def late_rows(query) -> int:
    """Rows that a query's stateful operators found behind the watermark so far."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)


def run_to_table(stream: DataFrame, mode: str, allow_late: bool = False) -> DataFrame:
    """Run a stream over the data present and return all emitted rows with their ``epoch``.

    Each micro-batch overwrites its own folder, so a repeated batch changes nothing.
    """
    spark = stream.sparkSession
    root = work_folder(spark)

    def write(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")

    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state")
         .trigger(availableNow=True).foreachBatch(write).start())
    q.awaitTermination()
    if (late := late_rows(q)) and not allow_late:
        raise ValueError(f"{late} rows were later than the delay; give stream_snap a longer one")
    return spark.read.schema(stream.schema.add("epoch", "long")).parquet(f"{root}/out")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Last emitted version of each key of an update stream."""
    rest = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "epoch").alias(c) for c in rest])
