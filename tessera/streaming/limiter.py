"""Rate limits per client, in batch and as a stream, and continuous ingest."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Requests, window, and the calls that are charged.
CAPACITY, WINDOW_SECONDS = 20, 60
CHARGED = r"^/api/collections(/[^/]+/(documents|query))?/?$"


@dataclass
class Bucket:
    """Tokens of one client. Time is in nanoseconds; a token comes back every
    ``window / capacity`` of it, progress towards one carries over, and time
    spent full earns nothing."""

    tokens: int
    credited: int

    def take(self, now: int, capacity: int, interval: int) -> int:
        """0 if allowed, else the nanoseconds until a token is there."""
        earned = max(0, now - self.credited) // interval
        if earned:
            full = self.tokens + earned >= capacity
            self.tokens = min(capacity, self.tokens + earned)
            self.credited = now if full else self.credited + earned * interval
        if self.tokens:
            self.tokens -= 1
            return 0
        return max(1, self.credited + interval - now)


def refill_interval(capacity: int, window_seconds: float) -> int:
    return max(1, int(window_seconds * 1_000_000_000) // capacity)


def charged(requests: DataFrame) -> DataFrame:
    """The calls that cost a token: uploads and questions."""
    return requests.filter((F.upper("method") == "POST") & F.col("path").rlike(CHARGED))


RESULT = "request_id bigint, client string, ts timestamp, allowed boolean, retry_after_s bigint"


def limit_requests(requests: DataFrame, capacity: int = CAPACITY, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Each request (request_id, client, ts) with its verdict, by the clients'
    requests in order of time. One client's requests are handled in one task, as
    each depends on the one before, but are read in order and not held. Rows
    without a client or a time are left out."""
    interval = refill_interval(capacity, window_seconds)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, bucket = None, None
        for part in parts:
            out = []
            for rid, who, ts in zip(part["request_id"], part["client"], part["ts"]):
                now = ts.value
                if who != client:
                    client, bucket = who, Bucket(capacity, now)
                wait = bucket.take(now, capacity, interval)
                out.append((rid, who, ts, wait == 0, math.ceil(wait / 1e9)))
            yield pd.DataFrame(out, columns=["request_id", "client", "ts", "allowed", "retry_after_s"])

    rows = requests.select("request_id", "client", "ts").filter("client is not null and ts is not null")
    return rows.repartition("client").sortWithinPartitions("client", "ts", "request_id").mapInPandas(run, RESULT)


def limit_stream(requests: DataFrame, capacity: int = CAPACITY, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """The same over a stream; a client idle for a window is forgotten, which
    changes nothing, as its bucket would be full."""
    interval = refill_interval(capacity, window_seconds)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = Bucket(*state.get) if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["ts", "request_id"])
        out = []
        for rid, ts in zip(rows["request_id"], rows["ts"]):
            bucket = bucket or Bucket(capacity, ts.value)
            wait = bucket.take(ts.value, capacity, interval)
            out.append((rid, key[0], ts, wait == 0, math.ceil(wait / 1e9)))
        state.update((bucket.tokens, bucket.credited))
        state.setTimeoutDuration(max(1, int(window_seconds * 1000)))
        yield pd.DataFrame(out, columns=["request_id", "client", "ts", "allowed", "retry_after_s"])

    return requests.select("request_id", "client", "ts").filter("client is not null and ts is not null").groupBy("client").applyInPandasWithState(run, RESULT, "tokens long, credited long", "append", "ProcessingTimeTimeout")


def ingest_stream(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str, schema: str = "path string, modificationTime timestamp, length bigint, content binary"):
    """Files that arrive in a folder, batch by batch to ``handle``."""
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
