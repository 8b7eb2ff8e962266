"""Request streams: quota windows, sliding metrics, and new sentences of arriving documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from foliant.functions.session import importable
from foliant.operators.text import sentences_of
from foliant.sources.store import GrowingTable


def rate_limit_counts(requests: DataFrame, quotas: DataFrame, lateness: str | None = None) -> DataFrame:
    """client, route, start, n, quota, rejected per minute; quotas: route, quota. A batch or, with lateness, a stream."""
    source = requests.withWatermark("ts", lateness) if lateness else requests
    counted = source.join(quotas, "route").groupBy("client", "route", "quota", F.window("ts", "1 minute")).agg(F.count("*").alias("n"))
    return counted.select("client", "route", F.col("window.start").alias("start"), "n", "quota", F.greatest(F.col("n") - F.col("quota"), F.lit(0)).alias("rejected"))


def rate_limit_flags(requests: DataFrame, quotas: DataFrame) -> DataFrame:
    """request_id, accepted of every request of a batch: the first `quota` of a client, route and minute are."""
    order = Window.partitionBy("client", "route", F.window("ts", "1 minute")).orderBy("ts", "request_id")
    return requests.join(quotas, "route").select("request_id", (F.row_number().over(order) <= F.col("quota")).alias("accepted"))


def request_metrics(requests: DataFrame, failed: Column, length: str = "1 hour", slide: str = "30 minutes", lateness: str | None = None, share: float = 0.95) -> DataFrame:
    """route, start, n, errors, error_share, mean_duration, high_duration (the `share` quantile, approximate) per sliding window.

    failed: a condition on a request.
    """
    source = requests.withWatermark("ts", lateness) if lateness else requests
    return source.groupBy("route", F.window("ts", length, slide)).agg(
        F.count("*").alias("n"), F.count_if(failed).alias("errors"), (F.count_if(failed) / F.count("*")).alias("error_share"),
        F.avg("duration").alias("mean_duration"), F.percentile_approx("duration", F.lit(share), F.lit(100_000)).alias("high_duration"),
    ).select("route", F.col("window.start").alias("start"), "n", "errors", "error_share", "mean_duration", "high_duration")


class QuotaFlags(StatefulProcessor):
    """Flags of one client, route and minute: its first `quota` requests by time and id are accepted.

    The state holds the earliest `quota` requests so far and no more. A request that can't be among them any longer is
    rejected at once, whether it comes late or is pushed out by an earlier one that came later; those that are held are accepted
    when the watermark has passed the minute, and the state goes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "requests array<struct<at: bigint, request_id: bigint>>, ends bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.held.get() if self.held.exists() else None
        held = [tuple(x) for x in before[0]] if before else []
        out, ends = [], before[1] if before else None
        for frame in rows:
            if ends is None:
                ends = int(frame["ends"].iloc[0])
                self.handle.registerTimer(ends)
            quota = int(frame["quota"].iloc[0])
            held = sorted([*held, *zip(frame["at"].astype(int).tolist(), frame["request_id"].astype(int).tolist())])
            out += [x[1] for x in held[quota:]]
            held = held[:quota]
        self.held.update((held, ends))
        yield pd.DataFrame({"request_id": pd.Series(out, dtype="int64"), "accepted": False})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [x[1] for x in self.held.get()[0]] if self.held.exists() else []
        self.held.clear()
        yield pd.DataFrame({"request_id": pd.Series(held, dtype="int64"), "accepted": True})

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, quotas: DataFrame, lateness: str) -> DataFrame:
    """rate_limit_flags() of a stream of requests: each request's flag once, the same whatever the order of arrival within
    `lateness`. Requests that come later than that are dropped, as their minute is closed."""
    importable(requests.sparkSession)
    minute = F.window("ts", "1 minute")
    own = requests.withWatermark("ts", lateness).join(F.broadcast(quotas), "route").select(
        "client", "route", "ts", minute["start"].alias("minute"), "request_id", "quota",
        F.unix_micros("ts").alias("at"), F.unix_millis(minute["end"]).alias("ends"),
    )
    return own.groupBy("client", "route", "minute").transformWithStateInPandas(QuotaFlags(), "request_id bigint, accepted boolean", "append", "EventTime")


def sentence_sink(table: GrowingTable) -> Callable[[DataFrame, int], None]:
    """For foreachBatch on a stream of documents (lang, text): appends the sentences that the table (lang, text) has not had in
    an earlier batch, as a version of the batch's number. A batch that is run again adds nothing."""

    def add(docs: DataFrame, batch: int) -> None:
        if batch in table.versions():
            return
        lines = docs.select("lang", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike("\\p{L}"))
        found = lines.select("lang", F.explode(sentences_of(F.col("line"))).alias("text")).groupBy("lang", "text").agg(F.count("*").alias("n"))
        table.append(table.joined(found, "left_anti", before=batch), batch)

    return add


def stream_sentences(docs: DataFrame, table: GrowingTable, checkpoint: str) -> None:
    """Reads what has arrived of a stream of documents into the table; checkpoint: a folder that all executors share."""
    docs.writeStream.foreachBatch(sentence_sink(table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_once(stream: DataFrame, spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """A stream over what has arrived, to Parquet, and the table it leaves; checkpoint: a folder all executors share."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
