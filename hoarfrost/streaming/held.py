"""A bounded first-in-first-out store of days in a stream's state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State stores that transformWithState can work with.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "day date, low double, n long"


class RecentDays(StatefulProcessor):
    """Holds the last most days of a key, each with its least value. Rows are closed days, which come in order from batch to batch; the oldest day beyond most is evicted."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """Days are held in order; those that are too many go."""
        held, out = sorted((tuple(x) for x in self.held.get()), key=lambda x: x[0]), []
        for d, low, n in sorted(((r["day"], r["low"], r["n"]) for r in rows), key=lambda x: x[0]):
            held = [*held, (d, low, n)][-self.most :]
            known = [x[1] for x in held if x[1] is not None]
            out.append(Row(key=key[0], day=d, low=low, n=n, n_held=len(held), mean_low=sum(known) / len(known) if known else None, first_held=held[0][0]))
        self.held.put(held)
        return iter(out)

    def close(self) -> None:
        pass


def recent_days(stream: DataFrame, key: str, ts: str, value: str, most: int, late: str = "1 day") -> DataFrame:
    """(key, day, low, n, n_held, mean_low, first_held) for every day of a key that the watermark has passed: its least value, and how many days are held then, their mean, and the oldest one.

    Days are windows, which Spark sums up before the shuffle and gives out once
    the watermark has passed their end; only closed days reach the processor.
    The state of a key is most closed days and those still open, whatever the
    stream's length. Null keys, times and values: rows without a key or a time are left out, a day of
    null values only has no least value. Needs the RocksDB state store (ROCKSDB).
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark(ts, late).where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    days = rows.groupBy(F.window(ts, "1 day").alias("w"), F.col(key).alias("key")).agg(F.min(F.col(value).cast("double")).alias("low"), F.count(F.lit(1)).alias("n"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("w.start") / 86_400).cast("int"))  # whatever the session's time zone
    out = days.select("key", day.alias("day"), "low", "n").groupBy("key").transformWithState(RecentDays(most), f"key {kind}, day date, low double, n long, n_held int, mean_low double, first_held date", "Append", "None")
    return out.withColumnRenamed("key", key)
