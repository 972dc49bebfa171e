"""Receipts of what arrives: the first of each digest, its repeats, and late rows, with state by digest.

A row is a receipt if its digest is new or was last seen longer than ``horizon``
before; otherwise a repeat; or late, if it is further than ``delay`` behind the
newest row of its digest that came before it. Rows are taken in the order of their
arrival numbers, so the outcome does not depend on how they fall into batches, and
``classified`` gives the same for a table. What one digest leaves behind is one
number, and a timer forgets it once the watermark has passed its horizon: whatever
is not dropped after that is a receipt again. Rows behind the watermark never come
to the state; ``dropped`` counts them. A stream that is to lose no row has no
watermark and forgets nothing. Digests share the state's keys by their hash, so a
batch calls Python once for each of ``BUCKETS``, however many digests it holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

RECEIPT, REPEAT, LATE = "receipt", "repeat", "late"
SCHEMA = "digest string, seq bigint, ts timestamp, status string"
#: Keys of the state; a checkpoint goes on only with the number it began with.
BUCKETS = 1024
#: What a bucket keeps: its digests, and the newest time of each in microseconds.
_KEPT = pa.schema([("digest", pa.string()), ("at", pa.int64())])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ready(rows: DataFrame, digest: Column, seq: str, ts: str) -> DataFrame:
    return rows.select(digest.cast("string").alias("digest"), F.col(seq).cast("bigint").alias("seq"), F.col(ts).cast("timestamp").alias("ts")).where("digest is not null and seq is not null and ts is not null")


def classified(rows: DataFrame, digest: Column, seq: str, ts: str, horizon: int, delay: int) -> DataFrame:
    """(digest, seq, ts, status) of a table; ``horizon`` and ``delay`` are seconds. Rows without digest, number or time have none."""
    newest = F.max(F.unix_micros("ts")).over(Window.partitionBy("digest").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    gone = F.unix_micros("ts") - newest
    status = F.when(newest.isNull() | (gone > horizon * 1_000_000), RECEIPT).when(gone < -delay * 1_000_000, LATE).otherwise(REPEAT)
    return _ready(rows, digest, seq, ts).withColumn("status", status)


class _Receipts(StatefulProcessor):
    """Keeps the newest time of each digest of a bucket."""

    def __init__(self, horizon: int, delay: int, forget: bool) -> None:
        self.horizon, self.delay, self.forget = horizon * 1_000_000, delay * 1_000_000, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("kept", "rows binary")

    def _kept(self) -> pd.Series:
        if not self.state.exists():
            return pd.Series(np.array([], np.int64), pd.Index([], dtype=object))
        rows = pa.ipc.open_stream(bytes(self.state.get()[0])).read_all()
        return pd.Series(rows["at"].to_numpy(), pd.Index(rows["digest"].to_pandas(), dtype=object))

    def _keep(self, kept: pd.Series) -> None:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, _KEPT) as stream:
            stream.write_table(pa.table([pa.array(kept.index, pa.string()), pa.array(kept.to_numpy(), pa.int64())], schema=_KEPT))
        self.state.update((out.getvalue().to_pybytes(),))

    def _wake(self, kept: pd.Series) -> None:
        """One timer, for the digest that is forgotten first."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(kept):
            self.handle.registerTimer(int((kept.min() + self.horizon) // 1000 + 1))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        """Rows of a bucket in one batch, which the trigger bounds."""
        new = pd.concat(list(rows), ignore_index=True)
        codes, digests = pd.factorize(new["digest"])
        order = np.lexsort((new["seq"].to_numpy(), codes))
        new, codes = new.iloc[order], codes[order]
        at = new["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        kept, lowest = self._kept(), np.iinfo(np.int64).min // 2
        before = kept.reindex(digests, fill_value=lowest).to_numpy()
        newest = pd.Series(at).groupby(codes).cummax().to_numpy()
        first = np.concatenate(([True], codes[1:] != codes[:-1]))
        gone = at - np.maximum(before[codes], np.where(first, lowest, np.concatenate(([lowest], newest[:-1]))))
        status = np.where(gone > self.horizon, RECEIPT, np.where(gone < -self.delay, LATE, REPEAT))
        last = np.concatenate((first[1:], [True]))
        now = pd.Series(np.maximum(before, newest[last]), pd.Index(digests, dtype=object))
        kept = pd.concat([kept[~kept.index.isin(now.index)], now])
        self._keep(kept)
        if self.forget:
            self._wake(kept)
        yield pd.DataFrame({"digest": new["digest"].to_numpy(), "seq": new["seq"].to_numpy(), "ts": new["ts"].to_numpy(), "status": status})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        kept = self._kept()
        kept = kept[(kept + self.horizon) // 1000 + 1 > timerValues.getCurrentWatermarkInMs()]
        if len(kept):
            self._keep(kept)
        else:
            self.state.clear()
        self._wake(kept)
        return iter(())

    def close(self) -> None:
        pass


def receipts(rows: DataFrame, digest: Column, seq: str, ts: str, horizon: int, delay: int, forget: bool = True) -> DataFrame:
    """As ``classified``, of a stream: each row once, when it arrives.

    Without ``forget`` there is no watermark: no row is dropped, however far behind,
    and the state keeps a number for every digest there ever was.
    """
    ready = _ready(rows, digest, seq, ts).withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(BUCKETS)).cast("int"))
    if forget:
        ready = ready.withWatermark("ts", f"{delay} seconds")
    return ready.groupBy("bucket").transformWithStateInPandas(_Receipts(horizon, delay, forget), SCHEMA, "Append", "EventTime" if forget else "None")


def append(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a table, with the state in a store that is snapshot to the checkpoint."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    old = conf.get(name, None)
    conf.set(name, PROVIDER)
    try:
        return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if old is None:
            conf.unset(name)
        else:
            conf.set(name, old)


def dropped(query: StreamingQuery) -> int:
    """Rows of a query's recent batches that came behind the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def replay(table: DataFrame, order: str, folder: str, parts: int, run: Callable[[DataFrame], StreamingQuery]) -> None:
    """The rows of a table as they would have arrived: written in so many steps by ``order``, each taken up by ``run`` as one batch.

    ``run`` starts a query over the stream of the folder that ends when it has taken
    what is there, and goes on from its checkpoint. A step is a batch whatever number
    of files it has, so no file of a step overtakes another.
    """
    spark, cuts = table.sparkSession, table.stat.approxQuantile(order, [k / parts for k in range(1, parts)], 0.01)
    edges = [None, *sorted(set(cuts)), None]
    for low, high in zip(edges, edges[1:], strict=False):
        own = table if low is None else table.where(F.col(order) > low)
        (own if high is None else own.where(F.col(order) <= high)).write.mode("append").parquet(folder)
        run(spark.readStream.schema(table.schema).parquet(folder)).awaitTermination()
