"""Streams: scoring as results arrive, and stopping a training by its metric series."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.relate import shared_folder
from ..plans.evaluate import scored
from ..sources.readers import metric_hits

STATE = "best double, stale int, seen int, reason string"


def append(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Rows written as JSON lines; the checkpoint makes a stopped stream go on where it was."""
    writer = rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def score_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Results scored one by one; progress is the query's own."""
    return append(scored(rows), path, checkpoint)


def early_stops(rows: DataFrame, group: str, seq: str, value: str, target: float = 0.95, patience: int = 2, epsilon: float = 0.001) -> DataFrame:
    """After each batch, the state of each group's series: best, stale rounds, values seen, reason to stop.

    The state is four numbers a group; values of a batch are taken in the order of ``seq``.
    """
    kind = rows.schema[group].dataType.simpleString()

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, stale, seen, reason = state.get if state.exists else (None, 0, 0, None)
        for v in pd.concat(list(batches)).sort_values(seq)[value]:
            if reason:
                break
            seen += 1
            if best is None or v >= best + epsilon:
                best, stale = float(v), 0
            else:
                stale += 1
            reason = "target" if best >= target else "no improvement" if stale >= patience else None
        state.update((best, stale, seen, reason))
        yield pd.DataFrame({group: [key[0]], "best": [best], "stale": [stale], "seen": [seen], "reason": [reason]})

    return rows.select(group, seq, value).groupBy(group).applyInPandasWithState(step, f"`{group}` {kind}, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


class MetricWatch(StatefulProcessor):
    """One log's watch: which pattern has matched, how many values each has given, and the series so far.

    A trigger is one look at the log. It takes the values that are new since the last look, and
    only then asks whether the series has ended, as a watch that wakes from time to time does.
    Once a line names the current metric, only such lines count, and places already looked at
    stay looked at. A timer ends a watch at its deadline.
    """

    def __init__(self, key: str, target: float, patience: int, epsilon: float, deadline_ms: int | None) -> None:
        self.key, self.target, self.patience, self.epsilon, self.deadline_ms = key, target, patience, epsilon, deadline_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("watch", WATCH)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            named, plain, looked, best, stale, reason = self.state.get()
        else:
            named, plain, looked, best, stale, reason = 0, 0, 0, None, 0, None
            if self.deadline_ms is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.deadline_ms)
        lines = pd.concat(list(rows)).sort_values("place")
        kept = []  # (place among its kind, value), of either kind
        for own, all_ in zip(lines["named"], lines["plain"], strict=True):
            for kind, values in ((True, own), (False, all_)):
                for v in values:
                    kept.append((kind, named if kind else plain, float(v)))
                    named, plain = named + kind, plain + (not kind)
        if not reason:
            for _, place, v in sorted(k for k in kept if k[0] == (named > 0)):
                if place < looked:
                    continue
                looked = place + 1
                best, stale = (v, 0) if best is None or v >= best + self.epsilon else (best, stale + 1)
            reason = "target" if best is not None and best >= self.target else "no improvement" if stale >= self.patience else None
        self.state.update((named, plain, looked, best, stale, reason))
        yield pd.DataFrame({self.key: [key[0]], "best": [best], "stale": [stale], "seen": [looked], "reason": [reason]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        named, plain, looked, best, stale, reason = self.state.get()
        if reason:
            return
        self.state.update((named, plain, looked, best, stale, "deadline"))
        yield pd.DataFrame({self.key: [key[0]], "best": [best], "stale": [stale], "seen": [looked], "reason": ["deadline"]})

    def close(self) -> None:
        pass


WATCH = "named long, plain long, looked long, best double, stale int, reason string"


def watch_logs(lines: DataFrame, source: str, order: str, target: float = 0.95, patience: int = 2, epsilon: float = 0.001, deadline: float | None = None) -> DataFrame:
    """The state of the watch over each log of a stream of ``lines`` (value), after each trigger that has lines of it.

    ``order`` gives the order of a log's lines within a trigger; ``deadline`` are the seconds after
    the first line at which a watch ends. The state store is RocksDB's, which this kind of state needs.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = lines.schema[source].dataType.simpleString()
    hits = lines.select(source, F.col(order).alias("place"), metric_hits(F.col("value")).alias("h")).select(source, "place", "h.named", "h.plain")
    watch = MetricWatch(source, target, patience, epsilon, None if deadline is None else int(deadline * 1000))
    schema = f"`{source}` {kind}, best double, stale int, seen long, reason string"
    return hits.groupBy(source).transformWithStateInPandas(watch, schema, "update", "None" if deadline is None else "ProcessingTime")


class FirstWins(StatefulProcessor):
    """Of each key the order of the row that leads; a row is passed on when it takes the lead."""

    def __init__(self, names: list[str], order: list[str], state: str) -> None:
        self.names, self.order, self.schema = names, order, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("lead", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        place = tuple(x.item() if hasattr(x, "item") else x for x in batch[self.order].iloc[0])
        if not self.state.exists() or place < tuple(self.state.get()):
            self.state.update(place)
            yield batch[self.names].iloc[:1]

    def close(self) -> None:
        pass


def first_wins_stream(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """W5 on chunks as they arrive: a key's row whenever it is earlier in ``order`` than all of the key before.

    The state is a key's order alone. Whatever the order of arrival, of all rows passed on the
    earliest of each key (``relate.first_wins``) are those of the batch manifest. Names begin with
    no underscore; ``order`` has no nulls; rows of a null key are one key's.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    state = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in order)
    return rows.groupBy(key).transformWithStateInPandas(FirstWins(rows.columns, order, state), rows.schema, "update", "None")


class StatusFiles(StreamingQueryListener):
    """The state of each streaming query as a JSON file of its name, or its id, and a marker when it has ended.

    The file has when it began, the last batch, rows in all, observed counters, whether it runs,
    ended or failed, and why. Files are written whole by Spark's file system, from the driver; a
    reader sees the state before or after, as they are renamed into place.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.hadoop, self.folder, self.now = spark._jvm, spark._jsc.hadoopConfiguration(), folder, {}

    def _write(self, name: str, text: str) -> None:
        path = self.jvm.org.apache.hadoop.fs.Path
        files, part, to = path(self.folder).getFileSystem(self.hadoop), path(f"{self.folder}/.{name}.part"), path(f"{self.folder}/{name}")
        out = files.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        files.delete(to, False)
        files.rename(part, to)

    def _update(self, key: str, **more) -> dict:
        state = self.now.setdefault(key, {"rows": 0})
        state |= more
        self._write(f"{state.get('name') or state['id']}.json", json.dumps(state, default=str))
        return state

    def onQueryStarted(self, event) -> None:
        self._update(str(event.runId), id=str(event.id), run=str(event.runId), name=event.name, state="running", began=event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = self.now.get(str(p.runId), {}).get("rows", 0) + max(0, p.numInputRows)
        observed = {k: v.asDict() for k, v in (p.observedMetrics or {}).items()}
        self._update(str(p.runId), id=str(p.id), name=p.name, batch=p.batchId, rows=rows, seen=p.timestamp, observed=observed)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        state = self._update(str(event.runId), id=str(event.id), state="failed" if event.exception else "ended", reason=event.exception, ended=time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))
        self._write(f"{state.get('name') or state['id']}.done", f"{state['state']} {state['ended']}\n")


def run_available(rows: DataFrame, mode: str = "update") -> DataFrame:
    """All that is there now, as a table: what each batch gives goes to a folder of its own in the shared folder and is read from there.

    A batch that runs again after a failure writes its folder again, so nothing comes twice.
    """
    spark = rows.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    writer = rows.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    writer.start().awaitTermination()
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], rows.schema)
    return spark.read.schema(rows.schema).parquet(f"{base}/out/batch=*")


def run_until(query: StreamingQuery, seconds: float) -> bool:
    """Waits for a stream up to a deadline and then stops it; its checkpoint lets a later run go on. Whether it ended by itself."""
    ended = query.awaitTermination(max(1, int(seconds)))
    if not ended:
        query.stop()
    return bool(ended)


def after_marker(spark: SparkSession, marker: str, start: Callable[[], StreamingQuery], seconds: float, poll: float = 30.0) -> StreamingQuery:
    """Starts a job once the file by which its producer says that it is done is there; an error if it does not come in time."""
    path, ends = spark._jvm.org.apache.hadoop.fs.Path(marker), time.monotonic() + seconds
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    while not files.exists(path):
        if time.monotonic() >= ends:
            raise TimeoutError(f"{marker} did not come in {seconds} s")
        time.sleep(min(poll, max(0.0, ends - time.monotonic())))
    return start()
