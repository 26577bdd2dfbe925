"""The protocol of workers as a stateful stream: one processor holds the state of each job, and timers end dead ones.

Lines of a job may come late, twice, or in any order: what is folded is decided by sequence numbers, as in the batch
functions, and a line counts once. The numbers seen are kept as a mark below which all have come and a map of those
above it, so in an orderly stream their state is one number. The last lines that are no messages are a list of bounded
length. A job that ends, or of which nothing comes for a time, gives its state a last time; a dead one is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rastrum.streaming import protocol as P

FOLD = "progress double, progress_seq long, description string, description_seq long, logs long, result string, result_seq long, error string, error_seq long, failed boolean, canceled boolean, done boolean, lines long"
OUT = "job_id long, progress double, description string, logs long, result string, error string, failed boolean, canceled boolean, done boolean, status string, tail array<string>, lines long"
KEPT = {"progress": ("progress", "value"), "describe": ("description", "text"), "result": ("result", "data"), "error": ("error", "message")}  # type of message: what it sets, and from which field
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NOTHING = {"progress": None, "description": None, "result": None, "error": None, "logs": 0, "failed": False, "canceled": False, "done": False, "lines": 0} | {f"{c}_seq": -1 for c in ("progress", "description", "result", "error")}


def status_of(s: dict, dead: bool = False) -> str:
    """As protocol.terminal, and lost for a job that died without an end."""
    ended = "canceled" if s["canceled"] else "error" if s["failed"] else "result" if s["done"] else None
    return ended or ("lost" if dead else "no_result")


class Jobs(StatefulProcessor):
    def __init__(self, n_tail: int, patience: timedelta | None):
        self.n_tail, self.patience = n_tail, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", FOLD)
        self.mark = handle.getValueState("mark", "seq long")
        self.above = handle.getMapState("above", "seq long", "there boolean")
        self.tail = handle.getListState("tail", "seq long, line string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in FOLD.split(", ")]
        s = dict(zip(names, self.fold.get(), strict=True)) if self.fold.exists() else dict(NOTHING)
        mark = self.mark.get()[0] if self.mark.exists() else -1
        tail = [(r[0], r[1]) for r in self.tail.get()] if self.tail.exists() else []
        known_tail = list(tail)
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                seq = int(r.seq)
                if seq <= mark or self.above.containsKey((seq,)):
                    continue
                if seq == mark + 1:
                    mark = seq
                    while self.above.containsKey((mark + 1,)):
                        mark += 1
                        self.above.removeKey((mark,))
                else:
                    self.above.updateValue((seq,), (True,))
                s["lines"] += 1
                if r.kind == "tail":
                    tail = sorted([*tail, (seq, r.line)])[-self.n_tail :]
                if r.kind != "message":
                    continue
                kept = KEPT.get(r.type)
                if kept and seq > s[f"{kept[0]}_seq"]:
                    value = getattr(r, kept[1])
                    s[kept[0]], s[f"{kept[0]}_seq"] = None if pd.isna(value) else value, seq
                s["logs"] += r.type == "log"
                s["failed"] |= r.type == "error"
                s["canceled"] |= r.type == "canceled"
                s["done"] |= r.type == "result"
        self.fold.update(tuple(s[c] for c in names))
        self.mark.update((mark,))
        if tail != known_tail:
            self.tail.put(tail)
        if self.patience is not None:
            for t in [*self.handle.listTimers()]:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.patience.total_seconds() * 1000))
        yield self._said(key, s, tail, status_of(s))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.fold.exists():
            return
        s = dict(zip([f.split()[0] for f in FOLD.split(", ")], self.fold.get(), strict=True))
        tail = [(r[0], r[1]) for r in self.tail.get()] if self.tail.exists() else []
        for state in (self.fold, self.mark, self.above, self.tail):
            state.clear()
        yield self._said(key, s, tail, status_of(s, dead=True))

    def close(self) -> None:
        pass

    def _said(self, key, s: dict, tail: list, status: str) -> pd.DataFrame:
        row = {"job_id": key[0], **{c: s[c] for c in ("progress", "description", "logs", "result", "error", "failed", "canceled", "done")}, "status": status, "tail": [line for _, line in tail], "lines": s["lines"]}
        return pd.DataFrame({c: pd.Series([v], dtype=object) for c, v in row.items()})


def job_states(lines: DataFrame, n_tail: int = P.TAIL, patience: timedelta | None = None) -> DataFrame:
    """A row for each job that a batch of a stream of (job_id, seq, line) touches: its folded state, status, last lines and number of lines.

    seq counts a job's lines from 0; of lines with the same seq the first to come counts. With patience, a job
    of which nothing came for so long is given once more, as lost if it had no end, and its state is dropped; lines
    that come later begin a new job. Rows are updates: the last one of a job is its state. Null ids are one job; lines
    with a null seq are passed over.
    """
    spark = lines.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    parsed = P.parse(lines).where("seq is not null").select("job_id", "seq", "kind", "line", "msg.type", "msg.value", "msg.text", "msg.message", "msg.data")
    mode = "ProcessingTime" if patience is not None else "None"
    return parsed.groupBy("job_id").transformWithStateInPandas(statefulProcessor=Jobs(n_tail, patience), outputStructType=OUT, outputMode="Update", timeMode=mode)


def run_job_states(spark: SparkSession, folder: str, sink: str, checkpoint_folder: str, **options) -> None:
    """All lines that have come into folder since the last run, as updates of the states in sink (Parquet), with what was held at the last checkpoint."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    states = job_states(P.read_lines(spark, folder), **options)
    states.writeStream.outputMode("update").option("checkpointLocation", checkpoint_folder).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def latest(updates: DataFrame) -> DataFrame:
    """The last update of each job from the batches that run_job_states wrote."""
    from pyspark.sql import functions as F

    return updates.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in updates.columns if c not in ("job_id", "batch")]), "batch").alias("s")).select("job_id", "s.*")
