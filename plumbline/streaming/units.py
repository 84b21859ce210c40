"""Runs of many units that go on where they were interrupted: state of its own with timers, and a fixed order of steps."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from plumbline.session import ship

#: What the operator says of a unit, and of a run that has been silent.
PLAN = "job string, run_id long, seq long, unit string, decision string, next_unit string, n_done long, inherited_from long"
#: Markets and steps of the first load, in this order, and the days that each looks back.
BACKFILL = (
    ("JP", "securities_master"), ("JP", "macro"), ("JP", "prices"), ("US", "prices"), ("JP", "prices_live"), ("US", "financials"), ("JP", "documents"), ("US", "documents"), ("JP", "features"),
)
LOOKBACKS = {"JP": {"prices": 730, "prices_live": 84, "financials": 730, "documents": 365, "macro": 3650}, "US": {"prices": 1825, "financials": 1825, "documents": 365, "macro": 3650}}


class _Units(StatefulProcessor):
    """Keeps of each job the units that are done and the run that it is in. A unit is done once its row's batch has been
    committed: a batch that fails is worked off again from the state before it, and so does its unit."""

    def __init__(self, silence_ms: int):
        self.silence = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getMapState("done", "unit string", "run_id long")
        self.run = handle.getValueState("run", "run_id long, inherited_from long, n_done long, interrupted boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows)).sort_values(["run_id", "seq"])  # the rows of one job in one batch
        out = []
        run, inherited, n, interrupted = self.run.get() if self.run.exists() else (None, None, 0, False)
        following = [*x["unit"].tolist()[1:], None]
        for r, after in zip(x.itertuples(index=False), following):
            if run is not None and r.run_id != run:
                inherited = run
            run = int(r.run_id)
            unit = (r.unit,)
            if self.done.containsKey(unit):
                out.append((key[0], run, int(r.seq), r.unit, "skipped", after, n, inherited))
                continue
            self.done.updateValue(unit, (run,))
            n += 1
            out.append((key[0], run, int(r.seq), r.unit, "run", after, n, inherited))
        self.run.update((run, inherited, n, False))
        if self.silence:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence)
        yield _frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.run.exists():
            run, inherited, n, interrupted = self.run.get()
            if not interrupted:
                self.run.update((run, inherited, n, True))
                yield _frame([(key[0], run, None, None, "interrupted", None, n, inherited)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    x = pd.DataFrame(rows, columns=["job", "run_id", "seq", "unit", "decision", "next_unit", "n_done", "inherited_from"])
    return x.astype({c: "Int64" for c in ("run_id", "seq", "n_done", "inherited_from")})


def planned_units(units: DataFrame, silence_ms: int = 0) -> DataFrame:
    """A stream of (job, run_id, seq, unit) to what is to be done with each: ``run`` the first time that the job sees the unit,
    ``skipped`` after that, in this run or one that inherits from an interrupted one. A job that is silent for ``silence_ms``
    is said to be ``interrupted``, once, when its timer expires. ``inherited_from`` is the run before, if there was one. ``started`` starts queries of such streams."""
    ship(units.sparkSession)
    mode = "ProcessingTime" if silence_ms else "None"
    return units.groupBy("job").transformWithStateInPandas(statefulProcessor=_Units(silence_ms), outputStructType=PLAN, outputMode="Update", timeMode=mode)


def started(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Starts a query whose operators have several states a key, which one state store alone offers; a query keeps the settings
    that it started with, and the session gets its own back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return writer.start()
    finally:
        spark.conf.set(key, before)


def run_units(units: DataFrame, work: Callable[[str, str, int], None], ledger: str, checkpoint: str) -> StreamingQuery:
    """Works off a stream of units, in order, and writes what became of each to the table ``ledger``. ``work(job, unit, batch)``
    may raise: the query stops, and when it starts again with the same checkpoint it goes on at that unit. Units of one batch
    are worked off on the driver, which only starts them: give a batch one file (``file_stream`` with ``files=1``)."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        said = rows.orderBy("job", "run_id", "seq").collect()  # the units of one file
        for r in said:
            if r["decision"] == "run":
                work(r["job"], r["unit"], batch_id)
        if said:
            rows.sparkSession.createDataFrame(said, PLAN).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(ledger)

    writer = planned_units(units).writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return started(writer, units.sparkSession)


def checkpoints(ledger: DataFrame) -> DataFrame:
    """A row a job: its latest run, the units done so far in their order, the last run's next unit, and the run inherited from."""
    done = ledger.filter("decision = 'run'").groupBy("job").agg(F.array_sort(F.collect_list(F.struct("batch", "run_id", "seq", "unit")))["unit"].alias("completed_units"))
    last = ledger.filter("decision <> 'interrupted'").groupBy("job").agg(F.max(F.struct("run_id", "seq", "next_unit", "inherited_from")).alias("l"))
    return done.join(last, "job").select("job", F.col("l.run_id").alias("run_id"), "completed_units", F.size("completed_units").alias("completed"), F.col("l.next_unit").alias("next_unit"), F.col("l.inherited_from").alias("inherited_from"))


def run_steps(spark: SparkSession, progress: str, as_of: str, steps: dict[str, Callable[[str, str, int | None], dict | None]], order: Sequence[tuple[str, str]] = BACKFILL) -> dict[str, str]:
    """The first load: (market, step) in a fixed order, each a function of market, date and days to look back. What is done stays
    done in the table ``progress`` (market.step, status, as_of, metrics), and a step that is done is skipped when the load runs
    again; a step that raises is marked as failed and ends the load; one without a function, or whose metrics say so, counts as
    skipped and is not asked for again. Returns the status of each step that was reached.
    """
    found: dict[str, str] = {}
    done = {r["key"] for r in _progress(spark, progress).filter("status = 'done'").collect()}  # a row a step
    for market, step in order:
        key = f"{market}.{step}"
        if key in done:
            found[key] = "skipped"
            continue
        _note(spark, progress, key, "running", as_of, {})
        work = steps.get(step)
        try:
            metrics = (work(market, as_of, LOOKBACKS.get(market, {}).get(step)) if work else {"skipped": True}) or {}
        except Exception as e:  # noqa: BLE001  whatever a step raises is its failure
            _note(spark, progress, key, "failed", as_of, {"error": f"{type(e).__name__}: {e}"})
            found[key] = "failed"
            break
        found[key] = "skipped" if metrics.get("skipped") else "success"
        _note(spark, progress, key, "done", as_of, metrics)
    return found


_STEP = "key string, status string, as_of string, metrics string"


def _note(spark: SparkSession, progress: str, key: str, status: str, as_of: str, metrics: dict) -> None:
    row = spark.createDataFrame([(key, status, as_of, json.dumps(metrics, default=str))], _STEP)  # one row
    row.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(progress)


def _progress(spark: SparkSession, progress: str) -> DataFrame:
    empty = spark.createDataFrame([], _STEP)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(progress)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return empty
    return spark.read.schema(_STEP).parquet(progress)


def progress_table(spark: SparkSession, progress: str, order: Iterable[tuple[str, str]] = BACKFILL) -> DataFrame:
    """Every step of the load in its order with its status, ``waiting`` where it has none."""
    steps = spark.createDataFrame([(k, m, s, f"{m}.{s}") for k, (m, s) in enumerate(order)], "place int, market string, step string, key string")  # a row a step
    return steps.join(_progress(spark, progress), "key", "left").select("place", "market", "step", F.coalesce("status", F.lit("waiting")).alias("status"), "as_of", "metrics")
