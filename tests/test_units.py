"""Interrupted runs go on at the next unit; no unit runs twice."""

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import ingest, units

SCHEMA = "job string, run_id long, seq long, unit string"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_a_killed_stream_goes_on_at_the_next_unit(spark, tmp_path):
    folder, ledger, checkpoint = (str(tmp_path / x) for x in ("in", "ledger", "cp"))
    for k in range(5):
        put(spark, folder, [("load", 1, k, f"u{k}")])
    worked, broken = [], {"u3"}

    def work(job, unit, batch):
        if unit in broken:
            broken.discard(unit)
            raise RuntimeError("killed")
        worked.append(unit)

    def go():
        q = units.run_units(ingest.file_stream(spark, folder, SCHEMA, 1), work, ledger, checkpoint)
        try:
            q.awaitTermination(180)
        finally:
            q.stop()

    with pytest.raises(Exception, match="killed"):
        go()
    assert sorted(worked) == worked[:] or len(worked) < 5
    before = list(worked)
    go()
    assert sorted(worked) == [f"u{k}" for k in range(5)] and worked[: len(before)] == before
    put(spark, folder, [("load", 2, 0, "u1"), ("load", 2, 1, "u5"), ("load", 2, 2, "u5")])  # the run after inherits
    put(spark, folder, [("other", 7, 0, "u1")])
    go()
    assert sorted(worked) == sorted([f"u{k}" for k in range(6)] + ["u1"])
    said = spark.read.parquet(ledger)
    assert said.filter("decision = 'run'").groupBy("job", "unit").count().filter("count > 1").count() == 0
    assert {(r.unit, r.seq): (r.decision, r.inherited_from) for r in said.filter("run_id = 2").collect()} == {("u1", 0): ("skipped", 1), ("u5", 1): ("run", 1), ("u5", 2): ("skipped", 1)}
    state = {r.job: r for r in units.checkpoints(said).collect()}
    assert (state["load"].completed, state["load"].run_id, state["load"].inherited_from, state["other"].completed_units) == (6, 2, 1, ["u1"])


def test_a_silent_run_is_called_interrupted(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, [("load", 1, 0, "u0"), ("load", 1, 1, "u1")])
    out = units.planned_units(ingest.file_stream(spark, folder, SCHEMA, 1), silence_ms=1500)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    q = units.started(out.writeStream.format("memory").queryName("silent").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds"), spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    try:
        for _ in range(60):
            q.awaitTermination(1)
            if spark.table("silent").filter("decision = 'interrupted'").count():
                break
    finally:
        q.stop()
    rows = spark.table("silent").collect()
    assert [(r.unit, r.next_unit) for r in rows if r.decision == "run"] == [("u0", "u1"), ("u1", None)]
    assert [(r.run_id, r.n_done) for r in rows if r.decision == "interrupted"] == [(1, 2)]


def test_the_first_load_keeps_its_order(spark, tmp_path):
    progress, ran = str(tmp_path / "progress"), []

    def step(name, fails=()):
        def work(market, as_of, days):
            ran.append((market, name, days))
            if (market, name) in fails:
                raise ValueError("no network")
            return {"rows": 3}

        return work

    names = ("securities_master", "macro", "prices", "financials", "documents", "features")
    first = units.run_steps(spark, progress, "2024-01-05", {n: step(n, {("US", "prices")}) for n in names})
    assert first == {"JP.securities_master": "success", "JP.macro": "success", "JP.prices": "success", "US.prices": "failed"}
    table = [r.status for r in units.progress_table(spark, progress).orderBy("place").collect()]
    assert table == ["done"] * 3 + ["failed"] + ["waiting"] * 5
    ran.clear()
    again = units.run_steps(spark, progress, "2024-01-06", {n: step(n) for n in names})
    assert list(again) == [f"{m}.{s}" for m, s in units.BACKFILL] and again["JP.prices"] == "skipped" and again["JP.prices_live"] == "skipped"
    assert ran == [("US", "prices", 1825), ("US", "financials", 1825), ("JP", "documents", 365), ("US", "documents", 365), ("JP", "features", None)]
    assert set(units.run_steps(spark, progress, "2024-01-07", {}).values()) == {"skipped"}
    assert units.progress_table(spark, progress).filter("status = 'done'").select(F.countDistinct("step")).first()[0] == 7
