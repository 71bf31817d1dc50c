"""Ingestion job, session catalogue and pruned scans."""
import json

from riskgrid.sources import ingest as IN
from riskgrid.sources import session_catalogue as SC

SESSION = "session_key long, meeting_key long, year int, meeting_name string, date_start string"
SESSIONS = [(1, 10, 2023, "A GP", "2023-03-02T15:00:00"), (2, 20, 2024, "B GP", "2024-03-02T15:00:00"), (2, 20, 2024, "B GP", "2024-03-02T15:00:00")]


def land(tmp_path, table, lines, name="a.json"):
    folder = tmp_path / "landed" / table
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def record(session, second, **more):
    return {"session_key": session, "date": f"2024-03-02T15:00:{second:02d}", **more}


def state(log):
    return {(r.table_name, r.session_key): (r.status, r.written, r.rejected) for r in log.collect()}


def test_broken_records_tables_and_second_run(spark, tmp_path):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "bronze")
    sessions = spark.createDataFrame(SESSIONS, SESSION)
    land(tmp_path, "race_control", [
        record(1, 1, message="SAFETY CAR DEPLOYED"), record(2, 2, message="CLEAR"), '{"session_key": 2, "date": "2024-03', "no json at all",
        record(9, 3), {"session_key": 1, "date": "soon"}, {"date": "2024-03-02T15:00:00"}, "", record(2, 4, more={"nested": 1})])
    land(tmp_path, "weather", [])
    land(tmp_path, "position", [record(1, 5, driver_number="44", position="3")])
    failures = []
    log = state(IN.ingest(spark, landed, root, sessions, on_failure=lambda t, e: failures.append(t)))
    assert failures == ["intervals"]
    assert {k: v for k, v in log.items() if k[0] == "race_control"} == {("race_control", 1): ("written", 1, 1), ("race_control", 2): ("written", 2, 1), ("race_control", -1): ("written", 0, 3)}
    assert log["weather", 1] == ("written", 0, 0) and log["position", 1] == ("written", 1, 0) and log["intervals", 2] == ("failed", 0, 0)
    rejected = sorted((r.reason, r.session_key) for r in IN.rejected_records(spark, root).collect())
    assert rejected == [("malformed", -1), ("malformed", 2), ("no time", 1), ("unknown session", -1), ("unknown session", -1)]
    rows = {(r.session_key, r.message, r.meeting_name) for r in SC.scan(spark, root, "race_control").collect()}
    assert rows == {(1, "SAFETY CAR DEPLOYED", "A GP"), (2, "CLEAR", "B GP"), (2, None, "B GP")}

    # The second run does what failed and what is new, and leaves what is written.
    land(tmp_path, "intervals", [record(2, 6, driver_number="1", gap_to_leader="1.5", interval="0.5")])
    land(tmp_path, "race_control", [record(1, 7, message="late line of a written session"), record(3, 8, message="new session")], "b.json")
    more = spark.createDataFrame([*SESSIONS, (3, 30, 2024, "C GP", "2024-04-02T15:00:00")], SESSION)
    again = state(IN.ingest(spark, landed, root, more, on_failure=lambda t, e: failures.append(t)))
    assert failures == ["intervals"] and again["intervals", 2] == ("written", 1, 0) and again["race_control", 3] == ("written", 1, 0)
    assert again["race_control", 1] == log["race_control", 1] and SC.scan(spark, root, "race_control").count() == 4
    assert state(IN.ingest(spark, landed, root, more)) == again


def test_half_written_table_is_done_again(spark, tmp_path, monkeypatch):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "bronze")
    sessions = spark.createDataFrame(SESSIONS, SESSION)
    land(tmp_path, "position", [record(1, 5, driver_number="44", position="3"), "{"])
    write = IN._write_parts

    def lost(df, path):
        if path.endswith("_log") and df.first().status == "written":
            raise RuntimeError("driver lost before the commit")
        write(df, path)
    monkeypatch.setattr(IN, "_write_parts", lost)
    assert set(state(IN.ingest(spark, landed, root, sessions, ["position"])).values()) == {("failed", 0, 0)}
    monkeypatch.setattr(IN, "_write_parts", write)
    assert state(IN.ingest(spark, landed, root, sessions, ["position"]))["position", 1] == ("written", 1, 0)
    assert SC.scan(spark, root, "position").count() == 1 and IN.rejected_records(spark, root).count() == 1


def test_foreign_folders_and_dynamic_pruning(spark, tmp_path):
    root = str(tmp_path / "bronze")
    rows = [(k, k * 10, 2020 + k % 3, "GP", f"m{k}") for k in range(12)]
    made = spark.createDataFrame(rows, "session_key long, meeting_key long, year int, meeting_name string, message string")
    made = made.selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' as date")
    made.write.partitionBy("year", "session_key").parquet(f"{root}/race_control")
    stray = made.where("session_key = 3").drop("year", "session_key")
    stray.write.parquet(f"{root}/race_control/year=abc/session_key=3")
    stray.write.parquet(f"{root}/race_control/year=2020/session_key=x1")
    assert SC.scan(spark, root, "race_control").count() == 12
    got = {r.session_key: (r.meeting_key, r.year, r.meeting_name, r.n_rows) for r in SC.catalogue(spark, root, "race_control").collect()}
    assert got == {k: (k * 10, 2020 + k % 3, "GP", 1) for k in range(12)}
    spark.createDataFrame([(k, "even" if k % 2 == 0 else "odd") for k in range(12)], "session_key long, kind string").write.parquet(f"{root}/list")
    listed = spark.read.parquet(f"{root}/list").where("kind = 'odd'")
    pruned = SC.scan_sessions(spark, root, "race_control", listed)
    assert "dynamicpruning" in pruned._jdf.queryExecution().executedPlan().toString().lower()
    assert sorted(r.session_key for r in pruned.collect()) == [1, 3, 5, 7, 9, 11]
    static = SC.scan(spark, root, "race_control").where("year = 2021")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in static and "try_cast(year" in static
    assert SC.scan(spark, root, "weather").count() == 0
