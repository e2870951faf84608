import datetime as dt

from quadloom.plans.updates import history
from quadloom.streaming import changelog

T = lambda x: (1, x, "", "")


def rows(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 10, m)
    data = [(1, at(0), "u", "add", T("urn:a"), "urn:p", T("urn:b"), "g"), (2, at(5), "u", "add", T("urn:c"), "urn:p", T("urn:d"), "g"), (3, at(12), "v", "remove", T("urn:a"), "urn:p", T("urn:b"), "g"), (4, at(30), "v", "add", T("urn:a"), "urn:q", T("urn:b"), None)]
    return spark.createDataFrame(data, changelog.SCHEMA)


def test_log_and_history(spark, tmp_path):
    rows(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = changelog.append_log(changelog.read_changes(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    log = spark.read.parquet(str(tmp_path / "log"))
    state = lambda m, **k: {(r.s.lex, r.p) for r in history(log, dt.datetime(2024, 1, 1, 10, m), **k).collect()}
    assert state(6) == {("urn:a", "urn:p"), ("urn:c", "urn:p")} and state(40) == {("urn:c", "urn:p"), ("urn:a", "urn:q")} and state(40, user="v") == {("urn:a", "urn:q")}


def test_rates(spark, tmp_path):
    rows(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    rates = changelog.predicate_rates(changelog.read_changes(spark, str(tmp_path / "in")))
    q = rates.writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.window.start.minute, r.p, r.n_added, r.n_removed) for r in spark.table("rates").collect()}
    assert got == {(0, "urn:p", 2, 0), (10, "urn:p", 0, 1), (30, "urn:q", 1, 0)}
