"""Stateful streams: what they hold and write, stopped and started again."""

import random

import pytest

from quern.streaming import refresh


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


EVENTS = "url string, ts long, note string"


def test_state_changes_only_are_written_and_survive_a_restart(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", "c", "d"]), rnd.choice([None, *range(30)]), f"n{i}") for i in range(40)]
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for part in (rows[:10], rows[10:20]):
        put(spark, part, EVENTS, source)
    refresh.state_stream(stream(spark, source, EVENTS), out, at).awaitTermination()
    half = spark.read.parquet(out).count()
    for part in (rows[20:30], rows[30:], [(u, -1, "late") for u in "abcd"] * 5):
        put(spark, part, EVENTS, source)
    refresh.state_stream(stream(spark, source, EVENTS), out, at).awaitTermination()
    log = spark.read.parquet(out)
    want = {}
    for u, ts, _ in rows:
        want[u] = max(want.get(u, -1), -1 if ts is None else ts)
    got = {r.url: r.ts for r in refresh.read_state(spark, out, EVENTS).collect()}
    assert got == want
    # Rows that change nothing are not written: for each batch and key one at most, and none for the late ones.
    assert half <= 8 and log.count() <= 16 and log.filter("note = 'late'").count() == 0


def test_tails_go_on_after_a_restart(spark, tmp_path):
    schema = "conv_id long, turn long, question string, answer string"
    rows = [(c, n, f"q{c}-{n}", "") for n in range(7) for c in (1, 2, None)]
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "cp"))

    def run():
        rows = refresh.conversation_stream(stream(spark, source, schema))
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()

    put(spark, rows[:9], schema, source)
    run()
    put(spark, rows[9:], schema, source)
    run()
    got = sorted((r.conv_id or 0, r.turn, r.question, r.kept, r.previous) for r in spark.read.parquet(out).collect())
    assert got == sorted((c or 0, n, f"q{c}-{n}", min(4, n + 1), f"q{c}-{n - 1}" if n else None) for n in range(7) for c in (1, 2, None))


def test_state_that_is_kept_for_a_time_only(spark, tmp_path):
    """A key that had no change for longer than its time is forgotten: then any row is a change."""
    import time

    source, out, at = (str(tmp_path / x) for x in ("in", "out", "cp"))
    put(spark, [("a", 9, "first")], EVENTS, source)
    query = refresh.state_stream(stream(spark, source, EVENTS), out, at, ttl_ms=1000)
    notes = lambda: {r.note for r in spark.read.schema(EVENTS).parquet(out).collect()} if (tmp_path / "out").exists() else set()

    def wait_for(n: int) -> None:
        until = time.time() + 60
        while len(notes()) < n and time.time() < until:
            time.sleep(0.5)

    try:
        wait_for(1)
        time.sleep(2)
        put(spark, [("a", 5, "older")], EVENTS, source)
        wait_for(2)
    finally:
        query.stop()
    assert notes() == {"first", "older"}


@pytest.fixture(autouse=True)
def keep_provider(spark):
    old = spark.conf.get(refresh._PROVIDER)
    yield
    spark.conf.set(refresh._PROVIDER, old)
