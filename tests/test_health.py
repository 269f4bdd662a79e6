import json

from pyspark.sql import functions as F

from quern import __main__ as commands
from quern.__main__ import main
from quern.operators import crawl, health, index

SCHEMA = "id string, text string, pos long"


def test_diagnosis_names_the_first_failure(spark, tmp_path):
    own = index.Index(spark, str(tmp_path / "a"), SCHEMA)
    embed = lambda xs: [[0.0] * 3 for _ in xs]

    def broken(_):
        raise OSError("secret token=abc")

    assert health.diagnose(own, embed, True)["failure_point"] == "empty_index"
    own.write(spark.createDataFrame([("x", "t", 0)], SCHEMA))
    assert health.diagnose(own, embed, True) | {"error": None} == {"document_count": 1, "dimensions": 3, "error": None, "failure_point": None, "llm_configured": True, "status": "healthy"}
    assert health.diagnose(own, None, False)["failure_point"] == "embedding_config" and health.diagnose(own, embed, False)["failure_point"] == "llm_config"
    bad = health.diagnose(own, broken, True)
    assert bad["failure_point"] == "embedding" and "abc" not in str(bad) and bad["status"] == "unhealthy"
    assert health.list_indexes(own) == ["a"] and health.statistics(own)["sample_ids"] == ["x"]


def test_crawl_report(spark):
    outcomes = spark.createDataFrame([("a", "new", 200), ("b", "access_denied", 403), ("c", "unchanged", 200), ("d", "http_error", 500)], "url string, outcome string, status_code int")
    decided = spark.createDataFrame([("a", "queued"), ("p", "document_link"), ("q", "external")], "url string, decision string")
    got = health.crawl_report(outcomes, decided)
    assert {tuple(r) for r in got["failed"].collect()} == {("b", "ACCESS_DENIED", 403), ("d", "http_error", 500)}
    assert {tuple(r) for r in got["skipped"].collect()} == {("p", "document_link"), ("c", "unchanged_content")}
    assert {r["name"]: r["count"] for r in got["stats"].collect()}["queued"] == 1


def test_commands(spark, tmp_path, capsys):
    pages = spark.createDataFrame([(1, "https://hub.example.com/", "<h1>A</h1><p>text here</p>"), (2, "https://hub.example.com/e", "")], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    run, own = str(tmp_path / "process_1"), str(tmp_path / "index")
    assert main(["process", str(tmp_path / "pages.parquet"), run]) == 0
    assert main(["index", "full", own, run]) == 0 and main(["index", "incremental", own, run]) == 0
    assert '"upserted": 0' in capsys.readouterr().out
    assert main(["index", "stats", own]) == 0 and '"count": 1' in capsys.readouterr().out
    assert main(["index", "clear", own]) == 0 and main(["index", "full", own, str(tmp_path / "none")]) == 1


def test_refresh_command(spark, tmp_path, capsys, monkeypatch):
    """Crawl, process and index in one; what changed goes into the index, and a refresh that breaks off is made up for."""
    home = '<title>Home</title><p>Welcome to all</p><a href="/a">a</a><a href="/b">b</a>'
    root, own = str(tmp_path / "root"), str(tmp_path / "index")

    def go(a, b):
        rows = [(0, "https://hub.example.com/", home), (1, "https://hub.example.com/a", f"<title>A</title><p>{a}</p>"), (2, "https://hub.example.com/b", f"<title>B</title><p>{b}</p>")]
        source = str(tmp_path / f"{a}{b}.parquet")
        spark.createDataFrame(rows, "page_id long, url string, html string").write.mode("overwrite").parquet(source)
        code = main(["refresh", source, root, own])
        said = capsys.readouterr().out
        texts = {r["url"][24:]: r["text"] for r in index.Index(spark, own, commands.SCHEMA).read().collect()}
        return code, json.loads(said) if code == 0 else None, {k: v for k, v in texts.items() if k in ("a", "b")}

    whole = commands._index
    monkeypatch.setattr(commands, "_index", lambda *_: 1 // 0)
    code, _, held = go("one", "two")
    assert code == 1 and not held
    monkeypatch.setattr(commands, "_index", whole)
    code, first, held = go("one", "two")
    assert code == 0 and first["crawl"]["successfully_crawled_pages"] == 3 and first["process"]["processed"] == 3
    assert "one" in held["a"] and "two" in held["b"]
    code, again, held = go("three", "two")
    assert code == 0 and again["process"]["input"] == 1 and again["crawl"]["unchanged_pages"] == 2
    assert "three" in held["a"] and "one" not in held["a"] and "two" in held["b"]


def test_state_survives_failures(spark):
    state = spark.createDataFrame([("u", "T", "h", "s", "s", "PROCESSED", "", [])], crawl.STATE)
    after = crawl.upsert_state(state, state.select("url", F.lit("FAILED").alias("status"), F.lit("e").alias("error")), "n").first()
    assert (after["title"], after["content_hash"], after["status"], after["error"]) == ("T", "h", "FAILED", "e")
