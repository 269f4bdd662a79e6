"""Runs as a data source: newest and named ones, failures as rows, half-written runs, streams that stop and start again."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quern.sources import files, runs


@pytest.fixture(scope="module")
def source(spark):
    runs.register(spark)
    return spark


def page(i):
    return {"url": f"https://h/{i}", "status_code": 200, "headings": [{"level": "h1", "text": f"T{i}"}], "html": "é" * i}


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())


def test_foreign_pages_and_failures(source, tmp_path):
    old, new = tmp_path / "crawl_2" / "pages", tmp_path / "crawl_1" / "pages"
    put(old, "a.json", json.dumps(page(9)))
    put(new, "a.json", json.dumps(page(1), indent=2))
    put(new, "b.json", "\n".join([json.dumps(page(2)), "", "no page", json.dumps(page(3))]))
    put(new, "c.json", "[1]")
    put(new, "d.json", "")
    put(new, "e.json", b'{"url": "\xff"}')
    put(new, "f.json", '{"url": "x\\ud800", "status_code": "200", "headings": [{"level": 1}], "depth": 99999999999, "file": "mine"}')
    put(new, "g.json", '{"url": NaN}')
    put(new, "_h.json", "hidden")
    put(new, "i.txt", "other")
    os.utime(tmp_path / "crawl_2", (1, 1))
    got = source.read.format("quern_pages").load(str(tmp_path)).collect()
    good = {r["url"]: r for r in got if r["failure"] is None}
    assert set(good) == {"https://h/1", "https://h/2", "https://h/3", "x�"}
    assert good["https://h/1"]["headings"][0]["text"] == "T1" and good["https://h/2"]["html"] == "éé"
    odd = good["x�"]
    assert (odd["status_code"], odd["depth"], odd["headings"][0]["level"], odd["file"]) == (None, None, "1", "crawl_1/pages/f.json")
    assert sorted(r["file"][-6] for r in got if r["failure"]) == list("bcdeg")
    named = source.read.format("quern_pages").option("run", "crawl_2").schema("html string, url string").load(str(tmp_path))
    assert named.columns == ["html", "url"] and [r["url"] for r in named.collect()] == ["https://h/9"]


def test_roots_without_runs(source, tmp_path):
    load = lambda kind, at: source.read.format(f"quern_{kind}").load(str(at))
    assert load("pages", tmp_path / "none").count() == 0
    put(tmp_path, "p.json", json.dumps(page(4)))
    assert [r["url"] for r in load("pages", tmp_path).collect()] == ["https://h/4"]
    with pytest.raises(Exception, match="no process_ folder"):
        load("chunks", tmp_path).count()
    (tmp_path / "crawl_3").mkdir()
    with pytest.raises(Exception, match="no page files"):
        load("pages", tmp_path).count()


def test_chunks_lines_stretches_and_nested(source, tmp_path):
    lines = [json.dumps({"chunk_id": str(i), "text": "y" * (i % 7), "token_count": i}) for i in range(500)]
    text = "\r\n".join([*lines, "[1]", "{", ""])
    put(tmp_path / "process_1", "chunks.jsonl", text)
    got = source.read.format("quern_chunks").load(str(tmp_path))
    assert sorted(r["token_count"] for r in got.filter("failure IS NULL").collect()) == list(range(500))
    assert got.filter("failure IS NOT NULL").count() == 2
    # However a file is cut, each line is read once.
    fs, root = runs.store_of(str(tmp_path))
    size = len(text.encode())
    whole = list(runs._lines(fs, f"{root}/process_1/chunks.jsonl", 0, size))
    assert [line.strip().decode() for _, line in whole] == [*lines, "[1]", "{"]
    for step in (1, 7, 53, 4096):
        assert [x for i in range(0, size, step) for x in runs._lines(fs, f"{root}/process_1/chunks.jsonl", i, min(i + step, size))] == whole
    put(tmp_path / "process_2" / "documents", "d.json", json.dumps({"document_id": "D", "chunks": [{"chunk_id": "c", "document_id": ""}, {"chunk_id": "e", "document_id": "own"}, 5]}))
    put(tmp_path / "process_2" / "documents", "e.json", json.dumps({"document_id": "E", "chunks": None}))
    nested = source.read.format("quern_chunks").option("run", "process_2").load(str(tmp_path))
    assert {(r["chunk_id"], r["document_id"]) for r in nested.collect()} == {("c", "D"), ("e", "own")}


def test_written_runs_are_whole_or_unseen(source, tmp_path):
    root = str(tmp_path)
    rows = source.range(2500).select(F.concat(F.lit("https://h/"), "id").alias("url"), F.when(F.col("id") % 2 == 0, F.col("id").cast("int")).alias("depth"))
    load = lambda: source.read.format("quern_pages").load(root)
    write = lambda df, run: df.write.format("quern_pages").mode("append").option("run", run).save(root)
    write(rows.repartition(2), "crawl_a")
    assert sorted((r["url"], r["depth"]) for r in load().collect()) == sorted((r["url"], r["depth"]) for r in rows.collect())
    listed = json.loads((tmp_path / "crawl_a" / runs.LIST).read_text())
    assert listed["rows"] == 2500 and len(listed["files"]) == 4
    # A file of an attempt that was not committed isn't read, nor is a run whose job failed.
    put(tmp_path / "crawl_a" / "pages", "part-lost.json", json.dumps(page(1)))
    fail = F.udf(lambda i: 1 // (1200 - i), "int")
    with pytest.raises(Exception, match="ZeroDivisionError"):
        write(source.range(2500).repartition(3).select(F.lit("x").alias("url"), fail("id").alias("depth")), "crawl_b")
    assert load().count() == 2500
    with pytest.raises(Exception, match="not complete"):
        source.read.format("quern_pages").option("run", "crawl_b").load(root).count()
    with pytest.raises(Exception, match="can't be written again"):
        write(rows, "crawl_a")
    write(rows.limit(0), "crawl_c")
    assert load().count() == 0
    write(rows.limit(7), "crawl_b")
    assert load().count() == 7
    # What the other reader makes of such a run is the same.
    pages, bad = files.read_pages(source, f"{root}/crawl_b/pages")
    assert pages.count() >= 7 and bad.count() == 0


def test_states_keep_their_own_error(source, tmp_path):
    rows = source.createDataFrame([("u", "timeout", ["a", "b"])], "url string, error string, document_links array<string>")
    rows.write.format("quern_states").mode("append").save(str(tmp_path))
    (got,) = source.read.format("quern_states").load(str(tmp_path)).collect()
    assert (got["url"], got["error"], got["document_links"], got["failure"]) == ("u", "timeout", ["a", "b"], None)


def test_stream_reads_each_run_once_and_writes_a_run_a_batch(source, tmp_path):
    inside, out, at = (str(tmp_path / n) for n in ("in", "out", "at"))
    write = lambda urls, run: source.createDataFrame([(u,) for u in urls], "url string").write.format("quern_pages").mode("append").option("run", run).save(inside)

    def go():
        stream = source.readStream.format("quern_pages").load(inside).select("url")
        q = stream.writeStream.format("quern_pages").option("stream", "copy").option("path", out).option("checkpointLocation", at).trigger(once=True)
        q.start().awaitTermination()
        fs, root = runs.store_of(out)
        names = [n for _, n in runs.committed(fs, root, "crawl_")]
        read = lambda n: {r["url"] for r in source.read.format("quern_pages").option("run", n).load(out).collect()}
        return {n: read(n) for n in names}

    write("ab", "crawl_1")
    put(tmp_path / "in" / "crawl_foreign" / "pages", "x.json", json.dumps(page(1)))
    (tmp_path / "in" / "crawl_half").mkdir()
    (tmp_path / "in" / "crawl_half" / runs.OPEN).write_text("{}")
    assert list(go().values()) == [{"a", "b"}]
    write("c", "crawl_2")
    write("d", "crawl_0")
    # A list that is seen later than its time says is read all the same.
    old = tmp_path / "in" / "crawl_0" / runs.LIST
    t = (tmp_path / "in" / "crawl_1" / runs.LIST).stat().st_mtime - 60
    os.utime(old, (t, t))
    first = go()
    assert sorted(map(sorted, first.values())) == [["a", "b"], ["c", "d"]]
    # The last batch comes again if its commit wasn't noted: its run stays as it is.
    last = max((tmp_path / "at" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (tmp_path / "at" / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    assert go() == first
