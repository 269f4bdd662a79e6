"""Queries against their SQL on pages that come twice, and whose texts end within a character reference."""

import duckdb
import pytest

from quern.plans import registry
from quern.sources import files, runs
from tests.test_registry import tidy


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    page = '<!DOCTYPE html><html><head><title>{0}</title></head><body><article><h1>{0}</h1><p>{1} text of a page</article></body></html>'
    u = "https://hub.example.com/en/1"
    rows = [(9, u, page.format("Twice", "sign in required, access denied")), (5, u, page.format("Twice", "b")), (2, "https://hub.example.com/x", page.format("A &lt; B &amp", "c")), (3, "https://hub.example.com/y", page.format("C&quot D&&&amp", "d &lt e"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{root}/pages.parquet")
    spark.createDataFrame([(1, "a text", "en", "src0", 6)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    return str(root)


@pytest.mark.parametrize("name", ["html_title", "html_headings", "html_visible_text", "html_clean", "html_blocks", "sections_rollup", "chunk_documents", "chunk_documents_sql", "refresh_run"])
def test_odd_pages(spark, odd, name):
    db = duckdb.connect()
    for t in ("pages", "documents"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, odd)
    rel = db.sql(registry.ORACLES[name])
    order = [rel.columns.index(c) for c in df.columns]
    assert sorted(repr(tuple(map(tidy, r))) for r in df.collect()) == sorted(repr(tuple(tidy(r[i]) for i in order)) for r in rel.fetchall())


def test_files_of_lines_are_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text("".join(f'{{"n": {i}}}\r\n\n' for i in range(3000)))
    (tmp_path / "b.json").write_text('{\n"n":\n1}\n')
    (tmp_path / "c.json").write_text('no object\n{"n": 1}\n')
    (tmp_path / "d.json").write_text("\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        rows = files._objects(spark, str(tmp_path))
        got = {(r.file, r.good): r["count"] for r in rows.groupBy("file", "good").count().collect()}
        assert got == {("a.json", True): 3000, ("b.json", True): 1, ("c.json", False): 1, ("d.json", False): 1}
        assert rows.filter("file = 'a.json'").selectExpr("spark_partition_id()").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_of_many_tasks_lie_in_one_folder(spark, tmp_path):
    rows = spark.range(40).repartition(5).selectExpr("concat(id, '.txt') AS name", "concat('é\n', id) AS value")
    assert runs.write_files(rows, f"file:{tmp_path}/pages") == 40
    assert {f.name: f.read_text() for f in (tmp_path / "pages").iterdir()} == {f"{i}.txt": f"é\n{i}" for i in range(40)}
    assert runs.write_files(rows.limit(0), str(tmp_path / "none")) == 0
