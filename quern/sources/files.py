"""Page, chunk and state files: newest runs, per-file errors, nested documents; and the sinks beside them.

Listing goes through Hadoop's file systems, so paths may be in any store that Spark reads.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import blank
from quern.operators.frames import checkpointed, small

PAGE = (
    "url string, final_url string, status_code int, page_title string, headings array<struct<level:string,text:string>>, visible_text string, content string, "
    "content_hash string, source string, access string, scraped_at string, crawl_timestamp string, "
    "links array<struct<url:string,text:string,internal:boolean>>, html string, depth int"
)
CHUNK = (
    "chunk_id string, page_title string, url string, section string, heading string, crawl_timestamp string, source_type string, source string, text string, "
    "content_hash string, access string, scraped_date string, document_id string, token_count int"
)
RECORD = "url:string,title:string,content_hash:string,last_scraped:string,last_updated:string,status:string,error:string,document_links:array<string>"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def newest_run(spark: SparkSession, root: str, prefix: str) -> str | None:
    """The folder prefix* under root that was changed last, by time and not by name."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return None
    runs = [s for s in fs.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith(prefix)]
    return max(runs, key=lambda s: s.getModificationTime()).getPath().toString() if runs else None


def page_folder(spark: SparkSession, root: str, run: str | None = None) -> str | None:
    """Where page files are: the given run's, the newest crawl's, or root itself without any; None if root is missing."""
    if run is not None:
        fs, path = _fs(spark, f"{run}/pages")
        if not fs.exists(path):
            raise FileNotFoundError(f"no pages folder in {run}")
        return f"{run}/pages"
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return None
    newest = newest_run(spark, root, "crawl_")
    return f"{newest}/pages" if newest else root


def is_object(value: str):
    """True where a text column holds a JSON object."""
    return F.try_parse_json(value).isNotNull() & F.col(value).rlike(r"\A\s*\{")


def _objects(spark: SparkSession, folder: str) -> DataFrame:
    """(file, value, good) of folder/*.json: each line of a file that has an object on each, else the file as a whole.

    Files are read a line at a time; only those that are no lines of objects are put together again, by file.
    """
    name, blank_line = F.col("_metadata.file_name").alias("file"), F.trim("value") == ""
    source = lambda: spark.read.option("pathGlobFilter", "*.json")
    raw = source().option("lineSep", "\n").text(folder)
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth")).alias("place")
    lines = raw.select(name, place, F.regexp_replace("value", "\r$", "").alias("value"))
    each = lines.filter(~blank_line).groupBy("file").agg(F.min(is_object("value")).alias("lined"))
    lined = small(checkpointed(each.filter("lined").select("file")))
    own = lines.join(lined, "file", "left_semi").filter(~blank_line).select("file", "value", F.lit(True).alias("good"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), "\n")
    whole = lines.join(lined, "file", "left_anti").groupBy("file").agg(text.alias("value"))
    # Files without any lines are listed too.
    names = source().format("binaryFile").load(folder).select(name).join(lined, "file", "left_anti")
    whole = names.join(whole, "file", "left").select("file", blank("value").alias("value"))
    return own.unionByName(whole.withColumn("good", is_object("value")))


def read_pages(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(pages, failures): files that hold neither a JSON object nor one a line are listed and don't stop the rest."""
    rows = _objects(spark, folder)
    parsed = rows.filter("good").select("file", F.from_json("value", PAGE).alias("page"))
    return parsed.select("page.*", "file"), rows.filter("NOT good").select("file", F.lit("not a JSON page").alias("error"))


def write_pages(pages: DataFrame, run: str, per_file: int = 1000) -> None:
    """Pages under run/pages, one JSON object a line, `per_file` a file, so that each is read back whole."""
    fields = pages.sparkSession.createDataFrame([], PAGE).columns
    pages.select(*(f for f in fields if f in pages.columns)).write.mode("overwrite").option("maxRecordsPerFile", per_file).json(f"{run}/pages")


def write_report(frames: dict[str, DataFrame], report: dict, run: str) -> None:
    """A crawl's report: each frame of crawl_report as JSON lines under its name, and the totals as one object."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").json(f"{run}/{name}")
    spark = next(iter(frames.values())).sparkSession
    spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{run}/report.json")


def process_run(spark: SparkSession, root: str, run: str | None = None) -> str:
    found = run or newest_run(spark, root, "process_")
    if found is None:
        raise FileNotFoundError(f"no process_ folder under {root}")
    return found


def read_chunks(spark: SparkSession, run: str) -> DataFrame:
    """Chunks of chunks.jsonl, invalid lines left out; without that file, those nested in documents/*.json."""
    fs, path = _fs(spark, f"{run}/chunks.jsonl")
    if fs.exists(path):
        rows = spark.read.text(str(path)).filter(is_object("value"))
        return rows.select(F.from_json("value", CHUNK).alias("c")).select("c.*")
    fields = ",".join(f.replace(" ", ":", 1) for f in CHUNK.split(", "))
    docs = _objects(spark, f"{run}/documents").filter("good").select(F.from_json("value", f"document_id string, chunks array<struct<{fields}>>").alias("d"))
    return nested_chunks(docs.select("d.*"))


def nested_chunks(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("document_id").alias("of"), F.explode("chunks").alias("c")).select("of", "c.*")
    return rows.withColumn("document_id", F.coalesce(F.nullif("document_id", F.lit("")), "of")).drop("of")


def write_run(documents: DataFrame, chunks: DataFrame, report: dict, run: str) -> None:
    """Documents, chunks (also if there are none) and a report under run."""
    documents.write.mode("overwrite").json(f"{run}/documents")
    chunks.write.mode("overwrite").json(f"{run}/chunks.jsonl")
    spark = documents.sparkSession
    spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{run}/report.json")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """State from a file {"urls": {url: record}} or {url: record}, or from a folder that write_state wrote.

    The record's own url wins, blank ones go, and a bad file is empty.
    """
    from quern.operators.crawl import STATE

    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], STATE)
    if fs.getFileStatus(p).isDirectory():
        rows = spark.read.schema(STATE).json(path).select(F.lit(None).cast("string").alias("key"), F.struct("*").alias("r"))
    else:
        text = spark.read.text(path, wholetext=True)
        wrapped = F.from_json("value", f"struct<urls:map<string,struct<{RECORD}>>>")["urls"]
        bare = F.from_json("value", f"map<string,struct<{RECORD}>>")
        rows = text.select(F.explode(F.coalesce(wrapped, bare)).alias("key", "r")).filter("r IS NOT NULL")
    links = F.coalesce("r.document_links", F.array().cast("array<string>")).alias("document_links")
    fields = [blank(f"r.{c}").alias(c) for c in ("title", "content_hash", "last_scraped", "last_updated")]
    status = F.coalesce(F.nullif("r.status", F.lit("")), F.lit("PENDING")).alias("status")
    return rows.select(F.coalesce("r.url", "key").alias("url"), *fields, status, blank("r.error").alias("error"), links).filter("url <> ''")


def write_state(state: DataFrame, path: str, now: str = "") -> None:
    """A folder with a JSON record a line, by url over all files, each with the time of writing; read_state reads it."""
    state.withColumn("updated_at", F.lit(now)).orderBy("url").write.mode("overwrite").json(path)
