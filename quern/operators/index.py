"""The chunk index: records in buckets by hash of id, refreshed in full or where something changed.

A bucket is a folder of Parquet; a small manifest says which folder holds each bucket, and the index's metadata. A refresh
writes the buckets that it touches anew, in a folder of its own, and then a manifest, which appears whole under the next
number; untouched buckets stay where they are. The manifest with the highest number counts, so a change that breaks off
leaves the index as it was, and of two writers at once the second fails and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import blank, strip
from quern.operators.frames import checkpointed

#: The metadata that a record keeps.
METADATA = ("page_title", "url", "section", "heading", "crawl_timestamp", "source_type", "source", "token_count", "content_hash", "access", "scraped_date", "document_id", "chunk_id")


def normalize_records(chunks: DataFrame, pos: str = "pos") -> DataFrame:
    """Records (id, text, metadata) of chunks in input order: blank ids and texts go, and the first of an id stays."""
    rows = chunks.withColumn("id", strip(blank("chunk_id"))).withColumn("text", strip(blank("text"))).filter("id <> '' AND text <> ''")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(pos))).filter("nth = 1")
    kept = [F.col("id").alias("chunk_id") if c == "chunk_id" else F.col(c) for c in METADATA if c in rows.columns]
    return rows.select("id", "text", F.col(pos).alias("pos"), *kept, *(c for c in ("embedding",) if c in rows.columns))


def skip_existing(records: DataFrame, index: DataFrame) -> DataFrame:
    return records.join(index.select("id"), "id", "left_anti")


def stale(index: DataFrame, records: DataFrame) -> DataFrame:
    """Index rows of the batch's URLs whose hash is not among the batch's for that URL; rows without a hash are never stale."""
    fresh = records.filter("coalesce(url, '') <> '' AND coalesce(content_hash, '') <> ''").select("url", "content_hash").distinct()
    rows = index.filter("coalesce(content_hash, '') <> ''").join(fresh.select("url").distinct(), "url", "left_semi")
    return rows.join(fresh, ["url", "content_hash"], "left_anti")


def upsert(index: DataFrame, records: DataFrame) -> DataFrame:
    """index with records in place of rows of the same id."""
    return index.join(records.select("id"), "id", "left_anti").unionByName(records, allowMissingColumns=True)


def delete(index: DataFrame, gone: DataFrame) -> DataFrame:
    return index.join(gone.select("id"), "id", "left_anti")


def get_by_ids(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("id").distinct(), "id", "left_semi")


def get_by_metadata(index: DataFrame, **equal) -> DataFrame:
    for column, value in equal.items():
        index = index.filter(F.col(column) == F.lit(value))
    return index


def hashes_by_url(records: DataFrame) -> DataFrame:
    rows = records.filter("coalesce(url, '') <> '' AND coalesce(content_hash, '') <> ''")
    return rows.groupBy("url").agg(F.array_sort(F.collect_set("content_hash")).alias("hashes"))


def changes(index: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gone, fresh): stale rows go first, so that an id that was kept over an edit is taken anew; then known ids are skipped.

    Of index only id, url and content_hash are read.
    """
    known = index.select("id", "url", "content_hash")
    gone = stale(known, records)
    return gone, skip_existing(records, delete(known, gone))


def incremental(index: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new index, stats) of index after the changes that chunks bring."""
    records = normalize_records(chunks)
    gone, fresh = changes(index, records)
    after = delete(index, gone).unionByName(fresh, allowMissingColumns=True)
    return after, stats(chunks, records, fresh, after, "incremental", gone)


def full(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    records = normalize_records(chunks)
    return records, stats(chunks, records, records, records, "full")


def stats(chunks: DataFrame, records: DataFrame, upserted: DataFrame, after: DataFrame, mode: str, gone: DataFrame | None = None) -> DataFrame:
    """One row; skipped_invalid counts duplicates too."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = n(chunks, "loaded").crossJoin(n(records, "valid")).crossJoin(n(upserted, "upserted")).crossJoin(n(after, "collection_count"))
    out = out.crossJoin(n(gone, "stale")) if gone is not None else out.withColumn("stale", F.lit(0).cast("long"))
    return out.select(
        F.lit(mode).alias("mode"), "loaded", "upserted", (F.col("valid") - F.col("upserted")).alias("skipped_existing"), (F.col("loaded") - F.col("valid")).alias("skipped_invalid"), "stale", "collection_count"
    )


#: Buckets of an index; a bucket is what a refresh writes at least.
BUCKETS = 64


def bucket_of(id: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(buckets)).cast("int")


class Index:
    """Buckets under a folder that Spark can write to; the manifest is read and written through Spark too."""

    def __init__(self, spark: SparkSession, path: str, schema: str, embed: Callable[[DataFrame], DataFrame] | None = None, model: str = "none", buckets: int = BUCKETS):
        """buckets holds for an index that is new; one that is there keeps its number."""
        self.spark, self.path, self.schema, self.embed, self.model, self._new_buckets = spark, path.rstrip("/"), schema, embed, model, buckets

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str = "") -> list[str]:
        fs, root = self._path(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(root)) if fs.exists(root) else []

    def _manifests(self) -> list[int]:
        ends = [n.removeprefix("manifest-").removesuffix(".json") for n in self._names() if n.startswith("manifest-") and n.endswith(".json")]
        return sorted(int(n) for n in ends if n.isdigit())

    def _load(self, number: int) -> dict:
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/manifest-{number}.json").collect()))

    def manifest(self) -> dict:
        """live: the number of the last write, or None for no index; folders: where each bucket with records is."""
        known = self._manifests()
        if not known:
            return {"live": None, "space": "cosine", "embedding_model": self.model, "writes": 0, "buckets": self._new_buckets, "folders": {}}
        return self._load(known[-1])

    def _point(self, before: list[int], manifest: dict) -> None:
        """The manifest under the number after those of before; an error if another writer has taken it."""
        number = max(before, default=-1) + 1
        fs, beside = self._path(f"_manifest-{uuid.uuid4().hex}.json")
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps(manifest | {"embedding_model": self.model}).encode()))
        out.close()
        target = self._path(f"manifest-{number}.json")[1]
        if fs.exists(target) or not fs.rename(beside, target):
            fs.delete(beside, False)
            raise RuntimeError(f"manifest {number} was written by someone else")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete folders that none of the last `keep` manifests names, and all manifests before those; names of the folders that went."""
        known = self._manifests()
        last = known[-max(1, keep) :]
        used = {f for n in last for f in self._load(n)["folders"].values()}
        gone = [n for n in self._names() if n.startswith("data-") and n not in used]
        for name in (*gone, *(f"manifest-{n}.json" for n in known if n not in last)):
            fs, path = self._path(name)
            fs.delete(path, True)
        return gone

    def read(self, only: set[int] | None = None) -> DataFrame:
        """All records, or those of some buckets."""
        folders = self.manifest()["folders"]
        paths = [f"{self.path}/{f}/bucket={b}" for b, f in sorted(folders.items()) if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, records: DataFrame, touched: set[int] | None = None, before: list[int] | None = None) -> list[int]:
        """Put records in place of what the touched buckets hold, or of the whole index; numbers of the buckets written.

        before: the manifests that records come from; without it, those of now.
        """
        before = self._manifests() if before is None else before
        old = self._load(before[-1]) if before else self.manifest()
        fields = self.spark.createDataFrame([], self.schema).schema.fields
        rows = records.select(*((F.col(f.name) if f.name in records.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields), bucket_of("id", old["buckets"]).alias("bucket"))
        folder = f"data-{uuid.uuid4().hex}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        written = sorted(int(n.removeprefix("bucket=")) for n in self._names(folder) if n.startswith("bucket="))
        kept = {b: f for b, f in old["folders"].items() if touched is not None and int(b) not in touched}
        self._point(before, old | {"live": old["writes"], "writes": old["writes"] + 1, "folders": kept | {str(b): folder for b in written}})
        return written

    def clear(self) -> None:
        self._point(self._manifests(), self.manifest() | {"live": None, "folders": {}})

    def count(self) -> int:
        return self.read().count()

    def peek(self, n: int = 5) -> DataFrame:
        return self.read().orderBy("id").limit(n)

    def refresh(self, chunks: DataFrame, mode: str = "incremental") -> dict:
        """Take in chunks, in place of the whole index or where they bring changes; the figures of stats.

        An incremental refresh reads ids, URLs and hashes of all buckets, and whole records only of those it writes.
        """
        before, live = self._manifests(), self.manifest()
        chunks = checkpointed(self.embed(chunks) if self.embed else chunks)  # it is gone through for the figures and for the records
        if mode == "full" or not live["folders"]:
            if mode == "full":
                after = checkpointed(normalize_records(chunks))  # counted and written
                figures = stats(chunks, after, after, after, "full")
            else:
                after, figures = incremental(self.read(), chunks)
            out = figures.first().asDict()
            self.write(after, None, before)
            return out
        records = checkpointed(normalize_records(chunks))
        gone, fresh = map(checkpointed, changes(self.read(), records))
        ids = gone.select("id").unionByName(fresh.select("id"))
        touched = {r.b for r in ids.select(bucket_of("id", live["buckets"]).alias("b")).distinct().collect()}
        n = lambda df: df.count()
        out = {
            "mode": "incremental", "loaded": n(chunks), "upserted": n(fresh), "skipped_existing": n(records) - n(fresh), "skipped_invalid": n(chunks) - n(records), "stale": n(gone),
            "collection_count": self.count() - n(gone) + n(fresh),
        }
        if touched:
            self.write(delete(self.read(touched), gone).unionByName(fresh, allowMissingColumns=True), touched, before)
        return out
