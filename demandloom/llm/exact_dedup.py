"""Exact deduplication as a stream: keyed state on disk that never expires, and a check of full bytes on hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm.common import BLANKS
from demandloom.session import cut_lineage, scratch_path

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Otherwise each state partition sets 4 MB aside for its manifest.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def normalized(text: Column) -> Column:
    """Runs of white space become one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def digests(docs: DataFrame) -> DataFrame:
    """Digest, stable id and content locator of each document of a (streaming) file scan."""
    return docs.select(
        F.col("doc_id"),
        F.sha2(normalized(F.col("text")), 256).alias("text_sha256"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.row_index").alias("row_index"),
    )


def holders(rows: DataFrame) -> DataFrame:
    """Per digest the smallest id with its locator and the number of rows, in batch or as a stateful aggregate."""
    # A row without an id never stands before one with an id.
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "file_path", "row_index")
    return rows.groupBy("text_sha256").agg(F.min(first).alias("holder"), F.count("*").alias("group_size"))


def _run(frame: DataFrame, sink: str, checkpoint: str, mode: str, **options: str) -> None:
    writer = frame.writeStream.format(sink).outputMode(mode).option("checkpointLocation", checkpoint)
    writer.options(**options).trigger(availableNow=True).start().awaitTermination()


def remember(spark: SparkSession, path: str, folder: str, files_per_batch: int = 256) -> tuple[DataFrame, DataFrame]:
    """Stream the Parquet table at `path` into the state kept in `folder`.

    Returns the digest rows seen so far and the state: one holder and count per digest. A later call with the same
    folder reads only files that are new, as both checkpoints and the RocksDB state live in the folder. Both queries
    take batches of `files_per_batch` files; a batch pre-aggregates before it reaches the state, so a digest that a
    third of all rows share is one update per task.
    """
    before = {k: spark.conf.get(k, None) for k in STATE}
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    listing = {"maxFilesPerTrigger": str(files_per_batch)}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        # As a pattern the path may name one file as well as a folder; a plain streaming path must be a folder.
        stream = spark.readStream.schema(schema).options(**listing).parquet(f"{path[:-1]}[{path[-1]}]")
        rows = f"{folder}/digests"
        _run(digests(stream), "parquet", f"{folder}/digests-log", "append", path=rows)
        seen = spark.read.parquet(rows)
        keyed = spark.readStream.schema(seen.schema).options(**listing).parquet(rows)
        _run(holders(keyed), "noop", f"{folder}/state", "update")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(f"{folder}/state")
    value = [f.name for f in state.schema["value"].dataType.fields]
    held = state.select(
        F.col("key").getField(state.schema["key"].dataType.fields[0].name).alias("text_sha256"),
        F.col("value").getField(value[0]).alias("holder"),
        F.col("value").getField(value[1]).alias("group_size"),
    )
    return seen, held


def false_hits(docs: DataFrame, held: DataFrame) -> DataFrame:
    """Digests whose rows don't all have the same bytes.

    Full normalised texts of the hits are compared inside their group through the smallest and the largest of them,
    which combine before the shuffle, so that a large group of copies never meets in one task.
    """
    hits = held.where("group_size > 1").select("text_sha256")
    texts = docs.select(normalized(F.col("text")).alias("_text")).withColumn("text_sha256", F.sha2("_text", 256))
    groups = texts.join(hits, "text_sha256", "left_semi").groupBy("text_sha256")
    return groups.agg(F.min("_text").alias("_a"), F.max("_text").alias("_b")).where("_a <> _b").select("text_sha256")


def exact_dedup(spark: SparkSession, path: str, *, folder: str | None = None, files_per_batch: int = 256) -> DataFrame:
    """Exact copies of the documents table at `path`, equal after white space runs become one space.

    Returns one row per document, dropped ones too: doc_id, text_sha256, keep_id, group_size, kept, and the locator of
    the copy that stays (keep_file, keep_row). The smallest doc_id stays; of rows that share it, the one that comes
    first by file and row. Null texts count as empty, and empty texts are copies of one another. A row without doc_id
    stays only where its whole group has none. An empty table gives no rows. Other columns are not read.
    """
    seen, held = remember(spark, path, folder or scratch_path(spark, "exact-dedup"), files_per_batch)
    docs = spark.read.parquet(path)
    clashes = cut_lineage(false_hits(docs, held))
    if clashes.isEmpty():
        joined = seen.join(held, "text_sha256")
    else:  # two texts under one digest: tell the groups of those digests apart by their bytes
        told = docs.withColumn("_text", normalized(F.col("text"))).select("doc_id", "_text", "_metadata.file_path", "_metadata.row_index")
        told = told.withColumn("text_sha256", F.sha2("_text", 256)).join(clashes, "text_sha256", "left_semi")
        exact = told.groupBy("text_sha256", "_text").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "file_path", "row_index")).alias("holder"),
            F.count("*").alias("group_size"),
        )
        apart = told.join(exact, ["text_sha256", "_text"]).drop("_text")
        joined = seen.join(clashes, "text_sha256", "left_anti").join(held, "text_sha256").unionByName(apart)
    here = (F.col("file_path") == F.col("holder.file_path")) & (F.col("row_index") == F.col("holder.row_index"))
    return joined.select(
        "doc_id",
        "text_sha256",
        F.col("holder.doc_id").alias("keep_id"),
        "group_size",
        here.alias("kept"),
        F.col("holder.file_path").alias("keep_file"),
        F.col("holder.row_index").alias("keep_row"),
    )
