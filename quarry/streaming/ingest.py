"""Files that arrive in a folder, chunked and appended as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import admin, chunk, parse
from quarry.sources import documents


def chunked(found: DataFrame) -> DataFrame:
    """Chunks of files, from the columns of sources.documents.files()."""
    docs = documents.documents(found).where("error is null").withColumn("document_id", F.md5("path"))
    blocks = docs.select("document_id", "title", F.explode("blocks").alias("b")).select("document_id", "title", "b.*")
    made = chunk.chunk(chunk.units(parse.sections(blocks))).select("document_id", F.explode("chunks").alias("c")).select("document_id", "c.*")
    titled = made.join(docs.select("document_id", "title"), "document_id")
    return chunk.with_headers(titled).withColumn("id", F.concat_ws("::", "document_id", F.col("chunk_index").cast("string")))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Takes what is in the folder now; call again (or schedule) for later files. A file counts once, by its path."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)

    def batch(frame: DataFrame, number: int) -> None:
        named = frame.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length", "content")
        found = admin.verdicts(named).withColumn("file_type", F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)))
        chunked(found).write.mode("overwrite").parquet(f"{out}/batch={number}")  # repeating a batch replaces it

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
