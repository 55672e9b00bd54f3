"""Streaming forms (survey R1-R9, F7, J30, W10): the same operators over streams of files."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import checkpoints, settle
from ..operators import sketch
from ..operators.log import LOG


def tail_log(spark: SparkSession, path: str, schema: str = LOG, files_at_once: int = 100) -> DataFrame:
    """New log files as they come, so many at once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table as a stream of its files, be it one file or a folder of them."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(path)


def windowed_counts(events: DataFrame, ts: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling counts by event time; rows later than the watermark are dropped."""
    t = F.col(ts).cast("timestamp")
    return events.withColumn("_t", t).withWatermark("_t", late).groupBy(F.window("_t", window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def author_sessions(events: DataFrame, ts: str, by: str, gap: str = "7 days", late: str = "7 days") -> DataFrame:
    """Sessions of an author; a gap of exactly the limit stays in one."""
    t = F.col(ts).cast("timestamp")
    return events.withColumn("_t", t).withWatermark("_t", late).groupBy(F.session_window("_t", gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def first_seen(packages: DataFrame, ts: str, late: str = "1 day") -> DataFrame:
    """Each package once, state bounded by the watermark."""
    return packages.withWatermark(ts, late).dropDuplicatesWithinWatermark(["name"])


def incremental(batch: DataFrame, batch_id: int, state_path: str, key: list[str]) -> DataFrame:
    """Rows of a batch whose key (path and digest, say) the state lacks; they are added to it.  For foreachBatch.

    The state is a folder of one part a batch.  A batch that is run again reads the parts
    of the batches before it and overwrites its own, so it neither loses nor repeats keys.
    """
    spark = batch.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state_path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    new = batch
    if there:
        schema = batch.select(*key).schema.add("batch", "long")
        known = spark.read.schema(schema).parquet(state_path).where(F.col("batch") < batch_id).select(*key)
        new = batch.join(known.distinct(), key, "left_anti")
    new = settle(new)  # read twice: written, and returned
    new.select(*key).distinct().write.mode("overwrite").parquet(f"{state_path.rstrip('/')}/batch={batch_id}")
    return new


def compacted(spark: SparkSession, state_path: str, upto: int, key: list[str]) -> None:
    """The parts of batches up to one number as one part, so the state does not grow by a folder a batch for ever."""
    root = state_path.rstrip("/")
    old = spark.read.parquet(root).where(F.col("batch") <= upto)
    settle(old.select(*key).distinct()).write.mode("overwrite").parquet(f"{root}/batch={upto}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for n in range(upto):
        p = hadoop.Path(f"{root}/batch={n}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def probed(batch: DataFrame, batch_id: int, index_path: str, threshold: float = 0.85) -> DataFrame:
    """A batch of signatures (repo_slug, pr_number, sketch) against those of the batches before it and its own, then added to them.  For foreachBatch."""
    spark = batch.sparkSession
    batch = settle(batch.select("repo_slug", "pr_number", "sketch"))
    batch.write.mode("overwrite").parquet(f"{index_path.rstrip('/')}/batch={batch_id}")
    index = spark.read.schema(batch.schema.add("batch", "long")).parquet(index_path).where(F.col("batch") <= batch_id).drop("batch")
    return sketch.collisions(batch, index, threshold)


def with_registry(stream: DataFrame, registry_path: str, apply, sink) -> object:
    """A query that reads the registry anew for each batch: apply(batch, registry) -> rows, sink(rows, batch_id)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(apply(batch, batch.sparkSession.read.parquet(registry_path)), batch_id)

    return stream.writeStream.foreachBatch(each)


def hash_chain(rows: list[str], previous: str = "") -> list[str]:
    """Digests that each cover their row and the digest before; a log is sequential by its nature, so this runs where it is written."""
    out = []
    for row in rows:
        previous = hashlib.sha384((previous + row).encode()).hexdigest()
        out.append(previous)
    return out


def chain_holds(chain: DataFrame) -> DataFrame:
    """The numbers of rows (seq without gaps, row, digest) of a written chain that do not follow from the one before; each needs its neighbour only, so this is an equality join."""
    before = chain.select((F.col("seq") + 1).alias("seq"), F.col("digest").alias("before"))
    joined = chain.join(before, "seq", "left")
    return joined.where(F.col("digest") != F.sha2(F.concat(F.coalesce("before", F.lit("")), "row"), 384)).select("seq")


def run_available(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that a stream has now, written as a table in the shared folder and read again."""
    spark = stream.sparkSession
    root = f"{checkpoints(spark).rstrip('/')}/vellum-stream-{name}-{uuid.uuid4().hex}"

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows" if mode == "complete" else f"{root}/rows/batch={batch_id}")

    q = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{root}/rows")
    return found
