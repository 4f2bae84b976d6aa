"""Streams: rows looked up as their files arrive, and id dictionaries that outlive a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.linking import sequential_ids
from ..operators.lookup import reverse_lookup
from ..operators.terminology import unresolved
from ..sources.scratch import kept


def look_up_arrivals(spark: SparkSession, arriving: str, schema: str, entities: DataFrame, ids: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Rows of new files whose title is blank, with title and outcome, appended to a table. Stops when all files are read; started
    again with the same checkpoint it takes only files that came since."""
    rows = spark.readStream.schema(schema).parquet(arriving)
    pending = unresolved(rows, "title").drop("title")
    return reverse_lookup(pending, entities, ids).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def grow_ids(spark: SparkSession, arriving: str, table: str, checkpoint: str) -> StreamingQuery:
    """Keys (key, pos) of new files get ids after those in the table, a folder of one part a batch.

    Which keys have been seen is the stream's own keyed state, in RocksDB under the checkpoint, so a batch costs what its own keys cost: it
    reads no earlier part, but the ids that were there before the first batch, and the last number of the batch before. A key counts from
    its first batch on, by its least pos there. A batch that runs again has the same state and time, so the same keys are new,
    and writes the same part over its old one."""
    id_schema, head_schema, heads = "key string, number long, code string", "top long", f"{table.rstrip('/')}-heads"

    def batch(new: DataFrame, batch_id: int) -> None:
        own = new.sparkSession
        seed = own.read.schema(id_schema).parquet(f"{table}/batch=-1")
        top = own.read.schema(head_schema).parquet(f"{heads}/batch={batch_id - 1}") if batch_id else seed.agg(F.coalesce(F.max("number"), F.lit(0)).alias("top"))
        ids = kept(sequential_ids(new.select("key", "first.pos"), seed.select("key", "number"), top=top), "new-ids")
        ids.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        top.unionByName(ids.select(F.col("number").alias("top"))).agg(F.max("top").alias("top")).write.mode("overwrite").parquet(f"{heads}/batch={batch_id}")

    spark.createDataFrame([], id_schema).write.mode("ignore").parquet(f"{table}/batch=-1")
    seen = spark.readStream.schema("key string, pos long").parquet(arriving).withColumn("seen", F.current_timestamp())  # the batch's own time
    state = seen.groupBy("key").agg(F.min(F.struct("seen", "pos")).alias("first"), F.max("seen").alias("last"))
    setting, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(setting, ROCKS)
    try:
        return state.where("first.seen = last").writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, before)
