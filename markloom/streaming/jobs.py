"""Job items as a stream: an append-only log, its latest state by key, roll-ups by job, progress over windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from markloom.functions import rules

#: Columns of the log; seq breaks ties of updated_at.
ITEM = "id string, job_id string, input string, fingerprint string, state string, stage string, output string, error string, updated_at timestamp, seq long"


def item_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream: files of items as they come."""
    return spark.readStream.schema(ITEM).json(path)


def append(items: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Writes items of a stream to the log, each once: the file sink commits a batch as a whole, and a restarted query
    goes on at its checkpoint. What is there is then written and the query ends."""
    return items.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(items: DataFrame) -> DataFrame:
    """The last row of each item; a maximum by key with map-side combine."""
    rest = [c for c in items.columns if c != "id"]
    last = items.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "seq")).alias("last"))
    return last.select("id", "last.*")


def job_states(items: DataFrame) -> DataFrame:
    """Counts, mean progress and state of each job from the latest state of its items."""
    base = F.create_map(*[F.lit(x) for kv in rules.STAGE_PROGRESS.items() for x in kv])
    n = latest(items).groupBy("job_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("state") == "completed").alias("completed"), F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(~F.col("state").isin(*rules.TERMINAL)).alias("open"), F.avg(F.when(F.col("state").isin(*rules.TERMINAL), 1.0).otherwise(F.coalesce(base[F.col("stage")], F.lit(0.0)))).alias("progress"),
    )
    state = F.when(F.col("open") > 0, "processing").when(F.col("failed") == F.col("total"), "failed").otherwise("completed")
    return n.withColumn("state", state)


def throughput(items: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Items finished by job and window of event time; those later than `late` are dropped with their window's state."""
    done = items.where(F.col("state").isin(*rules.TERMINAL)).withWatermark("updated_at", late)
    return done.groupBy("job_id", F.window("updated_at", window).alias("span")).agg(F.count("*").alias("finished"), F.count_if(F.col("state") == "failed").alias("failed"))


def to_resume(items: DataFrame, files: DataFrame) -> DataFrame:
    """(id, input, action) of the items of interrupted jobs against the `files` (path, fingerprint) there are now."""
    i, f = latest(items).alias("i"), files.select("path", F.col("fingerprint").alias("now")).alias("f")
    action = F.when(F.col("f.path").isNull(), "missing").when(F.col("f.now") != F.col("i.fingerprint"), "changed").when((F.col("i.state") == "completed") & F.col("i.output").isNotNull(), "done").otherwise("resume")
    return i.join(f, F.col("i.input") == F.col("f.path"), "left").select("i.id", "i.input", action.alias("action"))
