"""The work queue as a stream: new URLs merge into a frontier table, progress is counted as it goes.

Each batch is merged once by its number (a batch that is run again overwrites what it wrote), so a restart from the checkpoint loses and doubles nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from siteloom import model
from siteloom.functions import urls as U
from siteloom.operators.base import small

QUEUED, IN_PROGRESS, DONE, FAILED = range(4)
KEEP = 5


def discovered(spark: SparkSession, path: str) -> DataFrame:
    """A stream of frontier rows from Parquet files in ``path``."""
    return spark.readStream.schema(model.schema("frontier")).parquet(path)


def merged(known: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``found`` that are not known yet, one for each project and normal address: the highest priority, then the first."""
    key = found.withColumn("norm", U.normalize_with_query(F.col("address")))
    first = Window.partitionBy("project_id", "norm").orderBy(F.desc("priority"), "enqueued", "address")
    one = key.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return one.join(known.select("project_id", U.normalize_with_query(F.col("address")).alias("norm")).distinct(), ["project_id", "norm"], "left_anti").drop("norm").select(found.columns)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, on whatever file system its path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def moved(frontier: DataFrame, changes: DataFrame) -> DataFrame:
    """The queue after state changes (project_id, address, state): an address' last state, of equals the highest, so that a page that is done never goes back by a repeated change."""
    last = changes.groupBy("project_id", "address").agg(F.max(F.col("state").cast("tinyint")).alias("to"))
    return frontier.join(last, ["project_id", "address"], "left").withColumn("state", F.coalesce("to", "state")).drop("to").select(frontier.columns)


def requeued(frontier: DataFrame, stale: bool = True, failed: bool = False) -> DataFrame:
    """The queue as a crawl resumes it: what was in progress when it stopped is queued again, and, if wanted, what failed."""
    back = [s for s, wanted in ((IN_PROGRESS, stale), (FAILED, failed)) if wanted]
    return frontier.withColumn("state", F.when(F.col("state").isin(back), F.lit(QUEUED)).otherwise(F.col("state")).cast("tinyint")) if back else frontier


def states(frontier: DataFrame) -> DataFrame:
    """(project_id, queued, in_progress, done, failed) counts of each project."""
    return frontier.groupBy("project_id").agg(*(F.count_if(F.col("state") == s).alias(n) for n, s in (("queued", QUEUED), ("in_progress", IN_PROGRESS), ("done", DONE), ("failed", FAILED))))


def start(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Merge the stream into ``table``, a folder with a part for each batch.

    Only a folder that is not there is an empty frontier; an error of reading one that is there fails the batch, which is then run again. Of the known rows, addresses alone are read, and
    only those of the batch's projects.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.createDataFrame([], model.schema("frontier"))
        if exists(spark, table):
            known = spark.read.schema(model.schema("frontier").add("batch", "long")).parquet(table).where(F.col("batch") < number).join(batch.select("project_id").distinct(), "project_id", "left_semi")
        merged(known, batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def following(frontier: DataFrame, n: int, project: int | None = None) -> DataFrame:
    """The next rows to crawl: highest priority, then longest queued."""
    rows = frontier.where(F.col("state") == QUEUED)
    return (rows if project is None else rows.where(F.col("project_id") == project)).orderBy(F.desc("priority"), "enqueued", "address").limit(n)


def admitted(found: DataFrame, projects: DataFrame, known_counts: DataFrame) -> DataFrame:
    """Discovered links as frontier rows: (project_id, address, from_depth, is_resource). Internal pages lie one deeper, resources as deep as their page, external ones at -1 with a low
    priority; what is deeper than the project allows, or beyond its number of URLs, is left out."""
    rows = found.join(small(projects.select("project_id", "base_url", "max_depth", "max_urls")), "project_id").join(small(known_counts), "project_id", "left").fillna(0, ["n_known"])
    outside = U.is_external(F.col("base_url"), F.col("address"))
    depth = F.when(outside, -1).when(F.col("is_resource"), F.col("from_depth")).otherwise(F.col("from_depth") + 1)
    placed = rows.withColumns({"depth": depth, "priority": F.when(outside, 50).otherwise(100 - F.least(depth, F.lit(50)))}).where(F.col("depth") <= F.col("max_depth"))
    order = Window.partitionBy("project_id").orderBy(F.desc("priority"), "depth", "address")
    best = placed.groupBy("project_id", "address").agg(F.min_by(F.struct("priority", "depth", "n_known", "max_urls"), F.struct(-F.col("priority"), "depth")).alias("x")).select("project_id", "address", "x.*")
    one = best.withColumn("_n", F.row_number().over(order)).where(F.col("_n") + F.col("n_known") <= F.col("max_urls"))
    return one.select("project_id", "address", F.col("priority").cast("int").alias("priority"), F.col("depth").cast("int").alias("depth"), U.host(F.col("address")).alias("host_key"), F.lit(QUEUED).cast("tinyint").alias("state"))


def kept_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """The last five of each project."""
    last = Window.partitionBy("project_id").orderBy(F.desc("created"), F.desc("checkpoint_id"))
    return checkpoints.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= KEEP).drop("_n")


def politeness(fetches: DataFrame) -> DataFrame:
    """(host, ts, gap): seconds since the host's previous fetch."""
    return fetches.withColumn("gap", F.col("ts").cast("double") - F.lag("ts").over(Window.partitionBy("host").orderBy("ts")).cast("double"))


def unique_events(events: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """A stream without repeated rows, its state bounded by the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


class Progress(StreamingQueryListener):
    """Rows and rate of each batch, for whoever shows progress."""

    def __init__(self):
        self.seen: list[tuple[str, int, float]] = []

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.seen.append((str(p.id), p.numInputRows, p.processedRowsPerSecond))

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
