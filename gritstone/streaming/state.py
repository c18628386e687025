"""Streams: event windows, triage state, watch deltas. Each also has a batch form with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.operators.graph import shared_path
from gritstone.sources.tables import table


def windowed(events: DataFrame, length: str = "1 hour") -> DataFrame:
    """Counts and values by window and type; works on a stream (with a watermark) and on a table."""
    rows = events.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def table_stream(spark: SparkSession, d: str, name: str, files_each: int | None = None) -> DataFrame:
    """A table's files as a stream, be the table a file or a folder of part files; ``files_each`` bounds a micro-batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", "*.parquet" if folder else f"{name}.parquet")
    if files_each:
        reader = reader.option("maxFilesPerTrigger", files_each)
    return reader.parquet(f"{d}/{name}.parquet" if folder else d)


def run_to_table(stream: DataFrame, name: str, mode: str = "append", key: list[str] | None = None, at: str | None = None) -> DataFrame:
    """Run a stream over what is there now, into a table; exactly once by the checkpoint, as a batch that is run again writes its own folder again. With ``key`` the
    last batch's row of each key counts (update mode). ``at`` names the folder of a run that is to be gone on with."""
    spark = stream.sparkSession
    at = at or shared_path(spark, name)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/check").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{at}/rows")
    if key:
        rows = rows.groupBy(*key).agg(F.max_by(F.struct(*stream.columns), "epoch").alias("__row")).select("__row.*")
    return rows.select(*stream.columns)


def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Event windows of a stream in update mode: a window's state goes when the watermark has passed it, and the sink keeps each window's last row."""
    stream = table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return run_to_table(windowed(stream.withWatermark("ts", "2 hours")), "windows", "update", ["window_start", "event_type"])


def triage_stream(scans: DataFrame, at: str) -> DataFrame:
    """The triage store after a stream of scans' findings (scan, id): each micro-batch's scans are applied in order to the store of the batch before. The store is a
    folder for each batch; a batch that is run again starts from the same store, so a run that was cut off and gone on with ends like one that wasn't."""
    from gritstone.operators.lifecycle import empty_triage, sync_triage

    spark = scans.sparkSession
    store = lambda epoch: f"{at}/store/epoch={epoch}"

    def apply(batch: DataFrame, epoch: int) -> None:
        state = spark.read.parquet(store(epoch - 1)) if epoch else empty_triage(spark)
        for n, r in enumerate(batch.select("scan").distinct().orderBy("scan").collect()):  # the scans of one batch, a few numbers
            state = sync_triage(state, batch.filter(F.col("scan") == r["scan"]), r["scan"])
            path = f"{at}/steps/epoch={epoch}/{n}"
            state.write.mode("overwrite").parquet(path)
            state = spark.read.parquet(path)
        state.write.mode("overwrite").parquet(store(epoch))
        (spark.createDataFrame([(epoch,)], "epoch long")).write.mode("overwrite").parquet(f"{at}/last")

    q = scans.writeStream.option("checkpointLocation", f"{at}/check").trigger(availableNow=True).foreachBatch(apply).start()
    q.awaitTermination()
    last = spark.read.parquet(f"{at}/last").first()["epoch"]
    return spark.read.parquet(store(last))


def triage_sync(spark: SparkSession, d: str) -> DataFrame:
    """Each day of errors is a scan that sees users: the store after all days, by state and the day of opening. Scans come as files, a day a file."""
    days = table(spark, d, "events").filter("event_type = 'error'").select(F.datediff(F.col("ts"), F.lit("2024-01-01")).cast("long").alias("scan"), F.col("user_id").alias("id")).distinct()
    at = shared_path(spark, "triage")
    days.repartitionByRange(4, "scan").sortWithinPartitions("scan").write.parquet(f"{at}/scans")
    stream = spark.readStream.schema(days.schema).parquet(f"{at}/scans")
    return triage_stream(stream, at).groupBy("state", "opened").agg(F.count("*").alias("n"))


def triage_state(spark: SparkSession, d: str) -> DataFrame:
    """Each user's state after all events: error opens, purchase fixes, signup after a fix reopens nothing (fixed is final
    until the next error)."""
    events = table(spark, d, "events").filter("event_type in ('error', 'purchase')")
    last = events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("event_id").alias("last_event"))
    return last.select("user_id", F.when(F.col("last") == "error", "open").otherwise("fixed").alias("state"), "errors", "last_event")


def watch_delta(before: DataFrame, now: DataFrame, most: int = 50, batch: str | None = None) -> DataFrame:
    """Added and fixed findings by key between two states; nothing when more than ``most`` paths changed at once (of a ``batch`` by itself, where rows name theirs)."""
    key = ["path", "line", "rule"]
    added, fixed = now.join(before, key, "left_anti").withColumn("change", F.lit("added")), before.join(now, key, "left_anti").withColumn("change", F.lit("fixed"))
    of = [batch] if batch else []
    both = added.select(*of, *key, "change").unionByName(fixed.select(*of, *key, "change"))
    if batch:
        calm = both.groupBy(batch).agg(F.countDistinct("path").alias("__n")).filter(F.col("__n") <= most).select(batch)
        return both.join(calm, batch, "left_semi")
    burst = both.agg((F.countDistinct("path") > most).alias("burst"))
    return both.join(F.broadcast(burst), ~F.col("burst")).drop("burst")  # the other side is one row


def alerts_once(components: DataFrame, advisories: DataFrame, late: str = "7 days") -> DataFrame:
    """Alerts of a stream of components (name, ecosystem, seen) against a table of advisories (name, ecosystem, advisory), each advisory once for
    a component within ``late``. The table side is static, so only the alerts given are kept as state, and they expire."""
    rows = components.join(advisories, ["ecosystem", "name"])
    keys = ["advisory", "ecosystem", "name"]
    return rows.withWatermark("seen", late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Events as components (their type, by user), users with a value over 50 as advisories of that type; an alert for each user and type once."""
    events = table(spark, d, "events")
    name = F.col("user_id").cast("string").alias("name")
    advisories = events.filter("value > 50").select(F.col("event_type").alias("ecosystem"), name, F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("advisory")).distinct()
    rows = table_stream(spark, d, "events").select(F.col("event_type").alias("ecosystem"), name, F.col("ts").cast("timestamp").alias("seen"))
    out = alerts_once(rows, advisories, "3650 days").select("advisory", "ecosystem")
    return run_to_table(out, "alerts")
