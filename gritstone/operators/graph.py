"""Graph operators: closure, components, slices by depth, taint with summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.sources.tables import table


_own_folder: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names; where it names none, in a folder of this machine if all of Spark runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if not _own_folder:
            import tempfile

            _own_folder.append(tempfile.mkdtemp(prefix="gritstone-"))
        base = _own_folder[0]
    return f"{base.rstrip('/')}/gritstone/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage of an iteration."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables of an iteration; all but the result go when it ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(shared_path(self.spark, name))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def result(self, df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        for path in self.paths:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return out


#: Rounds after which what was found is written as one table again, so that plans don't grow with the longest path.
MERGE = 16


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = 12) -> DataFrame:
    """(node, depth): nodes within max_depth of the seeds (however far without one), with their least depth. Edges are (src, dst)."""
    rounds, depth = Rounds(edges.sparkSession), 0
    seen = rounds.keep(seeds.select(F.col("node"), F.lit(0).alias("depth")).distinct(), "reach")
    front = seen
    while max_depth is None or depth < max_depth:
        depth += 1
        front = rounds.keep(front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if depth % MERGE == 0:
            seen = rounds.keep(seen, "reach")
    return rounds.result(seen, "reached")


def connected(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node reachable over edges in either direction."""
    rounds = Rounds(edges.sparkSession)
    both = rounds.keep(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select("dst", "src")).distinct(), "edges")
    labels = rounds.keep(both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("comp")), "labels")
    while True:
        low = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("comp").alias("low"))
        step = labels.join(low, labels.node == low.u).select("node", F.col("comp").alias("was"), F.least("comp", "low").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("comp").alias("far"))
        step = rounds.keep(step.join(jump, "near", "left").select("node", "was", F.least("near", "far").alias("comp")), "labels")
        if step.filter("was <> comp").isEmpty():
            return rounds.result(step.select("node", "comp"), "components")
        labels = step.select("node", "comp")


def business_edges(spark: SparkSession, d: str) -> DataFrame:
    """nation to customer to order to part, as text nodes."""
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c = table(spark, d, "customer").select(node("n", "c_nationkey").alias("src"), node("c", "c_custkey").alias("dst"))
    o = table(spark, d, "orders").select(node("c", "o_custkey").alias("src"), node("o", "o_orderkey").alias("dst"))
    p = table(spark, d, "lineitem").select(node("o", "l_orderkey").alias("src"), node("p", "l_partkey").alias("dst")).distinct()
    return c.union(o).union(p)


def reach_closure(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    return reach(business_edges(spark, d), seeds).withColumn("depth", F.col("depth").cast("long"))


def connected_areas(spark: SparkSession, d: str, most: int = 8) -> DataFrame:
    """Components of nations joined by a supplier balance band; areas beyond the seven largest become misc."""
    s = table(spark, d, "supplier")
    edges = s.select(F.col("s_nationkey").cast("long").alias("src"), (F.col("s_nationkey") - F.col("s_nationkey") % 3).cast("long").alias("dst"))
    sizes = connected(edges).groupBy("comp").agg(F.count("*").alias("nodes"))
    rank = F.row_number().over(_order(F.desc("nodes"), F.col("comp")))  # one row an area
    n = F.count("*").over(_all())
    return sizes.withColumn("area", F.when((n > most) & (rank > most - 1), F.lit("misc")).otherwise(F.col("comp").cast("string"))).groupBy("area").agg(F.sum("nodes").alias("nodes"), F.count("*").alias("components"))


def sink_slice_depth(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that lead to large finished orders, by depth against the edges."""
    sinks = table(spark, d, "orders").filter("o_orderstatus = 'F' and o_orderpriority = '1-URGENT' and o_totalprice > 200000").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    back = business_edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(back, sinks, 12).groupBy("depth").agg(F.count("*").alias("nodes")).withColumn("depth", F.col("depth").cast("long"))


def taint(flows: DataFrame, sources: DataFrame, sinks: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(source, sink, sanitized): facts over flow edges (src, dst), to the fixpoint. Sanitizers mark a path and never end it; a node
    in ``cleaned`` (reassigned from a constant) ends it."""
    rounds, n = Rounds(flows.sparkSession), 0
    seen = rounds.keep(sources.select(F.col("node").alias("source"), F.col("node"), F.lit(False).alias("sanitized")).distinct(), "taint")
    front = seen
    while True:  # facts are finite, and each round adds some or ends
        n += 1
        step = front.join(flows, front["node"] == flows["src"]).select("source", F.col("dst").alias("node"), (F.col("sanitized") | F.coalesce(F.col("sanitizer"), F.lit(False))).alias("sanitized")).distinct()
        front = rounds.keep(step.join(cleaned, "node", "left_anti").join(seen, ["source", "node", "sanitized"], "left_anti"), "taint")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if n % MERGE == 0:
            seen = rounds.keep(seen, "taint")
    return rounds.result(seen.join(sinks, "node").select("source", F.col("node").alias("sink"), "sanitized").distinct(), "tainted")


def _order(*cols):
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(*cols)


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))
