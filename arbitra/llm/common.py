"""Words, scratch tables and connected components, shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitra.session import scratch_dir

# A word is a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), f)[0]


class Scratch:
    """Intermediate Parquet tables under the folder that the cluster shares.

    A written table cuts the lineage and is read again after a lost executor.
    ``drop`` removes one as soon as nothing reads it any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        # each frame with its path: a frame that is held keeps its id()
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_dir(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            _, path = self.paths.pop(id(df), (None, None))
            if path:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` of an undirected graph given as rows ``(a, b)``: the component is
    the smallest node that can be reached. Only nodes with an edge to another node appear.

    Alternates the large-star and the small-star step, which end after a number of rounds
    that grows with the logarithm of the graph. Each step keeps one minimum per node and
    never gathers a node's neighbours, so a hub is an ordinary (skewed) join key.
    """
    cur = scratch.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc"
    )  # always a > b
    state = None
    while True:
        both = cur.unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        mid = scratch.write(large.where("a <> b"), "cc")
        scratch.drop(cur)
        least = mid.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            mid.join(least, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        cur = scratch.write(small, "cc")
        scratch.drop(mid)
        # A star forest (every node points at a root, no root points anywhere) no longer changes.
        now = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
