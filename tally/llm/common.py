"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.session import scratch_path, ship_package

#: A word: a run of anything but ASCII white space (space, \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"
#: The white-space characters that end a word.
BLANKS = " \t\n\x0b\f\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared scratch folder and read it back.

    This cuts the lineage: what follows reads files that any executor can
    read again, so a lost executor costs no recomputation of what came before.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches, rows: int = 500):
    """Arrow batches in parts of ``rows`` rows, so that few texts at a time
    become Python strings."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has two bigint columns ``a`` and ``b``.  Returns ``node, root``
    (root: the smallest node reachable) for every node on an edge with two
    different ends; an empty table for no such edges.  Each step is a grouped
    minimum (combined before the shuffle) and an equi-join, so no node's
    neighbours are ever gathered in one task, and the rounds grow with the
    logarithm of the component size.  Every round is staged in the shared
    folder; the driver sees two numbers a round.
    """
    cur = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = stage(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        cur = stage(small, "small")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = tuple(now)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
