"""Mixing sources to target weights with a multivariate-hypergeometric
splitting tree.  DataFrame operations only.

1. Targets: the mix is ``share`` of all words, dealt to the sources by weight;
   a source gets ``max_epochs`` times its words at most and the rest goes to
   the others by weight, until none is above.
2. Blocks: each source's documents are hashed into blocks of about
   ``block_words`` words.  A pass goes through a source's blocks in permuted
   order, and the second pass (another permutation) starts when the first is
   used up; the last block of a source is drawn in part, document by document,
   up to the target.  Blocks are disjoint, so no pass takes a document twice.
3. Tree: the exact numbers of blocks drawn from each source are split among
   the output shards.  Each node sends half of its blocks to the left; how many
   of each source go left is one draw of the multivariate hypergeometric
   distribution (source by source, conditional on what is left), so every shard
   gets the mix's proportions up to chance, and the counts add up exactly.
4. A shard's rows are ordered by a keyed hash (the local shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import WORD, fresh, stage

WEIGHTS = (5.0, 2.0, 1.0)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(totals: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``source, source_size, n_docs, target`` from one row per source.

    Water filling: with the sources in ascending order of limit / weight, the
    level that the rest would get rises until the first source that stays below
    its limit, and falls from there; its maximum is the level.  One row per
    source, so a single ordered window is small.
    """
    every = Window.partitionBy()
    ranked = totals.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.select("*", w.alias("w"), (F.col("source_size") * F.lit(float(max_epochs))).alias("most"))
    before = Window.orderBy(F.col("most") / F.col("w"), "n").rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
             / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("level", F.max("level").over(every))
    return ranked.select("source", "source_size", "n_docs", F.least("most", F.col("w") * F.col("level")).alias("target"))


def _unit(*cols) -> Column:
    """A keyed hash as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def hypergeometric(total: Column, marked: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` (without replacement, from ``total`` of which
    ``marked`` are marked) are marked: the inverse of the distribution at ``u``.
    The support is walked over 12 standard deviations around the mean; what
    lies beyond has less weight than a double can tell from zero.
    """
    n, k, m = total.cast("double"), marked.cast("double"), draws.cast("double")
    mean = m * k / F.greatest(n, F.lit(1.0))
    sd = F.sqrt(F.greatest(F.lit(0.0), mean * (n - k) / F.greatest(n, F.lit(1.0))
                           * (n - m) / F.greatest(n - 1, F.lit(1.0))))
    low = F.greatest(F.lit(0.0), m - (n - k), F.floor(mean - 12 * sd - 2).cast("double"))
    high = F.least(k, m, F.ceil(mean + 12 * sd + 2).cast("double"))

    def ratio(x):  # weight of x + 1 over weight of x
        return (k - x) * (m - x) / F.greatest((x + 1) * (n - k - m + x + 1), F.lit(1.0))

    steps = F.sequence(low.cast("bigint"), F.greatest(low, high).cast("bigint"))
    zero, one = F.lit(0.0), F.lit(1.0)
    weight = F.aggregate(steps, F.struct(one.alias("w"), zero.alias("sum")),
                         lambda a, x: F.struct((a["w"] * ratio(x.cast("double"))).alias("w"),
                                               (a["sum"] + a["w"]).alias("sum")),
                         lambda a: a["sum"])
    return F.aggregate(
        steps, F.struct(one.alias("w"), (u * weight).alias("left"), low.cast("bigint").alias("x")),
        lambda a, x: F.struct(
            (a["w"] * ratio(x.cast("double"))).alias("w"), (a["left"] - a["w"]).alias("left"),
            F.when((a["left"] >= 0) & (x > a["x"]), x).otherwise(a["x"]).alias("x")),
        lambda a: F.least(a["x"], F.greatest(low, high).cast("bigint")))


def split(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """``shard, s, q``: the quotas (one row: array ``quotas``, one number per
    source) split among 2**levels shards."""
    nodes = quotas.select(F.lit(0).cast("bigint").alias("node"), F.col("quotas"))
    for level in range(levels):
        count = F.aggregate("quotas", F.lit(0).cast("bigint"), lambda a, x: a + x)
        nodes = nodes.withColumn("n", count)

        def draw(a, s):
            """What is left of the node after source ``s``: ``c`` still to go
            left of ``n`` blocks, given what the sources before sent left."""
            own = F.element_at(F.col("quotas"), (s + 1).cast("int"))
            open_ = a["c"] - F.aggregate(a["out"], F.lit(0).cast("bigint"), lambda x, y: x + y)
            got = hypergeometric(a["n"], own, open_, _unit(F.lit(seed), F.lit(level), F.col("node"), s))
            return F.struct((a["n"] - own).alias("n"), a["c"].alias("c"), F.array_append(a["out"], got).alias("out"))

        start = F.struct(F.col("n").alias("n"), F.expr("n div 2").alias("c"),
                         F.array().cast("array<bigint>").alias("out"))
        left = F.aggregate(F.sequence(F.lit(0), F.size("quotas") - 1), start, draw, lambda a: a["out"])
        nodes = nodes.select("node", "quotas", left.alias("lefts"))
        nodes = nodes.select("node", F.posexplode(F.array(
            F.col("lefts"), F.zip_with("quotas", "lefts", lambda x, y: x - y))).alias("side", "quotas"))
        nodes = nodes.select((F.col("node") * 2 + F.col("side")).alias("node"), "quotas")
        if level % 3 == 2:
            nodes = stage(nodes, "tree")
    return nodes.select(F.col("node").alias("shard"), F.posexplode("quotas").alias("s", "q"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights=WEIGHTS, share: float = 1.5, max_epochs: int = 2, block_words: int = 1 << 20,
         shard_words: int = 1 << 23, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size,
    target, taken, row_hash, draws`` (draws: array of ``epoch, shard,
    position``, empty if the row is not in the mix).

    Size: the words of the text, 0 for a null one.  A null source is a source
    (last in order).  A document is taken whole: the last one of a source if
    more than half of it lies below the target.  Ids may repeat or be null;
    rows equal in every column are drawn in turn and cannot be told apart, and
    hash to the same block, which is then as large as they are together.
    Documents without words are never taken.  An empty table gives an empty
    result.  Reruns agree: every choice is a hash of ``seed`` and the row.
    """
    rows = stage(docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                             F.col(source_col).cast("string").alias("source"),
                             size_of(F.col(text_col)).alias("size"),
                             F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_hash")), "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    goal = targets(totals, weights, share, max_epochs)
    block_rows = max(1, block_words // 64)
    goal = stage(goal.select("*", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words),
                                             F.ceil(F.col("n_docs") / block_rows)).cast("bigint").alias("n_blocks"),
                             (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("s")),
                 "targets")
    same = F.col("r.source").eqNullSafe(F.col("g.source"))
    # hot sources: the join splits by size (AQE); from here the key is (source number, block)
    rows = (rows.alias("r").join(goal.alias("g"), same)
            .select("r.*", "g.source_size", "g.target", "g.s",
                    F.pmod(F.xxhash64(F.lit(seed), "r.row_hash"), F.col("g.n_blocks")).alias("block")))
    sizes = rows.groupBy("s", "block").agg(F.sum("size").alias("words"), F.first("target").alias("target"))
    passes = sizes.where("words > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"))
    order = Window.partitionBy("s").orderBy("epoch", F.xxhash64(F.lit(seed), "epoch", "s", "block"), "block")
    passes = passes.withColumn("before", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    drawn = passes.select("s", "block", "epoch", F.greatest(F.lit(0.0), F.least(
        F.col("words").cast("double"), F.col("target") - F.coalesce("before", F.lit(0)))).alias("draw")).where("draw > 0")
    deal = Window.partitionBy("s").orderBy(F.xxhash64(F.lit(seed + 1), "epoch", "s", "block"), "epoch", "block")
    drawn = stage(drawn.withColumn("rank", F.row_number().over(deal) - 1), "drawn")

    words = drawn.agg(F.sum("draw")).first()[0] or 0.0  # one number
    levels = max(0, int(words / shard_words)).bit_length()
    quotas = (goal.select("s").join(drawn.groupBy("s").agg(F.count("*").alias("q")), "s", "left")
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("s", F.coalesce("q", F.lit(0)).alias("q")))),
                               lambda x: x["q"].cast("bigint")).alias("quotas")))  # a number per source
    leaves = split(quotas, levels, seed)
    upto = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    leaves = leaves.withColumn("a", F.coalesce(F.sum("q").over(upto), F.lit(0))).where("q > 0")
    dealt = leaves.select("s", "shard", F.explode(F.sequence(F.col("a"), F.col("a") + F.col("q") - 1)).alias("rank"))
    drawn = drawn.join(dealt, ["s", "rank"]).groupBy("s", "block").agg(
        F.sort_array(F.collect_list(F.struct("epoch", "draw", "shard"))).alias("parts"))  # max_epochs at most

    inside = Window.partitionBy("s", "block").orderBy("row_hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("upto", F.sum("size").over(inside)).join(drawn, ["s", "block"], "left")
    middle = F.col("upto") - F.col("size") / 2
    parts = F.filter(F.coalesce("parts", F.array().cast("array<struct<epoch:int,draw:double,shard:bigint>>")),
                     lambda p: (middle <= p["draw"]) & (F.col("size") > 0))
    draws = F.transform(parts, lambda p: F.struct(
        p["epoch"].alias("epoch"), p["shard"].alias("shard"),
        F.xxhash64(F.lit(seed + 2), p["epoch"], "row_hash").alias("position")))
    out = out.select("doc_id", "source", "size", "source_size", "target", "row_hash", draws.alias("draws"))
    return out.withColumn("taken", F.size("draws") * F.col("size"))


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it was drawn, laid
    out shard by shard in shuffled order; all columns kept.  Which of several
    rows equal in every column was drawn makes no difference."""
    drawn = (plan(docs, id_col, **options).where("taken > 0")
             .select("doc_id", "row_hash", F.explode("draws").alias("at"))
             .groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("at.shard", "at.position")).alias("__at"))
             .select(F.col("doc_id").alias("__drawn_id"), F.col("row_hash").alias("__drawn_hash"), "__at"))
    key, at = fresh(docs, "__row_hash"), fresh(docs, "__shard")
    own = docs.withColumn(key, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).dropDuplicates([id_col, key])
    out = own.alias("d").join(drawn, F.col(f"d.`{id_col}`").cast("bigint").eqNullSafe(F.col("__drawn_id"))
                              & (F.col(f"d.`{key}`") == F.col("__drawn_hash")))
    out = out.select("d.*", F.explode("__at").alias(at))
    return (out.repartition(F.col(f"{at}.shard")).sortWithinPartitions(f"{at}.shard", f"{at}.position")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
