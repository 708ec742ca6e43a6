"""Mixing sources to target weights by a splitting tree.

Every source is cut into blocks by a seeded hash. The words a source owes the mix are whole
passes over its blocks plus a last, partial pass in permuted block order, so its quota is an
exact number of block takes. The takes of all sources form one pool. A splitting tree deals the
pool to the output shards: at every node half of the pool, drawn without replacement, goes left,
so that the shares of the sources there follow the multivariate hypergeometric law. Halving one
random permutation again and again is this very draw; hence the leaves are read off the rank in
the permutation (``hashed_rank``, which never sorts the pool in one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qamill.llm.common import n_words, source_key
from qamill.operators.ranking import hashed_rank

WEIGHTS = (5, 2, 1)  # by the rank of the source in code point order, repeating
MOST = 3             # no source and no document is taken more often
BLOCKS = 1024        # blocks per source


def _digest(*columns) -> Column:
    return F.md5(F.concat_ws("\x1f", *[c if isinstance(c, Column) else F.col(c) for c in columns]))


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(_src, source, size) -> one row per source: source_size, weight, target.

    Targets share the sum of all sizes by weight and stop at ``most`` times the size of the
    source; the excess is shared by weight among the others until none is above. With the sources
    in order of ``most * size / weight`` the first level that its own source does not exceed is
    the water level of all that follow. One small row per source is all that is sorted here.
    """
    sources = sized.groupBy("_src").agg(
        F.max("source").alias("source"), F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("_place", place).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                               (F.col("_place") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * float(most)
    before = W.orderBy(cap / F.col("weight"), "_place").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    level = (F.sum(F.col("source_size")).over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    sources = sources.withColumn("_level", level)
    fits = F.when(F.col("_level") <= cap / F.col("weight"),
                  F.struct((cap / F.col("weight")).alias("r"), F.col("_place"), F.col("_level").alias("l")))
    sources = sources.withColumn("_water", F.min(fits).over(everything).getField("l"))
    target = F.coalesce(F.least(cap, F.col("_water") * F.col("weight")), F.lit(0.0))
    return sources.select("_src", "source_size", "weight", target.alias("target"))


def plan_mix(
    docs: DataFrame, keep: list[str], shards: int = 8, seed: int = 4,
    weights=WEIGHTS, most: int = MOST, blocks: int = BLOCKS,
) -> DataFrame:
    """For every document ``doc`` (a struct of the columns ``keep``), size, source_size, target,
    taken and takes.

    ``takes`` lists (epoch, shard, words) of each time the mix takes the document; the last pass
    may end within a document, which then gives its first ``words`` words. ``taken`` is their sum.
    A null text or a text without words has size 0 and is never taken. A null source is a source
    of its own, last in order. Documents with equal ids share a block; ties within a block are
    broken by size. No document is dropped: those that are not taken have ``taken`` 0.
    """
    sized = docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("_doc"), source_key(F.col("source")).alias("_src"),
        F.col("source").cast("string").alias("_source"), n_words(F.col("text")).alias("_size"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(blocks)).alias("_block"),
        _digest(F.col("doc_id").cast("string"), F.lit(str(seed))).alias("_pick"))
    light = sized.select("_src", F.col("_source").alias("source"), F.col("_size").alias("size"), "_block")
    targets = source_targets(light, weights, most)
    by_block = light.groupBy("_src", "_block").agg(F.sum("size").alias("_words"))
    by_block = by_block.where(F.col("_words") > 0).join(targets, "_src")
    passes = F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size"))).cast("int")
    rest = F.round("target").cast("long") - F.col("_passes") * F.col("source_size")
    order = W.partitionBy("_src").orderBy(_digest("_src", F.col("_block").cast("string"), F.lit(str(seed))))
    permuted = by_block.withColumn("_passes", passes).withColumn(
        "_part", F.greatest(F.lit(0).cast("long"), F.least(
            F.col("_words"), rest - (F.sum("_words").over(order) - F.col("_words")))))
    epochs = F.sequence(F.lit(1), F.col("_passes") + F.when(F.col("_part") > 0, 1).otherwise(0))
    some = (F.col("_passes") > 0) | (F.col("_part") > 0)
    pool = permuted.where(some).select("_src", "_block", F.explode(epochs).alias("_epoch")).withColumn(
        "_one", F.lit(1)).withColumn("_pick", _digest(
            "_src", F.col("_block").cast("string"), F.col("_epoch").cast("string"), F.lit(f"pool{seed}")))
    dealt = hashed_rank(pool, ["_one"], "_pick", "_src", digits=2)
    leaf = F.floor((F.col("rank_ix") - 1) * shards / F.col("group_size")).cast("int")
    dealt = dealt.groupBy("_src", "_block").agg(
        F.map_from_entries(F.collect_list(F.struct("_epoch", leaf))).alias("_leaves"))
    plan = permuted.select("_src", "_block", "_passes", "_part").join(dealt, ["_src", "_block"], "left")
    inner = W.partitionBy("_src", "_block").orderBy("_pick", "_size")
    laid = sized.withColumn("_before", F.sum("_size").over(
        inner.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_size"))
    full = laid.join(plan, ["_src", "_block"], "left").join(
        targets.select(F.col("_src").alias("_t"), F.col("source_size").alias("_ss"), "target"),
        F.col("_src") == F.col("_t"))
    zero = F.lit(0).cast("long")
    passes_of = F.when(F.col("_size") > 0, F.coalesce("_passes", F.lit(0))).otherwise(0)
    part = F.greatest(zero, F.least(F.col("_size"), F.coalesce("_part", zero) - F.col("_before")))
    full = full.withColumn("_p", passes_of).withColumn("_part_words", part)
    words = lambda e: F.when(e <= F.col("_p"), F.col("_size")).otherwise(F.col("_part_words"))
    takes = F.filter(
        F.transform(F.sequence(F.lit(1), F.col("_p") + 1), lambda e: F.struct(
            e.alias("epoch"), F.element_at("_leaves", e).alias("shard"), words(e).alias("words"))),
        lambda t: t["words"] > 0)
    return full.select(
        F.col("_doc").alias("doc"), F.col("_size").alias("size"), F.col("_ss").alias("source_size"), "target",
        (F.col("_p") * F.col("_size") + F.col("_part_words")).cast("long").alias("taken"),
        takes.alias("takes"))


def mixture(docs: DataFrame, shards: int = 8, seed: int = 4, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: columns of ``docs`` plus epoch and shard, one row per take, shuffled locally.

    A take of fewer words than the text has keeps the first words, joined by single spaces. Rows
    of a shard come in a seeded random order within each partition. Columns of ``docs`` that are
    named epoch or shard are replaced.
    """
    columns = [c for c in docs.columns if c not in ("epoch", "shard")]
    plan = plan_mix(docs, columns, shards, seed, weights, most)
    taken = plan.select("doc", "size", F.explode("takes").alias("take"))
    words = F.filter(F.split(F.col("doc.text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    head = F.array_join(F.slice(words, F.lit(1), F.col("take.words").cast("int")), " ")
    text = F.when(F.col("take.words") < F.col("size"), head).otherwise(F.col("doc.text"))
    order = F.xxhash64(F.col("doc.doc_id").cast("string"), F.col("take.epoch"), F.lit(seed + 1))
    out = taken.select(
        *[text.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in columns],
        F.col("take.epoch").alias("epoch"), F.col("take.shard").alias("shard"), order.alias("_order"))
    return out.sortWithinPartitions("shard", "_order").drop("_order")


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, and the shards it goes to."""
    return plan_mix(docs, ["doc_id"]).select(
        F.col("doc.doc_id").alias("doc_id"), "size", "source_size", F.col("target").cast("double"),
        "taken", F.transform("takes", lambda t: t["shard"]).alias("shards"))
