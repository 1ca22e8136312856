"""Exact joins of similar word sets within a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import pieces, word_set
from ..session import stage


def similar_pairs(sets: DataFrame, group: str, threshold: float = 0.8) -> DataFrame:
    """sets: group, words (array without repeats), n (how many members share the set). Pairs of different sets of a
    group whose Jaccard similarity is above the threshold: group, n_a, n_b.

    Prefix filtering: two sets above the threshold share one of the first |s| - ceil(t |s|) + 1 elements of a common
    order (rarest in the group first), so only those meet, on (group, element); a third of all rows in one group spreads
    over its elements. Every candidate is verified; nothing is capped."""
    numbered = sets.filter(F.size("words") > 0).withColumn("key", F.xxhash64(F.array_join(F.array_sort("words"), "\0")))
    freq = numbered.select(group, F.explode("words").alias("w")).groupBy(group, "w").agg(F.count("*").alias("f"))
    ranked = numbered.select(group, "key", "n", F.size("words").alias("size"), F.explode("words").alias("w")).join(freq, [group, "w"])
    ordered = stage(ranked.groupBy(group, "key", "n", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "w"))), lambda x: x["w"]).alias("words")), "sets")
    prefix = F.slice("words", F.lit(1), F.col("size") - F.ceil(F.col("size") * threshold).cast("int") + 1)
    p = ordered.select(group, "key", "size", F.explode(prefix).alias("w"))
    a, b = (p.select(group, "w", F.col("key").alias(f"k{x}"), F.col("size").alias(f"s{x}")) for x in "ab")
    # only keys meet; the words of a candidate are fetched once it is known to be one
    near = a.join(b, [group, "w"]).filter("ka < kb").filter(F.least("sa", "sb") > threshold * F.greatest("sa", "sb")).select(group, "ka", "kb").distinct()
    wa, wb = (ordered.select(group, F.col("key").alias(f"k{x}"), F.col("n").alias(f"n_{x}"), F.col("words").alias(f"w{x}")) for x in "ab")
    both = F.size(F.array_intersect("wa", "wb"))
    found = near.join(wa, [group, "ka"]).join(wb, [group, "kb"])
    return found.filter(both > threshold * (F.size("wa") + F.size("wb") - both)).select(group, "n_a", "n_b")


def repeated_count(sets: DataFrame, group: str, threshold: float = 0.8) -> DataFrame:
    """How many pairs of members of a group are similar: equal sets by arithmetic, different ones by `similar_pairs`."""
    equal = sets.groupBy(group).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("c"))
    other = similar_pairs(sets, group, threshold).groupBy(group).agg(F.sum(F.col("n_a") * F.col("n_b")).cast("long").alias("c"))
    return equal.unionByName(other).groupBy(group).agg(F.sum("c").alias("pairs"))


def sentence_sets(rows: DataFrame, group: str, column: str) -> DataFrame:
    """Distinct word sets of the sentences of a text, with how many sentences share each: group, words, n."""
    s = rows.filter(F.col(column).isNotNull()).select(group, F.explode(pieces(F.col(column), r"[.!?]+")).alias("s"))
    return s.select(group, F.array_sort(word_set(F.col("s"))).alias("words")).groupBy(group, "words").agg(F.count("*").alias("n"))
