"""Problem 7: filling containers of fixed capacity with texts.

Method: the configuration linear program over the histogram of lengths. Multiplicative weights keep a price for each
length; the dearest configuration at these prices comes from a knapsack by dynamic programming; the fractional solution
is rounded down and what is left is packed first-fit decreasing, class by class. Rounds end when no better packing than the one
reached is possible (a lower bound from the sum of lengths and from the prices). Only the histogram (at most `capacity` numbers) and the
configurations reach the driver, the programs are solved in tasks, one a capacity; every text finds its container from
its rank within its length class. Lengths are exact whatever the capacity.

A text above the capacity is divided into full containers and a rest, which is packed like a text; no other text is
divided. Nulls: null ids give no row; null, empty and other texts without a token need no container and give no row.
Repeated rows are packed each. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package, stage
from .tokens import with_tokens


def dearest_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> dict[int, int]:
    """Knapsack by dynamic programming: index of size -> how often, of the most valuable filling of the capacity."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1, np.int64)
    small = int(sizes[0])
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for w in range(small, capacity + 1):
        k = upto[w]
        v = best[w - sizes[:k]] + prices[:k]
        i = int(v.argmax())
        if v[i] > best[w - 1]:
            best[w], choice[w] = v[i], i
        else:
            best[w], choice[w] = best[w - 1], -2
    out: dict[int, int] = {}
    w = capacity
    while w >= small and choice[w] != -1:
        if choice[w] == -2:
            w -= 1
            continue
        i = int(choice[w])
        out[i] = out.get(i, 0) + 1
        w -= int(sizes[i])
    return out


def rounded(solution: dict[tuple, float], cover: np.ndarray, sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole copies of a fractional solution; what they leave is packed first-fit decreasing over classes."""
    scale = np.maximum(cover, 1.0)
    left = counts.astype(np.int64).copy()
    plan: list[tuple[dict[int, int], int]] = []
    for key, x in sorted(solution.items(), key=lambda kv: -kv[1]):
        k = int(x / max(scale[i] for i, _ in key))
        k = min([k, *(int(left[i] // a) for i, a in key)])
        if k > 0:
            plan.append((dict(key), k))
            for i, a in key:
                left[i] -= a * k
    open_ = np.flatnonzero(left)
    while len(open_):  # each round fills one container or more and uses up a class
        conf, room, top = {}, capacity, len(open_)
        while top:
            top = int(np.searchsorted(sizes[open_[:top]], room, side="right"))  # the longest that fits
            if not top:
                break
            top -= 1
            i = open_[top]
            a = min(int(left[i]), room // int(sizes[i]))
            conf[int(i)] = a
            room -= a * int(sizes[i])
        k = min(int(left[i] // a) for i, a in conf.items())
        plan.append((conf, k))
        for i, a in conf.items():
            left[i] -= a * k
        open_ = open_[left[open_] > 0]
    return plan


def solve_configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 256, rate: float = 0.5, passes: int = 6, first: int = 16) -> list[tuple[dict[int, int], int]]:
    """(configuration, copies) that together hold all counts of sizes (ascending, none above the capacity). Looks at the
    rounded plan after 1, 2, 4, ... rounds, keeps the best, and ends after `first` rounds when it needs no more containers than
    the lower bound."""
    if not len(sizes):
        return []
    n = counts.astype(float)
    cover = np.zeros(len(sizes))
    solution: dict[tuple, float] = {}
    bound, best, used, look = n @ sizes / capacity, None, 0, 1
    for turn in range(1, rounds + 1):
        open_ = cover < passes
        if open_.any():
            # a price is per text: lengths less covered so far are dearer, long ones too
            prices = np.where(open_, sizes * np.exp(-rate * (cover - cover[open_].min())) + 1e-9 * sizes, 0.0)
            conf = dearest_configuration(sizes, prices, capacity)
            bound = max(bound, n @ prices / sum(prices[i] * a for i, a in conf.items()))
            step = min(n[i] / a for i, a in conf.items())
            key = tuple(sorted(conf.items()))
            solution[key] = solution.get(key, 0.0) + step
            for i, a in conf.items():
                cover[i] += step * a / n[i]
        if turn == look or turn == rounds or not open_.any():
            plan = rounded(solution, cover, sizes, counts, capacity)
            now = sum(k for _, k in plan)
            if best is None or now < used:
                best, used = plan, now
            if turn >= first and used <= np.ceil(bound - 1e-6) or not open_.any():
                break
            look *= 2
    return best


def solve_in_tasks(spark: SparkSession, programs: list[tuple[int, dict[int, int]]]) -> list[list[tuple[dict[int, int], int]]]:
    """The plan of each (capacity, how many texts of each length), solved in one task each; configurations name lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                sizes = np.array(r["sizes"], np.int64)
                plan = solve_configurations(sizes, np.array(r["counts"], np.int64), r["capacity"])
                rows = [(r["program"], j, k, int(sizes[i]), a) for j, (conf, k) in enumerate(plan) for i, a in conf.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in map(list, zip(*rows))], ["program", "conf", "copies", "size", "each"])

    rows = [(j, capacity, sorted(h), [h[k] for k in sorted(h)]) for j, (capacity, h) in enumerate(programs)]
    if not rows:
        return []
    df = spark.createDataFrame(rows, "program long, capacity int, sizes array<long>, counts array<long>").repartitionByRange(len(rows), "program")
    plans: list[dict] = [{} for _ in programs]
    for r in df.mapInArrow(run, "program long, conf long, copies long, size long, each long").collect():  # bounded by capacity and rounds
        plans[r.program].setdefault(r.conf, (r.copies, {}))[1][r.size] = r.each
    return [[(conf, copies) for _, (copies, conf) in sorted(p.items())] for p in plans]


def ranked_items(counted: DataFrame, capacity: int) -> DataFrame:
    """Rest or whole text of each row with its length class, its rank within (part, class) and, for texts above the
    capacity, how many full containers come before its rest and their rank within the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)  # the last counts full containers; a rest is below the capacity
        for b in batches:
            t = b.column(1).to_numpy(zero_copy_only=False)
            full, rest = t // capacity, t % capacity
            cls = rest
            order = np.argsort(cls, kind="stable")
            s = cls[order]
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, int)
            rank = np.empty(len(s), np.int64)
            rank[order] = np.arange(len(s)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(s)]]))) + seen[s]
            seen[:capacity] += np.bincount(cls, minlength=capacity)
            before = np.cumsum(full) - full + seen[-1]
            seen[-1] += full.sum()
            cols = [b.column(0), pa.array(rest), pa.array(cls.astype(np.int32)), pa.array(rank), pa.array(full), pa.array(before)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "rest", "cls", "k", "full", "before"])

    out = counted.select("doc_id", "tokens").mapInArrow(run, "doc_id long, rest long, cls int, k long, full long, before long")
    return out.withColumn("part", F.spark_partition_id())


def pack(counted: DataFrame, *capacities: int) -> list[DataFrame]:
    """counted: doc_id, tokens. Gives container (from 0), doc_id, part (of the text, from 0), tokens for each capacity."""
    spark = counted.sparkSession
    ship_package(spark)
    items = [stage(ranked_items(counted, c), "items") for c in capacities]
    sizes = [stage(i.groupBy("part", "cls").agg(F.count("*").alias("n"), F.sum("full").alias("f")), "sizes") for i in items]
    histograms = [{r.cls: r.n for r in s.filter("cls > 0").groupBy("cls").agg(F.sum("n").alias("n")).collect()} for s in sizes]  # fewer rows than the capacity
    plans = solve_in_tasks(spark, list(zip(capacities, histograms)))
    return [place(*x) for x in zip(items, sizes, histograms, plans, capacities)]


def place(items: DataFrame, sizes: DataFrame, histogram: dict[int, int], plan: list[tuple[dict[int, int], int]], capacity: int) -> DataFrame:
    """Every text into the container that its rank within its length has in the plan."""
    spark = items.sparkSession
    # slots of each length: from this rank on, so many a container, counted from this container on
    slots: dict[int, list] = {k: [] for k in histogram}
    used = dict.fromkeys(histogram, 0)
    at = int(sizes.agg(F.sum("f")).first()[0] or 0)
    for conf, copies in plan:
        for k, a in conf.items():
            slots[k].append((used[k], a, at))
            used[k] += a * copies
        at += copies
    table = spark.sparkContext.broadcast({k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in slots.items()})  # bounded by capacity and rounds

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, rank = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            where = np.full(len(cls), -1, np.int64)
            for k in np.unique(cls):
                if k:
                    start, each, first = table.value[int(k)]
                    mine = cls == k
                    j = np.searchsorted(start, rank[mine], side="right") - 1
                    where[mine] = first[j] + (rank[mine] - start[j]) // each[j]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(where), b.column(4), b.column(5)], ["doc_id", "rest", "container", "full", "first_full"])

    by_class, by_part = Window.partitionBy("cls").orderBy("part"), Window.orderBy("part")  # one row a partition
    offsets = sizes.withColumn("o", F.sum("n").over(by_class) - F.col("n")).select("part", "cls", "o")
    parts = sizes.groupBy("part").agg(F.sum("f").alias("f")).withColumn("of", F.sum("f").over(by_part) - F.col("f")).select("part", "of")  # one row a partition
    ranked = items.join(offsets, ["part", "cls"]).join(parts, "part")
    placed = ranked.select("doc_id", "rest", "cls", (F.col("k") + F.col("o")).alias("rank"), "full", (F.col("before") + F.col("of")).alias("first_full")).mapInArrow(find, "doc_id long, rest long, container long, full long, first_full long")
    pieces = F.when(F.col("full") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("full") - 1), lambda i: F.struct((F.col("first_full") + i).alias("container"), i.cast("int").alias("part"), F.lit(capacity).cast("long").alias("tokens")))).otherwise(F.array().cast("array<struct<container:bigint,part:int,tokens:bigint>>"))
    rest = F.when(F.col("rest") > 0, F.array(F.struct("container", F.col("full").cast("int").alias("part"), F.col("rest").alias("tokens")))).otherwise(F.array().cast("array<struct<container:bigint,part:int,tokens:bigint>>"))
    return placed.select("doc_id", F.explode(F.concat(pieces, rest)).alias("x")).select("x.container", "doc_id", "x.part", "x.tokens")


def counted_documents(documents: DataFrame) -> DataFrame:
    return stage(with_tokens(documents.filter("doc_id is not null and text is not null and text <> ''"), {"doc_id": "long"}).filter("tokens > 0"), "counted")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of every text or piece of a text, for each capacity."""
    counted = counted_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = spark.read.parquet(f"{sf_dir}/containers.parquet").select("container_id", "capacity").filter("capacity > 0").orderBy("container_id").collect()  # one row a kind of container
    out = None
    for r, packed in zip(kinds, pack(counted, *[r.capacity for r in kinds])):
        one = packed.select(F.lit(r.container_id).alias("container_id"), F.lit(r.capacity).alias("capacity"), "container", "doc_id", "part", "tokens")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "container_id int, capacity int, container long, doc_id long, part int, tokens long")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each capacity: containers used, the least possible number, and the share of space filled."""
    g = p7_containers(spark, sf_dir).groupBy("container_id", "capacity", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    g = g.groupBy("container_id", "capacity").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.sum("n").alias("pieces"), F.max("t").alias("fullest"))
    return g.select("*", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("filled"))


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any packing: texts packed, containers above the capacity, texts divided though they would fit."""
    packed = p7_containers(spark, sf_dir)
    kind = ["container_id", "capacity"]
    over = packed.groupBy(*kind, "container").agg(F.sum("tokens").alias("t")).groupBy(*kind).agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"))
    texts = packed.groupBy(*kind, "doc_id").agg(F.sum("tokens").alias("t"), F.count_if(F.col("part") == 0).alias("n"), F.count("*").alias("pieces"))
    texts = texts.groupBy(*kind).agg(F.sum("n").alias("texts"), F.count_if((F.col("pieces") > F.col("n")) & (F.col("t") <= F.col("capacity"))).alias("divided"))
    return texts.join(over, kind).select(*kind, "texts", "overfull", "divided")


QUERIES = {"p7_containers": p7_containers, "p7_report": p7_report, "p7_totals": p7_totals}
SQL = {
    "p7_totals": """SELECT container_id, capacity, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL AND text <> '') AS texts, 0::BIGINT AS overfull, 0::BIGINT AS divided
FROM containers WHERE capacity > 0 AND EXISTS (SELECT 1 FROM documents WHERE doc_id IS NOT NULL AND text <> '')""",
}
