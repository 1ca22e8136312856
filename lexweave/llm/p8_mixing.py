"""Problem 8: mixing sources to target shares.

Method: cube-method balanced sampling. The collection is as large as the caps allow; every text of a source gets the
same expected number of uses, a whole number and a fraction. The fractions move through the null space of two balancing
constraints (tokens and number of texts of the source) until each is 0 or 1: first within each partition, then the few
left over within each source, and the last two of a source are landed on the choice nearest to its target.

A text that occurs in several rows counts as one and is used at most max_repeats times in all; its least doc_id stands
for it, with that row's source. Sources without texts can't contribute; the others' targets are scaled to sum 1 and both
figures are reported. Nulls: rows with a null doc_id, source or text, empty texts, and sources without a target are not
drawn. Targets that are null or not positive draw nothing. Extra columns are not read.
"""

from __future__ import annotations

import random
from collections import defaultdict

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .batches import scan_partitions
from .tokens import with_tokens


def flight(items: list[tuple], rng: random.Random) -> tuple[list[tuple], list[tuple]]:
    """items: (key, tokens, probability), best the longest first, so that short ones are left. Moves probabilities so that their sum and their sum weighted by tokens stay as
    they are, until at most two (of different size) are neither 0 nor 1. Returns decided (key, tokens, 0 or 1) and the
    rest."""
    done: list[tuple] = []
    live: list[list] = []
    eps = 1e-9
    for item in items:
        live.append(list(item))
        while True:
            if len(live) >= 2 and live[-1][1] == live[-2][1]:
                move, u = live[-2:], (1.0, -1.0)
            elif len(live) >= 3:
                move = live[:3]
                x, y, z = (m[1] for m in move)
                u = (float(y - z), float(z - x), float(x - y))
            else:
                break
            up = min(((1 - m[2]) / d if d > 0 else m[2] / -d) for m, d in zip(move, u) if d)
            down = min((m[2] / d if d > 0 else (1 - m[2]) / -d) for m, d in zip(move, u) if d)
            step = up if rng.random() * (up + down) < down else -down
            for m, d in zip(move, u):
                m[2] += step * d
            live = [m for m in live if eps < m[2] < 1 - eps or done.append((m[0], m[1], int(m[2] > 0.5)))]
    return done, [tuple(m) for m in live]


def land(rest: list[tuple], wanted: float) -> list[tuple]:
    """Decides the last few of a source: of all choices the one whose tokens come nearest to what is wanted."""
    best = min(range(1 << len(rest)), key=lambda c: (abs(sum(r[1] for i, r in enumerate(rest) if c >> i & 1) - wanted), c))
    return [(r[0], r[1], best >> i & 1) for i, r in enumerate(rest)]


def texts_of(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Each distinct text of a source with a target once: doc_id, source, tokens. The text itself does not travel."""
    rows = documents.filter("doc_id is not null and source is not null and text is not null and text <> ''")
    rows = rows.join(targets.filter("target_share > 0 and max_repeats > 0").select("source").distinct(), "source", "left_semi")
    sized = with_tokens(rows.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.md5("text")), {"doc_id": "long", "source": "string", "h1": "long", "h2": "string"})
    one = sized.filter("tokens > 0").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("x"))
    return one.select("x.*")


def plan_shares(texts: DataFrame, targets: DataFrame) -> dict[str, dict]:
    """For each source: its scaled target, uses expected of each of its texts, and tokens wanted. One row a source."""
    have = {r.source: r for r in texts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("texts")).collect()}
    rows = {r.source: r for r in targets.filter("target_share > 0 and max_repeats > 0").collect()}
    total_share = sum(rows[s].target_share for s in rows if s in have)
    out = {s: {"target": rows[s].target_share, "scaled": rows[s].target_share / total_share if s in have else 0.0, "tokens": have[s].tokens if s in have else 0, "texts": have[s].texts if s in have else 0, "cap": rows[s].max_repeats} for s in rows}
    size = min((v["cap"] * v["tokens"] / v["scaled"] for v in out.values() if v["tokens"]), default=0.0)
    for v in out.values():
        v["wanted"] = size * v["scaled"]
        v["uses"] = min(float(v["cap"]), v["wanted"] / v["tokens"]) if v["tokens"] else 0.0
    return out


def draw(texts: DataFrame, shares: dict[str, dict], seed: int = 17) -> DataFrame:
    """doc_id, source, tokens, uses of every text drawn at least once."""
    uses = {s: v["uses"] for s, v in shares.items()}

    def start() -> dict:
        at = TaskContext.get()  # partitions must not draw alike, and each the same when it runs again
        return {"rng": random.Random(seed * 1_000_003 + (at.partitionId() if at else 0)), "rest": defaultdict(list)}

    def rows_of(done: list[tuple], source: str) -> list[tuple]:
        base = int(uses[source] + 1e-9)
        return [(k, source, t, base + d, None) for k, t, d in done]

    def columns(rows: list[tuple]) -> dict[str, object]:
        cols = list(zip(*rows)) if rows else [()] * 5
        return dict(zip(("doc_id", "source", "tokens", "uses", "p"), map(list, cols)))

    def step(st: dict, c: dict[str, list]) -> dict[str, object]:
        group = defaultdict(list)
        for k, s, t in zip(c["doc_id"], c["source"], c["tokens"]):
            group[s].append((k, t))
        rows = []
        for s, items in group.items():
            p = uses[s] - int(uses[s] + 1e-9)
            if p < 1e-9:
                rows += rows_of([(k, t, 0) for k, t in items], s)
                continue
            done, st["rest"][s] = flight(sorted(st["rest"][s] + [(k, t, p) for k, t in items], key=lambda x: -x[1]), st["rng"])
            rows += rows_of(done, s)
        return columns(rows)

    def end(st: dict) -> dict[str, object]:
        return columns([(k, s, t, int(uses[s] + 1e-9), p) for s, rest in st["rest"].items() for k, t, p in rest])

    schema = "doc_id long, source string, tokens long, uses int, p double"
    first = stage(scan_partitions(texts, schema, start, step, end, ()), "flight")
    wanted = {s: v["wanted"] for s, v in shares.items()}
    sure = {r.source: r.t for r in first.filter("p is null").groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("t")).collect()}  # one row a source

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:  # at most two texts a partition
        s = key[0]
        pdf = pdf.sort_values(["tokens", "doc_id"], ascending=[False, True])
        base = int(uses[s] + 1e-9)
        done, rest = flight(list(zip(pdf["doc_id"], pdf["tokens"], pdf["p"])), random.Random(seed))
        missing = wanted[s] - sure.get(s, 0) - sum(t * base for t in pdf["tokens"]) - sum(t * d for _, t, d in done)
        rows = [(k, s, t, base + d, None) for k, t, d in done + land(rest, missing)]
        return pd.DataFrame(rows, columns=["doc_id", "source", "tokens", "uses", "p"])

    last = first.filter("p is not null").groupBy("source").applyInPandas(finish, schema)
    decided = stage(first.filter("p is null").unionByName(last).select("doc_id", "source", "tokens", "uses"), "decided")
    return balance(decided, shares).filter("uses > 0")


def balance(decided: DataFrame, shares: dict[str, dict], rounds: int = 4) -> DataFrame:
    """A landing on a very long text can miss the target by half its length; then, at most `rounds` times, the text
    whose length is nearest to what is missing (or too much) gets one use more (or less)."""
    spark = decided.sparkSession
    spread = spark.createDataFrame([(s, v["wanted"], int(v["uses"] + 1e-9), v["cap"]) for s, v in shares.items() if v["uses"] > 0], "source string, wanted double, base int, cap int")
    flips: dict[int, int] = {}
    for _ in range(rounds):
        now = decided if not flips else decided.join(spark.createDataFrame(list(flips.items()), "doc_id long, flip int"), "doc_id", "left").withColumn("uses", F.col("uses") + F.coalesce("flip", F.lit(0))).drop("flip")
        error = spread.join(now.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("got")), "source").select("source", "base", "cap", (F.col("wanted") - F.col("got")).alias("e"))
        may = F.when(F.col("e") > 0, (F.col("uses") == F.col("base")) & (F.col("uses") < F.col("cap"))).otherwise(F.col("uses") > F.col("base")) & (F.abs(F.abs("e") - F.col("tokens")) < F.abs("e"))
        near = now.join(error, "source").filter(may).groupBy("source").agg(F.min(F.struct(F.abs(F.abs("e") - F.col("tokens")).alias("d"), F.col("doc_id"), F.signum("e").cast("int").alias("s"))).alias("x")).select("x.doc_id", "x.s").collect()  # one row a source
        if not near:
            break
        for r in near:
            flips[r.doc_id] = flips.get(r.doc_id, 0) + r.s
    if not flips:
        return decided
    return decided.join(spark.createDataFrame(list(flips.items()), "doc_id long, flip int"), "doc_id", "left").select("doc_id", "source", "tokens", (F.col("uses") + F.coalesce("flip", F.lit(0))).alias("uses"))


def _drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, dict]]:
    targets = spark.read.parquet(f"{sf_dir}/mix_targets.parquet")
    texts = stage(texts_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), targets), "texts")
    shares = plan_shares(texts, targets)
    return draw(texts, shares), shares


def p8_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts drawn, with how often each is used."""
    return _drawn(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source: target share, target scaled to the sources that have texts, share reached, uses, and the tokens
    by which the draw still misses what was wanted."""
    drawn, shares = _drawn(spark, sf_dir)
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.sum("uses").alias("documents"), F.max("uses").alias("most_uses"))
    want = spark.createDataFrame([(s, v["target"], v["scaled"], v["cap"], float(v["wanted"])) for s, v in shares.items()], "source string, target_share double, scaled_share double, max_repeats int, wanted double")
    got = stage(got, "shares")  # one row a source
    total = got.agg(F.sum("tokens")).first()[0] or 0
    j = want.join(got, "source", "left")
    zero = F.lit(0).cast("long")
    return j.select("source", "target_share", "scaled_share", "max_repeats", F.coalesce("tokens", zero).alias("tokens"), F.coalesce("documents", zero).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), (F.coalesce("tokens", zero) / F.lit(max(total, 1))).alias("actual_share"), (F.coalesce("tokens", zero) - F.col("wanted")).alias("residual_tokens"))


def p8_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any draw, for each source that has texts: texts used above the cap, texts of another source, texts drawn twice."""
    drawn, shares = _drawn(spark, sf_dir)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("own"), F.md5("text").alias("h"))
    caps = spark.createDataFrame([(s, v["cap"]) for s, v in shares.items() if v["texts"]], "source string, max_repeats int")
    j = caps.join(drawn.join(documents, "doc_id"), "source", "left")
    again = j.filter("h is not null").groupBy("source", "h").agg(F.count("*").alias("n")).groupBy("source").agg(F.count_if(F.col("n") > 1).alias("repeated"))
    g = j.groupBy("source", "max_repeats").agg(F.count_if(F.col("uses") > F.col("max_repeats")).alias("over_cap"), F.count_if(F.col("own") != F.col("source")).alias("other_source"))
    return g.join(again, "source", "left").withColumn("repeated", F.coalesce("repeated", F.lit(0).cast("long")))


QUERIES = {"p8_collection": p8_collection, "p8_shares": p8_shares, "p8_totals": p8_totals}
SQL = {
    "p8_totals": """WITH one AS (SELECT text, arg_min(source, doc_id) AS source FROM documents d
  WHERE doc_id IS NOT NULL AND text <> '' AND source IN (SELECT source FROM mix_targets WHERE target_share > 0 AND max_repeats > 0) GROUP BY text)
SELECT source, max_repeats, 0::BIGINT AS over_cap, 0::BIGINT AS other_source, 0::BIGINT AS repeated FROM mix_targets
WHERE target_share > 0 AND max_repeats > 0 AND source IN (SELECT source FROM one)""",
}
