"""Bounded context for model calls, from stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, set_jaccard, word_count, words
from ..session import small_side, stage
from .store import is_filled

SIZE, PREFILL, WORD_LIMIT = 5, 3, 512
#: Paragraphs of a stretch whose rows one task puts in order, and numbers of a block in which values come together.
SPAN, BLOCK = 256, 1000


#: What a context holds of each pair.
PAIR, PAIR_TYPE = ("id", "source", "target", "words"), "struct<id:bigint,source:string,target:string,words:int>"


def pair_words(source: Column, target: Column) -> Column:
    return word_count(source) + word_count(target)


def admissible(source: Column, target: Column) -> Column:
    """Both have words, and a source of more than five words is not nearly its target."""
    def ok(a: Column, b: Column) -> Column:
        alike = let(set_jaccard, F.array_distinct(a), F.array_distinct(b))
        return (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(a) <= 5) | (alike <= 0.95))

    return let(ok, words(F.lower(source)), words(F.lower(target)))


def chapter_rank(rows: DataFrame) -> DataFrame:
    """Chapters in translation order: metadata, then most paragraphs first, then number."""
    g = rows.groupBy("book", "edition", "chapter").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("book", "edition").orderBy((F.col("chapter") != 0).cast("int"), F.desc("_n"), "chapter")
    return rows.join(g.withColumn("chapter_rank", F.row_number().over(w)).drop("_n"), ["book", "edition", "chapter"])


def numbered(ranked: DataFrame, weight: Column, name: str = "_n") -> DataFrame:
    """How much weight stands before each row of its book and edition, in the order of chapter_rank, paragraph and id.
    Sums run within stretches of SPAN paragraphs and over the table of stretches, so that no task has a whole book."""
    at = ["book", "edition", "chapter_rank", "_stretch"]
    r = ranked.withColumn("_stretch", F.floor(F.col("paragraph") / SPAN)).withColumn("_w", weight)
    sums = r.groupBy(*at).agg(F.sum("_w").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("book", "edition").orderBy("chapter_rank", "_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(k).alias(f"r{k}") for k in at], before.alias("_before"))
    same = [r[k].eqNullSafe(sums[f"r{k}"]) for k in at]
    j = r.join(sums, same[0] & same[1] & same[2] & same[3])
    own = F.coalesce(F.sum("_w").over(Window.partitionBy(*at).orderBy("paragraph", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return j.withColumn(name, F.col("_before") + own).drop("_stretch", "_w", "_before", *[f"r{k}" for k in at])


def rolling(ranked: DataFrame, value: Column, size: int = SIZE) -> DataFrame:
    """Rows with `context`: the value of up to `size` rows before each in its book and edition, oldest first. Values move
    once, into blocks of BLOCK numbers; the last rows of a block go along to the next."""
    n = numbered(ranked, F.lit(1), "_n").withColumn("_value", value)
    block = F.floor(F.col("_n") / BLOCK)
    ahead = F.col("_n") % BLOCK >= BLOCK - size
    n = n.withColumn("_block", F.explode(F.when(ahead, F.array(block, block + 1)).otherwise(F.array(block))))
    w = Window.partitionBy("book", "edition", "_block").orderBy("_n").rowsBetween(-size, -1)
    return n.withColumn("context", F.collect_list("_value").over(w)).filter(F.col("_block") == block).drop("_n", "_block", "_value")


def rolling_pairs(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """Filled, admissible rows with the `size` pairs before them in their book and edition, oldest first, each with its
    number of words. The context flows across chapters in translation order, as in one run over the book."""
    kept = chapter_rank(rows.filter(is_filled(F.col("target")))).filter(admissible(F.col("source"), F.col("target")))
    kept = kept.withColumn("words", pair_words(F.col("source"), F.col("target")))
    return rolling(kept, F.struct(*PAIR), size).drop("words")


def within_budget(context: Column, limit: int = WORD_LIMIT) -> Column:
    """The newest pairs whose words fit the limit, stopping at the first that does not, oldest first."""
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast(f"array<{PAIR_TYPE}>").alias("kept"))

    def merge(acc: Column, pair: Column) -> Column:
        full = acc["full"] | (acc["used"] + pair["words"] > limit)
        return F.struct(F.when(full, acc["used"]).otherwise(acc["used"] + pair["words"]).alias("used"), full.alias("full"), F.when(full, acc["kept"]).otherwise(F.concat(F.array(pair), acc["kept"])).alias("kept"))

    return F.aggregate(F.reverse(context), start, merge, lambda a: a["kept"])


def context_of(rows: DataFrame, wanted: DataFrame, size: int = SIZE) -> DataFrame:
    """The context of wanted rows (ids of rows) from the pairs before them: id, context. Texts travel by an equi-join on
    their running number, and only those that are needed."""
    rows = rows.select("id", "book", "edition", "chapter", "paragraph", "source", "target")
    ok = is_filled(F.col("target")) & admissible(F.col("source"), F.col("target"))
    ranked = chapter_rank(rows.withColumn("_ok", F.coalesce(ok, F.lit(False)).cast("int")))
    keys = stage(numbered(ranked.select("id", "book", "edition", "chapter_rank", "paragraph", "_ok"), F.col("_ok")), "places")
    need = keys.join(wanted.select("id"), "id", "left_semi").filter("_n > 0").select(F.col("id").alias("_for"), "book", "edition", F.explode(F.sequence(F.greatest(F.col("_n") - (size - 1), F.lit(1)), F.col("_n"))).alias("_i"))
    places = stage(need.join(keys.filter("_ok = 1").select("id", "book", "edition", (F.col("_n") + 1).alias("_i")), ["book", "edition", "_i"]).select("_for", "_i", "id"), "context")
    texts = rows.filter(ok).select("id", "source", "target").join(small_side(places.select("id").distinct()), "id", "left_semi")
    pairs = places.join(texts, "id").withColumn("words", pair_words(F.col("source"), F.col("target")))
    g = pairs.groupBy("_for").agg(F.array_sort(F.collect_list(F.struct("_i", *PAIR))).alias("x"))
    return g.select(F.col("_for").alias("id"), F.transform("x", lambda s: F.struct(*[s[f].alias(f) for f in PAIR])).alias("context"))


def message(role: str, tag: Column, text: Column) -> Column:
    t = F.lower(tag)
    return F.struct(F.lit(role).alias("role"), F.concat(F.lit("<"), t, F.lit(">"), text, F.lit("</"), t, F.lit(">")).alias("content"))


def chat_messages(system: Column, context: Column, source_lang: Column, target_lang: Column, text: Column, example: Column | None = None) -> Column:
    """System prompt, at most one similar example, the context and the text itself, as messages."""
    def pair(c: Column) -> Column:
        return F.array(message("user", source_lang, c["source"]), message("assistant", target_lang, c["target"]))

    parts = [F.array(F.struct(F.lit("system").alias("role"), system.alias("content")))]
    if example is not None:
        parts.append(F.when(example.isNotNull(), pair(example)).otherwise(F.array().cast("array<struct<role:string,content:string>>")))
    return F.concat(*parts, F.flatten(F.transform(context, pair)), F.array(message("user", source_lang, text)))


def prefill(rows: DataFrame, chapter: Column | None = None, n: int = PREFILL, seed: int | None = None) -> DataFrame:
    """Up to n examples for each book and pair: the newest of the wanted chapter, then others, then untranslated texts.
    Random choices are by a seeded hash of the id, so that they repeat."""
    mid = (F.length("source") > 50) & (F.length("source") < 200)
    done = is_filled(F.col("target")) & mid & (F.col("source") != F.col("target"))
    pending = ~is_filled(F.col("target")) & mid & F.col("source").rlike("^[A-Za-z]")
    here = F.lit(False) if chapter is None else F.col("chapter") == chapter
    order = F.xxhash64(F.lit(seed), F.col("id")) if seed is not None else -F.col("id")
    kind = F.when(done & here, 1).when(done, 2).when(pending, 3)
    k = rows.withColumn("priority", kind).filter("priority is not null").withColumn("_o", F.when(F.col("priority") == 1, -F.col("id")).otherwise(order))
    return top_n(k, ["book", "source_lang", "target_lang"], ["priority", "_o", "id"], n).drop("_o")


def top_n(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group; ranked within partitions first (WindowGroupLimit), so a hot group stays small."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def keeps_context(sizes: Column, sources: Column) -> Column:
    """Whether a context survives the end of a chapter: fewer than ten paragraphs, and all its sources over 50 characters."""
    return (sizes < 10) & F.forall(sources, lambda s: F.length(s) > 50)


def payload(messages: Column, model: Column | str, temperature: float = 0.5, max_tokens: int = 4096) -> Column:
    """Body of a chat request as JSON; what stands before @ in a model's name asks for one provider."""
    m = F.lit(model) if isinstance(model, str) else model
    at = F.instr(m, "@") > 0
    order = F.when(at, F.struct(F.array(F.regexp_extract(m, r"^(.*)@", 1)).alias("order")))
    return F.to_json(F.struct(F.regexp_replace(m, r"^.*@", "").alias("model"), messages.alias("messages"), F.lit(temperature).alias("temperature"), F.lit(max_tokens).alias("max_tokens"), order.alias("provider")))


def reply(body: Column) -> Column:
    """Content of the first choice of a reply in JSON; null where there is none."""
    return F.get_json_object(body, "$.choices[0].message.content")
