"""The translation memory as set-based operators on DataFrames.

A row is identified by book, language pair, edition, chapter and paragraph. Files have no unique constraint, so
`current` keeps the last row to arrive of each key; every operator says whether it needs that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words
from ..session import small_side, stage

KEY = ["book", "source_lang", "target_lang", "edition", "chapter", "paragraph"]
PLACE = ["book", "edition", "chapter", "paragraph"]
OVERLAY = "@"

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("book", T.LongType()), T.StructField("edition", T.IntegerType()),
    T.StructField("chapter", T.IntegerType()), T.StructField("paragraph", T.IntegerType()), T.StructField("source_lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("target_lang", T.StringType()), T.StructField("target", T.StringType()),
    T.StructField("duration", T.IntegerType()), T.StructField("fluency", T.IntegerType()), T.StructField("model", T.StringType()),
    T.StructField("created", T.TimestampNTZType()),
])


def is_filled(target: Column) -> Column:
    return F.coalesce(target != "", F.lit(False))


def current(rows: DataFrame) -> DataFrame:
    """One row a key, the largest id; one aggregation, so a hot key is combined before the shuffle. Null key values
    make a group of their own."""
    rest = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(F.max(F.struct("id", *[c for c in rest if c != "id"])).alias("_x")).select(*KEY, "_x.*").select(*rows.columns)


def best_translation(rows: DataFrame, *more: str) -> DataFrame:
    """For each language pair and source text the filled row of highest fluency, then least id; more: further columns of it."""
    top = F.max(F.struct(F.coalesce("fluency", F.lit(-1)).alias("fluency"), (-F.col("id")).alias("n"), F.col("target"), *more))
    return rows.filter(is_filled(F.col("target"))).groupBy("source_lang", "target_lang", "source").agg(top.alias("x")).select("source_lang", "target_lang", "source", (-F.col("x.n")).alias("id"), "x.target", "x.fluency", *[f"x.{c}" for c in more])


def overlay_read(rows: DataFrame) -> DataFrame:
    """Rows with their proofread text where an overlay row has the same place and target language."""
    now = current(rows)
    over = now.filter(F.col("source_lang") == OVERLAY).select(*PLACE, "target_lang", F.col("target").alias("proof"))
    base = now.filter(F.coalesce(F.col("source_lang") != OVERLAY, F.lit(True)))
    return base.join(over, [*PLACE, "target_lang"], "left").withColumn("text", F.coalesce("proof", "target"))


def latest_edition(rows: DataFrame) -> DataFrame:
    return rows.groupBy("book", "source_lang", "target_lang").agg(F.coalesce(F.max("edition"), F.lit(0)).alias("edition"))


def chapter_list(rows: DataFrame) -> DataFrame:
    """Paragraphs of each chapter without metadata; rank_by_length: most paragraphs first, then chapter."""
    g = rows.filter("chapter > 0").groupBy("book", "source_lang", "target_lang", "edition", "chapter").agg(F.count("*").alias("paragraphs"))
    w = Window.partitionBy("book", "source_lang", "target_lang", "edition").orderBy(F.desc("paragraphs"), "chapter")
    return g.withColumn("rank_by_length", F.row_number().over(w))


def chapter_stats(rows: DataFrame) -> DataFrame:
    """Totals of each chapter: rows, untranslated rows, positive durations, and the time the rest will take."""
    timed = F.col("duration") > 0
    g = rows.groupBy("book", "source_lang", "target_lang", "edition", "chapter").agg(
        F.count("*").alias("total"), F.count_if(~is_filled(F.col("target"))).alias("untranslated"), F.count_if(timed).alias("timed"),
        F.sum(F.when(timed, F.col("duration")).cast("long")).alias("elapsed"),
    )
    average = F.try_divide(F.col("elapsed").cast("double"), F.col("timed").cast("double"))
    return g.withColumn("average", F.coalesce(average, F.lit(0.0))).withColumn("elapsed", F.coalesce("elapsed", F.lit(0).cast("long"))).withColumn("remaining", F.col("average") * (F.col("total") - F.col("timed")))


def complete_chapters(rows: DataFrame) -> DataFrame:
    return chapter_stats(rows).filter("untranslated = 0").select("book", "source_lang", "target_lang", "edition", "chapter", "total")


def next_paragraph(rows: DataFrame) -> DataFrame:
    """For each row the next paragraph of its chapter with its text."""
    w = Window.partitionBy("book", "source_lang", "target_lang", "edition", "chapter").orderBy("paragraph", "id")
    return overlay_read(rows).select("id", *KEY, F.lead("paragraph").over(w).alias("next_paragraph"), F.lead("text").over(w).alias("next_text"))


def search(rows: DataFrame, phrase: str, source_lang: str | None = None, target_lang: str | None = None, most_words: int = 10, wildcards: bool = False) -> DataFrame:
    """Filled rows whose source has every word of the phrase, case ignored; none for no words or too many.
    wildcards: % and _ in words match as in LIKE. An operator of the caller's choice ranks the hits (see `top_hit`)."""
    terms = phrase.split()
    hits = rows.filter(is_filled(F.col("target")))
    if not 0 < len(terms) <= most_words:
        return hits.limit(0)
    for t in terms:
        hits = hits.filter(F.ilike("source", F.lit(f"%{t}%"), F.lit("\x01")) if wildcards else F.contains(F.lower("source"), F.lit(t.lower())))
    if source_lang:
        hits = hits.filter(F.col("source_lang") == source_lang)
    return hits.filter(F.col("target_lang") == target_lang) if target_lang else hits


def top_hit(hits: DataFrame, by: list[str]) -> DataFrame:
    """The hit of highest fluency, then least id, of each group."""
    return hits.groupBy(*by).agg(F.max(F.struct(F.coalesce("fluency", F.lit(-1)).alias("fluency"), (-F.col("id")).alias("n"), "source", "target")).alias("x")).select(*by, (-F.col("x.n")).alias("id"), "x.source", "x.target", "x.fluency")


def best_hits(rows: DataFrame, phrases: DataFrame, most_words: int = 10) -> DataFrame:
    """The top hit of `search` for each distinct phrase and language pair (phrase, source_lang, target_lang), as example.
    Words are looked up in the vocabulary by their first three characters; the rarest word of a phrase finds the rows, and
    all of its words are checked there."""
    pair = ["source_lang", "target_lang"]
    terms = F.array_distinct(words(F.lower("phrase")))
    q = stage(phrases.select("phrase", *pair).distinct().filter(F.size(words(F.col("phrase"))).between(1, most_words)).withColumn("terms", terms), "phrases")
    hits = rows.filter(is_filled(F.col("target"))).select("id", *pair, "source", "target", "fluency")
    token = F.explode(F.array_distinct(words(F.lower("source")))).alias("token")
    v = hits.select(*pair, token).groupBy(*pair, "token").agg(F.count("*").alias("n"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda k: F.substring(F.col("token"), i, k))))
    g = v.select(*pair, "token", "n", F.explode(F.array_distinct(grams)).alias("gram"))
    t = q.select(*pair, F.explode("terms").alias("term")).distinct().withColumn("gram", F.substring("term", 1, 3))
    found = stage(t.join(g, [*pair, "gram"]).filter(F.contains("token", "term")).select(*pair, "term", "token", "n"), "found")
    often = found.groupBy(*pair, "term").agg(F.sum("n").alias("n"))
    rare = q.select("phrase", *pair, F.explode("terms").alias("term")).join(often, [*pair, "term"], "left").groupBy("phrase", *pair).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("x"))
    need = rare.filter("x.n > 0").select("phrase", *pair, "x.term").join(found, [*pair, "term"]).join(q, ["phrase", *pair]).select(*pair, "token", "phrase", "terms")
    every = lambda rows: rows.filter(F.forall("terms", lambda w: F.contains("_s", w)))
    low = hits.withColumn("_s", F.lower("source"))
    near = every(low.select("id", *pair, "fluency", "_s", token).join(small_side(stage(need, "need")), [*pair, "token"]))
    top = near.groupBy("phrase", *pair).agg(F.max(F.struct(F.coalesce("fluency", F.lit(-1)).alias("fluency"), (-F.col("id")).alias("n")))["n"].alias("n"))
    ids = stage(top.join(q, ["phrase", *pair]).select("phrase", *pair, "terms", (-F.col("n")).alias("id")), "ids")
    texts = every(low.join(small_side(ids), ["id", *pair]))
    return top_hit(texts, ["phrase", *pair]).select("phrase", *pair, F.struct("source", "target").alias("example"))


def _anti(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left rows without a partner; null key values match each other."""
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, "left_anti")


def insert_ignore(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows, and of the new ones the first (least id) of each key that the old lack."""
    first = new.groupBy(*KEY).agg(F.min(F.struct("id", *[c for c in new.columns if c not in KEY and c != "id"])).alias("_x")).select(*KEY, "_x.*").select(*new.columns)
    return old.unionByName(_anti(first, old, KEY))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows (the last of each key) replace old rows of their key."""
    return _anti(old, new, KEY).unionByName(current(new))


def import_replace(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows (the last of each key) replace old rows with their id or their key."""
    rows = current(new)
    return _anti(_anti(old, rows, ["id"]), rows, KEY).unionByName(rows)


def cleanup_empty(rows: DataFrame) -> DataFrame:
    """Rows with a target; empty ones of every edition go."""
    return rows.filter(is_filled(F.col("target")))


def item(rows: DataFrame) -> DataFrame:
    """Every row's text: its target, or its source where there is none."""
    return rows.withColumn("text", F.when(is_filled(F.col("target")), F.col("target")).otherwise(F.col("source")))


def parse_selector(spec: str) -> list[int]:
    """Sorted distinct numbers of a list such as 1,3-5; a reversed range is empty, anything else raises ValueError."""
    out: set[int] = set()
    for part in spec.split(","):
        part = part.strip()
        if not part:
            continue
        a, dash, b = part.partition("-")
        out.update(range(int(a), int(b) + 1) if dash else [int(part)])
    return sorted(out)


def select_chapters(chapters: DataFrame, spec: str | None) -> DataFrame:
    """Chapters that a selector names, in their order; all of them where it is empty."""
    if not spec or not spec.strip():
        return chapters
    return chapters.filter(F.col("chapter").isin(parse_selector(spec)))


def chapters_for(rows: DataFrame, spec: str | None = None, by_length: bool = False, with_metadata: bool = True) -> DataFrame:
    """Chapters of each book and pair's latest edition in the order in which they are worked off (`rank`): metadata first
    if wanted, then as selected in ascending order, else by length or number."""
    last = rows.groupBy("book", "source_lang", "target_lang").agg(F.coalesce(F.max("edition"), F.lit(0)).alias("edition"))
    group = ["book", "source_lang", "target_lang"]
    cond = None
    for k in [*group, "edition"]:
        c = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        cond = c if cond is None else cond & c
    n = rows.alias("r").join(last.alias("l"), cond, "left_semi").groupBy(*group, "edition", "chapter").agg(F.count("*").alias("paragraphs"))
    chosen = select_chapters(n.filter("chapter > 0"), spec)
    chosen = chosen.unionByName(n.filter("chapter = 0")) if with_metadata else chosen
    order = [F.col("chapter") != 0, *([F.desc("paragraphs")] if by_length and not (spec or "").strip() else []), "chapter"]
    return chosen.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def candidates(paragraphs: DataFrame, memory: DataFrame) -> DataFrame:
    """Rows to insert for paragraphs (book, chapter, paragraph, source, languages): copies, cached translations, or
    empty targets. Blank paragraphs are skipped. The cache ignores edition and place; texts without letters are copied,
    others of the same language go through the cache too."""
    p = paragraphs.filter(F.size(words(F.col("source"))) > 0)
    cache = best_translation(memory).select("source_lang", "target_lang", "source", F.col("target").alias("cached"), F.col("fluency").alias("cached_fluency"))
    letters = F.col("source").rlike("[a-zA-Z]")
    j = p.join(cache, ["source_lang", "target_lang", "source"], "left")
    hit = letters & F.col("cached").isNotNull()
    return j.select(
        *[c for c in p.columns], F.when(~letters, F.col("source")).when(hit, F.col("cached")).otherwise("").alias("target"),
        F.when(~letters, 0).otherwise(-1).alias("duration"), F.when(~letters, 100).when(hit, F.col("cached_fluency")).otherwise(-1).alias("fluency"),
        F.when(~letters, "copy").when(hit, "cache").otherwise("").alias("model"),
    )
