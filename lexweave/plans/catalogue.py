"""All queries of the core and the same queries in SQL for DuckDB.

Every query runs over its whole tables. Where SQL can't express a query (Html, EPUB, model calls) or is too slow on whole
tables, it has none here and is tested against fixtures or brute force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quality, text
from ..functions.html import html_markdown
from ..operators import context, similarity, store
from ..operators.model import StubClient
from ..session import read_table, stage_dir
from ..sources import readers
from . import pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: DuckDB's spelling of Python's white space.
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def tm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "translations")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


# SQL helpers
def q_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def q_strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def q_jaccard(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b}))::DOUBLE / nullif(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0)::DOUBLE, 0.0)"


def q_count(x: str, part: str) -> str:
    return f"((length({x}) - length(replace({x}, '{part}', ''))) // {len(part)})"


def q_bounded(x: str) -> str:
    return f"greatest(0, least(100, trunc({x})::INT))"


Q_KEY = "book, source_lang, target_lang, edition, chapter, paragraph"
Q_CHAPTER = "book, source_lang, target_lang, edition, chapter"
Q_NOW = f"now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {Q_KEY} ORDER BY id DESC) AS rn FROM translations) WHERE rn = 1)"
Q_READ = f"""{Q_NOW},
readout AS (
  SELECT b.*, o.target AS proof, coalesce(o.target, b.target) AS text
  FROM (SELECT * FROM now WHERE coalesce(source_lang <> '@', true)) b
  LEFT JOIN (SELECT * FROM now WHERE source_lang = '@') o
    ON b.book = o.book AND b.edition = o.edition AND b.chapter = o.chapter AND b.paragraph = o.paragraph AND b.target_lang = o.target_lang)"""


def q_fluency(x: str) -> str:
    """A list of three numbers first, so that each is worked out once."""
    sizes = f"list_transform(list_filter(list_transform(string_split({x}, '.'), lambda p: {q_strip('p')}), lambda p: p <> ''), lambda p: len({q_words('p')}))"
    top = f"(list_max(map_values(list_histogram({q_words(f'lower({x})')}))))::DOUBLE / len({q_words(f'lower({x})')})::DOUBLE"
    n, s, q = f"len({sizes})", f"list_sum({sizes})", f"list_sum(list_transform({sizes}, lambda v: v * v))"
    return f"CASE WHEN {n} = 0 THEN 100 ELSE {q_bounded(f'(1.0::DOUBLE - (({n} * {q} - {s} * {s})::DOUBLE / ({n}::DOUBLE * {n}::DOUBLE)) / 1000 - {top}) * 100')} END"


def q_adequacy(o: str, t: str) -> str:
    o, t = f"lower({q_strip(o)})", f"lower({q_strip(t)})"
    wo, wt = q_words(o), q_words(t)
    ratio = lambda a, b: f"(least({a}, {b})::DOUBLE / nullif(greatest({a}, {b}), 0)::DOUBLE)"
    score = f"{ratio(f'len({wo})', f'len({wt})')} * 30 + {q_jaccard(f'list_distinct({wo})', f'list_distinct({wt})')} * 50 + {ratio(f'length({o})', f'length({t})')} * 20"
    return f"CASE WHEN {o} = '' OR {t} = '' THEN 0 ELSE {q_bounded(score)} END"


# --- the memory -------------------------------------------------------------------------------------------------------
@query(f"WITH {Q_NOW} SELECT id, {Q_KEY}, source, target FROM now")
def tm_current(spark, d):
    return store.current(tm(spark, d)).select("id", *store.KEY, "source", "target")


@query("""SELECT source_lang, target_lang, source, id, target, coalesce(fluency, -1) AS fluency FROM (
  SELECT *, row_number() OVER (PARTITION BY source_lang, target_lang, source ORDER BY coalesce(fluency, -1) DESC, id) AS rn
  FROM translations WHERE target <> '') WHERE rn = 1""")
def tm_best_translation(spark, d):
    return store.best_translation(tm(spark, d))


@query(f"WITH {Q_READ} SELECT id, {Q_KEY}, text FROM readout")
def tm_overlay_read(spark, d):
    return store.overlay_read(tm(spark, d)).select("id", *store.KEY, "text")


@query(f"""WITH g AS (SELECT {Q_CHAPTER}, count(*) AS paragraphs FROM translations WHERE chapter > 0 GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY book, source_lang, target_lang, edition ORDER BY paragraphs DESC, chapter)::INT AS rank_by_length FROM g""")
def tm_chapter_list(spark, d):
    return store.chapter_list(tm(spark, d))


@query(f"""WITH g AS (SELECT {Q_CHAPTER}, count(*) AS total, count_if(target IS NULL OR target = '') AS untranslated,
  count(*) FILTER (WHERE duration > 0) AS timed, sum(CASE WHEN duration > 0 THEN duration ELSE 0 END)::BIGINT AS elapsed FROM translations GROUP BY ALL)
SELECT * REPLACE (untranslated::BIGINT AS untranslated, timed::BIGINT AS timed), CASE WHEN timed > 0 THEN elapsed::DOUBLE / timed::DOUBLE ELSE 0.0 END AS average,
  CASE WHEN timed > 0 THEN elapsed::DOUBLE / timed::DOUBLE ELSE 0.0 END * (total - timed) AS remaining FROM g""")
def tm_chapter_stats(spark, d):
    return store.chapter_stats(tm(spark, d))


@query("SELECT book, source_lang, target_lang, coalesce(max(edition), 0) AS edition FROM translations GROUP BY ALL")
def tm_latest_edition(spark, d):
    return store.latest_edition(tm(spark, d))


@query(f"SELECT {Q_CHAPTER}, count(*) AS untranslated FROM translations WHERE target IS NULL OR target = '' GROUP BY ALL")
def tm_untranslated(spark, d):
    return tm(spark, d).filter(~store.is_filled(F.col("target"))).groupBy("book", "source_lang", "target_lang", "edition", "chapter").agg(F.count("*").alias("untranslated"))


@query(f"SELECT {Q_CHAPTER}, count(*) AS total FROM translations GROUP BY ALL HAVING count_if(target IS NULL OR target = '') = 0")
def tm_complete_chapters(spark, d):
    return store.complete_chapters(tm(spark, d))


@query(f"""WITH {Q_READ} SELECT id, {Q_KEY}, coalesce(lead(paragraph) OVER w, -1) AS next_paragraph, lead(text) OVER w AS next_text FROM readout
WINDOW w AS (PARTITION BY {Q_CHAPTER} ORDER BY paragraph NULLS FIRST, id)""")
def tm_next_paragraph(spark, d):
    return store.next_paragraph(tm(spark, d)).withColumn("next_paragraph", F.coalesce("next_paragraph", F.lit(-1)))


@query("""SELECT book, target_lang, id, source, target, fluency FROM (
  SELECT book, target_lang, id, source, target, coalesce(fluency, -1) AS fluency,
         row_number() OVER (PARTITION BY book, target_lang ORDER BY coalesce(fluency, -1) DESC, id) AS rn
  FROM translations WHERE target <> '' AND contains(lower(source), 'silver') AND contains(lower(source), 'lantern')) WHERE rn = 1""")
def tm_search(spark, d):
    return store.top_hit(store.search(tm(spark, d), "silver lantern"), ["book", "target_lang"])


Q_OLDNEW = "old AS (SELECT * FROM translations WHERE edition = 1), fresh AS (SELECT * FROM translations)"
Q_SAME = " AND ".join(f"o.{k} IS NOT DISTINCT FROM n.{k}" for k in store.KEY)
Q_LAST = f"last AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY {Q_KEY} ORDER BY id DESC) AS rn FROM fresh) WHERE rn = 1)"


def _old_new(spark, d):
    t = tm(spark, d)
    return t.filter("edition = 1"), t


@query(f"""WITH {Q_OLDNEW}, first AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY {Q_KEY} ORDER BY id) AS rn FROM fresh) WHERE rn = 1)
SELECT id, {Q_KEY}, target FROM old UNION ALL SELECT id, {Q_KEY}, target FROM first n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE {Q_SAME})""")
def tm_insert_ignore(spark, d):
    return store.insert_ignore(*_old_new(spark, d)).select("id", *store.KEY, "target")


@query(f"""WITH {Q_OLDNEW}, {Q_LAST} SELECT id, {Q_KEY}, target FROM old o WHERE NOT EXISTS (SELECT 1 FROM last n WHERE {Q_SAME})
UNION ALL SELECT id, {Q_KEY}, target FROM last""")
def tm_upsert(spark, d):
    return store.upsert(*_old_new(spark, d)).select("id", *store.KEY, "target")


@query(f"""WITH {Q_OLDNEW}, {Q_LAST} SELECT id, {Q_KEY}, target FROM old o
WHERE NOT EXISTS (SELECT 1 FROM last n WHERE {Q_SAME}) AND NOT EXISTS (SELECT 1 FROM last n WHERE n.id = o.id) UNION ALL SELECT id, {Q_KEY}, target FROM last""")
def tm_import_replace(spark, d):
    return store.import_replace(*_old_new(spark, d)).select("id", *store.KEY, "target")


@query(f"SELECT id, {Q_KEY} FROM translations WHERE target <> ''")
def tm_cleanup_empty(spark, d):
    return store.cleanup_empty(tm(spark, d)).select("id", *store.KEY)


@query("SELECT id, CASE WHEN target <> '' THEN target ELSE source END AS text FROM translations")
def tm_item_fallback(spark, d):
    return store.item(tm(spark, d)).select("id", "text")


@query(f"SELECT {Q_CHAPTER}, count(*) AS paragraphs FROM translations WHERE chapter > 0 AND chapter IN (1, 3, 4, 5, 8, 9, 10) GROUP BY ALL")
def chapter_selector(spark, d):
    return store.select_chapters(store.chapter_list(tm(spark, d)), "1,3-5,8-10").drop("rank_by_length")


@query("""WITH best AS (SELECT source_lang, target_lang, source, target, coalesce(fluency, -1) AS f FROM (
  SELECT *, row_number() OVER (PARTITION BY source_lang, target_lang, source ORDER BY coalesce(fluency, -1) DESC, id) AS rn FROM translations WHERE target <> '') WHERE rn = 1),
p AS (SELECT c.book, c.chapter, (u.i - 1)::INT AS paragraph, u.source, b.source_lang, b.target_lang
  FROM chapters c JOIN books b USING (book), LATERAL (SELECT unnest(c.paragraphs) AS source, generate_subscripts(c.paragraphs, 1) AS i) u)
SELECT p.*, CASE WHEN NOT regexp_matches(p.source, '[a-zA-Z]') THEN p.source ELSE coalesce(t.target, '') END AS target,
  CASE WHEN NOT regexp_matches(p.source, '[a-zA-Z]') THEN 100 ELSE coalesce(t.f, -1) END AS fluency,
  CASE WHEN NOT regexp_matches(p.source, '[a-zA-Z]') THEN 'copy' WHEN t.target IS NOT NULL THEN 'cache' ELSE '' END AS model
FROM p LEFT JOIN best t ON p.source_lang = t.source_lang AND p.target_lang = t.target_lang AND p.source = t.source
WHERE len(""" + q_words("p.source") + ") > 0")
def tm_extract_candidates(spark, d):
    books = read_table(spark, d, "books").select("book", "source_lang", "target_lang")
    p = readers.explode_paragraphs(read_table(spark, d, "chapters").select("book", "chapter", "paragraphs")).join(books, "book")
    return store.candidates(p, tm(spark, d)).select("book", "chapter", F.col("paragraph").cast("int").alias("paragraph"), "source", "source_lang", "target_lang", "target", "fluency", "model")


# --- context ----------------------------------------------------------------------------------------------------------
Q_MID = "length(source) > 50 AND length(source) < 200"


@query(f"""WITH k AS (SELECT *, CASE WHEN target <> '' AND source <> target AND {Q_MID} AND chapter = 1 THEN 1 WHEN target <> '' AND source <> target AND {Q_MID} THEN 2
  WHEN (target IS NULL OR target = '') AND {Q_MID} AND regexp_matches(source, '^[A-Za-z]') THEN 3 END AS priority FROM translations),
r AS (SELECT book, source_lang, target_lang, id, priority, source, row_number() OVER (PARTITION BY book, source_lang, target_lang ORDER BY priority, id DESC)::INT AS rank FROM k WHERE priority IS NOT NULL)
SELECT * FROM r WHERE rank <= 3""")
def tm_prefill(spark, d):
    return context.prefill(tm(spark, d), F.lit(1)).select("book", "source_lang", "target_lang", "id", "priority", "source", "rank")


@query(f"""WITH r AS (SELECT book, source_lang, target_lang, id, source, row_number() OVER (PARTITION BY book, source_lang, target_lang ORDER BY id DESC)::INT AS rank
  FROM translations WHERE (target IS NULL OR target = '') AND {Q_MID} AND regexp_matches(source, '^[A-Za-z]')) SELECT * FROM r WHERE rank <= 3""")
def tm_prefill_untranslated(spark, d):
    rows = tm(spark, d).filter(~store.is_filled(F.col("target")) & (F.length("source") > 50) & (F.length("source") < 200) & F.col("source").rlike("^[A-Za-z]"))
    return context.top_n(rows.select("book", "source_lang", "target_lang", "id", "source").withColumn("_o", -F.col("id")), ["book", "source_lang", "target_lang"], ["_o"], 3).drop("_o")


Q_SET = lambda x: f"list_distinct({q_words(f'lower({x})')})"
Q_RANKED = f"""n AS (SELECT book, edition, chapter, count(*) AS n FROM translations WHERE target <> '' GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY book, edition ORDER BY (chapter <> 0)::INT, n DESC, chapter) AS chapter_rank FROM n),
kept AS (SELECT t.*, rk.chapter_rank, len({q_words('t.source')}) AS sw, len({q_words('t.target')}) AS tw FROM translations t JOIN rk USING (book, edition, chapter) WHERE target <> ''
  AND len({q_words('source')}) > 0 AND len({q_words('target')}) > 0 AND (len({q_words('source')}) <= 5 OR {q_jaccard(Q_SET('source'), Q_SET('target'))} <= 0.95))"""
Q_CTX = "OVER (PARTITION BY book, edition ORDER BY chapter_rank, paragraph, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"


@query(f"WITH {Q_RANKED} SELECT id, count(*) {Q_CTX} AS pairs, coalesce(string_agg(id::VARCHAR, ',') {Q_CTX}, '') AS pair_ids FROM kept")
def context_window_pairs(spark, d):
    r = context.rolling_pairs(tm(spark, d))
    return r.select("id", F.size("context").cast("long").alias("pairs"), F.array_join(F.transform("context", lambda c: c["id"].cast("string")), ",").alias("pair_ids"))


@query(f"""WITH {Q_RANKED}, x AS (SELECT id, coalesce(list(struct_pack(i := id, w := sw + tw)) {Q_CTX}, []) AS c FROM kept),
y AS (SELECT id, c, list_filter(range(1, len(c) + 1), lambda k: coalesce(list_sum(list_transform(c[k:], lambda p: p.w)), 0) <= 512) AS fit FROM x)
SELECT id, len(fit) AS kept, coalesce(list_sum(list_transform(c[len(c) - len(fit) + 1:], lambda p: p.w)), 0)::BIGINT AS words FROM y""")
def context_budget(spark, d):
    r = context.rolling_pairs(tm(spark, d)).withColumn("k", context.within_budget(F.col("context")))
    cost = F.aggregate("k", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return r.select("id", F.size("k").cast("long").alias("kept"), cost.alias("words"))


@query(f"""WITH {Q_RANKED}, x AS (SELECT id, source, target, sw, tw, coalesce(list(struct_pack(s := {Q_SET('source')}, t := {Q_SET('target')})) {Q_CTX}, []) AS c FROM kept)
SELECT id, (sw > 50 AND tw < sw * 0.3) OR coalesce(len(list_filter(c, lambda p: {q_jaccard(Q_SET('target'), 'p.t')} > 0.8 AND {q_jaccard(Q_SET('source'), 'p.s')} < 0.3)), 0) > 0 AS bleeding,
  trunc(coalesce(list_max(list_transform(c, lambda p: {q_jaccard(Q_SET('target'), 'p.t')})), 0.0) * 1000)::INT AS nearest FROM x""")
def tm_bleeding(spark, d):
    """Word sets are built once a row, before they are collected."""
    t = tm(spark, d).filter(store.is_filled(F.col("target")))
    kept = context.chapter_rank(t).filter(context.admissible(F.col("source"), F.col("target")))
    kept = kept.select("id", "book", "edition", "chapter_rank", "paragraph", text.word_set(F.col("source")).alias("s"), text.word_set(F.col("target")).alias("t"), quality.too_short(F.col("source"), F.col("target")).alias("short"))
    r = context.rolling(kept, F.struct("s", "t")).withColumnRenamed("context", "c")
    hit = F.exists("c", lambda p: (text.set_jaccard(F.col("t"), p["t"]) > 0.8) & (text.set_jaccard(F.col("s"), p["s"]) < 0.3))
    near = F.array_max(F.transform("c", lambda p: text.set_jaccard(F.col("t"), p["t"])))
    return r.select("id", (F.col("short") | hit).alias("bleeding"), (F.coalesce(near, F.lit(0.0)) * 1000).cast("int").alias("nearest"))


@query(f"""WITH {Q_RANKED}, x AS (SELECT id, source, lower(source_lang) AS a, lower(target_lang) AS b, coalesce(list(struct_pack(s := source, t := target)) {Q_CTX}, []) AS c FROM kept)
SELECT id, 'system: Translate' || chr(10) || list_aggregate(list_concat(list_transform(c, lambda p: 'user: <' || a || '>' || p.s || '</' || a || '>' || chr(10) || 'assistant: <' || b || '>' || p.t || '</' || b || '>'),
  ['user: <' || a || '>' || source || '</' || a || '>']), 'string_agg', chr(10)) AS chat FROM x WHERE a IS NOT NULL AND b IS NOT NULL""")
def chat_messages(spark, d):
    r = context.rolling_pairs(tm(spark, d)).filter("source_lang IS NOT NULL AND target_lang IS NOT NULL")
    m = context.chat_messages(F.lit("Translate"), F.col("context"), F.col("source_lang"), F.col("target_lang"), F.col("source"))
    return r.select("id", F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n").alias("chat"))


# --- quality ----------------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, {q_fluency('text')} AS fluency FROM documents WHERE text IS NOT NULL")
def doc_fluency(spark, d):
    return documents(spark, d).filter("text IS NOT NULL").select("doc_id", quality.fluency(F.col("text")).alias("fluency"))


@query(f"SELECT id, len({q_words('source')}) >= 1000 AS too_long FROM translations WHERE source IS NOT NULL")
def tm_too_long(spark, d):
    return tm(spark, d).filter("source IS NOT NULL").select("id", quality.too_long(F.col("source")).alias("too_long"))


@query(f"SELECT id, {q_adequacy('source', 'target')} AS adequacy FROM translations WHERE source IS NOT NULL AND target IS NOT NULL")
def tm_adequacy(spark, d):
    return tm(spark, d).filter("source IS NOT NULL AND target IS NOT NULL").select("id", quality.adequacy(F.col("source"), F.col("target")).alias("adequacy"))


@query(f"""SELECT id, (({' + '.join(f"({q_count('target', m)} % 2)" for m in quality.PAIRED_MARKS)}) + len(list_filter(
  list_transform(list_filter(regexp_extract_all(target, '<[^>]+>'), lambda t: NOT starts_with(t, '</')), lambda t: trim(t, '<>/')),
  lambda t: NOT list_contains(list_transform(list_filter(regexp_extract_all(target, '<[^>]+>'), lambda u: starts_with(u, '</')), lambda u: trim(u, '<>/')), t))))::INT AS issues
FROM translations WHERE target IS NOT NULL""")
def tm_errors_formatting(spark, d):
    return tm(spark, d).filter("target IS NOT NULL").select("id", quality.formatting_issues(F.col("target")).alias("issues"))


@query(f"""SELECT id, ((n > 10 AND m < n * 0.3)::INT + (n < 5 AND m > n * 5)::INT + ({' OR '.join(f"{q_count('low', w)} > m * 0.3" for w in quality.COMMON_WORDS)})::INT) AS points
FROM (SELECT id, len({q_words('source')}) AS n, len({q_words('target')}) AS m, lower(target) AS low FROM translations WHERE target IS NOT NULL AND source IS NOT NULL)""")
def tm_errors_mistranslation(spark, d):
    return tm(spark, d).filter("target IS NOT NULL AND source IS NOT NULL").select("id", quality.mistranslations(F.col("source"), F.col("target")).alias("points"))


@query(f"""SELECT id, len(list_filter(list_transform(list_filter({q_words('source')}, lambda w: length(w) > 3), lambda w: trim(lower(w), '.,!?;:"()[]{{}}')),
  lambda w: w <> '' AND list_contains(list_transform({q_words('lower(target)')}, lambda v: trim(v, '.,!?;:"()[]{{}}')), w)))::INT AS untranslated
FROM translations WHERE target IS NOT NULL AND source IS NOT NULL""")
def tm_untranslated_tokens(spark, d):
    return tm(spark, d).filter("target IS NOT NULL AND source IS NOT NULL").select("id", quality.untranslated_tokens(F.col("source"), F.col("target")).alias("untranslated"))


@query(f"""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda p: {q_strip('p')}), lambda p: p <> '')) AS s FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, list_sort({Q_SET('s')}) AS w, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w) AS i, len(w) AS z FROM w)
SELECT doc_id, (sum(n * (n - 1) // 2) + coalesce(any_value(c), 0))::BIGINT AS pairs FROM k LEFT JOIN (
  SELECT a.doc_id AS d, sum(a.n * b.n) AS c FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.i < b.i AND least(a.z, b.z) > 0.8 * greatest(a.z, b.z) AND {q_jaccard('a.w', 'b.w')} > 0.8 GROUP BY 1) ON d = doc_id GROUP BY doc_id""")
def doc_repeated_phrases(spark, d):
    return similarity.repeated_count(similarity.sentence_sets(documents(spark, d), "doc_id", "text"), "doc_id")


@query(f"""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda p: {q_strip('p')}), lambda p: p <> '')) AS s FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, list_sort({Q_SET('s')}) AS w, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w) AS i, len(w) AS z FROM w)
SELECT a.doc_id, count(*) AS links, sum(a.n * b.n)::BIGINT AS pairs FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.i < b.i AND least(a.z, b.z) > 0.8 * greatest(a.z, b.z) AND {q_jaccard('a.w', 'b.w')} > 0.8 GROUP BY 1""")
def doc_similarity_pairs(spark, d):
    """Different sentences of a document that are nearly alike: links between distinct ones, and pairs with their copies."""
    pairs = similarity.similar_pairs(similarity.sentence_sets(documents(spark, d), "doc_id", "text"), "doc_id")
    return pairs.groupBy("doc_id").agg(F.count("*").alias("links"), F.sum(F.col("n_a") * F.col("n_b")).cast("long").alias("pairs"))


@query("""SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM documents WHERE text IS NOT NULL) GROUP BY term""")
def doc_terms(spark, d):
    """Counted within documents first, so that a common term is combined before the shuffle."""
    t = documents(spark, d).filter("text IS NOT NULL").select("doc_id", F.explode(quality.content_terms(F.col("text"))).alias("term"))
    return t.groupBy("term", "doc_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))


@query(f"""WITH {Q_NOW}, g AS (SELECT {Q_CHAPTER}, count(*) AS paragraphs, string_agg(target, chr(10) || chr(10) ORDER BY paragraph NULLS FIRST, id) AS t,
  string_agg(coalesce(source, ''), chr(10) || chr(10) ORDER BY paragraph NULLS FIRST, id) AS s FROM now WHERE coalesce(source_lang <> '@', true) AND target <> '' GROUP BY ALL),
f AS (SELECT {Q_CHAPTER}, paragraphs, {q_fluency('t')} AS fluency, {q_adequacy('s', 't')} AS adequacy FROM g)
SELECT *, 100 AS consistency, trunc(fluency * 0.4::DOUBLE + adequacy * 0.4::DOUBLE + 100 * 0.2::DOUBLE)::INT AS overall FROM f""")
def quality_report(spark, d):
    return pipeline.quality_report(tm(spark, d))


Q_REPORT = f"""WITH {Q_NOW}, g AS (SELECT {Q_CHAPTER}, count(*) AS paragraphs, string_agg(target, chr(10) || chr(10) ORDER BY paragraph NULLS FIRST, id) AS t,
  string_agg(coalesce(source, ''), chr(10) || chr(10) ORDER BY paragraph NULLS FIRST, id) AS s FROM now WHERE coalesce(source_lang <> '@', true) AND target <> '' GROUP BY ALL),
f AS (SELECT {Q_CHAPTER}, {q_fluency('t')} AS fluency, {q_adequacy('s', 't')} AS adequacy FROM g)"""


@query(f"""{Q_REPORT}, n AS (SELECT *, row_number() OVER (PARTITION BY book, source_lang, target_lang, edition ORDER BY chapter) AS n FROM f),
a AS (SELECT book, source_lang, target_lang, edition, count(*) AS chapters, sum(fluency)::DOUBLE / count(*) AS fluency, sum(CASE WHEN n <= 5 THEN adequacy END)::DOUBLE / count(*) FILTER (WHERE n <= 5) AS adequacy FROM n GROUP BY ALL)
SELECT *, trunc(fluency * 0.4::DOUBLE + adequacy * 0.4::DOUBLE + 100 * 0.2::DOUBLE)::INT AS overall FROM a""")
def quality_report_book(spark, d):
    return pipeline.book_report(tm(spark, d))


@query(f"""WITH {Q_READ}, t AS (SELECT {Q_CHAPTER}, row_number() OVER () AS g, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY paragraph, id) FILTER (paragraph > 0), '') AS x FROM readout WHERE text <> '' GROUP BY {Q_CHAPTER}),
s AS (SELECT g, unnest(list_filter(list_transform(regexp_split_to_array(x, '[.!?]+'), lambda p: {q_strip('p')}), lambda p: p <> '')) AS s FROM t),
w AS (SELECT g, list_sort({Q_SET('s')}) AS w, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY w) AS i, len(w) AS z FROM w),
p AS (SELECT g, sum(n * (n - 1) // 2) AS c FROM k GROUP BY ALL UNION ALL SELECT a.g, sum(a.n * b.n) FROM k a JOIN k b ON a.g = b.g
  AND a.i < b.i AND least(a.z, b.z) > 0.8 * greatest(a.z, b.z) AND {q_jaccard('a.w', 'b.w')} > 0.8 GROUP BY ALL),
q AS (SELECT g, sum(c)::BIGINT AS repeated FROM p GROUP BY ALL),
e AS (SELECT *, len({q_words('x')}) AS m, lower(x) AS low,
  (({' + '.join(f"({q_count('x', m)} % 2)" for m in quality.PAIRED_MARKS)}) + len(list_filter(list_transform(list_filter(regexp_extract_all(x, '<[^>]+>'), lambda t: NOT starts_with(t, '</')), lambda t: trim(t, '<>/')),
  lambda t: NOT list_contains(list_transform(list_filter(regexp_extract_all(x, '<[^>]+>'), lambda u: starts_with(u, '</')), lambda u: trim(u, '<>/')), t))))::INT AS formatting, {q_fluency('x')} AS fluency FROM t),
r AS (SELECT {Q_CHAPTER}, formatting, ((m > 0)::INT + ({' OR '.join(f"{q_count('low', w)} > m * 0.3" for w in quality.COMMON_WORDS)})::INT) AS mistranslations, coalesce(repeated, 0) AS repeated, fluency
  FROM e LEFT JOIN q USING (g)) SELECT *, formatting + mistranslations + repeated AS total FROM r""")
def chapter_checks(spark, d):
    return pipeline.chapter_checks(tm(spark, d))


@query(f"""WITH l AS (SELECT book, source_lang, target_lang, coalesce(max(edition), 0) AS edition FROM translations GROUP BY ALL),
n AS (SELECT t.book, t.source_lang, t.target_lang, t.edition, chapter, count(*) AS paragraphs FROM translations t JOIN l ON t.book = l.book AND t.source_lang IS NOT DISTINCT FROM l.source_lang
  AND t.target_lang IS NOT DISTINCT FROM l.target_lang AND t.edition = l.edition GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY book, source_lang, target_lang ORDER BY chapter <> 0, paragraphs DESC, chapter)::INT AS rank FROM n WHERE chapter >= 0""")
def chapters_by_length(spark, d):
    return store.chapters_for(tm(spark, d), by_length=True)


@query()
def tm_untranslated_segments(spark, d):
    """By regular expression in Python, tested against brute force: DuckDB's word boundaries know ASCII only."""
    return tm(spark, d).filter("target IS NOT NULL AND source IS NOT NULL").select("id", quality.untranslated_segments(F.col("source"), F.col("target")).alias("untranslated"))


# --- text -------------------------------------------------------------------------------------------------------------
Q_TEXT = r'a-zA-Z\x{80}-\x{FFFF}"'


@query(rf"""WITH s AS (SELECT id, {q_strip("coalesce(target, '')")} AS t FROM translations), p AS (SELECT id, t, regexp_extract(t, '^[^{Q_TEXT}]+') AS prefix FROM s),
r AS (SELECT id, prefix, substr(t, length(prefix) + 1) AS rest FROM p), x AS (SELECT *, CASE WHEN prefix <> '' THEN regexp_extract(rest, '[^{Q_TEXT}]+$') ELSE '' END AS suffix FROM r)
SELECT id, substr(rest, 1, length(rest) - length(suffix)) AS clean, prefix, suffix FROM x""")
def strip_markdown(spark, d):
    return tm(spark, d).select("id", text.strip_markdown(F.col("target")).alias("x")).select("id", "x.*")


def q_inline(x: str) -> str:
    for pattern, to in text.INLINE_MARKS:
        x = f"regexp_replace({x}, '{pattern.removeprefix('(?d)')}', '{to.replace('$1', chr(92) + '1')}', 'g')"
    return x


@query(f"SELECT id, {q_inline('target')} AS html FROM translations WHERE target IS NOT NULL")
def inline_markdown(spark, d):
    return tm(spark, d).filter("target IS NOT NULL").select("id", text.inline_markdown(F.col("target")).alias("html"))


Q_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: {q_strip('l')}), lambda l: l <> '')"
Q_LEVEL = "length(regexp_extract(l, '^(#{1,6}) ', 1))"
Q_LINE = f"""CASE WHEN {Q_LEVEL} > 0 THEN '<h' || {Q_LEVEL} || '>' || {q_inline(f'substr(l, {Q_LEVEL} + 2)')} || '</h' || {Q_LEVEL} || '>' WHEN l = '---' THEN '<hr/>' WHEN l = '***' THEN '<br/>'
  WHEN starts_with(l, '- ') THEN '<li>' || {q_inline('substr(l, 3)')} || '</li>' WHEN starts_with(l, '> ') THEN '<blockquote>' || {q_inline('substr(l, 3)')} || '</blockquote>' ELSE '<p>' || {q_inline('l')} || '</p>' END"""


@query(f"""SELECT doc_id, {q_inline("regexp_replace(list_filter(ls, lambda l: regexp_matches(l, '^#{1,4} '))[1], '^#+ ', '')")} AS title,
  coalesce(list_aggregate(list_transform(ls, lambda l: {Q_LINE}), 'string_agg', chr(10)), '') AS html FROM (SELECT doc_id, {Q_LINES} AS ls FROM documents WHERE text IS NOT NULL)""")
def markdown_to_html(spark, d):
    return documents(spark, d).filter("text IS NOT NULL").select("doc_id", text.markdown_html(F.col("text")).alias("x")).select("doc_id", "x.*")


@query(r"""SELECT id, regexp_replace(regexp_replace(target, '(?is)<french\b[^>]*>.*?</french>', '', 'g'), '(?i)<french\b[^>]*/?>', '', 'g') AS text FROM translations WHERE target IS NOT NULL""")
def remove_xml_tags(spark, d):
    return tm(spark, d).filter("target IS NOT NULL").select("id", text.remove_xml_tags(F.col("target"), "french").alias("text"))


@query(f"SELECT id, coalesce({q_strip(chr(114) + 'egexp_extract(target, ' + chr(39) + '(?s)<French>(.*?)</French>' + chr(39) + ', 1)')}, '') AS text FROM translations")
def extract_tag(spark, d):
    return tm(spark, d).select("id", F.coalesce(text.tagged(F.col("target"), "French"), F.lit("")).alias("text"))


@query("SELECT DISTINCT target_lang, coalesce(nullif(lower(substr(target_lang, 1, 2)), ''), 'en') AS code FROM translations")
def language_code(spark, d):
    return tm(spark, d).select("target_lang").distinct().select("target_lang", text.language_code(F.col("target_lang")).alias("code"))


@query(f"""SELECT doc_id, (i - 1)::INT AS paragraph, p AS text FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda l: {q_strip('l')}), lambda l: l <> '') AS ps FROM documents WHERE text IS NOT NULL))""")
def doc_paragraphs(spark, d):
    return documents(spark, d).filter("text IS NOT NULL").select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("paragraph", "text"))


@query(f"""WITH b AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10) || chr(10)), lambda l: {q_strip('l')} <> '') AS ps FROM documents WHERE text IS NOT NULL)),
c AS (SELECT *, sum(starts_with(p, '#')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS chapter FROM b)
SELECT doc_id, chapter::INT AS chapter, count(*) AS blocks, max(CASE WHEN starts_with(p, '#') THEN {q_strip("regexp_replace(p, '^#{1,6}', '')")} END) AS title FROM c GROUP BY ALL""")
def doc_chapters(spark, d):
    docs = documents(spark, d).filter("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), "text")
    c = readers.markdown_chapters(docs)
    own = F.size("paragraphs") - F.when(F.col("chapter") == 0, 3).otherwise(1)
    return c.select(F.col("path").cast("long").alias("doc_id"), "chapter", own.cast("long").alias("blocks"), F.when(F.col("chapter") > 0, F.col("title")).alias("title")).filter("blocks > 0 OR chapter > 0")


@query(f"""WITH {Q_READ}, g AS (SELECT {Q_CHAPTER}, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY paragraph, id) FILTER (paragraph > 0) AS text FROM readout
  GROUP BY ALL HAVING count_if(target IS NULL OR target = '') = 0), l AS (SELECT {Q_CHAPTER}, {Q_LINES} AS ls FROM g)
SELECT {Q_CHAPTER}, coalesce(list_aggregate(list_transform(ls, lambda l: {Q_LINE}), 'string_agg', chr(10)), '') AS html FROM l""")
def build_xhtml(spark, d):
    return pipeline.built_chapters(tm(spark, d)).select(*readers.CHAPTER, "html")


@query()
def html_roundtrip(spark, d):
    """Documents to html and back to Markdown: no SQL; the rules are tested on fixtures."""
    h = documents(spark, d).filter("text IS NOT NULL").select("doc_id", text.markdown_html(F.col("text"))["html"].alias("html"))
    return h.select("doc_id", html_markdown(F.col("html")).alias("markdown"))


@query("SELECT id, edition, chapter, paragraph, source_lang, source, coalesce(target_lang, '') AS target_lang, coalesce(target, '') AS target, coalesce(duration, -1) AS duration, coalesce(fluency, 1) AS fluency, coalesce(model, '') AS model, coalesce(strftime(created, '%Y-%m-%d %H:%M:%S.%f'), '') AS created FROM translations")
def csv_roundtrip(spark, d):
    """Export and import again; empty and null numbers come back as the defaults."""
    path = f"{stage_dir(spark)}/csv-{uuid.uuid4().hex}"
    t = tm(spark, d).withColumns({"target": F.coalesce("target", F.lit("")), "model": F.coalesce("model", F.lit(""))})
    readers.export_csv(t, path)
    return readers.import_csv(spark, path).select(*readers.CSV_COLUMNS).withColumn("created", F.coalesce(F.date_format("created", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("")))


# --- pipeline ---------------------------------------------------------------------------------------------------------
@query()
def translate_stub(spark, d):
    """All pending rows through the deterministic client."""
    return pipeline.translate(tm(spark, d), StubClient).select("id", "source", "target", "fluency", "model")


@query()
def proofread_stub(spark, d):
    return pipeline.proofread(tm(spark, d), lambda: StubClient("[p] ")).select("id", "source_lang", "source", "target", "fluency")


@query()
def epub_books(spark, d):
    """Every complete book as an EPUB, read again: chapters and paragraphs found in it."""
    from ..session import ship_package
    from ..sources.epub import read_epub

    ship_package(spark)

    pair = ["book", "source_lang", "target_lang", "edition"]

    def count(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(*(getattr(r, k) for k in pair), r.title, len(c), sum(len(x["paragraphs"]) for x in c)) for r in pdf.itertuples(index=False) for c in [read_epub(bytes(r.epub))]]
            yield pd.DataFrame(rows, columns=[*pair, "title", "chapters", "paragraphs"])

    return pipeline.build_books(tm(spark, d)).mapInPandas(count, "book long, source_lang string, target_lang string, edition int, title string, chapters int, paragraphs int")


@query()
def translate_in_order(spark, d):
    """All pending rows, each with the replies to those before it in its book as context."""
    return pipeline.translate(tm(spark, d), StubClient, in_order=True).select("id", "source", "target", "fluency", "model")
