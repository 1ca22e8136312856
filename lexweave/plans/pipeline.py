"""The four phases of a book: extract, translate, proofread, build. Each is one set-based plan over any number of books."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quality import adequacy, fluency, formatting_issues, mistranslations
from ..functions.text import after_colon, language_code, markdown_html, safe_filename, strip_markdown
from ..operators import context as ctx
from ..operators import similarity, store
from ..operators.model import LOW_ADEQUACY, better_of, changed, model_text, model_text_in_order, translatable
from ..session import small_side, stage
from ..sources.epub import write_epub
from ..sources.readers import CHAPTER, chapter_texts, explode_paragraphs, stem

SYSTEM = "Translate {source_lang} text to {target_lang}. Keep its Markdown. Answer inside <{target_lang}> tags in lower case."
SYSTEM_PROOF = "Correct this {target_lang} text. Keep its Markdown. Answer inside <{target_lang}> tags in lower case."


def no_context() -> Column:
    return F.array().cast(f"array<{ctx.PAIR_TYPE}>")


def extract(chapters: DataFrame, memory: DataFrame, book: Column, source_lang: str, target_lang: str, new_edition: bool = False) -> DataFrame:
    """The memory with the paragraphs of chapters added: into the latest edition, or a new one if asked or there is none;
    empty targets of the pair go first; texts without letters are copied and known ones taken from the memory."""
    pair = (F.col("source_lang") == source_lang) & (F.col("target_lang") == target_lang)
    kept = memory.filter(~F.coalesce(pair, F.lit(False)) | store.is_filled(F.col("target")))
    p = explode_paragraphs(chapters).select(book.alias("book"), "chapter", "paragraph", "source", F.lit(source_lang).alias("source_lang"), F.lit(target_lang).alias("target_lang"))
    last = store.latest_edition(memory.filter(pair)).select("book", F.col("edition").alias("last"))
    rows = store.candidates(p, kept.filter(pair)).join(last, "book", "left")
    edition = F.when(F.coalesce("last", F.lit(0)) == 0, F.lit(1)).otherwise(F.col("last") + (1 if new_edition else 0))
    rows = rows.withColumn("edition", edition.cast("int")).withColumn("created", F.localtimestamp())
    return store.insert_ignore(kept, stage(with_ids(rows, kept).select(*kept.columns), "candidates"))  # ids must not change


def with_ids(rows: DataFrame, memory: DataFrame) -> DataFrame:
    """Fresh ids after the memory's largest: numbered within partitions, spread by partition, so unique without a sort."""
    top = memory.agg(F.max("id")).first()[0] or 0
    return rows.withColumn("id", F.lit(top + 1).cast("long") + F.monotonically_increasing_id())


def of_pair(rows: DataFrame, source_lang: str, target_lang: str, edition: int | None = None) -> DataFrame:
    """Rows of one language pair, with the overlays of its target language; of one edition if it is given."""
    own = rows.filter(((F.col("source_lang") == source_lang) | (F.col("source_lang") == store.OVERLAY)) & (F.col("target_lang") == target_lang))
    return own if edition is None else own.filter(F.col("edition") == edition)


def originals(rows: DataFrame) -> DataFrame:
    """The current rows without overlays."""
    own = rows.select(*store.SCHEMA.fieldNames())  # other columns may have the names of ours
    return store.current(own).filter(F.coalesce(F.col("source_lang") != store.OVERLAY, F.lit(True)))


def pending(rows: DataFrame) -> DataFrame:
    """Rows still to translate, with the context that stored rows give: the five pairs before them in their book, as many
    of the newest as fit the word limit."""
    return with_context(originals(rows)).withColumn("context", ctx.within_budget(F.col("context")))


def with_context(now: DataFrame, chapters: list[int] | None = None) -> DataFrame:
    """As pending, of current rows and without the word limit; only of some chapters if they are given."""
    todo = translatable(now.filter(~store.is_filled(F.col("target"))))
    todo = todo if chapters is None else todo.filter(F.col("chapter").isin(chapters))
    c = ctx.context_of(now, todo)
    return todo.join(c, "id", "left").withColumn("context", F.coalesce("context", no_context()))


def known(todo: DataFrame, memory: DataFrame) -> DataFrame:
    """todo with the reply that needs no call and its model, null where there is none: the text itself within one
    language, else its best translation in the memory as it lies (any book and edition, replaced rows too), else the text itself if it is only marks."""
    place = F.xxhash64("source_lang", "target_lang", "source").alias("_h")  # only rows that may match are grouped
    near = memory.withColumn("_h", place).join(small_side(todo.select(place).distinct()), "_h", "left_semi")
    best = store.best_translation(near, "model").select("source_lang", "target_lang", "source", F.struct(F.col("target").alias("reply"), "model").alias("_best"))
    copy = F.struct(F.col("source").alias("reply"), F.lit("copy").alias("model"))
    same = F.lower("source_lang") == F.lower("target_lang")
    reply = F.when(same, copy).when(F.col("_best").isNotNull(), F.col("_best")).when(strip_markdown(F.col("source"))["clean"] == "", copy)
    return todo.join(best, ["source_lang", "target_lang", "source"], "left").withColumn("known", reply).drop("_best")


def with_phrase(asked: DataFrame) -> DataFrame:
    return asked.withColumn("phrase", strip_markdown(F.col("source"))["clean"])


def with_example(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """asked with the best hit of a search for its words as example, null where there is none."""
    return with_phrase(asked).join(hits, ["phrase", "source_lang", "target_lang"], "left").drop("phrase")


def prefill_pairs(rows: DataFrame, todo: DataFrame, hits: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Up to three pairs for each book and language pair with rows to do (x: rank, place, id, source, target, words),
    stored ones of the chapter that is translated first, then of others, then untranslated texts that the model is asked
    for one after another, each with the pairs before it. Such replies are not stored."""
    by = ["book", "source_lang", "target_lang"]
    places = ctx.chapter_rank(rows.select("id", *by, "edition", "chapter")).join(todo.select("id"), "id", "left_semi")
    chapter = places.groupBy(*by).agg(F.min(F.struct("chapter_rank", "chapter"))["chapter"].alias("_first"))
    pre = ctx.prefill(rows.select("id", *by, "chapter", "source", "target").join(chapter, by), F.col("_first"))
    pre = stage(pre.withColumn("place", F.struct("priority", F.when(F.col("priority") == 1, -F.col("rank")).otherwise(F.col("rank")).alias("n"))).drop("chapter", "_first"), "prefill")
    cols = [*by, "rank", "place", "id", "source", "target"]
    pairs = pre.filter("priority < 3").select(*cols)
    fields = [F.col(c) for c in ("rank", "place", "id", "source", "target")] + [ctx.pair_words(F.col("source"), F.col("target")).alias("words")]
    group = lambda p: p.groupBy(*by).agg(F.collect_list(F.struct(*fields)).alias("x"))
    drafts = pre.filter((F.col("priority") == 3) & (F.lower("source_lang") != F.lower("target_lang"))).withColumn("source", strip_markdown(F.col("source"))["clean"]).filter("source <> ''").drop("target")
    if not drafts.isEmpty():
        drafts = stage(with_example(drafts, hits), "drafts")
        for n in range(1, ctx.PREFILL + 1):
            d = drafts.filter(F.col("rank") == n).join(group(pairs), by, "left").withColumn("context", ctx.within_budget(in_place(F.coalesce("x", F.array()))))
            replies = ask(d.drop("x")).withColumnRenamed("reply", "target").filter(store.is_filled(F.col("target")) & ctx.admissible(F.col("source"), F.col("target")))
            pairs = stage(pairs.unionByName(replies.select(*cols)), "pairs")
    return group(pairs)


def in_place(x: Column) -> Column:
    """Pairs of a prefill in the order in which they stand in a context."""
    return F.transform(F.array_sort(F.transform(x, lambda p: F.struct(p["place"].alias("place"), *[p[f].alias(f) for f in ctx.PAIR]))), lambda p: F.struct(*[p[f].alias(f) for f in ctx.PAIR]))


def prefilled(todo: DataFrame, pairs: DataFrame) -> DataFrame:
    """todo with contexts of under three pairs filled up to three from those of the book, and all kept to the word limit."""
    own = F.transform("context", lambda c: c["id"])
    more = F.slice(F.array_sort(F.filter("x", lambda p: ~F.array_contains(own, p["id"]))), F.lit(1), F.greatest(F.lit(ctx.PREFILL) - F.size("context"), F.lit(0)))
    full = F.concat(F.when(F.col("x").isNull(), no_context()).otherwise(in_place(more)), F.col("context"))
    return todo.join(pairs, ["book", "source_lang", "target_lang"], "left").withColumn("context", ctx.within_budget(full)).drop("x")


def translate(rows: DataFrame, client_factory: Callable[[], object], model: str = "stub", min_interval: float = 0.0, parallel: int | None = None, memory: DataFrame | None = None, in_order: bool = False, chapters: list[int] | None = None) -> DataFrame:
    """Translated rows for the pending ones, known texts from the memory (rows themselves by default) and all others by the
    model, equal ones with the reply to the first. Requests have a similar example of the memory, and contexts are filled up
    to three pairs; chapters restricts what is translated, not what is context. A reply that scores under LOW_ADEQUACY is asked for once more, without
    context, and the better of both is kept. Every reply is written down before it is used, so that it is paid for once however
    often the result is read. in_order: contexts hold this run's own replies too, book by book, so that a book is worked
    off in one task."""
    now = stage(originals(rows), "now")
    todo = stage(with_context(now, chapters).drop("duration", "fluency", "model", "created"), "pending")
    table = (rows if memory is None else memory).select(*store.SCHEMA.fieldNames())
    todo = stage(known(todo, table), "todo")
    ready = todo.filter("known IS NOT NULL").select("*", "known.reply", "known.model", F.lit(0).alias("duration"))
    misses = todo.filter("known IS NULL").drop("known").withColumn("_text", F.sha2(F.to_json(F.struct("source_lang", "target_lang", "source")), 256))
    ask = misses.join(misses.groupBy("_text").agg(F.min("id").alias("id")), ["_text", "id"], "left_semi")
    call = lambda asked: model_text(asked, client_factory, SYSTEM, "translate", model, min_interval, parallel)
    hits = stage(store.best_hits(table, with_phrase(todo if memory is None else todo.select("source", "source_lang", "target_lang").unionByName(memory.filter(~store.is_filled(F.col("target"))).select("source", "source_lang", "target_lang")))), "examples")
    pairs = prefill_pairs(now if memory is None else stage(originals(memory), "whole"), ask, hits, call)
    ask = with_example(ask, hits)
    if in_order:
        told = now.unionByName(ready.select(*[F.col("reply").alias("target") if c == "target" else c for c in ready.columns if c in now.columns]), allowMissingColumns=True)
        replies = replies_in_order(told, ask, pairs, client_factory, model, min_interval)
        replies = ask.join(replies, "id")
    else:
        replies = call(prefilled(ask, pairs))
    first = stage(replies.withColumn("adequacy", adequacy(F.col("source"), F.col("reply"))), "first")
    low = first.filter((F.col("adequacy") < LOW_ADEQUACY) & (F.col("reply") != "")).drop("reply", "adequacy", "duration").withColumn("context", no_context())
    second = stage(call(low).withColumn("adequacy", adequacy(F.col("source"), F.col("reply"))), "second")
    replies = better_of(first, second, ["id"]).filter(F.col("reply") != "").select("_text", "reply", "duration", F.lit(model).alias("model"), F.col("id").alias("_asked"))
    asked = misses.join(replies, "_text").withColumn("duration", F.when(F.col("id") == F.col("_asked"), F.col("duration")).otherwise(0))
    done = ready.unionByName(asked, allowMissingColumns=True)
    return stage(done.select("id", "book", "edition", "chapter", "paragraph", "source_lang", "source", "target_lang", F.col("reply").alias("target"), F.col("duration").cast("int").alias("duration"), fluency(F.col("reply")).alias("fluency"), "model", F.localtimestamp().alias("created")), "translated")


def replies_in_order(now: DataFrame, ask: DataFrame, pairs: DataFrame, client_factory: Callable[[], object], model: str, min_interval: float) -> DataFrame:
    """id, reply, duration of the rows to ask for, worked off by book, pair and edition in translation order; the pairs
    of a prefill stand before the first row."""
    group = ["book", "source_lang", "target_lang", "edition"]
    cols = ["id", "book", "source_lang", "target_lang", "edition", "chapter", "paragraph", "source", "target"]
    told = now.filter(store.is_filled(F.col("target"))).select(*cols, F.lit(None).cast("struct<source:string,target:string>").alias("example"), F.lit(False).alias("ask"))
    asked = ask.withColumn("target", F.lit(None).cast("string")).withColumn("ask", F.lit(True)).select(*cols, "example", "ask")
    ranked = ctx.chapter_rank(told.unionByName(asked))
    first = pairs.join(ask.select(*group).distinct(), group[:3]).select(*group, F.posexplode(in_place(F.col("x"))).alias("paragraph", "p"))
    first = first.select(F.col("p.id").alias("id"), *group, F.lit(0).alias("chapter"), "paragraph", "p.source", "p.target", F.lit(0).alias("chapter_rank"), F.lit(False).alias("ask"))
    ranked = ranked.unionByName(first, allowMissingColumns=True)
    return model_text_in_order(ranked, group, ["chapter_rank", "paragraph", "id"], client_factory, SYSTEM, model, min_interval, ctx.SIZE, ctx.WORD_LIMIT)


def proofread(rows: DataFrame, client_factory: Callable[[], object], model: str = "stub", min_interval: float = 0.0, parallel: int | None = None, memory: DataFrame | None = None, chapters: list[int] | None = None) -> DataFrame:
    """Overlay rows for translated rows that have none. A text that an overlay of the memory (rows themselves by default)
    already corrects takes that reply; all others go to the model, with the five corrected pairs before them in
    their book as context. Replies that change nothing but layout give no row; each is written down before it is used."""
    own = rows.select(*store.SCHEMA.fieldNames())
    read = stage(store.overlay_read(own), "read")
    texts = read.drop("source", "source_lang").withColumnRenamed("target", "source").withColumn("source_lang", F.lit(store.OVERLAY))
    todo = translatable(texts.filter(store.is_filled(F.col("source")) & F.col("proof").isNull())).drop("duration", "fluency", "model", "created")
    todo = todo if chapters is None else todo.filter(F.col("chapter").isin(chapters))
    c = ctx.context_of(texts.withColumnRenamed("proof", "target"), todo)
    todo = todo.join(c, "id", "left").withColumn("context", ctx.within_budget(F.coalesce("context", no_context())))
    todo = stage(known(todo, own if memory is None else memory.select(*store.SCHEMA.fieldNames())), "todo")
    ready = todo.filter("known.model <> 'copy'").select("*", "known.reply", "known.model", F.lit(0).alias("duration"))
    misses = todo.filter("known IS NULL").withColumn("source_lang", F.col("target_lang"))
    out = stage(model_text(misses, client_factory, SYSTEM_PROOF, "proofread", model, min_interval, parallel), "proofs").withColumn("model", F.lit(model))
    out = out.unionByName(ready, allowMissingColumns=True).filter(store.is_filled(F.col("reply")) & changed(F.col("source"), F.col("reply")))
    return stage(out.select("id", "book", "edition", "chapter", "paragraph", F.lit(store.OVERLAY).alias("source_lang"), "source", "target_lang", F.col("reply").alias("target"), F.col("duration").cast("int").alias("duration"), fluency(F.col("reply")).alias("fluency"), "model", F.localtimestamp().alias("created")), "proofread")


def built_chapters(rows: DataFrame) -> DataFrame:
    """Title, text and html of every chapter of a language pair whose rows are all translated, proofread texts where there are any."""
    texts = chapter_texts(store.overlay_read(rows), "text", F.count_if(~store.is_filled(F.col("target"))).alias("_open")).filter("_open = 0")
    return texts.withColumn("_h", markdown_html(F.col("markdown"))).select(*CHAPTER, F.coalesce("title", "_h.title", F.concat(F.lit("Chapter "), F.col("chapter").cast("string"))).alias("title"), "markdown", "_h.html")


#: Characters of html that one book may have; it is put together in one task.
BOOK_CHARS = 500_000_000


def build_books(rows: DataFrame) -> DataFrame:
    """(book, source_lang, target_lang, edition, title, epub) of every book in every language pair: title and author from
    its metadata chapter. A book is one file and one row; one of more than BOOK_CHARS characters raises an error that names it."""
    pair = CHAPTER[:-1]
    meta = store.item(store.current(rows).filter("chapter = 0 AND paragraph <= 2").filter(F.coalesce(F.col("source_lang") != store.OVERLAY, F.lit(True))))
    m = meta.groupBy(*pair).agg(*[F.max(F.when(F.col("paragraph") == i, after_colon(F.col("text")))).alias(n) for i, n in ((0, "ident"), (1, "name"), (2, "author"))])
    chapters = built_chapters(rows).filter("chapter > 0")
    g = chapters.groupBy(*pair).agg(F.sum(F.length("html")).alias("chars"), F.array_sort(F.collect_list(F.struct("chapter", "title", "html"))).alias("chapters"))
    fits = F.when(F.col("chars") <= BOOK_CHARS, F.col("chapters")).otherwise(F.raise_error(F.format_string("book %s has too many characters for one file: %s", F.col("book").cast("string"), F.col("chars").cast("string"))))
    same = [F.col(f"g.{k}").eqNullSafe(F.col(f"m.{k}")) for k in pair]
    g = g.withColumn("chapters", fits).alias("g").join(m.alias("m"), same[0] & same[1] & same[2] & same[3], "left").select("g.*", "ident", "name", "author", language_code(F.col("g.target_lang")).alias("code"))

    def pack(batches):
        import pandas as pd

        for pdf in batches:
            out = [(r.book, r.source_lang, r.target_lang, r.edition, r.name or "Untitled", write_epub(r.ident or str(r.book), r.name or "Untitled", r.author, r.code, [(c["title"], c["html"]) for c in r.chapters])) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["book", "source_lang", "target_lang", "edition", "title", "epub"])

    return g.drop("chars").mapInPandas(pack, "book long, source_lang string, target_lang string, edition int, title string, epub binary")


def chapter_files(rows: DataFrame) -> DataFrame:
    """name, text of the files of every built chapter: Markdown without its title, and html as an article."""
    c = built_chapters(rows).filter("chapter > 0")
    folder = F.concat_ws("/", F.col("book").cast("string"), F.coalesce("target_lang", F.lit("unknown")), F.col("edition").cast("string"))
    name = F.concat(folder, F.lit("/chapter-"), F.col("chapter").cast("string"))
    article = F.concat(F.lit('<article id="chapter-'), F.col("chapter").cast("string"), F.lit('">\n'), F.col("html"), F.lit("\n</article>"))
    return c.select(F.explode(F.array(F.struct(F.concat(name, F.lit(".md")).alias("name"), F.col("markdown").alias("text")), F.struct(F.concat(name, F.lit(".xhtml")).alias("name"), article.alias("text")))).alias("x")).select("x.*")


def source_files(chapters: DataFrame) -> DataFrame:
    """name, text of the Markdown files of read chapters: metadata, each chapter without its title, and the whole book."""
    c = chapters.filter("paragraphs is not null")
    own = F.array_join(F.slice("paragraphs", F.lit(2), F.greatest(F.size("paragraphs") - 1, F.lit(0))), "\n\n")
    one = c.select(F.when(F.col("chapter") == 0, F.lit("metadata.md")).otherwise(F.concat(safe_filename(F.coalesce("chapter_name", "item_id")), F.lit(".md"))).alias("name"), F.when(F.col("chapter") == 0, F.array_join("paragraphs", "\n\n")).otherwise(own).alias("text"))
    body = c.filter("chapter > 0").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("chapter", own.alias("t")))).alias("x"))
    return one.unionByName(body.select(F.concat(stem(F.col("path")), F.lit(".md")).alias("name"), F.array_join(F.transform("x", lambda s: F.concat(s["t"], F.lit("\n\n"))), "").alias("text")))


def quality_report(rows: DataFrame) -> DataFrame:
    """For each chapter: fluency of its text, adequacy against its source, and the overall score (40, 40, and 20 for
    consistency, which is 100 by definition of terms mapped to themselves)."""
    now = store.current(rows).filter(F.coalesce(F.col("source_lang") != store.OVERLAY, F.lit(True)) & store.is_filled(F.col("target")))
    key = ["book", "source_lang", "target_lang", "edition", "chapter"]
    g = now.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("paragraph", "id", "source", "target"))).alias("x"))
    text = lambda f: F.array_join(F.transform("x", lambda s: F.coalesce(s[f], F.lit(""))), "\n\n")
    g = g.select(*key, F.size("x").cast("long").alias("paragraphs"), fluency(text("target")).alias("fluency"), adequacy(text("source"), text("target")).alias("adequacy"))
    return g.withColumn("consistency", F.lit(100)).withColumn("overall", (F.col("fluency") * 0.4 + F.col("adequacy") * 0.4 + F.lit(100) * 0.2).cast("int"))


def book_report(rows: DataFrame, sample: int = 5) -> DataFrame:
    """For each book, pair and edition: mean fluency of its chapters, mean adequacy of the first `sample`, and overall."""
    r = quality_report(rows)
    group = ["book", "source_lang", "target_lang", "edition"]
    r = r.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy("chapter")))
    g = r.groupBy(*group).agg(F.count("*").alias("chapters"), F.avg("fluency").alias("fluency"), F.avg(F.when(F.col("n") <= sample, F.col("adequacy"))).alias("adequacy"))
    return g.withColumn("overall", (F.col("fluency") * 0.4 + F.col("adequacy") * 0.4 + F.lit(100) * 0.2).cast("int"))


def chapter_checks(rows: DataFrame) -> DataFrame:
    """Faults of each chapter's text by itself, without its source: formatting, points for mistranslation (any text is
    long beside no source), repeated phrases, their total, and fluency."""
    key = CHAPTER
    texts = chapter_texts(store.overlay_read(rows).filter(store.is_filled(F.col("text")))).withColumn("_id", F.to_json(F.struct(*key)))
    phrases = similarity.repeated_count(similarity.sentence_sets(texts, "_id", "markdown"), "_id")
    t = F.col("markdown")
    g = texts.join(phrases, "_id", "left").select(*key, formatting_issues(t).alias("formatting"), mistranslations(F.lit(""), t).alias("mistranslations"), F.coalesce("pairs", F.lit(0).cast("long")).alias("repeated"), fluency(t).alias("fluency"))
    return g.withColumn("total", F.col("formatting") + F.col("mistranslations") + F.col("repeated"))
