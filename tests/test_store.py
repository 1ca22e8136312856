import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lexweave.operators import context, similarity, store
from lexweave.operators.model import Caller, HttpClient, StubClient, bleeds, reply_content, unwrap
from lexweave.plans import pipeline
from lexweave.sources import epub, readers
from lexweave.streaming import resume

NOW = datetime.datetime(2024, 1, 1)


def row(i, chapter=1, paragraph=1, source="Hello there", target="Bonjour", lang="English", to="French", edition=1, duration=1000, fluency=90, book=1, model="m"):
    return (i, book, edition, chapter, paragraph, lang, source, to, target, duration, fluency, model, NOW)


@pytest.fixture
def memory(spark):
    rows = [row(1), row(2, paragraph=2, source="World", target="Monde", duration=1500, fluency=95), row(3, paragraph=3, source="Third", target="", duration=-1, fluency=-1, model=""),
            row(4, lang="@", source="Bonjour", target="Salut"), row(5, chapter=2, source="Hello there", target="Allo", fluency=99), row(6, chapter=0, paragraph=0, source="id", target="id")]
    return spark.createDataFrame(rows, store.SCHEMA)


def test_reads(spark, memory):
    assert store.latest_edition(memory).filter("source_lang = 'English'").first().edition == 1
    s = store.chapter_stats(memory).filter("chapter = 1 AND source_lang = 'English'").first()
    assert (s.total, s.untranslated, s.timed, s.elapsed, s.average, s.remaining) == (3, 1, 2, 2500, 1250.0, 1250.0)
    texts = {r.paragraph: r.text for r in store.overlay_read(memory).filter("chapter = 1").collect()}
    assert texts == {1: "Salut", 2: "Monde", 3: ""}
    assert store.best_translation(memory).filter("source = 'Hello there'").first().target == "Allo"
    nxt = store.next_paragraph(memory).filter("chapter = 1 AND paragraph = 1").first()
    assert (nxt.next_paragraph, nxt.next_text) == (2, "Monde")
    assert [r.chapter for r in store.chapter_list(memory).filter("source_lang = 'English'").orderBy("rank_by_length").collect()] == [1, 2]
    assert store.cleanup_empty(memory).count() == 5
    assert store.complete_chapters(memory).filter("chapter = 1 AND source_lang = 'English'").count() == 0
    assert store.item(memory).filter("id = 3").first().text == "Third"


def test_search(memory):
    assert store.search(memory, "hello THERE").count() == 2
    assert store.search(memory, "").count() == 0
    assert store.search(memory, "a " * 11).count() == 0
    assert store.search(memory, "h_llo", wildcards=True).count() == 2
    assert store.search(memory, "100%").count() == 0
    assert store.top_hit(store.search(memory, "hello"), ["book"]).first().target == "Allo"


def test_writes(spark, memory):
    new = spark.createDataFrame([row(10, target="New"), row(11, target="Newer"), row(12, paragraph=9, target="Nine"), row(2, paragraph=8, target="by id")], store.SCHEMA)
    ignore = {r.id for r in store.insert_ignore(memory, new).collect()}
    assert ignore == {1, 2, 3, 4, 5, 6, 12, 2}
    up = {r.id: r.target for r in store.upsert(memory, new.filter("id > 9")).collect()}
    assert up == {2: "Monde", 3: "", 4: "Salut", 5: "Allo", 6: "id", 11: "Newer", 12: "Nine"}
    assert {r.id: r.target for r in store.import_replace(memory, new).collect()}[2] == "by id"
    empty = spark.createDataFrame([], store.SCHEMA)
    assert store.upsert(empty, memory).count() == 6 and store.upsert(memory, empty).count() == 6
    nulls = spark.createDataFrame([(1, None, None, None, None, None, None, None, None, None, None, None, None), (2, None, None, None, None, None, None, None, "x", None, None, None, None)], store.SCHEMA)
    assert store.upsert(nulls, nulls).count() == 1


@pytest.mark.parametrize(("spec", "expected"), [("1,3-5,8-10", [1, 3, 4, 5, 8, 9, 10]), ("7-3", []), ("2,2, 1", [1, 2]), ("", [])])
def test_selector(spec, expected):
    assert store.parse_selector(spec) == expected


@pytest.mark.parametrize("spec", ["-3", "1-2-3", "x"])
def test_selector_errors(spec):
    with pytest.raises(ValueError):
        store.parse_selector(spec)


def test_selector_all(memory):
    assert store.select_chapters(memory, " ").count() == memory.count()


def test_context(spark):
    rows = [row(i, paragraph=i, source=f"word{i} " * 60, target=f"mot{i} " * 60) for i in range(1, 9)]
    r = {x.id: x for x in context.rolling_pairs(spark.createDataFrame(rows, store.SCHEMA)).withColumn("k", context.within_budget(F.col("context"))).collect()}
    assert [p.id for p in r[8].context] == [3, 4, 5, 6, 7]
    assert [p.id for p in r[8].k] == [4, 5, 6, 7]
    assert r[1].context == []
    m = context.chat_messages(F.lit("S"), F.array(F.struct(F.lit("a").alias("source"), F.lit("b").alias("target"))), F.lit("English"), F.lit("French"), F.lit("t"))
    assert [tuple(x) for x in spark.range(1).select(m.alias("m")).first().m] == [("system", "S"), ("user", "<english>a</english>"), ("assistant", "<french>b</french>"), ("user", "<english>t</english>")]
    kept = spark.range(1).select(context.keeps_context(F.lit(3), F.array(F.lit("x" * 51))).alias("a"), context.keeps_context(F.lit(12), F.array(F.lit("x" * 51))).alias("b")).first()
    assert (kept.a, kept.b) == (True, False)
    pre = context.prefill(spark.createDataFrame([row(i, paragraph=i, source="s" * 60, target="t" if i % 2 else "") for i in range(1, 7)], store.SCHEMA), F.lit(1))
    assert [(r.id, r.priority) for r in pre.orderBy("rank").collect()] == [(5, 1), (3, 1), (1, 1)]


def test_similar_pairs(spark):
    texts = ["a b c d e f g h i j", "a b c d e f g h i k", "a b c d e f g h i j", "x y", "y x", "z"]
    df = spark.createDataFrame([(1, sorted(set(t.split()))) for t in texts], "g long, words array<string>").groupBy("g", "words").agg(F.count("*").alias("n"))
    brute = sum(len(a & b) / len(a | b) > 0.8 for i, a in enumerate(map(set, map(str.split, texts))) for b in map(set, map(str.split, texts[i + 1 :])))
    assert similarity.repeated_count(df, "g").first().pairs == brute


def test_model_client():
    assert unwrap("<think>x</think><fr> a </fr>", "fr") == "a" and unwrap("a", "fr") is None
    assert reply_content('{"choices":[{"message":{"content":"ok"}}]}') == "ok"
    with pytest.raises(ValueError, match="bad key"):
        reply_content('{"error": "bad key"}')
    assert bleeds("w " * 60, "short", []) and not bleeds("a b", "c d", [("x", "y")])
    waits, calls = [], []

    class Flaky:
        def complete(self, payload):
            calls.append(len(payload["messages"]))
            if len(calls) < 3:
                raise OSError("busy")
            return "<fr>fin</fr>"

    c = Caller(Flaky(), sleep=waits.append, clock=lambda: 0.0)
    assert c.translate("un deux", lambda p: [{}] * (1 + len(p)), [], "fr") == "fin" and waits == [2.0, 4.0]
    times = iter([0.0, 0.0, 0.4, 1.0])
    waits.clear()
    c = Caller(StubClient(), min_interval=1.0, sleep=waits.append, clock=lambda: next(times))
    for _ in range(2):
        c.ask([{"content": "<en>x</en>"}], "fr")
    assert waits == [0.6]
    assert HttpClient("http://x/", "k").url == "http://x"


def test_pipeline(spark, memory, tmp_path):
    done = pipeline.translate(memory, StubClient)
    assert [(r.id, r.target) for r in done.collect()] == [(3, "[t] Third")]
    full = store.upsert(memory, done.select(*memory.columns))
    proofs = pipeline.proofread(full, lambda: StubClient("[p] "))
    assert {r.source for r in proofs.collect()} == {"Monde", "[t] Third", "Allo", "id"}
    books = pipeline.build_books(full).collect()
    assert [(r.source_lang, r.target_lang) for r in books] == [("English", "French")]
    chapters = epub.read_epub(bytes(books[0].epub))
    assert [c["chapter"] for c in chapters] == list(range(len(chapters))) and any("Monde" in p for c in chapters for p in c["paragraphs"])
    report = pipeline.quality_report(memory).filter("chapter = 1").first()
    assert report.consistency == 100 and 0 <= report.overall <= 100


def test_translate_known(spark):
    """Texts of one language and texts of the memory are not sent; equal others are sent once."""
    rows = [row(1, target="Bonjour", fluency=80), row(2, paragraph=2, target="Salut", fluency=95, book=2, model="best"), row(3, paragraph=3, target=""), row(4, paragraph=4, source="Same", target="", to="english"),
            row(5, paragraph=5, source="Other", target=""), row(6, paragraph=6, source="***", target=""), row(7, chapter=2, source="Other", target=""), row(8, paragraph=8, target="", to="German")]
    memory = spark.createDataFrame(rows, store.SCHEMA)
    got = {r.id: (r.target, r.model) for r in pipeline.translate(memory, StubClient).collect()}
    assert got == {3: ("Salut", "best"), 4: ("Same", "copy"), 5: ("[t] Other", "stub"), 6: ("***", "copy"), 7: ("[t] Other", "stub"), 8: ("[t] Hello there", "stub")}
    part = pipeline.translate(memory.filter("id = 3"), StubClient, memory=memory)
    assert [(r.id, r.target) for r in part.collect()] == [(3, "Salut")]


def test_best_hits(spark, memory):
    q = spark.createDataFrame([(p, "English", "French") for p in ("ELLO there", "world", "hello world", "", "o " * 11)], "phrase string, source_lang string, target_lang string")
    assert {r.phrase: r.example.target for r in store.best_hits(memory, q).collect()} == {"ELLO there": "Allo", "world": "Monde"}


def test_translate_requests(spark, tmp_path):
    """A similar example and up to three pairs of the book go with every request, drafts of its own texts if it has none."""
    log = str(tmp_path / "log")

    class Logged(StubClient):
        def complete(self, payload):
            import json

            with open(log, "a") as f:
                f.write(json.dumps([m["content"] for m in payload["messages"][1:]]) + "\n")
            return super().complete(payload)

    long = [f"Sentence number {w} of a book with nothing translated in it yet." for w in ("one", "two")]
    rows = [row(1, book=1, source="The silver lantern", target="La lanterne"), row(2, book=2, source="silver lantern", target=""),
            *[row(3 + i, book=2, paragraph=2 + i, source=t, target="") for i, t in enumerate(long)],
            *[row(6 + i, book=3, chapter=2, paragraph=i, source=f"An old text {i} which is longer than fifty characters by far.", target=f"Texte {i}") for i in range(4)],
            row(20, book=3, chapter=2, paragraph=-1, source="Fresh words", target="")]
    pipeline.translate(spark.createDataFrame(rows, store.SCHEMA), Logged).collect()
    import json

    asked = [json.loads(x) for x in open(log)]
    last = {m[-1]: m for m in asked}
    lantern = last["<english>silver lantern</english>"]
    assert lantern[:2] == ["<english>The silver lantern</english>", "<french>La lanterne</french>"]
    assert len(lantern) == 7 and {lantern[2], lantern[4]} == {f"<english>{t}</english>" for t in long}
    assert len(last["<english>Fresh words</english>"]) == 7
    assert sorted(len(m) for m in asked if "Sentence" in m[-1])[:2] == [1, 3]


def test_extract(spark, tmp_path):
    (tmp_path / "A. Writer - Book.md").write_text("Before\n\n# One\n\nText here.\n\n1234\n\n## Two\n\nMore.")
    chapters = readers.read_book(spark, str(tmp_path / "A. Writer - Book.md"))
    got = {r.chapter: (r.title, r.paragraphs) for r in chapters.collect()}
    assert got[0] == ("Book", ["A. Writer - Book", "Book", "A. Writer", "Before"])
    assert got[1] == ("One", ["One", "# One", "Text here.", "1234"]) and got[2][0] == "Two"
    empty = spark.createDataFrame([], store.SCHEMA)
    rows = pipeline.extract(chapters, empty, F.lit(7).cast("long"), "English", "French")
    r = {x.source: x for x in rows.collect()}
    assert (r["1234"].target, r["1234"].model, r["1234"].fluency) == ("1234", "copy", 100) and r["Text here."].target == "" and r["1234"].edition == 1
    (tmp_path / "page.HTML").write_text("<h1>T</h1><p>x</p>")
    assert readers.read_book(spark, str(tmp_path / "page.HTML")).filter("chapter = 1").first().title == "T"
    with pytest.raises(ValueError):
        readers.read_book(spark, "a.pdf")


def test_epub(spark, tmp_path):
    data = epub.write_epub("id1", "Title & co", "Me", "fr", [("One", "<h1>One</h1><p>a</p>"), ("Two", "<p>a much longer paragraph that has more than ten words in it</p>")])
    (tmp_path / "b.epub").write_bytes(data)
    (tmp_path / "broken.epub").write_bytes(b"no zip")
    every = readers.read_epubs(spark, str(tmp_path)).collect()
    assert [(r.path.rpartition("/")[2], r.chapter, r.paragraphs) for r in every if r.error] == [("broken.epub", None, None)]
    assert [(r.entry, r.title, r.target) for r in readers.read_tables_of_contents(spark, str(tmp_path)).collect()] == [(0, "One", "chapter1.xhtml"), (1, "Two", "chapter2.xhtml")]
    rows = {r.chapter: r for r in every if not r.error}
    assert rows[0].paragraphs[:5] == ["id1", "Title & co", "Me", "Unknown", "Unknown"]
    assert rows[2].title == "One" and rows[3].chapter_name == "003. Two"
    assert epub.heading_of(["w " * 12]) is None and epub.heading_of(["1. Short start!"]) == "Short start"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert epub.toc_links(z, z.namelist()) == [("One", "chapter1.xhtml"), ("Two", "chapter2.xhtml")]


def test_csv_and_store(spark, memory, tmp_path):
    readers.export_csv(memory, str(tmp_path / "csv"), single=True)
    assert sorted(map(tuple, readers.import_csv(spark, str(tmp_path / "csv")).select(*memory.columns).collect())) == sorted(map(tuple, memory.collect()))
    (tmp_path / "x.csv").write_text('id,edition,chapter,paragraph,source_lang,source,target_lang,target,duration,fluency,model,created\n,,1,x,English,a,French,b,,,m,\n,,1,2,English,"a ""q"", b",French,"l1\nl2",,,m,\n')
    r = readers.import_csv(spark, str(tmp_path / "x.csv")).collect()
    assert len(r) == 1 and (r[0].id, r[0].edition, r[0].fluency, r[0].duration, r[0].created) == (None, -1, 1, -1, None) and r[0].source == 'a "q", b' and r[0].target == "l1\nl2"
    path = str(tmp_path / "store")
    assert readers.read_store(spark, path).count() == 0
    readers.write_store(memory, path)
    readers.write_store(memory.filter("id < 3"), path)
    assert readers.read_store(spark, path).count() == 2


def test_store_is_never_lost(spark, memory, tmp_path, monkeypatch):
    """A crash before or while the pointer is written leaves the last version; an unreadable version is an error."""
    import shutil

    path = str(tmp_path / "store")
    readers.write_store(memory, path)
    real = readers._files

    class Broken:
        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            return getattr(self.system, name)

        def rename(self, a, b):
            return False

    monkeypatch.setattr(readers, "_files", lambda s, p: (lambda x: (x[0], Broken(x[1]), x[2]))(real(s, p)))
    with pytest.raises(RuntimeError):
        readers.write_store(memory.filter("id < 3"), path)
    monkeypatch.setattr(readers, "_files", real)
    assert readers.read_store(spark, path).count() == 6
    version = readers.write_store(memory.filter("id < 3"), path)
    assert readers.read_store(spark, path).count() == 2
    shutil.rmtree(f"{path}/{version}")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_store(spark, path)


def counting(log, mark="[t] "):
    """Makes clients that write down every request; a text with the word weak gets a reply that scores low. Workers don't have this module, so that all is local."""

    def make():
        import json

        from lexweave.operators.model import StubClient

        class Counting(StubClient):
            def complete(self, payload):
                with open(log, "a") as f:
                    f.write(json.dumps([m["content"] for m in payload["messages"][1:]]) + "\n")
                return f"<{payload['target_tag']}>Autre</{payload['target_tag']}>" if "weak" in payload["messages"][-1]["content"] else super().complete(payload)

        return Counting(mark)

    return make


def asked(log):
    import json

    return [json.loads(x) for x in open(log)]


def test_calls_are_paid_once(spark, tmp_path):
    """As many calls as distinct requests, though the result is read again and again and stored."""
    log = str(tmp_path / "log")
    rows = [row(i, paragraph=i, source=f"Number {i} of the texts", target="") for i in range(10)] + [row(20, paragraph=20, source="Number 3 of the texts", target=""), row(21, paragraph=21, source="A weak text of seven words at least", target="")]
    memory = spark.createDataFrame(rows, store.SCHEMA)
    new = pipeline.translate(memory, counting(log))
    new.collect()
    full = store.upsert(memory, new.select(*memory.columns))
    assert full.filter("target <> ''").count() == 12 and new.count() == 12
    assert len(asked(log)) == 12  # ten texts, one weak text twice
    proofs = pipeline.proofread(full, counting(str(tmp_path / "proofs"), "[p] "))
    both = store.upsert(full, proofs.select(*memory.columns))
    assert both.filter("source_lang = '@'").count() == proofs.count() == 12
    requests = asked(str(tmp_path / "proofs"))
    assert len(requests) == len({tuple(r) for r in requests}) and len(requests) <= 12
    assert pipeline.proofread(both, counting(str(tmp_path / "none"))).count() == 0 and not (tmp_path / "none").exists()


def test_proofreading_context(spark, tmp_path):
    """Corrected pairs stand before a request; a text that was corrected before is not sent."""
    rows = [row(i, paragraph=i, source=f"text {i}", target=f"texte {i}") for i in range(1, 5)]
    rows += [row(10 + i, paragraph=i, lang="@", source=f"texte {i}", target=f"le texte {i}") for i in (1, 2)] + [row(20, paragraph=9, source="again", target="texte 1")]
    log = str(tmp_path / "log")
    got = {r.id: r.target for r in pipeline.proofread(spark.createDataFrame(rows, store.SCHEMA), counting(log, "[p] ")).collect()}
    assert got == {3: "[p] texte 3", 4: "[p] texte 4", 20: "le texte 1"}
    assert sorted(map(len, asked(log))) == [5, 5] and asked(log)[0][:2] == ["<french>texte 1</french>", "<french>le texte 1</french>"]


def test_in_order(spark, tmp_path):
    """Each request has the replies to those before it in its book, and stored pairs; at most five."""
    log = str(tmp_path / "log")
    rows = [row(i, paragraph=i, source=f"Words of {i}", target="Mots" if i == 2 else "") for i in range(1, 9)] + [row(20, book=2, source="Another", target="")]
    got = {r.id: r.target for r in pipeline.translate(spark.createDataFrame(rows, store.SCHEMA), counting(log), in_order=True).collect()}
    assert len(got) == 8 and got[8] == "[t] Words of 8"
    by = {r[-1]: r for r in asked(log)}
    assert by["<english>Words of 3</english>"][-5:-1] == ["<english>Words of 1</english>", "<french>[t] Words of 1</french>", "<english>Words of 2</english>", "<french>Mots</french>"]
    pairs = [x for x in by["<english>Words of 8</english>"] if x.startswith("<english>")]
    assert pairs[-6:] == [f"<english>Words of {i}</english>" for i in range(3, 9)] and len(by["<english>Another</english>"]) <= 3


def test_two_languages(spark):
    """Each language pair of a book is built and checked by itself."""
    rows = [row(1, target="Bonjour"), row(2, target="Guten Tag", to="German"), row(3, paragraph=2, target="", to="German"), row(4, lang="@", source="Bonjour", target="Salut")]
    memory = spark.createDataFrame(rows, store.SCHEMA)
    built = {r.target_lang: r.html for r in pipeline.built_chapters(memory).collect()}
    assert set(built) == {"French"} and "Salut" in built["French"] and "Guten" not in built["French"]
    assert {r.target_lang for r in pipeline.chapter_checks(memory).collect()} == {"French", "German"}
    assert {r.target_lang for r in pipeline.build_books(pipeline.of_pair(memory, "English", "French", 1)).collect()} == {"French"}
    names = {r.name: r.text for r in pipeline.chapter_files(memory).collect()}
    assert names["1/French/1/chapter-1.md"] == "Salut" and names["1/French/1/chapter-1.xhtml"].startswith('<article id="chapter-1">')


def test_context_of_long_books(spark, monkeypatch):
    """Contexts across blocks and stretches against a plain walk over each book."""
    monkeypatch.setattr(context, "SPAN", 3)
    monkeypatch.setattr(context, "BLOCK", 7)
    rows = [row(100 * b + i, book=b, chapter=1 + i % 4, paragraph=i // 2, source=f"s{b} {i}", target=f"t{b} {i}" if i % 5 else "") for b in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, store.SCHEMA)
    want = {}
    for b in (1, 2):
        mine = [r for r in rows if r[1] == b and r[8]]
        n = {c: sum(r[3] == c for r in mine) for c in range(5)}
        mine.sort(key=lambda r: (r[3] != 0, -n[r[3]], r[3], r[4], r[0]))
        want |= {r[0]: [x[0] for x in mine[max(0, k - 5) : k]] for k, r in enumerate(mine)}
    assert {r.id: [p.id for p in r.context] for r in context.rolling_pairs(df).collect()} == want
    open_ = df.filter("target = ''")
    got = {r.id: [p.id for p in r.context] for r in context.context_of(df, open_).collect()}
    every = {}
    for b in (1, 2):
        mine = [r for r in rows if r[1] == b]
        n = {c: sum(r[3] == c for r in mine) for c in range(5)}
        mine.sort(key=lambda r: (r[3] != 0, -n[r[3]], r[3], r[4], r[0]))
        for k, r in enumerate(mine):
            if not r[8]:
                every[r[0]] = [x[0] for x in mine[:k] if x[8]][-5:]
    assert got == {k: v for k, v in every.items() if v}


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from lexweave.__main__ import main

    book = tmp_path / "A. Writer - Book.md"
    book.write_text("# One\n\nText here.\n\n# Two\n\nMore text.\n\n# Three\n\nLast text.")
    out = str(tmp_path / "out")
    args = [str(book), "-t", "french", "-o", out, "--stub"]
    assert main([*args, "-c", "2,9", "-v", "-w", "40"]) == 0
    said = capsys.readouterr().out
    assert "chapters that don't exist: 9" in said and "[t] More text." in said and "translate: " in said
    rows = readers.read_store(spark, out + "/store")
    assert {r.chapter for r in rows.filter("target <> ''").collect()} == {0, 2}
    assert (tmp_path / "out" / "English" / "002. Two.md").read_text() == "# Two\n\nMore text." and (tmp_path / "out" / "English" / "metadata.md").exists()
    assert "[t] More text." in (tmp_path / "out" / "1" / "French" / "1" / "chapter-2.md").read_text()
    chapters = epub.read_epub((tmp_path / "out" / "A. Writer - Book french 1.epub").read_bytes())
    assert chapters[0]["title"] == "[t] Book" and len(chapters) == 3  # title page and chapter 2
    assert main([*args, "--in-order", "--translate", "--proofread"]) == 0
    assert readers.read_store(spark, out + "/store").filter("target = ''").count() == 0
    csv = str(tmp_path / "rows.csv")
    assert main([*args, "-e", csv]) == 0 and main([str(book), "-o", str(tmp_path / "other"), "-i", csv]) == 0
    assert "imported rows:" in capsys.readouterr().out
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    assert main([str(tmp_path / "bad.epub"), "-o", str(tmp_path / "bad")]) == 1


def test_stage_folder(spark, monkeypatch):
    from lexweave import session

    staged = session.stage(spark.range(3), "a b")
    assert staged.count() == 3 and session.stage_dir(spark).endswith(spark.sparkContext.applicationId)

    class Conf:
        def get(self, *a):
            return None

    class Java:
        sc = getCheckpointDir = lambda self: self
        isDefined = lambda self: False

    class Context:
        master, _jsc = "yarn", Java()

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


def test_streaming(spark, memory, tmp_path):
    memory.write.parquet(str(tmp_path / "in"))
    run = lambda: resume.follow(spark, str(tmp_path / "in"), lambda df, memory: df.select("id").crossJoin(memory.agg(F.count("*").alias("seen"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert run() == 1 and [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [3]
    assert run() == 0
    memory.filter("id = 3").withColumn("id", F.lit(33).cast("long")).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == 1 and {(r.id, r.seen) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(3, 6), (33, 7)}
