"""Sources and sinks: html, Markdown and EPUB books into chapter rows; the memory from and to CSV and Parquet; texts out.

Chapter rows: path, chapter (0 = metadata), item_id, chapter_name, title, paragraphs, error (null but for files that
can't be read, which have one row with nothing else).
"""

from __future__ import annotations

import io
import os
import uuid
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.html import html_markdown
from ..functions.text import safe_filename, split_filename, strip
from ..operators.store import KEY, SCHEMA
from ..session import ship_package
from .epub import read_epub, toc_links

CHAPTERS = "path string, chapter int, item_id string, chapter_name string, title string, paragraphs array<string>, error string"


def stem(path: Column) -> Column:
    """File name without folder and ending; file addresses come percent-encoded."""
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_replace(F.regexp_extract(plain, r"([^/]*)$", 1), r"\.[^.]*$", "")


def markdown_chapters(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Chapters of Markdown documents: a block that begins with # starts one; what comes before belongs to the metadata
    chapter, which every document has and which holds `Author - Title`, title and author from the file name. A document's blocks are cut inside its
    row and travel once."""
    name = split_filename(stem(F.col(path)))
    blocks = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n\n"), lambda b: strip(b) != "")
    lead = F.array(F.concat_ws(" - ", "name.author", "name.title"), F.col("name.title"), F.col("name.author"))
    d = docs.select(F.col(path).alias("path"), name.alias("name"), blocks.alias("blocks"))
    first = F.array(F.lit(None).cast("string"))  # so that every document has its metadata chapter
    b = d.select("path", "name", F.posexplode(F.concat(first, "blocks")).alias("pos", "block"))
    head = F.coalesce(F.startswith("block", F.lit("#")), F.lit(False))
    b = b.withColumn("chapter", F.sum(head.cast("int")).over(Window.partitionBy("path").orderBy("pos")))
    title = F.when(head, strip(F.regexp_replace("block", r"^#{1,6}", "")))
    g = b.groupBy("path", "chapter").agg(F.first("name").alias("name"), F.max(title).alias("title"), F.array_sort(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("pos", "block")))).alias("x"))
    own = F.transform("x", lambda s: s["block"])
    titled = F.when(F.col("chapter") == 0, F.col("name.title")).otherwise(F.col("title"))
    code = F.lpad(F.col("chapter").cast("string"), 3, "0")
    return g.select("path", F.col("chapter").cast("int"), code.alias("item_id"), F.concat(code, F.lit(". "), titled).alias("chapter_name"), titled.alias("title"), F.when(F.col("chapter") == 0, F.concat(lead, own)).otherwise(F.concat(F.array("title"), own)).alias("paragraphs"), F.lit(None).cast("string").alias("error"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    return markdown_chapters(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    return markdown_chapters(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), html_markdown(F.col("value")).alias("text")))


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """All chapters of EPUB files; a file that can't be read gives one row with its path and the error."""
    ship_package(spark)

    def chapters(batches):
        for pdf in batches:
            rows = []
            for p, data in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(p, c["chapter"], c["id"], c["name"], c["title"], c["paragraphs"], None) for c in read_epub(bytes(data))]
                except Exception as e:  # noqa: BLE001 - a broken file must not end the job
                    rows.append((p, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["path", "chapter", "item_id", "chapter_name", "title", "paragraphs", "error"])
            yield out.astype({"chapter": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(chapters, CHAPTERS)


def read_tables_of_contents(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the tables of contents of EPUB files: path, entry (from 0), title, target. Files without one, or that can't be read, give none."""
    ship_package(spark)

    def entries(batches):
        for pdf in batches:
            rows = []
            for p, data in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                        rows += [(p, i, t, to) for i, (t, to) in enumerate(toc_links(z, z.namelist()))]
                except (zipfile.BadZipFile, SyntaxError):  # read_epubs tells about it
                    continue
            yield pd.DataFrame(rows, columns=["path", "entry", "title", "target"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(entries, "path string, entry int, title string, target string")


#: File name endings and their readers.
READERS = {".epub": read_epubs, ".html": read_html, ".htm": read_html, ".md": read_markdown, ".markdown": read_markdown}


def read_book(spark: SparkSession, path: str) -> DataFrame:
    """Chapters of a book by its ending, whatever its case; ValueError for others."""
    ending = os.path.splitext(path)[1].lower()
    if ending not in READERS:
        raise ValueError(f"no reader for {ending or 'files without ending'}")
    return READERS[ending](spark, path)


def explode_paragraphs(chapters: DataFrame) -> DataFrame:
    """One row a paragraph, counted from 0; blank ones are dropped but keep their number."""
    keep = [c for c in chapters.columns if c != "paragraphs"]
    return chapters.select(*keep, F.posexplode("paragraphs").alias("paragraph", "source")).filter(strip(F.col("source")) != "")


CSV_COLUMNS = ["id", "edition", "chapter", "paragraph", "source_lang", "source", "target_lang", "target", "duration", "fluency", "model", "created"]


def export_csv(rows: DataFrame, path: str, single: bool = False) -> None:
    """Rows in key order with a header. single: one file, for one small book."""
    extra = [c for c in rows.columns if c == "book"]
    out = rows.select(*CSV_COLUMNS, *extra).orderBy(*[c for c in KEY if c in rows.columns], "id")
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(path)


def import_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV file. Empty numbers become -1 (fluency 1), empty id and created null; rows with numbers that can't
    be read, or without a language or source, are left out."""
    names = spark.read.option("header", True).csv(path).columns
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("nullValue", "\x00").option("emptyValue", "").schema(", ".join(f"`{n}` string" for n in names)).csv(path)

    def number(name: str, kind: str, default: int | None) -> Column:
        c = F.col(name)
        return F.when(F.coalesce(c, F.lit("")) == "", F.lit(default).cast(kind)).otherwise(F.expr(f"try_cast(`{name}` AS {kind})")).alias(name)

    good = F.lit(True)
    for n in ("id", "edition", "chapter", "paragraph", "duration", "fluency"):
        good = good & ((F.coalesce(F.col(n), F.lit("")) == "") | F.expr(f"try_cast(`{n}` AS BIGINT) IS NOT NULL"))
    good = good & F.col("source_lang").isNotNull() & F.col("target_lang").isNotNull() & F.col("source").isNotNull()
    cols = [number("id", "bigint", None), *[number(n, "int", -1) for n in ("edition", "chapter", "paragraph")], "source_lang", "source", "target_lang", "target", number("duration", "int", -1), number("fluency", "int", 1), "model", F.expr("try_to_timestamp(nullif(created, ''))").cast("timestamp_ntz").alias("created")]
    if "book" in names:
        cols.append(number("book", "bigint", None))
    return raw.filter(good).select(*cols)


def _files(spark: SparkSession, path: str) -> tuple:
    """Hadoop's Path class, the file system of a path, and the numbers of the pointers in it."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
    return fs.Path, system, sorted(int(n.removeprefix(POINTER)) for n in names if n.startswith(POINTER))


#: What the names of pointer files begin with; a number follows, and the highest counts.
POINTER = "POINTER-"


def write_store(rows: DataFrame, path: str) -> str:
    """A new version of the memory beside the old ones, partitioned by target language and edition. A new pointer then
    names it; older pointers and versions stay, so that a crash at any moment leaves the last complete version
    readable. Of two writers at a time the later one fails. Returns the version's name."""
    version = f"v-{uuid.uuid4().hex}"
    spark = rows.sparkSession
    at, system, numbers = _files(spark, path)
    rows.write.partitionBy("target_lang", "edition").parquet(f"{path}/{version}")
    fresh, pointer = at(f"{path}/_{version}"), at(f"{path}/{POINTER}{max(numbers, default=0) + 1:012d}")
    stream = system.create(fresh, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    if system.exists(pointer) or not system.rename(fresh, pointer):
        raise RuntimeError(f"{pointer} was written by another run; this version is not current")
    return version


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The version that the highest pointer names; an empty memory where no version was ever completed. Whatever else
    can't be read is an error."""
    _, _, numbers = _files(spark, path)
    if not numbers:
        return spark.createDataFrame([], SCHEMA)
    version = spark.read.text(f"{path}/{POINTER}{numbers[-1]:012d}").first().value
    return spark.read.schema(SCHEMA).parquet(f"{path}/{version}").select(*SCHEMA.fieldNames())


#: What a chapter's text belongs to.
CHAPTER = ["book", "source_lang", "target_lang", "edition", "chapter"]


def chapter_texts(rows: DataFrame, text: str = "text", *more: Column) -> DataFrame:
    """Each chapter's text in each language pair: its paragraphs in order without the title (paragraph 0), blank lines
    between them. more: further aggregates."""
    g = rows.groupBy(*CHAPTER).agg(F.array_sort(F.collect_list(F.struct("paragraph", F.col("id"), F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("x"), *more)
    body = F.array_join(F.transform(F.filter("x", lambda s: s["paragraph"] > 0), lambda s: s["t"]), "\n\n")
    title = F.try_element_at(F.filter("x", lambda s: s["paragraph"] == 0), F.lit(1))["t"]
    return g.select(*CHAPTER, title.alias("title"), body.alias("markdown"), *[c for c in g.columns if c not in [*CHAPTER, "x"]])


def write_files(files: DataFrame, folder: str) -> int:
    """One file for each row (name, text), whose names may have folders; they pass through the driver one by one, so this
    is for a book or a few, and `write_texts` for many. Returns how many files there are."""
    spark, n = files.sparkSession, 0
    at, system, _ = _files(spark, folder)
    for r in files.toLocalIterator():
        stream = system.create(at(f"{folder}/{r.name}"), True)
        stream.write(bytearray((r.text or "").encode()))
        stream.close()
        n += 1
    return n


def write_texts(texts: DataFrame, folder: str, name: Column, text: str = "markdown") -> None:
    """One folder of text for each name (made safe), written by the executors."""
    texts.select(safe_filename(name).alias("name"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("name").text(folder)
