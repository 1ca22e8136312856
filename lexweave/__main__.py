"""Command line: python -m lexweave BOOK -s English -t French [--extract --translate --proofread --build] ..."""

from __future__ import annotations

import argparse
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import side_by_side
from .operators import store
from .operators.model import PROVIDERS, HttpClient, StubClient
from .plans import pipeline
from .sources import readers


def parser() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(prog="lexweave")
    a.add_argument("book")
    a.add_argument("-s", "--source-lang", default="English")
    a.add_argument("-t", "--target-lang", default="Romanian")
    a.add_argument("-o", "--output", help="folder of the results; the book's name without its ending if left out")
    for phase in ("extract", "translate", "proofread", "build"):
        a.add_argument(f"--{phase}", action="store_true", help=f"run this phase; extract, translate and build run if no phase is named ({phase})")
    a.add_argument("--new-edition", action="store_true")
    a.add_argument("--stub", action="store_true", help="answer by a deterministic stand-in instead of a model")
    a.add_argument("--in-order", action="store_true", help="give each request the replies before it in its book; one request at a time")
    a.add_argument("-c", "--chapters", help="such as 1,3-5")
    kind = a.add_mutually_exclusive_group()
    for p in sorted(PROVIDERS):
        kind.add_argument(f"--{p}", dest="provider", action="store_const", const=p)
    a.set_defaults(provider="openai")
    a.add_argument("-m", "--model")
    a.add_argument("-u", "--url")
    a.add_argument("-k", "--api-key")
    a.add_argument("--throttle", type=float, default=0.0, help="least seconds between two requests")
    a.add_argument("--parallel", type=int, help="most requests at a time")
    a.add_argument("-e", "--export-csv")
    a.add_argument("-i", "--import-csv")
    a.add_argument("-v", "--verbose", action="store_true", help="print texts and translations side by side")
    a.add_argument("-w", "--width", type=int, help="of the side-by-side print; the terminal's if left out")
    return a


def chosen_chapters(rows: DataFrame, spec: str | None) -> list[int] | None:
    """Numbers of the chapters to work on, metadata always among them; None for all. Tells which of those asked for don't exist."""
    if not spec or not spec.strip():
        return None
    wanted = store.parse_selector(spec)
    have = {r.chapter for r in rows.select("chapter").distinct().filter(F.col("chapter").isin(wanted)).collect()}  # at most as many as asked for
    if missing := [c for c in wanted if c not in have]:
        print(f"chapters that don't exist: {', '.join(map(str, missing))}")
    return sorted(have | {0})


def show(rows: DataFrame, width: int) -> None:
    for r in rows.select("chapter", "paragraph", side_by_side(F.col("source"), F.col("target"), width).alias("lines")).orderBy("chapter", "paragraph").toLocalIterator():
        print("\n".join([f"--- chapter {r.chapter}, paragraph {r.paragraph}", *r.lines]))


def main(argv: list[str] | None = None) -> int:
    n = parser().parse_args(argv)
    source, target = n.source_lang.capitalize(), n.target_lang.capitalize()
    name = os.path.splitext(os.path.basename(n.book))[0]
    output = n.output or name
    spark = SparkSession.builder.appName("lexweave").getOrCreate()
    path = os.path.join(output, "store")
    memory = readers.read_store(spark, path)

    def keep(rows: DataFrame) -> DataFrame:
        readers.write_store(rows.select(*memory.columns), path)
        return readers.read_store(spark, path)

    if n.export_csv:
        readers.export_csv(memory, n.export_csv, single=True)
        return 0
    if n.import_csv:
        new = readers.import_csv(spark, n.import_csv)
        new = new if "book" in new.columns else new.withColumn("book", F.lit(1).cast("long"))
        keep(store.import_replace(memory, new.select(*memory.columns)))
        print(f"imported rows: {new.count()}")
        return 0
    url, model, variable = PROVIDERS[n.provider]
    model = n.model or model
    key = n.api_key or (os.environ.get(variable, "") if variable else "")
    client = (lambda: StubClient()) if n.stub else (lambda: HttpClient(n.url or url, key))
    every = not (n.extract or n.translate or n.proofread or n.build)
    if n.extract or every:
        chapters = readers.read_book(spark, n.book)
        if bad := chapters.filter("error is not null").first():
            print(f"{bad.path}: {bad.error}")
            return 1
        before = memory.count()
        memory = keep(pipeline.extract(chapters, memory, F.lit(1).cast("long"), source, target, n.new_edition))
        print(f"rows: {memory.count()}, {before} before")
        readers.write_files(pipeline.source_files(chapters), os.path.join(output, source))
    last = memory.filter((F.col("source_lang") == source) & (F.col("target_lang") == target)).agg(F.max("edition")).first()[0]
    pair = lambda: pipeline.of_pair(memory, source, target, last)
    chapters = chosen_chapters(pair(), n.chapters)
    for on, work in ((n.translate or every, pipeline.translate), (n.proofread, pipeline.proofread)):
        if on:
            more = {"in_order": n.in_order} if work is pipeline.translate else {}
            new = work(pair(), client, model, n.throttle, n.parallel, memory=memory, chapters=chapters, **more)
            if n.verbose:
                show(new, n.width or shutil.get_terminal_size().columns)
            memory = keep(store.upsert(memory, new.select(*memory.columns)))
            print(f"{work.__name__}: {new.count()} rows")
    if n.build or every:
        rows = pair() if chapters is None else pair().filter(F.col("chapter").isin(chapters))
        readers.write_files(pipeline.chapter_files(rows), output)
        for r in pipeline.build_books(rows).toLocalIterator():
            with open(os.path.join(output, f"{name} {target.lower()} {r.edition}.epub"), "wb") as f:
                f.write(r.epub)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
