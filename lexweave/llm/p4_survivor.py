"""Problem 4: the surviving value of each duplicate group, field by field.

Method: one aggregation takes, for each field, the maximum of a struct (rank values first, then the row that supplies
them); no window, no sort of a group, partial results before the shuffle, so a group of any size is safe. Nulls: key
columns that are null make a group of their own; a null model ranks 0; a null `created` ranks earliest and supplies no
`created`. Repeated rows tie and the largest id wins. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import EMPTY_STRIP, INVISIBLE, PLACEHOLDERS

_PLACES = sorted({"".join(c for c in p if c.isalpha()) for p in PLACEHOLDERS})
_JAVA_INVISIBLE = INVISIBLE.replace(r"\U000e0000-\U000e0fff", r"\x{e0000}-\x{e0fff}")


def is_empty_column(target: Column, source: Column) -> Column:
    """textkit.is_empty as a column expression."""
    kept = F.lower(F.regexp_replace(target, EMPTY_STRIP, ""))
    blanks = rf"[\s\p{{Z}}{_JAVA_INVISIBLE}]+"
    t, s = F.regexp_replace(target, blanks, ""), F.regexp_replace(source, blanks, "")
    nothing = (kept == "") | ((F.length(target) <= 120) & kept.isin(_PLACES))
    return F.coalesce(nothing & ~((t != "") & F.coalesce(t == s, F.lit(False))), F.lit(True))


def model_key(model: Column) -> Column:
    """Model name without provider prefix, case and outer blanks."""
    return F.lower(F.trim(F.regexp_replace(model, r"^.*@", "")))


def survivors(translations: DataFrame, models: DataFrame) -> DataFrame:
    """One row for each group of at least two rows and field that some row can supply: group_id, field, id, model."""
    trust = models.select(model_key(F.col("model")).alias("_key"), F.col("trust").cast("int").alias("_trust")).filter("_key is not null").groupBy("_key").agg(F.max("_trust").alias("_trust"))
    t = translations.select(
        "id", "book", "edition", "chapter", "paragraph", F.coalesce(F.col("source_lang") == "@", F.lit(False)).alias("overlay"),
        (~is_empty_column(F.col("target"), F.col("source"))).alias("filled"), "fluency", "model", "created", model_key(F.col("model")).alias("_key"),
    ).filter("id is not null").join(trust, "_key", "left")
    early = F.coalesce("created", F.lit("0001-01-01 00:00:00").cast(t.schema["created"].dataType))
    g = t.groupBy("book", "edition", "chapter", "paragraph", "overlay").agg(
        F.count("*").alias("n"),
        F.min("id").alias("group_id"),
        F.max(F.when(F.col("filled"), F.struct(F.coalesce("_trust", F.lit(0)).alias("a"), early.alias("b"), F.col("id"), F.col("model")))).alias("target"),
        F.max(F.when(F.col("filled") & (F.col("fluency") >= 0), F.struct(early.alias("b"), F.col("id"), F.col("model")))).alias("fluency"),
        F.max(F.when(F.col("created").isNotNull(), F.struct(F.col("created").alias("b"), F.col("id"), F.col("model")))).alias("created"),
    )
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f)["id"].alias("id"), F.col(f)["model"].alias("model")) for f in ("target", "fluency", "created")])
    return g.filter("n >= 2").select("group_id", F.explode(fields).alias("x")).select("group_id", "x.field", "x.id", "x.model").filter("id is not null")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/translations.parquet"), spark.read.parquet(f"{sf_dir}/models.parquet")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(*_tables(spark, sf_dir)).select("group_id", "field", "id")


def p4_model_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many surviving targets each model supplies."""
    return survivors(*_tables(spark, sf_dir)).filter("field = 'target'").groupBy(model_key(F.col("model")).alias("model")).agg(F.count("*").alias("survivors"))


_RE2_INVISIBLE = r"\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{fff9}-\x{fffb}\x{e0000}-\x{e0fff}"
_SQL_BLANKS = rf"[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}{_RE2_INVISIBLE}]+"
_SQL_BASE = rf"""
WITH base AS (
  SELECT id, book, edition, chapter, paragraph, coalesce(source_lang = '@', false) AS overlay, fluency, model, created,
         lower(trim(regexp_replace(model, '^.*@', ''))) AS k, target,
         lower(regexp_replace(target, '{EMPTY_STRIP}', '', 'g')) AS kept,
         regexp_replace(target, '{_SQL_BLANKS}', '', 'g') AS tb, regexp_replace(source, '{_SQL_BLANKS}', '', 'g') AS sb
  FROM translations),
t AS (
  SELECT b.*, coalesce(m.trust, 0) AS trust,
         NOT coalesce((kept = '' OR (length(target) <= 120 AND kept IN ({", ".join(f"'{p}'" for p in _PLACES)})))
                      AND NOT (tb <> '' AND coalesce(tb = sb, false)), true) AS filled
  FROM base b LEFT JOIN (SELECT lower(trim(regexp_replace(model, '^.*@', ''))) AS mk, max(trust) AS trust FROM models GROUP BY 1) m ON b.k = m.mk),
g AS (
  SELECT *, min(id) OVER w AS group_id, count(*) OVER w AS n FROM t
  WINDOW w AS (PARTITION BY book, edition, chapter, paragraph, overlay)),
best AS (
  SELECT group_id, 'target' AS field, id, k, row_number() OVER (PARTITION BY group_id ORDER BY trust DESC, created DESC NULLS LAST, id DESC) AS r FROM g WHERE n >= 2 AND filled
  UNION ALL
  SELECT group_id, 'fluency', id, k, row_number() OVER (PARTITION BY group_id ORDER BY created DESC NULLS LAST, id DESC) FROM g WHERE n >= 2 AND filled AND fluency >= 0
  UNION ALL
  SELECT group_id, 'created', id, k, row_number() OVER (PARTITION BY group_id ORDER BY created DESC, id DESC) FROM g WHERE n >= 2 AND created IS NOT NULL)
"""
QUERIES = {"p4_found": p4_found, "p4_model_report": p4_model_report}
SQL = {
    "p4_found": _SQL_BASE + "SELECT group_id, field, id FROM best WHERE r = 1",
    "p4_model_report": _SQL_BASE + "SELECT k AS model, count(*) AS survivors FROM best WHERE r = 1 AND field = 'target' GROUP BY 1",
}
