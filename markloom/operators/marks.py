"""Text marks: scoring lines, what pages repeat, and how well the scores find labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markloom.functions import rules, scalars
from markloom.plans.registry import query, table


def _any(column: str, marks: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{m}')" for m in marks) + ")"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, line, line_no, n): the trimmed lines of documents, where each stands, how many there are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.split("text", "\n").alias("parts"))
    rows = docs.select("doc_id", "lang", "source", F.size("parts").alias("n"), F.posexplode("parts").alias("line_no", "line"))
    return rows.select("doc_id", "lang", "source", F.trim("line").alias("line"), "line_no", "n").where("line <> ''")


#: Double quotes in a pattern are plain in both engines.
LINES_SQL = """SELECT doc_id, lang, source, trim(parts[i]) AS line, i - 1 AS line_no, n FROM (
  SELECT doc_id, lang, source, parts, len(parts) AS n, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents)) WHERE trim(parts[i]) <> ''"""

SCORED_SQL = f"""
WITH l AS ({LINES_SQL}),
m AS (SELECT *, lower(line) AS low, count(*) OVER (PARTITION BY doc_id, line) AS repeats, CASE WHEN line_no = 0 OR line_no = n - 1 THEN 0.6::DOUBLE ELSE 0 END AS position FROM l),
k AS (SELECT *, {_any('low', rules.URL_MARKS)} AS url, {_any('low', rules.COPYRIGHT_MARKS)} AS rights, {_any('low', rules.PLATFORM_MARKS)} AS platform, regexp_matches(line, '{rules.TIME_OR_DATE}') AS dated FROM m),
s AS (SELECT doc_id, lang, line_no, line, greatest(0, least(0.98::DOUBLE, 0.15::DOUBLE + url::INT * 0.35::DOUBLE + rights::INT * 0.35::DOUBLE + platform::INT * 0.3::DOUBLE + dated::INT * 0.3::DOUBLE + position * 0.15::DOUBLE
  + least(1::DOUBLE, greatest(0::DOUBLE, (repeats - 1) / 3.0::DOUBLE)) * 0.2::DOUBLE - CASE WHEN length(line) > 40 AND NOT (url OR rights OR platform OR dated) THEN 0.25::DOUBLE ELSE 0 END)) AS score FROM k)
"""


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the number of equal lines in their document and their score as marks.

    Repeats are counted before lines meet a document again, by document and line, so a line that very many documents
    share is no hot key."""
    rows = lines(spark, sf_dir)
    repeats = F.count("*").over(Window.partitionBy("doc_id", "line"))
    position = F.when((F.col("line_no") == 0) | (F.col("line_no") == F.col("n") - 1), 0.6).otherwise(0.0)
    rows = rows.withColumn("repeats", repeats)
    return rows.withColumn("score", rules.text_score(F.col("line"), position, F.lit(0.0), F.col("repeats"), F.lit(0.85)))


@query(SCORED_SQL + "SELECT doc_id, line_no, round(score, 4) AS score FROM s WHERE score >= 0.3")
def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that may be marks."""
    return scored_lines(spark, sf_dir).where("score >= 0.3").select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.round("score", 4).alias("score"))


@query(
    SCORED_SQL
    + """, d AS (SELECT doc_id, max(score) AS score FROM s GROUP BY doc_id),
e AS (SELECT lang, quality = 0 AS marked, coalesce(d.score, 0) >= 0.45 AS found FROM labels JOIN documents USING (doc_id) LEFT JOIN d USING (doc_id))
SELECT lang, count(*) AS documents, count(*) FILTER (found AND marked) AS true_positives, count(*) FILTER (found AND NOT marked) AS false_positives, count(*) FILTER (NOT found AND marked) AS false_negatives,
  round(coalesce(count(*) FILTER (found AND marked) / nullif(count(*) FILTER (found), 0)::DOUBLE, 1), 6) AS precision_, round(coalesce(count(*) FILTER (found AND marked) / nullif(count(*) FILTER (marked), 0)::DOUBLE, 1), 6) AS recall FROM e GROUP BY lang
"""
)
def eval_text_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: lines are scored, documents decided, and the decisions held against labels, by language.

    A document's best score is a maximum with map-side combine; labels join the scores, not the texts."""
    best = scored_lines(spark, sf_dir).groupBy("doc_id").agg(F.max("score").alias("score"))
    known = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    e = known.join(best, "doc_id", "left").select("lang", (F.col("quality") == 0).alias("marked"), (F.coalesce("score", F.lit(0.0)) >= 0.45).alias("found"))
    found, marked = F.col("found"), F.col("marked")
    n = e.groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(found & marked).alias("true_positives"), F.count_if(found & ~marked).alias("false_positives"), F.count_if(~found & marked).alias("false_negatives"))
    tp = F.col("true_positives")
    rate = lambda other: F.round(F.coalesce(F.try_divide(tp, tp + F.col(other)), F.lit(1.0)), 6)
    return n.select("*", rate("false_positives").alias("precision_"), rate("false_negatives").alias("recall"))


@query(f"""
WITH t AS (SELECT page_id, url, html, regexp_matches(html, '{rules.TIME_OR_DATE}') AS dated FROM pages)
SELECT page_id, dated, regexp_extract(html, '{rules.TIME_OR_DATE}', 2) AS first_found, contains(lower(url), '.com') OR contains(lower(url), '.co') AS commercial FROM t
""")
def time_or_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page holds a clock time or a date, and the first."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", rules.time_or_date(F.col("html")).alias("dated"), F.regexp_extract("html", rules.TIME_OR_DATE, 2).alias("first_found"), rules.has_any(F.lower("url"), (".com", ".co")).alias("commercial"))


@query(f"""
WITH l AS ({LINES_SQL}) SELECT doc_id, line_no::BIGINT AS line_no, count(*) OVER (PARTITION BY doc_id, line) AS repeats FROM l QUALIFY repeats > 1
""")
def repeat_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that their document has more than once."""
    rows = lines(spark, sf_dir).withColumn("repeats", F.count("*").over(Window.partitionBy("doc_id", "line")))
    return rows.where("repeats > 1").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "repeats")


@query(f"""
WITH l AS ({LINES_SQL}), docs AS (SELECT source, count(*) AS all_pages FROM documents GROUP BY source),
o AS (SELECT source, line, count(DISTINCT doc_id) AS pages, max(line_no) - min(line_no) < 3 AS consistent, min(line_no) = 0 AS banded FROM l GROUP BY source, line HAVING count(DISTINCT doc_id) >= 2)
SELECT o.source, md5(line) AS object, pages, round(least(0.6::DOUBLE, 0.3::DOUBLE + 0.25::DOUBLE * pages / all_pages + CASE WHEN consistent THEN 0.08::DOUBLE ELSE 0 END - CASE WHEN banded THEN 0.25::DOUBLE ELSE 0 END), 6) AS score FROM o JOIN docs USING (source)
""")
def page_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that several pages (documents) of a file (source) repeat, scored by how many, and whether at one place.

    Lines are reduced to one row a document before documents are counted, so no distinct count sees every line."""
    per = lines(spark, sf_dir).groupBy("source", F.md5(F.col("line").cast("binary")).alias("object"), "doc_id").agg(F.min("line_no").alias("low"), F.max("line_no").alias("high"))
    o = per.groupBy("source", "object").agg(F.count("*").alias("pages"), F.min("low").alias("low"), F.max("high").alias("high")).where("pages >= 2")
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("all_pages"))
    no = F.lit(False)
    score = rules.object_score(F.col("pages"), F.col("all_pages"), F.col("high") - F.col("low") < 3, no, F.lit(1.0), F.lit(0.0), F.col("low") == 0)
    return o.join(n, "source").select("source", "object", "pages", F.round(score, 6).alias("score"))


@query("""
WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS texts, count(*) FILTER (event_type = 'click') AS objects, max(value) / 500 AS cover FROM events GROUP BY user_id)
SELECT user_id AS page, CASE WHEN cover >= 0.85 AND texts <= 2 THEN 'scanned' WHEN cover >= 0.2 THEN 'mixed' WHEN texts > 0 OR objects > 0 THEN 'native' ELSE 'empty' END AS kind FROM c
""")
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page is made of, from the area its largest image covers and the texts it shows."""
    c = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("page")).agg(F.count_if(F.col("event_type") == "view").alias("texts"), F.count_if(F.col("event_type") == "click").alias("objects"), (F.max("value") / 500).alias("cover"))
    return c.select("page", rules.page_kind(F.col("cover"), F.col("texts"), F.col("objects")).alias("kind"))


@query("""
WITH w AS (SELECT list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 2)) AS words, doc_id, doc_id % 40 AS item_id FROM documents),
b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 2)) AS words FROM benchmark)
SELECT doc_id, len(b.words) AS original, len(list_filter(b.words, lambda x: list_contains(w.words, x))) AS kept, len(b.words) = 0 OR len(list_filter(b.words, lambda x: list_contains(w.words, x))) >= 0.98 * len(b.words) AS retained FROM w JOIN b ON w.item_id = b.item_id
""")
def word_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of an original's words its edited text has; 98 % must stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 40).alias("item_id"), scalars.retained_words(F.col("text")).alias("words"))
    items = table(spark, sf_dir, "benchmark").select("item_id", scalars.retained_words(F.col("text")).alias("wanted"))
    j = docs.join(items, "item_id").select("doc_id", F.size("wanted").cast("long").alias("original"), F.size(F.array_intersect("wanted", "words")).cast("long").alias("kept"))
    return j.withColumn("retained", F.col("kept") >= 0.98 * F.col("original"))
