"""Review and masks: regions that are removed, what edits cover, similar marks, notes, undo, and rasters of masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markloom.functions import geometry as g
from markloom.functions import rules, scalars
from markloom.operators.decisions import CANDIDATES_SQL, candidates
from markloom.operators.spatial import BOXES_SQL, OVERLAP_SQL, boxes
from markloom.operators.statistics import nearest_rank, upper_median
from markloom.plans.registry import query, table


@query(f"""
WITH c AS (SELECT DISTINCT file_id, candidate FROM ({CANDIDATES_SQL}) WHERE CASE user_action WHEN 'approve' THEN true WHEN 'reject' THEN false ELSE decision = 'auto' END),
b AS ({BOXES_SQL}) SELECT b.page, b.id FROM b SEMI JOIN c ON b.page = c.file_id AND b.id = c.candidate UNION ALL SELECT DISTINCT page, 0 FROM b WHERE page % 10 = 0
""")
def removal_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask regions of approved candidates, and those drawn by hand (region 0 of every tenth file)."""
    c = candidates(spark, sf_dir)
    approved = c.where(rules.should_remove(c.decision, c.user_action)).select(F.col("file_id").alias("page"), F.col("candidate").alias("id"))
    b = boxes(spark, sf_dir).select("page", "id")
    return b.join(approved, ["page", "id"], "left_semi").unionByName(b.where("page % 10 = 0").select("page", F.lit(0).alias("id")).distinct())


@query("""
SELECT o_orderkey AS file_id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50
""")
def preview_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty previews to make first; only they are numbered."""
    first = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)
    return first.select(F.col("o_orderkey").alias("file_id"), F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("place"))


@query("""
SELECT page_id, url LIKE 'https://%' AS secure, starts_with(url, 'http') AND NOT contains(url, '..') AS allowed, lower(regexp_extract(split_part(url, '?', 1), '[^/.][^/]*\\.([^./]+)$', 1)) AS ext FROM pages
""")
def paths_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.col("url").startswith("https://").alias("secure"), (F.col("url").startswith("http") & ~F.contains("url", F.lit(".."))).alias("allowed"), scalars.lower_ext(F.substring_index("url", "?", 1)).alias("ext"))


@query(f"""
WITH b AS ({BOXES_SQL}), t AS (SELECT page, x + 3 AS x, y + 2 AS y, w, h FROM b WHERE id = 2), old AS (SELECT * FROM b WHERE id > 2),
m AS (SELECT t.page, min(old.id) AS id FROM t JOIN old ON t.page = old.page AND {OVERLAP_SQL.format(a="t.", b="old.")} / (t.w * t.h + old.w * old.h - {OVERLAP_SQL.format(a="t.", b="old.")}) > 0.3 GROUP BY t.page)
SELECT t.page, coalesce(m.id, -1) AS candidate, CASE WHEN m.id IS NULL THEN 'insert' ELSE 'update' END AS action FROM t LEFT JOIN m ON t.page = m.page
""")
def apply_to_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mark found again in other files updates the first candidate it overlaps, or is a new one."""
    b = boxes(spark, sf_dir)
    moved = g.box(F.col("box.x") + 3, F.col("box.y") + 2, F.col("box.w"), F.col("box.h"))
    t = b.where("id = 2").select("page", moved.alias("found"))
    hit = t.join(b.where("id > 2"), "page").where(g.iou(F.col("found"), F.col("box")) > 0.3).groupBy("page").agg(F.min("id").alias("id"))
    return t.select("page").join(hit, "page", "left").select("page", F.coalesce("id", F.lit(-1)).alias("candidate"), F.when(F.col("id").isNull(), "insert").otherwise("update").alias("action"))


@query("""
WITH m AS (SELECT user_id, event_id, event_type, ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS clear FROM events),
s AS (SELECT *, sum(clear) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, count(*) OVER (PARTITION BY user_id) AS n, max(clear) OVER (PARTITION BY user_id) AS ever FROM m),
l AS (SELECT user_id, max(epoch) AS last FROM s GROUP BY user_id)
SELECT s.user_id, max(version) AS version, count(*) FILTER (s.epoch = l.last AND s.clear = 0) AS regions, count(*) FILTER (version > n - 30) AS undo_depth FROM s JOIN l ON s.user_id = l.user_id GROUP BY s.user_id
""")
def mask_edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask edits folded in order: clearing (an error) empties the mask, other edits add a region; thirty can be undone."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    m = table(spark, sf_dir, "events").withColumn("clear", (F.col("event_type") == "error").cast("int"))
    m = m.withColumns({"epoch": F.sum("clear").over(w), "version": F.row_number().over(w).cast("long")})
    per = m.groupBy("user_id", "epoch").agg(F.max("version").alias("version"), F.count_if(F.col("clear") == 0).alias("regions"))
    last = per.groupBy("user_id").agg(F.max("version").alias("version"), F.max_by("regions", "epoch").alias("regions"))
    return last.withColumn("undo_depth", F.least("version", F.lit(30)).cast("long"))


@query("""
WITH r AS (SELECT l_suppkey AS mask, (l_partkey % 12)::INT AS x0, (l_orderkey % 9)::INT AS y0, (l_quantity * 5)::INT AS v FROM lineitem),
p AS (SELECT mask, x0 + dx AS x, y0 + dy AS y, v FROM r, range(3) a(dx), range(2) b(dy)), m AS (SELECT mask, x, y, max(v) AS v FROM p GROUP BY mask, x, y)
SELECT mask, count(*) AS pixels, sum(v)::BIGINT AS total, min(x) AS left_, max(x) AS right_, min(y) AS top, max(y) AS bottom, round(avg(v), 6) AS mean, count(*) FILTER (v >= 128) AS solid FROM m GROUP BY mask
""")
def mask_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft regions laid into masks, the strongest winning at each pixel; and the masks' bounds and coverage."""
    c = F.col
    r = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("mask"), (c("l_partkey") % 12).alias("x0"), (c("l_orderkey") % 9).alias("y0"), (c("l_quantity") * 5).cast("int").alias("v"))
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(3) for dy in range(2)])
    p = r.withColumn("s", F.explode(shifts)).select("mask", (c("x0") + c("s.dx")).alias("x"), (c("y0") + c("s.dy")).alias("y"), "v")
    m = p.groupBy("mask", "x", "y").agg(F.max("v").alias("v"))
    return m.groupBy("mask").agg(
        F.count("*").alias("pixels"), F.sum("v").alias("total"), F.min("x").alias("left_"), F.max("x").alias("right_"), F.min("y").alias("top"), F.max("y").alias("bottom"),
        F.round(F.avg("v"), 6).alias("mean"), F.count_if(c("v") >= 128).alias("solid"),
    )


@query("""
WITH p AS (SELECT l_suppkey, least(1, greatest(0, (l_extendedprice / 1000 - l_quantity) / (60 - l_quantity))) AS alpha FROM lineitem WHERE abs(60 - l_quantity) > 24)
SELECT l_suppkey, count(*) AS pairs, round(list_sort(list(alpha))[count(*) // 2 + 1], 6) AS alpha, round(list_sort(list(alpha))[floor((count(*) - 1) * 0.9::DOUBLE + 0.5)::BIGINT + 1], 6) AS p90 FROM p GROUP BY l_suppkey HAVING count(*) >= 3
""")
def robust_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How opaque a mark is, as the upper median over pairs of pixels that tell it; groups fit in a row."""
    alpha = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("l_extendedprice") / 1000 - F.col("l_quantity")) / (60 - F.col("l_quantity"))))
    p = table(spark, sf_dir, "lineitem").where(F.abs(60 - F.col("l_quantity")) > 24).groupBy("l_suppkey").agg(F.collect_list(alpha).alias("a"))
    return p.where(F.size("a") >= 3).select("l_suppkey", F.size("a").cast("long").alias("pairs"), F.round(upper_median(F.col("a")), 6).alias("alpha"), F.round(nearest_rank(F.col("a"), 0.9), 6).alias("p90"))


@query("""
SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS notes, round(count(*) FILTER (event_type = 'purchase') / count(*)::DOUBLE, 6) AS ratio,
  CASE WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN NULL ELSE round((epoch_ms(max(ts)) - epoch_ms(min(ts))) / 1000.0::DOUBLE / count(*) FILTER (event_type = 'purchase') * (count(*) - count(*) FILTER (event_type = 'purchase')), 3) END AS eta_seconds FROM events GROUP BY user_id
""")
def notes_and_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each note once, the part that is done, and the time that the rest will take at the pace so far."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("notes"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("done"),
        (F.unix_millis(F.max("ts").cast("timestamp")) - F.unix_millis(F.min("ts").cast("timestamp"))).alias("ms"),
    )
    eta = F.try_divide(F.col("ms") / 1000.0, F.col("done")) * (F.col("n") - F.col("done"))
    return e.select("user_id", "notes", F.round(F.col("done") / F.col("n"), 6).alias("ratio"), F.round(eta, 3).alias("eta_seconds"))


@query(f"""
WITH b AS ({BOXES_SQL}) SELECT page, string_agg(id::VARCHAR, ',' ORDER BY floor(y / 16), x, id) AS reading_order FROM b GROUP BY page
""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes by rows of a fixed height, then from the left: an order without the cycles that tolerances make."""
    b = boxes(spark, sf_dir).groupBy("page").agg(F.sort_array(F.collect_list(F.struct(F.floor(F.col("box.y") / 16).alias("r"), F.col("box.x").alias("x"), "id"))).alias("o"))
    return b.select("page", F.array_join(F.transform("o", lambda v: v["id"].cast("string")), ",").alias("reading_order"))


@query(f"""
WITH b AS ({BOXES_SQL}), m AS (SELECT page, x, y, w, h FROM b WHERE id = 1)
SELECT b.page, b.id, CASE WHEN m.page IS NULL THEN 0 ELSE round({OVERLAP_SQL.format(a="b.", b="m.")} / (b.w * b.h), 6) END AS covered,
  CASE WHEN m.page IS NULL OR {OVERLAP_SQL.format(a="b.", b="m.")} = 0 THEN 'ignore' ELSE 'keep' END AS after_edit FROM b LEFT JOIN m ON b.page = m.page WHERE b.id > 1
""")
def covered_by_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that an edited mask (box 1) no longer covers are ignored."""
    b = boxes(spark, sf_dir)
    j = b.where("id > 1").join(b.where("id = 1").select("page", F.col("box").alias("mask")), "page", "left")
    part = F.when(F.col("mask").isNull(), 0.0).otherwise(g.overlap(F.col("box"), F.col("mask")) / g.area(F.col("box")))
    return j.select("page", "id", F.round(part, 6).alias("covered"), F.when(part == 0, "ignore").otherwise("keep").alias("after_edit"))
