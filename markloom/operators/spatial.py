"""Joins of boxes: overlap, greedy fusion, absorption, intervals, predictions against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.functions import geometry as g
from markloom.plans.registry import query, table

#: Boxes: a line of an order is one, on the page that its order is.
BOXES_SQL = """SELECT page, id, b.x AS x, b.y AS y, b.w AS w, b.h AS h FROM (SELECT l_orderkey AS page, l_linenumber AS id,
  min({'x': (l_partkey % 100)::DOUBLE, 'y': (l_suppkey % 100)::DOUBLE, 'w': 20 + l_quantity, 'h': 10 + l_quantity / 2}) AS b FROM lineitem GROUP BY 1, 2)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    b = g.box(c("l_partkey") % 100, c("l_suppkey") % 100, 20 + c("l_quantity"), 10 + c("l_quantity") / 2)
    return table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("page"), c("l_linenumber").alias("id")).agg(F.min(b).alias("box"))


OVERLAP_SQL = "greatest(0, least({a}x + {a}w, {b}x + {b}w) - greatest({a}x, {b}x)) * greatest(0, least({a}y + {a}h, {b}y + {b}h) - greatest({a}y, {b}y))"


@query(f"""
WITH b AS ({BOXES_SQL}), p AS (SELECT a.page, a.id AS a, b.id AS b, {OVERLAP_SQL.format(a="a.", b="b.")} AS o, a.w * a.h AS sa, b.w * b.h AS sb FROM b a JOIN b ON a.page = b.page AND a.id < b.id)
SELECT page, a, b, round(o / (sa + sb - o), 6) AS iou, round(o / least(sa, sb), 6) AS containment FROM p WHERE o / (sa + sb - o) >= 0.3 OR o / least(sa, sb) >= 0.7
""")
def iou_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of one page that overlap: an equi join by page, the overlap as its filter."""
    b = boxes(spark, sf_dir)
    p = b.select("page", F.col("id").alias("a"), F.col("box").alias("one")).join(b.select("page", F.col("id").alias("b"), F.col("box").alias("two")), "page").where("a < b")
    one, two = F.col("one"), F.col("two")
    p = p.withColumns({"iou": g.iou(one, two), "containment": g.containment(one, two)}).where("iou >= 0.3 OR containment >= 0.7")
    return p.select("page", "a", "b", F.round("iou", 6).alias("iou"), F.round("containment", 6).alias("containment"))


def fuse_greedily(boxes_of_page: Column) -> Column:
    """Clusters of an ordered array of (id, box): each box joins the first cluster it overlaps enough, whose box grows."""
    kind = "array<struct<ids: array<int>, box: struct<x: double, y: double, w: double, h: double>>>"

    def step(clusters: Column, item: Column) -> Column:
        def near(c: Column) -> Column:
            small, large = F.least(g.area(c["box"]), g.area(item["box"])), F.greatest(g.area(c["box"]), g.area(item["box"]))
            return (g.iou(c["box"], item["box"]) >= 0.3) | ((g.containment(c["box"], item["box"]) >= 0.7) & (small >= 0.25 * large))

        at = F.array_position(F.transform(clusters, near), F.lit(True))
        grown = F.transform(
            clusters,
            lambda c, i: F.when(i + 1 == at, F.struct(F.concat(c["ids"], F.array(item["id"])).alias("ids"), g.union(c["box"], item["box"]).alias("box"))).otherwise(c),
        )
        return F.when(at > 0, grown).otherwise(F.concat(clusters, F.array(F.struct(F.array(item["id"]).alias("ids"), item["box"].alias("box")))))

    return F.aggregate(boxes_of_page, F.expr(f"cast(array() as {kind})"), step)


@query(f"""
WITH RECURSIVE b AS (SELECT * FROM ({BOXES_SQL})), n AS (SELECT page, max(id) AS n FROM b GROUP BY page),
f AS (SELECT page, 0 AS k, []::STRUCT(ids INT[], x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[] AS c FROM n
  UNION ALL
  SELECT f.page, k + 1, CASE WHEN b.id IS NULL THEN c ELSE (
    SELECT CASE WHEN hit IS NULL THEN list_append(c, {{'ids': [b.id], 'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h}}) ELSE list_transform(c, lambda q, i: CASE WHEN i = hit THEN
      {{'ids': list_append(q.ids, b.id), 'x': least(q.x, b.x), 'y': least(q.y, b.y), 'w': greatest(q.x + q.w, b.x + b.w) - least(q.x, b.x), 'h': greatest(q.y + q.h, b.y + b.h) - least(q.y, b.y)}} ELSE q END) END
    FROM (SELECT list_position(list_transform(c, lambda q: ({OVERLAP_SQL.format(a="q.", b="b.")}) / (q.w * q.h + b.w * b.h - {OVERLAP_SQL.format(a="q.", b="b.")}) >= 0.3
      OR (({OVERLAP_SQL.format(a="q.", b="b.")}) / least(q.w * q.h, b.w * b.h) >= 0.7 AND least(q.w * q.h, b.w * b.h) >= 0.25 * greatest(q.w * q.h, b.w * b.h))), true) AS hit0, nullif(hit0, 0) AS hit)) END
  FROM f JOIN n ON f.page = n.page AND f.k < n.n LEFT JOIN b ON b.page = f.page AND b.id = f.k + 1),
last AS (SELECT f.page, unnest(c) AS q FROM f JOIN n ON f.page = n.page AND f.k = n.n)
SELECT page, array_to_string(q.ids, ',') AS ids, q.x AS x, q.y AS y, round(q.w, 6) AS w, round(q.h, 6) AS h FROM last
""")
def greedy_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of a page fused in their order: a fold over the page's array, inside generated code."""
    b = boxes(spark, sf_dir)
    p = b.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("id", "box"))).alias("boxes"))
    c = p.select("page", F.explode(fuse_greedily(F.col("boxes"))).alias("c"))
    return c.select("page", F.array_join(F.col("c.ids").cast("array<string>"), ",").alias("ids"), "c.box.x", "c.box.y", F.round("c.box.w", 6).alias("w"), F.round("c.box.h", 6).alias("h"))


@query(f"""
WITH b AS ({BOXES_SQL}), s AS (SELECT * FROM b WHERE id = 1), o AS (SELECT * FROM b WHERE id > 1),
hit AS (SELECT o.page, o.id, s.id AS stamp FROM o JOIN s ON o.page = s.page WHERE o.w * o.h < s.w * s.h AND {OVERLAP_SQL.format(a="o.", b="s.")} / (o.w * o.h) >= 0.6)
SELECT b.page, b.id, (SELECT count(*) FROM hit h WHERE h.page = b.page AND h.stamp = b.id) AS absorbed FROM b WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.page = b.page AND h.id = b.id)
""")
def stamp_absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smaller boxes that lie mostly in a page's stamp (box 1) are dropped; the stamp counts them."""
    b = boxes(spark, sf_dir)
    s = b.where("id = 1").select("page", F.col("box").alias("stamp"))
    j = b.join(s, "page", "left").withColumn("inside", F.coalesce((F.col("id") > 1) & (g.area(F.col("box")) < g.area(F.col("stamp"))) & (g.containment(F.col("box"), F.col("stamp")) >= 0.6), F.lit(False)))
    count = j.where("inside").groupBy("page").agg(F.count("*").alias("absorbed"))
    left = j.where("not inside").select("page", "id").join(count, "page", "left")
    return left.select("page", "id", F.when(F.col("id") == 1, F.coalesce("absorbed", F.lit(0))).otherwise(0).cast("long").alias("absorbed"))


@query(f"""
WITH b AS ({BOXES_SQL}) SELECT page, id, round(w * h, 6) AS area, greatest(0, floor(x - 2))::INT AS px, least(160, ceil(x + w + 2))::INT - greatest(0, floor(x - 2))::INT AS pw,
  (CASE WHEN (y + h / 2) / 160 < 1/3::DOUBLE THEN 0 WHEN (y + h / 2) / 160 > 2/3::DOUBLE THEN 2 ELSE 1 END) * 3 + (CASE WHEN (x + w / 2) / 160 < 1/3::DOUBLE THEN 0 WHEN (x + w / 2) / 160 > 2/3::DOUBLE THEN 2 ELSE 1 END) AS place,
  ['top_left', 'top', 'top_right', 'left', 'center', 'right', 'bottom_left', 'bottom', 'bottom_right'][place + 1] AS anchor FROM b
""")
def box_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, padded pixel rectangle and anchor of each box on a page of 160 by 160."""
    b = boxes(spark, sf_dir)
    side = F.lit(160)
    r = g.to_pixel_rect(g.expand(F.col("box"), F.lit(2.0)), side, side)
    cx, cy = (F.col("box.x") + F.col("box.w") / 2) / 160, (F.col("box.y") + F.col("box.h") / 2) / 160
    return b.select("page", "id", F.round(g.area(F.col("box")), 6).alias("area"), r["x"].alias("px"), r["w"].alias("pw"), (g.third(cy) * 3 + g.third(cx)).alias("place"), g.anchor(cx, cy).alias("anchor"))


@query("""
WITH r AS (SELECT o_orderkey, l_linenumber AS range_id, l_quantity::INT AS start_, l_quantity::INT + 10 AS end_ FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber <= 2),
e AS (SELECT l_orderkey, l_linenumber, (l_partkey % 60)::INT AS op FROM lineitem)
SELECT e.l_orderkey AS page, e.l_linenumber AS object, r.range_id FROM e JOIN r ON e.l_orderkey = r.o_orderkey AND op >= start_ AND op < end_
""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page objects whose operation lies in a marked range of the same page."""
    items = table(spark, sf_dir, "lineitem")
    r = items.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("range_id"), F.col("l_quantity").cast("int").alias("start"))
    e = items.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("object"), (F.col("l_partkey") % 60).cast("int").alias("op"))
    return e.join(r, "page").where("op >= start AND op < start + 10").select("page", "object", "range_id")


@query(f"""
WITH b AS ({BOXES_SQL}), pred AS (SELECT *, w / 70 AS confidence FROM b WHERE id <> 1), truth AS (SELECT page, x, y, w, h FROM b WHERE id = 1 AND page % 3 <> 0),
j AS (SELECT p.page, p.id, confidence >= 0.85 AS auto, t.page IS NOT NULL AS has_truth, t.page IS NOT NULL AND coalesce({OVERLAP_SQL.format(a="p.", b="t.")} / (p.w * p.h + t.w * t.h - {OVERLAP_SQL.format(a="p.", b="t.")}) > 0.2
  OR {OVERLAP_SQL.format(a="p.", b="t.")} / least(p.w * p.h, t.w * t.h) > 0.6, false) AS hit FROM pred p LEFT JOIN truth t ON p.page = t.page),
f AS (SELECT page, bool_or(has_truth) AS has_truth, bool_or(auto AND hit) AS auto_hit, bool_or(hit) AS any_hit, count(*) FILTER (auto AND NOT hit) AS false_auto, bool_or(auto) AS any_auto FROM j GROUP BY page),
s AS (SELECT count(*) FILTER (has_truth) AS positives, count(*) FILTER (auto_hit) AS tp, count(*) FILTER (has_truth AND any_hit) AS found, sum(false_auto) AS fp, count(*) FILTER (NOT has_truth) AS negatives, count(*) FILTER (NOT has_truth AND any_auto) AS alarms FROM f)
SELECT positives, negatives, round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp)::DOUBLE END, 6) AS auto_precision, round(CASE WHEN positives = 0 THEN 1 ELSE tp / positives::DOUBLE END, 6) AS auto_recall,
  round(CASE WHEN positives = 0 THEN 1 ELSE found / positives::DOUBLE END, 6) AS candidate_recall, round(CASE WHEN negatives = 0 THEN 0 ELSE alarms / negatives::DOUBLE END, 6) AS false_alarm_rate FROM s
""")
def eval_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted boxes against one true box a file: every unmatched automatic box is a false positive, recall counts files."""
    b = boxes(spark, sf_dir)
    pred = b.where("id <> 1").withColumn("confidence", F.col("box.w") / 70)
    truth = b.where("id = 1 AND page % 3 <> 0").select("page", F.col("box").alias("true_box"))
    j = pred.join(truth, "page", "left")
    hit = F.coalesce((g.iou(F.col("box"), F.col("true_box")) > 0.2) | (g.containment(F.col("box"), F.col("true_box")) > 0.6), F.lit(False)) & F.col("true_box").isNotNull()
    j = j.select("page", (F.col("confidence") >= 0.85).alias("auto"), F.col("true_box").isNotNull().alias("has_truth"), hit.alias("hit"))
    f = j.groupBy("page").agg(
        F.bool_or("has_truth").alias("has_truth"), F.bool_or(F.col("auto") & F.col("hit")).alias("auto_hit"), F.bool_or("hit").alias("any_hit"), F.count_if(F.col("auto") & ~F.col("hit")).alias("false_auto"), F.bool_or("auto").alias("any_auto")
    )
    s = f.agg(
        F.count_if("has_truth").alias("positives"), F.count_if(~F.col("has_truth")).alias("negatives"), F.count_if("auto_hit").alias("tp"), F.count_if(F.col("has_truth") & F.col("any_hit")).alias("found"),
        F.sum("false_auto").alias("fp"), F.count_if(~F.col("has_truth") & F.col("any_auto")).alias("alarms"),
    )
    rate = lambda a, n, empty: F.round(F.coalesce(F.try_divide(a, n), F.lit(empty)), 6)
    c = F.col
    return s.select(
        "positives", "negatives", rate(c("tp"), c("tp") + c("fp"), 1.0).alias("auto_precision"), rate(c("tp"), c("positives"), 1.0).alias("auto_recall"),
        rate(c("found"), c("positives"), 1.0).alias("candidate_recall"), rate(c("alarms"), c("negatives"), 0.0).alias("false_alarm_rate"),
    )
