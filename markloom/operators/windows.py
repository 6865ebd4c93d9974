"""Windows over pixels and sequences, spread samples, runs; closed-form rasters that SQL can make as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markloom.functions import scalars
from markloom.plans.registry import query, table

TEXTURE_SQL = "SELECT x, y, ((x * 7 + y * 13) % 31) * 4 + 60 AS v, x >= 15 AND x < 45 AND y >= 20 AND y < 30 AS masked FROM range(60) a(x), range(50) b(y)"


def texture(spark: SparkSession) -> DataFrame:
    """A 60 by 50 raster and a mask in it, as rows (x, y, v, masked)."""
    p = spark.range(3000).select((F.col("id") % 60).alias("x"), F.floor(F.col("id") / 60).alias("y"))
    return p.withColumns({"v": (F.col("x") * 7 + F.col("y") * 13) % 31 * 4 + 60, "masked": F.col("x").between(15, 44) & F.col("y").between(20, 29)})


def separable(rows: DataFrame, out: str, by: Column, radius: int) -> DataFrame:
    """One window function along rows, then along columns, cut at the edges. `by` reads the column v."""
    for line, along in (("y", "x"), ("x", "y")):
        w = Window.partitionBy(line).orderBy(along).rowsBetween(-radius, radius)
        rows = rows.withColumn("v", by.over(w))
    return rows.withColumnRenamed("v", out)


@query(f"""
WITH p AS ({TEXTURE_SQL}), a AS (SELECT x, y, sum(v) OVER w AS s, count(*) OVER w AS c FROM p WINDOW w AS (PARTITION BY y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT x, y, round(sum(s) OVER w / (sum(c) OVER w)::DOUBLE, 6) AS mean FROM a WINDOW w AS (PARTITION BY x ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
""")
def box_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of a square of 7, cut at the edges: sums and counts, one direction after the other."""
    w = lambda a, b: Window.partitionBy(a).orderBy(b).rowsBetween(-3, 3)
    a = texture(spark).select("x", "y", F.sum("v").over(w("y", "x")).alias("s"), F.count("*").over(w("y", "x")).alias("c"))
    return a.select("x", "y", F.round(F.sum("s").over(w("x", "y")) / F.sum("c").over(w("x", "y")), 6).alias("mean"))


@query(f"""
WITH p AS ({TEXTURE_SQL}), a AS (SELECT x, y, v, min(v) OVER w AS lo, max(v) OVER w AS hi FROM p WINDOW w AS (PARTITION BY y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
b AS (SELECT x, y, v, min(lo) OVER w AS eroded, max(hi) OVER w AS dilated FROM a WINDOW w AS (PARTITION BY x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT x, y, eroded, dilated, v - eroded AS above FROM b
""")
def sliding_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Erosion and dilation by a square of 5."""
    p = texture(spark).select("x", "y", "v")
    lo = separable(p, "eroded", F.min("v"), 2)
    hi = separable(p, "dilated", F.max("v"), 2)
    return p.join(lo, ["x", "y"]).join(hi, ["x", "y"]).select("x", "y", "eroded", "dilated", (F.col("v") - F.col("eroded")).alias("above"))


@query(f"""
WITH p AS ({TEXTURE_SQL}), n AS (SELECT p.x, p.y, dx, dy, q.v FROM p, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy), ({TEXTURE_SQL}) q WHERE q.x = greatest(0, least(59, p.x + dx)) AND q.y = greatest(0, least(49, p.y + dy)))
SELECT x, y, round(sqrt(pow(sum(v * dx * (2 - abs(dy))) / 8.0::DOUBLE, 2) + pow(sum(v * dy * (2 - abs(dx))) / 8.0::DOUBLE, 2)), 6) AS magnitude FROM n GROUP BY x, y
""")
def sobel_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradients of a 3 by 3 neighbourhood with clamped edges, by lag and lead along rows and columns."""
    p = texture(spark).select("x", "y", F.col("v").cast("double").alias("v"))
    wx, wy = Window.partitionBy("y").orderBy("x"), Window.partitionBy("x").orderBy("y")
    near = lambda c, w: (F.coalesce(F.lag(c).over(w), F.col(c)), F.coalesce(F.lead(c).over(w), F.col(c)))
    left, right = near("v", wx)
    p = p.withColumns({"d": right - left, "s": left + 2 * F.col("v") + right})
    up_d, down_d = near("d", wy)
    up_s, down_s = near("s", wy)
    gx, gy = (up_d + 2 * F.col("d") + down_d) / 8, (down_s - up_s) / 8
    return p.select("x", "y", F.round(F.sqrt(gx * gx + gy * gy), 6).alias("magnitude"))


@query(f"""
WITH p AS ({TEXTURE_SQL}), q AS (SELECT *, x >= 10 AND x < 50 AND y >= 15 AND y < 35 AND NOT masked AS ring, CASE WHEN masked THEN v + 3 WHEN x = 3 THEN v + 2 ELSE v END AS r FROM p)
SELECT sum(v)::BIGINT AS total, count(*) FILTER (masked) AS inside, round(avg(r - v) FILTER (masked), 6) AS shift, count(*) FILTER (NOT masked AND abs(r - v) > 1) AS changed_outside,
  round(least(1, greatest(0.05::DOUBLE, 50 * count(*) FILTER (NOT masked AND abs(r - v) > 1) / (count(*) FILTER (NOT masked))::DOUBLE)), 6) AS outside_severity,
  round(greatest(0, (abs(avg(r) FILTER (masked) - avg(r) FILTER (ring)) - 2 * stddev_pop(r) FILTER (ring) - 6) / 40), 6) AS color_shift FROM q
""")
def quality_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repaired raster against the original: what changed outside the mask, and the shift against a ring around it."""
    p = texture(spark)
    ring = F.col("x").between(10, 49) & F.col("y").between(15, 34) & ~F.col("masked")
    q = p.withColumns({"ring": ring, "r": F.when(F.col("masked"), F.col("v") + 3).when(F.col("x") == 3, F.col("v") + 2).otherwise(F.col("v"))})
    inside, outside = F.col("masked"), ~F.col("masked")
    of = lambda cond, v: F.when(cond, v)
    a = q.agg(
        F.sum("v").alias("total"), F.count_if(inside).alias("inside"), F.avg(of(inside, F.col("r") - F.col("v"))).alias("shift"), F.count_if(outside & (F.abs(F.col("r") - F.col("v")) > 1)).alias("changed_outside"),
        F.count_if(outside).alias("outside"), F.avg(of(inside, F.col("r"))).alias("in_mean"), F.avg(of(F.col("ring"), F.col("r"))).alias("ring_mean"), F.stddev_pop(of(F.col("ring"), F.col("r"))).alias("ring_sd"),
    )
    severity = F.least(F.lit(1.0), F.greatest(F.lit(0.05), 50 * F.col("changed_outside") / F.col("outside")))
    shift = F.greatest(F.lit(0.0), (F.abs(F.col("in_mean") - F.col("ring_mean")) - 2 * F.col("ring_sd") - 6) / 40)
    return a.select("total", "inside", F.round("shift", 6).alias("shift"), "changed_outside", F.round(severity, 6).alias("outside_severity"), F.round(shift, 6).alias("color_shift"))


@query("""
WITH o AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM o)
SELECT user_id, run::BIGINT AS run, min(event_type) AS event_type, count(*) AS length FROM r GROUP BY user_id, run HAVING count(*) >= 2
""")
def gaps_and_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal labels of two or more, as rows of glyphs or repeated symbols are found."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    o = table(spark, sf_dir, "events").withColumn("new", (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))).cast("int"))
    r = o.withColumn("run", F.sum("new").over(w))
    return r.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("length")).where("length >= 2")


@query("""
WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN '' WHEN 'view' THEN 'a' WHEN 'click' THEN 'b' WHEN 'purchase' THEN 'c' ELSE 'd' END AS symbol, value, ts FROM events),
o AS (SELECT *, lag(symbol) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s)
SELECT user_id, coalesce(string_agg(symbol, '' ORDER BY ts, event_id) FILTER (symbol <> '' AND (before IS NULL OR before <> symbol)), '') AS decoded, round(avg(value) FILTER (symbol <> '' AND (before IS NULL OR before <> symbol)), 5) AS score FROM o GROUP BY user_id
""")
def greedy_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best symbol of each step, repeats collapsed, blanks dropped: how recognised text lines are read."""
    t = F.col("event_type")
    symbol = F.when(t == "signup", "").when(t == "view", "a").when(t == "click", "b").when(t == "purchase", "c").otherwise("d")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    o = table(spark, sf_dir, "events").withColumn("symbol", symbol).withColumn("before", F.lag("symbol").over(w))
    kept = (F.col("symbol") != "") & (F.col("before").isNull() | (F.col("before") != F.col("symbol")))
    steps = F.sort_array(F.collect_list(F.when(kept, F.struct("ts", "event_id", "symbol"))))
    r = o.groupBy("user_id").agg(steps.alias("steps"), F.round(F.avg(F.when(kept, F.col("value"))), 5).alias("score"))
    return r.select("user_id", F.array_join(F.transform("steps", lambda x: x["symbol"]), "").alias("decoded"), "score")


def spread_places(n: Column, count: Column) -> Column:
    """0-based places spread evenly over n rows, ends included; the middle one if one is asked for."""
    step = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.floor(i * (n - 1) / F.greatest(count - 1, F.lit(1)) + 0.5))
    return F.when(count >= n, F.sequence(F.lit(0).cast("long"), n - 1)).when(count == 1, F.array(F.floor(n / 2))).otherwise(F.array_distinct(step))


@query("""
WITH p AS (SELECT p_partkey, p_size AS w, p_retailprice / 50 AS h, printf('ar%+d', round(log2(p_size / (p_retailprice / 50)) / 0.25)::INT) AS key FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p_partkey) - 1 AS k, count(*) OVER (PARTITION BY key) AS n FROM p),
c AS (SELECT *, CASE WHEN n <= 10 THEN n WHEN n <= 100 THEN 10 WHEN n <= 500 THEN 20 ELSE 30 END AS want FROM r)
SELECT key, p_partkey FROM c WHERE want >= n OR list_contains(list_transform(range(want), lambda i: floor(i * (n - 1) / (want - 1)::DOUBLE + 0.5)::BIGINT), k)
""")
def aspect_group_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files grouped by aspect ratio, and a sample spread over each group in import order."""
    w, h = F.col("p_size").cast("double"), F.col("p_retailprice") / 50
    p = table(spark, sf_dir, "part").select("p_partkey", scalars.aspect_key(w, h).alias("key"))
    group = Window.partitionBy("key")
    r = p.select("key", "p_partkey", (F.row_number().over(group.orderBy("p_partkey")) - 1).cast("long").alias("k"), F.count("*").over(group).alias("n"))
    return r.where(F.array_contains(spread_places(F.col("n"), scalars.sample_count(F.col("n")).cast("long")), F.col("k"))).select("key", "p_partkey")


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_suppkey, l_partkey) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, k FROM r WHERE k <= 4
""")
def top_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best regions of each image; Spark keeps four a group before the shuffle."""
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_suppkey", "l_partkey")
    r = table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w)).where("k <= 4")
    return r.select("l_orderkey", "l_linenumber", F.col("k").cast("long").alias("k"))
