"""Order statistics, thresholds, correlations and regressions with the semantics that marks are measured by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markloom.plans.registry import query, table


def upper_median(values: Column) -> Column:
    """Of an even number of values the greater of the middle two; 0 of none. For groups that fit in a row."""
    return F.coalesce(F.try_element_at(F.sort_array(values), (F.floor(F.size(values) / 2) + 1).cast("int")), F.lit(0.0))


def nearest_rank(values: Column, q: float) -> Column:
    """The value at the rounded place (n - 1) q."""
    at = (F.floor((F.size(values) - 1) * F.lit(q) + 0.5) + 1).cast("int")
    return F.coalesce(F.try_element_at(F.sort_array(values), at), F.lit(0.0))


def order_statistics(rows: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """Values at 0-based places of each group's order, by counting equal values and a running sum of the counts.

    Groups of any size: what is ordered are distinct values with their counts, combined before the shuffle. `places`
    maps names to columns of `n`, the group's number of rows."""
    counts = rows.groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    group = Window.partitionBy(*by)
    upto = counts.select(*by, "v", "c", F.sum("c").over(group.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("c").over(group).alias("n"))
    pick = lambda at: F.min(F.when((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at), F.col("v")))
    return upto.groupBy(*by).agg(F.max("n").alias("n"), *[pick(at).alias(name) for name, at in places.items()])


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS mid,
  list_sort(list(l_extendedprice))[floor((count(*) - 1) * 0.05::DOUBLE + 0.5)::BIGINT + 1] AS p05, list_sort(list(l_extendedprice))[floor((count(*) - 1) * 0.95::DOUBLE + 0.5)::BIGINT + 1] AS p95
FROM lineitem GROUP BY 1, 2
""")
def upper_median_and_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median and the nearest ranks of 5 and 95 % of groups too large for a row."""
    n = F.col("n")
    rank = lambda q: F.floor((n - 1) * F.lit(q) + 0.5)
    return order_statistics(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"mid": F.floor(n / 2), "p05": rank(0.05), "p95": rank(0.95)})


def otsu(rows: DataFrame, by: list[str], value: str, bins: int = 256) -> DataFrame:
    """The threshold between two classes of values that separates their means most; a constant gives itself.

    Values fall into bins between a group's extremes; running sums over at most `bins` rows give every threshold."""
    ends = rows.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    wide = F.col("hi") - F.col("lo")
    bin_ = F.least(F.floor((F.col(value) - F.col("lo")) / F.when(wide > 0, wide).otherwise(1.0) * bins), F.lit(bins - 1)).cast("int")
    hist = rows.join(F.broadcast(ends) if not by else ends, by) if by else rows.crossJoin(F.broadcast(ends))
    hist = hist.groupBy(*by, "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    s = hist.select(
        *by, "lo", "hi", "bin", F.sum("c").over(upto).alias("w0"), F.sum(F.col("bin") * F.col("c")).over(upto).alias("s0"), F.sum("c").over(w).alias("n"), F.sum(F.col("bin") * F.col("c")).over(w).alias("s")
    )
    gap = F.col("s0") / F.col("w0") - F.try_divide(F.col("s") - F.col("s0"), F.col("n") - F.col("w0"))
    between = F.col("w0").cast("double") * (F.col("n") - F.col("w0")) * gap * gap
    best = F.max_by("bin", F.struct(F.coalesce(F.round(between, 3), F.lit(-1.0)), -F.col("bin")))
    at = F.col("lo") + (F.col("best") + 1) * (F.col("hi") - F.col("lo")) / bins
    return s.groupBy(*by, "lo", "hi").agg(best.alias("best")).select(*by, F.when(F.col("hi") > F.col("lo"), at).otherwise(F.col("hi")).alias("threshold"))


@query("""
WITH v AS (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings), e AS (SELECT label, min(x) AS lo, max(x) AS hi FROM v GROUP BY label),
h AS (SELECT v.label, lo, hi, least(floor((x - lo) / (hi - lo) * 256), 255)::INT AS bin, count(*) AS c FROM v JOIN e ON v.label = e.label GROUP BY ALL),
s AS (SELECT *, sum(c) OVER (PARTITION BY label ORDER BY bin) AS w0, sum(bin * c) OVER (PARTITION BY label ORDER BY bin) AS s0, sum(c) OVER (PARTITION BY label) AS n, sum(bin * c) OVER (PARTITION BY label) AS t FROM h),
b AS (SELECT label, lo, hi, bin, CASE WHEN n = w0 THEN -1 ELSE round(w0::DOUBLE * (n - w0)::DOUBLE * pow(s0::DOUBLE / w0::DOUBLE - (t - s0)::DOUBLE / (n - w0)::DOUBLE, 2), 3) END AS between_ FROM s)
SELECT label, round(lo + (arg_max(bin, (between_, -bin)) + 1) * (hi - lo) / 256, 6) AS threshold FROM b GROUP BY label, lo, hi
""")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    return otsu(v, ["label"], "x").select("label", F.round("threshold", 6).alias("threshold"))


def ncc(a: Column | str, b: Column | str) -> Column:
    """Normalised cross correlation of two columns; 0 where either is constant."""
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))


@query("""
WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
u AS (SELECT a, b, unnest(x)::DOUBLE AS x, unnest(y)::DOUBLE AS y FROM p)
SELECT a, b, round(coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0), 6) AS ncc FROM u GROUP BY a, b
""")
def ncc_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the next, joined by key; elements are zipped in the row and never shuffled alone."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    p = e.withColumnRenamed("vec_id", "a").join(e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("other")), "a")
    d = p.select("a", "b", F.col("embedding").cast("array<double>").alias("x"), F.col("other").cast("array<double>").alias("y"), F.size("embedding").alias("n"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    m = d.withColumns({"mx": total(F.col("x")) / F.col("n"), "my": total(F.col("y")) / F.col("n")})
    dx, dy = F.transform("x", lambda v: v - F.col("mx")), F.transform("y", lambda v: v - F.col("my"))
    dot = lambda a, b: total(F.zip_with(a, b, lambda u, v: u * v))
    value = F.coalesce(F.try_divide(dot(dx, dy), F.sqrt(dot(dx, dx) * dot(dy, dy))), F.lit(0.0))
    return m.select("a", "b", F.round(value, 6).alias("ncc"))


@query("""
WITH u AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
g AS (SELECT a.vec_id, a.v AS gx, b.v AS gy FROM u a JOIN u b ON a.vec_id = b.vec_id AND b.i = a.i + 1 AND a.i % 2 = 1),
h AS (SELECT vec_id, (floor((atan2(gy, gx) + pi()) / (2 * pi()) * 16)::INT % 16) AS bin, sum(sqrt(gx * gx + gy * gy)) AS m FROM g WHERE sqrt(gx * gx + gy * gy) >= 0.1 GROUP BY 1, 2)
SELECT vec_id, bin, round(m / sqrt(sum(m * m) OVER (PARTITION BY vec_id)), 6) AS weight FROM h
""")
def orientation_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen directions of gradients (pairs of elements), weighted by magnitude, of unit length by vector."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(F.col("embedding")[k * 2].cast("double").alias("gx"), F.col("embedding")[k * 2 + 1].cast("double").alias("gy")))
    g = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(pairs).alias("g")).select("vec_id", "g.gx", "g.gy")
    m = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    bin_ = (F.floor((F.atan2("gy", "gx") + F.pi()) / (2 * F.pi()) * 16) % 16).cast("int")
    h = g.where(m >= 0.1).groupBy("vec_id", bin_.alias("bin")).agg(F.sum(m).alias("m"))
    return h.select("vec_id", "bin", F.round(F.col("m") / F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("vec_id"))), 6).alias("weight"))


@query("""
SELECT l_suppkey, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept,
       round(least(1, greatest(0, 1 - regr_slope(l_extendedprice, l_quantity) / 2000)), 4) AS alpha FROM lineitem GROUP BY l_suppkey HAVING regr_sxx(l_extendedprice, l_quantity) >= 200
""")
def regression_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares by pixel (a supplier is one): slope and intercept over the samples, if they vary enough."""
    y, x = "l_extendedprice", "l_quantity"
    r = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"))
    alpha = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("slope") / 2000))
    return r.where("sxx >= 200").select("l_suppkey", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round(alpha, 4).alias("alpha"))


@query("""
WITH s AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'batch' WHEN 'view' THEN 'overlay' WHEN 'click' THEN 'repeated' WHEN 'purchase' THEN 'text_ocr' ELSE 'info_stamp' END AS source, value FROM events),
c AS (SELECT user_id, source, max(least(1, greatest(0, value / 500 * CASE source WHEN 'text_ocr' THEN 0.9::DOUBLE ELSE 1 END))) AS s FROM s GROUP BY 1, 2),
o AS (SELECT *, source IN ('overlay', 'repeated', 'info_stamp') AS h, row_number() OVER w AS k, bool_and(source IN ('overlay', 'repeated', 'info_stamp')) OVER w AS all_h FROM c WINDOW w AS (PARTITION BY user_id ORDER BY s DESC, source)),
f AS (SELECT user_id, count(*) AS sources, bool_and(h) AS only_h, exp(sum(CASE WHEN k = 1 THEN ln(greatest(1e-300::DOUBLE, 1 - s)) ELSE ln(1 - s * CASE WHEN all_h THEN 0.15::DOUBLE ELSE 0.6::DOUBLE END) END)) AS miss FROM o GROUP BY user_id)
SELECT user_id, sources, round(least(0.99::DOUBLE, CASE WHEN only_h THEN least(0.9::DOUBLE, 1 - miss) ELSE 1 - miss END), 5) AS confidence FROM f
""")
def combined_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of detectors fused: the best counts whole, each further one closes part of the gap that is left, a small
    part as long as all so far are heuristics. An ordered fold over a handful of sources a candidate."""
    from markloom.functions import rules

    t = F.col("event_type")
    source = F.when(t == "signup", "batch").when(t == "view", "overlay").when(t == "click", "repeated").when(t == "purchase", "text_ocr").otherwise("info_stamp")
    s = table(spark, sf_dir, "events").select("user_id", source.alias("source"), "value")
    calibrated = F.col("value") / 500 * F.when(F.col("source") == "text_ocr", rules.CALIBRATION["text_ocr"]).otherwise(1.0)
    c = s.groupBy("user_id", "source").agg(F.max(F.least(F.lit(1.0), F.greatest(F.lit(0.0), calibrated))).alias("s"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("key"), "source", "s")))
    heuristic = lambda x: x.isin(*rules.HEURISTIC)
    start = F.struct(F.lit(0.0).alias("p"), F.lit(True).alias("only"), F.lit(True).alias("first"))

    def step(acc: Column, x: Column) -> Column:
        only = acc["only"] & heuristic(x["source"])
        weight = F.when(acc["first"], 1.0).when(only, rules.CORRELATED_WEIGHT).otherwise(rules.OTHER_WEIGHT)
        return F.struct((acc["p"] + (1 - acc["p"]) * x["s"] * weight).alias("p"), only.alias("only"), F.lit(False).alias("first"))

    def finish(acc: Column) -> Column:
        return F.least(F.lit(rules.CONFIDENCE_CAP), F.when(acc["only"], F.least(F.lit(rules.HEURISTIC_CAP), acc["p"])).otherwise(acc["p"]))

    r = c.groupBy("user_id").agg(F.count("*").alias("sources"), ordered.alias("scores"))
    return r.select("user_id", "sources", F.round(F.aggregate("scores", start, step, finish), 5).alias("confidence"))


@query("""
WITH i AS (SELECT l_orderkey AS file_id, CASE l_linenumber WHEN 1 THEN 'residual' WHEN 2 THEN 'blur' WHEN 3 THEN 'color_shift' WHEN 4 THEN 'edge_artifact' WHEN 5 THEN 'outside_change' ELSE 'structure' END AS kind, l_discount * 10 AS severity FROM lineitem),
w AS (SELECT *, CASE kind WHEN 'residual' THEN 0.6::DOUBLE WHEN 'blur' THEN 0.3 WHEN 'color_shift' THEN 0.4 WHEN 'edge_artifact' THEN 0.3 ELSE 1 END AS weight FROM i)
SELECT file_id, round(greatest(0, 1 - sum(severity * weight)), 6) AS score, NOT bool_or(kind IN ('outside_change', 'structure')) AND round(greatest(0, 1 - sum(severity * weight)), 6) >= 0.6 AS passed, count(*) AS issues FROM w GROUP BY file_id
""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result's score from its weighted issues; some kinds fail it outright."""
    from markloom.functions import rules

    kinds = F.array(*map(F.lit, rules.ISSUE_WEIGHTS))
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.element_at(kinds, F.least(F.col("l_linenumber"), F.lit(6))).alias("kind"), (F.col("l_discount") * 10).alias("severity"))
    i = i.withColumn("kind", F.when(F.col("kind") == "outside_change", "outside_change").otherwise(F.col("kind")))
    score = F.round(F.greatest(F.lit(0.0), 1 - F.sum(F.col("severity") * rules.issue_weight(F.col("kind")))), 6)
    r = i.groupBy("file_id").agg(score.alias("score"), F.bool_or(F.col("kind").isin(*rules.BLOCKING_ISSUES)).alias("blocked"), F.count("*").alias("issues"))
    return r.select("file_id", "score", (~F.col("blocked") & (F.col("score") >= 0.6)).alias("passed"), "issues")


@query("""
WITH c AS (SELECT l_orderkey, l_suppkey % 4 AS cluster, min(l_quantity / 50) AS score, bool_and(l_discount < 0.1) AS passed, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS issues FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, min(score) AS score, bool_and(passed) AS passed, string_agg(issues, ';' ORDER BY cluster) AS issues FROM c GROUP BY l_orderkey
""")
def cluster_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file is as good as its worst repaired cluster, and lists the issues of all."""
    joined = lambda c, sep: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["t"]), sep)
    line = F.struct("l_linenumber", F.col("l_linenumber").cast("string").alias("t"))
    c = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 4).alias("cluster")).agg(F.min(F.col("l_quantity") / 50).alias("score"), F.bool_and(F.col("l_discount") < 0.1).alias("passed"), joined(line, ",").alias("t"))
    return c.groupBy("l_orderkey").agg(F.min("score").alias("score"), F.bool_and("passed").alias("passed"), joined(F.struct("cluster", "t"), ";").alias("issues"))


@query("""
WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0.1::FLOAT) AS a, list_transform(embedding, lambda x: x > 0.05::FLOAT OR x < (-0.2)::FLOAT) AS b FROM embeddings),
n AS (SELECT vec_id, len(list_filter(list_zip(a, b), lambda t: t[1] AND t[2])) AS both_, len(list_filter(list_zip(a, b), lambda t: t[1] OR t[2])) AS any_, len(list_filter(a, lambda t: t)) + len(list_filter(b, lambda t: t)) AS total FROM m)
SELECT vec_id, round(CASE WHEN any_ = 0 THEN 1 ELSE both_ / any_::DOUBLE END, 6) AS iou, round(CASE WHEN total = 0 THEN 1 ELSE 2 * both_ / total::DOUBLE END, 6) AS dice FROM n
""")
def mask_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of two masks over the same pixels; two empty ones agree."""
    e = table(spark, sf_dir, "embeddings")
    a, b = F.transform("embedding", lambda x: x > F.lit(0.1).cast("float")), F.transform("embedding", lambda x: (x > F.lit(0.05).cast("float")) | (x < F.lit(-0.2).cast("float")))
    n = lambda c: F.size(F.filter(c, lambda t: t))
    m = e.select("vec_id", n(F.zip_with(a, b, lambda x, y: x & y)).alias("both"), n(F.zip_with(a, b, lambda x, y: x | y)).alias("any"), (n(a) + n(b)).alias("total"))
    part = lambda x, y: F.round(F.coalesce(F.try_divide(x, y), F.lit(1.0)), 6)
    return m.select("vec_id", part(F.col("both"), F.col("any")).alias("iou"), part(2 * F.col("both"), F.col("total")).alias("dice"))


#: Added before rounding, so that exact ties don't depend on the order of sums.
NUDGE = 1e-7


@query("""
SELECT l_orderkey, count(*) AS n, round(var_pop(l_quantity) + 1e-7::DOUBLE, 4) AS xx, round(covar_pop(l_quantity, l_extendedprice / 1000) + 1e-7::DOUBLE, 4) AS xy,
  round(var_pop(l_extendedprice / 1000) + 1e-7::DOUBLE, 4) AS yy, round(degrees(0.5::DOUBLE * atan2(2 * covar_pop(l_quantity, l_extendedprice / 1000), var_pop(l_quantity) - var_pop(l_extendedprice / 1000))) + 1e-7::DOUBLE, 3) AS angle
FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3
""")
def line_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances of glyph centres and the angle of the line they lie on."""
    x, y = F.col("l_quantity"), F.col("l_extendedprice") / 1000
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.var_pop(x).alias("xx"), F.covar_pop(x, y).alias("xy"), F.var_pop(y).alias("yy"))
    angle = F.degrees(0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")))
    return r.where("n >= 3").select("l_orderkey", "n", *[F.round(F.col(c) + NUDGE, 4).alias(c) for c in ("xx", "xy", "yy")], F.round(angle + NUDGE, 3).alias("angle"))
