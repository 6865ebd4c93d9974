"""Decisions over candidate rows: thresholds, routes, states, review, settings. The driver's tables stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.functions import rules, scalars
from markloom.plans.registry import query, table

#: Candidates: a line item is one; confidence, decision and the user's action follow from its numbers.
CANDIDATES_SQL = """
  SELECT l_orderkey AS file_id, l_linenumber AS candidate, l_quantity / 50 AS confidence,
         CASE l_returnflag WHEN 'A' THEN 'approve' WHEN 'R' THEN 'reject' ELSE 'pending' END AS user_action,
         CASE WHEN l_quantity / 50 >= 0.85 THEN 'auto' WHEN l_quantity / 50 >= 0.7 THEN 'review' ELSE 'ignore' END AS decision
  FROM lineitem
"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file_id"),
        F.col("l_linenumber").alias("candidate"),
        (F.col("l_quantity") / 50).alias("confidence"),
        F.when(F.col("l_returnflag") == "A", "approve").when(F.col("l_returnflag") == "R", "reject").otherwise("pending").alias("user_action"),
    )
    return rows.withColumn("decision", rules.decide(F.col("confidence"), *rules.THRESHOLDS["standard"]))


@query("""
WITH modes(mode, auto, review) AS (VALUES ('conservative', 0.95::DOUBLE, 0.6::DOUBLE), ('standard', 0.85::DOUBLE, 0.7::DOUBLE), ('aggressive', 0.75::DOUBLE, 0.55::DOUBLE)),
named AS (SELECT event_id, value / 500 AS confidence, CASE event_id % 3 WHEN 0 THEN 'conservative' WHEN 1 THEN 'standard' ELSE 'aggressive' END AS mode FROM events)
SELECT event_id, n.mode, CASE WHEN confidence >= auto THEN 'auto' WHEN confidence >= review THEN 'review' ELSE 'ignore' END AS decision
FROM named n JOIN modes m ON n.mode = m.mode
""")
def decide_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A confidence becomes auto, review or ignore by the thresholds of its mode."""
    modes = spark.createDataFrame([(m, a, r) for m, (a, r) in rules.THRESHOLDS.items()], "mode string, auto double, review double")
    mode = F.when(F.col("event_id") % 3 == 0, "conservative").when(F.col("event_id") % 3 == 1, "standard").otherwise("aggressive")
    named = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 500).alias("confidence"), mode.alias("mode"))
    return named.join(F.broadcast(modes), "mode").select("event_id", "mode", rules.decide(F.col("confidence"), F.col("auto"), F.col("review")).alias("decision"))


@query(f"""
WITH c AS ({CANDIDATES_SQL})
SELECT file_id, candidate, CASE user_action WHEN 'approve' THEN true WHEN 'reject' THEN false ELSE decision = 'auto' END AS removed,
       user_action = 'pending' AND decision = 'review' AS awaiting FROM c
""")
def effective_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's action beats the decision."""
    c = candidates(spark, sf_dir)
    return c.select("file_id", "candidate", rules.should_remove(c.decision, c.user_action).alias("removed"), rules.awaiting_review(c.decision, c.user_action).alias("awaiting"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'pdf_object_remove' WHEN l_returnflag = 'A' AND l_discount * 10 >= 0.6 THEN 'alpha_restore'
  WHEN l_linestatus = 'F' OR (l_tax / 2 < 0.02 AND l_quantity / 50 < 0.35 AND l_linenumber * 1.5::DOUBLE <= 6) THEN 'fast_inpaint'
  WHEN l_suppkey % 2 = 0 THEN 'ai_inpaint' ELSE 'texture_synthesis' END AS route FROM lineitem
""")
def route_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first repair route that fits each region."""
    c = F.col
    how = rules.route(c("l_linenumber") == 7, c("l_returnflag") == "A", c("l_discount") * 10, c("l_linestatus") == "F", c("l_tax") / 2, c("l_quantity") / 50, c("l_linenumber") * 1.5, c("l_suppkey") % 2 == 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", how.alias("route"))


STATE_SQL = "CASE o_orderkey % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'scanning' WHEN 2 THEN 'ready' WHEN 3 THEN 'processing' WHEN 4 THEN 'completed' WHEN 5 THEN 'failed' ELSE 'cancelled' END"
#: Files: an order is one, its line items are its candidates.
FILES_SQL = f"""
  SELECT o_orderkey AS file_id, {STATE_SQL} AS state, CASE o_orderstatus WHEN 'P' THEN 'needs_review' WHEN 'O' THEN 'none' ELSE 'approved' END AS review,
         count(l_orderkey) AS n_candidates, count(l_orderkey) FILTER (l_returnflag = 'A') AS to_remove, o_orderpriority = '1-URGENT' AS needs_password
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_orderpriority
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items are counted before the join, so only one row an order is joined."""
    counted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file_id")).agg(F.count("*").alias("n_candidates"), F.count_if(F.col("l_returnflag") == "A").alias("to_remove"))
    state = F.element_at(F.array(*map(F.lit, rules.STATES)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    review = F.when(F.col("o_orderstatus") == "P", "needs_review").when(F.col("o_orderstatus") == "O", "none").otherwise("approved")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), state.alias("state"), review.alias("review"), (F.col("o_orderpriority") == "1-URGENT").alias("needs_password"))
    return orders.join(counted, "file_id", "left").fillna(0, ["n_candidates", "to_remove"])


STATUS_SQL = """CASE WHEN state IN ('queued', 'cancelled') THEN 'waiting' WHEN state IN ('scanning', 'processing', 'failed') THEN state
         WHEN review = 'needs_review' THEN 'needs_review' WHEN state = 'completed' THEN 'completed' WHEN n_candidates = 0 THEN 'clean' ELSE 'detected' END"""


@query(f"""
WITH f AS ({FILES_SQL})
SELECT file_id, state, {STATUS_SQL} AS status,
       CASE WHEN to_remove > 2 OR needs_password THEN 'needs_review' WHEN review = 'needs_review' THEN 'approved' ELSE review END AS next_review FROM f
""")
def file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status a list shows, and the review state after everything open was looked at again."""
    f = files(spark, sf_dir)
    no = F.lit(False)
    return f.select("file_id", "state", rules.file_status(f.state, f.review, f.n_candidates).alias("status"), rules.review_status(f.review, f.to_remove > 2, no, f.needs_password, no).alias("next_review"))


@query(f"""
WITH f AS ({FILES_SQL}) SELECT file_id, state = 'ready' AND review <> 'needs_review' AND to_remove > 0 AND NOT needs_password AS processable FROM f
""")
def processable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return f.select("file_id", rules.processable(f.state, f.review, f.to_remove, F.lit(False), f.needs_password).alias("processable"))


@query("""
WITH s(state) AS (VALUES ('queued'), ('scanning'), ('ready'), ('processing'), ('completed'), ('failed'), ('cancelled'))
SELECT a.state AS state, b.state AS following, CASE WHEN a.state = b.state THEN true
  WHEN b.state = 'cancelled' THEN a.state NOT IN ('completed', 'cancelled') WHEN b.state = 'failed' THEN a.state NOT IN ('completed', 'failed', 'cancelled')
  ELSE (a.state || '>' || b.state) IN ('queued>scanning', 'scanning>ready', 'ready>processing', 'processing>completed', 'ready>scanning', 'failed>queued', 'cancelled>queued',
    'failed>ready', 'cancelled>ready', 'completed>ready', 'completed>scanning', 'processing>ready', 'queued>ready') END AS allowed FROM s a, s b
""")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the seven states, and whether a job may go from one to the other."""
    pairs = spark.createDataFrame([(a, b) for a in rules.STATES for b in rules.STATES], "state string, following string")
    return pairs.withColumn("allowed", rules.may_follow(F.col("state"), F.col("following")))


@query(f"""
WITH f AS ({FILES_SQL}), s AS (SELECT {STATUS_SQL} AS status, file_id FROM f)
SELECT 'all' AS filter, count(*) AS n FROM s UNION ALL SELECT status, count(*) FROM s GROUP BY status
""")
def status_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by filter of a list; each counts in `all` as well."""
    f = files(spark, sf_dir)
    status = rules.file_status(f.state, f.review, f.n_candidates)
    return f.select(F.explode(F.array(F.lit("all"), status)).alias("filter")).groupBy("filter").agg(F.count("*").alias("n"))


@query(f"""
WITH f AS ({FILES_SQL}), s AS (SELECT {STATUS_SQL} AS status, file_id FROM f)
SELECT file_id AS first_shown FROM s ORDER BY CASE status WHEN 'failed' THEN 0 WHEN 'needs_review' THEN 1 ELSE 2 END, file_id LIMIT 1
""")
def default_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failed file, else the first to review, else the first."""
    f = files(spark, sf_dir)
    status = rules.file_status(f.state, f.review, f.n_candidates)
    rank = F.when(status == "failed", 0).when(status == "needs_review", 1).otherwise(2)
    return f.agg(F.min_by("file_id", F.struct(rank, "file_id")).alias("first_shown"))


@query(f"""
WITH c AS ({CANDIDATES_SQL})
SELECT file_id, candidate, CASE WHEN confidence >= 0.75 THEN CASE WHEN candidate % 3 = 0 THEN 'review' ELSE 'auto' END WHEN confidence >= 0.55 THEN 'review' ELSE 'ignore' END AS decision FROM c
""")
def redecide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions after new thresholds; a candidate without a mask (every third) is reviewed, never removed unseen."""
    c = candidates(spark, sf_dir)
    new = rules.decide(c.confidence, *rules.THRESHOLDS["aggressive"])
    return c.select("file_id", "candidate", F.when((new == "auto") & (c.candidate % 3 == 0), "review").otherwise(new).alias("decision"))


@query("""
SELECT p_partkey, greatest(0.05::DOUBLE, least(1::DOUBLE, p_retailprice / 1500)) AS auto,
       greatest(0::DOUBLE, least(greatest(0.05::DOUBLE, least(1::DOUBLE, p_retailprice / 1500)), p_size / 40.0::DOUBLE)) AS review,
       CASE WHEN p_size < 3 THEN '_clean' ELSE translate(p_type, '/\\:', '___') END AS suffix, greatest(1, least(64, p_size)) AS workers FROM part
""")
def settings_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings brought into their ranges: review not above auto, a suffix that names a new file."""
    one = F.lit(1.0)
    auto = F.greatest(F.lit(0.05), F.least(one, F.col("p_retailprice") / 1500))
    suffix = F.when(F.col("p_size") < 3, "_clean").otherwise(scalars.safe_suffix(F.col("p_type")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", auto.alias("auto"), F.greatest(F.lit(0.0), F.least(auto, F.col("p_size") / 40.0)).alias("review"), suffix.alias("suffix"), F.greatest(F.lit(1), F.least(F.lit(64), F.col("p_size"))).alias("workers")
    )


#: Presets that are always there (id, mode, threshold, quality, format).
PRESETS = (
    ("builtin-xhs", "standard", 0.85, "balanced", "jpeg"),
    ("builtin-product", "standard", 0.85, "balanced", "same"),
    ("builtin-photography", "conservative", 0.95, "best", "same"),
    ("builtin-pdf", "conservative", 0.95, "balanced", "same"),
)


@query("""
SELECT * FROM (VALUES ('builtin-xhs', 'standard', 0.85::DOUBLE, 'balanced', 'jpeg', true), ('builtin-product', 'standard', 0.85, 'balanced', 'same', true),
  ('builtin-photography', 'conservative', 0.95, 'best', 'same', true), ('builtin-pdf', 'conservative', 0.95, 'balanced', 'same', true)) t(id, mode, threshold, quality, format, builtin)
UNION ALL SELECT 'user-' || c_custkey, 'aggressive', 0.75, 'fast', 'png', false FROM customer WHERE c_mktsegment = 'BUILDING'
""")
def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in presets and the user's."""
    built = spark.createDataFrame([(*p, True) for p in PRESETS], "id string, mode string, threshold double, quality string, format string, builtin boolean")
    own = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("user-"), F.col("c_custkey")).alias("id"), F.lit("aggressive").alias("mode"), F.lit(0.75).alias("threshold"), F.lit("fast").alias("quality"), F.lit("png").alias("format"), F.lit(False).alias("builtin")
    )
    return built.unionByName(own)


@query("""
WITH e(kind, code) AS (VALUES ('io', 'E_IO'), ('unsupported_format', 'E_UNSUPPORTED_FORMAT'), ('decode', 'E_DECODE'), ('encode', 'E_ENCODE'), ('pdf', 'E_PDF'), ('model', 'E_MODEL'),
  ('inference', 'E_INFERENCE'), ('out_of_memory', 'E_OOM'), ('permission', 'E_PERMISSION'), ('cancelled', 'E_CANCELLED'), ('invalid_password', 'E_INVALID_PASSWORD'),
  ('needs_confirmation', 'E_NEEDS_CONFIRMATION'), ('internal', 'E_INTERNAL'))
SELECT kind, code, kind IN ('io', 'out_of_memory', 'inference', 'cancelled') AS retryable FROM e
""")
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(rules.ERROR_CODES.items()), "kind string, code string")
    return rows.withColumn("retryable", F.col("kind").isin(*rules.RETRYABLE))


@query("""
WITH s(stage, base) AS (VALUES ('queued', 0.0::DOUBLE), ('decode', 0.05), ('analyze', 0.1), ('detect', 0.2), ('segment', 0.35), ('remove', 0.5), ('evaluate', 0.8), ('encode', 0.85), ('commit', 0.95), ('done', 1.0)),
e AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'detect' WHEN 'click' THEN 'remove' WHEN 'purchase' THEN 'done' ELSE 'decode' END AS stage FROM events)
SELECT user_id, round(avg(base), 6) AS progress, count(*) AS items FROM e JOIN s ON e.stage = s.stage GROUP BY user_id
""")
def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean progress of a job's items, from the stage each is in."""
    t = F.col("event_type")
    stage = F.when(t == "signup", "queued").when(t == "view", "detect").when(t == "click", "remove").when(t == "purchase", "done").otherwise("decode")
    base = F.create_map(*[F.lit(x) for kv in rules.STAGE_PROGRESS.items() for x in kv])
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg(base[stage]), 6).alias("progress"), F.count("*").alias("items"))


@query(f"""
WITH c AS ({CANDIDATES_SQL}), strong AS (SELECT file_id, bool_or(candidate = 1 AND confidence >= 0.85) AS hit FROM c GROUP BY file_id)
SELECT c.file_id, candidate FROM c JOIN strong s ON c.file_id = s.file_id WHERE NOT (s.hit AND candidate % 2 = 0)
""")
def detector_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a learned pattern hits surely (candidate 1), the overlay detector (even candidates) isn't asked."""
    c = candidates(spark, sf_dir)
    strong = c.where((c.candidate == 1) & (c.confidence >= 0.85)).select("file_id").distinct().withColumn("hit", F.lit(True))
    return c.join(strong, "file_id", "left").where(~(F.coalesce("hit", F.lit(False)) & (F.col("candidate") % 2 == 0))).select("file_id", "candidate")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity AS contrast, (l_suppkey % 180)::DOUBLE AS angle FROM lineitem),
m AS (SELECT l_orderkey, count(*) AS n, list_sort(list(contrast))[count(*) // 2 + 1] AS mid_contrast, list_sort(list(angle))[count(*) // 2 + 1] AS mid_angle FROM l GROUP BY l_orderkey)
SELECT l.l_orderkey, l.l_linenumber FROM l JOIN m USING (l_orderkey)
WHERE n < 6 OR contrast < 0.6::DOUBLE * mid_contrast OR least((angle - mid_angle + 180) % 180, 180 - (angle - mid_angle + 180) % 180) > 15
""")
def body_text_protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With six lines or more, only those much fainter than the upper median or tilted against it may be marks."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("contrast"), (F.col("l_suppkey") % 180).cast("double").alias("angle"))
    mid = lambda c: F.element_at(F.sort_array(F.collect_list(c)), F.floor(F.count("*") / 2).cast("int") + 1)
    m = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), mid("contrast").alias("mid_contrast"), mid("angle").alias("mid_angle"))
    kept = (F.col("n") < 6) | (F.col("contrast") < 0.6 * F.col("mid_contrast")) | (scalars.angle_difference(F.col("angle"), F.col("mid_angle")) > 15)
    return rows.join(m, "l_orderkey").where(kept).select("l_orderkey", "l_linenumber")
