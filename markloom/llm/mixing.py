"""Mixing sources to target weights: Efraimidis-Spirakis sampling in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markloom.llm.common import materialize, shared_dir

#: ASCII white space separates words.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows for which the key range gets another bucket; one bucket of a source is sorted row by row.
BUCKET_ROWS, LEAST_BUCKETS = 4096, 256


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """`sizes` (source, source_size), a row a source, with target, epochs and rest.

    Sources in code point order, null last, have the weights in turn, again and again. They divide `share` of all
    words by weight; who would get more than `cap` times its size gets that, and the excess is divided anew. In
    order of cap * size / weight, the capped sources come first, which running sums tell without a loop. The
    running sums go over one row a source. Without words all targets are 0."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(table, ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int")))
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    steps = ranked.select(
        "*",
        (F.sum("source_size").over(every) * F.lit(float(share))).alias("all_words"),
        F.sum("weight").over(every).alias("all_weight"),
        F.coalesce(F.sum(F.col("source_size") * cap).over(before), zero).alias("full"),
        F.coalesce(F.sum("weight").over(before), zero).alias("full_weight"),
    )
    level = (F.col("all_words") - F.col("full")) / (F.col("all_weight") - F.col("full_weight"))
    marked = steps.withColumn("capped", F.col("source_size") * cap <= level * F.col("weight"))
    kept = F.sum(F.when(F.col("capped"), F.col("source_size") * cap).otherwise(zero)).over(every)
    kept_weight = F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(zero)).over(every)
    target = F.when(F.col("capped"), (F.col("source_size") * cap).cast("double")).otherwise(
        F.col("weight") * F.try_divide(F.col("all_words") - kept, F.col("all_weight") - kept_weight)
    )
    out = marked.withColumn("target", F.coalesce(target, zero))
    epochs = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    return out.withColumn("epochs", epochs).select("source", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, cap: float = 3, quality: Column | None = None, row: Column | None = None, labels: DataFrame | None = None
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of `docs` (doc_id, text, source).

    size: the text's words, 0 for null. A source gives whole epochs of all its documents first; what is left of its
    target is filled by the documents with the smallest keys -ln(u) / quality, where u is uniform by a digest of
    doc_id and text: Efraimidis and Spirakis's sample without replacement. A document is taken if its middle word,
    in that order, is within what is left, so a source ends as near its target as the order allows. copies: times a
    document is taken; taken: copies * size. Reruns give the same.

    Keys are monotonously dealt into buckets; sums by bucket tell which buckets are taken whole, and only the rows
    of the one bucket in which a source's target ends are sorted. So a source that holds most rows isn't gathered
    in a task. Nulls: a null source is a source, a null quality counts as 1. Equal rows have equal keys and may be
    taken in any order, which changes no count. Rows of no words are only taken with whole epochs. `quality`:
    positive weights of documents, at most 1 for evenly filled buckets. `labels` (doc_id, quality) gives weights
    instead, as `label_quality` does; it meets the rows when their texts are numbers already, so that no text is
    shuffled for a label. `row`: a column of each row that its result has too, as row, and that orders rows of equal
    keys. An empty table gives none."""
    shared_dir(docs.sparkSession)
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    weight = F.lit(1.0) if quality is None else F.coalesce(quality.cast("double"), F.lit(1.0))
    carried = [] if row is None else ["row"]
    base = docs.select("doc_id", "source", size.alias("size"), (-F.ln(u) / weight).alias("key"), *([] if row is None else [row.alias("row")]))
    if labels is not None:
        base = label_quality(base, labels).withColumn("key", F.col("key") / F.col("mix_quality")).drop("mix_quality")
    base = materialize(base)
    buckets = max(LEAST_BUCKETS, base.count() // BUCKET_ROWS)
    bucket = F.least(F.floor((1 - F.exp(-F.col("key") / 2)) * buckets), F.lit(buckets - 1)).cast("int")
    base = base.withColumn("bucket", bucket)
    sums = materialize(base.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    t = targets.alias("t")
    ends = sums.alias("s").join(t, F.col("s.source").eqNullSafe(F.col("t.source")) & (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")), "right")
    plan = materialize(ends.select(*[F.col(f"t.{c}").alias(c) for c in ("source", "source_size", "target", "epochs", "rest")], F.coalesce("bucket", F.lit(buckets)).alias("end"), F.coalesce("before", F.lit(0)).alias("before")))
    rows = base.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).drop(F.col("p.source"))
    ahead = Window.partitionBy("source").orderBy("key", F.col("doc_id"), "size", *carried).rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where("bucket = end").withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    edge = edge.withColumn("more", ((F.col("size") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("rest"))).cast("long"))
    # a source without rest ends before its first words; documents of no words are not taken there either
    plain = rows.where("bucket <> end").withColumn("more", ((F.col("bucket") < F.col("end")) & (F.col("rest") > 0) & (F.col("size") > 0)).cast("long"))
    return plain.unionByName(edge).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("epochs") + F.col("more")).alias("copies"), ((F.col("epochs") + F.col("more")) * F.col("size")).alias("taken"), *carried
    )


def label_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with the column mix_quality: 1 for labelled good, 0.25 for labelled bad, 0.5 for unlabelled documents."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    d, k = docs.alias("d"), known.alias("k")
    weight = F.when(F.col("k.label") == 1, 1.0).when(F.col("k.label") == 0, 0.25).otherwise(0.5)
    return d.join(k, F.col("d.doc_id") == F.col("k.doc_id"), "left").select(*[F.col(f"d.{c}") for c in docs.columns], weight.alias("mix_quality"))


def mixed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it: not at all, once or more times.

    The mix is made of numbers and a digest of each row; only its result meets the rows, in one shuffle. Equal rows
    are one there, with the copies of all of them, so rows without doc_id and rows that share one come as often as
    the mix counted them."""
    name = F.md5(F.to_json(F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])).cast("binary"))
    taken = mix(docs, row=name, labels=labels).where("copies > 0").groupBy("row").agg(F.sum("copies").alias("copies"))
    rows = docs.select(F.struct(*docs.columns).alias("whole"), name.alias("row")).groupBy("row").agg(F.first("whole").alias("whole"))
    both = rows.join(materialize(taken), "row")
    return both.select("whole", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("whole.*")


ORACLE = r"""
WITH base AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || '|' || coalesce(d.text, '')), 1, 12))::BIGINT + 0.5) / 281474976710656.0)
           / (CASE k.label WHEN 1 THEN 1.0 WHEN 0 THEN 0.25 ELSE 0.5 END) AS key
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS label FROM labels GROUP BY doc_id) k ON d.doc_id = k.doc_id),
sources AS (
  SELECT source, sum(size)::DOUBLE AS s, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM base GROUP BY source),
steps AS (
  SELECT *, sum(s) OVER () AS all_words, sum(w) OVER () AS all_weight,
         coalesce(sum(3 * s) OVER room, 0) AS full_words, coalesce(sum(w) OVER room, 0) AS full_weight
  FROM sources WINDOW room AS (ORDER BY s / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, 3 * s <= (all_words - full_words) / (all_weight - full_weight) * w AS capped FROM steps),
targets AS (
  SELECT source, s, coalesce(CASE WHEN capped THEN 3 * s ELSE w * ((all_words - sum(CASE WHEN capped THEN 3 * s ELSE 0 END) OVER ())
         / nullif(all_weight - sum(CASE WHEN capped THEN w ELSE 0 END) OVER (), 0)) END, 0) AS target FROM marked),
epochs AS (SELECT *, coalesce(floor(target / nullif(s, 0)), 0)::BIGINT AS epochs FROM targets),
ranked AS (
  SELECT b.*, e.s, e.target, e.epochs, e.target - e.epochs * e.s AS rest,
         coalesce(sum(size) OVER (PARTITION BY b.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM base b JOIN epochs e ON b.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, s::BIGINT AS source_size, target,
       (epochs + CASE WHEN size > 0 AND rest > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END)::BIGINT AS copies,
       ((epochs + CASE WHEN size > 0 AND rest > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM ranked
"""
