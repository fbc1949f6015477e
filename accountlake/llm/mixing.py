"""Mixing sources to target weights, with a cap on how often a source may be repeated.

Water-filling: the words there are go to the sources by weight; a source that would exceed its cap
is clamped to it and what it cannot take goes to the others by weight, until no source is above.
A source's target then gives whole repetitions of all its documents and a seeded
sample for the rest: documents in the order of a seeded hash, as many as come nearest to it.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accountlake.llm.common import WORD, packed, pick, ranked, saved, unpacked

EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = 11
GROUP = 4096  # documents of a source summed together in the search for the last one sampled


def words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A document's place in the seeded order; rows equal in id and text share it."""
    parts = [F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit(""))]
    return F.md5(F.concat(*parts).cast("binary"))


def sources_of(sized: DataFrame) -> DataFrame:
    """One row per source (null is one too) with words, documents and its place by code point, null last."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    return ranked(sums, [F.col("source").asc_nulls_last()], "place")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``sources`` with ``target``: capped water-filling over one small row per source.

    Each turn sums what is left over the sources that are not clamped, clamps those above their cap
    and ends when there is none. Sums are of whole words, so turns in any order give the same.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    state = saved(
        sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs).withColumn("full", F.lit(False)),
        "sources",
    )
    total = state.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:
        left, share = state.agg(
            F.lit(total) - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0.0)),
        ).first()
        fair = F.lit(float(left)) * F.col("weight") / F.lit(share or 1.0)
        over = state.where(~F.col("full") & (fair > F.col("cap")))
        if share == 0 or over.isEmpty():
            return state.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(fair))
        state = saved(state.withColumn("full", F.col("full") | (fair > F.col("cap"))), "sources")


def placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with ``source`` and ``draw`` beside their source's figures and their group of the draw."""
    at = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    return (
        rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("group", F.floor(at * F.col("groups") / F.lit(1 << 32)).cast("long"))
    )


def plan_mix(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per source: its figures, and (by ``place``) where its sample ends.

    ``sized`` has ``source, size, draw``. A source repeats all its documents ``whole`` times and
    then those of its sample: a document is in it if the words before it in the draw and half
    its own fit the rest. Groups of some ``GROUP`` documents are summed first; only the one group per source
    where the rest runs out is looked into, so no task holds a source.
    """
    size = F.col("source_size")
    whole = F.when(size == 0, 1).otherwise(F.least(F.floor(F.col("target") / size), F.lit(EPOCHS))).cast("long")
    plan = targets(sources_of(sized)).select(
        F.col("source").alias("_source"), "place", "target", "source_size", whole.alias("whole"),
        F.ceil(F.col("source_docs") / GROUP).cast("long").alias("groups"),
    ).withColumn("rest", F.col("target") - F.col("whole") * size)
    plan = saved(plan, "plan")
    narrow = saved(placed(sized, plan).select("place", "group", "draw", "size"), "draws")
    earlier = Window.partitionBy("place").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sums = narrow.groupBy("place", "group").agg(F.sum("size").alias("words"))
    runs = sums.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0))).join(
        plan.select("place", "rest"), "place"
    )
    seams = runs.where("before + words > rest").groupBy("place").agg(
        F.min(F.struct("group", "before", "rest")).alias("seam")
    ).select("place", "seam.*")
    # Rows that share a draw are taken together or not at all.
    inside = narrow.join(seams, ["place", "group"]).groupBy("place", "group", "before", "rest", "draw").agg(
        F.sum("size").alias("size")
    )
    so_far = Window.partitionBy("place").orderBy("draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("run", F.sum("size").over(so_far)).where(
        "rest > 0 and before + run - size / 2.0D <= rest"
    ).groupBy("place").agg(F.max("draw").alias("last"))
    ends = seams.select("place", F.col("group").alias("seam")).join(last, "place", "left")
    return plan, saved(ends, "ends")


def repeated(rows: DataFrame, plan: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows with ``source`` and ``draw``, and ``times``: how often the mix takes the row."""
    sampled = (F.col("group") < F.col("seam")) | ((F.col("group") == F.col("seam")) & (F.col("draw") <= F.col("last")))
    # Without a seam the rest covers all documents; with no rest there is no sample.
    sampled = (F.col("rest") > 0) & F.coalesce(sampled, F.col("seam").isNull())
    return placed(rows, plan).join(ends, "place", "left").withColumn("times", F.col("whole") + sampled.cast("long"))


def _sized(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return pick(docs, "doc_id", "text", "source").select(
        "doc_id", "source", words(text).alias("size"), draw(F.col("doc_id"), text).alias("draw")
    )


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its words, its source's words and target, and the words the mix takes of it.

    Null and empty texts have 0 words. Rows equal in id and text are taken alike. A source without words
    has target 0. An empty table gives no rows. Reruns agree: the draw is a hash.
    """
    sized = saved(_sized(docs), "sized")
    plan, ends = plan_mix(sized)
    return repeated(sized, plan, ends).select(
        F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("times")).alias("taken"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, as often as the mix takes them.

    Sources without words stay once. Null and empty texts have no words, a null source comes last, rows equal in id and text are
    taken alike, columns of any names are kept, an empty table stays empty. Texts are not shuffled while the table of sources is small enough
    for Spark to broadcast it; else the join is split where a source is hot.
    """
    plan, ends = plan_mix(saved(_sized(docs), "sized"))
    text = F.col("text").cast("string")
    whole = packed(docs, "doc_id", "text", "source").select("row", "source", draw(F.col("doc_id"), text).alias("draw"))
    times = repeated(whole, plan, ends).where("times > 0")
    # A generator repeats the row; the copies are not built as an array.
    return unpacked(times.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))), docs.columns)


REPORT_SQL = rf"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        md5('{SEED}:' || coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '')) AS draw
    FROM documents
), s AS (
    SELECT *, {EPOCHS} * source_size AS cap,
        (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight
    FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)
), f AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER below, 0))::DOUBLE AS left_over,
        sum(weight) OVER () - coalesce(sum(weight) OVER below, 0) AS share
    FROM s WINDOW below AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
    SELECT *, min(CASE WHEN left_over * weight / share > cap THEN 1 ELSE 0 END)
        OVER (ORDER BY cap / weight, source NULLS LAST) AS clamped
    FROM f
), t AS (
    SELECT source, source_size, CASE WHEN clamped = 1 THEN cap::DOUBLE ELSE
        (sum(source_size) OVER () - coalesce(sum(CASE WHEN clamped = 1 THEN cap END) OVER (), 0))::DOUBLE * weight
        / sum(CASE WHEN clamped = 0 THEN weight END) OVER () END AS target
    FROM g
), p AS (
    SELECT *, CASE WHEN source_size = 0 THEN 1 ELSE least(floor(target / source_size), {EPOCHS})::BIGINT END AS whole
    FROM t
), q AS (SELECT *, target - whole * source_size AS rest FROM p),
r AS (
    SELECT source, draw, sum(size) AS together, sum(sum(size)) OVER (PARTITION BY source ORDER BY draw) AS run
    FROM d GROUP BY source, draw
)
SELECT d.doc_id, d.size, q.source_size, q.target,
    (d.size * (q.whole + CASE WHEN q.rest > 0 AND r.run - r.together / 2.0 <= q.rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.draw = r.draw
"""
