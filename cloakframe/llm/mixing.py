"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Each source's weight is a function of training time t from 0 to 1, its total weight times a piecewise-linear shape. The integral of the
shape is the source's cumulative token demand; a document stands in its source at a cumulative token count, and the
inverse of the demand turns that count into a training position. Documents are range-sorted by position.

Totals: all sources together share `share` times the words there are, by weight, but none gets more than `most` times its
own words; what is left over goes to the others by weight. A source is read in passes; a document is taken in a pass
if its middle word lies before the source's target, so a source's words miss the target by half a document at most, and no document
is taken more than `most` times. A document's place in its source is the order of the MD5 of its id and size, so reruns agree.

Defined results: a null text has no words and is taken never; a null source is a source of its own, the last; repeated rows are
documents of their own. Sums run over `3 hex digits` blocks of each source (4096), so that a source with a third of all rows
is spread over as many groups; only sums meet in one task: a row for each source, which are to be few (thousands, not one a document).
An empty table gives an empty one; very long texts are split into words whole; clashing columns are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cloakframe.llm.common import WHITE, table, written

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Shapes by weight: (time, level) knots from time 0 to 1, each of mean level 1.
SHAPES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def word_count(text: Column) -> Column:
    """The number of words ([^\\x20\\x09-\\x0D]+) of a text; null has none."""
    parts = F.split(text, f"{WHITE}+")
    empty = lambda i: (F.element_at(parts, i) == "").cast("int")
    return F.when(text.isNull(), 0).otherwise(F.greatest(F.lit(0), F.size(parts) - empty(1) - empty(-1))).cast("long")


def inverse_demand(share: Column, knots) -> Column:
    """The time at which the integral of a piecewise-linear shape is the given share of its whole."""
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    done, out = 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        area, slope = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
        rest = F.greatest(F.lit(0.0), share * total - done)
        at = rest / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * rest)) - w0) / slope
        done += area
        out.append((share * total <= done, t0 + at))
    return F.least(F.lit(1.0), reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), reversed(out[:-1]), out[-1][1]))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size, and any others, one row a source) with kind (index into weights) and target.

    Reshare until none is above its limit, in one pass: by limit per weight, ascending, the level at which the rest of the total fills
    the rest of the weights; the first level that is not above its own source's limit per weight holds for all after it."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    kinds = sizes.withColumn("kind", ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    kinds = kinds.withColumns({"__w": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("kind") + 1), "__cap": F.col("source_size") * F.lit(float(most))}).withColumn("__r", F.col("__cap") / F.col("__w"))
    by = Window.orderBy("__r", F.col("source").isNull(), "source")
    ahead, after, all_ = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(all_) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("__cap").over(ahead), F.lit(0.0))) / F.sum("__w").over(after)
    leveled = kinds.withColumn("__level", level).withColumn("__level", F.min(F.when(F.col("__level") <= F.col("__r"), F.struct("__r", F.col("source").isNull(), "source", "__level"))).over(all_)["__level"])
    return leveled.select(*sizes.columns, "kind", F.coalesce(F.least("__cap", F.col("__w") * F.col("__level")), F.col("__cap")).alias("target"))


def mixed(rows: DataFrame, weights=WEIGHTS, shapes=SHAPES, share: float = SHARE, most: float = MOST) -> DataFrame:
    """rows (doc_id, size, source, and any others) with source_size, target, taken, position (its first, null if not taken) and
    positions, one for each time it is taken. Clashing columns are replaced."""
    rows = rows.drop("source_size", "target", "taken", "position", "positions")
    key = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string")).cast("binary"))
    # the source as a key that is never null: the join with the blocks and the window over them share one shuffle
    rows = rows.withColumns({"__order": key, "__source": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))}).withColumn("__block", F.substring("__order", 1, 3))
    names = [c for c in rows.columns if c not in ("source", "__block", "__source", "__order")]
    blocks = rows.groupBy("source", "__source", "__block").agg(F.sum("size").alias("__block_size"))
    goals = targets(blocks.groupBy("source", "__source").agg(F.sum("__block_size").alias("source_size")), weights, share, most)
    ahead = Window.partitionBy("__source").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.drop("source").withColumn("__ahead", F.coalesce(F.sum("__block_size").over(ahead), F.lit(0)))
    each = starts.join(goals.drop("source"), "__source").select("__source", "__block", "__ahead", "source_size", "kind", "target")
    inside = Window.partitionBy("__source", "__block").orderBy("__order", "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(each, ["__source", "__block"]).withColumn("__before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    middle = F.col("__ahead") + F.col("__before") + F.col("size") / 2
    turns = int(-(-most // 1))
    passes = reduce(lambda a, c: a + c, [(middle + F.lit(float(k)) * F.col("source_size") <= F.col("target")).cast("long") for k in range(turns)])
    def time(k: int) -> Column:
        done = (middle + F.lit(float(k)) * F.col("source_size")) / F.col("target")
        return F.round(reduce(lambda rest, i: F.when(F.col("kind") == i, inverse_demand(done, shapes[i])).otherwise(rest), range(len(weights)), F.lit(None).cast("double")), 6)

    out = joined.withColumn("__passes", F.when(F.col("size") > 0, passes).otherwise(0)).withColumn("positions", F.slice(F.array(*[time(k) for k in range(turns)]), F.lit(1), F.col("__passes").cast("int")))
    return out.select(*names, "source", "source_size", "target", (F.col("__passes") * F.col("size")).cast("long").alias("taken"), F.get("positions", F.lit(0)).alias("position"), "positions")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    out = mixed(written(rows, "op6"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")  # the id splits the many without a position


QUERIES = {"op6_mixing": op6_mixing}
ORACLE_SQL = {
    "op6_mixing": """
WITH rows AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
kinds AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS kind FROM sizes),
limits AS (SELECT *, CASE kind WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM kinds),
levels AS (SELECT *, cap / w AS r, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k,
  ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
   / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM limits),
goals AS (SELECT source, source_size, kind, coalesce(least(cap, w * (SELECT level FROM levels WHERE level <= r ORDER BY k LIMIT 1)), cap) AS target FROM levels),
placed AS (SELECT *, md5(coalesce(doc_id::VARCHAR, 'null') || '/' || size::VARCHAR) AS o FROM rows),
middles AS (SELECT p.doc_id, p.size, g.source_size, g.target, g.kind,
   (coalesce(sum(p.size) OVER (PARTITION BY p.source ORDER BY o, p.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + p.size / 2.0)::DOUBLE AS m
   FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source),
taken AS (SELECT *, CASE WHEN size > 0 THEN (m <= target)::BIGINT + (m + source_size <= target)::BIGINT ELSE 0 END AS n, m / target AS u FROM middles)
SELECT doc_id, size, source_size, target, n * size AS taken,
  CASE WHEN n > 0 THEN round(least(1.0, CASE kind WHEN 0 THEN (sqrt(greatest(0.0, 2.25 - 2 * u)) - 1.5) / -1.0 WHEN 1 THEN u
       ELSE (sqrt(greatest(0.0, 0.25 + 2 * u)) - 0.5) / 1.0 END), 6) END AS position FROM taken"""
}
