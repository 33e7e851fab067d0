"""Mixing sources to target weights with DataFrame operations alone.

Sources' sizes are summed, targets derived from the weights (none above a source's cap; the excess
goes to the others by weight), and each document is taken floor(rate) times plus once more if its
hash falls below the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionloom.llm.common import WORD, named

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with target double.

    Sources in order of code points, null last, weigh `weights` in turn. With caps c = most x size and
    targets min(c, L x weight), the level L is the only one at which targets add up to share x total:
    resharing the excess by weight ends there. Sources are sorted by c / weight; those before the
    level are at their caps. A row for each source, which one task must hold: millions of them, not
    billions. A null source is the last; an empty table gives none; sources of size 0 get target 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (turn + 1).cast("int"))
    caps = sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("cap"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    summed = caps.select(
        "*",
        (F.sum("cap").over(by_level) - F.col("cap")).alias("cap_before"),
        (F.sum("w").over(whole) - F.sum("w").over(by_level) + F.col("w")).alias("w_left"),
        (F.sum("source_size").over(whole) * F.lit(float(share))).alias("wanted"),
    )
    level = (F.col("wanted") - F.col("cap_before")) / F.col("w_left")
    open_level = F.when(level * F.col("w") <= F.col("cap"), level)
    # The first row whose own level stays below its cap sets the level for it and all after it.
    return summed.select("source", "source_size", "w", "cap", F.min(F.struct(F.when(open_level.isNull(), 1).otherwise(0).alias("closed"), (F.col("cap") / F.col("w")).alias("order"), open_level.alias("level"))).over(whole).alias("best")).select(
        "source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("best.level") * F.col("w")), F.col("cap").cast("double")).alias("target")
    )


def with_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """docs with size, source_size, target and copies (0 to `most`); columns of docs so named give way.

    Null texts have size 0; null sources are a source; a source without words gets target 0 and no
    copies; rows repeated share their doc_id's hash, so they are taken alike; an empty table gives none.
    """
    sized = docs.drop("size", "source_size", "target", "copies").withColumn("size", word_count(F.col("text")))
    # The sum is taken within each task first, so a hot source sends one row a task.
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    planned_source = "_".join(["planned_source", *docs.columns])  # no column of docs has this name
    planned = targets(sizes, weights, share, most).withColumnRenamed("source", planned_source)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    draw = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    joined = sized.join(planned, F.col("source").eqNullSafe(F.col(f"`{planned_source}`")), "left").drop(planned_source)
    return joined.withColumn("copies", (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mixed corpus: the columns of docs, each row as often as it is taken.

    Any other columns ride along, whatever their names; see with_copies() for nulls, repeated rows and
    empty tables.
    """
    packed = docs.select("doc_id", "source", "text", F.struct(*[named(c) for c in docs.columns]).alias("_row"))
    picked = with_copies(packed, weights, share, most).filter(F.col("copies") > 0)
    return picked.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def mix_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row for each row of docs; see with_copies(). Other columns are left out."""
    d = with_copies(docs.select("doc_id", "source", "text"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: DuckDB SQL for mix_digest() over `documents`; the same sums of integers, the same divisions.
SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, 2 * source_size AS cap,
  CASE (row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w FROM sizes),
summed AS (SELECT *, cap::DOUBLE / w AS o,
  (sum(cap) OVER b - cap)::DOUBLE AS cap_before, (sum(w) OVER () - sum(w) OVER b + w)::DOUBLE AS w_left, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS wanted
  FROM weighed WINDOW b AS (ORDER BY cap::DOUBLE / w, source COLLATE "C" ASC NULLS LAST)),
leveled AS (SELECT *, (wanted - cap_before) / w_left AS lv FROM summed),
best AS (SELECT arg_min(lv, o) AS lv FROM leveled WHERE lv * w <= cap),
planned AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, best.lv * w), cap::DOUBLE) AS target FROM leveled CROSS JOIN best),
rated AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
  ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
  FROM sized JOIN planned ON sized.source IS NOT DISTINCT FROM planned.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""
