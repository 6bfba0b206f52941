"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A document is expected in the mix as often as its source's target holds the source's words.
Within a source the expected copies are summed up in a fixed order, one offset drawn from the
source's name is added, and a document is taken once for each whole number its step crosses:
the expected number rounded down or up.  The order goes by size, so that neighbours weigh
nearly the same and the words taken come near the target, not only the number of documents.

The sums are taken in two steps, over blocks of a source and then inside each block, so no
source passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysift.llm.common import DOCUMENT, materialize, read_table, with_place, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
SEED = "mix"
# Expected copies are counted in units of this part of a copy, so sums are exact in any order.
UNIT = 1 << 26
# Blocks of a source: documents of like size, dealt over so many by a hash of the id.
DEALT = 32


def _fraction(text: Column) -> Column:
    """A number from 0 up to 1, in units, from the md5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long").bitwiseAND(
        F.lit(UNIT - 1))


def _name(source: Column) -> Column:
    """A text that differs between the null source and every other."""
    return F.coalesce(F.concat(F.lit(f"{SEED}:"), source), F.lit(SEED))


def targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
    most: int = MOST_REPEATS,
) -> DataFrame:
    """(source, source_size, target) of each source of ``sizes`` (source, size).

    Sources by code point, null last, weigh ``weights`` over and over, and share ``share`` times all
    sizes by weight.  None gets more than ``most`` times its own size: with sources in the order
    of the weight at which they are full, the level that all others reach follows from running
    sums.  A source without words has target 0.  Only one row for each source is ever in
    these windows; ``share`` is ``most`` at most.
    """
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = materialize(found, "sources")  # a row for each source
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), place % len(weights) + 1)
    weighed = found.withColumn("weight", weight.cast("long"))
    order = Window.orderBy(F.col("source_size") * most / F.col("weight"),
                           F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(whole) * share
             - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # The first source that isn't full at the level left by those before it, and all after it.
    levels = weighed.withColumn("level", level).withColumn(
        "open", F.col("level") * F.col("weight") < F.col("source_size") * most)
    reached = F.min(F.when(F.col("open"), F.struct(
        F.col("source_size") * most / F.col("weight"), F.col("level")))).over(whole)
    return levels.select(
        "source", "source_size",
        F.least(F.col("source_size") * float(most), F.coalesce(
            reached["level"] * F.col("weight"), F.col("source_size") * float(most))
        ).alias("target"))


def copies(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
    most: int = MOST_REPEATS,
) -> DataFrame:
    """(row, size, source_size, target, copies) of every row of ``docs`` (row, source, text).

    ``row`` is a struct with ``doc_id``.  Size is the number of words, 0 for a null text; a null
    source is a source of its own.  Copies lie between 0 and ``most``, and depend on nothing but
    the rows, so reruns agree; of rows with the same source, size and doc_id it is open which
    comes first.  A source without words is not taken.  An empty table gives no rows.
    """
    sized = materialize(
        docs.select("row", "source", word_count(F.col("text")).alias("size")), "sizes")
    goals = materialize(targets(sized, weights, share, most), "targets")
    # Steps of a factor of 1.09: documents of a block differ little.
    by_id = F.concat_ws(":", F.lit(SEED), F.col("row.doc_id").cast("string"))
    blocks = sized.select(
        "row", "source", "size",
        F.floor(F.log2(F.col("size") + 1) * 8).cast("int").alias("step"),
        (_fraction(by_id) % DEALT).cast("int").alias("dealt"))
    each = F.when(F.col("source_size") > 0, F.round(
        F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    rates = goals.withColumn("each", each).withColumn("offset", _fraction(_name(F.col("source"))))
    totals = blocks.groupBy("source", "step", "dealt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("step", "dealt").rowsBetween(
        Window.unboundedPreceding, -1)
    begins = totals.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    begins = begins.alias("b").join(
        rates.alias("r"), F.expr("b.source <=> r.source")).select(
        "b.source", "b.step", "b.dealt", "source_size", "target", "each",
        (F.col("earlier") * F.col("each") + F.col("offset")).alias("start"))
    inside = Window.partitionBy("source", "step", "dealt").orderBy("size", "row.doc_id")
    placed = blocks.withColumn("nth", F.row_number().over(inside))
    reached = placed.alias("p").join(begins.alias("b"), F.expr(
        "p.source <=> b.source AND p.step = b.step AND p.dealt = b.dealt"))
    end = F.col("start") + F.col("nth") * F.col("each")
    crossed = F.shiftright(end, 26) - F.shiftright(end - F.col("each"), 26)
    return reached.select("p.row", "p.size", "source_size", "target",
                          crossed.cast("long").alias("copies"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document."""
    docs = read_table(spark, sf_dir, "documents").select(
        F.struct("doc_id").alias("row"), "source", "text")
    return copies(docs).select("row.doc_id", "size", "source_size", "target",
                               (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix; one taken twice is there twice."""
    rows = with_place(docs.select("doc_id", "source", "text", F.struct(
        *[F.col(f"`{c}`") for c in docs.columns]).alias(DOCUMENT)))
    taken = copies(rows.select(F.struct("doc_id", "at").alias("row"), "source", "text"))
    taken = materialize(taken.where("copies > 0").select(
        F.col("row.at").alias("taken_at"), "copies"), "taken")
    return rows.select("at", DOCUMENT).join(
        taken.hint("merge"), F.col("at") == F.col("taken_at")).select(
        DOCUMENT, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        f"{DOCUMENT}.*")


# The same rows by the same rule; doubles are built by the same operations.
SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(length(translate(regexp_replace(coalesce(text, ''),
    '[^\\x20\\x09-\\x0D]+', 'x', 'g'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13),
    '')) AS BIGINT) AS size FROM documents),
found AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT)
    AS weight FROM found),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER before, 0) * 2)
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY source_size * 2 / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
reached AS (
  SELECT arg_min(level, source_size * 2 / weight) AS level FROM levels
  WHERE level * weight < source_size * 2),
goals AS (
  SELECT l.source, source_size, least(source_size * 2::DOUBLE,
    coalesce(r.level * weight, source_size * 2::DOUBLE)) AS target,
    CAST(('0x' || substr(md5(coalesce('{SEED}:' || l.source, '{SEED}')), 1, 8)) AS BIGINT)
      & {UNIT - 1} AS begin
  FROM levels l CROSS JOIN reached r),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target / source_size * {UNIT}) AS BIGINT)
    ELSE 0 END AS each FROM goals),
placed AS (
  SELECT doc_id, size, source, row_number() OVER (PARTITION BY source ORDER BY
    floor(log2(size + 1) * 8),
    (CAST(('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT)
      & {UNIT - 1}) % {DEALT}, size, doc_id) AS nth
  FROM sized)
SELECT doc_id, size, source_size, target, size * (
  ((nth * each + begin) >> 26) - (((nth - 1) * each + begin) >> 26)) AS taken
FROM placed p JOIN rates r ON p.source IS NOT DISTINCT FROM r.source
"""
