"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source gets a share of the word budget in proportion to its weight, but
no more than `max_epochs` times its own size. What a capped source can't take
is shared among the others by weight until nobody is above the cap. The end of
that process has a closed form: order the sources by cap / weight; a source is
capped if its cap is at most its share of what the capped ones before it leave.

Inside a source, whole repetitions go to every document and the rest is drawn
in a seeded order: documents take one more repetition until the target is
reached, and the document that crosses it gives only a part of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blocktrace.llm.common import WORD, fresh, settle

#: Leading hex digits of the seeded order that cut a source into 16 ** 3 parts.
BUCKET_DIGITS = 3
WIDE = "decimal(38,0)"


def word_count(column: str | Column) -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_order(seed: str) -> Column:
    """Place of a document in the seeded order of its source."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def source_key() -> Column:
    """The source as a value that is never null."""
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget_percent: int, max_epochs: int) -> DataFrame:
    """One row per source: `source`, `source_size` and the `target` in words.

    `sizes` has one row per source (`source`, `source_size`). Weights repeat
    over the sources in code-point order, null last. All comparisons are made
    on integers, so that ties come out alike everywhere.
    """
    everything = Window.partitionBy()
    ranked = sizes.select(
        "source", "source_size",
        F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("_rank"),
    ).select(
        "source", "source_size",
        F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
        .cast("long").alias("_weight"),
        (F.col("source_size") * max_epochs).alias("_cap"),
        "_rank")
    before = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.select(
        "*",
        (F.sum("source_size").over(everything) * budget_percent).alias("_budget"),
        F.sum("_weight").over(everything).alias("_weights"),
        F.coalesce(F.sum("_cap").over(before), F.lit(0)).alias("_caps_before"),
        F.coalesce(F.sum("_weight").over(before), F.lit(0)).alias("_weights_before"))
    left = (F.col("_budget") - 100 * F.col("_caps_before")).cast(WIDE)
    capped = (F.col("_cap") * 100).cast(WIDE) * (F.col("_weights") - F.col("_weights_before")) <= left * F.col("_weight")
    filled = filled.withColumn("_capped", capped)
    for name, column in (("_caps", "_cap"), ("_capped_weights", "_weight")):
        filled = filled.withColumn(name, F.sum(F.when(F.col("_capped"), F.col(column)).otherwise(0)).over(everything))
    share = ((F.col("_budget") - 100 * F.col("_caps")) * F.col("_weight")).cast("double") / \
        (100 * (F.col("_weights") - F.col("_capped_weights"))).cast("double")
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(share)
    return filled.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), budget_percent: int = 150,
                max_epochs: int = 2, seed: str = "mix") -> DataFrame:
    """Words that the mix takes of every document.

    Returns one row per row of `docs`: `doc_id`, `source`, `size` (words of the
    text), `source_size`, `target` (of its source) and `taken`. Null text has
    size 0; null is a source of its own, the last one; a null id is ordered
    like an empty one; equal rows follow each other. Documents without words
    take 0. An empty table gives an empty result.
    """
    order = seeded_order(seed)
    sized = settle(docs.select("doc_id", "source", word_count("text").alias("size")), "mix-sizes")
    keyed = sized.select(
        "*", order.alias("_order"),
        source_key().alias("_key"),
    ).withColumn("_part", F.substring("_order", 1, BUCKET_DIGITS))
    # A part of a source is one group: the seeded order deals a hot source out evenly.
    parts = settle(keyed.groupBy("_key", "_part").agg(F.first("source").alias("source"), F.sum("size").alias("_words")),
                   "mix-parts")
    targets = source_targets(parts.groupBy("source").agg(F.sum("_words").alias("source_size")),
                             weights, budget_percent, max_epochs)
    along = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.select("_key", "_part", "source", F.coalesce(F.sum("_words").over(along), F.lit(0)).alias("_ahead"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    planned = (placed.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
               .select("_key", "_part", "_ahead", "source_size", "target", epochs.cast("long").alias("_epochs"))
               .withColumn("_rest", F.floor(F.col("target") + 0.5).cast("long")
                           - F.col("_epochs") * F.col("source_size")))
    inside = (Window.partitionBy("_key", "_part").orderBy("_order", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    running = keyed.withColumn("_earlier", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    extra = F.least(F.col("size"), F.greatest(F.lit(0), F.col("_rest") - F.col("_ahead") - F.col("_earlier")))
    return running.join(planned, ["_key", "_part"]).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("_epochs") * F.col("size") + extra).alias("taken"))


def mixed_documents(docs: DataFrame, *, seed: str = "mix", **options) -> DataFrame:
    """The mix itself: rows of `docs`, each as often as it is taken.

    In the seeded order of a source, the rows before one place take a
    repetition more than those after it, and the row at that place gives a part
    of its words. So one row per source says it all, and no text is shuffled.
    A whole repetition is the row as it is. A part is its first words with the
    white space before them, with `n_chars` counted anew. Rows that the mix
    doesn't take and rows without words are left out. Equal rows at the place
    of the part share it equally, rounded down.
    """
    order = seeded_order(seed)
    repetitions = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rows = settle(mix_sources(docs, seed=seed, **options).select(
        source_key().alias("_key"), F.struct(order.alias("o"), F.col("size").alias("s")).alias("_place"),
        repetitions.cast("int").alias("_whole"), (F.col("taken") - repetitions.cast("long") * F.col("size")).alias("_extra")),
        "mix-rows")
    cuts = rows.groupBy("_key").agg(F.first("_whole").alias("whole"), F.max(F.when(F.col("_extra") > 0, F.col("_place"))).alias("cut"))
    parts = (rows.join(settle(cuts, "mix-cuts"), "_key").filter("_place = cut").groupBy("_key")
             .agg(F.floor(F.sum("_extra") / F.count(F.lit(1))).alias("part")))
    plan = fresh(docs, "_plan")
    cut = settle(cuts.join(parts, "_key", "left").select(
        F.col("_key").alias(f"{plan}k"), F.struct("whole", "cut", F.coalesce("part", F.lit(0)).alias("part")).alias(plan)), "mix-cuts")
    marked = docs.join(cut, source_key() == F.col(f"{plan}k")).filter(F.col("text").rlike(WORD))

    whole, at, part = (F.col(plan)[name] for name in ("whole", "cut", "part"))
    # The words of a row are counted only where its order is that of the cut.
    size = F.when(order == at["o"], word_count("text"))
    before = F.coalesce(order < at["o"], F.lit(False)) | F.coalesce(size < at["s"], F.lit(False))
    inside = F.coalesce(size == at["s"], F.lit(False))
    full = before | (inside & (part >= at["s"]))
    rest = F.when(inside & ~full, part).otherwise(0).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), whole + full.cast("int")), F.array_repeat(rest, (rest > 0).cast("int")))
    words = F.col(f"{plan}w")
    pieces = F.expr(r"regexp_extract_all(text, r'([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)', 1)")
    cut_text = F.array_join(F.slice(pieces, F.lit(1), F.greatest(words, F.lit(1))), "")
    out = marked.select("*", F.explode(copies).alias(f"{plan}w")).withColumn(
        "text", F.when(words < 0, F.col("text")).otherwise(cut_text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(words < 0, F.col("n_chars")).otherwise(
            F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat('mix:', coalesce(doc_id::VARCHAR, ''))) AS seeded
  FROM documents),
sources AS (SELECT source, sum(size)::HUGEINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::HUGEINT AS weight,
         2 * source_size AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sources),
filled AS (
  SELECT *, 150 * sum(source_size) OVER () AS budget, sum(weight) OVER () AS weights,
         coalesce(sum(cap) OVER before, 0) AS caps_before, coalesce(sum(weight) OVER before, 0) AS weights_before
  FROM ranked
  WINDOW before AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (
  SELECT *, 100 * cap * (weights - weights_before) <= (budget - 100 * caps_before) * weight AS capped FROM filled),
levels AS (
  SELECT *, sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS caps,
         sum(CASE WHEN capped THEN weight ELSE 0 END) OVER () AS capped_weights FROM judged),
targets AS (
  SELECT source, source_size::BIGINT AS source_size,
         CASE WHEN capped THEN cap::DOUBLE
              ELSE ((budget - 100 * caps) * weight)::DOUBLE / (100 * (weights - capped_weights))::DOUBLE END AS target
  FROM levels),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
running AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY seeded, doc_id, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM sized)
SELECT r.doc_id, r.size, p.source_size, p.target,
       (p.epochs * r.size + least(r.size, greatest(
          0, floor(p.target + 0.5)::BIGINT - p.epochs * p.source_size - r.earlier)))::BIGINT AS taken
FROM running r JOIN planned p ON r.source IS NOT DISTINCT FROM p.source
"""
