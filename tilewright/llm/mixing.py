"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Each source asks for its weight's share of a budget of words. Sources above ``max_epochs`` times their size are clamped
there and the excess goes to the others by weight, until none is above. A source's target then is a whole number of
passes over its documents plus a fraction; the fraction is taken in a seeded order up to the running sum of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tilewright.llm.common import WORD, keep, table
from tilewright.operators.ranking import cut_by_range, number_rows

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = "mix"


def water_level(sources: DataFrame, budget: float) -> tuple[float, float]:
    """(level, cap ratio): a source with weight w and cap c gets c if c/w is at most the ratio, else level * w.

    ``sources`` has ``_weight`` and ``_cap``. Every round clamps the sources above the level and raises it for the rest;
    a clamped source stays clamped, so the rounds end. Only one row of sums reaches the driver in each.
    """
    ratio = F.col("_cap") / F.col("_weight")
    clamped_at = -1.0
    while True:
        r = sources.agg(F.sum(F.when(ratio <= clamped_at, F.col("_cap"))).alias("caps"),
                        F.sum(F.when(ratio > clamped_at, F.col("_weight"))).alias("weights")).head()
        if not r["weights"]:
            return 0.0, clamped_at
        level = (budget - (r["caps"] or 0)) / r["weights"]
        above = sources.where((ratio > clamped_at) & (ratio < level)).agg(F.max(ratio)).head()[0]
        if above is None:
            return level, clamped_at
        clamped_at = above


def mix(df: DataFrame, size: Column, source: Column, identity: list[Column], weights: tuple[int, ...] = WEIGHTS,
        budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: str = SEED, tie: Column | None = None) -> DataFrame:
    """Add ``_size``, ``_source_size``, ``_target``, ``_copies`` to every row.

    Sources are taken by code point with null last and get ``weights`` in turn; they share ``budget`` times all sizes.
    Documents come in the order of the digest of their ``identity``, then of size, ``tie`` and a row number, in chunks
    that are ranges of that order; so one source, or one identity, may hold any share of the rows. Rows equal in all but
    the number are interchangeable. A source of size 0 has target 0 and its documents no copies. Empty input gives no rows.
    """
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in identity]))
    whole_rows = keep(df.withColumns({"_size": size.cast("long"), "_source": source, "_digest": digest,
                                      "_tie": F.lit(0) if tie is None else tie, "_row": F.monotonically_increasing_id()}))
    order = ["_digest", "_size", "_tie", "_row"]
    rows = cut_by_range(whole_rows.select("_source", *order), ["_source"], order)
    per_chunk = keep(rows.groupBy("_source", "_chunk").agg(F.sum("_size").alias("_in_chunk")))
    sizes = per_chunk.groupBy("_source").agg(F.sum("_in_chunk").alias("_source_size"))
    ordered = sizes.withColumn("_null", F.col("_source").isNull())
    ordered = number_rows(ordered, [], ["_null", "_source"], "_nth")
    table_of = F.array(*[F.lit(int(w)) for w in weights])
    sources = keep(ordered.withColumns({
        "_weight": F.element_at(table_of, (F.pmod(F.col("_nth") - 1, F.lit(len(weights))) + 1).cast("int")),
        "_cap": F.col("_source_size") * max_epochs}).drop("_null", "_nth"))
    total = sources.agg(F.sum("_source_size")).head()[0] or 0
    level, clamped_at = water_level(sources, budget * total)
    target = F.when(F.col("_cap") / F.col("_weight") <= clamped_at, F.col("_cap").cast("double")).otherwise(
        F.col("_weight") * F.lit(float(level)))
    sources = sources.withColumn("_target", target).withColumn(
        "_whole", F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(0))
    sources = sources.withColumn("_part", F.col("_target") - F.col("_whole") * F.col("_source_size"))
    before = W.partitionBy("_source").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    filled = per_chunk.withColumn("_before", F.coalesce(F.sum("_in_chunk").over(before), F.lit(0)))
    s = sources.select(F.col("_source").alias("_s"), "_source_size", "_target", "_whole", "_part")
    filled = filled.join(s, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s", "_in_chunk")
    filled = filled.withColumnsRenamed({"_source": "_s", "_chunk": "_c"})
    joined = rows.join(filled, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_chunk") == F.col("_c"))).drop("_s", "_c")
    so_far = W.partitionBy("_source", "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.col("_before") + F.sum("_size").over(so_far)
    taken = (2 * end - F.col("_size") <= 2 * F.col("_part")) & (F.col("_part") > 0)
    placed = keep(joined.withColumn("_in", taken).drop("_before"))
    flips = _nearest_flip(placed, filled.select("_s", "_c"))
    flipped = F.col("_flip").isNotNull() != F.col("_in")
    copies = (placed.join(flips, F.col("_row") == F.col("_fr"), "left")
              .withColumn("_copies", (F.col("_whole") + flipped.cast("int")).cast("int"))
              .select(F.col("_row").alias("_r"), "_source_size", "_target", "_copies"))
    return (whole_rows.join(copies, F.col("_row") == F.col("_r"))
            .drop("_source", "_digest", "_tie", "_row", "_r"))


def _nearest_flip(placed: DataFrame, chunks: DataFrame) -> DataFrame:
    """(_fr, _flip): number of one row for each source that brings the source nearer to its target.

    The order ends within half a document of the target, which may be a long one. The document whose size is nearest to
    what is missing is taken too, or the one nearest to the excess is left out, if that helps.
    """
    got = F.sum(F.when(F.col("_in"), F.col("_size")).otherwise(0))
    sums = placed.groupBy("_source", "_chunk").agg(got.alias("g"), F.max("_part").alias("p"))
    missing = sums.groupBy("_source").agg((F.max("p") - F.sum("g")).alias("_missing")).withColumnRenamed("_source", "_m")
    by_chunk = chunks.join(missing, F.col("_s").eqNullSafe(F.col("_m"))).drop("_m")
    rows = placed.select("_source", "_chunk", "_digest", "_size", "_tie", "_row", "_in").join(
        by_chunk, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_chunk") == F.col("_c")))
    gap = F.abs(F.abs("_missing") - F.col("_size"))
    useful = (F.col("_in") == (F.col("_missing") < 0)) & (gap < F.abs("_missing"))
    best = rows.where(useful).groupBy("_source").agg(F.min(F.struct(gap.alias("g"), "_digest", "_size", "_tie", "_row")).alias("b"))
    return best.select(F.col("b._row").alias("_fr"), F.lit(True).alias("_flip"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def op8(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document (null text: none)."""
    narrow = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix(narrow, F.col("size"), F.col("source"), [F.col("doc_id")])
    return mixed.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
                        (F.col("_copies") * F.col("size")).cast("long").alias("taken"))


OP8_SQL = r"""
with d as (select doc_id, source,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                  md5('mix|' || coalesce(doc_id::varchar, 'null')) as digest from documents),
s as (select source, sum(size)::bigint as source_size,
             [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from d group by source),
r as (select *, 2 * source_size as cap, (2 * source_size) / weight as ratio,
             coalesce(sum(2 * source_size) over (order by (2 * source_size) / weight
                 range between unbounded preceding and current row exclude group), 0) as caps,
             sum(weight) over () - coalesce(sum(weight) over (order by (2 * source_size) / weight
                 range between unbounded preceding and current row exclude group), 0) as weights,
             1.5::double * sum(source_size) over () as budget from s),
l as (select arg_min((budget - caps) / weights, ratio) filter (where ratio >= (budget - caps) / weights) as level from r),
t as (select source, source_size, case when ratio < level then cap::double else weight * level end as target from r, l),
p as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from t),
o as (select d.*, source_size, target, whole, target - whole * source_size as part,
             target - whole * source_size > 0 and
             2 * sum(size) over (partition by d.source order by digest, size rows unbounded preceding) - size
             <= 2 * (target - whole * source_size) as chosen
      from d join p on d.source is not distinct from p.source),
m as (select *, part - sum(case when chosen then size else 0 end) over (partition by source) as missing from o),
f as (select *, chosen = (missing < 0) and abs(abs(missing) - size) < abs(missing) as useful from m),
x as (select *, useful and row_number() over (partition by source, useful order by abs(abs(missing) - size), digest) = 1
             as flip from f)
select doc_id, size, source_size, target, (size * (whole + (chosen != flip)::int))::bigint as taken from x
"""


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row as often as the mix takes it, with the columns it came with."""
    columns = docs.columns
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    at = {c: F.col(f"c{i}") for i, c in enumerate(columns)}
    mixed = mix(inner, word_count(at["text"]), at["source"], [at["doc_id"]], tie=F.xxhash64(at["text"]))
    copies = mixed.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return copies.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
