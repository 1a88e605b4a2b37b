"""Row numbers, running sums and exact quantiles that never need a whole key, or a whole table, in one task.

A plain window sorts each partition key in a single task. Here the rows of a key are first cut into *chunks* that
follow the sort order; windows run per (key, chunk), and the chunk totals, of which there are few, supply what came
before. One key may then hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tilewright.functions.draws import seeded_digest
from tilewright.session import pin

CHUNK = "_chunk"
DIGITS = 4      # hexadecimal digits of a digest that are counted at once
FEW = 20_000    # rows that are ranked in one task at most


def _name(df: DataFrame, order: Sequence[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def cut_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Range partition on keys and order, with the partition number as chunk, pinned so that it stays the same.

    The number of partitions is left to Spark, which merges neighbouring small ones; their numbers still follow the
    order.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *_name(df, order))
    return pin(ranged.withColumn(CHUNK, F.spark_partition_id()))


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rank",
                weight: str | None = None, total: str | None = None, chunked: bool = False) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` as column ``name``.

    ``weight`` makes it the running sum of that column, ``total`` adds the sum over the key. The order must be total
    within a key. With ``chunked`` the frame already has a chunk column that grows with the order.
    """
    keys = list(keys)
    if not chunked:
        df = cut_by_range(df, keys, order)
    amount = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    per_chunk = df.groupBy(*keys, CHUNK).agg(F.sum(amount).alias("_in_chunk"))
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    per_chunk = per_chunk.withColumn("_before", F.coalesce(F.sum("_in_chunk").over(before), F.lit(0)))
    if total is not None:
        per_chunk = per_chunk.withColumn(total, F.sum("_in_chunk").over(W.partitionBy(*keys)))
    inside = W.partitionBy(*keys, CHUNK).orderBy(*_name(df, order))
    local = F.row_number().over(inside) if weight is None else F.sum(weight).over(
        inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    per_chunk = per_chunk.drop("_in_chunk").withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)} | {CHUNK: "_at"})
    same = F.col(CHUNK) == F.col("_at")
    for i, k in enumerate(keys):  # a null key is a key like any other
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return (df.join(per_chunk, same)
            .withColumn(name, F.col("_before") + local)
            .drop(CHUNK, "_at", "_before", *[f"_key_{i}" for i in range(len(keys))]))


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rank",
                  total: str | None = None) -> DataFrame:
    """:func:`number_rows` where keys are small as a rule: those of up to ``FEW`` rows are numbered by a plain window, so that
    rows move once, by key. Only larger ones are cut into chunks. ``df`` is read twice, so pin what is expensive.
    """
    keys = list(keys)
    named = {k: f"_key_{i}" for i, k in enumerate(keys)}
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = pin(sizes.where(F.col("_n") > FEW).select(*[F.col(k).alias(n) for k, n in named.items()]))
    within = W.partitionBy(*keys)
    added = {name: F.row_number().over(within.orderBy(*_name(df, order))).cast("bigint")}
    if total is not None:
        added[total] = F.count(F.lit(1)).over(within)
    if large.isEmpty():
        return df.withColumns(added)
    same = F.lit(True)
    for k, n in named.items():  # a null key is a key like any other
        same = same & F.col(k).eqNullSafe(F.col(n))
    cut = number_rows(df.join(large, same, "left_semi"), keys, order, name, total=total)
    return df.join(large, same, "left_anti").withColumns(added).unionByName(cut)


def seeded_rank(df: DataFrame, keys: Sequence[str], seed: int | str, by: Sequence[str],
                name: str = "rank") -> DataFrame:
    """Number the rows of each key in seeded random order; ``by`` must identify a row within the key.

    The digest is uniform, so its first digits are ready-made chunks and no range sampling is needed.
    """
    cols = df.columns
    shuffled = df.withColumn("_digest", seeded_digest(seed, *[F.col(c) for c in by]))
    shuffled = pin(shuffled.withColumn(CHUNK, F.substring("_digest", 1, 3)))
    out = number_rows(shuffled, keys, ["_digest", *by], name, chunked=True)
    return out.select(*cols, name)


def seeded_first(df: DataFrame, group: str, quotas: dict[str, int], seed: int | str, by: Sequence[str]) -> DataFrame:
    """The rows that :func:`seeded_rank` numbers up to ``quotas`` in each group, without ranking, sorting or moving the rest.

    Rows are counted by the first digits of their digest. All below the digits at which the quota is reached are in; only
    those with the very digits are looked at again, by more digits until they are few, and the last few are ranked.
    Groups without a quota are left out. ``df`` is read once for each step, two as a rule, so pin what is expensive.
    """
    drawn = df.withColumn("_digest", seeded_digest(seed, *[F.col(c) for c in by]))
    rest = {g: ("", n) for g, n in quotas.items() if n > 0}  # digits in question, and rows still wanted from them
    sure, edge = F.lit(False), F.lit(False)
    wanted = F.lit(0)
    size = 0
    while rest:
        size += DIGITS
        mine = F.lit(False)
        quota = F.lit(0)
        for g, (digits, n) in rest.items():
            mine = mine | ((F.col(group) == g) & F.col("_digest").startswith(digits))
            quota = F.when(F.col(group) == g, F.lit(n)).otherwise(quota)
        counts = drawn.where(mine).groupBy(group, F.substring("_digest", 1, size).alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(W.partitionBy(group).orderBy("_at"))
        reached = {r[group]: r for r in counts.withColumns({"_upto": upto, "_quota": quota})
                   .where((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_n") < F.col("_quota"))).collect()}
        later = {}
        for g, (digits, n) in rest.items():
            if g not in reached:  # the quota is more than there is
                sure = sure | (F.col(group) == g)
                continue
            at, count, upto_at = (reached[g][c] for c in ("_at", "_n", "_upto"))
            left = n - (upto_at - count)
            same = F.substring("_digest", 1, size)
            sure = sure | ((F.col(group) == g) & (same <= at if left == count else same < at))
            if left == count:
                continue
            if count <= FEW or size >= 32:
                edge = edge | ((F.col(group) == g) & (same == at))
                wanted = F.when(F.col(group) == g, F.lit(left)).otherwise(wanted)
            else:
                later[g] = (at, left)
        rest = later
    place = F.row_number().over(W.partitionBy(group).orderBy("_digest", *by))
    last = drawn.where(edge).withColumn("_place", place).where(F.col("_place") <= wanted).drop("_place")
    return drawn.where(sure).unionByName(last).select(df.columns)


def seeded_subset(df: DataFrame, n: int, seed: int | str, by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows of a seeded random order, in any order."""
    return seeded_first(df.withColumn("_all", F.lit("all")), "_all", {"all": n}, seed, by).drop("_all")


def seeded_sample(df: DataFrame, n: int, seed: int | str, by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in seeded random order."""
    return seeded_subset(df, n, seed, by).orderBy(seeded_digest(seed, *[F.col(c) for c in by]), *by)


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float],
                    keys: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles per key, one column per entry of ``quantiles``.

    Equal values are merged before the shuffle, so heavy repeats cost nothing, and no task holds all values of a key.
    """
    keys = list(keys)
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v"))
              .agg(F.count(F.lit(1)).alias("_w")))
    ends = number_rows(counts, keys, ["_v"], "_end", weight="_w", total="_total")

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("_end") > position, F.col("_v")))

    aggs = [F.max("_total").alias("_total")]
    for label, q in quantiles.items():
        position = F.lit(float(q)) * (F.col("_total") - 1)
        aggs += [at(F.floor(position)).alias(f"_lo_{label}"), at(F.ceil(position)).alias(f"_hi_{label}")]
    found = ends.groupBy(*keys).agg(*aggs)
    out = []
    for label, q in quantiles.items():
        position = F.lit(float(q)) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo_{label}"), F.col(f"_hi_{label}")
        out.append((lo + (hi - lo) * (position - F.floor(position))).alias(label))
    return found.select(*keys, *out)
