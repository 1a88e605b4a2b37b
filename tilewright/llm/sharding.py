"""Sharding by sampled splitters (DataFrame functions only).

Rows are ordered by (hash of the text, hash of the identifier). A size-weighted sample of keys gives splitters, the
splitters cut the key space into many fine ranges, ranges that came out overfull get splitters of their own, and exact
totals per range place the 24 (or ``shards``) boundaries, so shard sizes differ by about one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tilewright.llm.common import keep, table

SHARDS = 24
RANGES_PER_SHARD = 32     # fine ranges for each shard
DRAWS_PER_RANGE = 8       # sampled keys for each fine range
OVERFULL = 2.0            # times the mean size of a range


def _splitter_column(splitters: list[tuple[int, int]], key: Column) -> Column:
    """Number of splitters at or below the key, found in two steps of about sqrt(n) comparisons."""
    if not splitters:
        return F.lit(0)
    step = max(1, round(len(splitters) ** 0.5))
    blocks = [splitters[i:i + step] for i in range(0, len(splitters), step)]
    pair = "struct<h:bigint,d:bigint>"
    tops = F.from_json(F.lit(_json([b[0] for b in blocks])), f"array<{pair}>")
    nested = F.from_json(F.lit("[" + ",".join(_json(b) for b in blocks) + "]"), f"array<array<{pair}>>")
    block = F.size(F.filter(tops, lambda x: x <= key))
    inside = F.size(F.filter(F.element_at(nested, F.greatest(block, F.lit(1))), lambda x: x <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * step + inside)


def _json(pairs: list[tuple[int, int]]) -> str:
    return "[" + ",".join(f'{{"h":{h},"d":{d}}}' for h, d in pairs) + "]"


def _draw(rows: DataFrame, n: int, total: int) -> list[tuple[int, int]]:
    """About ``n`` keys, drawn with probability by size: those that arrive first when every byte arrives at rate 1.

    Bytes arrive at the rate ``total`` in all, so ``n / total`` is the time by which about ``n`` are there; a key counts
    once. No task sorts or sends more than its share.
    """
    uniform = (F.pmod(F.xxhash64("_h", "_d", F.lit("draw")), F.lit(2 ** 40)) + 1) / float(2 ** 40 + 1)
    arrival = -F.log(uniform) / F.col("_size")
    drawn = rows.where((F.col("_size") > 0) & (arrival <= n / max(total, 1))).select("_h", "_d").distinct()
    return sorted((r["_h"], r["_d"]) for r in drawn.collect())


def _quantiles(sample: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []


def assign_shards(df: DataFrame, size: Column, shards: int = SHARDS, key: Column | None = None,
                  tie: list[Column] | None = None, ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """Add ``_size``, ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in the shard) to every row.

    ``size`` is a non-negative number of bytes. Rows with equal ``key`` are neighbours, so they share a shard unless a
    boundary falls among them; ``tie`` orders them. Equal rows are interchangeable. Empty input gives no rows; rows that
    all have size 0 go to shards by their count. Only the sample (``shards * ranges_per_shard * 8`` keys), the totals of
    the fine ranges and the first row numbers of the shards reach the driver, whatever the input.
    """
    spark_tie = tie or []
    keyed = df.withColumns({"_size": size.cast("long"), "_h": F.xxhash64(key) if key is not None else F.lit(0).cast("long"),
                            "_d": F.xxhash64(*spark_tie) if spark_tie else F.xxhash64(*df.columns)})
    keyed = keep(keyed)
    n_ranges = shards * ranges_per_shard
    total_bytes = keyed.agg(F.sum("_size")).head()[0] or 0
    splitters = _quantiles(_draw(keyed, n_ranges * DRAWS_PER_RANGE, total_bytes), n_ranges)
    point = F.struct(F.col("_h").alias("h"), F.col("_d").alias("d"))

    def totals(found: DataFrame) -> list:
        return (found.groupBy("_range").agg(F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("rows"),
                                            F.min(point).alias("low"), F.max(point).alias("high"))
                .orderBy("_range").collect())

    ranged = keyed.withColumn("_range", _splitter_column(splitters, point))
    per_range = totals(ranged)
    for _ in range(4):
        mean = total_bytes / n_ranges
        full = [r for r in per_range if r["bytes"] > OVERFULL * mean and r["low"] != r["high"]]
        more = {}
        if full:
            within = ranged.where(F.col("_range").isin([r["_range"] for r in full]))
            cuts = sum(int(r["bytes"] / mean) for r in full)
            sample = _draw(within, cuts * DRAWS_PER_RANGE, sum(r["bytes"] for r in full))
            for r in full:
                low, high = tuple(r["low"]), tuple(r["high"])
                inside = [k for k in sample if low < k <= high]
                more[r["_range"]] = _quantiles(inside, max(2, int(r["bytes"] / mean)))
        new = sorted({*splitters, *(k for keys in more.values() for k in keys)})
        if len(new) == len(splitters):
            break
        splitters = new
        ranged = keyed.withColumn("_range", _splitter_column(splitters, point))
        per_range = totals(ranged)

    offsets, bytes_before, rows_before = [], 0, 0
    for r in per_range:
        offsets.append((r["_range"], bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + r["bytes"], rows_before + r["rows"]
    spark = df.sparkSession
    before = spark.createDataFrame(offsets, "_range int, _bytes_before long, _rows_before long")
    order = W.partitionBy("_range").orderBy("_h", "_d", *spark_tie)
    running = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (ranged.join(F.broadcast(before), "_range")
              .withColumns({"_end": F.col("_bytes_before") + F.sum("_size").over(running),
                            "_row": F.col("_rows_before") + F.row_number().over(order) - 1}))
    if total_bytes:
        middle = (2 * F.col("_end") - F.col("_size")).cast("decimal(38,0)")
        shard = F.floor(middle * shards / F.lit(2 * total_bytes).cast("decimal(38,0)"))
    else:
        shard = F.floor(F.col("_row") * shards / F.lit(max(rows_before, 1)))
    placed = keep(placed.withColumn("shard", F.least(shard.cast("int"), F.lit(shards - 1))))
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row for each shard
    return (placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_row") - F.col("_first"))
            .drop("_h", "_d", "_range", "_bytes_before", "_rows_before", "_end", "_row", "_first"))


def document_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def op6(spark, sf_dir: str) -> DataFrame:
    """All documents by law ``bytes``. Null or repeated identifiers and texts are ordinary rows."""
    narrow = table(spark, sf_dir, "documents").select(
        "doc_id", document_size(F.col("text")).alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"))
    placed = assign_shards(narrow, F.col("size"), SHARDS, F.col("text_hash"),
                           [F.col("doc_id"), F.col("size"), F.col("text_crc32")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def shard_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row it gets, with ``shard`` and ``slot`` in place of columns of those names."""
    rows = docs.select(F.struct(*docs.columns).alias("r"), document_size(docs["text"]).alias("size"),
                       F.xxhash64(docs["text"]).alias("text_hash"), docs["doc_id"].alias("id"))
    placed = assign_shards(rows, F.col("size"), SHARDS, F.col("text_hash"), [F.col("id"), F.xxhash64("r")])
    return placed.select(*[F.col("r")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")
