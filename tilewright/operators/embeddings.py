"""Nearest neighbours, projection and clustering of object embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from tilewright.functions.draws import seeded_digest
from tilewright.operators.grids import l2_normalize
from tilewright.operators.selection import top_per_key
from tilewright.session import pin

MAX_PIVOTS = 256
BLOCK_ROWS = 4096    # vectors of a block
COMPARE_ROWS = 512   # vectors that are compared with a block at once
VISIT_ROWS = 2048    # vectors whose distances to all pivots are looked at at once


def _stack(column: pd.Series, dim: int) -> np.ndarray:
    return np.asarray(column.tolist(), dtype=np.float64).reshape(-1, dim)


def _pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = (vectors ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None, :] - 2.0 * vectors @ pivots.T
    return np.sqrt(np.maximum(sq, 0.0))


def _block_layout(count: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each pivot's cell. Small cells of pivots that are close share a block."""
    first, parts = np.zeros(len(count), np.int64), np.ones(len(count), np.int64)
    left, at, filled, block = set(range(len(count))), 0, 0, 0
    while left:
        left.discard(at)
        if filled and filled + count[at] > BLOCK_ROWS:
            block, filled = block + 1, 0
        first[at], parts[at] = block, max(1, -(-count[at] // BLOCK_ROWS))
        block, filled = block + parts[at] - 1, filled + count[at]
        if left:
            rest = np.array(sorted(left))
            at = int(rest[((pivots[rest] - pivots[at]) ** 2).sum(1).argmin()])
    return first, parts


def knn_graph(vectors: DataFrame, k: int = 30, metric: str = "cosine", vec: str = "embedding",
              id_col: str = "vec_id") -> DataFrame:
    """Exact ``k`` nearest neighbours of every vector: rows ``id, rank, neighbor, distance``; ties go to the lower id.

    Equal vectors are merged, and of each only the ``k+1`` lowest ids can matter. The rest is partitioned around at most
    256 pivots, whose cells are cut or put together into blocks of about ``BLOCK_ROWS``. The triangle inequality gives
    each vector an upper bound for its k-th distance; a pair of blocks is compared if any vector of the one may have
    something nearer in the other. Only the pairs of numbers are listed, vectors travel once for each block they meet. A
    task compares one pair of blocks, a part of the rows at a time, and returns ``k+1`` candidates per vector.
    """
    spark = vectors.sparkSession
    raw = F.transform(F.col(vec), lambda v: v.cast("double"))
    unit = l2_normalize(raw) if metric == "cosine" else raw
    rows = pin(vectors.select(F.col(id_col).cast("bigint").alias("id"), unit.alias("v")))

    groups = rows.groupBy("v").agg(F.min("id").alias("gid"))
    lowest = (top_per_key(rows, ["v"], [F.col("id")], k + 1).groupBy("v")
              .agg(F.array_sort(F.collect_list("id")).alias("ids")))
    points = pin(groups.join(lowest, "v"))

    n = points.count()
    n_pivots = max(1, min(MAX_PIVOTS, int(np.sqrt(n))))
    chosen = points.orderBy(seeded_digest("pivot", F.col("gid")), "gid").limit(n_pivots).select("v").collect()
    pivots = np.asarray([r["v"] for r in chosen], dtype=np.float64)
    dim = pivots.shape[1] if len(chosen) else 0
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = _pivot_distances(_stack(pdf["v"], dim), shared.value)
            cell = d.argmin(1)
            yield pdf.assign(cell=cell.astype(np.int32), reach=d[np.arange(len(d)), cell])

    assigned = pin(points.select("gid", "v").mapInPandas(assign, "gid bigint, v array<double>, cell int, reach double"))
    cells = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("r")).collect()
    count, radius = np.zeros(n_pivots, dtype=np.int64), np.full(n_pivots, -np.inf)
    for c in cells:
        count[c["cell"]], radius[c["cell"]] = c["n"], c["r"]
    first, parts = _block_layout(count, pivots)
    layout = spark.sparkContext.broadcast((count, radius, first, parts))

    def block_of(gid: np.ndarray, cell: np.ndarray) -> np.ndarray:
        _, _, first, parts = layout.value
        mixed = (gid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return first[cell] + (mixed % parts[cell].astype(np.uint64)).astype(np.int64)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            block = block_of(pdf["gid"].to_numpy(), pdf["cell"].to_numpy())
            yield pdf[["gid", "v"]].assign(block=block.astype(np.int32))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n_in, r, first, parts = layout.value
        n_blocks = int((first + parts).max(initial=0))
        for whole in batches:
            for lo in range(0, len(whole), VISIT_ROWS):
                pdf = whole.iloc[lo:lo + VISIT_ROWS]
                d = _pivot_distances(_stack(pdf["v"], dim), shared.value)
                far = np.where(n_in > 0, d + r, np.inf)
                order = np.argsort(far, axis=1)
                seen = np.cumsum(n_in[order], axis=1)
                stop = np.minimum((seen >= k + 1).argmax(1) + np.where(seen[:, -1] >= k + 1, 0, n_pivots), n_pivots - 1)
                bound = np.where(seen[:, -1] >= k + 1, far[np.arange(len(d)), order[np.arange(len(d)), stop]], np.inf)
                near = np.where(n_in > 0, d - r, np.inf)
                q, c = np.nonzero((near <= bound[:, None] + 1e-9) & (n_in > 0))
                mine = block_of(pdf["gid"].to_numpy(), pdf["cell"].to_numpy())
                both = np.unique(mine[q] * n_pivots + c)
                qb, c = both // n_pivots, both % n_pivots
                of = np.repeat(np.arange(len(c)), parts[c])
                cb = first[c][of] + np.arange(len(of)) - (np.cumsum(parts[c]) - parts[c])[of]
                both = np.unique(qb[of] * n_blocks + cb)
                yield pd.DataFrame({"qb": (both // n_blocks).astype(np.int32), "cb": (both % n_blocks).astype(np.int32)})

    placed = pin(assigned.select("gid", "v", "cell").mapInPandas(place, "gid bigint, v array<double>, block int"))
    wanted = pin(assigned.select("gid", "v", "cell").mapInPandas(visits, "qb int, cb int").distinct())
    questions = placed.join(wanted, F.col("block") == F.col("qb")).select("qb", "cb", "gid", "v")
    answers = placed.join(wanted, F.col("block") == F.col("cb")).select(*[F.col(c).alias(f"_{c}") for c in ("qb", "cb", "gid", "v")])

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"gid": [], "cand": [], "sq": []}).astype({"gid": "int64", "cand": "int64"})
        b, ids = _stack(right["_v"], dim), right["_gid"].to_numpy()
        gids = left["gid"].to_numpy()
        m = min(k + 1, len(ids))
        out = []
        for lo in range(0, len(left), COMPARE_ROWS):
            a = _stack(left["v"].iloc[lo:lo + COMPARE_ROWS], dim)
            if metric == "cosine":
                sq = 2.0 - 2.0 * (a @ b.T)
            else:
                sq = (a ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None, :] - 2.0 * a @ b.T
            row, col = np.nonzero(sq <= np.partition(sq, m - 1, axis=1)[:, m - 1:m])  # ties of the last one too
            by = np.lexsort((ids[col], sq[row, col], row))
            row, col = row[by], col[by]
            place_in_row = np.arange(len(row)) - np.searchsorted(row, row)
            row, col = row[place_in_row < m], col[place_in_row < m]
            out.append(pd.DataFrame({"gid": gids[lo + row], "cand": ids[col], "sq": np.maximum(sq[row, col], 0.0)}))
        return pd.concat(out, ignore_index=True)

    found = (questions.groupBy("qb", "cb").cogroup(answers.groupBy("_qb", "_cb"))
             .applyInPandas(nearest, "gid bigint, cand bigint, sq double"))
    found = found.withColumn("sq", F.when(F.col("gid") == F.col("cand"), F.lit(0.0)).otherwise(F.col("sq")))
    expanded = (top_per_key(found, ["gid"], [F.col("sq"), F.col("cand")], k + 1)
                .join(points.select(F.col("gid").alias("cand"), "ids"), "cand")
                .select("gid", "sq", F.explode("ids").alias("nb")))
    lists = (top_per_key(expanded, ["gid"], [F.col("sq"), F.col("nb")], k + 1).groupBy("gid")
             .agg(F.array_sort(F.collect_list(F.struct("sq", "nb"))).alias("_l")))
    members = rows.join(groups, "v").select("id", "gid")
    dist = F.col("_x.sq") / 2.0 if metric == "cosine" else F.sqrt("_x.sq")
    return (members.join(lists, "gid")
            .select("id", F.posexplode(F.slice(F.filter("_l", lambda e: e["nb"] != F.col("id")), 1, k)).alias("_p", "_x"))
            .select("id", (F.col("_p") + 1).alias("rank"), F.col("_x.nb").alias("neighbor"), dist.alias("distance")))


def project_2d(vectors: DataFrame, vec: str = "embedding", out: str = "xy") -> DataFrame:
    """First two principal components as an array of two doubles."""
    features = vectors.withColumn("_f", array_to_vector(F.transform(vec, lambda v: v.cast("double"))))
    model = PCA(k=2, inputCol="_f", outputCol="_p").fit(features)
    return model.transform(features).withColumn(out, vector_to_array("_p")).drop("_f", "_p")


def cluster_count(wanted: int, n_objects: int) -> int:
    """Number of clusters, reduced when there are fewer objects than clusters."""
    k = max(2, wanted)
    return k if n_objects >= k else max(2, min(n_objects, 8))


def cluster_objects(objects: DataFrame, num_clusters: int, vec: str = "xy", seed: int = 42, n_init: int = 10) -> DataFrame:
    """Column ``cluster`` from the k-means run with the lowest cost among ``n_init`` seeds."""
    ready = pin(objects.withColumn("_f", array_to_vector(F.transform(vec, lambda v: v.cast("double")))))
    k = cluster_count(num_clusters, ready.count())
    best = None
    for i in range(n_init):
        model = KMeans(k=k, seed=seed + i, featuresCol="_f", predictionCol="cluster").fit(ready)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best.transform(ready).drop("_f")


def write_projection_run(objects: DataFrame, path: str, run_key: str) -> None:
    """Store the projection of one named run, replacing an earlier run of that name and leaving the others alone."""
    key = run_key.strip() or "obj_umap"
    (objects.withColumn("run_key", F.lit(key)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_key").parquet(path))
