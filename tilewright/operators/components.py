"""Eight-neighbour components of masks, by union of runs.

A run ``(image_id, gy, xs, xe)`` is a stretch of neighbouring cells in a grid row, as long as it gets. Two runs of
neighbouring rows touch if their intervals, grown by one cell, overlap. Rows are dealt out in bands; each band is linked
inside a task, by interval look-ups over sorted runs. Only runs on both sides of a band edge take part in a distributed
merge, whose rounds at least halve the number of open components and are checkpointed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tilewright.session import pin

BAND = 64    # grid rows of a band
PIECE = 64   # columns in which runs of neighbouring bands look for each other


def _merge_edges(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest member index of each node's component."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        open_ = a != b
        if not open_.any():
            break
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            nxt = root[root]
            if (nxt == root).all():
                break
            root = nxt
    return root


def touching(band: np.ndarray, gy: np.ndarray, xs: np.ndarray, xe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs of one band that touch. Runs are sorted by band, row and column and don't overlap within a row."""
    width = int(xe.max(initial=0)) + 4
    row = np.cumsum(np.concatenate([[0], np.where(np.diff(band) != 0, 2, np.diff(gy))]))  # 1 apart: neighbours of one band
    start, end = row * width + xs + 1, row * width + xe + 1
    below = (row + 1) * width
    first = np.searchsorted(end, below + xs)                       # ends at or after the column before this run
    last = np.searchsorted(start, below + xe + 2, side="right")    # starts at or before the column after it
    counts = np.maximum(last - first, 0)
    upper = np.repeat(np.arange(len(row)), counts)
    lower = np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)
    return upper, lower


def _numbered(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    """Which rows belong together: a number that grows where one of the columns changes."""
    new = np.zeros(batch.num_rows, bool)
    for name in names:
        code = batch.column(batch.schema.names.index(name)).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new)


def whole_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of sorted rows cut where the columns change, each with the group number of its rows.

    What may go on in the next batch waits; pieces of one long group are put together once, at its end.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        number = _numbered(batch, names)
        edge = int(np.searchsorted(number, number[-1]))
        if len(waiting) > 1:
            before = waiting[-2].slice(waiting[-2].num_rows - 1)
            joint = pa.Table.from_batches([before, batch.slice(0, 1)]).combine_chunks().to_batches()[0]
            if not edge and _numbered(joint, names)[-1] == 0:
                continue  # the group goes on over this whole batch
        done = pa.Table.from_batches([*waiting[:-1], batch.slice(0, edge)]).combine_chunks().to_batches()
        for part in done:
            if part.num_rows:
                yield part, _numbered(part, names)
        waiting = [batch.slice(edge)]
    if waiting:
        for part in pa.Table.from_batches(waiting).combine_chunks().to_batches():
            yield part, _numbered(part, names)


def _label(names: tuple[str, ...]):
    """Labels of the runs of each group (an image or a band of it) by the first cell of their component in the group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in whole_groups(batches, names):
            gy, xs, xe = (batch.column(c).to_numpy().astype(np.int64) for c in ("gy", "xs", "xe"))
            root = _merge_edges(len(group), *touching(group, gy, xs, xe))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(gy[root].astype(np.int32)), pa.array(xs[root].astype(np.int32))], names=[*batch.schema.names, "ry", "rx"])
    return run


def merge_labels(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Components of an undirected graph ``(u, v)``: rows ``node, root`` with the smallest node as root.

    Every round points each node at its smallest neighbour, follows the pointers to their end, and contracts the graph
    to the roots. Only local minima survive a round, so the graph at least halves; parallel edges vanish.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    graph = pin(both.where(F.col("u") != F.col("v")).distinct())
    if graph.isEmpty():
        return graph.select(F.col("u").alias("node"), F.col("u").alias("root"))
    roots = None
    for _ in range(max_rounds):
        parent = graph.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("_m"))
        parent = pin(parent.select("node", F.least("node", "_m").alias("root")))
        while True:  # pointer doubling: chains get half as long each time
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("_top"))
            jumped = pin(parent.join(up, "root").select("node", F.col("_top").alias("root"), (F.col("_top") != F.col("root")).alias("_moved")))
            moved = not jumped.where("_moved").isEmpty()
            parent = jumped.drop("_moved")
            if not moved:
                break
        if roots is None:
            roots = parent
        else:
            nxt = parent.select(F.col("node").alias("root"), F.col("root").alias("_top"))
            roots = pin(roots.join(nxt, "root", "left").select("node", F.coalesce("_top", "root").alias("root")))
        a = parent.select(F.col("node").alias("u"), F.col("root").alias("_u"))
        b = parent.select(F.col("node").alias("v"), F.col("root").alias("_v"))
        graph = pin(graph.join(a, "u").join(b, "v").where(F.col("_u") != F.col("_v"))
                    .select(F.col("_u").alias("u"), F.col("_v").alias("v")).distinct())
        if graph.isEmpty():
            return roots
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def cell_runs(cells: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Runs of a table of cells, by gaps and islands within a grid row. Repeated cells count once.

    The columns ``also`` must be the same in neighbouring cells and stay with the run.
    """
    row = W.partitionBy("image_id", "gy").orderBy("gx")
    island = F.col("gx") - F.dense_rank().over(row)
    return (cells.select("image_id", F.col("gy").cast("int").alias("gy"), F.col("gx").cast("int").alias("gx"), *also).withColumn("_i", island)
            .groupBy("image_id", "gy", "_i", *also).agg(F.min("gx").alias("xs"), F.max("gx").alias("xe")).drop("_i"))


def run_cells(runs: DataFrame) -> DataFrame:
    """The single cells of runs."""
    rest = [c for c in runs.columns if c not in ("xs", "xe")]
    return runs.select(*rest, F.explode(F.sequence("xs", "xe")).alias("gx"))


def label_runs(runs: DataFrame, dealt: bool = False) -> DataFrame:
    """Runs, with all their columns, and ``comp_y, comp_x``: the first cell (row by row) of their component.

    Runs of one row must not overlap or touch, as those of :func:`cell_runs` and of grid rows don't.
    With ``dealt`` an image's runs lie next to each other in one task, sorted by row and column, as its grid did. Then they
    are labelled there, an image at once; nothing is shuffled or pinned, and they come in the same order.
    """
    ends = [T.StructField("ry", T.IntegerType()), T.StructField("rx", T.IntegerType())]
    if dealt:
        whole = runs.mapInArrow(_label(("image_id",)), T.StructType([*runs.schema.fields, *ends]))
        return whole.withColumnsRenamed({"ry": "comp_y", "rx": "comp_x"})
    band = F.expr(f"gy div {BAND}").cast("int")
    banded = runs.withColumn("band", band).repartition("image_id", "band").sortWithinPartitions("image_id", "band", "gy", "xs")
    labelled = pin(banded.mapInArrow(_label(("image_id", "band")), T.StructType([*banded.schema.fields, *ends])))
    node = F.struct("image_id", "ry", "rx")

    def pieces(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / PIECE), F.floor(high / PIECE)))

    above = labelled.where(F.col("gy") % BAND == BAND - 1).select(
        "image_id", (F.col("gy") + 1).alias("gy"), F.col("xs").alias("_xs"), F.col("xe").alias("_xe"), node.alias("u"),
        pieces(F.col("xs") - 1, F.col("xe") + 1).alias("_p"))
    below = labelled.where((F.col("gy") % BAND == 0) & (F.col("gy") > 0)).select("image_id", "gy", "xs", "xe", node.alias("v"), pieces(F.col("xs"), F.col("xe")).alias("_p"))
    edges = above.join(below, ["image_id", "gy", "_p"]).where(
        (F.col("xs") <= F.col("_xe") + 1) & (F.col("xe") >= F.col("_xs") - 1)).select("u", "v").distinct()
    roots = merge_labels(edges)
    moved = roots.select(F.col("node.image_id").alias("image_id"), F.col("node.ry").alias("ry"), F.col("node.rx").alias("rx"),
                         F.col("root.ry").alias("_ty"), F.col("root.rx").alias("_tx"))
    return (labelled.join(moved, ["image_id", "ry", "rx"], "left")
            .select(*runs.columns, F.coalesce("_ty", "ry").alias("comp_y"), F.coalesce("_tx", "rx").alias("comp_x")))


def connected_components(cells: DataFrame) -> DataFrame:
    """Cells with ``comp_y, comp_x``, the first cell (row by row) of their component, which names it."""
    return run_cells(label_runs(cell_runs(cells))).select("image_id", "gy", "gx", "comp_y", "comp_x")


def component_id(cells: DataFrame, name: str = "det_id") -> DataFrame:
    """One bigint per component from its naming cell; unique within the image."""
    return cells.withColumn(name, F.col("comp_y").cast("bigint") * 4294967296 + F.col("comp_x")).drop("comp_y", "comp_x")


def _stats_of_images(s: float, keys: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in whole_groups(batches, keys[:1]):
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            rest = [column[k].dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for k in keys[1:]]
            order = np.lexsort((*rest, group))
            new = np.zeros(len(order), bool)
            new[0] = True
            for v in (group, *rest):
                new[1:] |= np.diff(v[order]) != 0
            heads = np.flatnonzero(new)
            gy, xs, xe = (column[c].to_numpy().astype(np.int64)[order] for c in ("gy", "xs", "xe"))
            n = np.add.reduceat(xe - xs + 1, heads)
            box = [f.reduceat(v, heads) * s for f, v in ((np.minimum, xs), (np.minimum, gy), (np.maximum, xe + 1), (np.maximum, gy + 1))]
            score = np.add.reduceat(column["total"].to_numpy()[order], heads) / n
            names = pa.array(order[heads])
            yield pa.RecordBatch.from_arrays([*[column[k].take(names) for k in keys], *map(pa.array, (n, *box, score))],
                                             names=[*keys, "n_cells", "x0", "y0", "x1", "y1", "score"])
    return run


def run_stats(runs: DataFrame, stride: int, keys: tuple[str, ...] = ("image_id", "det_id"), dealt: bool = False) -> DataFrame:
    """Cells, box in pixels and mean probability (the score) of each component, from its runs and their totals.

    With ``dealt`` the runs of an image lie next to each other in one task, and are added up there without a shuffle.
    """
    s = float(stride)
    length = F.col("xe") - F.col("xs") + 1
    if dealt:
        types = ", ".join(f"{k} {runs.schema[k].dataType.simpleString()}" for k in keys)
        return runs.select(*keys, "gy", "xs", "xe", "total").mapInArrow(
            _stats_of_images(s, keys), f"{types}, n_cells bigint, x0 double, y0 double, x1 double, y1 double, score double")
    return runs.groupBy(*keys).agg(
        F.sum(length).alias("n_cells"), (F.min("xs") * s).alias("x0"), (F.min("gy") * s).alias("y0"),
        ((F.max("xe") + 1) * s).alias("x1"), ((F.max("gy") + 1) * s).alias("y1"), (F.sum("total") / F.sum(length)).alias("score"))


def component_stats(cells: DataFrame, stride: int, keys: tuple[str, ...] = ("image_id", "det_id")) -> DataFrame:
    """Cells, box in pixels and mean probability (the score) of each component."""
    s = float(stride)
    return cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cells"), (F.min("gx") * s).alias("x0"), (F.min("gy") * s).alias("y0"),
        ((F.max("gx") + 1) * s).alias("x1"), ((F.max("gy") + 1) * s).alias("y1"), F.avg("prob").alias("score"))
