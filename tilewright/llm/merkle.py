"""Merkle manifest of a dataset: built level by level, checked by a recursive query that climbs from every leaf.

A row is a leaf: the hash of its fields, each with its length in front. The leaves of a tree (here: a language) are put
in order, and every ``FAN`` consecutive nodes become the hash of their hashes until one is left; the roots of all trees
are the leaves of a last tree. Each such run of nodes is stored as one row that names its own node's place one level up.

The check climbs along these rows: a Spark recursive query joins a node with the run it belongs to, appends the run's
other hashes to the proof and folds the node's hash in. The leaves of one run share every sibling above it, so they
climb as one row that holds a folded hash for each of them, and the proof once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tilewright.llm.common import join_groups, keep, table
from tilewright.operators.ranking import number_rows

FAN = 8
TOP = "t"  # name of the tree of roots; trees of values are named "n" (null) or "v" and the value, in this order
UNLIMITED = {"spark.sql.cteRecursionRowLimit": "-1"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Manifest:
    """``members`` (leaf runs: tree, k, n, leaves), ``runs`` (all levels, linked upwards), ``roots`` (tree, subroot, top_idx,
    _n), ``root`` and the number of leaves."""

    members: DataFrame
    runs: DataFrame
    roots: DataFrame
    root: str | None
    total: int


def encoded(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def tree_name(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("v"), value.cast("string")), F.lit("n"))


def _hash_of(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, ""), 256)


def _levels(runs: DataFrame) -> list[DataFrame]:
    """Runs of every level from those of the first one (tree, level, k, hashes, h, width: nodes of the next level)."""
    found = [runs]
    while True:
        last = found[-1]
        nodes = last.where("width > 1")
        if nodes.isEmpty():
            return found
        pairs = F.sort_array(F.collect_list(F.struct("k", "h")))
        found.append(keep(
            nodes.groupBy("tree", F.expr(f"k div {FAN}").alias("_up"), "level", "width").agg(F.transform(pairs, lambda p: p["h"]).alias("hashes"))
            .select("tree", (F.col("level") + 1).alias("level"), F.col("_up").alias("k"), "hashes", _hash_of(F.col("hashes")).alias("h"),
                    F.ceil(F.col("width") / FAN).alias("width"))))


def build(leaves: DataFrame) -> Manifest:
    """Manifest of (tree, id, leaf, claimed): leaves ascend by ``id`` (null first), then by hash.

    ``claimed`` is the hash that a holder of the row presents later; it goes along with its leaf and into no node.
    Rows that are equal in all four are told apart by number and interchangeable. No rows give no root.
    """
    rows = leaves.select("tree", "id", "leaf", "claimed").withColumn("_u", F.monotonically_increasing_id())
    rows = rows.withColumn("_has", F.col("id").isNotNull())
    placed = number_rows(rows, ["tree"], ["_has", "id", "leaf", "claimed", "_u"], "_rank", weight=None, total="n")
    at = F.col("_rank") - 1
    member = F.struct((at % FAN).cast("int").alias("pos"), "id", "leaf", "claimed")
    members = keep(placed.groupBy("tree", "n", F.expr(f"(_rank - 1) div {FAN}").alias("k"))
                   .agg(F.sort_array(F.collect_list(member)).alias("leaves")))
    hashes = F.transform("leaves", lambda m: m["leaf"])
    first = members.where("n > 1").select("tree", F.lit(0).alias("level"), "k", hashes.alias("hashes"), _hash_of(hashes).alias("h"),
                                          F.ceil(F.col("n") / FAN).alias("width"))
    inner = _levels(first)
    last = [r.where("width = 1").select("tree", F.col("h").alias("subroot")) for r in inner]
    last.append(members.where("n = 1").select("tree", F.col("leaves")[0]["leaf"].alias("subroot")))
    ends = last[0]
    for more in last[1:]:
        ends = ends.unionByName(more)
    counts = members.groupBy("tree").agg(F.max("n").alias("_n"))
    roots = keep(number_rows(ends.join(counts, "tree"), [], ["tree"], "_rank", total="trees")
                 .select("tree", "subroot", "_n", (F.col("_rank") - 1).alias("top_idx"), "trees"))
    pairs = F.sort_array(F.collect_list(F.struct("top_idx", "subroot")))
    top = keep(roots.where("trees > 1").groupBy(F.expr(f"top_idx div {FAN}").alias("k"), "trees")
               .agg(F.transform(pairs, lambda p: p["subroot"]).alias("hashes"))
               .select(F.lit(TOP).alias("tree"), F.lit(0).alias("level"), "k", "hashes", _hash_of(F.col("hashes")).alias("h"),
                       F.ceil(F.col("trees") / FAN).alias("width")))
    outer = _levels(top)
    end = roots.where("trees = 1").select(F.col("subroot").alias("h")).head()
    for r in outer:
        end = end or r.where("width = 1").select("h").head()
    total = roots.agg(F.sum("_n")).head()[0] or 0
    return Manifest(members, keep(_linked(inner, outer, roots)), roots, end and end["h"], total)


def _linked(inner: list[DataFrame], outer: list[DataFrame], roots: DataFrame) -> DataFrame:
    """All runs with the place of their own node: (up_tree, up_level, up_idx), null above the last one."""
    def union(parts: list[DataFrame]) -> DataFrame:
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole

    def up(runs: DataFrame) -> DataFrame:
        return runs.where("width > 1").withColumns({"up_tree": F.col("tree"), "up_level": F.col("level") + 1, "up_idx": F.col("k")})

    inner_all, outer_all = union(inner), union(outer)
    ends = inner_all.where("width = 1").join(roots.select("tree", "top_idx", "trees"), "tree")
    more = F.col("trees") > 1
    ends = ends.withColumns({"up_tree": F.when(more, F.lit(TOP)), "up_level": F.when(more, F.lit(0)),
                             "up_idx": F.when(more, F.col("top_idx"))}).drop("top_idx", "trees")
    stop = outer_all.where("width = 1").withColumns({"up_tree": F.lit(None).cast("string"), "up_level": F.lit(None).cast("int"),
                                                     "up_idx": F.lit(None).cast("bigint")})
    columns = ["tree", "level", "k", "hashes", "h", "up_tree", "up_level", "up_idx"]
    return union([x.select(columns) for x in (up(inner_all), ends, up(outer_all), stop)])


CLIMB = """
with recursive climb(tree, k, leaves, up_tree, up_level, up_idx, folded, proof) as (
    select tree, k, leaves, up_tree, up_level, up_idx, folded, '' from {start}
    union all
    select c.tree, c.k, c.leaves, r.up_tree, r.up_level, r.up_idx,
        transform(c.folded, f -> sha2(concat(array_join(slice(r.hashes, 1, int(c.up_idx % {fan})), ''), f,
                                             array_join(slice(r.hashes, int(c.up_idx % {fan}) + 2, {fan}), '')), 256)),
        concat(c.proof, array_join(slice(r.hashes, 1, int(c.up_idx % {fan})), ''),
               array_join(slice(r.hashes, int(c.up_idx % {fan}) + 2, {fan}), ''))
    from climb c join {runs} r on c.up_tree = r.tree and c.up_level = r.level and c.up_idx div {fan} = r.k)
select * from climb where up_tree is null
"""


def climb(manifest: Manifest) -> DataFrame:
    """(tree, id, leaf, proof_sha256, folded_root) for every leaf: the root that its claimed hash leads to."""
    spark = manifest.runs.sparkSession
    own = manifest.runs.where((F.col("level") == 0) & (F.col("tree") != TOP)).select("tree", "k", "up_tree", "up_level", "up_idx")
    whole = F.transform("leaves", lambda m: m["leaf"])

    def beside(at: Column, middle: Column) -> Column:
        return F.array_join(F.concat(F.slice(whole, F.lit(1), at), middle, F.slice(whole, at + 2, F.lit(FAN))), "")

    folded = F.transform("leaves", lambda m: F.sha2(beside(m["pos"], F.array(m["claimed"])), 256))
    start = manifest.members.where("n > 1").join(own, ["tree", "k"]).withColumn("folded", folded)
    lone = manifest.members.where("n = 1").join(manifest.roots.select("tree", "top_idx", "trees"), "tree")
    more = F.col("trees") > 1
    lone = lone.withColumns({"up_tree": F.when(more, F.lit(TOP)), "up_level": F.when(more, F.lit(0)),
                             "up_idx": F.when(more, F.col("top_idx")), "folded": F.transform("leaves", lambda m: m["claimed"])})
    columns = ["tree", "k", "leaves", "up_tree", "up_level", "up_idx", "folded"]
    start = keep(start.select(columns).unionByName(lone.select(columns)))
    done = _recursive(spark, CLIMB, start=start, runs=manifest.runs)
    none = F.array().cast("array<string>")
    each = F.explode(F.transform("leaves", lambda m: F.struct(
        m["id"].alias("id"), m["leaf"].alias("leaf"), F.sha2(F.concat(beside(m["pos"], none), F.col("proof")), 256).alias("proof_sha256"),
        F.get("folded", m["pos"]).alias("folded_root"))))
    return done.select("tree", each.alias("m")).select("tree", "m.*")


def _recursive(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Result of a recursive query, kept. The limit on its rows, which would end it, is lifted while it runs."""
    names = {n: f"merkle_{n}_{id(df)}" for n, df in tables.items()}
    before = {k: spark.conf.get(k) for k in UNLIMITED}
    for n, df in tables.items():
        df.createOrReplaceTempView(names[n])
    try:
        for k, v in UNLIMITED.items():
            spark.conf.set(k, v)
        return keep(spark.sql(sql.format(fan=FAN, **names)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        for n in names.values():
            spark.catalog.dropTempView(n)


def verify(leaves: DataFrame) -> DataFrame:
    """``tree, id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of :func:`build`'s input."""
    manifest = build(leaves)
    roots = manifest.roots.select("tree", "subroot", "_n")
    return (join_groups(climb(manifest), roots, "tree", manifest.total).withColumn("root", F.lit(manifest.root).cast("string"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def document_leaves(docs: DataFrame, by: str = "lang") -> DataFrame:
    """Leaves of documents, one tree for each ``by``; the claimed text is lower-cased where 3 divides crc32 of the id.

    Null fields are written ``-``; a null identifier is never tampered with. Empty texts are ``0:``. Rows that repeat are
    leaves of their own. Other columns are left out, whatever their names.
    """
    def leaf(text: Column) -> Column:
        return digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.translate("text", _UPPER, _LOWER)
    return docs.select(tree_name(F.col(by)).alias("tree"), F.col("doc_id").alias("id"), leaf(F.col("text")).alias("leaf"),
                       F.when(hit, leaf(lower)).otherwise(leaf(F.col("text"))).alias("claimed"))


def op13(spark, sf_dir: str) -> DataFrame:
    found = verify(document_leaves(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: The crc32 table (reflected polynomial 0xEDB88320), as a list for SQL.
CRC_TABLE = ("list_transform(range(256), lambda i: list_reduce(list_concat([i::bigint], range(8)), "
             "lambda c, b: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end))")

OP13_SQL = rf"""
with recursive crc as (select {CRC_TABLE} as t),
coded as (select doc_id, lang, text, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''),
        lambda c: unicode(c)::bigint)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)) as state,
    concat(coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
           coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-')) as head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lowered
    from documents, crc),
leaves as (select doc_id, coalesce('v' || lang, 'n') as tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    case when xor(state, 4294967295) % 3 = 0 then sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-'))
         else sha256(head || coalesce(strlen(text) || ':' || text, '-')) end as claimed from coded),
placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by tree) as n
    from leaves),
inner_nodes as (select tree, 0 as level, i, n, leaf as h from placed
    union all select tree, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i)) from inner_nodes where n > 1
    group by tree, level, i // 8, n),
subroots as (select tree, level, h as subroot, row_number() over (order by tree) - 1 as ti, count(*) over () as tn
    from inner_nodes where n = 1),
outer_nodes as (select 't' as tree, 0 as level, ti as i, tn as n, subroot as h from subroots
    union all select tree, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i)) from outer_nodes where n > 1
    group by tree, level, i // 8, n),
nodes as (select * from inner_nodes union all select * from outer_nodes),
runs as (select tree, level, i // 8 as k, list(h order by i) as hs from nodes where n > 1 group by all),
climb as (select doc_id, leaf, tree as own, tree, 0 as level, i, claimed as folded, '' as proof, i as own_i from placed
    union all select c.doc_id, c.leaf, c.own, case when r.hs is null then 't' else c.tree end,
        case when r.hs is null then 0 else c.level + 1 end, case when r.hs is null then s.ti else c.i // 8 end,
        case when r.hs is null then c.folded else sha256(array_to_string(r.hs[1:c.i % 8], '') || c.folded || array_to_string(r.hs[c.i % 8 + 2:], '')) end,
        case when r.hs is null then c.proof else c.proof || array_to_string(r.hs[1:c.i % 8], '') || array_to_string(r.hs[c.i % 8 + 2:], '') end, own_i
    from climb c left join runs r on r.tree = c.tree and r.level = c.level and r.k = c.i // 8
    left join subroots s on s.tree = c.tree where r.hs is not null or c.tree <> 't'),
ends as (select * from climb c where tree = 't' and not exists (select 1 from runs r where r.tree = 't' and r.level = c.level and r.k = c.i // 8)),
root as (select h as root from outer_nodes where n = 1)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified
from ends join subroots s on s.tree = ends.own, root
"""
