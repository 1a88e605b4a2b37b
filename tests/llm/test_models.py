"""Suffix tree, classifier, near-duplicates, retrieval, archives and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm import cases
from tilewright.llm import common, components, decontaminate, setsketch, suffix_tree, toxicity, warc

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("some", ["table", None, []])
def test_suffix_tree_columns(spark, tmp_path, some):
    path = SF if some == "table" else cases.save(spark, tmp_path, cases.frame(spark, some))
    rows = [(r["doc_id"], words(r["text"])) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter()
    for i, w in rows:
        if not held[i]:
            counts.update([*w, None])
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, held[i], len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), n,
                    round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in [*w, None]), 4)) for i, w in rows)
    got = suffix_tree.op1(spark, path).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def longer(text):
    return b" ".join(text.encode().lower().split()) + b"\n"


class NaiveTree:
    """The tree by its definition, from counters of whole contexts."""

    def __init__(self, train, share):
        self.follow = [defaultdict(Counter) for _ in range(suffix_tree.DEPTH + 1)]
        pad = b"\n" * suffix_tree.DEPTH
        for text in train:
            whole = pad + longer(text)
            for at in range(suffix_tree.DEPTH, len(whole)):
                for d, level in enumerate(self.follow):
                    level[whole[at - d:at]][whole[at]] += 1
        total = sum(self.follow[0][b""].values())
        self.nodes = [{b""}]
        for d in range(1, suffix_tree.DEPTH + 1):
            least = share * total if d <= suffix_tree.HEAD else suffix_tree.LEAST_COUNT
            self.nodes.append({x for x, c in self.follow[d].items() if sum(c.values()) >= least
                               and self.gain(d, x) >= suffix_tree.LEAST_DIVERGENCE})
        for d in (*range(suffix_tree.DEPTH, suffix_tree.HEAD + 1, -1), *range(suffix_tree.HEAD, 1, -1)):
            self.nodes[d - 1] |= {x[1:] for x in self.nodes[d]}

    def gain(self, d, context):
        own, shorter = self.follow[d][context], self.follow[d - 1][context[1:]]
        n, m = sum(own.values()), sum(shorter.values())
        return 2 * sum(c * math.log(c / n / (shorter[x] / m)) for x, c in own.items())

    def score(self, text):
        whole, out = b"\n" * suffix_tree.DEPTH + longer(text), 0.0
        for at in range(suffix_tree.DEPTH, len(whole)):
            p = 1 / 256
            for d, nodes in enumerate(self.nodes):
                context = whole[at - d:at]
                if context in nodes:
                    c = self.follow[d][context]
                    p = (c[whole[at]] + len(c) * p) / (sum(c.values()) + len(c))
            out += math.log10(p)
        return out


@pytest.mark.parametrize("blocks", ["one", "many"])
def test_scores_equal_those_of_the_tree_by_its_definition(spark, tmp_path, monkeypatch, blocks):
    share = 1e-3
    monkeypatch.setattr(suffix_tree, "LEAST_SHARE", share)
    if blocks == "many":
        for name, value in (("VOCABULARY", 40), ("BLOCK_GRAMS", 300), ("PIECE_BYTES", 9000), ("BUCKET_BYTES", 1000)):
            monkeypatch.setattr(suffix_tree, name, value)
    found = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()
    texts = [r["text"] or "" for r in found] + ["", "unseen 漢字 words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(3)
    path = cases.save(spark, tmp_path, docs)
    tree = NaiveTree([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2], share)
    for d in range(3, suffix_tree.DEPTH + 1):  # all thresholds bite
        assert 20 < len(tree.nodes[d]) < len(tree.follow[d]) / 2
    got = {r["doc_id"]: r["score"] for r in suffix_tree.op1(spark, path).collect()}
    assert got == pytest.approx({i: tree.score(t) for i, t in enumerate(texts)}, rel=1e-6)


def test_nodes_are_distributions_and_grow_with_the_corpus(spark):
    texts = [b" ".join((r["text"] or "").encode().lower().split())
             for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    sizes = []
    for some in (texts[:len(texts) // 10], texts):
        counts = suffix_tree.GramCounts()
        counts.add(some, True)
        counts.merge()
        tree = suffix_tree.branch(suffix_tree.Tree(suffix_tree.HEAD), *counts.done)
        sizes.append(sum(map(len, tree.contexts[suffix_tree.HEAD + 1:])))
    assert sizes[1] > 3 * sizes[0] > 0
    for gram in counts.done[0][::len(counts.done[0]) // 50]:
        assert tree.probability(((gram >> 8) << 8) + np.arange(256)).sum() == pytest.approx(1.0)


def test_pieces_of_a_long_text_score_like_one(monkeypatch):
    texts = [cases.prose(2, 500).lower().encode(), b"", cases.prose(3, 40).lower().encode()]
    counts = suffix_tree.GramCounts()
    counts.add(texts, True)
    counts.merge()
    keys, logs = counts.done[0], -np.log10(1.0 + counts.done[1])
    whole = suffix_tree.log10_scores(keys, logs, texts)
    monkeypatch.setattr(suffix_tree, "PIECE_BYTES", 100)
    assert suffix_tree.log10_scores(keys, logs, texts) == pytest.approx(whole)


def test_held_out_texts_score_above_the_base(spark):
    got = suffix_tree.op1(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score")).head()
    assert got[0] > 0.96 * got[1]  # the base knows every word's count; the tree spells even unseen words


def test_toxicity_on_held_out_labels(spark):
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    got = toxicity.op2(spark, path)
    rows = got.join(labels.where("toxic is not null"), "doc_id").where("held_out").collect()
    hit = [r["predicted"] for r in rows if r["toxic"] == 1]
    false = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(hit) >= 0.8 * len(hit) and sum(false) <= 0.03 * len(false)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.collect())


@pytest.mark.parametrize("some, labelled", [(None, [(1, 0), (4, 1), (11, 0), (16, 1), (None, 1)]), (None, []), ([], [(1, 1), (2, 0)])])
def test_toxicity_of_odd_rows(spark, tmp_path, some, labelled):
    docs = cases.frame(spark, some)
    labels = spark.createDataFrame([(i, 1, t) for i, t in labelled], LABELS)
    path = cases.save(spark, tmp_path, docs, labels=labels)
    got = toxicity.op2(spark, path).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity_stage(spark, docs, path).columns == docs.columns


def test_a_frequent_labelled_identifier_pushes_no_label_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ENTRIES", 300_000)
    ids = [i for i in range(240) if zlib.crc32(str(i).encode()) % toxicity.FOLDS != toxicity.HELD_OUT]
    hot = spark.createDataFrame([(i,) for i in ids], "i long").orderBy(F.xxhash64("i", F.lit("order")), "i").head()[0]
    rows = [(i, cases.prose(i, 60) + (" vileword" if i % 3 == 0 and i != hot else "")) for i in range(240)]
    rng = random.Random(5)
    rows += [(hot, " ".join(f"{rng.randrange(16 ** 8):08x}" for _ in range(300))) for _ in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0 and i != hot)) for i in range(240)], LABELS)
    keys, _ = toxicity.sample_keys(labels)
    assert Counter(r["_id"] for r in toxicity.sample_texts(docs.unionByName(docs), keys).collect()) == Counter(ids)
    got = toxicity.op2(spark, cases.save(spark, tmp_path, docs, labels=labels)).where(F.col("doc_id") != hot).collect()
    assert len(got) == 239 and all(r["predicted"] == (r["doc_id"] % 3 == 0) for r in got)


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(i, k, shingles(t)) for k, (i, t) in enumerate(rows)]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a, s in sets:
        for j, b, t in sets[a + 1:]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                parent[find(b)] = find(a)
    least = defaultdict(list)
    for i, k, _ in sets:
        least[find(k)].append(i)
    smallest = {k: min((i for i in ids if i is not None), default=None) for k, ids in least.items()}
    return [(i, len(s), smallest[find(k)]) for i, k, s in sets]


def near_family(seed, n):
    """A text, and variants of it whose similarities lie on both sides of the limit."""
    rng = random.Random(seed)
    base = cases.prose(seed, 120).split()
    out = [" ".join(base)]
    for _ in range(n - 1):
        w = rng.choice(out).split()
        for _ in range(rng.choice((1, 2, 3, 4, 5))):
            w[rng.randrange(len(w))] = rng.choice(cases.WORDS) + "x"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("kind", ["odd", "families", "empty"])
def test_near_duplicates_equal_brute_force(spark, tmp_path, kind):
    if kind == "families":
        rows = list(enumerate(t for seed in range(6) for t in near_family(seed, 25)))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
    else:
        docs = cases.frame(spark, None if kind == "odd" else [])
        rows = [r[:2] for r in cases.rows()] if kind == "odd" else []
    got = setsketch.op5(spark, cases.save(spark, tmp_path, docs)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute_components(rows))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["component_id"] is not None)
    staged = setsketch.near_stage(spark, docs, "")
    assert staged.columns == docs.columns
    heads = Counter((r["component_id"]) for r in got if r["n_shingles"] and r["component_id"] is not None)
    kept = Counter(r["doc_id"] for r in staged.collect())
    assert all(kept[c] == 1 for c in heads)


def test_all_rounds_lose_no_link(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(setsketch, "PAIRS_PER_ENTRY", -1.0)
    rows = list(enumerate(near_family(3, 40)))
    path = cases.save(spark, tmp_path, spark.createDataFrame(rows, "doc_id long, text string"))
    got = setsketch.op5(spark, path).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute_components(rows))


def test_pairs_do_not_grow_with_the_square_of_a_family(spark, tmp_path, monkeypatch):
    """Variants of one text at similarities about 0.5: they share buckets with each other, but hardly any pair is a link."""
    base, rows = cases.prose(8, 150).split(), []
    for i in range(200):
        rng, w = random.Random(i), list(base)
        for at in rng.sample(range(len(w)), 5):
            w[at] = f"own{i}x{at}"
        rows.append((i, " ".join(w)))
    seen, likely = [], setsketch.likely

    def counted(pairs, sketches):
        seen.append(pairs.count())
        return likely(pairs, sketches)

    monkeypatch.setattr(setsketch, "likely", counted)
    got = setsketch.op5(spark, cases.save(spark, tmp_path, spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute_components(rows))
    assert seen and sum(seen) <= (setsketch.ROUNDS * setsketch.CENTRES + 1) * len(rows)


def test_sieve_lets_all_wanted_rows_pass(spark, monkeypatch):
    rows = spark.range(20_000)
    wanted = spark.range(0, 20_000, 100).select(F.col("id").alias("k"))
    for words, most in ((2 ** 17, 220), (1, 20_000)):
        monkeypatch.setattr(common, "SIEVE", words)
        got = common.sieve(rows, "id", wanted, "k").collect()
        assert {r["id"] for r in got} >= set(range(0, 20_000, 100)) and len(got) <= most
    assert common.sieve(rows, "id", wanted.limit(0), "k").count() == 0


def test_parity_rules_out_no_link(spark):
    rng = np.random.default_rng(3)
    pairs = []
    for n in (1, 5, 40, 150, 900, 5000):
        for share in (0.3, 0.5, 0.74, 0.75, 0.8, 1.0):
            common = rng.integers(0, 2 ** 63, max(1, round(2 * n * share / (1 + share))), dtype=np.uint64)
            own = [rng.integers(0, 2 ** 63, max(0, n - len(common)), dtype=np.uint64) for _ in range(2)]
            a, b = (np.unique(np.concatenate([common, x])) for x in own)
            pairs.append((n, share, len(np.intersect1d(a, b)), len(a), len(b), *setsketch.parity([a, b]).tolist()))
    schema = "n long, share double, common long, na long, nb long, pa array<long>, pb array<long>"
    got = spark.createDataFrame(pairs, schema).withColumn("may", setsketch.may_link("a", "b")).collect()
    assert all(r["may"] for r in got if 100 * r["common"] >= 75 * (r["na"] + r["nb"] - r["common"]))
    assert not any(r["may"] for r in got if 40 <= r["n"] <= 150 and r["share"] <= 0.5)


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.75, 0.95):
        n = 3000
        common = rng.integers(0, 2 ** 63, int(2 * n * share / (1 + share)), dtype=np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 2 ** 63, n - len(common), dtype=np.uint64)]) for _ in range(2))
        registers = setsketch.sketch([np.unique(a), np.unique(b)])
        size = np.array([float(n)])
        assert setsketch.estimate(registers[:1], registers[1:], size, size)[0] == pytest.approx(share, abs=0.15)
        merged = setsketch.sketch([np.unique(np.concatenate([a, b]))])[0]
        assert (merged == registers.max(axis=0)).all()  # of a union: the larger registers


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (7, 7)], "u long, v long")
    got = {r["node"]: r["label"] for r in components.connected(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}
    assert components.connected(edges.limit(0)).count() == 0


def test_components_are_joined_by_new_links(spark):
    first, second = [(1, 2), (3, 2), (7, 8), (9, 9)], [(8, 3), (20, 21), (1, 3), (30, 7)]
    empty = spark.createDataFrame([], "node long, label long")
    label = components.joined(empty, spark.createDataFrame(first, "u long, v long"))
    assert {r["node"]: r["label"] for r in label.collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9}
    label = components.joined(label, spark.createDataFrame(second, "u long, v long"))
    assert {r["node"]: r["label"] for r in label.collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 30: 1, 9: 9, 20: 20, 21: 20}
    assert components.joined(empty, empty.select(F.col("node").alias("u"), F.col("label").alias("v"))).collect() == []


def test_a_round_of_stars_is_a_small_plan(spark):
    edges = components.keep(spark.createDataFrame([(2, 1), (3, 2), (5, 4)], "u long, v long"))
    for star in (components.large_star, components.small_star):
        plan = star(edges, 3)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") <= 6


def test_leaks_of_the_table(spark):
    items = {r["item_id"]: " ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: " " + " ".join(r["text"].lower().split()) + " " for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, q in items.items() if q in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op4(spark, SF).collect()}
    assert want <= got and len(got) <= 1.1 * len(want) + 1


def test_paraphrases_leak_and_clean_texts_do_not(spark):
    items = [(i, cases.prose(1000 + i, 40)) for i in range(8)] + [(90, None), (91, ""), (92, "short one")]
    changed = items[2][1].split()
    for at in (3, 11, 19, 27):
        changed[at] = "other"
    docs = [(1, cases.prose(1, 200) + " " + items[0][1] + " " + cases.prose(2, 90)), (2, items[1][1].upper()),
            (3, cases.prose(3, 55) + " " + " ".join(changed)), (4, cases.prose(4, 400)), (5, None), (6, ""), (None, items[3][1])]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                              spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 0), (2, 1), (3, 2), (None, 3)}


def test_frequencies_reach_the_driver_without_row_objects(spark, monkeypatch):
    docs = cases.frame(spark).select("text")
    want, texts = Counter(), [r[0] or "" for r in docs.collect()]
    for t in texts:
        want.update(set((decontaminate.word_ids(t.encode()) & (decontaminate.BUCKETS - 1)).tolist()))
    monkeypatch.setattr(type(docs), "collect", lambda self: pytest.fail("rows were collected"))
    counts, total = decontaminate.document_frequencies(docs)
    assert total == len(texts) and {int(b): int(counts[b]) for b in np.flatnonzero(counts)} == dict(want)
    assert decontaminate.document_frequencies(docs.limit(0))[1] == 0


def test_excerpts_of_long_items_leak(spark):
    items = [(0, cases.prose(2000, 59)), (1, cases.prose(2001, 300)), (2, cases.prose(2002, 120))]
    first, long, third = (t.split() for _, t in items)
    parts = [first[:40], long[:200], long[95:135], third[-35:], third[7:12] + third[60:65], []]
    docs = [(i, cases.prose(10 + i, 53 + i) + " " + " ".join(p) + " " + cases.prose(30 + i, 70)) for i, p in enumerate(parts)]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                              spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(0, 0), (1, 1), (2, 1), (3, 2)}
    assert all(r["common_words"] >= min(len(parts[r["doc_id"]]), 36) - 4 for r in got)


@pytest.mark.parametrize("some", [None, []])
def test_leaks_of_odd_rows(spark, some):
    docs = cases.frame(spark, some)
    none = spark.createDataFrame([], "item_id long, text string, label string")
    assert decontaminate.leaks(docs, none).count() == 0
    items = spark.createDataFrame([(1, cases.prose(4, 9), "x"), (1, cases.prose(4, 9), "x"), (2, None, None)], none.schema)
    few = docs.where("doc_id is null or doc_id != 11")  # 30,000 words out of twenty hold many a short item
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(few, items).collect()} == ({(12, 1)} if some is None else set())


@pytest.mark.parametrize("a, b", [("abcbdab", "bdcaba"), ("", "x"), ("aaaa", "aa"), ("xyz", "abc")])
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert decontaminate.common_subsequence(decontaminate._masks([ord(x) for x in a]), len(a), [ord(y) for y in b]) == table[-1][-1]


PAGES = "page_id long, url string, html string, _digest string, record string"


def test_archive_round_trip_of_odd_pages(spark, tmp_path):
    body = "<p>" + "é" * 120
    rows = [(3, "http://a b/", body), (1, None, body), (2, "http://x", "small"), (4, "http://y", "small"), (5, None, None),
            (6, "http://z\r\nX: y", ""), (None, "http://n", body), (1, None, body), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 30), (9, "big", "q" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)
    bundles = warc.archive(pages)
    got = warc.read_bundles(bundles).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == Counter(
        (p, len((h or "").encode()), "revisit" if h == body and p != 1 else "response", 1 if h == body and p != 1 else None) for p, _, h in rows)
    assert warc.export_files(bundles, str(tmp_path)).count() == bundles.count()
    import zstandard
    for r in bundles.collect():
        data = (tmp_path / f"{r['bundle']}.warc.zst").read_bytes()
        assert data == r["data"]
        plain = b"".join(zstandard.ZstdDecompressor().decompress(data[a:a + n]) for a, n in warc.seek_table(data))
        assert plain.count(b"WARC/1.1\r\nWARC-Type") == len(r["index"])
    assert warc.read_bundles(warc.archive(pages.limit(0))).count() == 0


def test_damaged_payloads_are_noticed():
    writer = warc.BundleWriter()
    writer.add(*warc.record_bytes(7, "http://x", b"hello", "0" * 64, 5, None))
    data, index = writer.bundle()
    import zstandard
    start, packed = warc.seek_table(data)[index[0]["frame"]]
    frame = zstandard.ZstdDecompressor().decompress(data[start:start + packed])
    fields, body = warc.read_record(frame, index[0]["offset"], index[0]["length"])
    assert body == b"hello" and fields["WARC-Target-URI"] == "http://x"
    with pytest.raises(ValueError):
        warc.seek_table(data[:-1] + b"x")


def test_pipeline_stages_take_effect(spark, tmp_path):
    """Each stage against its operator's own decisions on what the stage before it kept."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        if name != "sharding":
            assert out.columns == docs.columns
        docs = spark.read.parquet(path)
        seen[name] = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    whole = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    clean = {r["doc_id"] for r in toxicity.op2(spark, SF).where("predicted = 0").collect()}
    assert set(seen["toxicity"]) == clean
    survivors = [(i, whole[i]) for i in sorted(clean)]
    assert set(seen["near duplicates"]) == {c for _, _, c in brute_components(survivors)}
    texts = {i: " " + " ".join(whole[i].lower().split()) + " " for i in seen["near duplicates"]}
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(seen["decontamination"]) == {i for i, t in texts.items() if not any(q in t for q in items)}
    assert seen["mixing"] == seen["sharding"] and max(seen["mixing"].values()) <= 2
    assert corpus_pipeline.run(spark, SF).count() == sum(seen["sharding"].values())


def test_word_hashes_part_words_and_drop_their_edges(monkeypatch):
    texts = [cases.prose(i, 300) for i in range(20)] + ["", "  ", ".", " ... A!", "\v(x)\f É é, \t\nz" + "y" * 90, "a a. (A)"]
    plain = [[w.strip(decontaminate._EDGE) for w in t.lower().encode().split()] for t in texts]
    hashes = [decontaminate.word_ids(t.encode()).tolist() for t in texts]
    pairs = {(w, h) for ws, hs in zip(plain, hashes, strict=True) for w, h in zip(ws, hs, strict=True)}
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 50)  # long texts are taken in blocks
    assert [decontaminate.word_ids(t.encode()).tolist() for t in texts] == hashes
