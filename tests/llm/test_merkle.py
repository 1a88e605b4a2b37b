"""Merkle manifest against a tree built and climbed by plain recursion."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from llm import cases
from tilewright.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def leaf(row, text):
    return sha(*map(field, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def fold(nodes, at, mine):
    """(root, siblings of node ``at`` in order, root with ``mine`` in its place)."""
    path = []
    while len(nodes) > 1:
        runs = [nodes[i:i + 8] for i in range(0, len(nodes), 8)]
        run, place = runs[at // 8], at % 8
        path += run[:place] + run[place + 1:]
        mine = sha(*run[:place], mine, *run[place + 1:])
        nodes, at = [sha(*r) for r in runs], at // 8
    return nodes[0], path, mine


def plain(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r["lang"]].append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        trees[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    tops = [fold([leaf(r, r["text"]) for r in trees[lang]], 0, "")[0] for lang in langs]
    out = []
    for t, lang in enumerate(langs):
        leaves = [leaf(r, r["text"]) for r in trees[lang]]
        for i, r in enumerate(trees[lang]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            subroot, path, mine = fold(leaves, i, leaf(r, lower(r["text"]) if hit else r["text"]))
            root, more, mine = fold(tops, t, mine)
            out.append((r["doc_id"], leaves[i], subroot, root, sha(*path, *more), mine, mine == root))
    return out


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def table(n, langs):
    return [{"doc_id": i * 3 % 1009, "source": "s" if i % 4 else None, "lang": langs[i * i % len(langs)], "n_chars": i % 7 or None,
             "text": f"Some Text {i}" if i % 5 else (None if i % 2 else f"plain {i}")} for i in range(n)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (8, ["en"]), (9, ["en"]), (65, [None]), (600, ["en", None, "", "de", "é"]), (30, [f"l{i}" for i in range(30)]),
                                      (2, ["a", "b"])])
def test_equals_plain_recursion(spark, tmp_path, n, langs):
    rows = table(n, langs)
    found = got(merkle.op13(spark, cases.save(spark, tmp_path, spark.createDataFrame(rows, SCHEMA).repartition(3))))
    want = Counter(plain(rows))
    assert found == want
    if n > 100:
        assert 0 < sum(not r[-1] for r in want) < n


def test_odd_rows(spark, tmp_path):
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in cases.rows()]
    found = got(merkle.op13(spark, cases.save(spark, tmp_path, cases.frame(spark))))
    # equal rows may change places, which changes nothing else
    assert found == Counter(plain(rows))


def test_many_equal_rows(spark, tmp_path):
    rows = table(40, ["en", "de"]) + [{"doc_id": None, "source": None, "lang": "en", "n_chars": None, "text": "Same"}] * 300
    found = got(merkle.op13(spark, cases.save(spark, tmp_path, spark.createDataFrame(rows, SCHEMA))))
    assert found == Counter(plain(rows))


def test_no_rows(spark, tmp_path):
    found = merkle.op13(spark, cases.save(spark, tmp_path, cases.frame(spark, [])))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and found.collect() == []


def test_runs_are_linked_to_their_parents(spark):
    leaves = merkle.document_leaves(spark.createDataFrame(table(700, ["en", "de", None]), SCHEMA))
    manifest = merkle.build(leaves)
    runs = {(r["tree"], r["level"], r["k"]): r for r in manifest.runs.collect()}
    ends = [r for r in runs.values() if r["up_tree"] is None]
    assert len(ends) == 1 and ends[0]["h"] == manifest.root and ends[0]["tree"] == merkle.TOP
    for r in runs.values():
        assert 1 <= len(r["hashes"]) <= merkle.FAN and r["h"] == sha(*r["hashes"])
        if r["up_tree"] is not None:
            assert runs[r["up_tree"], r["up_level"], r["up_idx"] // merkle.FAN]["hashes"][r["up_idx"] % merkle.FAN] == r["h"]


def test_session_settings_are_put_back(spark):
    before = {k: spark.conf.get(k) for k in merkle.UNLIMITED}
    merkle.verify(merkle.document_leaves(spark.createDataFrame(table(20, ["en"]), SCHEMA))).collect()
    assert {k: spark.conf.get(k) for k in merkle.UNLIMITED} == before
