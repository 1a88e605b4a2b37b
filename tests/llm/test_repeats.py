"""Repeated passages against the rule applied word by word."""

import hashlib
import random

import numpy as np
import pytest

from llm import cases
from tilewright.llm import repeats


def plain(rows, window):
    """(doc_id, n_words, n_removed, kept) of rows in their order."""
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = set(), [None] * len(rows)
    for k in order:
        doc_id, words = texts[k]
        gone = set()
        for i in range(len(words) - window + 1):
            found = tuple(words[i:i + window])
            if found in seen:
                gone |= set(range(i, i + window))
            seen.add(found)
        out[k] = (doc_id, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode())
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()), key=repr)


def passages(seed, n_docs, words):
    """Texts made of a few passages in any order, so that repeats overlap, touch and nest."""
    rng = random.Random(seed)
    parts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(12)]
    return [(i, rng.choice((" ", "\n", " \t")).join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for i in range(n_docs)]


@pytest.mark.parametrize("seed, window, start, words", [(1, 20, 5, cases.WORDS), (2, 8, 2, ["a", "b"]), (3, 8, 1, cases.WORDS[:3]), (4, 4, 2, ["x", "y"])])
def test_equals_the_plain_rule(spark, seed, window, start, words):
    rows = passages(seed, 60, words)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(repeats.remove_repeats(docs, window, start)) == plain(rows, window)


def test_odd_rows(spark, tmp_path):
    rows = cases.rows()
    docs = spark.createDataFrame(rows, cases.SCHEMA).coalesce(1)
    assert got(repeats.remove_repeats(docs)) == plain([r[:2] for r in rows], 20)
    query = repeats.op11(spark, cases.save(spark, tmp_path, docs)).collect()
    want = {(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in plain([r[:2] for r in rows], 20)}
    assert {tuple(r) for r in query} == want and len(query) == len(rows)


def test_no_documents(spark):
    assert repeats.remove_repeats(cases.frame(spark, [])).collect() == []


def test_many_copies_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BITS", 3)
    base = cases.prose(7, 60)
    rows = [(i if i % 5 else None, base if i % 3 == 0 else f"{i} " + base[:300] + f" {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert got(repeats.remove_repeats(docs)) == plain(rows, 20)


def test_spans_cover_what_is_removed(spark):
    rows = passages(5, 40, cases.WORDS)
    texts = dict(rows)
    for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        words = texts[r["doc_id"]].split()
        gone = {i for s in r["spans"] for i in range(s["start"], s["end"])}
        assert len(gone) == r["n_removed"] and " ".join(w for i, w in enumerate(words) if i not in gone) == r["kept"]


@pytest.mark.parametrize("width", [1, 2, 3, 7, 16])
def test_sliding_minimum(width):
    x = np.random.default_rng(width).integers(0, 2 ** 60, 50).astype(np.uint64)
    assert repeats.sliding_min(x, width).tolist() == [min(x[i:i + width]) for i in range(50 - width + 1)]


def test_a_window_is_represented_alike_everywhere():
    rng = np.random.default_rng(1)
    names = rng.integers(1, 50, 300).astype(np.uint64)
    least, chosen = repeats.represent(np.arange(290), names, 11)
    assert least.tolist() == [min(names[i:i + 11]) for i in range(290)]
    assert set(chosen) == {q for i in range(290) for q in range(i, i + 11) if names[q] == min(names[i:i + 11])}
