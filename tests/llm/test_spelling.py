"""Spelling variants against plain loops over all pairs."""

import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings, strategies as st

from llm import cases
from tilewright.llm import spelling


def one_edit(a, b):
    """b comes from a by one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain(rows, least_length=6, least_count=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_length and c >= least_count}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def got(df):
    rows = df.collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


words = st.text("abé×", min_size=0, max_size=7)


@settings(max_examples=200, deadline=None)
@given(st.lists(words, min_size=1, max_size=12, unique=True), st.lists(words, min_size=1, max_size=12, unique=True))
def test_single_edits(a, b):
    left, right = spelling.single_edits(a, b)
    assert set(zip(left.tolist(), right.tolist())) == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if one_edit(x, y)}


def corpus(seed, n_words, n_docs):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdéÉXñ") for _ in range(rng.randint(6, 9))) for _ in range(n_words)]

    def slip(w):
        i = rng.randrange(len(w))
        return rng.choice((w[:i] + w[i + 1:], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1:], w, w, w, w, w, w))

    return [(i, rng.choice((" ", "-", "1")).join(slip(rng.choice(stems[:1 + rng.randrange(n_words)])) for _ in range(80))) for i in range(n_docs)]


def test_variants_equal_plain_loops(spark):
    rows = corpus(3, 25, 120)
    want = plain(rows, 6, 2)
    assert sum(v[0] is not None for v in want.values()) > 20 and max(v[3] for v in want.values()) > 5
    assert got(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), 6, 2)) == want


def test_groups_above_a_block_are_cut(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 16)
    monkeypatch.setattr(spelling, "PACK", 8)
    rows = [(i, f"common{a}{b} " * 5) for i, (a, b) in enumerate((a, b) for a in "abcdefghij" for b in "abcdefghij")]
    want = plain(rows)
    assert want["commonaa"][3] >= 17
    assert got(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_chains_lead_to_the_last_form(spark):
    chain = [("abcdef", 5), ("abcdefg", 25), ("abcdefgh", 125), ("abcdefghi", 625), ("abcdefghij", 3125)]
    rows = [(None, " ".join([w] * n)) for w, n in chain]
    found = got(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == plain(rows) and {v[1] for v in found.values()} == {"abcdefghij"}


def test_ties_go_to_the_first_in_code_point_order(spark):
    rows = [(1, "somewort " * 5 + "someworÿ " * 30 + "somewora " * 30)]
    assert got(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))["somewort"][0] == "somewora"


def test_odd_rows(spark, tmp_path):
    rows = [r[:2] for r in cases.rows()]
    assert got(spelling.variants(cases.frame(spark))) == plain(rows)
    assert got(spelling.op12(spark, cases.save(spark, tmp_path, cases.frame(spark)))) == plain(rows)
    assert spelling.variants(cases.frame(spark, [])).collect() == []
