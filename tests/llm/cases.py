"""Documents with what tables may hold: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

WORDS = "alpha beta gamma delta omega sigma lambda theta kappa zeta eta iota mu nu xi pi rho tau phi chi psi".split()
EXTRA = ("shard", "slot", "size", "score", "bucket", "row", "node", "_size", "_id", "_d", "r", "label", "c", "part")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "s", "ed", ",", ".")) for _ in range(n))


def rows():
    base = prose(1, 80)
    texts = [(1, base), (2, base), (3, base + " tail"), (4, prose(2, 60)), (5, None), (6, ""), (7, " \t\n\v\f\r "),
             (8, "one"), (9, "One"), (10, "é ü 漢字   x y 😀 " * 5), (11, prose(3, 30_000)), (None, "no id here"),
             (None, None), (4, prose(2, 60)), (12, prose(4, 9)), (13, "same line\nsame line\nother\n\n\n" * 3),
             (14, "x" * 70_000), (15, base.upper()), (16, prose(5, 50))]
    sources = ["b", "a", None, "b", "c", "a", "b", "", "b", None, "b", "b", "a", "b", "c", "b", "b", "ä", "Z"]
    return [(i, t, "en", s, None, *["clash"] * len(EXTRA)) for (i, t), s in zip(texts, sources)]


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def save(spark, folder, docs, **tables):
    docs.write.parquet(f"{folder}/documents.parquet")
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
