"""Personal data: base patterns as seeds, then bootstrapped contextual extraction.

One pass over the texts gives the base spans, and every identifier-like word with the words around it. Contexts and
identifiers form a graph. Spark scores it in rounds: a context is trusted for a kind by the share of its identifiers that
are known to be of that kind, an identifier by its trusted contexts. Unseen identifiers in trusted contexts become spans
of kind ``context_<kind>``.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tilewright.llm.common import keep, per_batch, table

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
LEAST_SEEDS = 3.0        # known identifiers that a trusted context must have
LEAST_TRUST = 0.5        # share of known identifiers among those of a trusted context
LEAST_BELIEF = 0.8       # belief from which an identifier counts as found
LEAST_DIGITS = 4         # digits of an identifier-like word without an @
CONTEXT_CHARS = 200      # the words around are looked for within so many characters
FEW_CONTEXTS = 100_000   # trusted contexts up to which they are broadcast

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Nothing matches from the middle of a digit run, so runs are entered at their first digit only and never given back.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^ \t-\r]+")
_DIGIT = re.compile(r"[0-9]")
_EDGE = ".,;:!?()[]{}<>\"'|"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their @ so that long runs without one cost nothing."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        name = text[last:at]
        start = last + len(name.rstrip(LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            last = domain.end()
            at = text.find("@", last)
        else:
            last, at = at + 1, text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), sorted."""
    out = [(0, *s) for s in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: two words before it, and the word on either side."""
    before = _WORD.findall(text[max(0, start - CONTEXT_CHARS):start].lower())
    after = _WORD.findall(text[end:end + CONTEXT_CHARS].lower())
    out = []
    if len(before) > 1:
        out.append(f"{before[-2]} {before[-1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    return out


def identifiers(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Base spans and identifier-like words that touch none, with their contexts."""
    out = [{"kind": k, "start": s, "end": e, "value": text[s:e], "contexts": contexts(text, s, e)} for k, s, e in base]
    if not (_DIGIT.search(text) or "@" in text):
        return out
    taken = iter(sorted((s, e) for _, s, e in base))
    span = next(taken, None)
    for m in _WORD.finditer(text):
        word = m[0].strip(_EDGE)
        if not ("@" in word[1:-1] or len(_DIGIT.findall(word)) >= LEAST_DIGITS):
            continue
        start = m.start() + m[0].index(word)
        end = start + len(word)
        while span and span[1] <= start:
            span = next(taken, None)
        if not (span and span[0] < end):
            out.append({"kind": None, "start": start, "end": end, "value": word, "contexts": contexts(text, start, end)})
    return out


def _extract(batch: pa.RecordBatch) -> dict:
    out: dict = {c: [] for c in (*(f"n_{k}" for k in KINDS), "base_sha256", "_base", "_found")}
    for text in batch.column("text").to_pylist():
        base = base_spans(text) if text else []
        joined = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base)
        for k, name in enumerate(KINDS):
            out[f"n_{name}"].append(sum(b[0] == k for b in base))
        out["base_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
        out["_base"].append(joined)
        out["_found"].append(identifiers(text, base) if text else [])
    return out


def bootstrap(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(trusted contexts: context, kind, trust; beliefs: value, kind, belief) from edges (context, value, kind or null).

    Each round adds the beliefs of a context's distinct values by kind, takes the contexts that reach ``LEAST_SEEDS`` and
    ``LEAST_TRUST``, and believes a value by 1 - product(1 - trust) over its trusted contexts. Known values stay at 1.
    """
    edges = keep(edges.groupBy("context", "value").agg(F.max("kind").alias("kind")))
    sizes = edges.groupBy("context").agg(F.count(F.lit(1)).alias("n"))
    seeds = keep(edges.where("kind is not null").groupBy("value", "kind").agg(F.lit(1.0).alias("belief")))
    beliefs, trusted = seeds, None
    links = edges.select("context", "value")
    for _ in range(rounds):
        support = links.join(beliefs, "value").groupBy("context", "kind").agg(F.sum("belief").alias("known"))
        trusted = keep(support.where(F.col("known") >= LEAST_SEEDS).join(sizes, "context")
                       .select("context", "kind", (F.col("known") / F.col("n")).alias("trust"))
                       .where(F.col("trust") >= LEAST_TRUST))
        unknown = edges.where("kind is null").select("context", "value").join(small(trusted), "context")
        doubt = F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9))))
        inferred = unknown.groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("belief"))
        beliefs = keep(seeds.unionByName(inferred))
    return trusted, beliefs


def small(contexts_: DataFrame) -> DataFrame:
    """Broadcast when a count shows that there are few; otherwise Spark joins by a shuffle."""
    return F.broadcast(contexts_) if contexts_.count() <= FEW_CONTEXTS else contexts_


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row for each document: counts by base kind, digest of the base spans, all spans, ``n_context``.

    Null and empty texts have no spans. Repeated rows and null identifiers stay as they are (rows are told apart by a
    number of their own); other columns are left out. No documents give no rows.
    """
    span = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()),
                         T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType()),
                         T.StructField("contexts", T.ArrayType(T.StringType()))])
    counts = [(f"n_{k}", T.LongType()) for k in KINDS]
    rows = per_batch(docs.select("doc_id", "text"), _extract, ["doc_id"],
                     [*counts, ("base_sha256", T.StringType()), ("_base", T.StringType()), ("_found", T.ArrayType(span))])
    rows = keep(rows.withColumn("_row", F.monotonically_increasing_id()))
    found = rows.select("_row", F.explode("_found").alias("f")).select("_row", "f.*")
    edges = found.select("kind", "value", F.explode("contexts").alias("context"))
    trusted, beliefs = bootstrap(edges)
    unseen = found.where("kind is null").select("_row", "start", "end", "value", F.explode("contexts").alias("context"))
    believed = beliefs.where(F.col("belief") >= LEAST_BELIEF).select("value", F.col("kind").alias("of"), "belief")
    hits = unseen.join(small(trusted).withColumnRenamed("kind", "of"), "context").join(believed, ["value", "of"])
    best = hits.groupBy("_row", "start", "end").agg(F.max(F.struct("belief", -F.col("of"))).alias("best"))
    kind = -F.col("best")["col2"]
    name = F.concat(F.lit("context_"), F.element_at(F.array(*map(F.lit, KINDS)), kind + 1))
    added = best.select("_row", F.struct(kind.alias("k"), "start", F.concat_ws(":", name, "start", "end").alias("s")).alias("x"))
    added = added.groupBy("_row").agg(F.array_sort(F.collect_list("x")).alias("x"))  # spans of one text
    out = rows.join(added, "_row", "left")
    more: Column = F.array_join(F.transform("x", lambda v: v["s"]), ",")
    spans = F.concat_ws(",", F.when(F.col("_base") != "", F.col("_base")), more)
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", spans.alias("spans"),
                      F.coalesce(F.size("x"), F.lit(0)).cast("long").alias("n_context"))


def op7(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
