"""Secret scan: all rules in one automaton, one step for each byte of every text.

The combined automaton says which rules match in a text. Only for those, the rule's own automaton lists the leftmost
spans that don't overlap; spans that fail the rule's length test are dropped and not tried again.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tilewright.llm.automaton import Automaton, compile_rules
from tilewright.llm.common import per_batch, table, text_bytes

#: (kind, rule, rule by which the automaton finds texts worth a second look, least length, of the value only)
#: The first three kinds are the base; a hex run has to be counted inside the automaton, else any "a" would stop it.
RULES = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", None, 6, True),
    ("access", r"AKIA[A-Z0-9]+", None, 20, False),
    ("hex", r"[0-9a-f]+", r"[0-9a-f]{24}", 24, False),
    ("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", None, 0, False),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", None, 40, False),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", None, 15, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", None, 40, False),
]
KINDS = [r[0] for r in RULES]
BASE = KINDS[:3]


@cache
def automata() -> tuple[Automaton, list[Automaton]]:
    """The combined automaton and one for each rule; compiled once in a worker process."""
    return (compile_rules([probe or rule for _, rule, probe, _, _ in RULES], anywhere=True),
            [compile_rules([rule], anywhere=False) for _, rule, _, _, _ in RULES])


def scan(data: bytes) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes, sorted."""
    combined, single = automata()
    bits, out = combined.found(data), []
    for k, (_, _, _, least, of_value) in enumerate(RULES):
        if bits >> k & 1:
            for start, end in single[k].spans(data):
                length = _value_length(data[start:end]) if of_value else end - start
                if length >= least:
                    out.append((start, k, end))
    return sorted(out)


def _value_length(match: bytes) -> int:
    """Length after the first ``:`` or ``=``, spaces and a quote; the keyword before it holds neither."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    rest = match[at + 1:].lstrip(b" ")
    return len(rest) - (rest[:1] in (b'"', b"'"))


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if data.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[s]), k, int(before[e])) for s, k, e in spans]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_batch(batch: pa.RecordBatch) -> dict:
    out: dict = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_other")}
    for data in text_bytes(batch):
        spans = code_points(data, scan(data)) if data else []
        base = [s for s in spans if s[1] < len(BASE)]
        for k, name in enumerate(BASE):
            out[f"n_{name}"].append(sum(s[1] == k for s in base))
        out["n_other"].append(len(spans) - len(base))
        out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
        out["spans"].append(joined(spans))
    return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row for each document: counts by base kind, ``n_other``, digest of the base spans, all spans.

    Null and empty texts have no spans. Repeated rows and null identifiers stay as they are; other columns of ``docs``
    are left out. No documents give no rows.
    """
    count = T.LongType()
    return per_batch(docs.select("doc_id", "text"), scan_batch, ["doc_id"], [
        ("n_assign", count), ("n_access", count), ("n_hex", count), ("base_sha256", T.StringType()),
        ("spans", T.StringType()), ("n_other", count)])


def op3(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
