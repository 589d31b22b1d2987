"""Secret scans: patterns, and the Shannon entropy of sliding windows over candidate strings.

Candidates are long runs of one character class (hexadecimal, or the letters of base 64).  A window of fixed length slides
over each; its entropy is kept up to date from the counts of the two characters that leave and enter.  Windows at or above
the class's threshold, and of the mixture a random string of the class has, make up the added spans.  A candidate that an
allow-list pattern matches adds none; what the patterns find stays in any case.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm.common import extended

KINDS = ("assign", "access", "hex", "entropy")
_BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}"), 0, 24),
)
#: Window length in characters; candidates are at least as long.
WINDOW = 24
#: Class, its runs, least entropy of a window in bits, and patterns that a window of it must hold.
CLASSES = (
    ("hex", re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{24,}"), 3.0, (re.compile("[0-9]"), re.compile("[A-Fa-f]"))),
    ("base64", re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}"), 3.9, (re.compile("[0-9]"), re.compile("[A-Z]"), re.compile("[a-z]"))),
)
#: Candidates with any of these are placeholders, not secrets.
ALLOW_LIST = ("(?i)example", "(?i)placeholder", "(?i)dummy", "(?i)changeme", "(.)\\1{7}", "0123456789", "(?i)abcdefgh", "(?i)lorem")


def high_entropy(text: str, window: int, least: float, needs) -> list[tuple[int, int]]:
    """Runs of the text that windows of at least ``least`` bits cover."""
    log = [0.0, 0.0, *(k * math.log2(k) for k in range(2, window + 1))]
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, c in enumerate(text):
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += log[k + 1] - log[k]
        if i >= window:
            old = text[i - window]
            k = counts[old]
            counts[old] = k - 1
            total += log[k - 1] - log[k]
        a = i + 1 - window
        if a >= 0 and math.log2(window) - total / window >= least - 1e-9 and all(n.search(text, a, i + 1) for n in needs):
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((a, i + 1))
    return spans


def find_in(text: str, window: int = WINDOW, allow=tuple(map(re.compile, ALLOW_LIST))) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start and then in the order of ``KINDS``."""
    found = [(*m.span(), kind) for kind, pattern, group, least in _BASE for m in pattern.finditer(text) if len(m[group]) >= least]
    added = set()
    for _, runs, least, needs in CLASSES:
        for m in runs.finditer(text):
            if not any(a.search(m[0]) for a in allow):
                added |= {(m.start() + a, m.start() + b, "entropy") for a, b in high_entropy(m[0], window, least, needs)}
    return sorted([*found, *added], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPANS = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("kind", "string"))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def find_secrets(docs: DataFrame, *, text_col: str = "text", window: int = WINDOW, allow_list: tuple[str, ...] = ALLOW_LIST) -> DataFrame:
    """``docs`` with secrets array<struct<start, end, kind>>: code points, end exclusive, by start and then kind.

    Null and empty texts have an empty array; repeated rows each get theirs; an empty table gives an empty one; a column
    already named secrets is replaced, others are kept whatever their names.
    """
    allow = tuple(re.compile(a) for a in allow_list)

    def work(batch):
        return [pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in find_in(t or "", window, allow)] for t in batch.column("t").to_pylist()], _ARROW_SPANS)]

    return extended(docs, {"t": F.col(text_col).cast("string")}, T.StructType().add("secrets", SPANS), work)


def redact_secrets(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every secret of the text replaced by ``mark``; overlapping spans are replaced together.

    A null text stays null, an empty one empty; repeated rows stay and are changed alike; very long texts are searched whole; an
    empty table gives an empty one; all other columns are kept.
    """
    found = find_secrets(docs, text_col=text_col, **options)

    def work(batch):
        out = []
        for t, spans in zip(batch.column("t").to_pylist(), batch.column("s").to_pylist()):
            if t and spans:
                parts, at = [], 0
                for s in spans:
                    if s["start"] >= at:
                        parts += [t[at : s["start"]], mark]
                    at = max(at, s["end"])
                t = "".join([*parts, t[at:]])
            out.append(t)
        return [pa.array(out, pa.string())]

    clean = extended(found, {"t": F.col(text_col).cast("string"), "s": F.col("secrets")}, T.StructType().add(text_col, "string"), work)
    return clean.select(*[c for c in docs.columns if c.lower() != "secrets"])
