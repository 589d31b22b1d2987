"""Document fingerprints by locally consistent parsing.

A text's symbols are cut into phrases by deterministic coin tossing: each symbol's label becomes the place and value of the
lowest bit in which it differs from its left neighbour's, four times over, until labels are few; a phrase begins where a label
is a local maximum.  A phrase is named by the hash of its symbols, and the names are parsed in turn.  Where a phrase begins
depends only on a few symbols around it, so equal substrings get equal interior names wherever they stand.

A fingerprint holds, for each of ``SLOTS`` slots, 16 bits of the least phrase name that falls into it; the likeness of two is the
share of equal slots among those that either uses, which estimates the Jaccard similarity of their phrases.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm.common import extended, pick, slices, text_slices, tidy
from millwright.llm.shingles import mix

#: Parsing rounds (a phrase of the last has about ten code points), slots, and rounds of coin tossing (64-bit labels end below six).
LEVELS, SLOTS, TOSSES = 2, 128, 4
#: Ranges of ids that rows are dealt out by, at most; beyond it ranges grow.
MOST_RANGES = 65_536
_EMPTY = 0xFFFF
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _phrases(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round: names and text numbers of the phrases."""
    if not len(names):
        return names, owner
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(names)))
    names = np.where(length > 1, mix(names[at] + length.astype(np.uint64) * _STEP), names[at])  # a run is one symbol
    owner = owner[at]
    head = np.ones(len(names), bool)
    head[1:] = owner[1:] != owner[:-1]
    label = names
    for _ in range(TOSSES):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[head] = label[head] ^ np.uint64(1)
        differ = label ^ before
        differ |= (differ == 0).astype(np.uint64)
        lowest = differ & (~differ + np.uint64(1))
        place = np.bitwise_count(lowest - np.uint64(1)).astype(np.uint64)
        label = place * np.uint64(2) + ((label & lowest) != 0)
    begin = head.copy()
    if len(label) > 2:
        begin[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~head[2:]
    start = np.flatnonzero(begin)
    number = np.cumsum(begin) - 1
    place = (np.arange(len(names)) - start[number]).astype(np.uint64)
    return mix(np.add.reduceat(mix(names + place * _STEP), start)), owner[start]


def fingerprints(texts: list[str], levels: int = LEVELS, slots: int = SLOTS) -> list[str]:
    """A fingerprint of 4 * ``slots`` hexadecimal digits for each text; the empty text has all slots unused."""
    symbols = [np.frombuffer(t.encode("utf-32-le", "replace"), "<u4") for t in texts]
    names = mix(np.concatenate(symbols).astype(np.uint64) + np.uint64(1)) if symbols else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in symbols])
    for _ in range(levels):
        names, owner = _phrases(names, owner)
    cells = np.full(len(texts) * slots, _EMPTY, np.uint16)
    slot = owner * slots + (names % np.uint64(slots)).astype(np.int64)
    order = np.lexsort((names, slot))
    slot, names = slot[order], names[order]
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    cells[slot[first]] = np.minimum(names[first] >> np.uint64(20) & np.uint64(0xFFFF), _EMPTY - 1)
    raw = cells.astype(">u2").tobytes().hex()
    width = 4 * slots
    return [raw[i * width : (i + 1) * width] for i in range(len(texts))]


def likeness(one: list[str], two: list[str]) -> np.ndarray:
    """Share of equal slots among those that either of the two uses; 1 where neither uses any."""
    a, b = (np.frombuffer(bytes.fromhex("".join(x)), ">u2").reshape(len(x), -1) for x in (one, two))
    used = (a != _EMPTY) | (b != _EMPTY)
    total = used.sum(axis=1)
    return np.where(total == 0, 1.0, ((a == b) & used).sum(axis=1) / np.maximum(total, 1))


def document_fingerprints(docs: DataFrame, *, text_col: str = "text", levels: int = LEVELS, slots: int = SLOTS) -> DataFrame:
    """``docs`` with fingerprint string.

    A null text has that of the empty one; repeated rows have equal ones; very long texts are parsed whole; an empty table gives an
    empty one; a column so named is replaced, all others are kept.
    """

    def work(batch):
        texts = [t or "" for t in batch.column("t").to_pylist()]
        return [pa.array([f for lo, hi in slices(texts) for f in fingerprints(texts[lo:hi], levels, slots)], pa.string())]

    return extended(docs, {"t": F.col(text_col).cast("string")}, T.StructType().add("fingerprint", "string"), work)


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 4096) -> DataFrame:
    """doc_id, text and next_text, the text of the next row by ascending id (after the last: the first), without a global sort.

    Rows are dealt out by ranges of ids; the rows with the least id of a range also go to the range before it.  Null ids come
    first; rows with one id follow by text.
    """
    rows = pick(docs, id_col, text_col).withColumn("at", F.coalesce("doc_id", F.lit(-(2**63))))
    cuts = max(1, min(MOST_RANGES, -(-rows.count() // bucket_rows)))
    rough = sorted(set(rows.approxQuantile("at", [k / cuts for k in range(1, cuts)], 0.2 / cuts))) if cuts > 1 else []

    def bucket(bounds: list) -> F.Column:
        """How many of the bounds, in order, are not above the id."""
        edges = np.array(bounds)

        @F.pandas_udf("int")
        def place(at: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(edges, at.to_numpy(), side="right").astype(np.int32))

        return place("at") if bounds else F.lit(0)

    firsts = sorted(r[1] for r in rows.select("at").groupBy(bucket(rough).alias("b")).agg(F.min("at")).collect())  # one id a range
    mine = bucket(firsts[1:])
    last = max(0, len(firsts) - 1)
    starts = np.array(firsts)

    @F.pandas_udf("boolean")
    def is_first(at: pd.Series) -> pd.Series:
        found = np.searchsorted(starts, at.to_numpy(), side="right") - 1
        return pd.Series(starts[found] == at.to_numpy())

    before = F.when(F.col("mine") == 0, F.lit(last)).otherwise(F.col("mine") - 1)
    places = F.when(F.col("first"), F.array(F.struct(F.col("mine").alias("b"), F.lit(False).alias("tail")), F.struct(before.alias("b"), F.lit(True).alias("tail")))).otherwise(F.array(F.struct(F.col("mine").alias("b"), F.lit(False).alias("tail"))))
    dealt = rows.withColumn("mine", mine).withColumn("first", is_first("at")).select("doc_id", "at", "text", F.explode(places).alias("p")).select("p.b", "p.tail", "at", "doc_id", "text")
    ordered = dealt.repartition("b").sortWithinPartitions("b", "tail", "at", "text")

    def follow(batches):
        """Each row waits for the one after it; of a range's tail rows only the first is wanted."""
        held = None
        for batch in (whole.slice(lo, hi - lo) for whole in batches for lo, hi in text_slices(whole.column("text"))):
            out: list[tuple] = []
            for b, tail, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("b", "tail", "doc_id", "text"))):
                if held is not None and held[0] == b:
                    out.append((held[1], held[2], text))
                held = None if tail else (b, doc_id, text)
            yield pa.record_batch([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.string())], ["doc_id", "text", "next_text"])

    return ordered.mapInArrow(tidy(follow), "doc_id long, text string, next_text string")


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", levels: int = LEVELS, slots: int = SLOTS) -> DataFrame:
    """Fingerprints of each text, of the text with its last quarter replaced by the next text's beginning, and their likenesses.

    Returns doc_id, n_chars, edited string, fingerprint, edited_fingerprint, near_edited, near_next.  Null texts are empty, and an
    empty text's edited text is empty; a lone row is its own next; repeated rows follow each other; an empty table gives an empty one.
    """

    def work(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi in text_slices(batch.column("text")):
                part, after = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in ("text", "next_text"))
                edited = [t[: len(t) - len(t) // 4] + a[: len(t) // 4] for t, a in zip(part, after)]
                own, other, following = (fingerprints(x, levels, slots) for x in (part, edited, after))
                yield pa.record_batch(
                    [ids.slice(lo, hi - lo), pa.array([len(t) for t in part], pa.int64()), *(pa.array(x, pa.string()) for x in (edited, own, other)), pa.array(likeness(own, other)), pa.array(likeness(own, following))],
                    ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col=id_col, text_col=text_col).mapInArrow(tidy(work), schema)
