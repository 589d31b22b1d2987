"""Best-fit packing by sums of squares.

Texts are encoded and cut into pieces where they lie; only the pieces' lengths (and, where asked for, their ids) are dealt out,
to many groups of bounded size.  In each, pieces go from long to short, each into that open bin for which the sum, over all
gaps, of the squared number of open bins with this gap becomes smallest (ties: the smallest gap).  A bin is opened only where
no open one has room.  Groups waste a bin or so each; their number follows that of documents and characters.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.bpe import LEAF_CHARS, encoded
from millwright.llm.common import binaries

#: Tokens of a sequence, the id that ends a document, and documents to a group.
CAPACITY, END_ID, GROUP_PIECES = 1024, 2, 16_384


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces are placed in the order given."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; full ones are not counted
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    opened = 0
    for i, size in enumerate(lengths.tolist()):
        have = count[size:]
        change = np.where(have > 0, count[: capacity + 1 - size] - have, capacity + len(lengths))
        best = int(change.argmin())
        if have[best] > 0:
            gap = best + size
            at = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, at = capacity, opened
            opened += 1
        bins[i], offsets[i] = at, capacity - gap
        if gap > size:
            count[gap - size] += 1
            stacks[gap - size].append(at)
    return bins, offsets


def pieces(doc_ids: pa.Array, flat: np.ndarray, offsets: np.ndarray, before: int, capacity: int, end_id: int, with_ids: bool) -> pa.RecordBatch:
    """The pieces of these documents, ``end_id`` put after each one's ids."""
    many = len(offsets) - 1
    ids = np.full(len(flat) + many, end_id, "<u4")
    ids[np.arange(len(flat)) + np.repeat(np.arange(many), np.diff(offsets))] = flat
    begin = offsets + np.arange(many + 1)
    size = np.diff(begin)
    count = -(-size // capacity)
    owner = np.repeat(np.arange(many), count)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    first = size - (count - 1) * capacity
    start = np.where(piece == 0, 0, first[owner] + (piece - 1) * capacity)
    length = np.where(piece == 0, first[owner], capacity)
    cuts = np.append(begin[:-1][owner] + start, begin[-1])
    raw = memoryview(ids.tobytes())
    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    columns = {"doc_id": doc_ids.take(pa.array(owner)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()), "nth": pa.array(owner + before)}
    if with_ids:
        columns["ids"] = binaries(ids.view(np.uint8), 4 * cuts)
    return pa.RecordBatch.from_pydict(columns)


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, with_ids: bool = True) -> DataFrame:
    """Documents as token sequences of at most ``capacity``, in nearly as few as can be.

    A document's ids are its text's and then ``end_id``; only one longer than ``capacity`` is cut, into pieces of that
    length, of which the first may be shorter.  Returns, per piece, doc_id, piece int, start long, length long, ids_crc32 long,
    sequence_id long, offset long, and with ``with_ids`` also ids binary (little-endian 32-bit).  Null and empty texts are one
    piece holding only ``end_id``; null ids and repeated rows are packed like others, pieces of equal length by doc_id, piece
    and checksum; very long texts are encoded in parallel parts; an empty table gives an empty one; other columns are left aside.
    """
    kept = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    columns = [c.split()[0] for c in kept.split(", ")]

    def emit(ids, flat, offsets, before):
        return pieces(ids, flat, offsets, before, capacity, end_id, with_ids).select([*columns, "nth"])

    cut = encoded(docs, f"{kept}, nth long", emit, id_col=id_col, text_col=text_col, tokenizer=tokenizer, leaf_chars=LEAF_CHARS)
    docs_and_chars = docs.select(F.count("*"), F.sum(F.length(F.col(text_col).cast("string")))).first()
    groups = max(1, -(-(docs_and_chars[0] + (docs_and_chars[1] or 0) // capacity) // group_pieces))  # a token has a character or more, as a rule

    def pack(table: pa.Table) -> pa.Table:
        order = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = place(order["length"].to_numpy(), capacity)
        base = order["group"][0].as_py() << 32
        return order.select(columns).append_column("sequence_id", pa.array(base + bins)).append_column("offset", pa.array(offsets))

    # nth parts the copies of one row
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "nth"), F.lit(groups))).drop("nth")
    return dealt.groupBy("group").applyInArrow(pack, f"{kept}, sequence_id long, offset long")
