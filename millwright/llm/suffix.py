"""Removing repeated byte strings with a logarithmic family of sparse suffix arrays.

Suffixes are sampled by content: of all ``gram``-byte strings inside a window of ``min_bytes`` bytes, the one with the least
hash is the window's anchor, so equal windows have equal anchors at equal offsets.  An anchor with the windows it stands for
is one entry (about one in (min_bytes - gram) / 2 bytes).  Entries whose bytes are equal form a class.

* A new batch is a suffix array of its own: its classes in the order of their anchors' fingerprints, as a table in the
  shared folder.  It is merge-scanned against the levels there are: a class that meets an equal one, or another one at the
  same anchor, is a match candidate.  Levels of equal rank are then merged into one of the next rank.
* Entries are of one class when both of two 64-bit hashes are equal, of the anchor and of all the entry's bytes; classes that
  come again are repeated over their whole extent.  Of different classes at one anchor, one member each is fetched, and a
  suffix array over their bytes (by prefix doubling) tells which windows are equal: exact, byte by byte.  An anchor with more
  classes than a task should hold is settled by counting 128-bit fingerprints of its windows instead.

Nothing is capped: every window of every document is in exactly one entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm.common import MARKS, removed, shared_dir, tidy, written
from millwright.llm.passages import least_places, merged, repeated_short_passages, word_places
from millwright.llm.shingles import mix

#: Length of a repeated string, of an anchor, number of batches, and classes of one anchor that one task compares.
MIN_BYTES, GRAM, BATCHES, ANCHOR_CLASSES = 400, 48, 4, 2048
#: Short passages, and windows of crowded anchors, that stand in more places than this are hot; up to so many hot ones (16 bytes each) are sent to every executor, not joined.
HOT_TIMES, SENT_PASSAGES = 64, 1 << 17
#: Window starts that one step of array operations takes; positions within a step have 24 bits.
_STEP = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BASE_2 = 0xD1342543DE82EF95


def _window_hashes(data: np.ndarray, width: int, base: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes from each position on."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    inverse = pow(base, -1, 1 << 64)
    powers = np.full(len(data), base, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    powers = np.full(n, inverse, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    return mix((sums[width:] - sums[: n]) * powers)


def _entries(data: np.ndarray, bounds: np.ndarray, min_bytes: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text number, first start, last start, anchor and anchor's hash of each entry; ``bounds``: where texts begin and end in ``data``."""
    hashes = _window_hashes(data, gram, _BASE)
    width = min_bytes - gram + 1
    n = len(data) - min_bytes + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    anchor = least_places(hashes, width)
    owner = np.searchsorted(bounds, np.arange(n), side="right") - 1
    valid = np.arange(n) + min_bytes <= bounds[owner + 1]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new & valid)
    stops = np.flatnonzero(np.append(new[1:] | ~valid[1:], True) & valid)
    return owner[starts], starts, stops, anchor[starts], hashes[anchor[starts]]


def _list_entries(texts: list[bytes], min_bytes: int, gram: int):
    """(text numbers, first starts, last starts, anchors, keys, context hashes), a step at a time; places count from their text's start."""
    i = 0
    while i < len(texts):
        first, size = i, 0
        while i < len(texts) and (i == first or size + len(texts[i]) <= _STEP):
            size += len(texts[i])
            i += 1
        for shift in range(0, max(1, size if i - first == 1 else 1), _STEP):  # a long text in steps that share min_bytes - 1 bytes
            part = texts[first:i] if i - first > 1 else [texts[first][shift : shift + _STEP + min_bytes - 1]]
            raw = b"".join(part)
            bounds = np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)
            owner, lo, hi, anchor, key = _entries(np.frombuffer(raw, np.uint8), bounds, min_bytes, gram)
            context = [xxhash.xxh3_64_intdigest(raw[a : b + min_bytes], c - a) for a, b, c in zip(lo.tolist(), hi.tolist(), anchor.tolist())]
            base = shift - bounds[owner]
            yield owner + first, lo + base, hi + base, anchor + base, key.view(np.int64), np.array(context, np.uint64).view(np.int64)


def equal_windows(contexts: list[bytes], starts: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(context number, start) of the windows of ``min_bytes`` that occur in two contexts or more; ``starts``: windows in each.

    Only the stretches whose windows' hashes stand twice are ordered.
    """
    raw = b"".join(contexts)
    base = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])[:-1]
    owner = np.repeat(np.arange(len(contexts)), starts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
    hashes = _window_hashes(np.frombuffer(raw, np.uint8), min_bytes, _BASE)[base[owner] + at]
    order = np.argsort(hashes)
    equal = hashes[order[1:]] == hashes[order[:-1]]
    twice = np.zeros(len(owner), bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    owner, first, last = _ranges(owner[twice], at[twice])
    if not len(owner):
        return owner, first
    cut = [contexts[i][a : b + min_bytes] for i, a, b in zip(owner.tolist(), first.tolist(), last.tolist())]
    part, at = _ordered_windows(cut, last - first + 1, min_bytes)
    return owner[part], first[part] + at


def _ordered_windows(contexts: list[bytes], starts: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """``equal_windows`` by the order of all suffixes of the contexts."""
    raw = b"".join(contexts)
    base = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])[:-1]
    owner = np.repeat(np.arange(len(contexts)), starts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
    place = base[owner] + at
    padded = np.frombuffer(raw + bytes(16), np.uint8)
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), (len(raw),), (1,))
    _, rank = np.unique(eight.astype(np.uint64), return_inverse=True)
    length = 8
    while 2 * length <= min_bytes:  # ranks of all suffixes by their first ``length`` bytes
        after = np.zeros_like(rank)
        after[: max(0, len(rank) - length)] = rank[length:]
        _, rank = np.unique(rank * len(raw) + after, return_inverse=True)
        length *= 2
    _, group, count = np.unique(rank[place] * len(raw) + rank[place + min_bytes - length], return_inverse=True, return_counts=True)
    twice = count[group] > 1
    return owner[twice], at[twice]


def short_passages(raw: bytes, words: int, below: int) -> dict[bytes, tuple[int, list[list[int]]]]:
    """Of the passages of ``words`` words that take fewer than ``below`` bytes, by their 128-bit hash: how many there are, and the runs of bytes they cover."""
    starts, ends = word_places(raw)
    if len(starts) < words:
        return {}
    starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    short = np.flatnonzero(ends - starts < below)
    found: dict[bytes, tuple[int, list[list[int]]]] = {}
    for a, b in zip(starts[short].tolist(), ends[short].tolist()):
        n, runs = found.get(key := xxhash.xxh3_128_digest(raw[a:b]), (0, []))
        if runs and a <= runs[-1][1]:
            runs[-1][1] = b
        else:
            runs.append([a, b])
        found[key] = n + 1, runs
    return found


def _ranges(owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive numbers: owner, first and last."""
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return owner[first], at[first], at[last]


class SuffixIndex:
    """Levels of suffix classes in the shared folder; a level of rank r holds 2 ** r batches.

    A class is (key, ctx): the hashes of its anchor and of its bytes.  Kept with it: n, how many entries it has; uid and at,
    the text and place of one; extent, how many windows it stands for and how far its anchor is in.
    """

    def __init__(self, spark, folder: str | None = None):
        self.spark = spark
        self.folder = folder or shared_dir(spark)
        self.levels: list[tuple[int, DataFrame, str]] = []  # rank, classes, folder
        self.hits: list[DataFrame] = []
        self._tables = 0

    def _keep(self, df: DataFrame) -> DataFrame:
        self._tables += 1
        self._last = f"{self.folder}/{self._tables}"
        return written(df, folder=self._last)

    @staticmethod
    def _merged(tables: list[DataFrame]) -> DataFrame:
        both = tables[0]
        for t in tables[1:]:
            both = both.unionByName(t)
        return both.groupBy("key", "ctx").agg(F.sum("n").alias("n"), F.min("uid").alias("uid"), F.min_by("at", "uid").alias("at"), F.min("extent").alias("extent"))

    def add(self, entries: DataFrame) -> None:
        """Takes a batch in: its suffix array is made, scanned against all levels, and levels of equal rank are merged."""
        new = self._keep(self._merged([entries.withColumn("n", F.lit(1).cast("long"))]).sortWithinPartitions("key", "ctx"))
        rank, path = 0, self._last
        scan = new.select("key")
        for _, level, _ in self.levels:
            scan = scan.unionByName(level.select("key"))
        self.hits.append(self._keep(scan.groupBy("key").agg(F.count("*").alias("met")).filter("met > 1").select("key")))
        while self.levels and self.levels[-1][0] == rank:
            _, level, old = self.levels.pop()
            merged = self._keep(self._merged([level, new]).sortWithinPartitions("key", "ctx"))
            removed(self.spark, old)
            removed(self.spark, path)
            new, path, rank = merged, self._last, rank + 1
        self.levels.append((rank, new, path))

    def classes(self) -> DataFrame:
        """All classes, with how many entries each has."""
        return self.levels[0][1] if len(self.levels) == 1 else self._keep(self._merged([level for _, level, _ in self.levels]))

    def contested(self) -> DataFrame:
        """Keys at which a scan met two classes, or one class in two levels."""
        keys = self.hits[0]
        for more in self.hits[1:]:
            keys = keys.unionByName(more)
        return keys.distinct()


_MARK = "mark"


def _mark() -> Column:
    return F.pmod(F.xxhash64("uid"), F.lit(MARKS))


def _marks(df: DataFrame) -> DataFrame:
    """The marks of the texts in ``df``, at most ``MARKS`` rows."""
    return F.broadcast(df.select(_mark().alias(_MARK)).distinct())


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, gram: int = GRAM, batches: int = BATCHES, anchor_classes: int = ANCHOR_CLASSES, whole_characters: bool = False, min_words: int | None = None, passage_words: int | None = None, hot_times: int = HOT_TIMES, sent_passages: int = SENT_PASSAGES) -> DataFrame:
    """Every text without the bytes that a repeated string of ``min_bytes`` bytes covers (here or in another document).

    Adds to the columns of ``docs``, replacing any so named: n_bytes long, spans array<struct<start, end>> (maximal removed
    byte runs), kept binary (the other bytes).  ``whole_characters``: a character stays whole if any of its bytes does.
    ``min_words``: a repeated string of so many whole words is removed too, however few bytes it takes.
    ``passage_words``: a column repeated is added, like spans, of the runs that spans and repeated strings of so many whole words
    (however few bytes they take) cover together; the latter are told, not removed.
    A null text counts as empty; null ids are ids like others; a repeated row repeats its text, so both are removed where long
    enough; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    added = ["n_bytes", "spans", "kept", *(["repeated"] if passage_words is not None else [])]
    others = [c for c in docs.columns if c.lower() not in added]
    gram = min(gram, max(1, min_bytes // 2))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # a text is known by its id (without one, by a hash of it) and a checksum; both checksum and place share one number
    uid, check = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)), F.crc32(F.encode(text, "UTF-8"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), uid.alias("uid"), check.alias("th")).withColumn(_MARK, _mark())
    field = others.index(next(c for c in others if c.lower() == text_col.lower()))

    def texts_of(batch) -> list[bytes]:
        return [(t or "").encode("utf-8", "replace") for t in batch.column("row").field(field).cast(pa.string()).to_pylist()]

    def list_entries(parts):
        for batch in parts:
            uid, th, texts = batch.column("uid"), batch.column("th").to_numpy(), [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            for owner, lo, hi, anchor, key, ctx in _list_entries(texts, min_bytes, gram):
                if len(owner):
                    at = (lo << 32) | th[owner]
                    extent = ((hi - lo + 1) << 32) | (anchor - lo)
                    yield pa.record_batch([pa.array(key), pa.array(ctx), uid.take(pa.array(owner)), pa.array(at), pa.array(extent)], ["key", "ctx", "uid", "at", "extent"])

    def list_passages(parts):
        run = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        kind = pa.list_(pa.struct([("w1", pa.int64()), ("w2", pa.int64()), ("n", pa.int64()), ("cover", pa.list_(run))]))
        for batch in parts:
            owner, listed = [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                found = short_passages((t or "").encode("utf-8", "replace"), min_words, min_bytes)
                if found:
                    w = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2).tolist()
                    owner.append(i)
                    listed.append([{"w1": x, "w2": y, "n": n, "cover": [{"start": a, "end": b} for a, b in runs]} for (x, y), (n, runs) in zip(w, found.values())])
            if owner:
                rows = pa.array(owner)
                yield pa.record_batch([batch.column("uid").take(rows), batch.column("th").take(rows), pa.array(listed, kind)], ["uid", "th", "listed"])

    place, checksum, windows_of = F.shiftright("at", 32).alias("lo"), F.col("at").bitwiseAND(0xFFFFFFFF).alias("th"), F.shiftright("extent", 32).alias("starts")
    folder = shared_dir(spark)
    listed = docs.select(uid.alias("uid"), check.alias("th"), text.alias("text")).mapInArrow(tidy(list_entries), "key long, ctx long, uid long, at long, extent long")
    listed.withColumn("batch", F.pmod(F.xxhash64("uid"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(f"{folder}/entries")
    entries = spark.read.schema("key long, ctx long, uid long, at long, extent long, batch int").parquet(f"{folder}/entries")
    index = SuffixIndex(spark, folder)
    for b in range(batches):
        index.add(entries.filter(F.col("batch") == b).drop("batch"))
    classes = index.classes()

    contested = classes.join(index.contested(), "key").select("key", "ctx", "uid", "at", "extent")
    counts = contested.groupBy("key").agg(F.count("*").alias("classes"))
    wanted = contested.join(counts.filter("classes > 1"), "key").select("key", "ctx", "uid", checksum, place, windows_of, "classes")
    per_text = written(wanted.groupBy("uid", "th").agg(F.collect_list(F.struct("key", "ctx", "classes", "lo", "starts")).alias("wanted")), folder=f"{folder}/wanted")
    fetched = rows.join(_marks(per_text), _MARK, "left_semi").join(per_text, ["uid", "th"]).select("row", "wanted")

    def fetch(parts):
        for batch in parts:
            for raw, wanted in zip(texts_of(batch), batch.column("wanted")):
                w = pa.RecordBatch.from_struct_array(wanted.values)
                cut = [raw[a : a + n + min_bytes - 1] for a, n in zip(w["lo"].to_pylist(), w["starts"].to_pylist())]
                yield pa.record_batch([w["key"], w["ctx"], w["classes"], w["starts"], pa.array(cut, pa.binary())], ["key", "ctx", "classes", "starts", "context"])

    contexts = fetched.mapInArrow(tidy(fetch), "key long, ctx long, classes long, starts long, context binary")

    def compare(parts):
        """Whole keys, about a step's bytes at a time."""
        held: list[pa.RecordBatch] = []
        size, last = 0, None

        def settle():
            t = pa.Table.from_batches(held)
            seen: dict[tuple[int, int], int] = {}
            for i, k in enumerate(zip(t["key"].to_pylist(), t["ctx"].to_pylist())):
                seen.setdefault(k, i)  # a repeated row was fetched twice
            t = t.take(pa.array(list(seen.values())))
            owner, at = equal_windows(t["context"].to_pylist(), t["starts"].to_numpy(), min_bytes)
            owner, first, stop = _ranges(owner, at)
            rows = pa.array(owner)
            return pa.record_batch([t["key"].combine_chunks().take(rows), t["ctx"].combine_chunks().take(rows), pa.array(first), pa.array(stop)], ["key", "ctx", "first", "last"])

        for batch in parts:
            keys = batch.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
            sizes = pc.binary_length(batch.column("context")).to_numpy(zero_copy_only=False)
            for lo, hi in zip(cuts, cuts[1:]):
                if held and keys[lo] != last and size >= _STEP:
                    yield settle()
                    held, size = [], 0
                last = keys[lo]
                held.append(batch.slice(lo, hi - lo))
                size += int(sizes[lo:hi].sum())
        if held:
            yield settle()

    def fingerprints(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place and 128-bit fingerprint of every window of a batch."""
        hashed = []
        for starts, context in zip(batch.column("starts").to_pylist(), batch.column("context").to_pylist()):
            data = np.frombuffer(context, np.uint8)
            hashed.append(np.stack([_window_hashes(data, min_bytes, b).view(np.int64)[:starts] for b in (_BASE, _BASE_2)], axis=1))
        sizes = [len(h) for h in hashed]
        at = np.concatenate([np.arange(n) for n in sizes])
        return np.repeat(np.arange(len(sizes)), sizes), at, np.concatenate(hashed)

    def count_windows(parts):
        """How often each window stands in a batch of classes."""
        for batch in parts:
            if len(batch):
                w, n = np.unique(fingerprints(batch)[2], axis=0, return_counts=True)
                yield pa.record_batch([pa.array(w[:, 0]), pa.array(w[:, 1]), pa.array(n)], ["w1", "w2", "n"])

    span = "key long, ctx long, first long, last long"
    few = contexts.filter(F.col("classes") <= anchor_classes).repartition("key").sortWithinPartitions("key").mapInArrow(tidy(compare), span)
    crowded = written(contexts.filter(F.col("classes") > anchor_classes).select("key", "ctx", "starts", "context").dropDuplicates(["key", "ctx"]), folder=f"{folder}/crowded")
    repeated = written(crowded.mapInArrow(tidy(count_windows), "w1 long, w2 long, n long").groupBy("w1", "w2").agg(F.sum("n").alias("times")).filter("times > 1"), folder=f"{folder}/repeated")
    frequent = repeated.filter(F.col("times") > hot_times)
    bounded = frequent.count() <= sent_passages
    sent_windows = spark.sparkContext.broadcast(frozenset(map(tuple, frequent.select("w1", "w2").collect())) if bounded else frozenset())

    def look_up(parts):
        """Runs of hot windows, without fingerprints, and each other window with its own."""
        for batch in parts:
            if len(batch):
                owner, at, w = fingerprints(batch)
                known = np.fromiter((x in sent_windows.value for x in map(tuple, w.tolist())), bool, len(w))
                runs, first, last = _ranges(owner[known], at[known])
                rows, w, rest = pa.array(np.concatenate([runs, owner[~known]])), w[~known], at[~known]
                named = [pa.concat_arrays([pa.nulls(len(runs), pa.int64()), pa.array(w[:, k])]) for k in (0, 1)]
                places = [pa.array(np.concatenate([x, rest]).astype(np.int64)) for x in (first, last)]
                yield pa.record_batch([batch.column("key").take(rows), batch.column("ctx").take(rows), *places, *named], ["key", "ctx", "first", "last", "w1", "w2"])

    looked = written(crowded.mapInArrow(tidy(look_up), f"{span}, w1 long, w2 long"), folder=f"{folder}/looked")
    cold = repeated.filter(F.col("times") <= hot_times) if bounded else repeated
    many = looked.filter("w1 is null").unionByName(looked.filter("w1 is not null").join(cold.select("w1", "w2"), ["w1", "w2"], "left_semi")).select("key", "ctx", "first", "last")
    found = few.unionByName(many).groupBy("key", "ctx").agg(F.collect_list(F.struct("first", "last")).alias("found"))

    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.lit(None).cast("long").alias("last")))  # to the last window
    twice = classes.filter("n > 1").select("key", "ctx", whole.alias("found"))
    settled = twice.unionByName(found.join(classes.filter("n > 1"), ["key", "ctx"], "left_anti"))
    spanned = lambda x: F.struct((F.col("lo") + x["first"]).alias("start"), (F.col("lo") + F.coalesce(x["last"], F.col("starts") - 1) + min_bytes).alias("end"))
    hit = entries.join(settled, ["key", "ctx"]).select("uid", checksum, place, windows_of, "found").select("uid", "th", F.transform("found", spanned).alias("cover"))
    gathered = lambda hits: hits.groupBy("uid", "th").agg(F.flatten(F.collect_set("cover")).alias("cover"))
    if min_words is None:
        cover = written(gathered(hit))
    else:  # passages of fewer bytes: all are counted, and those looked up that no span found so far holds
        run = "struct<start: long, end: long>"
        passages = written(docs.select(uid.alias("uid"), check.alias("th"), text.alias("text")).mapInArrow(tidy(list_passages), f"uid long, th long, listed array<struct<w1: long, w2: long, n: long, cover: array<{run}>>>"), folder=f"{folder}/passages")

        def count(parts):
            """How often each passage stands in a task's texts; what is common gives one row a task, not one a text."""
            seen: dict[tuple[int, int], int] = {}

            def sums():
                keys = np.array(list(seen), np.int64).reshape(-1, 2)
                return pa.record_batch([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(list(seen.values()), pa.int64())], ["w1", "w2", "n"])

            for batch in parts:
                for p in batch.column("listed").flatten().to_pylist():
                    key = p["w1"], p["w2"]
                    seen[key] = seen.get(key, 0) + p["n"]
                if len(seen) > 100_000:
                    yield sums()
                    seen.clear()
            yield sums()

        again = written(passages.select("listed").mapInArrow(tidy(count), "w1 long, w2 long, n long").groupBy("w1", "w2").agg(F.sum("n").alias("times")).filter("times > 1"), folder=f"{folder}/again")
        hot = again.filter(F.col("times") > hot_times)
        few = hot.count() <= sent_passages
        sent = spark.sparkContext.broadcast(frozenset(map(tuple, hot.select("w1", "w2").collect())) if few else frozenset())

        def part(parts):
            """What hot passages cover in each text, and its other passages."""
            for batch in parts:
                cover, rest = [], []
                for listed in batch.column("listed").to_pylist():
                    known = [p for p in listed if (p["w1"], p["w2"]) in sent.value]
                    cover.append([r for p in known for r in p["cover"]])
                    rest.append([p for p in listed if (p["w1"], p["w2"]) not in sent.value])
                kind = batch.schema.field("listed").type
                yield pa.record_batch([batch.column("uid"), batch.column("th"), pa.array(cover, kind.value_type.field("cover").type), pa.array(rest, kind)], ["uid", "th", "cover", "listed"])

        by_bytes = written(gathered(hit), folder=f"{folder}/by_bytes")
        held = lambda r: F.exists(F.coalesce("cover", F.array().cast(f"array<{run}>")), lambda c: (c["start"] <= r["start"]) & (r["end"] <= c["end"]))
        open_ones = passages.join(by_bytes, ["uid", "th"], "left").select("uid", "th", F.filter("listed", lambda p: ~F.forall(p["cover"], held)).alias("listed"))
        parted = written(open_ones.filter(F.size("listed") > 0).mapInArrow(tidy(part), f"uid long, th long, cover array<{run}>, listed array<struct<w1: long, w2: long, n: long, cover: array<{run}>>>"), folder=f"{folder}/parted")
        looked_up = parted.select("uid", "th", F.inline("listed")).join(again.filter(F.col("times") <= hot_times) if few else again, ["w1", "w2"]).select("uid", "th", "cover")
        short = looked_up.unionByName(parted.filter(F.size("cover") > 0).select("uid", "th", "cover"))
        cover = written(gathered(by_bytes.select("uid", "th", "cover").unionByName(short)))
    if passage_words is None:
        cover = cover.withColumn("passages", F.lit(None).cast(cover.schema["cover"].dataType))
    else:
        located = docs.select(uid.alias("uid"), check.alias("th"), text.alias("text")).withColumn(_MARK, _mark())
        short = repeated_short_passages(located, cover, folder, words=passage_words, below=min_bytes, mark=_MARK)
        cover = written(cover.join(short, ["uid", "th"], "full"))
    removed(spark, folder)  # of entries, levels and all between them and the cover nothing is needed any more
    marks = _marks(cover)
    touched = rows.join(marks, _MARK, "left_semi").join(cover, ["uid", "th"], "left").select("row", "cover", "passages")
    none = F.lit(None).cast(touched.schema["cover"].dataType)
    untouched = rows.join(marks, _MARK, "left_anti").select("row", none.alias("cover"), none.alias("passages"))
    joined = touched.unionByName(untouched)
    span_type = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))
    out_schema = T.StructType().add("row", joined.schema["row"].dataType).add("n_bytes", "long").add("spans", span_type).add("kept", "binary")
    out_schema = out_schema if passage_words is None else out_schema.add("repeated", span_type)

    as_spans = lambda runs: [{"start": a, "end": b} for a, b in runs]

    def remove(parts):
        for batch in parts:
            n_bytes, spans, kept, repeated = [], [], [], []
            for raw, cover, passages in zip(texts_of(batch), batch.column("cover").to_pylist(), batch.column("passages").to_pylist()):
                runs = merged((x["start"], x["end"]) for x in cover or [])
                repeated.append(as_spans(merged([*map(tuple, runs), *((x["start"], x["end"]) for x in passages or [])])))
                if whole_characters:
                    for r in runs:
                        while r[0] < r[1] and raw[r[0]] & 0xC0 == 0x80:
                            r[0] += 1
                        while r[1] < len(raw) and r[1] > r[0] and raw[r[1]] & 0xC0 == 0x80:
                            r[1] -= 1
                    runs = [r for r in runs if r[0] < r[1]]
                at, parts_kept = 0, []
                for a, b in runs:
                    parts_kept.append(raw[at:a])
                    at = b
                n_bytes.append(len(raw))
                spans.append(as_spans(runs))
                kept.append(b"".join([*parts_kept, raw[at:]]))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [batch.column("row"), pa.array(n_bytes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(repeated, kind)]
            yield pa.record_batch(columns[: 1 + len(added)], ["row", *added])

    return joined.mapInArrow(tidy(remove), out_schema).select("row.*", *added)
