"""Removing long passages that an earlier document holds too, by recompression.

A text is a sequence of words.  Each round of recompression names runs of one symbol, then pairs of neighbouring symbols twice:
of two classes that a bit of the names decides, a symbol of the first one followed by one of the second becomes a new symbol.
A new name is a function of the old ones (a hash), so it is the same in every document, and a round needs no dictionary and
no shuffle: Spark's tasks name their own texts, all alike.

With each symbol goes its context, the words that decide that it is there.  A symbol whose context lies within a window is in
every window of the same words, at the same place.  Of those the window's anchor is taken: one of the highest level, of these
the one with the least hash; its key is the name of its context.  So equal windows have equal anchors, and consecutive windows with one anchor are one entry
(about one in twenty words).  Spark then compares what is shared, from high to low:

1. Entries are grouped by anchor and by all their words: the least document of each class; later ones hold all its windows again.
2. Where one anchor, a high symbol, is shared by several classes, one entry of each is read again and its windows' words are
   named by 128 bits: windows that a class of a smaller document holds are repeats.
3. What is found is gathered by document and cut out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm import words
from millwright.llm.common import MARKS, near_ids, removed, shared_dir, text_slices, tidy, written
from millwright.llm.shingles import mix, word_hashes

#: Words of a window, and rounds of naming.
WINDOW_WORDS, ROUNDS = 50, 2
#: Classes with more entries, and windows in more classes, than this are hot; up to so many hot ones (some 40 bytes each) are sent to every task, not joined.
HOT_TIMES, SENT_HOT = 64, 1 << 17
#: Words of a long text that one step takes; steps share all but one word of a window.
_STEP = 1 << 19
_C = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def levels(names: np.ndarray, no: np.ndarray, rounds: int):
    """(names, first words, contexts' first words, words after the contexts) of the symbols after each naming; ``no``: the text of each word.

    A context that reaches an end of its text lies one word beyond it, and so in no window.
    """
    begin = np.flatnonzero(np.diff(np.concatenate([[-1], no])))  # where texts begin
    text = np.cumsum(np.diff(np.concatenate([[-1], no])) != 0) - 1
    stop = np.append(begin[1:], len(no))
    at = np.arange(len(names))
    c0, c1 = at, at + 1
    yield names, at, c0, c1

    def beside():
        """Whether a symbol is its text's first or last one, and contexts of the symbols before and after."""
        first = np.ones(len(names), bool)
        first[1:] = text[1:] != text[:-1]
        last = np.append(first[1:], True)
        return first, last, np.where(first, begin[text] - 1, np.append(0, c0[:-1])), np.where(last, stop[text] + 1, np.append(c1[1:], 0))

    for r in range(rounds):
        first, last, before, after = beside()
        differ = first.copy()
        differ[1:] |= names[1:] != names[:-1]
        head = np.flatnonzero(differ)
        tail = np.append(head[1:], len(names)) - 1
        times = tail - head + 1
        names = np.where(times > 1, mix(names[head] * _C[0] + times.astype(np.uint64)), names[head])
        at, c0, c1, text = at[head], before[head], after[tail], text[head]  # that a run ends is seen from what stands beside it
        yield names, at, c0, c1
        for half in (0, 1):
            first, last, before, after = beside()
            second = (mix(names ^ np.uint64(2 * r + half + 1)) & np.uint64(1)).astype(bool)
            pair = ~second & np.append(second[1:], False) & ~last
            taken = np.append(False, pair[:-1])
            joined = mix(names * _C[1] + mix(np.append(names[1:], names[:1]) ^ _C[2]))
            new0 = np.where(second & ~taken, before, c0)
            new1 = np.where(pair, np.append(c1[1:], 0), np.where(~second & ~pair, after, c1))
            names, at, c0, c1, text = (x[~taken] for x in (np.where(pair, joined, names), at, new0, new1, text))
            yield names, at, c0, c1


def anchors(names: np.ndarray, no: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, level, first word of the context, word after it) of the entries: consecutive windows, by their first words, with one anchor."""
    n = len(names) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 5
    open_ = np.flatnonzero(no[:n] == no[window - 1 :])
    mark, held0, held1 = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    low = np.uint64((1 << 24) - 1)
    known = list(levels(names, no, rounds))
    for level in range(len(known) - 1, -1, -1):
        symbols, at, c0, c1 = known[level]
        a, b = np.searchsorted(c0, open_), np.searchsorted(c1, open_ + window, side="right")
        held = a < b
        rows, a, b = open_[held], a[held], b[held]
        open_ = open_[~held]
        if not len(rows):
            continue
        tables = [(mix(symbols) & ~low) | np.arange(len(symbols), dtype=np.uint64)]
        width = np.log2(b - a).astype(np.int64)
        for k in range(int(width.max())):  # least hash of the 2 ** k symbols from each on
            tables.append(np.minimum(tables[-1], np.append(tables[-1][1 << k :], np.full(min(1 << k, len(symbols)), ~np.uint64(0)))))
        table = np.stack(tables)
        best = (np.minimum(table[width, a], table[width, b - (1 << width)]) & low).astype(np.int64)
        mark[rows], held0[rows], held1[rows] = level << 24 | best, c0[best], c1[best]
    new = np.ones(n, bool)
    new[1:] = mark[1:] != mark[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    real = mark[first] >= 0
    first, last = first[real], last[real]
    return first, last, mark[first] >> 24, held0[first], held1[first]


def _entries(texts: list[bytes], window: int, rounds: int) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, name of the anchor's context, name of all words) of the entries of some texts, whose words have one space between."""
    raw = b"\xff".join(texts) + b"\xff"
    data = np.frombuffer(raw, np.uint8)
    starts, ends, no = words.space_words(data)
    first, last, level, c0, c1 = anchors(word_hashes(data, starts, ends), no, window, rounds)
    key = [xxhash.xxh3_64_intdigest(raw[a:b], k) for a, b, k in zip(starts[c0].tolist(), ends[c1 - 1].tolist(), level.tolist())]
    named = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[first].tolist(), ends[last + window - 1].tolist())]
    begin = np.searchsorted(no, np.arange(len(texts)))
    return no[first], first - begin[no[first]], last - first + 1, *(np.array(x, np.uint64).view(np.int64) for x in (key, named))


def list_entries(texts: list[str], window: int, rounds: int):
    """The entries of a slice of texts, in one step; those of a long text in several."""
    if len(texts) > 1:
        yield _entries([b" ".join(t.encode("utf-8", "replace").split()) for t in texts], window, rounds)
        return
    parts = texts[0].encode("utf-8", "replace").split() if texts else []
    for shift in range(0, len(parts), _STEP):
        text, at, *rest = _entries([b" ".join(parts[shift : shift + _STEP + window - 1])], window, rounds)
        yield text, at + shift, *rest


def window_names(text: str, places: list[tuple[int, int]], window: int) -> list[np.ndarray]:
    """128-bit names, two numbers each, of the windows from ``first`` on, ``n`` of them, for each (first, n)."""
    raw = b" ".join(text.encode("utf-8", "replace").split())
    starts, ends, _ = words.space_words(np.frombuffer(raw + b"\xff", np.uint8))
    found = []
    for first, n in places:
        a, b = starts[first : first + n].tolist(), ends[first + window - 1 : first + window - 1 + n].tolist()
        found.append(np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(a, b)), np.int64).reshape(-1, 2))
    return found


def _looked_up(rows: DataFrame, known: DataFrame, keys: list[str], sent_hot: int) -> DataFrame:
    """``rows`` joined with ``known``, which says in n how many rows each of its keys has; hot keys are not shuffled, unless there are too many of them to send."""
    hot = known.filter(F.col("n") > HOT_TIMES)
    if not 0 < hot.count() <= sent_hot:
        return rows.join(known.drop("n"), keys)
    sent = F.broadcast(hot.drop("n"))
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(known.filter(F.col("n") <= HOT_TIMES).drop("n"), keys)
    return rows.join(sent, keys).unionByName(rest)


def _repeated_windows(rows: DataFrame, live: DataFrame, classes: DataFrame, folder: str, window: int, sent_hot: int) -> DataFrame:
    """(key, ctx, m, found) of the classes with windows that a class of a smaller document holds; found: first and last of each run of such windows."""
    spark = rows.sparkSession
    shared = classes.groupBy("key").agg(F.count("*").alias("n"), F.min("m").alias("least"), F.max("m").alias("most")).filter("least < most").select("key", "n")
    contested = _looked_up(classes.select("key", "ctx", "m", "th", "at"), written(shared, folder=f"{folder}/shared"), ["key"], sent_hot)
    wanted = written(contested.groupBy(F.col("m").alias("doc"), "th").agg(F.collect_list(F.struct("key", "ctx", "at")).alias("wanted")), folder=f"{folder}/wanted")

    def name(batches):
        for batch in batches:
            for doc, text, w in zip(batch.column("doc"), batch.column("text").to_pylist(), batch.column("wanted")):
                w = pa.RecordBatch.from_struct_array(w.values)
                at = w["at"].to_numpy()
                named = window_names(text, list(zip((at >> 16).tolist(), (at & 0xFFFF).tolist())), window)
                bounds = pa.array(np.cumsum([0, *map(len, named)]), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(named)[:, k])) for k in (0, 1)]
                yield pa.record_batch([w["key"], w["ctx"], pa.array(np.full(len(at), doc.as_py())), *lists], ["key", "ctx", "m", "w1", "w2"])

    texts = near_ids(rows.select("doc", "th", "text"), wanted, "doc", "doc").join(wanted, ["doc", "th"]).select("doc", "text", "wanted")
    named = written(texts.mapInArrow(tidy(name), "key long, ctx long, m long, w1 array<long>, w2 array<long>"), folder=f"{folder}/named")

    def laid_out(batch: pa.RecordBatch):
        """Row, place in its entry, and both halves of the name of each window."""
        lists = batch.column("w1")
        size = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(size)), size)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size), *(batch.column(c).flatten().to_numpy() for c in ("w1", "w2"))

    def count(batches):
        """The classes that hold a window, and their least and greatest document; one row for each window of a batch."""
        for batch in batches:
            row, _, w1, w2 = laid_out(batch)
            m = batch.column("m").to_numpy()[row]
            order = np.lexsort((m, w2, w1))
            w1, w2, m = w1[order], w2[order], m[order]
            new = np.flatnonzero(np.append(True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]))) if len(m) else np.zeros(0, np.int64)
            stop = np.append(new[1:], len(m))[: len(new)]
            yield pa.record_batch([pa.array(w1[new]), pa.array(w2[new]), pa.array(m[new]), pa.array(m[stop - 1]), pa.array(stop - new)], ["w1", "w2", "first", "last", "n"])

    counted = named.mapInArrow(tidy(count), "w1 long, w2 long, first long, last long, n long").groupBy("w1", "w2").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    repeated = written(counted.filter("first < last").select("w1", "w2", "first", "n"), folder=f"{folder}/repeated")
    hot = repeated.filter(F.col("n") > HOT_TIMES)
    few = 0 < hot.count() <= sent_hot
    table = hot.select("w1", "w2", "first").orderBy("w1", "w2").toArrow() if few else None
    sent = spark.sparkContext.broadcast([table[c].to_numpy() for c in ("w1", "w2", "first")] if few else None)

    def look_up(batches):
        """Runs of hot repeats, without names, and each window that is not hot with its own."""
        for batch in batches:
            row, at, w1, w2 = laid_out(batch)
            m = batch.column("m").to_numpy()[row]
            known = repeat = np.zeros(len(row), bool)
            if sent.value:
                h1, h2, first = sent.value
                place = np.minimum(np.searchsorted(h1, w1), len(h1) - 1)  # of equal first halves, only the first is looked up here
                known = (h1[place] == w1) & (h2[place] == w2)
                repeat = known & (first[place] < m)
            r, a = row[repeat], at[repeat]
            begin = np.flatnonzero(np.append(True, (a[1:] != a[:-1] + 1) | (r[1:] != r[:-1]))) if len(r) else np.zeros(0, np.int64)
            stop = np.append(begin[1:], len(r))[: len(begin)] - 1
            rows = np.concatenate([r[begin], row[~known]])
            nothing = pa.nulls(len(begin), pa.int64())
            places = [pa.array(np.concatenate([x, at[~known]])) for x in (a[begin], a[stop])]
            yield pa.record_batch([*(batch.column(c).take(pa.array(rows)) for c in ("key", "ctx", "m")), *places, *(pa.concat_arrays([nothing, pa.array(w[~known])]) for w in (w1, w2))], ["key", "ctx", "m", "from", "to", "w1", "w2"])

    looked = written(named.mapInArrow(tidy(look_up), "key long, ctx long, m long, from long, to long, w1 long, w2 long"), folder=f"{folder}/looked")
    sent.destroy()
    rest = looked.filter("w1 is not null").join(repeated.drop("n"), ["w1", "w2"]).filter("first < m")
    both = looked.filter("w1 is null").select("key", "ctx", "m", "from", "to").unionByName(rest.select("key", "ctx", "m", "from", "to"))
    return both.groupBy("key", "ctx", "m").agg(F.collect_set(F.struct("from", "to")).alias("found"))


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS, rounds: int = ROUNDS, sent_hot: int = SENT_HOT) -> DataFrame:
    """Every text without the words that a window of ``window`` words covers which also starts in a document of smaller id.

    Words lie between spaces and the controls 9 to 13.  Adds to the columns of ``docs``, replacing any so named: n_words long, spans
    array<struct<start, end>> (maximal runs of removed words, counted from 0), kept string (the other words, one space between).
    Windows are judged on the input, not on what is left.

    A null text counts as empty; texts shorter than a window stay whole, but for their white space; a row with a null id is neither
    less nor greater than others, so it loses nothing and makes no other lose; rows of one id make each other lose nothing, repeated
    rows lose the same; very long texts are read in steps that overlap, with the same result; an empty table gives an empty one.
    """
    if not 1 <= window < 1 << 16:
        raise ValueError("a window has 1 to 65535 words")
    spark = docs.sparkSession
    folder = shared_dir(spark)
    others = [c for c in docs.columns if c.lower() not in ("n_words", "spans", "kept")]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("_")).alias("row"), F.col(id_col).cast("long").alias("doc"), F.crc32(F.encode(text, "UTF-8")).alias("th"), text.alias("text"))

    def listed(batches):
        for batch in batches:
            for lo, hi in text_slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                for owner, first, n, key, ctx in list_entries(part.column("text").to_pylist(), window, rounds):
                    yield pa.record_batch([pa.array(key), pa.array(ctx), *(part.column(c).take(pa.array(owner)) for c in ("doc", "th")), pa.array(first << 16 | n)], ["key", "ctx", "doc", "th", "at"])

    known = rows.filter("doc is not null")
    entries = written(known.select("doc", "th", "text").mapInArrow(tidy(listed), "key long, ctx long, doc long, th long, at long"), folder=f"{folder}/entries")
    shared = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").select("key", "n")
    live = written(_looked_up(entries, written(shared, folder=f"{folder}/keys"), ["key"], sent_hot), folder=f"{folder}/live")  # anchors of two documents
    removed(spark, f"{folder}/entries")
    grouped = live.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min("doc").alias("m"), F.max("doc").alias("most"), F.min_by("at", "doc").alias("at"), F.min_by("th", "doc").alias("th"))
    classes = written(grouped, folder=f"{folder}/classes")
    found = written(_repeated_windows(known, live, classes, folder, window, sent_hot), folder=f"{folder}/found")
    again = classes.filter("m < most").select("key", "ctx", "m", "n")
    settled = written(again.join(found, ["key", "ctx", "m"], "full").withColumn("n", F.coalesce("n", F.lit(0))), folder=f"{folder}/settled")
    span = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    first, n = F.shiftright("at", 16), F.col("at").bitwiseAND(0xFFFF)
    whole = F.array(span(first, first + n - 1 + window))
    in_part = F.transform("found", lambda f: span(first + f["from"], first + f["to"] + window))
    hits = _looked_up(live, settled, ["key", "ctx"], sent_hot).select("doc", "th", F.when(F.col("doc") > F.col("m"), whole).when(F.col("doc") == F.col("m"), in_part).alias("cover")).filter("cover is not null")
    cover = written(hits.groupBy("doc", "th").agg(F.flatten(F.collect_set("cover")).alias("cover")))
    removed(spark, folder)

    kind = cover.schema["cover"].dataType
    nothing = F.lit(None).cast(kind)
    mark = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS)).alias("mark")
    marks = F.broadcast(cover.select(mark("doc")).distinct())
    marked = rows.withColumn("mark", mark("doc"))
    touched = marked.join(marks, "mark", "left_semi").join(cover, ["doc", "th"], "left").select("row", "text", "cover")
    joined = touched.unionByName(marked.join(marks, "mark", "left_anti").select("row", "text", nothing.alias("cover")))
    schema = T.StructType([T.StructField("row", joined.schema["row"].dataType), *T.StructType().add("n_words", "long").add("spans", kind).add("kept", "string")])

    def cut(batches):
        for batch in batches:
            for lo, hi in text_slices(batch.column("text"), 4 << 20):
                part = batch.slice(lo, hi - lo)
                count, spans, kept = [], [], []
                for text, cover in zip(part.column("text").to_pylist(), part.column("cover").to_pylist()):
                    parts, runs = text.encode("utf-8", "replace").split(), []
                    for x in sorted(cover or [], key=lambda x: x["start"]):
                        if runs and x["start"] <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], x["end"])
                        else:
                            runs.append([x["start"], x["end"]])
                    count.append(len(parts))
                    spans.append([{"start": a, "end": b} for a, b in runs])
                    edges = [0, *(e for r in runs for e in r), len(parts)]
                    kept.append(b" ".join(w for a, b in zip(edges[::2], edges[1::2]) for w in parts[a:b]).decode())
                yield pa.record_batch([part.column("row"), pa.array(count, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())], schema.names)

    out = joined.mapInArrow(tidy(cut), schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in others], "n_words", "spans", "kept")
