"""N-gram Jaccard join by grouped prefixes.

1. The documents that hold a shingle are counted exactly, by cell (the low bits of its hash): an aggregation over all documents
   that is combined before it is shuffled.  Only shingles in the first part of the hash range are counted, a part that holds
   more of a set than a prefix needs.  Counted shingles stand first, by hash; then the others; last the hot ones, which more
   than ``hot_count`` documents hold, by count.  So what many documents share is kept out of prefixes.
2. Documents with equal sets become one class.  A class keeps the first shingles in that order, so many that two sets as
   similar as asked must share one (prefix filter).  Classes with equal prefix and size become one group.
3. Groups that share a cold prefix shingle (counted and not hot: at most ``hot_count`` of them do) are paired, and pairs are
   filtered by size, by the places of the shared shingles, and by how many of them there are.  Groups that share another one,
   as large groups of near copies do, are tied to one leader in each size band instead: as many ties as groups, whatever
   their number.  What hangs together is a cluster.
4. Clusters are expanded to their classes, whose whole sets are compared; classes that already hang together are not
   compared again.  Members of a cluster too large for one task are compared with leaders first, dealt out evenly; what may
   link with a leader's ball from outside is compared with the ball, and what no leader takes in with itself, block by block.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import near_ids, pick, removed, runs, shared_dir, text_slices, tidy, written
from millwright.llm.graph import components
from millwright.llm.shingles import shingle_sets
from millwright.llm.words import gather

#: A cell that more documents hold than this is hot.
HOT_COUNT = 24
#: Low bits of a shingle's hash that make its cell.
CELL_BITS = 44
#: Hot cells are sent to every executor up to this many (16 bytes each); beyond it they are joined.
SENT_CELLS = 1 << 20
#: Shingles of a cluster's classes that one task compares; leaders that a larger cluster is compared with, one after the other, and pilots of a leader's ball.
CLUSTER_SHINGLES, LEADERS, PILOTS = 400_000, 6, 3
_CELL = np.uint64((1 << CELL_BITS) - 1)


def linked(hashes: np.ndarray, offsets: np.ndarray, percent: int) -> np.ndarray:
    """For each set, the least index that it hangs together with by links of at least ``percent``; sets are non-empty."""
    m = len(offsets) - 1
    size = np.diff(offsets)
    label = np.arange(m)
    _, token, count = np.unique(hashes, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size)
    shared = count[token] > 1
    token, owner = token[shared], owner[shared]
    held = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=m))])
    by_token = owner[np.argsort(token, kind="stable")]
    count[count < 2] = 0
    at = np.concatenate([[0], np.cumsum(count)])
    for i in range(m - 1):
        could = (100 * np.minimum(size[i], size[i + 1 :]) >= percent * np.maximum(size[i], size[i + 1 :])) & (label[i + 1 :] != label[i])
        if not could.any():
            continue
        meets, _ = gather(by_token, at, token[held[i] : held[i + 1]])
        common = np.bincount(meets, minlength=m)[i + 1 :]
        links = np.flatnonzero(could & (100 * common >= percent * (size[i] + size[i + 1 :] - common))) + i + 1
        for other in np.unique(label[links]).tolist():
            a, b = sorted((int(label[i]), other))
            label[label == b] = a
    return label


def linked_across(hashes: np.ndarray, offsets: np.ndarray, left: int, percent: int) -> np.ndarray:
    """For each set after the first ``left``, the first of these that it links with, or -1."""
    size = np.diff(offsets)
    _, token = np.unique(hashes, return_inverse=True)
    cut = offsets[left]
    by_token = np.repeat(np.arange(left), size[:left])[np.argsort(token[:cut], kind="stable")]
    at = np.concatenate([[0], np.cumsum(np.bincount(token[:cut], minlength=int(token.max()) + 1 if len(token) else 0))])
    found = np.full(len(size) - left, -1)
    for i in range(left, len(size)):
        meets, _ = gather(by_token, at, token[offsets[i] : offsets[i + 1]])
        common = np.bincount(meets, minlength=left)
        links = np.flatnonzero(100 * common >= percent * (size[i] + size[:left] - common))
        if len(links):
            found[i - left] = links[0]
    return found


def _sets(column: pa.Array, width: int):
    """(first row, row after the last, hashes, offsets) of a text column, some rows at a time."""
    for lo, hi in text_slices(column):
        yield lo, hi, *shingle_sets(column.slice(lo, hi - lo).to_pylist(), width)


def _counted(percent: int) -> np.uint64:
    """Hashes up to this are counted: two and a half times the part of a set that its prefix is."""
    return np.uint64(min(1.0, 0.025 * (100 - percent) + 0.01) * (2.0**64 - 4096))


def _hot_cells(rows: DataFrame, width: int, percent: int, hot_count: int) -> DataFrame:
    """(cell, df) of the counted cells that more than ``hot_count`` documents hold."""
    last = _counted(percent)

    def cells(batches):
        for batch in batches:
            for _, _, hashes, _ in _sets(batch.column("text"), width):
                yield pa.record_batch([pa.array((hashes[hashes <= last] & _CELL).view(np.int64))], ["cell"])

    return rows.select("text").mapInArrow(tidy(cells), "cell long").groupBy("cell").agg(F.count("*").alias("df")).filter(F.col("df") > hot_count)


def _with_hot(rows: DataFrame, hot: DataFrame, width: int) -> DataFrame:
    """``rows`` with the hot cells that each text holds and their counts, by a join of all cells."""

    def cells(batches):
        for batch in batches:
            for lo, hi, hashes, offsets in _sets(batch.column("text"), width):
                owner = pa.array(np.repeat(np.arange(lo, hi), np.diff(offsets)))
                yield pa.record_batch([batch.column("doc_id").take(owner), batch.column("th").take(owner), pa.array((hashes & _CELL).view(np.int64))], ["doc_id", "th", "cell"])

    held = rows.select("doc_id", "th", "text").mapInArrow(tidy(cells), "doc_id long, th long, cell long").join(hot, "cell").distinct()
    lists = held.groupBy("doc_id", "th").agg(F.collect_list(F.struct("cell", "df")).alias("hot"))
    same = (rows["doc_id"].eqNullSafe(lists["doc_id"])) & (rows["th"] == lists["th"])
    return rows.join(lists, same, "left").select(rows["doc_id"], rows["th"], "text", F.col("hot.cell").alias("cells"), F.col("hot.df").alias("counts"))


def _signed(rows: DataFrame, width: int, percent: int, hot_count: int, sent_cells: int) -> DataFrame:
    """Set size, signature and prefix of each row: th is a checksum of the text, cold says how many prefix shingles are cold."""
    hot = written(_hot_cells(rows, width, percent, hot_count))
    last = _counted(percent)
    few = hot.count() <= sent_cells
    sent = hot.orderBy("cell").toArrow() if few else None  # arrays of 16 bytes a cell, no rows
    every = rows.sparkSession.sparkContext.broadcast(tuple(sent[c].to_numpy() for c in ("cell", "df")) if few and sent.num_rows else ())
    marked = rows if few else _with_hot(rows, hot, width)

    def sign(batches):
        none = np.zeros(0, np.int64)
        for batch in batches:
            for lo, hi, hashes, offsets in _sets(batch.column("text"), width):
                part = batch.slice(lo, hi - lo)
                size = np.diff(offsets)
                owner = np.repeat(np.arange(hi - lo), size)
                cell = (hashes & _CELL).view(np.int64)
                if few:
                    known, counts = every.value or (none, none)
                else:
                    known, counts = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cells", "counts"))
                    known, first = np.unique(known, return_index=True)
                    counts = counts[first]
                df = np.zeros(len(cell), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, cell), len(known) - 1)
                    df = np.where((known[at] == cell) & (hashes <= last), counts[at], 0)
                kind = np.where(df > 0, 2, (hashes > last).astype(np.int64))
                order = np.lexsort((hashes, df, kind, owner))
                need = np.minimum(size, size - (percent * size + 99) // 100 + 1)
                kept = order[np.arange(len(order)) - offsets[:-1][owner] < need[owner]]
                bounds = np.concatenate([[0], np.cumsum(need)])
                cold = np.bincount(owner[kept], weights=kind[kept] == 0, minlength=hi - lo).astype(np.int64)
                raw, prefix = hashes.tobytes(), hashes[kept]
                sig = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
                pre = prefix.tobytes()
                key = [int.from_bytes(hashlib.blake2b(pre[8 * a : 8 * b], digest_size=8).digest(), "little", signed=True) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
                tokens = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(prefix.view(np.int64)))
                yield pa.record_batch([part.column("doc_id"), part.column("th"), pa.array(size), pa.array(sig, pa.binary()), pa.array(key, pa.int64()), pa.array(cold), tokens], ["doc_id", "th", "n", "sig", "prefix_key", "cold", "prefix"])

    signed = written(marked.mapInArrow(tidy(sign), "doc_id long, th long, n long, sig binary, prefix_key long, cold long, prefix array<long>"))
    every.destroy()  # what it was for is written
    return signed


def _group_edges(groups: DataFrame, percent: int) -> DataFrame:
    """(src, dst): filtered pairs of groups that share a cold prefix shingle, and ties of those that share another one.

    A pair's sets share no more than what their prefixes share and the larger rest of the two.  Of the prefixes, cold
    shingles are counted, and of others as many taken as shared as either has.
    """
    postings = groups.select("gid", "n", "cold", F.size("prefix").alias("p"), F.posexplode("prefix").alias("at", "token"))
    cold, hot = postings.filter("at < cold").select("token", "gid", "n", "at", (F.col("p") - F.col("cold")).alias("other"), (F.col("n") - F.col("p")).alias("rest")), postings.filter("at >= cold")
    a, b = cold.alias("a"), cold.alias("b")
    met = a.join(b, F.expr(f"a.token = b.token and a.gid < b.gid and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)"))
    best = F.max(F.expr("least(a.n - a.at, b.n - b.at)")).alias("from_first")
    counted = met.groupBy(F.col("a.gid").alias("src"), F.col("b.gid").alias("dst")).agg(F.count("*").alias("common"), best, *[F.first(F.expr(e)).alias(c) for c, e in (("other", "least(a.other, b.other)"), ("rest", "greatest(a.rest, b.rest)"), ("both", "a.n + b.n"))])
    pairs = counted.filter(f"({percent} + 100) * least(from_first, common + other + rest) >= {percent} * both").select("src", "dst")
    ratio = float(-np.log(max(percent - 1, 1) / 100))  # sets that can link are in the same or in neighbouring size bands
    banded = hot.select("token", "gid", F.floor(F.log("n") / ratio).cast("int").alias("band"))
    leaders = banded.groupBy("token", "band").agg(F.min("gid").alias("leader"))
    stars = banded.join(leaders, ["token", "band"]).select(F.col("gid").alias("src"), F.col("leader").alias("dst"))
    below = leaders.select("token", (F.col("band") + 1).alias("band"), F.col("leader").alias("other"))
    bridges = leaders.join(below, ["token", "band"]).select(F.col("leader").alias("src"), F.col("other").alias("dst"))
    return pairs.unionByName(stars).unionByName(bridges).filter("src <> dst").distinct()


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, hot_count: int = HOT_COUNT, sent_cells: int = SENT_CELLS, cluster_shingles: int = CLUSTER_SHINGLES) -> DataFrame:
    """Documents that hang together by links, where two link when 100 * |A ∩ B| >= percent * |A ∪ B| over their shingle sets.

    Returns one row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).  A null
    text or one without words has no shingles and links with nothing; a row with a null id links with nothing and has a null
    component; repeated rows are in one component, and so are all texts under one id; very long texts are compared whole;
    equal counts are ordered by hash; an empty table gives an empty one; other columns are left aside.
    """
    rows = pick(docs, id_col, text_col).withColumn("th", F.crc32(F.encode("text", "UTF-8")))
    signed = _signed(rows, shingle_words, percent, hot_count, sent_cells)
    named = signed.filter("n > 0 and doc_id is not null")
    classes = written(named.groupBy("sig").agg(F.min(F.struct("doc_id", "th")).alias("least"), F.first("n").alias("n"), F.first("prefix_key").alias("prefix_key"), F.first("cold").alias("cold"), F.first("prefix").alias("prefix")).select("sig", F.col("least.doc_id").alias("rep"), F.col("least.th").alias("th"), "n", "prefix_key", "cold", "prefix"))
    groups = classes.groupBy("n", "prefix_key").agg(F.min("rep").alias("gid"), F.first("cold").alias("cold"), F.first("prefix").alias("prefix"))
    clusters = components(_group_edges(groups, percent)).select(F.col("node").alias("gid"), F.col("component").alias("cluster"))

    of_group = classes.groupBy("n", "prefix_key").agg(F.min("rep").alias("gid"))
    members = classes.select("rep", "th", "n", "prefix_key").join(of_group, ["n", "prefix_key"])
    folder = shared_dir(docs.sparkSession)  # of what is needed no more once clusters are settled
    members = written(members.join(clusters, "gid", "left").select("rep", "th", "n", F.coalesce("cluster", "gid").alias("cluster")), folder=f"{folder}/members")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("classes"), F.sum("n").alias("size")).filter("classes > 1").drop("classes")
    wanted = written(members.join(sizes, "cluster").select("cluster", "rep", "th", "n", "size"), folder=f"{folder}/wanted")
    texts = near_ids(rows, wanted, "doc_id", "rep")
    chosen = written(wanted.join(texts.select(F.col("doc_id").alias("rep"), "th", "text"), ["rep", "th"]).dropDuplicates(["cluster", "rep", "th"]), folder=f"{folder}/chosen")

    def verify(batches):
        """The classes of a part that hang together."""
        for _, table in runs(batches, "part"):
            reps = table["rep"].to_numpy()
            sets = [s[2:] for chunk in table["text"].chunks for s in _sets(chunk, shingle_words)]
            hashes = np.concatenate([h for h, _ in sets])
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in sets]))])
            label = linked(hashes, offsets, percent)
            roots = np.full(len(reps), np.iinfo(np.int64).max)
            np.minimum.at(roots, label, reps)
            yield pa.record_batch([pa.array(reps), pa.array(roots[label])], ["src", "dst"])

    schema = "src long, dst long"
    dealt = lambda parts: parts.select("part", "rep", "text").repartition("part").sortWithinPartitions("part").mapInArrow(tidy(verify), schema)
    found = dealt(chosen.filter(F.col("size") <= cluster_shingles).withColumn("part", F.col("cluster")))
    large = chosen.filter(F.col("size") > cluster_shingles)
    if not large.isEmpty():
        found = found.unionByName(_large_clusters(large, shingle_words, percent, cluster_shingles, dealt, folder))
    labelled = components(found).select(F.col("node").alias("rep"), F.col("component").alias("component_id"))
    removed(docs.sparkSession, folder)

    per_class = classes.select("sig", "rep").join(labelled, "rep", "left").select("sig", F.coalesce("component_id", "rep").alias("component_id"))
    placed = named.select("doc_id", "n", "sig").join(per_class, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = signed.filter("not (n > 0 and doc_id is not null)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return placed.unionByName(alone)


def _large_clusters(large: DataFrame, width: int, percent: int, cluster_shingles: int, dealt, folder: str) -> DataFrame:
    """(src, dst) of classes that hang together in clusters too large for one task; ``large``: cluster, rep, th, n, text.

    Rounds: one leader of each cluster is compared with what is left of it.  Those that link with it, its ball, hang together
    and leave.  1 - similarity is a distance, so of the others only those twice as far as a link allows, the ring, can link with
    members of the ball.  The ring is compared with a few pilots of the ball, and what links with none of them with the whole
    ball, block by block.  What no ball took in after the last round is compared with itself, block by block.  So each pair that
    may link and does not hang together yet meets once.
    """
    spark = large.sparkSession
    ids = ["rep", "th"]
    near, far = percent, max(0, 2 * percent - 100)
    half = max(1, cluster_shingles // 2)
    texts = large.select(*ids, "text")

    def meet(batches):
        """Rows that link with the text they come with (link), or are in its ring."""
        last = None
        for batch in batches:
            for lo, hi, hashes, offsets in _sets(batch.column("text"), width):
                at, link = [], []
                for k, (leader, text) in enumerate(zip(*(batch.column(c).slice(lo, hi - lo).to_pylist() for c in ("leader", "leader_text")))):
                    if last is None or last[:2] != (leader, text):
                        last = leader, text, shingle_sets([text], width)[0]
                    own = hashes[offsets[k] : offsets[k + 1]]
                    common = len(np.intersect1d(own, last[2], assume_unique=True))
                    union = len(own) + len(last[2]) - common
                    if 100 * common >= far * union:
                        at.append(lo + k)
                        link.append(100 * common >= near * union)
                rows = pa.array(at, pa.int64())
                yield pa.record_batch([*(batch.column(c).take(rows) for c in ("cluster", "rep", "th", "n", "leader")), pa.array(link, pa.bool_())], ["cluster", "rep", "th", "n", "leader", "link"])

    def met(rows: DataFrame, leaders: DataFrame, name: str) -> DataFrame:
        """``rows`` (cluster, rep, th, n) with each of their cluster's ``leaders`` (cluster, leader, leader_th) that they are near to."""
        own = texts.toDF("leader", "leader_th", "leader_text")
        led = rows.join(texts, ids).join(leaders.join(own, ["leader", "leader_th"]).drop("leader_th"), "cluster")
        return written(led.mapInArrow(tidy(meet), "cluster long, rep long, th long, n long, leader long, link boolean"), folder=f"{folder}/{name}")

    def across(batches):
        """Members of the ring with one of the ball that they link with."""
        for _, table in runs(batches, "part"):
            reps, left = table["rep"].to_numpy(), int((table["side"].to_numpy() == 0).sum())
            if 0 < left < len(reps):
                sets = [s[2:] for chunk in table["text"].chunks for s in _sets(chunk, width)]
                hashes, offsets = np.concatenate([h for h, _ in sets]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in sets]))])
                hit = linked_across(hashes, offsets, left, percent)
                found = np.flatnonzero(hit >= 0)
                yield pa.record_batch([pa.array(reps[left + found]), pa.array(reps[hit[found]])], ["src", "dst"])

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with a block and how many there are in their cluster."""
        sized = rows.groupBy("cluster").agg(F.ceil(F.sum("n") / half).cast("int").alias(f"{name}s"))
        return rows.join(sized, "cluster").withColumn(name, F.pmod(F.xxhash64("rep"), F.col(f"{name}s")).cast("int"))

    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    first = lambda k: F.min_by(F.struct(*ids), F.struct(F.xxhash64("rep", F.lit(k)), "rep", "th"))
    rest, found = written(large.select("cluster", *ids, "n"), folder=f"{folder}/rest"), []
    for k in range(LEADERS):
        crowded = rest.groupBy("cluster").agg(F.sum("n").alias("left"), first(0).alias("l")).filter(F.col("left") > cluster_shingles)
        leaders = crowded.select("cluster", F.col("l.rep").alias("leader"), F.col("l.th").alias("leader_th"))
        if leaders.isEmpty():
            break
        near_by = met(rest, leaders, f"met{k}")
        ball, ring = near_by.filter("link"), near_by.filter("not link")
        found.append(ball.select(F.col("rep").alias("src"), F.col("leader").alias("dst")))
        pilots = ball.groupBy("cluster").agg(F.array_distinct(F.array(*map(first, range(1, PILOTS + 1)))).alias("p")).select("cluster", F.explode("p").alias("p")).select("cluster", F.col("p.rep").alias("leader"), F.col("p.th").alias("leader_th"))
        tried = met(ring.select("cluster", *ids, "n"), pilots, f"tried{k}").filter("link")
        found.append(tried.select(F.col("rep").alias("src"), F.col("leader").alias("dst")))
        open_ring = ring.join(tried.select(*ids).distinct(), ids, "left_anti")
        left, right = blocks(ball.select("cluster", *ids, "n"), "x"), blocks(open_ring.select("cluster", *ids, "n"), "y")
        one = left.join(right.select("cluster", "ys").distinct(), "cluster").withColumn("y", to("ys")).withColumn("side", F.lit(0))
        two = right.join(left.select("cluster", "xs").distinct(), "cluster").withColumn("x", to("xs")).withColumn("side", F.lit(1))
        units = one.select("cluster", "x", "y", "side", *ids).unionByName(two.select("cluster", "x", "y", "side", *ids)).join(texts, ids)
        placed = units.select(F.xxhash64("cluster", "x", "y").alias("part"), "side", "rep", "text").repartition("part").sortWithinPartitions("part", "side")
        found.append(written(placed.mapInArrow(tidy(across), "src long, dst long"), folder=f"{folder}/across{k}"))
        rest = written(rest.join(ball.select(*ids), ids, "left_anti"), folder=f"{folder}/rest{k}")
    sized = blocks(rest, "x")
    both = sized.withColumn("y", to("xs")).join(texts, ids)
    found.append(dealt(both.select(F.xxhash64("cluster", F.least("x", "y"), F.greatest("x", "y")).alias("part"), "rep", "text")))
    return reduce(DataFrame.unionByName, found)
