"""Joins of units, headers, tasks, decisions, logs, intervals and nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.columns import basename, extract_includes
from millwright.operators.ordered import in_order
from millwright.sources.shared import cut_lineage

#: Like nodes at most that a task of a cost matrix meets at once, and parts of the nodes.
NODE_BUNDLE, NODE_PARTS = 256, 4


def tasks_with_decisions(tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every task with each of its decisions; one without any keeps its row."""
    return tasks.join(decisions.select("task_id", "confidence", "attempt"), "task_id", "left")


def latest_decision(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("task_id").agg(F.max_by(F.struct("node_id", "confidence", "attempt"), "attempt").alias("x")).select("task_id", "x.*")


def _folders(paths: DataFrame) -> DataFrame:
    """(folder, name, target) for each folder, near or far above, and each file name below it: the least path of that name; the folder '' is above all."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    above = F.explode(F.array_union(F.array(F.lit("")), F.when(F.size(parts) > 1, above).otherwise(F.array()))).alias("folder")
    return paths.select(F.col("path").alias("target"), basename("path").alias("name"), above).groupBy("folder", "name").agg(F.min("target").alias("target"))


def resolve_includes(sources: DataFrame, paths: DataFrame) -> DataFrame:
    """(file_id, n, name, target): where the n-th include of each source lies; ``sources``: file_id, path, text, search (folders in order).

    A name with a / is a path below the includer's folder or, in their order, below a search folder, or nothing.  A bare name is
    looked for in and below the includer's folder, then each search folder in order, then anywhere; of several files the least path
    counts.  Each round looks up what the one before has left, by (folder, name); every lookup meets one row at most.
    """
    key = ["file_id", "n"]
    folder = F.regexp_replace("path", "/[^/]*$", "")
    inc = sources.select("file_id", "search", folder.alias("folder"), F.posexplode(extract_includes(F.col("text"))).alias("n", "name"))
    inc = cut_lineage(inc.withColumn("deep", F.contains("name", F.lit("/"))))
    exact = paths.select(F.concat(F.lit("/"), "path").alias("folder"), F.lit("").alias("name"), F.col("path").alias("target"))  # whole paths, told from folders by a leading /
    index = cut_lineage(_folders(paths).unionByName(exact.distinct()))

    def asked(rows: DataFrame, at: str) -> DataFrame:
        """What to look up for a name in the folder ``at``: the folder and the name, or the whole path of a name with a /."""
        deep = F.col("deep")
        return rows.withColumns({"at": F.when(deep, F.concat_ws("/", F.lit(""), at, "name")).otherwise(F.col(at)), "ask": F.when(deep, "").otherwise(F.col("name"))})

    known = index.toDF("at", "ask", "target")
    own = cut_lineage(asked(inc, "folder").join(known, ["at", "ask"], "left").select(*key, "name", "search", "deep", "target"))
    first = own.filter("target is not null").select(*key, "name", "target")
    left = own.filter("target is null").drop("target")
    dirs = asked(left.select(*key, "name", "deep", F.posexplode("search").alias("place", "dir")), "dir").join(known, ["at", "ask"])
    second = cut_lineage(dirs.groupBy(*key, "name").agg(F.min_by("target", "place").alias("target")))
    left = left.join(second, key, "left_anti")
    anywhere = known.filter("at = ''").select(F.col("ask").alias("name"), "target")
    bare = left.filter("not deep").join(anywhere, "name", "left").select(*key, "name", "target")
    nowhere = left.filter("deep").select(*key, "name", F.lit(None).cast("string").alias("target"))
    return first.unionByName(second).unionByName(bare).unionByName(nowhere)


def dependency_edges(resolved: DataFrame, paths: DataFrame) -> DataFrame:
    """(src, dst) file ids: the included file comes before the one that includes it; none to itself, none twice."""
    p = paths.select(F.col("path").alias("target"), F.col("file_id").alias("src"))
    return resolved.join(p, "target").select("src", F.col("file_id").alias("dst")).filter("src <> dst").distinct()


def unresolved_dependencies(resolved: DataFrame) -> DataFrame:
    return resolved.filter("target is null").groupBy("file_id").agg(F.count("*").alias("unresolved"))


def needs_rebuild(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reason) of every file known now or before (mtime, size, hash): new, gone, or the first of mtime, size and hash that differs; null if nothing does.  Unknown equals unknown."""
    n, o = now.withColumn("here", F.lit(True)).alias("n"), before.withColumn("here", F.lit(True)).alias("o")
    both = n.join(o, reduce(lambda x, y: x & y, [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]), "full")
    reason = F.when(F.col("o.here").isNull(), "new").when(F.col("n.here").isNull(), "gone")
    for c in ("mtime", "size", "hash"):
        reason = reason.when(~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")), c)
    return both.select(*[F.when(F.col("n.here").isNull(), F.col(f"o.{k}")).otherwise(F.col(f"n.{k}")).alias(k) for k in keys], reason.alias("reason"))


def header_to_source(headers: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources with the stem of a header."""
    stem = F.regexp_replace(basename("path"), r"\.\w+$", "")
    return headers.withColumn("stem", stem).join(sources.select(F.col("path").alias("source"), stem.alias("stem")), "stem").select("path", "source")


def project_dependencies(resolved: DataFrame, prefixes: list[str], root: str) -> DataFrame:
    """Dependencies below the root and below none of the system prefixes."""
    keep = F.col("target").startswith(root)
    for p in prefixes:
        keep &= ~F.col("target").startswith(p)
    return resolved.filter(keep)


def queue_waits(events: DataFrame, keys: list[str], order: list) -> DataFrame:
    """As-of: for each started event the last scheduled one of its group at or before it, and the seconds between."""
    placed = in_order(events, keys, order, lasts={"since": F.when(F.col("kind") == "scheduled", F.col("sec"))}).drop("__i", "__n")
    return placed.filter("kind = 'started' and since is not null and sec >= since").withColumn("wait", F.round(F.col("sec") - F.col("since"), 3))


def size_band_estimate(wanted: DataFrame, known: DataFrame, *, share: float = 0.3) -> DataFrame:
    """Each file's own mean time, else the mean of files within a share of its size, else a hundred-thousandth of its size.

    Sizes meet in bands of their logarithm, each with its neighbours, and are aggregated by size before that.
    """
    own = known.groupBy("path").agg(F.avg("seconds").alias("own"))
    by_size = known.groupBy("size").agg(F.sum("seconds").alias("s"), F.count("*").alias("c")).withColumn("band", F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)))))
    near = by_size.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).withColumnRenamed("size", "near_size")
    sizes = wanted.select("size").distinct().withColumn("band", F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)))))
    mean = sizes.join(near, "band").filter(F.abs(F.col("near_size") - F.col("size")) < share * F.col("size")).groupBy("size").agg((F.sum("s") / F.sum("c")).alias("band_mean"))
    return wanted.join(own, "path", "left").join(mean, "size", "left").withColumn("estimate", F.round(F.coalesce("own", "band_mean", F.col("size") * 1e-5), 6))


def concurrency_peak(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Most intervals at one instant, by a sweep; one that ends when another starts does not overlap it."""
    marks = intervals.select(*keys, F.col(start).alias("t"), F.lit(1).alias("d")).unionByName(intervals.select(*keys, F.col(end).alias("t"), F.lit(-1).alias("d")))
    net = marks.groupBy(*keys, "t").agg(F.sum("d").alias("d"))
    running = in_order(net, keys, ["t"], sums={"running": F.col("d")})
    return running.groupBy(*keys).agg(F.max("running").alias("peak"))


def concurrency_at(intervals: DataFrame, keys: list[str], start: Column, end: Column, step: int) -> DataFrame:
    """Intervals that hold each multiple of ``step``, start included, end excluded."""
    first, last = F.ceil(start / step), F.ceil(end / step) - 1
    return intervals.filter(last >= first).select(*keys, F.explode(F.sequence(first, last)).alias("k")).groupBy(*keys, (F.col("k") * step).alias("at")).agg(F.count("*").alias("running"))


def _with_nodes(tasks: DataFrame, nodes: DataFrame, same: list[str], name: str, cost: Column) -> DataFrame:
    """Every task with every node and their cost, which of a node needs the columns ``same`` only.

    Tasks are dealt out one by one over as many parts as a shuffle has, bundles of like nodes over a few; each part of the tasks meets
    each of the nodes, so that neither side is broadcast or passes through one task whole.  A cost is worked out once for a task and a
    bundle, and only then the bundle is taken apart: no more rows than it has nodes wait in memory for what follows.  Neighbouring
    rows repeat the task, its cost and, from task to task, the nodes: a file holds them in a small part of the bytes that rows in any
    order take.
    """
    parts = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.monotonically_increasing_id() / NODE_BUNDLE).alias("__place")
    found = nodes.orderBy(*same, "node_id").select(*same, F.struct("node_id").alias("__node"), place).groupBy(*same, "__place").agg(F.collect_list("__node").alias("__nodes"))
    bundles = found.select(*same, F.col("__nodes.node_id").alias("__nodes")).repartition(NODE_PARTS)
    pairs = bundles.hint("shuffle_replicate_nl").crossJoin(tasks.repartition(parts))
    return pairs.withColumn(name, cost).select("*", F.explode("__nodes").alias("node_id")).drop("__nodes")


def exec_cost_matrix(tasks: DataFrame, nodes: DataFrame, time: Column, cuda: Column) -> DataFrame:
    """Seconds of each task on each node: its time over the node's weight, a thousand times that for CUDA off the local node 0.

    The rows asked for are tasks times nodes; parts of both tables meet, whatever their sizes.
    """
    cost = F.col("__time") / F.col("weight") * F.when(F.col("__cuda") & F.col("__away"), 1000).otherwise(1)
    timed = tasks.select("*", time.alias("__time"), cuda.alias("__cuda"))
    found = _with_nodes(timed, nodes.select("node_id", "weight", (F.col("node_id") != 0).alias("__away")), ["weight", "__away"], "cost", F.round(cost, 6))
    return found.select(*[F.col(f"`{c}`") for c in tasks.columns], "node_id", "weight", "cost")


def cost_classes(nodes: DataFrame) -> DataFrame:
    """Of nodes on which every task costs the same (equal weight, local or not) the one with the least id: all that can be cheapest."""
    return nodes.groupBy("weight", (F.col("node_id") == 0).alias("local")).agg(F.min("node_id").alias("node_id")).select("node_id", "weight")


def cheapest_node(matrix: DataFrame, key: str) -> DataFrame:
    return matrix.groupBy(key).agg(F.min_by(F.struct("node_id", "cost"), F.struct("cost", "node_id")).alias("x")).select(key, "x.*")


def comm_cost_matrix(tasks: DataFrame, nodes: DataFrame, kilobytes: Column) -> DataFrame:
    """Seconds to send each task to each node: its latency and the source at 12.5 MB a second; nothing on the local node 0.

    The rows asked for are tasks times nodes; parts of both tables meet, whatever their sizes.
    """
    cost = F.when(F.col("__local"), 0.0).otherwise(F.col("latency_ms") / 1000 + F.col("__kilobytes") / 12_800)
    sized = tasks.select("*", kilobytes.alias("__kilobytes"))
    found = _with_nodes(sized, nodes.select("node_id", "latency_ms", (F.col("node_id") == 0).alias("__local")), ["latency_ms", "__local"], "comm", F.round(cost, 9))
    return found.select(*[F.col(f"`{c}`") for c in tasks.columns], "node_id", "comm")


def local_or_remote(tasks: DataFrame, nodes: DataFrame, *, threshold: float = 0.15) -> DataFrame:
    """local for CUDA tasks and where no remote node's time and transfer beat the local time by the threshold, else remote.

    ``tasks`` has est and cuda.  Of nodes of one weight only the nearest can be best, so a row with one entry for each weight is
    sent along, and each task takes its least sum over them.
    """
    classes = nodes.filter("node_id <> 0").groupBy("weight").agg(F.min("latency_ms").alias("latency_ms"))
    one = classes.agg(F.collect_list(F.struct("weight", "latency_ms")).alias("classes"))
    best = F.array_min(F.transform("classes", lambda c: F.col("est") / c["weight"] + c["latency_ms"] / 1000))
    local = F.col("cuda") | best.isNull() | (F.col("est") <= best + threshold)
    return tasks.crossJoin(F.broadcast(one)).withColumn("side", F.when(local, "local").otherwise("remote")).drop("classes")


def cross_machine_edges(edges: DataFrame, placement: DataFrame) -> DataFrame:
    """Edges whose ends are on different machines."""
    a, b = placement.select(F.col("task_id").alias("src"), F.col("machine").alias("src_machine")), placement.select(F.col("task_id").alias("dst"), F.col("machine").alias("dst_machine"))
    return edges.join(a, "src").join(b, "dst").filter("src_machine <> dst_machine")


def high_comm_edges(edges: DataFrame, placement: DataFrame, *, share: float = 0.3, top: int = 10) -> DataFrame:
    """The ten crossing edges whose transfer takes the most, of those above a share of the consumer's time."""
    took = placement.select(F.col("task_id").alias("dst"), (F.col("end") - F.col("start")).alias("exec"))
    comm = F.abs(F.col("src_machine") - F.col("dst_machine"))
    return cross_machine_edges(edges, placement).join(took, "dst").withColumn("comm", comm).filter(F.col("comm") > share * F.col("exec")).orderBy(F.col("comm").desc(), "src", "dst").limit(top)


def dependency_violations(edges: DataFrame, schedule: DataFrame) -> DataFrame:
    """Edges whose consumer started before its producer ended."""
    a, b = schedule.select(F.col("task_id").alias("src"), F.col("end").alias("src_end")), schedule.select(F.col("task_id").alias("dst"), F.col("start").alias("dst_start"))
    return edges.join(a, "src").join(b, "dst").filter("dst_start < src_end")


def mutual_dependencies(edges: DataFrame) -> DataFrame:
    """Pairs that depend on each other, each once."""
    return edges.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"]).filter("src < dst").select("src", "dst").distinct()


def missing_dependencies(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(dst, src) of dependencies on tasks that are neither known nor completed."""
    return edges.join(known.select(F.col("id").alias("src")).distinct(), "src", "left_anti").select("dst", "src").distinct()


def dependency_status(edges: DataFrame, done: DataFrame, known: DataFrame) -> DataFrame:
    """Per consumer: how many producers are missing, completed or pending, and whether it is ready."""
    e = edges.join(known.select(F.col("id").alias("src"), F.lit(1).alias("k")), "src", "left").join(done.select(F.col("id").alias("src"), F.lit(1).alias("d")), "src", "left")
    missing, completed = F.count_if(F.col("k").isNull()), F.count_if(F.col("d").isNotNull() & F.col("k").isNotNull())
    return e.groupBy("dst").agg(missing.alias("missing"), completed.alias("completed"), (F.count("*") - missing - completed).alias("pending")).withColumn("ready", (F.col("missing") == 0) & (F.col("pending") == 0))


def hosts_in_backoff(tasks: DataFrame, now: Column, *, seconds: int = 60) -> DataFrame:
    """Nodes whose latest outcome is a failure less than that long ago."""
    last = tasks.groupBy("node_id").agg(F.max_by("status", F.struct("completed_at", "task_id")).alias("last"), F.max("completed_at").alias("at"))
    return last.filter((F.col("last") == "failed") & (F.unix_micros(now) - F.unix_micros("at") < seconds * 1_000_000))


def label_containers(tasks: DataFrame, containers: DataFrame) -> DataFrame:
    """Each task with its node's container, or unknown-<node>."""
    named = F.coalesce("container", F.concat(F.lit("unknown-"), F.col("node_id").cast("string")))
    return tasks.join(containers.select("node_id", "container"), "node_id", "left").withColumn("container", named)
