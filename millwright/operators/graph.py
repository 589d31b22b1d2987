"""Dependency graphs, many at once: vertices (graph_id, id, node_type, weight), edges (graph_id, src, dst) from producer to consumer.

Loops advance all graphs together, a level or a hop a round; each round's state is a table in the folder that all executors share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from millwright.sources import shared
from millwright.sources.shared import new_folder


def cut_lineage(df: DataFrame, *, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` as a table, to be joined by shuffles: loops have hundreds of joins, and each table broadcast goes through the driver."""
    found = shared.cut_lineage(df, instead_of=instead_of)
    hinted = found.hint("merge")
    hinted.table_path = found.table_path
    return hinted


def _anchored(single: DataFrame) -> DataFrame:
    """(graph_id, id, up, add, open) of vertices with one producer each: the nearest vertex above that is none of them, and what is added on the way.

    ``single``: graph_id, id, up (the producer), add.  Pointers are doubled, so rounds are the logarithm of the longest chain.  What
    stays open is on a cycle of such vertices, or below one.
    """
    before = None
    p = cut_lineage(single.select("graph_id", "id", "up", "add", F.lit(True).alias("open")))
    while True:
        seen = Observation()
        q = p.select("graph_id", F.col("id").alias("up"), F.col("up").alias("far"), F.col("add").alias("more"))
        new = p.join(q, ["graph_id", "up"], "left").select("graph_id", "id", F.coalesce("far", "up").alias("up"), (F.col("add") + F.coalesce("more", F.lit(0))).alias("add"), F.col("far").isNotNull().alias("open"))
        p = cut_lineage(new.observe(seen, F.count_if(F.col("open")).alias("n")), instead_of=p)
        if seen.get["n"] in (0, before):
            return p
        before = seen.get["n"]


def _contracted(v: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Vertices and edges without those that have one producer only, and where these hang.

    Edges to one vertex whose producers hang on the same one become one, the longest; so more vertices have one producer, and the
    step is done again while it takes an eighth of the edges or more.
    """
    hung: list[DataFrame] = []
    while True:
        single = e.groupBy("graph_id", F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("src").alias("up"), F.max("len").alias("len")).filter("n = 1")
        single = cut_lineage(single.join(v, ["graph_id", "id"]).select("graph_id", "id", "up", (F.col("len") + F.col("cost")).alias("add")))
        if 8 * single.count() < max(1, e.count()):
            return v, e, hung
        p = _anchored(single)
        hung.append(p.filter("not open").select("graph_id", "id", "up", "add"))
        above = hung[-1].withColumnsRenamed({"id": "src", "add": "more"})
        rest = e.join(p.select("graph_id", F.col("id").alias("dst")), ["graph_id", "dst"], "left_anti").join(above, ["graph_id", "src"], "left")
        e = cut_lineage(rest.groupBy("graph_id", F.coalesce("up", "src").alias("src"), "dst").agg(F.max(F.col("len") + F.coalesce("more", F.lit(0))).alias("len")), instead_of=e)
        v = cut_lineage(v.join(p.select("graph_id", "id"), ["graph_id", "id"], "left_anti"), instead_of=v)


def _longest(vertices: DataFrame, edges: DataFrame, start: Column, cost: Column, max_rounds: int) -> DataFrame:
    """(graph_id, id, value): ``start`` of vertices without producers, else the greatest value of the producers and the vertex's ``cost``.

    Vertices with one producer hang on others at known distances and are set aside.  The rest is peeled level by level; each
    level's values are added to one table.  Then values go down to what was set aside.  Vertices on cycles or behind them get no row.
    """
    keys, spark = ["graph_id", "id"], vertices.sparkSession
    e = cut_lineage(edges.select("graph_id", "src", "dst").distinct().withColumn("len", F.lit(0).cast("long")))
    v, e, hung = _contracted(cut_lineage(vertices.select(*keys, start.cast("long").alias("start"), cost.cast("long").alias("cost"))), e)
    need = e.groupBy("graph_id", F.col("dst").alias("id")).agg(F.count("*").alias("need"))
    waiting = cut_lineage(v.join(need, keys, "left").select(*keys, "start", "cost", F.coalesce("need", F.lit(0)).alias("need"), F.lit(None).cast("long").alias("best")))
    folder, kind = new_folder(spark), waiting.select(*keys, F.col("start").alias("value")).schema
    for level in range(max_rounds):
        ready = waiting.filter("need = 0").select(*keys, F.coalesce(F.col("best") + F.col("cost"), "start").alias("value"))
        seen = Observation()
        ready.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/level={level}")
        if not seen.get["n"]:
            break
        now = spark.read.schema(kind).parquet(f"{folder}/level={level}")
        sent = now.withColumnRenamed("id", "src").join(e, ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("id")).agg(F.count("*").alias("came"), F.max(F.col("value") + F.col("len")).alias("value"))
        rest = waiting.filter("need > 0").join(sent, keys, "left")
        waiting = cut_lineage(rest.select(*keys, "start", "cost", (F.col("need") - F.coalesce("came", F.lit(0))).alias("need"), F.greatest("best", "value").alias("best")), instead_of=waiting)
    else:
        raise RuntimeError(f"vertices are left after {max_rounds} levels")
    values = spark.read.schema(kind).parquet(*[f"{folder}/level={k}" for k in range(level + 1)])
    for p in reversed(hung):
        above = values.select("graph_id", F.col("id").alias("up"), "value")
        values = cut_lineage(values.unionByName(p.join(above, ["graph_id", "up"]).select(*keys, (F.col("value") + F.col("add")).alias("value"))))
    return values


def topological_levels(vertices: DataFrame, edges: DataFrame, *, max_rounds: int = 10_000) -> DataFrame:
    """Level of each vertex: 0 without producers, else one more than its highest producer's."""
    return _longest(vertices, edges, F.lit(0), F.lit(1), max_rounds).select("graph_id", "id", F.col("value").cast("int").alias("level"))


def upward_rank(vertices: DataFrame, edges: DataFrame, *, comm: int = 0, max_rounds: int = 10_000) -> DataFrame:
    """rank = weight, plus the greatest of the consumers' ranks and the cost of an edge."""
    back = edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return _longest(vertices, back, F.col("weight"), F.col("weight") + comm, max_rounds).select("graph_id", "id", F.col("value").alias("rank"))


def level_histogram(levels: DataFrame) -> DataFrame:
    return levels.groupBy("graph_id", "level").agg(F.count("*").alias("vertices"))


def max_parallelism(levels: DataFrame) -> DataFrame:
    return level_histogram(levels).groupBy("graph_id").agg(F.max("vertices").alias("widest"), F.max("level").alias("depth"))


def critical_path_length(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("graph_id").agg(F.max("rank").alias("length"))


def critical_path(ranks: DataFrame, edges: DataFrame, *, max_rounds: int = 10_000) -> DataFrame:
    """(graph_id, step, id) along the best consumers from the best vertex; of equals the least id."""
    best = lambda: F.max_by("id", F.struct("rank", -F.col("id")))
    after = edges.join(ranks.select("graph_id", F.col("id").alias("dst"), "rank"), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("id")).agg(F.max_by("dst", F.struct("rank", -F.col("dst"))).alias("next"))
    after = cut_lineage(after)
    at = cut_lineage(ranks.groupBy("graph_id").agg(best().alias("id")))
    steps = []
    for step in range(max_rounds):
        if at.isEmpty():
            break
        steps.append(at.withColumn("step", F.lit(step)))
        at = cut_lineage(at.join(after, ["graph_id", "id"]).select("graph_id", F.col("next").alias("id")))
    else:
        raise RuntimeError(f"paths go on after {max_rounds} steps")
    return reduce(DataFrame.unionByName, steps).select("graph_id", "step", "id") if steps else at.select("graph_id", F.lit(0).alias("step"), "id")


def reachable(seeds: DataFrame, edges: DataFrame, *, hops: int | None = None, may_pass: DataFrame | None = None) -> DataFrame:
    """(graph_id, id, hop) of what the seeds reach, themselves at hop 0; only through vertices of ``may_pass``, if given."""
    keys = ["graph_id", "id"]
    e = edges.select("graph_id", "src", F.col("dst").alias("id"))
    if may_pass is not None:
        e = e.join(may_pass.select(*keys), keys, "left_semi")
    e = cut_lineage(e.distinct())
    seen = cut_lineage(seeds.select(*keys).distinct().withColumn("hop", F.lit(0)))
    front, hop = seen, 0
    while hops is None or hop < hops:
        hop += 1
        reached = front.select("graph_id", F.col("id").alias("src")).join(e, ["graph_id", "src"]).select(*keys).distinct()
        front = cut_lineage(reached.join(seen, keys, "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(front))
    return seen


def backward(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))


def impacted_tasks(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """Changed vertices and all that depend on them."""
    return reachable(changed, edges).select("graph_id", "id")


def dependency_chain(seeds: DataFrame, edges: DataFrame, *, hops: int = 10) -> DataFrame:
    return reachable(seeds, backward(edges), hops=hops)


def dependent_chain(seeds: DataFrame, edges: DataFrame, *, hops: int = 10) -> DataFrame:
    return reachable(seeds, edges, hops=hops)


def propagate_failures(failed: DataFrame, edges: DataFrame, open_tasks: DataFrame) -> DataFrame:
    """Failed vertices and the open ones that depend on them through open ones."""
    return reachable(failed, edges, may_pass=open_tasks).select("graph_id", "id")


def include_closure(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """(unit, id) of all that each unit reaches; pairs advance hop by hop.

    A hop's pairs are written once and not compared with all that were seen, except in hops 1, 2, 4, 8 and so on, where those go that
    are known: on cycles, too, a hop is empty before it is twice as long as the longest way.  Pairs with ways of several lengths meet
    at the end.
    """
    spark, folder = edges.sparkSession, new_folder(edges.sparkSession)
    e = cut_lineage(edges.select(F.col("src").alias("at"), F.col("dst").alias("id")).distinct())
    more = sources.select("unit").distinct().join(e, F.col("unit") == F.col("at")).select("unit", "id")
    kind, hop, paths = more.schema, 0, []
    known = lambda: spark.read.schema(kind).parquet(*paths)
    while True:
        if hop and hop & (hop - 1) == 0:
            more = more.join(known().hint("merge"), ["unit", "id"], "left_anti")
        paths.append(f"{folder}/hop={hop}")
        seen = Observation()
        more.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(paths[-1])
        if not seen.get["n"]:
            return known().distinct()
        more = spark.read.schema(kind).parquet(paths[-1]).select("unit", F.col("id").alias("at")).join(e, "at").select("unit", "id").distinct()
        hop += 1


def ready_tasks(vertices: DataFrame, edges: DataFrame, done: DataFrame) -> DataFrame:
    """Vertices not done whose producers all are."""
    keys = ["graph_id", "id"]
    blocked = edges.join(done.select("graph_id", F.col("id").alias("src")), ["graph_id", "src"], "left_anti").select("graph_id", F.col("dst").alias("id")).distinct()
    return vertices.select(*keys).join(done.select(*keys), keys, "left_anti").join(blocked, keys, "left_anti")


def roots_leaves(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees of every vertex and what they make it: root, leaf or orphan."""
    keys = ["graph_id", "id"]
    ins = edges.groupBy("graph_id", F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    outs = edges.groupBy("graph_id", F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    d = vertices.select(*keys).join(ins, keys, "left").join(outs, keys, "left").na.fill(0, ["in_degree", "out_degree"])
    return d.select("*", (F.col("in_degree") == 0).alias("root"), (F.col("out_degree") == 0).alias("leaf"), ((F.col("in_degree") == 0) & (F.col("out_degree") == 0)).alias("orphan"))


def graph_stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    d = roots_leaves(vertices, edges)
    s = d.groupBy("graph_id").agg(F.count("*").alias("vertices"), F.sum("in_degree").alias("edges"), F.max("in_degree").alias("max_in"), F.max("out_degree").alias("max_out"), F.count_if("root").alias("roots"), F.count_if("leaf").alias("leaves"))
    n = F.col("vertices")
    return s.select("*", F.round(F.when(n > 1, F.col("edges") / (n * (n - 1))).otherwise(0.0), 8).alias("density"))


def degree_stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Means and greatest of the vertices' in- and out-degrees, by graph."""
    d = roots_leaves(vertices, edges)
    return d.groupBy("graph_id").agg(*[f(f"{c}_degree").alias(f"{n}_{c}") for c in ("in", "out") for n, f in (("mean", lambda x: F.round(F.avg(x), 6)), ("max", F.max))])


def type_counts(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("graph_id", "node_type").agg(F.count("*").alias("vertices"))


def cyclic_nodes(vertices: DataFrame, edges: DataFrame, *, max_rounds: int = 10_000) -> DataFrame:
    """Vertices on cycles, or between two, which peeling from both sides leaves over."""
    keys = ["graph_id", "id"]
    ahead = vertices.select(*keys, "weight").join(topological_levels(vertices, edges, max_rounds=max_rounds), keys, "left_anti")
    rest = cut_lineage(ahead)
    inner = edges.join(rest.select("graph_id", F.col("id").alias("src")), ["graph_id", "src"], "left_semi").join(rest.select("graph_id", F.col("id").alias("dst")), ["graph_id", "dst"], "left_semi")
    return rest.select(*keys).join(topological_levels(rest, backward(inner), max_rounds=max_rounds), keys, "left_anti")


def dependency_clusters(vertices: DataFrame, edges: DataFrame, *, max_rounds: int = 10_000) -> DataFrame:
    """Weakly connected components: the least id of each vertex's component, by spreading labels and jumping along them."""
    keys = ["graph_id", "id"]
    both = cut_lineage(edges.select("graph_id", "src", "dst").unionByName(backward(edges)).distinct())
    label = cut_lineage(vertices.select(*keys, F.col("id").alias("label")))
    for _ in range(max_rounds):
        near = both.join(label.select("graph_id", F.col("id").alias("src"), "label"), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("id")).agg(F.min("label").alias("near"))
        spread = label.join(near, keys, "left").select(*keys, F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = spread.select("graph_id", F.col("id").alias("label"), F.col("label").alias("far"))
        new = cut_lineage(spread.join(jump, ["graph_id", "label"], "left").select(*keys, "old", F.least("label", "far").alias("label")))
        label = new.select(*keys, "label")
        if new.filter("old <> label").isEmpty():
            break
    else:
        raise RuntimeError(f"labels have not settled after {max_rounds} rounds")
    return label.withColumnRenamed("label", "cluster")


def largest_clusters(clusters: DataFrame, k: int = 10) -> DataFrame:
    return clusters.groupBy("graph_id", "cluster").agg(F.count("*").alias("size")).orderBy(F.col("size").desc(), "graph_id", "cluster").limit(k)


def task_priority(ranks: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """rank + 0.1 weight + 0.05 out-degree, a fifth more for vertices of the graph's greatest rank; 1.15 times with over five producers."""
    keys = ["graph_id", "id"]
    d = roots_leaves(vertices, edges).select(*keys, "in_degree", "out_degree")
    top = F.max("rank").over(Window.partitionBy("graph_id"))
    r = ranks.withColumn("top", F.col("rank") == top).join(vertices.select(*keys, "weight"), keys).join(d, keys)
    base = F.col("rank") + 0.1 * F.col("weight") + 0.05 * F.col("out_degree")
    return r.select(*keys, F.round(base * F.when(F.col("top"), 1.2).otherwise(1.0) * F.when(F.col("in_degree") > 5, 1.15).otherwise(1.0), 6).alias("priority"))


def movable_tasks(ranks: DataFrame, share: float = 0.8) -> DataFrame:
    """Vertices whose rank is below that percentile of their graph."""
    cut = ranks.groupBy("graph_id").agg(F.percentile("rank", F.lit(share)).alias("cut"))
    return ranks.join(cut, "graph_id").filter("rank < cut").select("graph_id", "id", "rank")


def transitive_reduction(edges: DataFrame, *, within: DataFrame | None = None, critical: DataFrame | None = None, share: float | None = None, max_rounds: int = 10_000) -> DataFrame:
    """Edges that no other path, however long, makes superfluous; edges on cycles or behind them are kept.

    Guards, where given: only edges and paths between vertices of ``within`` count, edges with both ends in ``critical`` are kept,
    and at most ``share`` of each graph's edges go, the first by their ends.
    """
    ends = ["graph_id", "src", "dst"]
    e = edges.select(*ends).distinct()
    e = cut_lineage(e if within is None else prune_graph(e, within))
    vertices = e.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("weight", F.lit(0).cast("long"))
    levels = cut_lineage(topological_levels(vertices, e, max_rounds=max_rounds))
    e = cut_lineage(e.join(levels.select("graph_id", F.col("id").alias("src"), F.col("level").alias("from")), ["graph_id", "src"]).join(levels.select("graph_id", F.col("id").alias("dst"), F.col("level").alias("to")), ["graph_id", "dst"]))
    long = cut_lineage(e.filter(F.col("to") - F.col("from") > 1).select(*ends, "to"))  # no other edge can have a detour
    pairs = ["graph_id", "src", "at"]
    steps = e.select("graph_id", F.col("src").alias("at"), F.col("dst").alias("next"), F.col("to").alias("level"))
    tops = cut_lineage(long.groupBy("graph_id", "src").agg(F.max("to").alias("top")))
    front = cut_lineage(tops.join(e.withColumnRenamed("dst", "at"), ["graph_id", "src"]).filter("to < top").select(*pairs, "top"))
    seen = front.select(*pairs).limit(0)  # what paths of two edges or more reach
    for _ in range(max_rounds):
        if front.isEmpty():
            break
        more = front.join(steps, ["graph_id", "at"]).filter("level <= top").select("graph_id", "src", F.col("next").alias("at"), "top").distinct()
        front = cut_lineage(more.join(seen, pairs, "left_anti"))
        seen = cut_lineage(seen.unionByName(front.select(*pairs)))
    else:
        raise RuntimeError(f"paths go on after {max_rounds} rounds")
    gone = long.join(seen.withColumnRenamed("at", "dst"), ends, "left_semi").select(*ends)
    if critical is not None:
        gone = gone.join(prune_graph(gone, critical), ends, "left_anti")
    if share is not None:
        most = edges.groupBy("graph_id").agg(F.floor(F.count("*") * share).alias("most"))
        place = F.row_number().over(Window.partitionBy("graph_id").orderBy("src", "dst"))
        gone = gone.withColumn("place", place).join(most, "graph_id").filter("place <= most").select(*ends)
    return edges.join(gone, ends, "left_anti")


def link_barriers(vertices: DataFrame, edges: DataFrame, *, least: int = 11) -> DataFrame:
    """Link vertices with that many compile producers or more: all those must be done first, as a set, sorted."""
    kind = vertices.select("graph_id", "id", "node_type")
    e = edges.join(kind.toDF("graph_id", "dst", "dst_type"), ["graph_id", "dst"]).join(kind.toDF("graph_id", "src", "src_type"), ["graph_id", "src"])
    return e.filter("dst_type = 'link' and src_type = 'compile'").groupBy("graph_id", F.col("dst").alias("id")).agg(F.count("*").alias("producers"), F.array_sort(F.collect_set("src")).alias("dependencies")).filter(F.col("producers") >= least)


def phase_barriers(phases: DataFrame) -> DataFrame:
    """Edges that order phases: each vertex of a phase to a barrier, the barrier to each of the next; n + m edges, not n * m."""
    barrier = F.concat(F.lit("barrier:"), F.col("phase").cast("string"))
    into = phases.select("graph_id", F.col("id").cast("string").alias("src"), barrier.alias("dst"))
    out = phases.select("graph_id", F.concat(F.lit("barrier:"), (F.col("phase") - 1).cast("string")).alias("src"), F.col("id").cast("string").alias("dst"))
    known = phases.select("graph_id", barrier.alias("src")).distinct()
    return into.unionByName(out.join(known, ["graph_id", "src"], "left_semi").select("graph_id", "src", "dst"))


def prune_graph(edges: DataFrame, keep: DataFrame, *, links: DataFrame | None = None) -> DataFrame:
    """Edges with both ends kept; of ``links``, those that a kept vertex leads to are kept as well."""
    if links is not None:
        led = edges.join(keep.select("graph_id", F.col("id").alias("src")), ["graph_id", "src"], "left_semi").select("graph_id", F.col("dst").alias("id")).distinct()
        keep = keep.select("graph_id", "id").unionByName(links.select("graph_id", "id").join(led, ["graph_id", "id"], "left_semi")).distinct()
    return edges.join(keep.select("graph_id", F.col("id").alias("src")), ["graph_id", "src"], "left_semi").join(keep.select("graph_id", F.col("id").alias("dst")), ["graph_id", "dst"], "left_semi")


def validate_graph(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Issues: edges to unknown vertices, edges to themselves, orphans, and vertices on cycles (or between two)."""
    keys = ["graph_id", "id"]
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
    unknown = ends.join(vertices.select(*keys), keys, "left_anti").withColumn("issue", F.lit("unknown"))
    loops = edges.filter("src = dst").select("graph_id", F.col("src").alias("id")).withColumn("issue", F.lit("self"))
    orphans = roots_leaves(vertices, edges).filter("orphan").select(*keys).withColumn("issue", F.lit("orphan"))
    known = vertices.select(*keys)
    inner = edges.filter("src <> dst").join(known.withColumnRenamed("id", "src"), ["graph_id", "src"], "left_semi").join(known.withColumnRenamed("id", "dst"), ["graph_id", "dst"], "left_semi")
    cycles = cyclic_nodes(vertices, inner).select(*keys).withColumn("issue", F.lit("cycle"))
    return unknown.unionByName(loops).unionByName(orphans).unionByName(cycles)


def incremental_plan(old: DataFrame, new: DataFrame, edges: DataFrame) -> DataFrame:
    """What to build again: files that are new or changed, and all that depend on them.  (graph_id, id, stamp) before and now."""
    keys = ["graph_id", "id"]
    changed = new.join(old.withColumnRenamed("stamp", "before").hint("merge"), keys, "left").filter(~F.col("stamp").eqNullSafe(F.col("before")))
    return impacted_tasks(changed, edges).join(new.select(*keys).hint("merge"), keys, "left_semi")




def direct_dependencies(edges: DataFrame, of: DataFrame) -> DataFrame:
    return edges.join(of.select("graph_id", F.col("id").alias("dst")), ["graph_id", "dst"], "left_semi").select("graph_id", F.col("src").alias("id")).distinct()


def direct_dependents(edges: DataFrame, of: DataFrame) -> DataFrame:
    return direct_dependencies(backward(edges), of)


def task_chain(vertices: DataFrame, edges: DataFrame, of: DataFrame) -> DataFrame:
    """All that a vertex needs, and itself, with levels: building by level builds dependencies first."""
    keys = ["graph_id", "id"]
    return topological_levels(vertices, edges).join(reachable(of, backward(edges)).select(*keys), keys, "left_semi")


def priority_adjust(priorities: DataFrame, times: DataFrame, edges: DataFrame) -> DataFrame:
    """A tenth less where a task's times vary much, 1.15 times with over five producers."""
    ins = edges.groupBy("graph_id", F.col("dst").alias("id")).agg(F.count("*").alias("producers"))
    p = priorities.join(times.select("id", "cv"), "id", "left").join(ins, ["graph_id", "id"], "left")
    factor = F.when(F.col("cv") > 0.3, 0.9).otherwise(1.0) * F.when(F.col("producers") > 5, 1.15).otherwise(1.0)
    return p.select("graph_id", "id", F.round(F.col("priority") * factor, 6).alias("priority"))


def _trimmed(edges: DataFrame, rounds: int) -> DataFrame:
    """``edges`` (graph_id, s, t) without those at vertices that lack producers or consumers, looked for so many times."""
    for _ in range(rounds):
        fed, used = edges.select("graph_id", F.col("t").alias("s")).distinct(), edges.select("graph_id", F.col("s").alias("t")).distinct()
        edges = edges.join(fed, ["graph_id", "s"], "left_semi").join(used, ["graph_id", "t"], "left_semi").select("graph_id", "s", "t")
    return edges


def _greatest_before(edges: DataFrame, max_rounds: int) -> DataFrame:
    """(graph_id, v, c): the greatest number among each vertex and all that lead to it.

    Numbers spread over edges, and then each vertex takes what the vertex of its number has: what leads there leads here as well.
    """
    state = cut_lineage(edges.select("graph_id", F.explode(F.array("s", "t")).alias("v")).distinct().withColumn("c", F.col("v")))
    for _ in range(max_rounds):
        came = edges.join(state.select("graph_id", F.col("v").alias("s"), "c"), ["graph_id", "s"]).groupBy("graph_id", F.col("t").alias("v")).agg(F.max("c").alias("came"))
        spread = state.join(came, ["graph_id", "v"], "left").select("graph_id", "v", F.col("c").alias("old"), F.greatest("c", "came").alias("c"))
        jump = spread.select("graph_id", F.col("v").alias("c"), F.col("c").alias("far"))
        changed = Observation()
        new = spread.join(jump, ["graph_id", "c"], "left").select("graph_id", "v", F.greatest("c", "far").alias("c"), "old")
        state = cut_lineage(new.observe(changed, F.count_if(F.col("old") != F.col("c")).alias("n")).drop("old"), instead_of=state)
        if not changed.get["n"]:
            return state
    raise RuntimeError(f"numbers have not settled after {max_rounds} rounds")


def strong_components(edges: DataFrame, *, max_rounds: int = 1000) -> DataFrame:
    """(graph_id, id, component) of the vertices in strongly connected components of two or more; component is the least id.

    All components are looked for at once.  Vertices get numbers in no order (a hash that no two ids share).  The greatest number
    that leads to a vertex is its colour; a component has one colour, so edges between colours go.  Within a colour, the vertices
    that its greatest number is reached from, backward as well, are one component.  They go, and the rest is coloured anew.
    """
    number = lambda c: F.xxhash64(F.col(c).cast("long"))
    ids = cut_lineage(edges.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("v", number("id")))
    e = edges.filter("src <> dst").select("graph_id", number("src").alias("s"), number("dst").alias("t")).distinct()
    found: list[DataFrame] = []
    for _ in range(max_rounds):
        e = cut_lineage(_trimmed(e, 2))
        if e.isEmpty():
            break
        colour = _greatest_before(e, max_rounds)
        ends = lambda name, end: colour.select("graph_id", F.col("v").alias(end), F.col("c").alias(name))
        inner = cut_lineage(e.join(ends("cs", "s"), ["graph_id", "s"]).join(ends("ct", "t"), ["graph_id", "t"]).filter("cs = ct").select("graph_id", "s", "t", F.col("cs").alias("c")))
        back = _greatest_before(inner.select("graph_id", F.col("t").alias("s"), F.col("s").alias("t")), max_rounds).withColumnRenamed("c", "d")
        members = cut_lineage(colour.join(back, ["graph_id", "v"]).filter("c = d").select("graph_id", "v", "c"))
        found.append(members)
        gone = members.select("graph_id", F.col("v").alias("s"))
        e = inner.select("graph_id", "s", "t").join(gone, ["graph_id", "s"], "left_anti").join(gone.withColumnRenamed("s", "t"), ["graph_id", "t"], "left_anti")
    else:
        raise RuntimeError(f"components are left after {max_rounds} rounds")
    none = ids.select("graph_id", "v", F.col("v").alias("c")).limit(0)
    named = reduce(DataFrame.unionByName, found, none).join(ids, ["graph_id", "v"])
    least = named.groupBy("graph_id", "c").agg(F.min("id").alias("component"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return named.join(least, ["graph_id", "c"]).select("graph_id", "id", "component")


#: Least score of an edge that is not dropped.
REFUSED = 1000


def repair_cycles(vertices: DataFrame, edges: DataFrame, *, max_rounds: int = 1000) -> DataFrame:
    """``edges`` (graph_id, src, dst, and relation where there is one) without cycles, as far as they may be broken, and refused.

    Each round drops the weakest edge of every strongly connected component, of all graphs at once; what is left of a component is
    searched again.  Score: a hundred times the edge's kind (1 inferred, 2 with an end that is generated, 3 with a link vertex, 10 a
    source dependency, else 5) and the degrees of both ends among all edges left; of equals the least ends.  A component whose
    weakest edge scores ``REFUSED`` or more stays, its edges marked.  Edges from a vertex to itself are dropped.
    """
    ends = ["graph_id", "src", "dst"]
    relation = F.col("relation") if "relation" in edges.columns else F.lit(None).cast("string")
    now = cut_lineage(edges.filter("src <> dst").select(*ends, relation.alias("relation")).dropDuplicates(ends))
    kind = cut_lineage(vertices.select("graph_id", "id", "node_type"))
    refused: list[DataFrame] = []
    search = now
    for _ in range(max_rounds):
        parts = cut_lineage(strong_components(search, max_rounds=max_rounds))
        if parts.isEmpty():
            break
        of = lambda end, name: parts.select("graph_id", F.col("id").alias(end), F.col("component").alias(name))
        inner = cut_lineage(search.join(of("src", "part"), ["graph_id", "src"]).join(of("dst", "other"), ["graph_id", "dst"]).filter("part = other").drop("other"))
        degree = now.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).join(parts.select("graph_id", "id"), ["graph_id", "id"], "left_semi").groupBy("graph_id", "id").agg(F.count("*").alias("degree"))
        known = cut_lineage(degree.join(kind, ["graph_id", "id"], "left"))
        at = lambda end: known.select("graph_id", F.col("id").alias(end), F.col("degree").alias(f"{end}_degree"), F.col("node_type").alias(f"{end}_type"))
        either = lambda t: F.coalesce(F.col("src_type") == t, F.lit(False)) | F.coalesce(F.col("dst_type") == t, F.lit(False))
        strength = F.when(F.col("relation") == "inferred", 1).when(either("gen"), 2).when(either("link"), 3).when(F.col("relation") == "source", 10).otherwise(5)
        scored = inner.join(at("src"), ["graph_id", "src"]).join(at("dst"), ["graph_id", "dst"]).withColumn("score", strength * 100 + F.col("src_degree") + F.col("dst_degree"))
        weakest = cut_lineage(scored.groupBy("graph_id", "part").agg(F.min(F.struct("score", "src", "dst")).alias("x")).select("graph_id", "part", "x.*"))
        firm = weakest.filter(F.col("score") >= REFUSED).select("graph_id", "part")
        refused.append(inner.join(firm, ["graph_id", "part"], "left_semi").select(*ends))
        drop = weakest.filter(F.col("score") < REFUSED).select(*ends)
        search = cut_lineage(inner.join(firm, ["graph_id", "part"], "left_anti").drop("part").join(drop, ends, "left_anti"))
        now = cut_lineage(now.join(drop, ends, "left_anti"))
    else:
        raise RuntimeError("cycles remain")
    kept = reduce(DataFrame.unionByName, refused, now.select(*ends).limit(0)).withColumn("refused", F.lit(True))
    return now.select(*ends).join(kept, ends, "left").withColumn("refused", F.coalesce("refused", F.lit(False)))


def add_link_node(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges, and for a graph without a link vertex but two compile vertices or more, edges from those to vertex -1, its link."""
    kinds = vertices.groupBy("graph_id").agg(F.count_if(F.col("node_type") == "link").alias("links"), F.count_if(F.col("node_type") == "compile").alias("units"))
    lacking = kinds.filter("links = 0 and units >= 2").select("graph_id")
    more = vertices.filter("node_type = 'compile'").join(lacking, "graph_id", "left_semi").select("graph_id", F.col("id").alias("src"), F.lit(-1).cast("long").alias("dst"))
    return edges.select("graph_id", "src", "dst").unionByName(more)


def path_depth_phases(files: DataFrame) -> DataFrame:
    """Layers by the depth of the path: what ``phase_barriers`` orders where dependencies are not known."""
    depth = F.size(F.split("path", "/"))
    return files.select("graph_id", "id", (F.dense_rank().over(Window.partitionBy("graph_id").orderBy(depth)) - 1).alias("phase"))


def generated_edges(unresolved: DataFrame, generator: Column) -> DataFrame:
    """(src, dst) from the step that makes an unresolved generated file to the unit that needs it."""
    return unresolved.select(generator.alias("src"), F.col("file_id").alias("dst")).filter("src is not null").distinct()
