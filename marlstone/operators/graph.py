"""Paths, neighbours, hierarchies and statistics over edge tables (src, dst, kind, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.components import connected_components
from marlstone.plans.stash import Stash


def _distances(edges: DataFrame, starts: DataFrame, hops: int, stash: Stash, barred: DataFrame | None = None) -> DataFrame:
    """(at, far): how many edges (_s, _d) a node is from the starts (at), one row a node; barred nodes lead on only as starts.

    Levels that others are made from are written.
    """
    seen = front = starts.select("at", F.lit(0).alias("far"))
    for far in range(1, hops + 1):
        on = front if barred is None or far == 1 else front.join(barred, "at", "left_anti")
        found = edges.join(on.select(F.col("at").alias("_s")), "_s", "left_semi").select(F.col("_d").alias("at")).distinct()
        front = found.join(seen, "at", "left_anti").withColumn("far", F.lit(far))
        front = stash.put(front) if far < hops else front
        seen = seen.unionByName(front)
    return seen


def paths_between(edges: DataFrame, sources: DataFrame, targets: DataFrame, hops: int, kinds: list[str] | None = None, only_shortest: bool = False) -> DataFrame:
    """(path, hops, weight) of all simple directed paths from a source to a target (id), or of the shortest of all.

    A path ends at the first target; sources that are targets have no path to themselves. Distances from
    the sources and to the targets come first, a row for each node; paths are then listed over the edges
    that lie on a walk of the length that is allowed, so a partial path is one that can end in time.
    """
    stash = Stash(edges.sparkSession)
    e = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    e = stash.put(e.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("weight").alias("_w")).where("_s != _d"))
    begin = sources.select(F.col("id").alias("at")).distinct()
    ends = targets.select(F.col("id").alias("at")).distinct()
    before = _distances(e, begin, hops - 1, stash, ends)
    after = _distances(e.select(F.col("_d").alias("_s"), F.col("_s").alias("_d")), ends, hops - 1, stash)
    near = e.join(before.withColumnRenamed("at", "_s"), "_s").withColumnRenamed("far", "_f").join(after.withColumnRenamed("at", "_d"), "_d")
    near = stash.put(near.withColumn("_l", F.col("_f") + 1 + F.col("far")).where(F.col("_l") <= hops).select("_s", "_d", "_w", "_l"))
    if only_shortest:  # where sources are targets, the shortest walk may come back to its source and be no path
        both = begin.join(ends, "at", "left_semi").agg(F.count("*").alias("_both"))
        most = near.agg(F.min("_l").alias("_m")).join(F.broadcast(both)).select(F.when(F.col("_both") > 0, hops).otherwise(F.col("_m")).alias("_most"))
        near = near.join(F.broadcast(most), F.col("_l") <= F.col("_most")).drop("_most")  # one row
    front = near.join(begin.select(F.col("at").alias("_s")), "_s", "left_semi")
    front = front.select(F.array("_s", "_d").alias("path"), F.col("_w").alias("weight"), F.col("_d").alias("at"))
    found = front.join(ends, "at", "left_semi").select("path", "weight")
    for n in range(2, hops + 1):
        front = front.join(ends, "at", "left_anti").join(near, F.col("at") == F.col("_s")).where(~F.array_contains("path", F.col("_d")))
        front = front.select(F.concat("path", F.array("_d")).alias("path"), (F.col("weight") + F.col("_w")).alias("weight"), F.col("_d").alias("at"))
        front = stash.put(front) if n < hops else front
        found = found.unionByName(front.join(ends, "at", "left_semi").select("path", "weight"))
    found = found.select("path", (F.size("path") - 1).alias("hops"), "weight")
    if not only_shortest:
        return found
    found = stash.put(found)
    return found.join(F.broadcast(found.agg(F.min("hops").alias("_m"))), F.col("hops") == F.col("_m")).drop("_m")  # one row


def simple_paths(edges: DataFrame, source, target, hops: int, kinds: list[str] | None = None, only_shortest: bool = False) -> DataFrame:
    """(path, hops, weight) of all simple directed paths between two nodes, or of the shortest."""
    one = edges.sparkSession.range(1)
    kind = edges.schema["src"].dataType
    node = lambda x: one.select(F.lit(x).cast(kind).alias("id"))
    return paths_between(edges, node(source), node(target), hops, kinds, only_shortest)


def shortest_paths(edges: DataFrame, source, target, hops: int) -> DataFrame:
    return simple_paths(edges, source, target, hops, only_shortest=True)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_out, fan_in) of every node with an edge, from one exploded pass."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    return edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.o").alias("fan_out"), F.sum("e.i").alias("fan_in"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density and mean degree of touched nodes, from one pass over the edges."""
    n = nodes.agg(F.count("*").alias("n_nodes"))
    touched = degrees(edges).agg(F.count("*").alias("touched"), F.coalesce(F.sum("fan_out"), F.lit(0)).alias("n_edges"))
    one = n.join(F.broadcast(touched))  # one row each
    return one.select(
        "n_nodes", "n_edges", F.round(F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)), 4).alias("density"),
        F.round(2.0 * F.col("n_edges") / F.col("touched"), 2).alias("avg_degree"),
    )


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_counts`` and the size of the largest component."""
    largest = connected_components(edges).groupBy("component").agg(F.count("*").alias("size")).agg(F.coalesce(F.max("size"), F.lit(1)).alias("largest_component"))
    return graph_counts(nodes, edges).join(F.broadcast(largest))  # one row each


def type_distribution(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n, share): how many nodes and edges there are of each kind, unnamed ones as unknown, and their share of all."""
    kinds = [d.select(F.lit(what).alias("what"), F.coalesce("kind", F.lit("unknown")).alias("kind")) for what, d in (("node", nodes), ("edge", edges))]
    rows = kinds[0].unionByName(kinds[1]).groupBy("what", "kind").agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("what")))  # a row a kind


def _levels(front: DataFrame, step, hops: int | None) -> DataFrame:
    """Rows of ``front`` (id, of, depth) and all that ``step`` reaches, each pair once, at its least depth.

    Every level is written; the search ends with an empty one, which pairs that were seen keep from coming again.
    """
    stash = Stash(front.sparkSession)
    seen = front = stash.put(front)
    depth = 1
    while (hops is None or depth < hops) and not front.isEmpty():
        depth += 1
        found = step(front).withColumn("depth", F.lit(depth)).distinct()
        front = stash.put(found.join(seen.select("id", "of"), ["id", "of"], "left_anti").select("id", "of", "depth"))
        seen = seen.unionByName(front)
    return seen


def descendants(tree: DataFrame, root, hops: int | None = None) -> DataFrame:
    """(id, depth) below a root of an (id, parent_id) table, of any depth or so many levels; loops end."""
    t = tree.where("id is not null and parent_id is not null and id != parent_id").select("id", "parent_id")
    front = t.where(F.col("parent_id") == root).select("id", F.lit(root).cast(t.schema["id"].dataType).alias("of"), F.lit(1).alias("depth"))
    step = lambda f: f.select(F.col("id").alias("parent_id"), "of").join(t, "parent_id").select("id", "of")
    return _levels(front, step, hops).where(F.col("id") != F.col("of")).select("id", "depth")


def ancestors(tree: DataFrame, hops: int | None = None) -> DataFrame:
    """(id, ancestor, depth) of every node of an (id, parent_id) table, up to its root."""
    t = tree.where("id is not null and parent_id is not null and id != parent_id").select("id", "parent_id")
    front = t.select(F.col("parent_id").alias("id"), F.col("id").alias("of"), F.lit(1).alias("depth"))
    step = lambda f: f.select("id", "of").join(t, "id").select(F.col("parent_id").alias("id"), "of")
    return _levels(front, step, hops).select(F.col("of").alias("id"), F.col("id").alias("ancestor"), "depth")


def _climbed(tree: DataFrame, stash: Stash) -> tuple[list[DataFrame], DataFrame]:
    """Jumps by pointer doubling, and the ids that lead into a loop or have several parents.

    The k-th jump has (id, up, steps) of every node with a parent: its ancestor 2 ** k levels up, if there is one,
    and how many levels up to 2 ** k there are above it. Their number is the logarithm of the depth.
    """
    above = tree.where("id is not null and parent_id is not null and id != parent_id").select("id", F.col("parent_id").alias("up")).distinct()
    above = stash.put(above.withColumn("steps", F.lit(1).cast("long")))
    size, apart = above.agg(F.count("*"), F.count_distinct("id")).first()
    if size != apart:
        return [above.where("false")], above.select("id").distinct()
    jumps = [above]
    while 2 ** (len(jumps) - 1) <= size:
        now = jumps[-1]
        going = now.where("up is not null")
        if going.isEmpty():
            break
        # by a merge: written ids compress so well that all of them would be sent through the driver as small, in each round
        ahead = now.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2")).hint("merge")
        going = going.join(ahead, "up", "left").select("id", F.col("up2").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"))
        jumps.append(stash.put(going.unionByName(now.where("up is null"))))
    return jumps, stash.put(jumps[-1].where("up is not null").select("id"))


def tree_levels(tree: DataFrame, most: int | None = None) -> DataFrame:
    """(id, level): 1 for roots, one more for each ancestor, ``most`` at most.

    By pointer doubling; only nodes that lead into a loop or trees with several parents need all pairs.
    """
    jumps, odd = _climbed(tree, Stash(tree.sparkSession))
    above = jumps[-1].join(odd.hint("merge"), "id", "left_anti").select("id", F.col("steps").alias("n"))
    if not odd.isEmpty():
        above = above.unionByName(ancestors(tree.join(odd, "id", "left_semi")).groupBy("id").agg(F.count("*").alias("n")))
    level = F.coalesce(F.col("n"), F.lit(0)) + 1
    level = F.least(level, F.lit(most)) if most else level
    return tree.select("id").distinct().join(above.hint("merge"), "id", "left").select("id", level.cast("int").alias("level"))


def subtree_totals(tree: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, count) of the items (id, n) in each node of (id, parent_id) and below it.

    After the k-th jump a node has the sum of all less than 2 ** (k + 1) levels below it: its own and that of
    the nodes 2 ** k levels below. So a chain takes as many rounds as the logarithm of its length, and
    no round has more rows than nodes.
    """
    stash = Stash(tree.sparkSession)
    jumps, odd = _climbed(tree, stash)
    own = tree.select("id").distinct().join(counts.groupBy("id").agg(F.sum("n").alias("n")).hint("merge"), "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("count"))
    total = own = stash.put(own)
    for jump in jumps:
        up = jump.where("up is not null").join(odd.hint("merge"), "id", "left_anti").join(total.hint("merge"), "id").groupBy(F.col("up").alias("id")).agg(F.sum("count").alias("below"))
        before, total = total, stash.put(total.join(up.hint("merge"), "id", "left").select("id", (F.col("count") + F.coalesce("below", F.lit(0))).alias("count")))
        if before is not own:
            stash.drop(before)
    if odd.isEmpty():
        return total
    some = tree.join(odd, "id", "left_semi")
    pairs = ancestors(some).select(F.col("ancestor").alias("id"), F.col("id").alias("of")).where("id != of")
    more = pairs.join(own.select(F.col("id").alias("of"), "count"), "of").groupBy("id").agg(F.sum("count").alias("below"))
    return total.join(more, "id", "left").select("id", (F.col("count") + F.coalesce("below", F.lit(0))).alias("count"))


def category_tree(tree: DataFrame, counts: DataFrame, order: str = "sort_order") -> DataFrame:
    """(id, children, count) of (id, parent_id, order): children in order, with how many items (id, n) are in the node and below it."""
    kids = tree.where("parent_id is not null and parent_id != id").groupBy(F.col("parent_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(order, "id"))).alias("k"))
    out = tree.select("id").join(kids, "id", "left").join(subtree_totals(tree, counts), "id", "left")
    return out.select("id", F.coalesce(F.col("k.id"), F.array().cast(f"array<{dict(tree.dtypes)['id']}>")).alias("children"), "count")


def neighbours(edges: DataFrame, node, kinds: list[str] | None = None, direction: str = "both", most: int = 100) -> DataFrame:
    """(node, kind, direction) of what an edge of the kinds leads to or from, each once; ``most`` is the page."""
    e = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    out = e.where(F.col("src") == node).select(F.col("dst").alias("node"), "kind", F.lit("out").alias("direction"))
    back = e.where(F.col("dst") == node).select(F.col("src").alias("node"), "kind", F.lit("in").alias("direction"))
    rows = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return rows.distinct().orderBy("node", "kind", "direction").limit(most)


def best_paths(edges: DataFrame, source, target, hops: int, kinds: list[str] | None = None, most: int = 10) -> DataFrame:
    """The first simple paths: the shortest, of equals the heaviest, then in order of their nodes."""
    return simple_paths(edges, source, target, hops, kinds).orderBy("hops", F.desc("weight"), "path").limit(most)


def call_chain(edges: DataFrame, symbols: DataFrame, source: str, target: str, hops: int, kinds: list[str]) -> DataFrame:
    """Shortest paths between two names: symbols (id, name, file) by their name, else all of a file by its path."""

    def ends(name: str) -> DataFrame:
        tier = F.when(F.col("name") == name, 1).when(F.col("file") == name, 2)
        both = symbols.select("id", tier.alias("tier")).where("tier is not null")
        return both.join(F.broadcast(both.agg(F.min("tier").alias("_t"))), F.col("tier") == F.col("_t")).select("id").distinct()  # one row

    return paths_between(edges, ends(source), ends(target), hops, kinds, only_shortest=True)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def picture(nodes: DataFrame, edges: DataFrame, counts: DataFrame, kind: str | None = None, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(nodes with a size of 5 to 50 by their documents, edges between them): the least ids of a kind, ``most`` of them. Nothing is deleted."""
    some = (nodes if kind is None else nodes.where(F.col("kind") == kind)).orderBy("id").limit(most)
    sized = some.join(counts.select("id", F.col("n").alias("_n")), "id", "left")
    size = F.least(F.greatest(F.coalesce("_n", F.lit(0)), F.lit(5)), F.lit(50))
    return sized.withColumn("size", size).drop("_n"), induced(edges, some)


def entity_hits(nodes: DataFrame, words: str, kind: str | None = None, most: int = 50) -> DataFrame:
    """(id, score): 1 where the name holds the words, .8 where only the description does, in any case."""
    low = words.lower()
    name, text = F.lower("name").contains(low), F.lower(F.coalesce("description", F.lit(""))).contains(low)
    rows = nodes if kind is None else nodes.where(F.col("kind") == kind)
    return rows.where(name | text).select("id", F.when(name, 1.0).otherwise(0.8).alias("score")).orderBy(F.desc("score"), "id").limit(most)


def entity_detail(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, other, kind, direction, name) of every node's edges with the name of the other end; two equi-joins, no OR."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "kind", F.lit("out").alias("direction"))
    back = edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "kind", F.lit("in").alias("direction"))
    return out.unionByName(back).join(nodes.select(F.col("id").alias("other"), "name"), "other", "left").select("id", "other", "kind", "direction", "name")


def cycles(edges: DataFrame, hops: int = 3) -> DataFrame:
    """Directed cycles up to a length, each once, from its least node.

    They are looked for from the node with the fewest edges (of equals the least): a hub is only reached
    from smaller nodes, so its edges don't meet each other. Paths are columns and carry the rank of their first
    node only as long as they grow; what is read once is not written.
    """
    stash = Stash(edges.sparkSession)
    e = stash.put(edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d")).where("_s != _d").distinct())
    n = degrees(e.select(F.col("_s").alias("src"), F.col("_d").alias("dst"))).select("node", F.struct((F.col("fan_out") + F.col("fan_in")).alias("n"), "node").alias("rank"))
    ranked = e.join(n.withColumnsRenamed({"node": "_s", "rank": "_a"}), "_s").join(n.withColumnsRenamed({"node": "_d", "rank": "_b"}), "_d")
    ranked = stash.put(ranked.select("_s", "_d", "_a", "_b"))
    onward = ranked.where("_a < _b").select(F.col("_s").alias("_p0"), F.col("_d").alias("_p1"), F.col("_a").alias("_least"))
    nodes, out, front = ["_p0", "_p1"], None, onward
    back = e.select(F.col("_s").alias("_last"), F.col("_d").alias("_p0"))
    for k in range(hops - 1):
        closed = front.select(*nodes, F.col(nodes[-1]).alias("_last")).join(back, ["_last", "_p0"]).select(F.array(*nodes).alias("path"))
        out = closed if out is None else out.unionByName(closed)
        if k + 2 < hops:
            step = ranked.select(F.col("_s").alias(nodes[-1]), F.col("_d").alias(f"_p{k + 2}"), "_b")
            front = front.join(step, nodes[-1]).where(F.col("_b") > F.col("_least"))
            for x in nodes[1:]:
                front = front.where(F.col(x) != F.col(f"_p{k + 2}"))
            nodes = [*nodes, f"_p{k + 2}"]
            front = stash.put(front.select(*nodes, "_least")) if k + 3 < hops else front.select(*nodes)
    start = F.array_position("path", F.array_min("path")).cast("int")
    turned = F.concat(F.slice("path", start, F.size("path")), F.slice("path", F.lit(1), start - 1))
    return out.select(turned.alias("path"), F.size("path").alias("length"))
