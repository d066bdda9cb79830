"""N-gram Jaccard self-join: a prefix-tree join that is exact at any skew.

Each document is its set of word n-gram hashes, in one global order (of the hash). Two documents
link when 100 * intersection >= percent * union. Four steps:

1. Documents with equal sets become one class, named by its least doc_id.
2. Candidates, by prefixes in an order of rarity. A set's prefix is its first
   size - ceil(p * size / 100) + 1 n-grams; sets that link share an n-gram of both prefixes, in
   whatever order all sets are kept. The order here: n-grams with hashes in the counted range
   (``counted_share`` of all) by the exact number of classes that hold them, then by hash; then the
   others by hash. So only counted n-grams, and the few others that reach into the prefix of a
   set with few counted ones, are shuffled. An n-gram of one class ties nothing, so a document
   takes part only if over 100 - p percent of it, about, is found elsewhere too; common
   passages come last and tie no one. Classes with a common n-gram in their prefixes are tied
   to the least of them (a star, no pairs) and connected components of these ties are the
   clusters. Linked classes never part.
3. Each cluster's sets are parted once more in the same way, now by the exact rarity of all their
   n-grams, and stored in prefix trees one after another, their n-grams in one order, the most
   frequent first, so that sets share paths far down. Before a set is stored it
   traverses the tree: the overlap with a path is counted once for all sets below it, subtrees
   are pruned by the lengths that remain, and subtrees already known to be in the set's own
   component are skipped. A cluster of more than ``block_tokens`` n-grams is cut into blocks by
   set size, and within one size by hash, and pairs of blocks whose sizes can link are tasks of
   their own; so no task is unbounded and no link between components is lost. In clusters of more
   than NEAR_BLOCKS blocks each block is first joined with itself and the next one. The
   components known then are given to the other pairs; of these, blocks that lie whole in one
   component are not compared, which spares large groups of near copies the square of their
   number of blocks.
4. Connected components of the links found give the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marlstone.llm.texts import WordHashes, map_rows, shingles, words
from marlstone.operators.components import connected_components
from marlstone.plans.stash import Stash

#: n-grams of one block of a cluster that is too large for one task, about.
BLOCK_TOKENS = 500_000
#: Clusters of more blocks are compared in two rounds.
NEAR_BLOCKS = 4
#: n-grams of the sets that a task takes on, about; clusters are small, and comparing takes longer than their bytes tell.
TASK_TOKENS = 120_000
#: One class in so many shows which n-grams are frequent; those above FREQUENT in that sample, or above
#: its n-grams divided by MOST_FREQUENT, which bounds their number, are dealt out in SALTS parts.
SAMPLED_CLASSES, FREQUENT, MOST_FREQUENT, SALTS = 32, 12, 50_000, 64


def ngram_set(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Distinct n-gram hashes in ascending order (A-Z count as a-z)."""
    return np.unique(shingles(hashes.of(words(text, lower=True)), n))


def needed(a: int, b: int, percent: int) -> int:
    """Least intersection with which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def counted_share(percent: int) -> float:
    """Share of the hash range whose n-grams are counted: twice what a prefix takes, and some more."""
    return min(1.0, 2 * (100 - percent) / 100 + 0.05)


def sent_tokens(tokens: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """How many n-grams are in the counted range, and these with those others that may be in the prefix."""
    share = counted_share(percent)
    counted = len(tokens) if share == 1 else int(np.searchsorted(tokens, np.uint64(int(share * 2.0**64))))
    return counted, tokens[: max(counted, prefix_length(len(tokens), percent))]


class Node:
    """A path of the tree: tokens, the sets that end here, what lies below."""

    __slots__ = ("tokens", "children", "ends", "low", "high", "members")

    def __init__(self, tokens: np.ndarray):
        self.tokens, self.children, self.ends = tokens, {}, []
        self.low, self.high, self.members = 1 << 60, 0, set()


class PrefixTree:
    """Links of sets that come one after another, with components kept as they join."""

    def __init__(self, percent: int):
        self.percent, self.root, self.parent, self.links = percent, Node(np.empty(0, np.uint64)), {}, []

    def find(self, x):
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def know(self, name, component) -> None:
        """``name`` is in a component already, which is called by its least name."""
        self.parent.setdefault(component, component)
        self.parent[name] = component

    def _below(self, node: Node) -> set:
        if len(node.members) > 1:
            node.members = {self.find(x) for x in node.members}
        return node.members

    def probe(self, name, tokens: np.ndarray) -> None:
        """Join ``name`` with every stored set that links with it and is in another component."""
        size, percent = len(tokens), self.percent
        if name not in self.parent:
            self.parent[name] = name
        todo = [(self.root, 0, 0, 0)]  # node, overlap, place in tokens, depth: all before the node's own tokens
        while todo:
            node, overlap, at, depth = todo.pop()
            if 100 * node.high < percent * size or 100 * size < percent * node.low:
                continue
            me = self.find(name)
            below = self._below(node)
            if not below or all(self.find(x) == me for x in below):
                continue
            own = node.tokens
            if len(own):
                depth += len(own)
                to = at + int(np.searchsorted(tokens[at:], own[-1], side="right"))
                part = tokens[at:to]
                if len(part):
                    spots = np.searchsorted(part, own)
                    spots[spots == len(part)] = 0
                    overlap += int(np.count_nonzero(part[spots] == own))
                at = to
            least = needed(size, max(node.low, -(-percent * size // 100)), percent)
            if overlap + min(size - at, node.high - depth) < least:
                continue
            for other, n in node.ends:
                if overlap >= needed(size, n, percent) and self.find(other) != self.find(name):
                    self.parent[max(self.find(other), self.find(name))] = min(self.find(other), self.find(name))
                    self.links.append((name, other))
            todo.extend((x, overlap, at, depth) for x in reversed(node.children.values()))

    def store(self, name, tokens: np.ndarray) -> None:
        if name not in self.parent:
            self.parent[name] = name
        node, rest, size, me = self.root, tokens, len(tokens), self.find(name)
        while True:
            node.low, node.high = min(node.low, size), max(node.high, size)
            node.members.add(me)
            if not len(rest):
                node.ends.append((name, size))
                return
            child = node.children.get(int(rest[0]))
            if child is None:
                child = node.children[int(rest[0])] = Node(rest)
                rest = rest[:0]
            else:
                width = min(len(child.tokens), len(rest))
                differ = np.flatnonzero(child.tokens[:width] != rest[:width])
                same = int(differ[0]) if len(differ) else width
                if same < len(child.tokens):  # part the path
                    upper = Node(child.tokens[:same])
                    upper.low, upper.high, upper.members = child.low, child.high, set(child.members)
                    child.tokens = child.tokens[same:]
                    upper.children[int(child.tokens[0])] = child
                    node.children[int(rest[0])] = child = upper
                rest = rest[same:]
            node = child


def regrouped(sides: tuple[list[tuple], list[tuple]], percent: int) -> list[tuple[list[tuple], list[tuple]]]:
    """The sets in groups that no link leaves, their n-grams as numbers, the most frequent first.

    Groups are found as clusters are, but with the exact counts of all n-grams of the task: sets that
    link share one of the rarest n-grams of both, the first size - ceil(p * size / 100) + 1 of each.
    """
    every = [tokens for side in sides for _, tokens in side]
    if not every:
        return []
    seen, inverse, counts = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    number = np.empty(len(seen), np.int64)  # 0 for the rarest
    number[np.lexsort((seen, counts))] = np.arange(len(seen))
    held = counts[np.argsort(number)] > 1
    sizes = np.array([len(x) for x in every])
    ordered = [np.sort(x) for x in np.split(number[inverse], np.cumsum(sizes)[:-1])]
    parent = list(range(len(every)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    first: dict[int, int] = {}
    for i, x in enumerate(ordered):
        rarest = x[: prefix_length(len(x), percent)]
        for token in rarest[held[rarest]].tolist():
            a, b = find(first.setdefault(token, i)), find(i)
            if a != b:
                parent[max(a, b)] = min(a, b)
    groups: dict[int, tuple[list, list]] = {}
    most = np.uint64(len(seen))
    names = [(name, k) for k, side in enumerate(sides) for name, _ in side]
    for i, (name, k) in enumerate(names):
        groups.setdefault(find(i), ([], []))[k].append((name, (most - ordered[i].astype(np.uint64))[::-1]))
    return list(groups.values())


def tree_links(left: list[tuple], right: list[tuple] | None, percent: int, known: dict | None = None) -> list[tuple]:
    """Links that join components: among ``left`` or, with ``right``, from right to left; ``known`` are components there are already."""
    tree = PrefixTree(percent)
    for name, component in (known or {}).items():
        tree.know(name, component)
    for name, tokens in left:
        if right is None:
            tree.probe(name, tokens)
        tree.store(name, tokens)
    for name, tokens in right or ():
        tree.probe(name, tokens)
    return tree.links


def ngram_jaccard_components(
    docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (least linked doc_id).

    Null or blank texts have the empty set and are their own component. A repeated row is
    in the component of its copy; where a doc_id comes with several texts, each row follows its
    text. A row with a null doc_id can't be named in a link: it gets its n_shingles and a null
    component_id. Other columns are not read. An empty table gives
    an empty result. Texts of any length are taken whole.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1..100")
    spark = docs.sparkSession
    stash = Stash(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def sizes():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> dict:
            sets = [ngram_set(x, n, hashes) for x in batch.column("text").to_pylist()]
            keys = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            some = [k is not None and k[0] % SAMPLED_CLASSES == 0 for k in keys]
            return {
                "doc_id": batch.column("doc_id"),
                "n_shingles": [len(x) for x in sets],
                "key": keys,
                "sample": [sent_tokens(x, percent)[1].view(np.int64) if shown else None for x, shown in zip(sets, some)],
            }

        return step

    base = stash.put(map_rows(docs, "doc_id long, n_shingles long, key binary, sample array<long>", sizes))
    classes = stash.put(
        base.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    )
    sampled = base.where("sample is not null").groupBy("key").agg(F.first("sample").alias("sample"))
    seen = stash.put(sampled.select(F.explode("sample").alias("token")).groupBy("token").agg(F.count("*").alias("seen")))
    least = max(FREQUENT, -(-(seen.agg(F.sum("seen")).first()[0] or 0) // MOST_FREQUENT))
    frequent = seen.where(F.col("seen") >= least).select("token", (F.col("seen") * SAMPLED_CLASSES).alias("often"))  # MOST_FREQUENT rows at most

    def prefixes():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> dict:
            sets = [ngram_set(x, n, hashes) for x in batch.column("text").to_pylist()]
            found = [sent_tokens(x, percent) for x in sets]
            return {
                "doc_id": batch.column("doc_id"),
                "counted": [c for c, _ in found],
                "room": [prefix_length(len(x), percent) for x in sets],
                "tokens": [t.view(np.int64) for _, t in found],
            }

        return step

    sent = map_rows(docs.where("doc_id is not null"), "doc_id long, counted int, room int, tokens array<long>", prefixes)
    sent = sent.join(classes.select("rep").distinct().hint("shuffle_hash"), F.col("doc_id") == F.col("rep"))
    sent = sent.select("rep", "counted", "room", F.posexplode("tokens").alias("at", "token"))
    sent = sent.select("rep", "token", (F.col("at") < F.col("counted")).alias("is_counted"), "counted", "room")
    sent = sent.join(F.broadcast(frequent), "token", "left").withColumn("salt", F.when(F.col("often").isNotNull(), F.pmod(F.xxhash64("rep"), F.lit(SALTS))).otherwise(0))
    part = Window.partitionBy("token", "salt")
    shared = sent.withColumn("holders", F.coalesce("often", F.count("*").over(part))).where("holders > 1")
    # texts with one doc_id and equal lengths are ranked as one, which only lengthens their prefixes
    own = Window.partitionBy("rep", "counted", "room")
    rank = F.row_number().over(own.orderBy(F.desc("is_counted"), "holders", "token"))
    alone = F.col("counted") - F.count(F.when(F.col("is_counted"), 1)).over(own)
    prefix = shared.withColumn("rank", rank).withColumn("alone", alone).where("not is_counted or rank + alone <= room")
    met = prefix.select("rep", "token", "often", F.min("rep").over(part).alias("least"))
    met = stash.put(met.where("rep != least or often is not null"))
    firsts = met.where("often is not null").groupBy("token", "least").count()  # SALTS rows of a token at most
    firsts = firsts.select(F.col("least").alias("rep"), F.min("least").over(Window.partitionBy("token")).alias("least"))
    ties = met.select("rep", "least").unionByName(firsts).where("rep != least").distinct()
    clusters = connected_components(ties, "rep", "least").withColumnsRenamed({"node": "rep", "component": "cluster"})
    stash.drop(met)
    stash.drop(seen)

    largest = classes.groupBy("rep").agg(F.max("n").alias("n"))
    members = stash.put(clusters.join(largest, "rep"))
    # a block is a run of n-grams in order of size; sets of one size are dealt along their part of it by hash
    of_size = members.groupBy("cluster", "n").agg(F.sum("n").alias("long"))
    order = Window.partitionBy("cluster").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    of_size = of_size.withColumn("before", F.coalesce(F.sum("long").over(order), F.lit(0)))
    at = F.col("before") + F.pmod(F.xxhash64("rep"), F.col("long"))
    placed = stash.put(members.join(of_size, ["cluster", "n"]).select("rep", "cluster", "n", F.floor(at / block_tokens).cast("int").alias("block")))
    stash.drop(members)
    block = placed.groupBy("cluster", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = block.select("cluster", F.col("block").alias("block2"), F.col("low").alias("low2"))
    # (block, block2): the sets of block2 are no smaller, and a pair may link
    pairs = block.join(other, "cluster").where(f"block2 = block or (block2 > block and 100 * high >= {percent} * low2)")
    last = block.groupBy("cluster").agg(F.max("block").alias("last"))
    near = (F.col("block2") - F.col("block") <= 1) | (F.col("last") < NEAR_BLOCKS)
    pairs = stash.put(pairs.join(last, "cluster").select("cluster", "block", "block2", near.alias("near")))
    size = placed.agg(F.sum("n").alias("tokens"), F.max("block").alias("last")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size.tokens or 0) // TASK_TOKENS))
    texts = docs.where("doc_id is not null and text is not null")

    def compared(some: DataFrame, members: DataFrame) -> DataFrame:
        """Links of the given pairs of blocks; ``members`` are (rep, cluster, block, component)."""
        roles = some.select(
            "cluster", F.col("block").alias("a"), F.col("block2").alias("b"), F.explode(F.array_distinct(F.array("block", "block2"))).alias("own")
        )
        tasks = members.withColumnRenamed("block", "own").join(roles, ["cluster", "own"])
        rows = texts.join(tasks.hint("shuffle_hash"), F.col("doc_id") == F.col("rep"))
        rows = rows.select("cluster", "a", "b", "own", "rep", "component", "text")
        rows = rows.repartition(parts, "cluster", "a", "b")  # by number, so that small partitions are not put together by bytes
        return stash.put(rows.groupBy("cluster", "a", "b").applyInArrow(_cluster_links(n, percent), "src long, dst long"))

    members = placed.select("rep", "cluster", "block", F.col("rep").alias("component"))
    links = compared(pairs.where("near"), members)
    joined = connected_components(links, "src", "dst").withColumnsRenamed({"node": "rep"})
    if (size.last or 0) >= NEAR_BLOCKS:
        members = stash.put(placed.join(joined, "rep", "left").select("rep", "cluster", "block", F.coalesce("component", "rep").alias("component")))
        whole = members.groupBy("cluster", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        first = whole.select("cluster", "block", F.when(F.col("low") == F.col("high"), F.col("low")).alias("one"))
        second = first.withColumnsRenamed({"block": "block2", "one": "one2"})
        far = pairs.where("not near").join(first, ["cluster", "block"]).join(second, ["cluster", "block2"])
        far = stash.put(far.where("one is null or one2 is null or one != one2").select("cluster", "block", "block2"))
        if not far.isEmpty():
            more = compared(far, members)
            joined = connected_components(links.unionByName(more), "src", "dst").withColumnsRenamed({"node": "rep"})
            stash.drop(more)
        stash.drop(far)
        stash.drop(members)
    stash.drop(links)
    stash.drop(pairs)
    stash.drop(placed)
    known = classes.join(joined, "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    found = base.join(known, "key", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _cluster_links(n: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        hashes, sides = WordHashes(), ([], [])
        own, a = table.column("own").to_numpy(), table.column("a").to_numpy()
        b = table.column("b").to_numpy()
        reps, components = table.column("rep").to_pylist(), table.column("component").to_pylist()
        for name, is_right, text in zip(reps, (own != a).tolist(), table.column("text").to_pylist()):
            sides[is_right].append((name, ngram_set(text, n, hashes)))
        for side in sides:
            side.sort(key=lambda x: (len(x[1]), x[0]))
        split, links = bool(len(a)) and a[0] != b[0], []
        component = dict(zip(reps, components))
        for left, right in regrouped(sides, percent):
            if right if split else len(left) > 1:
                known = {name: component[name] for name, _ in (*left, *right) if component[name] != name}
                links += tree_links(left, right if split else None, percent, known)
        return pa.table({"src": pa.array([x for x, _ in links], pa.int64()), "dst": pa.array([x for _, x in links], pa.int64())})

    return run


#: Names of rows whose doc_id stands for several texts: from here on, by a hash of the text.
STAND_INS = 1 << 62


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does: its least doc_id.

    All columns are kept. Rows are judged by their texts: where a doc_id comes with several texts,
    each of them is a document of its own, which stays unless it is linked with another one (one
    with a doc_id of its own stays first). Of rows that repeat doc_id and text one stays; rows with a
    null doc_id, which can't be told apart, all stay.
    """
    stash = Stash(docs.sparkSession)
    own, mark = F.col(f"`{doc_id}`").cast("long"), F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.alias("name"), mark.alias("mark"), F.col(f"`{text}`").cast("string").alias("text"))
    several = rows.groupBy("name").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("name is not null and low != high")
    several = stash.put(several.select(F.col("name").alias("several")))
    named = rows.where("name is not null")
    if not several.isEmpty():
        stand_in = F.lit(STAND_INS) + F.col("mark").bitwiseAND(F.lit(STAND_INS - 1))
        named = named.join(several, F.col("name") == F.col("several"), "left")
        named = named.withColumn("name", F.when(F.col("several").isNull(), F.col("name")).otherwise(stand_in)).drop("several")
    found = ngram_jaccard_components(named.select("name", "text"), doc_id="name", text="text", **options)
    stay = stash.put(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("name")).agg(F.count("*").alias("n")))
    kept = named.select("row", "name").join(stay.hint("shuffle_hash"), "name")
    if not stay.where("n > 1").isEmpty():  # counted first, so that the rows of one name meet in no task
        plain = [F.col("row").getField(c).cast("string") if "map<" in kind else F.col("row").getField(c) for c, kind in docs.dtypes]
        once, again = kept.where("n = 1").select("row"), kept.where("n > 1").withColumn("order", F.struct(F.xxhash64(*plain).alias("a"), F.xxhash64(F.lit(1), *plain).alias("b")))
        kept = once.unionByName(again.groupBy("name").agg(F.min_by("row", "order").alias("row")).select("row"))
    kept = kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return kept.unionByName(docs.where(F.col(f"`{doc_id}`").isNull()))
