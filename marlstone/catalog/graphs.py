"""Hierarchies, neighbours, paths and pictures of graphs over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import graph as G
from marlstone.registry import customer, lineitem, nation, orders, part, query, region, supplier


def heap(spark, d):
    """Customers as a tree in which each one's parent has half its number."""
    return customer(spark, d).select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 2).alias("parent_id")).where("id > 0")


_UP = "with recursive t as (select c_custkey as id, c_custkey // 2 as p from customer where c_custkey > 1), a(id, ancestor, depth) as (select id, p, 1 from t union all select a.id, t.p, depth + 1 from a join t on t.id = a.ancestor)"


@query(f"{_UP} select id, ancestor, depth from a where ancestor > 0")
def ancestors(spark, d):
    """All ancestors of every node, to the root."""
    return G.ancestors(heap(spark, d).where("id > 1"))


@query(f"{_UP} select id, depth from a where ancestor = 3")
def descendants(spark, d):
    """Everything below a node, of any depth."""
    return G.descendants(heap(spark, d), 3)


@query(f"{_UP} select id, depth from a where ancestor = 3 and depth <= 2")
def type_tree(spark, d):
    return G.descendants(heap(spark, d), 3, 2)


@query("select c_custkey as id, least(cast(floor(log2(c_custkey)) as integer) + 1, 3) as level from customer where c_custkey > 0")
def category_levels(spark, d):
    """Depth to the root, three at most."""
    return G.tree_levels(heap(spark, d).where("id > 1").unionByName(spark.sql("select cast(1 as bigint) as id, cast(null as bigint) as parent_id")), 3)


@query("""with c as (select c_nationkey, count(*) as n from customer group by 1) select n_nationkey + 100 as id, '' as children, coalesce(n, 0) as count from nation left join c on c_nationkey = n_nationkey
union all select r_regionkey + 10, (select string_agg(n_nationkey + 100, ',' order by n_name desc, n_nationkey) from nation where n_regionkey = r_regionkey), (select coalesce(sum(n), 0) from nation left join c on c_nationkey = n_nationkey where n_regionkey = r_regionkey) from region
union all select 1, (select string_agg(r_regionkey + 10, ',' order by r_name) from region), (select sum(n) from c)""")
def category_tree(spark, d):
    """Regions and nations with their children in order and the customers in and below them."""
    rank = F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.desc("n_name"), "n_nationkey"))
    n = nation(spark, d).select((F.col("n_nationkey") + 100).alias("id"), (F.col("n_regionkey") + 10).alias("parent_id"), F.lpad(rank.cast("string"), 5, "0").alias("sort_order"))
    r = region(spark, d).select((F.col("r_regionkey") + 10).alias("id"), F.lit(1).alias("parent_id"), F.col("r_name").alias("sort_order"))
    tree = n.unionByName(r).unionByName(spark.sql("select 1 as id, cast(null as int) as parent_id, '' as sort_order"))
    counts = customer(spark, d).groupBy((F.col("c_nationkey") + 100).alias("id")).agg(F.count("*").alias("n"))
    return G.category_tree(tree, counts).withColumn("children", F.array_join(F.transform("children", lambda x: x.cast("string")), ","))


@query("select c_custkey as id, cast(row_number() over (partition by c_nationkey order by c_custkey) as integer) as level from customer")
def chain_levels(spark, d):
    """Customers of a nation as one chain, each below the one before: levels as deep as there are customers."""
    before = F.lag("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    return G.tree_levels(customer(spark, d).select(F.col("c_custkey").alias("id"), before.alias("parent_id")))


@query(f"{_UP}, n as (select o_custkey as id, count(*) as n from orders group by 1) select c_custkey as id, cast(coalesce(sum(n), 0) as bigint) as count from customer left join (select ancestor, id from a union all select c_custkey, c_custkey from customer) b on b.ancestor = c_custkey left join n on n.id = b.id where c_custkey > 0 group by 1")
def subtree_totals(spark, d):
    """Orders of every customer of a tree and of all below."""
    counts = orders(spark, d).groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return G.subtree_totals(heap(spark, d), counts)


def named_edges(spark, d):
    """Suppliers and parts of all line items, by return flag."""
    return lineitem(spark, d).select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst"), F.col("l_returnflag").alias("kind"), F.lit(1.0).alias("weight")).distinct()


def named_nodes(spark, d):
    s = supplier(spark, d).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"), F.lit(None).cast("string").alias("description"))
    p = part(spark, d).select((F.col("p_partkey") + 1000000).alias("id"), F.col("p_name").alias("name"), F.lit("part").alias("kind"), F.col("p_type").alias("description"))
    return s.unionByName(p)


_E = "(select distinct l_suppkey as src, l_partkey + 1000000 as dst, l_returnflag as kind from lineitem)"


@query(f"select * from (select src as node, kind, 'in' as direction from {_E} where dst = 1000003 and kind in ('A', 'R') union select dst, kind, 'out' from {_E} where src = 1000003) order by node, kind limit 100")
def neighbours_of_kinds(spark, d):
    return G.neighbours(named_edges(spark, d), 1000003, ["A", "R"])


@query(f"select src as id, dst as other, e.kind, 'out' as direction, p_name as name from {_E} e join part on p_partkey + 1000000 = dst union all select dst, src, e.kind, 'in', s_name from {_E} e join supplier on s_suppkey = src")
def entity_edges(spark, d):
    """Edges of every entity, at either end, with the names of the other ends."""
    return G.entity_detail(named_edges(spark, d), named_nodes(spark, d))


@query("""select id, score from (select p_partkey + 1000000 as id, case when contains(lower(p_name), 'red') then 1.0 else 0.8 end as score from part where contains(lower(p_name), 'red') or contains(lower(p_type), 'red')) order by score desc, id limit 50""")
def entity_search(spark, d):
    return G.entity_hits(named_nodes(spark, d), "Red", "part")


@query(f"""with n as (select s_suppkey as id from supplier order by 1 limit 40), m as (select p_partkey + 1000000 as id from part order by 1 limit 60), c as (select src as id, count(*) as n from {_E} group by 1)
select 'node' as what, n.id as a, least(greatest(coalesce(c.n, 0), 5), 50) as b from n left join c using (id) union all select 'edge', src, dst from (select distinct src, dst from {_E}) where src in (from n) and dst in (from m)""")
def graph_picture(spark, d):
    """Forty suppliers sized by their edges, and the edges between them and sixty parts."""
    e = named_edges(spark, d)
    counts = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    nodes = named_nodes(spark, d)
    some, _ = G.picture(nodes, e, counts, "supplier", 40)
    parts, _ = G.picture(nodes, e, counts, "part", 60)
    between = G.induced(e, some.select("id").unionByName(parts.select("id"))).select("src", "dst").distinct()
    return some.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.col("size").alias("b")).unionByName(between.select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b")))


def follows(spark, d):
    """Parts that follow each other in an order, by return flag, weighted by how often."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = lineitem(spark, d).select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.col("l_returnflag").alias("kind")).where("src != dst")
    return rows.groupBy("src", "dst", "kind").agg(F.count("*").cast("double").alias("weight"))


_F = "(select src, dst, kind, cast(count(*) as double) as weight from (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as dst, l_returnflag as kind from lineitem) where src <> dst group by 1, 2, 3)"


@query(f"""with recursive e as (select * from {_F} where kind in ('A', 'N')), p(path, node, hops, weight) as (select [src, dst], dst, 1, weight from e where src = 1 and dst <> 1
union all select list_append(p.path, e.dst), e.dst, hops + 1, p.weight + e.weight from p join e on e.src = p.node where p.node <> 43 and hops < 3 and not list_contains(p.path, e.dst))
select array_to_string(path, '>') as path, hops, weight from p where node = 43 order by hops, weight desc, p.path limit 10""")
def best_paths(spark, d):
    """The ten first paths of some kinds: shortest, then heaviest."""
    out = G.best_paths(follows(spark, d), 1, 43, 3, ["A", "N"])
    return out.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "hops", "weight")


@query(f"""with recursive s as (select p_partkey from part where p_partkey // 3 = 2), e as (select * from {_F} where kind in ('A', 'N')),
p(path, node, hops, weight) as (select [src, dst], dst, 1, weight from e join s on s.p_partkey = src where dst <> src union all select list_append(p.path, e.dst), e.dst, hops + 1, p.weight + e.weight from p join e on e.src = p.node where p.node <> 10 and hops < 3 and not list_contains(p.path, e.dst)),
f as (select * from p where node = 10 and path[1] <> 10) select array_to_string(path, '>') as path, hops, weight from f where hops = (select min(hops) from f)""")
def call_chain(spark, d):
    """Shortest chains from symbols of a file to a symbol by its name."""
    symbols = part(spark, d).select(F.col("p_partkey").alias("id"), F.concat(F.lit("f"), "p_partkey").alias("name"), F.concat(F.lit("src/"), F.floor(F.col("p_partkey") / 3)).alias("file"))
    out = G.call_chain(follows(spark, d), symbols, "src/2", "f10", 3, ["A", "N"])
    return out.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "hops", "weight")


@query(f"""with f as (select p_partkey from part where p_type = 'PROMO'), e as (select src, dst, kind from {_F}) select src, dst, kind from e where src in (from f) and dst in (from f) and kind in ('A', 'R')""")
def dependency_graph(spark, d):
    """Edges of some kinds between the files of one repository."""
    files = part(spark, d).where("p_type = 'PROMO'").select(F.col("p_partkey").alias("id"))
    return G.induced(follows(spark, d).where("kind in ('A', 'R')"), files).select("src", "dst", "kind")


@query("select c_custkey, n_name, o.n from customer join nation on n_nationkey = c_nationkey left join (select o_custkey, count(*) as n from orders where o_orderstatus = 'F' group by 1) o on o_custkey = c_custkey where exists (select 1 from region where r_regionkey = n_regionkey and r_name = 'ASIA') and c_nationkey in (select s_nationkey from supplier)")
def nested_semi_joins(spark, d):
    """Customers of nations of a region that have suppliers, with their finished orders."""
    asia = nation(spark, d).join(region(spark, d).where("r_name = 'ASIA'").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey", "left_semi")
    asia = asia.join(supplier(spark, d).select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi")
    done = orders(spark, d).where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = customer(spark, d).join(asia.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    return rows.join(done, "c_custkey", "left").select("c_custkey", "n_name", "n")


@query("""select c_custkey, n_name, string_agg(o_orderkey || ':' || coalesce(l, ''), ';' order by o_orderkey) as nested from customer join nation on n_nationkey = c_nationkey join (select o_custkey, o_orderkey, (select string_agg(l_linenumber, ',' order by l_linenumber, l_partkey) from lineitem where l_orderkey = o_orderkey) as l from orders) on o_custkey = c_custkey group by 1, 2""")
def nested_records(spark, d):
    """Customers with their orders and the lines of these, as one row each."""
    lines = lineitem(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    per = orders(spark, d).join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "lines"))).alias("orders"))
    one = lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit(":"), F.coalesce(F.array_join(F.transform(x["lines"], lambda y: y["l_linenumber"].cast("string")), ","), F.lit("")))
    rows = customer(spark, d).join(per, "c_custkey").join(nation(spark, d).withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    return rows.select("c_custkey", "n_name", F.array_join(F.transform("orders", one), ";").alias("nested"))


@query(f"""with e as (select distinct src, dst from {_E}), n as (select (select count(*) from supplier) + (select count(*) from part) as v), t as (select src as x from e union select dst from e)
select v as n_nodes, (select count(*) from e) as n_edges, round((select count(*) from e) / (v * (v - 1.0)), 4) as density, round(2.0 * (select count(*) from e) / (select count(*) from t), 2) as avg_degree from n""")
def graph_counts(spark, d):
    return G.graph_counts(named_nodes(spark, d), named_edges(spark, d).select("src", "dst").distinct())


@query(f"""with k as (select 'node' as what, 'supplier' as kind from supplier union all select 'node', 'part' from part union all select 'edge', kind from {_E}), n as (select what, kind, count(*) as n from k group by 1, 2)
select *, n / sum(n) over (partition by what) as share from n""")
def type_distribution(spark, d):
    """Kinds of entities and relations with their numbers and shares."""
    return G.type_distribution(named_nodes(spark, d), named_edges(spark, d))
