"""Writes and exports, each as the rows after it, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.text import file_size
from marlstone.operators import store as W
from marlstone.registry import customer, docs, events, lineitem, nation, orders, part, query, supplier, turns


def _files(spark, d):
    tags = F.when(F.col("p_partkey") % 4 == 0, F.lit(None)).otherwise(F.array("p_type", "p_brand"))
    return part(spark, d).select("p_partkey", tags.alias("tags"), (F.col("p_partkey") % 5 == 0).alias("is_deleted"), "p_brand", "p_size")


_TAGS = "(select p_partkey, p_partkey % 3 = 0 as hit, case when p_partkey % 4 = 0 then [] else [p_type, p_brand] end as t from part)"


@query(f"""select p_partkey, array_to_string(case when hit then list_sort(list_distinct(list_concat(t, ['new', 'PROMO']))) else t end, ',') as added, array_to_string(case when hit then list_filter(t, lambda x: x <> 'PROMO') else t end, ',') as removed,
array_to_string(case when hit then ['only'] else t end, ',') as replaced from {_TAGS}""")
def batch_tags(spark, d):
    """Tags added, removed and replaced in a third of the rows."""
    rows, hit = _files(spark, d), F.col("p_partkey") % 3 == 0
    out = rows.select("p_partkey")
    for how, tags in (("add", ["new", "PROMO"]), ("remove", ["PROMO"]), ("replace", ["only"])):
        name = {"add": "added", "remove": "removed", "replace": "replaced"}[how]
        out = out.join(W.tagged(rows, hit, tags, how).select("p_partkey", F.coalesce(F.array_join("tags", ","), F.lit("")).alias(name)), "p_partkey")
    return out


@query("""select c_custkey, case when c_custkey % 3 = 0 and c_nationkey < 12 and c_custkey < 1000000 then 99 else c_nationkey end as c_nationkey, false as failed from customer union all select c_custkey, null, true from customer where c_custkey % 3 = 0 and c_nationkey >= 12 union all select -1, null, true""")
def batch_move(spark, d):
    """Customers asked to move: those of allowed nations do, the others and unknown ones fail."""
    rows = customer(spark, d).select("c_custkey", "c_nationkey")
    asked = rows.where("c_custkey % 3 = 0").select("c_custkey").unionByName(spark.sql("select cast(-1 as bigint) as c_custkey"))
    after, failed = W.moved(rows, asked, nation(spark, d).where("n_nationkey < 12").select(F.col("n_nationkey").alias("c_nationkey")), "c_custkey", {"c_nationkey": 99}, "c_nationkey")
    return after.withColumn("failed", F.lit(False)).unionByName(failed.select("c_custkey", F.lit(None).cast("int").alias("c_nationkey"), F.lit(True).alias("failed")))


@query("""select s_suppkey, s_name, s_suppkey % 10 = 3 as is_deleted from supplier union all select (select max(s_suppkey) from supplier) + 1 + r_regionkey, r_name, false from region""")
def created_and_deleted(spark, d):
    """Suppliers with regions added as new ones, and some soft-deleted."""
    from marlstone.registry import region

    rows = supplier(spark, d).select("s_suppkey", "s_name", F.lit(False).alias("is_deleted"))
    news = region(spark, d).select(F.lit(0).cast("long").alias("s_suppkey"), F.col("r_name").alias("s_name"), F.lit(False).alias("is_deleted"), "r_regionkey")
    after = W.created(rows, news, "s_suppkey", "r_regionkey").select("s_suppkey", "s_name", "is_deleted")
    gone = F.col("s_name").startswith("Supplier") & (F.col("s_suppkey") % 10 == 3)
    return W.soft_deleted(after, gone)


@query("select p_partkey, case when p_size > 40 then 0 else p_size end as p_size from part where p_partkey % 5 <> 0 and p_partkey <> 8 union all select p_partkey, 1 from part where p_partkey = 8")
def updated_and_purged(spark, d):
    """Rows changed where a condition holds, one by its key, and soft-deleted ones gone for good."""
    rows = W.hard_deleted(_files(spark, d)).select("p_partkey", "p_size")
    rows = W.updated(rows, F.col("p_size") > 40, {"p_size": 0})
    return W.updated(rows, F.col("p_partkey") == 8, {"p_size": 1})


@query("select p_partkey, p_size from part where p_partkey = 7")
def get_live(spark, d):
    rows = _files(spark, d)
    return W.get(rows, "p_partkey", 7).unionByName(W.get(rows, "p_partkey", 5)).select("p_partkey", "p_size")


@query("""select conv_id as chunk_id, turn as version, md5(text) as digest, null as reverted_from from conversations union all select c.conv_id, m.last + 1, md5(c.text), 0 from conversations c join (select conv_id, max(turn) as last from conversations group by 1) m using (conv_id) where c.turn = 0 and c.conv_id % 2 = 0""")
def version_revert(spark, d):
    """Every second conversation taken back to its first turn, as a new latest version."""
    versions = turns(spark, d).select(F.col("conv_id").alias("chunk_id"), F.col("turn").alias("version"), F.col("text").alias("content"))
    asked = versions.where("version = 0 and chunk_id % 2 = 0").unionByName(versions.where("version = 0").withColumn("version", F.lit(10**6).cast("long")))
    return W.with_revert(versions, asked).select("chunk_id", "version", F.md5(F.col("content").cast("binary")).alias("digest"), "reverted_from")


@query("""select conv_id as chunk_id, turn as version from conversations union all select conv_id, max(turn) + 1 from conversations where conv_id % 3 = 0 group by 1 union all select -5, 1""")
def version_added(spark, d):
    versions = turns(spark, d).select(F.col("conv_id").alias("chunk_id"), F.col("turn").alias("version"), F.col("text").alias("content"))
    news = versions.where("version = 0 and chunk_id % 3 = 0").select("chunk_id", "content").unionByName(spark.sql("select cast(-5 as bigint) as chunk_id, 'x' as content"))
    return W.with_version(versions, news).select("chunk_id", "version")


@query("""with n as (select p_partkey + 1000000 as id, p_name as name, p_type as kind, p_brand as kb from part where p_partkey % 2 = 1), f as (select * from n qualify row_number() over (partition by kb, name, kind order by id) = 1), o as (select p_partkey as id, p_name as name, p_type as kind, p_brand as kb from part where p_partkey % 2 = 0)
select * from f union all select * from o where not exists (select 1 from f where f.name = o.name and f.kind = o.kind and f.kb = o.kb)""")
def entities_upserted(spark, d):
    """Entities unique by base, name and kind."""
    one = part(spark, d).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("kb"))
    return W.vertices_upserted(one.where("id % 2 = 0"), one.where("id % 2 = 1").withColumn("id", F.col("id") + 1000000), "kb", "name", "kind").select("id", "name", "kind", "kb")


@query("""select l_orderkey as src, l_partkey as dst, l_returnflag as kind, coalesce(case when l_linenumber % 2 = 0 then l_discount end, 0.5) as weight, 0.8 as confidence from lineitem where l_returnflag <> 'N'""")
def relations_added(spark, d):
    rows = lineitem(spark, d).select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("kind"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")).alias("weight"), F.lit(None).cast("double").alias("confidence"))
    return W.edges_added(rows.where("false"), rows)


@query("""select 'vertex' as kind, s_suppkey as id, count(*) as n from supplier where s_suppkey % 7 = 0 group by 2 union all select 'edge', l_suppkey, count(*) from lineitem where l_suppkey % 7 <> 0 and l_partkey % 7 <> 0 group by 2""")
def entities_deleted(spark, d):
    """Vertices marked, and the edges left; ends of both kinds are numbered alike here."""
    gone = supplier(spark, d).where("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("id")).unionByName(part(spark, d).where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("id"))).distinct()
    vertices = supplier(spark, d).select(F.col("s_suppkey").alias("id"), F.lit(False).alias("is_deleted"))
    marked, left = W.entities_deleted(vertices, lineitem(spark, d).select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")), gone)
    return marked.where("is_deleted").select(F.lit("vertex").alias("kind"), "id", F.lit(1).cast("long").alias("n")).unionByName(left.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "id", "n"))


@query("select o_orderkey as id, o_custkey % 5 = 0 or o_custkey % 5 = 1 as orphan from orders")
def orphan_cleanup(spark, d):
    """Vertices whose entity is null, 0 or unknown go."""
    entity = F.when(F.col("o_custkey") % 5 == 0, F.lit(None)).when(F.col("o_custkey") % 5 == 1, 0).otherwise(F.col("o_custkey"))
    vertices = orders(spark, d).select(F.col("o_orderkey").alias("id"), entity.cast("long").alias("entity_id"))
    kept, orphans = W.without_orphans(vertices, customer(spark, d).select(F.col("c_custkey").alias("id")).unionByName(spark.sql("select cast(0 as bigint) as id")))
    return kept.select("id", F.lit(False).alias("orphan")).unionByName(orphans.withColumn("orphan", F.lit(True)))


@query("""with a as (select substr(trim('  ' || event_type || ' '), 1, 5) as keyword, ts from events where user_id > 2), c as (select 'click' as keyword, 1000 as n, timestamp '2023-01-01' as last_at)
select keyword, cast(sum(n) as bigint) as n, max(last_at) as last_at from (select keyword, count(*) as n, max(ts) as last_at from a group by 1 union all from c) group by 1""")
def hotwords_updated(spark, d):
    asked = events(spark, d).select(F.when(F.col("user_id") > 2, F.concat(F.lit("  "), "event_type", F.lit(" "))).otherwise("  ").alias("keyword"), F.col("ts").alias("at"))
    counts = spark.sql("select 'click' as keyword, 1000L as n, timestamp_ntz'2023-01-01 00:00:00' as last_at")
    return W.counted_words(counts, asked, 5)


_STATE = "case when o_custkey % 6 = 0 then 'new' when o_custkey % 6 = 1 then 'done' when o_custkey % 6 = 2 then 'failed' when o_orderkey % 2 = 0 then 'done' when o_custkey % 6 = 3 then 'failed' else 'new' end"


@query(f"""select o_custkey as batch_id, count(*) as total, count(*) filter (s = 'done') as success, count(*) filter (s = 'failed') as failed, round(count(*) filter (s <> 'new') * 100.0 / count(*), 2) as progress,
case when count(*) filter (s <> 'new') = 0 then 'pending' when count(*) filter (s = 'new') > 0 then 'processing' when count(*) filter (s = 'failed') = 0 then 'completed' when count(*) filter (s = 'done') = 0 then 'failed' else 'partial' end as status, string_agg(o_orderkey, ',' order by o_orderkey) as files
from (select *, {_STATE} as s from orders) group by 1""")
def batch_rollup(spark, d):
    c, o = F.col("o_custkey") % 6, F.col("o_orderkey") % 2
    state = F.when(c == 0, "new").when(c == 1, "done").when(c == 2, "failed").when(o == 0, "done").when(c == 3, "failed").otherwise("new")
    out = W.batch_status(orders(spark, d).select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("file_id"), state.alias("state")), "batch_id")
    return out.withColumn("files", F.array_join(F.transform("files.file_id", lambda x: x.cast("string")), ","))


@query("""select p_partkey, cast(ceil(p_partkey / least(greatest(coalesce(s, 20), 1), 100)) as bigint) as pages, p < ceil(p_partkey / least(greatest(coalesce(s, 20), 1), 100)) as has_next, p > 1 as has_prev from (select p_partkey, greatest(p_size - 5, 1) as p, case when p_size % 3 > 0 then p_size * 4 - 10 end as s from part)""")
def page_math(spark, d):
    size = F.when(F.col("p_size") % 3 > 0, F.col("p_size") * 4 - 10)
    return part(spark, d).select("p_partkey", *W.page_info(F.col("p_partkey"), F.col("p_size") - 5, size))


@query("""select 'f' || p_partkey as path, case p_partkey % 4 when 0 then 'added' when 1 then 'removed' when 2 then 'modified' end as change from part where p_partkey % 4 <> 3""")
def snapshot_changes(spark, d):
    """Files added, removed and modified between two snapshots, by their hashes."""
    p, k = part(spark, d), F.col("p_partkey") % 4
    path = F.concat(F.lit("f"), "p_partkey").alias("path")
    new = F.sha2(F.concat("p_name", F.when(k == 2, "!").otherwise("")).cast("binary"), 256)
    return W.changed_files(p.where(k != 0).select(path, F.sha2(F.col("p_name").cast("binary"), 256).alias("hash")), p.where(k != 1).select(path, new.alias("hash")))


def _bases(spark, d):
    return nation(spark, d).select(F.col("n_nationkey").alias("kb_id"), F.col("n_name").alias("name"))


@query("""with k as (select o_custkey, string_agg('{"chunk_index":' || o_orderkey || ',"content":"' || o_orderstatus || '"}', ',' order by o_orderkey) as c from orders group by 1),
x as (select c_nationkey, count(*) as n, string_agg('{"doc_id":' || c_custkey || ',"title":"' || c_name || '","chunks":[' || coalesce(c, '') || ']}', ',' order by c_custkey) as docs from customer left join k on o_custkey = c_custkey group by 1)
select n_nationkey as kb_id, '{"kb_id":' || n_nationkey || ',"name":"' || n_name || '","document_count":' || n || ',"documents":[' || docs || ']}' as json from nation join x on c_nationkey = n_nationkey""")
def export_kb_json(spark, d):
    """Knowledge bases with their documents and chunks, as nested JSON."""
    documents = customer(spark, d).select(F.col("c_nationkey").alias("kb_id"), F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title"))
    chunks = orders(spark, d).select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("int").alias("chunk_index"), F.col("o_orderstatus").alias("content"))
    return W.kb_json(_bases(spark, d), documents, chunks)


@query("""select n_nationkey as kb_id, '# ' || n_name || chr(10) || chr(10) || 'Documents: ' || count(*) || chr(10) || chr(10) || string_agg('## ' || c_name || chr(10) || chr(10) || '- ID: ' || c_custkey || chr(10) || '- Size: ' || case when c_custkey < 1024 then c_custkey || ' B' else printf('%.2f', c_custkey / 1024.0) || ' KB' end || chr(10), chr(10) order by c_custkey) as markdown from nation join customer on c_nationkey = n_nationkey group by n_nationkey, n_name""")
def export_kb_markdown(spark, d):
    documents = customer(spark, d).select(F.col("c_nationkey").alias("kb_id"), F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title"), file_size(F.col("c_custkey")).alias("size"))
    return W.kb_markdown(_bases(spark, d), documents)


@query("""select conv_id as doc_id, md5('# c' || conv_id || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) order by turn)) as digest from conversations group by 1""")
def export_doc_markdown(spark, d):
    t = turns(spark, d)
    documents = t.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("c"), "conv_id").alias("title")).distinct()
    out = W.document_markdown(documents, t.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content")))
    return out.select("doc_id", F.md5(F.col("markdown").cast("binary")).alias("digest"))


@query("""select user_id, '[' || string_agg('{"event_id":' || event_id || ',"kind":' || case when event_type = 'click' then 'null' else '"' || event_type || '"' end || '}', ',' order by event_id) || ']' as json from events group by 1""")
def export_qa_json(spark, d):
    """Rows of each user as one JSON array, nulls kept."""
    rows = events(spark, d).select("user_id", "event_id", F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind"))
    one = rows.select("event_id", "kind", "user_id")
    out = one.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "kind"))).alias("r"))
    return out.select("user_id", F.to_json("r", {"ignoreNullFields": "false"}).alias("json"))


@query("""with t as (select doc_id, unnest([source, lang]) as tag from documents), u as (select tag, count(distinct doc_id) as n from t group by 1)
select tag, n as usage_count, case tag when 'API' then 'system' else 'user' end as kind, '#909399' as colour from u order by n desc, tag limit 5 offset 2""")
def tag_page(spark, d):
    """Tags of all documents with their use, kind and colour: the second page of an ordered list."""
    from marlstone.functions import classify as C

    tags = docs(spark, d).select("doc_id", F.explode(F.array("source", "lang")).alias("tag")).where("tag is not null")
    used = tags.groupBy("tag").agg(F.countDistinct("doc_id").alias("usage_count"))
    out = used.select("tag", "usage_count", C.tag_kind(F.col("tag")).alias("kind"), C.tag_colour(F.col("tag")).alias("colour"))
    return out.orderBy(F.desc("usage_count"), "tag").offset(2).limit(5)


@query("""with t as (select doc_id, unnest(list_distinct([source, lang])) as tag from documents), n as (select tag, count(*) as n from t group by 1), r as (select d.doc_id, n.tag, n.n - coalesce(o.h, 0) as n from documents d, n left join (select doc_id, tag, 1 as h from t) o on o.doc_id = d.doc_id and o.tag = n.tag where o.h is null),
k as (select *, row_number() over (partition by doc_id order by n desc, tag) as k from r) select doc_id, string_agg(tag, ',' order by k) as tags from k where k <= 5 group by 1""")
def tag_suggest(spark, d):
    """The five most used tags that a document has not."""
    from marlstone.operators import relational

    tags = docs(spark, d).select("doc_id", F.explode(F.array_distinct(F.array("source", "lang"))).alias("tag")).where("tag is not null")
    return relational.suggested(tags, "doc_id", "tag", 5).select("doc_id", F.array_join("tags", ",").alias("tags"))
