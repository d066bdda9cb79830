"""Listings by permission, checks, previews and searches within documents, each as one query over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import consistency, relational
from marlstone.operators import retrieval as R
from marlstone.operators import store as W
from marlstone.registry import customer, docs, events, lineitem, nation, orders, part, query, region, supplier, turns, vectors
from marlstone.sources import tables as T

_ROLE = "case when exists (select 1 from customer where c_nationkey = n_nationkey and c_mktsegment = 'BUILDING') then (select coalesce(max(case when c_custkey % 7 = 0 then 'editor' when c_custkey % 7 = 1 then 'admin' end), 'viewer') from customer where c_nationkey = n_nationkey and c_mktsegment = 'BUILDING') when n_regionkey = 2 then 'owner' end"


@query(f"""select n_nationkey as kb_id, n_name as name, r_name as category, role, (select count(distinct s_suppkey) from supplier where s_nationkey = n_nationkey) as documents, (select count(distinct c_mktsegment) from customer where c_nationkey = n_nationkey) as members
from (select *, {_ROLE} as role from nation) left join region on r_regionkey = n_regionkey where role in ('admin', 'editor', 'owner')""")
def kb_listing_by_role(spark, d):
    """Bases of a user with category, role, documents and members, of some roles."""
    bases = nation(spark, d).select(F.col("n_nationkey").alias("kb_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("category_id"), F.when(F.col("n_regionkey") == 2, "BUILDING").otherwise("x").alias("owner"))
    k = F.col("c_custkey") % 7
    members = customer(spark, d).select(F.col("c_nationkey").alias("kb_id"), F.col("c_mktsegment").alias("user_id"), F.when(k == 0, "editor").when(k == 1, "admin").alias("role"))
    documents = supplier(spark, d).select(F.col("s_nationkey").alias("kb_id"), F.col("s_suppkey").alias("doc_id"))
    categories = region(spark, d).select(F.col("r_regionkey").alias("category_id"), F.col("r_name").alias("category"))
    return relational.bases_for(bases, categories, members, documents, "BUILDING", ["admin", "editor", "owner"])


@query("""select conv_id, turn, substr(text, cast(greatest(strpos(lower(text), 'the') - 100, 1) as bigint), 200) as context from (select *, row_number() over (partition by conv_id order by turn) as n from conversations where contains(lower(text), 'the') and turn % 4 in (0, 1, 2)) where n <= 3""")
def in_document_search(spark, d):
    """The first three turns of each conversation that hold a word, on some pages, with the text about it."""
    rows = turns(spark, d).withColumn("page", (F.col("turn") % 4).cast("int"))
    return R.within_documents(rows, "THE", "conv_id", "turn", page="page", pages=[0, 1, 2], most=3)


@query("select event_id as id, case when event_id % 2 = 0 then 'src/' || user_id || ':' || event_id else '' end as sources from events where event_type = 'click' order by ts, event_id limit 20 offset 20")
def qa_record_page(spark, d):
    """A page of the records of a session with their sources parsed; broken ones are empty."""
    js = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('[{"path":"src/'), "user_id", F.lit('","line":'), "event_id", F.lit("}]"))).otherwise("no json")
    records = events(spark, d).select(F.col("event_id").alias("id"), F.col("event_type").alias("session"), F.col("ts").alias("created_at"), js.alias("sources"))
    page = R.qa_page(records, "click", 2, 20)
    one = lambda s: F.concat(s["path"], F.lit(":"), s["line"].cast("string"))
    return page.select("id", F.array_join(F.transform("sources", one), ",").alias("sources"))


@query("select vec_id, case when vec_id % 5 <> 1 then cast(len(embedding) as integer) end as stored, case when vec_id % 5 <> 2 then case when vec_id % 5 = 3 then 8 else cast(len(embedding) as integer) end end as indexed from embeddings where vec_id % 5 in (1, 2, 3)")
def vector_consistency(spark, d):
    """Vectors whose dimensions differ between the store and the index, or that one of them lacks."""
    v = vectors(spark, d)
    k = F.col("vec_id") % 5
    index = v.where(k != 2).withColumn("embedding", F.when(k == 3, F.slice("embedding", 1, 8)).otherwise(F.col("embedding")))
    return consistency.vector_sizes(v.where(k != 1), index, "vec_id", "embedding")


@query("""select o_custkey as doc_id, bool_and(o_orderkey % 10 <> 3) as indexed, bool_and(o_orderkey % 7 <> 2) as vectors, bool_and(o_orderkey % 8 <> 5) as versions, bool_and(o_orderkey % 10 <> 3 and o_orderkey % 7 <> 2 and o_orderkey % 8 <> 5) as consistent from orders group by 1""")
def document_checks(spark, d):
    """Documents whose chunks are all indexed, have vectors of the right size and their latest version."""
    o = F.col("o_orderkey")
    chunks = orders(spark, d).select(F.col("o_custkey").alias("doc_id"), o.alias("chunk"), F.lit(2).alias("version"), F.lit(3).alias("dims"))
    rows = orders(spark, d).select(o.alias("chunk"), F.when(o % 7 == 2, F.array(F.lit(1.0))).otherwise(F.array(*map(F.lit, (1.0, 2.0, 3.0)))).alias("vector"), F.when(o % 8 == 5, 3).otherwise(2).alias("version"))
    versions = rows.select("chunk", "version").unionByName(rows.select("chunk", F.lit(1).alias("version")))
    return consistency.document_checks(chunks, rows.where("chunk % 10 <> 3"), rows, versions)


@query("""select event_id, '$' as path, 'object' as type, null as sample from events where event_id % 3 = 0 union all select event_id, '$.k', 'integer', cast(json_extract(props, '$.k') as varchar) from events where event_id % 3 = 0
union all select event_id, unnest(['/e', '/e@id', '/e/t']), unnest(['element', 'attribute', 'text']), unnest([null, cast(event_id as varchar), event_type]) from events where event_id % 3 = 1
union all select event_id, unnest(['a', 'b']), 'column', unnest([cast(user_id as varchar), event_type]) from events where event_id % 3 = 2 and event_id % 2 = 0 union all select event_id, '$', 'invalid', null from events where event_id % 3 = 2 and event_id % 2 = 1""")
def structure_previews(spark, d):
    """The structure of JSON, XML and CSV texts; broken ones are said to be so."""
    k, e = F.col("event_id") % 3, F.col("event_id").cast("string")
    xml = F.concat(F.lit('<e id="'), e, F.lit('"><t>'), "event_type", F.lit("</t><t>2</t></e>"))
    csv = F.concat(F.lit("a,b\n"), F.col("user_id").cast("string"), F.lit(","), "event_type", F.lit("\n"))
    broken = (k == 2) & (F.col("event_id") % 2 == 1)
    rows = events(spark, d).select("event_id", F.when(broken, "json").when(k == 0, "json").when(k == 1, "xml").otherwise("csv").alias("kind"), F.when(broken, "{no").when(k == 0, F.col("props")).when(k == 1, xml).otherwise(csv).alias("text"))
    return T.previews(rows, "event_id", "kind", "text").drop("place")


@query("""select o_orderkey as doc_id, '{"doc_id":' || o_orderkey || ',"title":"' || o_orderstatus || '"' || coalesce(',"chunks":[' || c || '],"images":[' || i || ']', '') || '}' as json
from orders left join (select l_orderkey, string_agg('{"chunk_index":' || l_linenumber || ',"content":"' || l_returnflag || '"}', ',' order by l_linenumber, l_returnflag) as c, string_agg(l_partkey, ',' order by l_partkey) as i from lineitem group by 1) on l_orderkey = o_orderkey""")
def export_doc_json(spark, d):
    documents = orders(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("title"))
    lines = lineitem(spark, d).withColumnRenamed("l_orderkey", "doc_id")
    return W.document_json(documents, lines.select("doc_id", F.col("l_linenumber").alias("chunk_index"), F.col("l_returnflag").alias("content")), lines.select("doc_id", F.col("l_partkey").alias("image")))


@query("select p_partkey from part where not (p_size > 10 and p_type = 'PROMO')")
def deleted_by_query(spark, d):
    """What a predicate leaves; where it is null nothing goes."""
    gone = (F.col("p_size") > 10) & F.when(F.col("p_type") == "PROMO", True)
    return W.deleted(part(spark, d), gone).select("p_partkey")


_AT = r"length(regexp_extract(text, '(?is)^(.*?)(?:license|token)', 1)) + 1"


@query(f"select doc_id, regexp_replace(substr(text, cast(greatest({_AT} - 75, 1) as bigint), 150), '(?i)(license|token)', '<mark>\\1</mark>', 'g') as fragment from documents where regexp_matches(text, '(?i)license|token')")
def search_highlight(spark, d):
    """A fragment about the first hit of two words, hits marked."""
    from marlstone.functions.text import highlight

    return docs(spark, d).select("doc_id", highlight(F.col("text"), ["license", "token"]).alias("fragment")).where("fragment is not null")
