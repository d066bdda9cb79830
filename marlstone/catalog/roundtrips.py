"""What is written and read back, and served orders and similarities: rows of the tables through files of the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.catalog.retrieval import _HISTORY, qa
from marlstone.functions import classify as C
from marlstone.functions.text import cosine
from marlstone.operators import chunking as K
from marlstone.operators import retrieval as R
from marlstone.operators import store
from marlstone.plans.stash import Stash
from marlstone.registry import ORACLES, customer, docs, nation, orders, part, query, supplier, vectors
from marlstone.sources import files as S


@query("""select doc_id, cast(i as integer) as chunk_index, case when i = 1 then 'replaced' when i = 2 and doc_id % 7 = 0 then 'newer' else substr(text, cast(1 + i * 100 as bigint), 100) end as content, lang
from (select *, unnest([0, 1, 2]) as i from documents) where doc_id % 5 <> 0""")
def chunk_archive(spark, d):
    """Chunks in gzip archives by language: written, read, one of each document replaced, some upserted, documents deleted."""
    at = F.explode(F.array(*map(F.lit, range(3)))).alias("chunk_index")
    chunks = docs(spark, d).select("doc_id", "lang", "text", at)
    chunks = chunks.select("doc_id", "chunk_index", F.substr("text", 1 + F.col("chunk_index") * 100, F.lit(100)).alias("content"), "lang")
    path = f"{Stash(spark).root}/archive"
    S.write_chunks(chunks, path, "lang")
    rows = S.read_chunks(spark, path, "doc_id long, chunk_index int, content string, lang string")
    rows = S.replace_chunk(rows, 1, "replaced").withColumn("key", F.struct("doc_id", "chunk_index"))
    news = rows.where("doc_id % 7 = 0 and chunk_index = 2").withColumn("content", F.lit("newer"))
    gone = docs(spark, d).where("doc_id % 5 = 0").select("doc_id")
    return S.without(S.merged(rows, news, "key"), gone, "doc_id").select("doc_id", "chunk_index", "content", "lang")


@query("select s_nationkey as n, string_agg(s_name, chr(10) order by s_name) || chr(10) as text from supplier group by 1")
def texts_read_back(spark, d):
    """Whole text files, one for each nation."""
    path = f"{Stash(spark).root}/texts"
    rows = supplier(spark, d).select("s_nationkey", "s_name").repartition(1, "s_nationkey").sortWithinPartitions("s_nationkey", "s_name")  # a file a nation
    rows.write.partitionBy("s_nationkey").text(path)
    found = S.read_texts(spark, path)
    return found.select(F.regexp_extract("path", r"s_nationkey=(\d+)", 1).cast("long").alias("n"), "text")


@query("""select cast(c_custkey as varchar) as c_custkey, c_name || ', "' || c_mktsegment || '"' as label, case when c_custkey % 3 > 0 then cast(c_nationkey as varchar) end as nation from customer""")
def rows_exported(spark, d):
    """A delimited export with quotes, separators and empty cells, read as strings again."""
    label = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))
    path = f"{Stash(spark).root}/rows"
    store.write_csv(customer(spark, d).select("c_custkey", label.alias("label"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("nation")), path)
    return S.read_rows(spark, path)


@query("select o_orderkey as id, o_orderstatus as status, case when o_orderkey % 4 > 0 then o_custkey end as owner from orders")
def json_exported(spark, d):
    """JSON lines with their nulls, read back with a schema."""
    path = f"{Stash(spark).root}/lines"
    store.write_json(orders(spark, d).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey")).alias("owner")), path)
    return S.read_chunks(spark, path, "id long, status string, owner long")


_BAD = ["no harm", "<A onclick='JavaScript: alert(1)'>", "x' UNION SELECT 1;--", "os.system('ls')", "cmd.exe and EVAL(1)"]
_FOUND = ["", "javascript:", "union select,;--", "system(", "eval(,cmd.exe"]


@query("select p_partkey, list_extract([" + ", ".join(f"'{x}'" for x in _FOUND) + "], cast(p_size % 5 + 1 as integer)) as words from part")
def suspicious_contents(spark, d):
    """Words that contents of files may not hold, in any case."""
    text = F.concat("p_name", F.lit(" "), F.element_at(F.array(*map(F.lit, _BAD)), (F.col("p_size") % 5 + 1).cast("int")))
    return part(spark, d).select("p_partkey", F.array_join(C.suspicious_words(text), ",").alias("words"))


@query(" union all ".join(f"select '{m}' as method, id from (select id from {_HISTORY} where user_id < 20 order by {o}, id limit 25)" for m, o in (("quality", "quality desc, created_at desc"), ("relevance", "id % 13 desc, created_at desc"), ("time", "created_at desc"))))
def history_sorted(spark, d):
    """The first pages of histories in each of the orders that can be asked for."""
    rows = qa(spark, d).where("user_id < 20").withColumn("score", F.col("id") % 13)
    pages = [rows.orderBy(*R.history_order(m), "id").limit(25).select(F.lit(m).alias("method"), "id") for m in ("quality", "relevance", "time")]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@query(ORACLES["chunk_sentence"])
def chunk_overlapping(spark, d):
    """Windows whose overlap is a fifth of their size."""
    return K.overlapping(docs(spark, d), 1000, 0.2).select("doc_id", "chunk_index", "start_pos", "end_pos", F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query("select n_nationkey as id, case when n_nationkey % 3 = 0 then 'v2-' else 'v1-' end || n_name as version from nation union all select n_nationkey + 1000, 'v2-' || n_name from nation where n_nationkey % 3 = 0")
def sync_states_set(spark, d):
    """States of synchronisations: new ones replace those of the same scope, others are added."""
    rows = nation(spark, d).select(F.col("n_nationkey").alias("id"), F.concat(F.lit("v1-"), "n_name").alias("version"))
    third = nation(spark, d).where("n_nationkey % 3 = 0")
    news = third.select(F.explode(F.array(F.col("n_nationkey"), F.col("n_nationkey") + 1000)).alias("id"), F.concat(F.lit("v2-"), "n_name").alias("version"))
    return S.merged(rows, news, "id")


@query("with p as (select vec_id, embedding as a, lead(embedding) over (order by vec_id) as b from embeddings) select vec_id, round(list_cosine_similarity(a::double[], b::double[]), 6) as score from p where b is not null")
def vector_similarity(spark, d):
    """The cosine of each vector and the next one."""
    v = vectors(spark, d)
    n = v.agg(F.max("vec_id").alias("last"))  # ids follow each other
    rows = v.select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id").join(F.broadcast(n))
    return pairs.where("vec_id < last").select("vec_id", F.round(cosine(F.col("a"), F.col("b")), 6).alias("score"))
