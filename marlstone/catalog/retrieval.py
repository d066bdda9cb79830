"""Searches as they are served, each as one query over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import classify as C
from marlstone.functions.text import match_share
from marlstone.operators import retrieval as R
from marlstone.operators import search as S
from marlstone.plans import rules
from marlstone.registry import TOKENS, docs, events, lineitem, nation, orders, part, query, turns, vectors

TERMS = ["of", "license", "version"]
QUESTION = "license of the work"
_COS = "list_cosine_similarity(e.embedding::double[], q.embedding::double[])"


def seed(spark, d):
    found = vectors(spark, d).where("vec_id = 0").first()
    return found and found.embedding


def named_vectors(spark, d):
    return vectors(spark, d).withColumnRenamed("vec_id", "doc_id")


def knn_sql(k: int, where: str = "true") -> str:
    return f"(select e.vec_id as doc_id, {_COS} as score from embeddings e, (select embedding from embeddings where vec_id = 0) q where {where} order by score desc, doc_id limit {k})"


def bm25_on(table: str, key: str, text: str, terms: list[str]) -> str:
    """DuckDB's BM25 over a text expression of a table."""
    terms = sorted(terms)
    n = range(len(terms))
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) as tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) filter (tf{i} > 0) as df{i}" for i in n)
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / a))" for i in n)
    hit = " or ".join(f"tf{i} > 0" for i in n)
    words = TOKENS.replace("(text)", f"({text})")
    return f"(with t as (select {key}, {words} as w from {table}), d as (select {key}, len(w) as dl, {tf} from t), s as (select count(*) as n, avg(dl) as a, {df} from d) select {key}, {score} as score from d, s where ({hit}))"


_BM = bm25_on("documents", "doc_id", "text", TERMS)
_SHARE = f"len(list_intersect(['license', 'of', 'the', 'work'], {TOKENS})) / 4.0"


def reranked(recall: str, k: int, least: float | None, fallback: bool = False) -> str:
    rows = f"(select doc_id, {_SHARE} as score, h.score as original_score from documents join {recall} h using (doc_id) where trim(text) <> '' order by score desc, doc_id limit {k})"
    bound = "" if least is None else f" where score >= {least}" + (f" or (select max(score) from r) < {least}" if fallback else "")
    return f"with r as {rows} select doc_id, round(score, 4) as score, round(original_score, 4) as original_score from r{bound}"


def shown(hits):
    return hits.select("doc_id", F.round("score", 4).alias("score"), F.round("original_score", 4).alias("original_score"))


@query(reranked(knn_sql(30), 10, 0.25))
def vector_search_served(spark, d):
    """Thirty nearest, reranked by the words they share with the question, ten best of .25 or more."""
    return shown(R.vector_search(docs(spark, d), named_vectors(spark, d), seed(spark, d), 10, R.lexical(QUESTION), 0.25))


@query(reranked(f"(select * from {_BM} b order by score desc, doc_id limit 60)", 20, 0.5))
def keyword_search_served(spark, d):
    return shown(R.keyword_search(docs(spark, d), TERMS, 20, R.lexical(QUESTION), 0.5))


_MERGED = f"(select coalesce(a.doc_id, b.doc_id) as doc_id, 0.3 * coalesce(a.score, 0) + 0.7 * coalesce(b.score, 0) as score from {knn_sql(30)} a full join (select * from {_BM} z order by score desc, doc_id limit 30) b on a.doc_id = b.doc_id order by score desc, doc_id limit 30)"


@query(reranked(_MERGED, 10, 0.5, True))
def mixed_search_served(spark, d):
    """Both recalls merged by weights, reranked, cut at .5."""
    return shown(R.mixed_search(docs(spark, d), named_vectors(spark, d), TERMS, seed(spark, d), 10, 0.3, R.lexical(QUESTION), 0.5))


@query(reranked(_MERGED, 10, 0.99, True))
def mixed_search_fallback(spark, d):
    """None reaches the bound, or some do: uncut in the first case."""
    return shown(R.search(docs(spark, d), named_vectors(spark, d), words=TERMS, vector=seed(spark, d), k=10, alpha=0.3, scorer=R.lexical(QUESTION), least=7.0))


_HAS = "contains(' ' || array_to_string(w, ' ') || ' ', ' {} ')"


@query(f"""with t as (select *, {TOKENS} as w from documents) select doc_id, n_chars from t where len(list_intersect(w, ['license', 'version'])) > 0 and ({_HAS.format('the')} or {_HAS.format('apache')}) and len(list_filter(w, lambda x: regexp_full_match(x, 'licen.*'))) > 0
and len(list_filter(w, lambda x: regexp_full_match(x, '[a-z]{{4}}'))) > 0 and n_chars >= 100 order by doc_id limit 1000""")
def advanced_search(spark, d):
    """Words, boolean, wildcard, pattern of a word and filters together."""
    found = R.search(docs(spark, d), named_vectors(spark, d), "advanced", k=5000, words="License version", boolean="the or apache", wildcard="licen*", regex="[a-z]{4}", filters={"n_chars": {"gte": 100}})
    return found.select("doc_id", "n_chars")


@query(f"select doc_id, n_chars from documents where contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' under the ') and lang = 'en' order by n_chars desc, doc_id limit 10")
def exact_search(spark, d):
    found = R.search(docs(spark, d), named_vectors(spark, d), "exact", words="under the", k=10, filters={"lang": "en"}, sort=F.desc("n_chars"))
    return found.select("doc_id", "n_chars")


@query(f"select doc_id, round(max(score), 4) as score from (select doc_id, 2 * score as score from {_BM} union all select doc_id, 3 * score from {bm25_on('documents', 'doc_id', 'source', ['src1', 'src2'])}) group by 1")
def multi_field_best_fields(spark, d):
    """The better of the boosted scores of two fields."""
    rows = docs(spark, d)
    by = R.fields_score(rows, TERMS, {"text": 2.0}).unionByName(R.fields_score(rows, ["src1", "src2"], {"source": 3.0}))
    return by.groupBy("doc_id").agg(F.round(F.max("score"), 4).alias("score"))


@query(f"select p_partkey, round(sum(score), 4) as score from (select * from {bm25_on('part', 'p_partkey', 'p_name', ['red', 'ring', 'promo'])} union all select p_partkey, 1.5 * score from {bm25_on('part', 'p_partkey', 'p_type', ['red', 'ring', 'promo'])} union all select p_partkey, score from {bm25_on('part', 'p_partkey', 'p_brand', ['red', 'ring', 'promo'])}) group by 1")
def image_keywords(spark, d):
    """Boosted scores of three fields added, one hit is enough."""
    return R.fields_score(part(spark, d), ["red", "ring", "promo"], {"p_name": 1.0, "p_type": 1.5, "p_brand": 1.0}, "p_partkey", "sum").withColumn("score", F.round("score", 4))


@query(f"select vec_id, round(score, 6) as score from (select e.vec_id, {_COS} as score from embeddings e, (select embedding from embeddings where vec_id = 3) q where vec_id <> 3 order by score desc, vec_id limit 50) where score >= 0.2")
def similar_search(spark, d):
    return R.similar(vectors(spark, d), 3, 50, 0.2).withColumn("score", F.round("score", 6))


@query(f"select w as term, count(*) as n from (select unnest({TOKENS}) as w from documents) where starts_with(w, 'th') group by 1 order by n desc, term limit 10")
def search_suggestions(spark, d):
    return R.suggestions(docs(spark, d), "Th")


@query(f"select doc_id from documents where len(list_filter({TOKENS}, lambda t: levenshtein(t, 'licence') <= 2)) > 0 or len(list_filter({TOKENS}, lambda t: levenshtein(t, 'trach') <= 1)) > 0")
def fuzzy_search(spark, d):
    t = F.col("text")
    return docs(spark, d).where(R.fuzzy(t, "licence") | R.fuzzy(t, "trach")).select("doc_id")


_SCOPES = f"(select 'documents' as scope, cast(doc_id as varchar) as id, text as content, score from documents join {_BM} b using (doc_id) union all select 'parts', cast(p_partkey as varchar), p_name, score from part join {bm25_on('part', 'p_partkey', 'p_name', ['red', 'ring'])} c using (p_partkey))"


@query(f"with u as (select * from {_SCOPES} s order by score desc, scope, id limit 60) select scope, id, round(len(list_intersect(['license', 'of', 'ring', 'the'], {TOKENS.replace('(text)', '(content)')})) / 4.0, 4) as score from u where trim(content) <> '' order by score desc, scope, id limit 20")
def unified_search(spark, d):
    """Documents and parts in one listing: sixty best by raw scores, reranked, twenty best."""
    a = S.bm25(docs(spark, d), TERMS, keep=("text",)).select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "score")
    b = S.bm25(part(spark, d), ["red", "ring"], "p_partkey", "p_name", keep=("p_name",)).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("content"), "score")
    return R.unified({"documents": a, "parts": b}, 20, R.lexical("license of the ring")).select("scope", "id", F.round("score", 4).alias("score"))


@query("with q as (select embedding from embeddings where vec_id = 0), a as (select 'even' as scope, vec_id as id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as score from embeddings e, q where vec_id % 2 = 0 order by score desc, id limit 10), b as (select 'odd', vec_id as id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as score from embeddings e, q where vec_id % 2 = 1 order by score desc, id limit 5) select scope, id, round(score, 6) as score from (from a union all from b)")
def vector_scopes(spark, d):
    v = vectors(spark, d).withColumnRenamed("vec_id", "id")
    return R.vector_scopes({"even": v.where("id % 2 = 0"), "odd": v.where("id % 2 = 1")}, seed(spark, d), 20).withColumn("score", F.round("score", 6))


_HISTORY = "(select event_id as id, user_id, event_type as kb_id, ts as created_at, value / 100.0 as quality, 'about ' || event_type as question, 'answer ' || user_id as answer from events)"


def qa(spark, d):
    return events(spark, d).select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("kb_id"), F.col("ts").alias("created_at"), (F.col("value") / 100.0).alias("quality"), F.concat(F.lit("about "), "event_type").alias("question"), F.concat(F.lit("answer "), "user_id").alias("answer"))


@query(f"select id, round(quality, 4) as quality from {_HISTORY} where kb_id = 'click' and created_at >= timestamp '2024-01-05 00:00:00' and created_at <= timestamp '2024-01-25 00:00:00' and quality between 0.1 and 0.6 order by quality desc, created_at desc, id limit 50")
def history_filters(spark, d):
    """Histories by knowledge base, time, quality and words within an edit, in order of quality."""
    rows = qa(spark, d)
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    kept = rows.where(R.history(rows, kb="click", start=at("2024-01-05 00:00:00"), end=at("2024-01-25 00:00:00"), quality=(0.1, 0.6), words="abuot clik"))
    return kept.orderBy(*R.history_order("quality"), "id").limit(50).select("id", F.round("quality", 4).alias("quality"))


@query(f"select doc_id, round(sum(score), 4) as score from (select * from {_BM} union all select doc_id, 1.5 * score from {knn_sql(10)}) group by 1")
def history_hybrid(spark, d):
    near = S.knn(named_vectors(spark, d), seed(spark, d), 10, key="doc_id")
    return R.hybrid_history(S.bm25(docs(spark, d), TERMS), near, "doc_id").withColumn("score", F.round("score", 4))


@query("with q as (select embedding from embeddings where vec_id = 0) select e.vec_id, round(greatest(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), list_cosine_similarity(list_reverse(e.embedding)::double[], q.embedding::double[])), 6) as score from embeddings e, q order by score desc, vec_id limit 20")
def question_answer_vectors(spark, d):
    """The better of the similarities of two vectors a row."""
    rows = vectors(spark, d).withColumn("answer", F.reverse("embedding"))
    return S.top(R.best_of_vectors(rows, seed(spark, d), ["embedding", "answer"], 20, "vec_id").withColumn("score", F.round("score", 6)), 20, key="vec_id")


_FILES = ["README.md", "src/main.py", "src/rings.go", "src/tool.py", ".git/README", "node_modules/a/index.js", "docs/notes.rst", "pkg/readme_first.txt"]


@query(f"""with f as (select 'p' || p_partkey || '/' || case p_partkey % 8 {' '.join(f"when {i} then '{f}'" for i, f in enumerate(_FILES))} end as path, p_partkey % 8 as k from part)
select path, case when k in (0, 7) then 1 when k = 1 then 2 when k = 2 then 3 else 4 end as tier from f where k not in (4, 5, 6) order by tier, path limit 700""")
def relevant_files(spark, d):
    """Files for a question in tiers: readmes, entry files, names with a keyword, other code."""
    path = F.concat(F.lit("p"), "p_partkey", F.lit("/"), F.element_at(F.array(*map(F.lit, _FILES)), (F.col("p_partkey") % 8 + 1).cast("int")))
    return R.relevant_files(part(spark, d).select(path.alias("path")), ["Ring"], 700, C.code_language(F.col("path")))


@query(f"""with h as (select doc_id, text, s.score as similarity, len(list_intersect(['license', 'of', 'the', 'work'], {TOKENS})) / 4.0 as match, (least(length(text) / 500.0, 1.0) + least((length(text) - length(replace(text, '.', ''))) / 3.0, 1.0)) / 2 as complete,
0.0 as accuracy from documents join {knn_sql(200)} s using (doc_id)), e as (select avg(similarity) as a, avg(match) as m, avg(complete) as c, avg(accuracy) as x, count(*) filter (similarity > 0.7) as high_quality, count(*) as total from h),
r as (select *, 0.4 * a + 0.3 * m + 0.2 * c + 0.1 * x as s from e)
select round(s, 4) as score, case when s > 0.8 then 'high' when s > 0.5 then 'medium' when s > 0.3 then 'low' else 'none' end as level, case when s > 0.8 then 'knowledge_base_answer' when s > 0.5 then 'llm_answer' when s > 0.3 then 'hybrid_answer' else 'no_info_reply' end as strategy, round(least(s + 0.2, 1.0), 4) as confidence, high_quality, total from r""")
def answer_assessment(spark, d):
    """Two hundred hits: their four scores, relevance and what answer they allow."""
    hits = R.with_content(S.knn(named_vectors(spark, d), seed(spark, d), 200, key="doc_id"), docs(spark, d), "doc_id", "text")
    text = F.col("content")
    e = R.evaluate_hits(hits, F.col("score"), match_share(F.lit(QUESTION), text), C.completeness(text), C.accuracy(text))
    score, level = rules.relevance(*[F.col(f"avg_{c}") for c in ("similarity", "match", "completeness", "accuracy")])
    kind, sure = R.answer_strategy(level, score)
    return e.select(F.round(score, 4).alias("score"), level.alias("level"), kind.alias("strategy"), F.round(sure, 4).alias("confidence"), "high_quality", "total")


@query("select p_partkey, case when p_partkey % 3 = 0 then 0.1 when p_partkey % 3 = 1 then p_size / 10.0 else 0 end as score, round(least((p_partkey % 4) / 10.0, 1), 4) as accuracy from part")
def first_scores(spark, d):
    """The first score that counts, and accuracy by indicator words."""
    k = F.col("p_partkey")
    words = F.array_join(F.slice(F.array(*map(F.lit, ["可以", "例如", "包含"])), 1, (k % 4).cast("int")), " ")
    score = R.first_score(F.when(k % 3 == 0, 0.1), F.when(k % 3 == 1, 0.0), F.when(k % 3 == 1, F.col("p_size") / 10.0).otherwise(0.0))
    return part(spark, d).select("p_partkey", score.alias("score"), F.round(C.accuracy(words), 4).alias("accuracy"))


@query("""select p_partkey, case p_partkey % 3 when 0 then p_name || chr(10) || p_brand when 1 then p_brand else '' end as content, 'function ' || p_name || chr(10) || case when p_size > 25 then 'signature: ' || p_type || chr(10) else '' end || 'body' as symbol from part""")
def hit_texts(spark, d):
    """What a reranker reads by kinds of hits, and what of a symbol is embedded."""
    k = F.col("p_partkey") % 3
    kind = F.when(k == 0, "document").when(k == 1, "code").otherwise("other")
    content = R.rerank_content(kind, {"document": ["p_name", "p_brand"], "code": ["p_brand"]})
    symbol = R.symbol_text(F.lit("function"), F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_type")), F.lit(""), F.lit("body"))
    return part(spark, d).select("p_partkey", content.alias("content"), symbol.alias("symbol"))


@query(f"""with t as (select conv_id, turn, {TOKENS} as w from conversations), b as (select conv_id, turn, list_transform(w, lambda x: ('0x' || substr(md5(x), 1, 4))::integer % 8) as b from t),
c as (select conv_id, turn, list_transform(generate_series(0, 7), lambda k: len(list_filter(b, lambda x: x = k))::double) as c from b), n as (select *, sqrt(list_sum(list_transform(c, lambda x: x * x))) as n from c)
select conv_id, turn, round(case when n > 0 then c[1] / n else 0 end, 6) as first, round(case when n > 0 then c[8] / n else 0 end, 6) as last from n""")
def embed_distinct(spark, d):
    """Vectors of hashed words, made once for equal texts."""
    rows = R.embed_once(turns(spark, d), "text", lambda c: R.hashed_embedding(c, 8))
    return rows.select("conv_id", "turn", F.round(F.element_at("vector", 1), 6).alias("first"), F.round(F.element_at("vector", -1), 6).alias("last"))


@query("select vec_id, round(case when vec_id % 3 = 0 then embedding[2]::double when vec_id % 3 = 1 then (0.5 * embedding[2]::double + 0.3 * embedding[3]::double) / 0.8 else (0.5 * embedding[2]::double + 0.3 * embedding[3]::double + 0.2 * embedding[4]::double) / 1.0 end, 6) as second from embeddings")
def hybrid_embedding(spark, d):
    """Weighted means of the vectors there are."""
    v, k = F.col("embedding"), F.col("vec_id") % 3
    shifted = lambda n: F.slice(v, n + 1, 8)
    out = R.weighted_embedding([(F.slice(v, 1, 8), 0.5), (F.when(k > 0, shifted(1)), 0.3), (F.when(k == 2, shifted(2)), 0.2)], 8)
    return vectors(spark, d).select("vec_id", F.round(F.element_at(out, 2), 6).alias("second"))


@query("""select conv_id, md5(string_agg(text, chr(10) || chr(10) order by turn desc)) as digest from conversations where trim(text) <> '' group by 1""")
def knowledge_context(spark, d):
    """Contents of each conversation in one context, the latest first."""
    out = R.context_text(turns(spark, d), [F.desc("turn")], ["conv_id"], "text")
    return out.select("conv_id", F.md5(F.col("context").cast("binary")).alias("digest"))


@query("select case when l_linenumber % 2 = 0 then 'document' else 'code' end as kind, l_orderkey as id, case when l_linenumber % 2 = 0 then l_returnflag else 'src/' || l_linestatus || ':' || l_linenumber end as source, repeat(l_returnflag, 200) as excerpt, round(l_discount, 4) as score from lineitem")
def citations(spark, d):
    kind = F.when(F.col("l_linenumber") % 2 == 0, "document").otherwise("code")
    rows = lineitem(spark, d).select(kind.alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("title"), F.expr("repeat(l_returnflag, 300)").alias("content"), F.col("l_discount").alias("score"), F.concat(F.lit("src/"), "l_linestatus").alias("path"), F.col("l_linenumber").alias("line"))
    return R.sources_of(rows)


@query("select n_nationkey, n_name, (select count(distinct o_orderkey) from customer join orders on o_custkey = c_custkey where c_nationkey = n_nationkey) as documents from nation where n_name like '%1%' order by n_nationkey desc limit 5 offset 5")
def entity_page(spark, d):
    """A page of entities, with how many documents each has; counted once, not for each entity."""
    from marlstone.operators import relational
    from marlstone.registry import customer

    counts = orders(spark, d).join(customer(spark, d).select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey").groupBy("n_nationkey").agg(F.count("*").alias("documents"))
    one = relational.page(nation(spark, d).where(F.col("n_name").contains("1")), [F.desc("n_nationkey")], 2, 5)
    return one.join(counts, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("documents", F.lit(0)).alias("documents"))
