"""Searches over indexes that are made of whole tables; their SQL is that of the scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.catalog.retrieval import TERMS, bm25_on, knn_sql, seed
from marlstone.operators import index as I
from marlstone.operators import positions as P
from marlstone.operators import quantised
from marlstone.operators import search as S
from marlstone.registry import TOKENS, docs, query, vectors


@query(f"select doc_id, round(score, 4) as score from {bm25_on('documents', 'doc_id', 'text', TERMS)} order by score desc, doc_id limit 100")
def kw_search_indexed(spark, d):
    """BM25 from postings, of which only the folders of the query's words are read."""
    made = I.term_index(docs(spark, d))
    return S.top(made.bm25(TERMS).withColumn("score", F.round("score", 4)), 100)


@query(f"select doc_id as vec_id, round(score, 6) as score from {knn_sql(25)}")
def knn_indexed(spark, d):
    """Exact nearest neighbours from the cells in which they can be."""
    made = I.vector_index(vectors(spark, d), cells=16)
    found = seed(spark, d)
    rows = made.knn(list(found), 25) if found else S.knn(vectors(spark, d), None, 25)
    return rows.withColumn("score", F.round("score", 6))


_INDEXES: dict[tuple[str, str], P.TextIndex] = {}


def text_index(spark, d) -> P.TextIndex:
    """The index of the documents of a folder, written when it is first asked for."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _INDEXES:
        _INDEXES[at] = P.text_index(docs(spark, d))
    return _INDEXES[at]


_HAS = "contains(' ' || array_to_string(w, ' ') || ' ', ' {} ')"
_SAID = f"with t as (select doc_id, {TOKENS} as w from documents)"


@query(f"{_SAID} select 'en' as wanted, doc_id from t where {_HAS.format('of the')} union all select 'license', doc_id from t where {_HAS.format('under the apache license version 2 0')}")
def phrase_indexed(spark, d):
    """Phrases from positions: one of frequent words, one long."""
    made = text_index(spark, d)
    found = [made.phrase(spark, words).select(F.lit(name).alias("wanted"), "doc_id") for name, words in (("en", "of the"), ("license", "under the Apache License, Version 2.0"))]
    return found[0].unionByName(found[1])


@query("select pattern, doc_id from (" + " union all ".join(f"select '{p}' as pattern, doc_id from documents where len(list_filter({TOKENS}, lambda x: regexp_full_match(x, '{r}'))) > 0" for p, r in (("licen*e?", "licen.*e."), ("*tion", ".*tion"), ("?a*", ".a.*"))) + ")")
def wildcard_indexed(spark, d):
    """Patterns by the trigrams of the vocabulary; the last has none and looks at all words, but at no text."""
    made = text_index(spark, d)
    found = [made.wildcard(spark, p).select(F.lit(p).alias("pattern"), "doc_id") for p in ("licen*e?", "*tion", "?a*")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"select doc_id from documents where len(list_filter({TOKENS}, lambda x: regexp_full_match(x, '[0-9]{{4,}}') or regexp_full_match(x, 'pass[a-z]+d'))) > 0")
def regexp_indexed(spark, d):
    """Regular expressions on whole words."""
    made = text_index(spark, d)
    return made.regexp(spark, "[0-9]{4,}").unionByName(made.regexp(spark, "pass[a-z]+d")).distinct()


@query(f"select word, doc_id from (" + " union all ".join(f"select '{w}' as word, doc_id from documents where len(list_filter({TOKENS}, lambda t: levenshtein(t, '{w}') <= {n})) > 0" for w, n in (("licence", 2), ("trach", 1), ("as", 0))) + ")")
def fuzzy_indexed(spark, d):
    """Words within some edits by the pieces of the vocabulary's words."""
    made = text_index(spark, d)
    found = [made.fuzzy(spark, w).select(F.lit(w).alias("word"), "doc_id") for w in ("licence", "trach", "as")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"select token, levenshtein(token, 'version') as distance from (select distinct unnest({TOKENS}) as token from documents) where levenshtein(token, 'version') <= 2")
def words_near(spark, d):
    return text_index(spark, d).near_tokens(spark, "Version")


@query(f"{_SAID} select doc_id from t where ({_HAS.format('license')} and not {_HAS.format('apache')}) or ({_HAS.format('trash')} and {_HAS.format('of the')})")
def bool_indexed(spark, d):
    """Words, phrases, AND, OR, NOT and parentheses as joins of keys."""
    return text_index(spark, d).boolean(spark, '(license AND NOT apache) OR trash "of the"')


@query()
def knn_quantised(spark, d):
    """Ten neighbours of every vector whose id is divisible by 100, from quantised codes; tests hold the recall against brute force."""
    v = vectors(spark, d)
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding")
    return quantised.quantised_index(v).knn(asked, 10).select("query", "vec_id", F.round("score", 6).alias("score"), "rank")
