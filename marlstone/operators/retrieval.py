"""Searches as they are served: recall, merging, reranking, thresholds, suggestions, scopes, histories."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import cosine, match_share, tokens
from marlstone.operators import search as S

# Recall is three times what is asked for, at most 1000 hits are given, scores above .99 ask for nothing.
RECALL, MOST_HITS, HIGHEST_BOUND = 3, 1000, 0.99

Scorer = Callable[[Column], Column]


def lexical(query: str) -> Scorer:
    """The share of the query's words that a content has: the scorer where no model is given."""
    return lambda content: match_share(F.lit(query), content)


def clamped(limit: int | None, default: int = 10, most: int | None = None) -> int:
    """A number of hits from 1 to ``most``, MOST_HITS if nothing else is said."""
    return min(max(limit if limit is not None else default, 1), MOST_HITS if most is None else most)


def rerank(hits: DataFrame, k: int = 5, scorer: Scorer | None = None, key: str = "doc_id", content: str = "content") -> DataFrame:
    """The k best hits (key, content, score): by the scorer, with ``original_score`` kept and empty contents dropped, or by score without one.

    A scorer is a column function, so a model is an Arrow UDF and is loaded once by a worker.
    """
    if scorer is None:
        return S.top(hits.withColumn("original_score", F.col("score")), k, key=key)
    rows = hits.where(F.trim(F.coalesce(content, F.lit(""))) != "")
    rows = rows.withColumn("original_score", F.col("score")).withColumn("score", scorer(F.col(content)).cast("double"))
    return S.top(rows, k, key=key)


def above(hits: DataFrame, least: float | None, fallback: bool = False) -> DataFrame:
    """Hits of a score of ``least`` (0 to .99) or more; with ``fallback`` all of them if none has it."""
    if least is None:
        return hits
    bound = min(max(least, 0.0), HIGHEST_BOUND)
    if not fallback:
        return hits.where(F.col("score") >= bound)
    best = hits.agg(F.max("score").alias("_best"))  # one row
    return hits.join(F.broadcast(best)).where((F.col("_best") < bound) | (F.col("score") >= bound)).drop("_best")


def with_content(hits: DataFrame, docs: DataFrame, key: str, text: str, few: bool = True) -> DataFrame:
    """Hits with their contents; up to MOST_HITS are broadcast."""
    return docs.select(key, F.col(text).alias("content")).join(F.broadcast(hits) if few else hits, key)


def vector_search(docs: DataFrame, vectors: DataFrame, vector: list[float] | None, k: int, scorer: Scorer | None = None, least: float | None = None, key: str = "doc_id", text: str = "text", most: int = MOST_HITS) -> DataFrame:
    """Nearest vectors, three times as many as asked for, reranked and cut at a score."""
    k = clamped(k, most=most)
    hits = S.knn(vectors, vector, min(RECALL * k, most), key=key)
    return above(rerank(with_content(hits, docs, key, text, most <= MOST_HITS), k, scorer, key), least)


def keyword_search(docs: DataFrame, words: list[str], k: int, scorer: Scorer | None = None, least: float | None = None, filters: dict | None = None, key: str = "doc_id", text: str = "text", most: int = MOST_HITS) -> DataFrame:
    """BM25 over all documents, filtered after scoring, three times as many as asked for, reranked and cut at a score."""
    k = clamped(k, most=most)
    hits = S.bm25(docs, words, key, text, keep=tuple(filters or ())).where(S.compile_filters(filters)).select(key, "score")
    return above(rerank(with_content(S.top(hits, min(RECALL * k, most), key=key), docs, key, text, most <= MOST_HITS), k, scorer, key), least)


def mixed_search(
    docs: DataFrame, vectors: DataFrame, words: list[str], vector: list[float] | None, k: int, alpha: float = 0.5, scorer: Scorer | None = None,
    least: float | None = None, key: str = "doc_id", text: str = "text", most: int = MOST_HITS,
) -> DataFrame:
    """Both recalls merged by raw weighted scores, reranked and cut at a score; if none reaches it, uncut."""
    k = clamped(k, most=most)
    recall = min(RECALL * k, most)
    merged = S.fuse(S.knn(vectors, vector, recall, key=key), S.top(S.bm25(docs, words, key, text), recall, key=key), key, alpha=alpha)
    return above(rerank(with_content(S.top(merged, recall, key=key), docs, key, text, most <= MOST_HITS), k, scorer, key), least, fallback=True)


def exact_search(docs: DataFrame, words: str, k: int | None = None, filters: dict | None = None, sort: Column | str | None = None, key: str = "doc_id", text: str = "text", most: int = MOST_HITS) -> DataFrame:
    """Documents with the phrase, in the order of ``sort`` and the key."""
    rows = docs.where(S.phrase(F.col(text), words) & S.compile_filters(filters))
    return rows.orderBy(*([sort] if sort is not None else []), key).limit(clamped(k, most=most))


def advanced(text: Column, words: str | None = None, boolean: str | None = None, phrase: str | None = None, wildcard: str | None = None, regex: str | None = None, filters: dict | None = None) -> Column:
    """The conjunction of what is given; at least one of the first five must be, or nothing matches."""
    parts = []
    if words:
        wanted = [w.lower() for w in words.split()]
        parts.append(F.arrays_overlap(tokens(text), F.array(*map(F.lit, wanted))))
    parts += [f(text, x) for f, x in ((S.boolean, boolean), (S.phrase, phrase), (S.wildcard, wildcard)) if x]
    if regex:
        parts.append(F.exists(tokens(text), lambda t: t.rlike(f"^(?:{regex})$")))
    if not parts:
        return F.lit(False)
    return reduce(lambda a, b: a & b, parts) & S.compile_filters(filters)


def search(docs: DataFrame, vectors: DataFrame, mode: str = "hybrid", **asked) -> DataFrame:
    """One entry for all kinds: vector, keyword, exact, advanced or hybrid (the default)."""
    if mode == "vector":
        return vector_search(docs, vectors, **asked)
    if mode == "keyword":
        return keyword_search(docs, **asked)
    if mode == "exact":
        return exact_search(docs, **asked)
    if mode == "advanced":
        k, key = clamped(asked.pop("k", None), most=asked.pop("most", MOST_HITS)), asked.pop("key", "doc_id")
        return docs.where(advanced(F.col(asked.pop("text", "text")), **asked)).orderBy(key).limit(k)
    if mode == "hybrid":
        return mixed_search(docs, vectors, **asked)
    raise ValueError(f"no search mode {mode}")


def fields_score(docs: DataFrame, words: list[str], boosts: dict[str, float], key: str = "doc_id", how: str = "best") -> DataFrame:
    """(key, score): the best or the sum of the boosted BM25 scores of several fields; each field has statistics of its own."""
    parts = [S.bm25(docs, words, key, f).select(key, (F.col("score") * boost).alias("score")) for f, boost in boosts.items()]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy(key).agg((F.max if how == "best" else F.sum)("score").alias("score"))


def similar(vectors: DataFrame, vec_id, k: int = 10, least: float = 0.7, key: str = "vec_id", most: int = MOST_HITS) -> DataFrame:
    """More like one: the nearest others of a similarity of ``least`` or more."""
    found = vectors.where(F.col(key) == vec_id).first()
    return S.knn(vectors, found and list(found.embedding), clamped(k, most=most), key=key, least=least, without=vec_id)


def suggestions(docs: DataFrame, prefix: str, k: int = 10, text: str = "text") -> DataFrame:
    """(term, n): the most frequent words that begin with the prefix; ties in order of the word."""
    words = docs.where(F.lower(text).contains(prefix.lower())).select(F.explode(F.filter(tokens(F.col(text)), lambda t: t.startswith(prefix.lower()))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def edits_allowed(word: str) -> int:
    """No edit up to two letters, one up to five, two above."""
    return 0 if len(word) < 3 else 1 if len(word) < 6 else 2


def fuzzy(text: Column, word: str) -> Column:
    """Whether a word is near, by the edits that its length allows."""
    edits, low = edits_allowed(word), word.lower()
    return F.exists(tokens(text), lambda t: F.levenshtein(t, F.lit(low), edits) >= 0 if edits else t == low)


def unified(scopes: dict[str, DataFrame], k: int, scorer: Scorer | None = None) -> DataFrame:
    """Hits (id, content, score) of several scopes: the best three times k of all, reranked; (scope, id, content, score)."""
    rows = reduce(DataFrame.unionByName, [d.select(F.lit(name).alias("scope"), F.col("id").cast("string").alias("id"), "content", "score") for name, d in scopes.items()])
    first = rows.orderBy(F.desc("score"), "scope", "id").limit(RECALL * k)
    if scorer is None:
        return first.orderBy(F.desc("score"), "scope", "id").limit(k)
    found = first.where(F.trim("content") != "").withColumn("score", scorer(F.col("content")).cast("double"))
    return found.orderBy(F.desc("score"), "scope", "id").limit(k)


def vector_scopes(scopes: dict[str, DataFrame], vector: list[float] | None, k: int) -> DataFrame:
    """Nearest of several scopes (id, embedding): half of k from the first, a quarter from each other, merged by score."""
    parts = []
    for n, (name, d) in enumerate(scopes.items()):
        budget = max(1, k // 2 if n == 0 else k // 4)
        parts.append(S.knn(d, vector, budget, key="id").select(F.lit(name).alias("scope"), "id", "score"))
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("score"), "scope", "id").limit(k)


def rerank_content(kind: Column, fields: dict[str, list[str]]) -> Column:
    """What a reranker reads of a hit: by its kind, fields joined by line ends, nulls left out."""
    out = F.lit("")
    for name, columns in fields.items():
        out = F.when(kind == name, F.concat_ws("\n", *columns)).otherwise(out)
    return out


def symbol_text(kind: Column, name: Column, signature: Column, doc: Column, body: Column, most: int = 2000) -> Column:
    """What of a symbol is turned into a vector; empty parts are left out."""
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    return F.substring(F.concat_ws("\n", part("", F.concat_ws(" ", kind, name)), part("signature: ", signature), part("doc: ", doc), body), 1, most)


def embed_once(rows: DataFrame, content: str, model: Scorer) -> DataFrame:
    """``rows`` with ``vector``: equal contents, by SHA-256, are embedded once."""
    hashed = rows.withColumn("_h", F.sha2(F.col(content).cast("binary"), 256))
    each = hashed.groupBy("_h").agg(F.first(content).alias("_c")).select("_h", model(F.col("_c")).alias("vector"))
    return hashed.join(each, "_h", "left").drop("_h")


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """A vector without a model: words counted in buckets of their MD5, scaled to length 1; zero for texts without words."""
    bucket = lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 4), 16, 10).cast("int") % dims
    buckets = F.transform(tokens(text), bucket)
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.size(F.filter(buckets, lambda b: b == k)).cast("double"))
    one = F.element_at(F.transform(F.array(counts), lambda c: F.struct(c.alias("c"), F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)).alias("n"))), 1)
    return F.element_at(F.transform(F.array(one), lambda s: F.transform(s["c"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(0.0))), 1)


def weighted_embedding(parts: list[tuple[Column, float]], dims: int) -> Column:
    """The weighted mean of the first ``dims`` numbers of the vectors there are; weights of missing ones are shared out."""
    total = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), w).otherwise(0.0) for v, w in parts])
    value = lambda i: reduce(lambda a, b: a + b, [F.coalesce(F.get(v, i).cast("double"), F.lit(0.0)) * w for v, w in parts])
    return F.when(total > 0, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: value(i) / total))


def first_score(*scores: Column) -> Column:
    """The first score that is neither null nor 0; else 0."""
    return F.coalesce(*[F.nullif(s.cast("double"), F.lit(0.0)) for s in scores], F.lit(0.0))


def history(rows: DataFrame, user=None, kb=None, start: Column | None = None, end: Column | None = None, quality: tuple[float, float] | None = None, words: str | None = None) -> Column:
    """Which rows of a history (user_id, kb_id, created_at, quality, question, answer) are asked for; what is not given doesn't count."""
    parts = [F.lit(True)]
    parts += [F.col("user_id") == user] if user is not None else []
    parts += [F.col("kb_id") == kb] if kb is not None else []
    parts += [F.col("created_at") >= start] if start is not None else []
    parts += [F.col("created_at") <= end] if end is not None else []
    parts += [F.col("quality").between(*quality)] if quality else []
    if words:
        parts.append(reduce(lambda a, b: a | b, [fuzzy(F.col(c), w) for c in ("question", "answer") for w in words.split()]))
    return reduce(lambda a, b: a & b, parts)


def history_order(method: str = "time") -> list:
    """Columns to order by: time (the default), quality or relevance."""
    return {"quality": [F.desc("quality"), F.desc("created_at")], "relevance": [F.desc("score"), F.desc("created_at")]}.get(method, [F.desc("created_at")])


def hybrid_history(keyword: DataFrame, nearest: DataFrame, key: str, boost: float = 1.5) -> DataFrame:
    """(key, score): keyword scores and boosted vector scores added, either of them enough."""
    both = keyword.select(key, "score").unionByName(nearest.select(key, (F.col("score") * boost).alias("score")))
    return both.groupBy(key).agg(F.sum("score").alias("score"))


def best_of_vectors(rows: DataFrame, query: list[float] | None, columns: list[str], k: int, key: str) -> DataFrame:
    """(key, score): the best cosine of several vector columns, k best rows."""
    if query is None:
        return rows.select(key, F.lit(0.0).alias("score")).where("false")
    q = F.array(*[F.lit(float(x)) for x in query])
    return S.top(rows.select(key, F.greatest(*[cosine(F.col(c), q) for c in columns]).alias("score")), k, key=key)


# Files that programs begin in.
ENTRY_FILES = "main.py app.py __init__.py index.js index.ts server.js app.js".split()


def relevant_files(files: DataFrame, keywords: list[str], most: int, language: Column) -> DataFrame:
    """(path, tier) of the files to read for a question: readmes, entry files, names with a keyword, any code; hidden folders are left out."""
    name = F.substring_index("path", "/", -1)
    named = reduce(lambda a, b: a | b, [F.lower(name).contains(k.lower()) for k in keywords], F.lit(False))
    tier = F.when(F.upper(name).contains("README"), 1).when(name.isin(ENTRY_FILES), 2).when(named & language.isNotNull(), 3).when(language.isNotNull(), 4)
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    hidden = F.exists(folders, lambda x: x.startswith(".") | x.isin("node_modules", "__pycache__"))
    rows = files.where(~hidden).withColumn("tier", tier).where("tier is not null")
    return rows.orderBy("tier", "path").limit(most).select("path", "tier")


def evaluate_hits(hits: DataFrame, similarity: Column, match: Column, completeness: Column, accuracy: Column) -> DataFrame:
    """One row: the means of four scores of the hits, how many are similar above .7, and all."""
    cols = {"similarity": similarity, "match": match, "completeness": completeness, "accuracy": accuracy}
    rows = hits.select(*[c.cast("double").alias(n) for n, c in cols.items()])
    means = [F.coalesce(F.avg(n), F.lit(0.0)).alias(f"avg_{n}") for n in cols]
    return rows.agg(*means, F.count_if(F.col("similarity") > 0.7).alias("high_quality"), F.count("*").alias("total"))


def answer_strategy(level: Column, score: Column) -> tuple[Column, Column]:
    """(strategy, confidence) by the relevance of what was found."""
    kind = F.when(level == "high", "knowledge_base_answer").when(level == "medium", "llm_answer").when(level == "low", "hybrid_answer").otherwise("no_info_reply")
    return kind, F.least(score + 0.2, F.lit(1.0))


def context_text(hits: DataFrame, order: list, group: list[str], content: str = "content", sep: str = "\n\n") -> DataFrame:
    """(group, context): contents of the hits of each group in order, null and empty ones left out."""
    w = Window.partitionBy(*group).orderBy(*order)
    rows = hits.where(F.trim(content) != "").withColumn("_n", F.row_number().over(w))
    out = rows.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_n", content))).alias("c"))
    return out.select(*group, F.array_join(F.col(f"c.{content}"), sep).alias("context"))


def sources_of(hits: DataFrame) -> DataFrame:
    """Hits (kind, id, title, content, score, path, line) as citations: what is cited depends on the kind, contents are cut at 200."""
    where = F.when(F.col("kind") == "document", F.col("title")).otherwise(F.concat_ws(":", "path", F.col("line").cast("string")))
    return hits.select("kind", "id", where.alias("source"), F.substring("content", 1, 200).alias("excerpt"), F.round("score", 4).alias("score"))


def within_documents(docs: DataFrame, words: str, key: str, order: str, text: str = "text", page: str | None = None, pages: list[int] | None = None, context: int = 200, most: int = 100) -> DataFrame:
    """(key, order, context) of the chunks of each document that hold the words, the first ``most``, with the text about the first hit."""
    low = F.lower(text)
    rows = docs.where(low.contains(words.lower()))
    if page is not None and pages is not None:
        rows = rows.where(F.col(page).isin(pages))
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    at = F.instr(low, words.lower())
    about = F.substring(text, F.greatest(at - context // 2, F.lit(1)), F.lit(context))
    return rows.withColumn("_n", n).where(F.col("_n") <= most).select(key, order, about.alias("context"))


def qa_page(records: DataFrame, session, number: int, size: int) -> DataFrame:
    """A page of the records (id, session, created_at, sources as JSON) of a session, the oldest first, sources parsed."""
    rows = records.where(F.col("session") == session).orderBy("created_at", "id").offset((max(number, 1) - 1) * size).limit(size)
    return rows.withColumn("sources", F.coalesce(F.from_json("sources", "array<struct<path:string,line:int>>"), F.array().cast("array<struct<path:string,line:int>>")))
