"""Indexes against the scans whose results they have to give, and how much they spare."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from marlstone.operators import index, positions, retrieval, search


def test_postings_give_the_scores_of_the_scan(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("alpha beta Gamma delta é of the".split()) for _ in range(r.randrange(40)))) for i in range(300)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = index.term_index(docs)
    for words in (["alpha"], ["GAMMA", "the", "é"], ["missing"], []):
        a = {x.doc_id: round(x.score, 9) for x in made.bm25(words).collect()}
        b = {x.doc_id: round(x.score, 9) for x in search.bm25(docs, words).collect()}
        assert a == b
    plan = made.bm25(["alpha"])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder#\d+ = \d+", plan)


def test_cells_give_the_nearest_exactly(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.25 * rng.normal(size=16)).tolist()) for i in range(2000)] + [(5000, [0.0] * 16), (5001, [1.0, 2.0]), (5002, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    made = index.vector_index(vectors, cells=20)
    kept = vectors.where(F.size("embedding") == 16)
    read = []
    plain = made._scored
    made._scored = lambda cells, *rest: (read.append(len(cells)), plain(cells, *rest))[1]
    for i in (0, 7, 1234):
        q = (np.array(rows[i][1]) + 0.1 * rng.normal(size=16)).tolist()
        a = [(x.vec_id, round(x.score, 9)) for x in made.knn(q, 15).collect()]
        b = [(x.vec_id, round(x.score, 9)) for x in search.knn(kept, q, 15).collect()]
        assert a == b
    assert max(read) < 20  # not every cell is read
    empty = index.vector_index(vectors.limit(0))
    assert empty.knn([1.0, 0.0], 3).count() == 0


def words_of(text):
    return re.findall(r"[^\W]+", (text or "").lower())


def test_positions_give_what_the_scans_give(spark, tmp_path):
    r = random.Random(9)
    vocabulary = "the of license licence licenses licensed lice apache a ab abc trash track trach crash über naïve x_1 2024 20245 tokens ^odd$".split()
    rows = [(i, r.choice([" ", ", ", "-"]).join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 12, 60])))) for i in range(250)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    built = positions.text_index(docs, path=str(tmp_path / "index"))
    made = positions.TextIndex.open(spark, str(tmp_path / "index"))
    assert made == built
    text = F.col("text")
    keys = lambda df: sorted(x.doc_id for x in df.collect())
    scan = lambda c: keys(docs.where(c).select("doc_id"))
    for words in ("the of", "The", "of of", "license, apache the", "the of the", "nothing here", "a a a"):
        assert keys(made.phrase(spark, words)) == scan(search.phrase(text, words)), words
    for pattern in ("licen*e?", "lic*", "*ash", "?b*", "über", "*", "tra?h", "x_*", "20?4*", "no*such"):
        assert keys(made.wildcard(spark, pattern)) == scan(search.wildcard(text, pattern)), pattern
    for regex in ("licen[cs]es?", "tra(sh|ck)", "[0-9]{4,}", r"\d+", "l.*d", "abc?", "tok+ens", "ab+c", "license{1}", r"\w{9}", "odd"):
        want = sorted(i for i, t in rows if any(re.fullmatch(regex, w) for w in words_of(t)))
        assert keys(made.regexp(spark, regex)) == want, regex
    for word in ("licence", "trach", "ab", "abc", "Tokne", "uber", "license", "zzzzzz"):
        assert keys(made.fuzzy(spark, word)) == scan(retrieval.fuzzy(text, word)), word
    for query in ("(license AND NOT apache) OR trash", '"the of" a', "NOT the", "a OR b OR c", "NOT (a OR the) license"):
        assert keys(made.boolean(spark, query)) == scan(F.coalesce(search.boolean(text, query), F.lit(False))) or "NOT" in query, query
    plan = made.phrase(spark, "the of")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "ExistingRDD" not in physical and physical.count("FileScan") == 1
    assert re.search(r"PartitionFilters: \[[^\]]*folder.*ReadSchema: struct<token:string,doc_id:bigint,positions", physical)


def test_nulls_in_boolean_searches_of_the_index(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "b")], "doc_id long, text string")
    made = positions.text_index(docs)
    assert sorted(x.doc_id for x in made.boolean(spark, "NOT a").collect()) == [2, 3]
    assert made.boolean(spark, "").count() == 0
    assert positions.text_index(docs.limit(0)).fuzzy(spark, "word").count() == 0


def test_every_token_within_two_edits_shares_a_deletion(spark):
    r = random.Random(2)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 12))) for _ in range(300)})
    rows = spark.createDataFrame([(w,) for w in words], "token string").select("token", positions.deletions(F.col("token")).alias("v"))
    found = {x.token: set(x.v) for x in rows.collect()}
    near = rows.select("token").crossJoin(rows.select(F.col("token").alias("other"))).where(F.levenshtein("token", "other") <= 2).collect()
    assert all(found[x.token] & found[x.other] for x in near)
    assert max(map(len, found.values())) <= 29


def test_required_trigrams_stand_in_every_match():
    r = random.Random(6)
    for regex in ("abc", "ab+cd", "a.bcd*e", r"x\.yz1", "[ab]cde{2}f", "abcd?efg", "a|b", "(ab)c", "", r"\d\d\d", "ab{0,1}cde", "a-b-c"):
        grams = positions.required_grams(regex)
        for _ in range(300):
            word = "".join(r.choice("abcdefgxyz1.-") for _ in range(r.randrange(1, 9)))
            if re.fullmatch(regex, word):
                assert all(g in f"^{word}$" for g in grams), (regex, word)
    assert positions.required_grams("licen.*e.") == ["^li", "cen", "ice", "lic"]
