"""Findings of the third report: what is done once, in bounded memory or without the driver."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import code, index, lexer, positions


def test_repeated_lines_and_heads_are_read_once():
    """lines and heads of blocks that come again take no new reading, and give what single tokens give."""
    lexer._line.cache_clear(), lexer._remembered.cache_clear()
    text = "class A {\n  int f(int a) {\n" + "    if (a > 1) { call(a); }\n" * 500 + '    String s = "}"; /* {\n */ return a;\n  }\n}\n'
    found = lexer.read(text, "java")
    assert lexer._line.cache_info().misses < 10 and lexer._remembered.cache_info().misses < 5
    assert [(s[0], s[2], s[3], s[4], s[7]) for s in found.symbols] == [("class", "A", 1, 506, 1), ("method", "A.f", 2, 505, 501)]
    assert found.calls == [("A.f", "call", n) for n in range(3, 503)]
    words, _ = lexer.tokens("a b\nx = y`}` + /[{]/;\n  #if {\nz()", "javascript")
    assert [(w.text, w.line) for w in words if w.name] == [("a", 1), ("b", 1), ("x", 2), ("y", 2), ("if", 3), ("z", 4)]


def test_fields_without_nodes_are_not_looked_at():
    """only fields that can hold nodes with children are walked."""
    import ast

    assert code._FIELDS[ast.Attribute] == ("value",) and code._FIELDS[ast.AugAssign] == ("target", "value")
    text = "def f(a, b=g(1)):\n    match a:\n        case {'x': [y, *z], **r} if h(y): return [i for i in k(r) if i and a or b]\n    x: T = lambda q: m(q)\n"
    assert code.python_symbols(text)[0][7] == 5
    assert [c[1] for c in code.python_calls(text)] == ["g", "h", "k", "m"]


def shuffled(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_top_terms_are_counted_within_the_row(spark):
    """F32: no term is shuffled; keys of several rows, null keys and rows without terms as before."""
    r = random.Random(5)
    rows = [(i, [r.choice("a b c d e \u00e9 zz".split()) for _ in range(r.randrange(30))]) for i in range(80)] + [(500, None), (501, []), (None, ["a"])]
    for extra in ([], [(3, ["zz"] * 9), (3, ["q"]), (None, ["b"])]):
        docs = spark.createDataFrame(rows + extra, "k long, w array<string>")
        out = T.top_terms(docs, "k", F.col("w"), 3, 2)
        want = T._top_of_keys(docs, "k", F.col("w"), 3, 2)
        assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
        assert extra or not shuffled(out)


def test_postings_are_shuffled_once(spark):
    """words are counted, and their positions put together, before the one shuffle."""
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, "A"), (4, "")], "doc_id long, text string")
    got = docs.select("doc_id", T.grouped_terms(T.tokens(F.col("text"))).alias("g")).collect()
    assert [(x.doc_id, [(g.term, g.places) for g in x.g]) for x in got] == [(1, [("a", [1]), ("b", [0, 2])]), (2, []), (3, [("a", [0])]), (4, [])]
    assert index.term_index(docs).bm25(["a"]).count() == 2


def test_tokens_within_the_edits_share_a_piece(spark, tmp_path):
    """three rows a token instead of 29; trigrams and pieces are written when they are asked for."""
    r = random.Random(3)
    words = sorted({"".join(r.choice("ab\u00e9") for _ in range(r.randrange(1, 11))) for _ in range(500)})
    rows = spark.createDataFrame([(w,) for w in words], "token string").select("token", positions.pieces(F.col("token")).alias("p")).collect()
    assert all(len(x.p) == 3 for x in rows)
    near = spark.createDataFrame([(a, b) for a in words[::7] for b in words], "a string, b string").select("a", "b", F.levenshtein("a", "b").alias("n")).collect()
    held = {x.token: set(x.p) for x in rows}
    for allowed in (0, 1, 2):
        asked = {w: set(positions.probes(w, allowed)) for w in words[::7]}
        assert all(asked[x.a] & held[x.b] for x in near if x.n <= allowed)
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    made = positions.text_index(docs, path=str(tmp_path / "index"))
    made.phrase(spark, words[0]).collect()
    assert not (tmp_path / "index" / "pieces").exists() and not (tmp_path / "index" / "grams").exists()
    for word in words[::50]:
        got = {x.token: x.distance for x in made.near_tokens(spark, word).collect()}
        assert got == {x.b: x.n for x in spark.createDataFrame([(w,) for w in words], "b string").select("b", F.levenshtein("b", F.lit(word)).alias("n")).collect() if x.n <= (0 if len(word) < 3 else 1 if len(word) < 6 else 2)}
    assert (tmp_path / "index" / "pieces").exists() and not (tmp_path / "index" / "grams").exists()


def test_levels_and_totals_send_no_nodes_through_the_driver(spark):
    """joins of nodes with nodes are no broadcasts, however small their files are."""
    from marlstone.operators import graph

    tree = spark.createDataFrame([(i, i - 1 if i else None) for i in range(300)] + [(1000, 1001), (1001, 1000)], "id long, parent_id long")
    out = graph.tree_levels(tree)
    assert {x.id: x.level for x in out.where("id < 1000").collect()} == {i: i + 1 for i in range(300)}
    made = []
    put = graph.Stash.put
    try:
        graph.Stash.put = lambda self, df: (made.append(df._jdf.queryExecution().executedPlan().toString()), put(self, df))[1]
        graph.tree_levels(tree.where("id < 1000"))
        graph.subtree_totals(tree.where("id < 1000"), tree.select("id", F.lit(1).alias("n")))
    finally:
        graph.Stash.put = put
    assert len(made) > 10 and not any("BroadcastHashJoin" in p for p in made)


def test_cycles_write_only_what_is_read_again(spark):
    """three written tables of edges and ranks, no paths for cycles of three edges; longer ones against brute force."""
    from itertools import permutations

    from marlstone.operators import graph

    r = random.Random(8)
    edges = {(r.randrange(9), r.randrange(9)) for _ in range(34)}
    made = []
    put = graph.Stash.put
    try:
        graph.Stash.put = lambda self, df: (made.append(df.columns), put(self, df))[1]
        for hops in (2, 3, 4):
            made.clear()
            out = graph.cycles(spark.createDataFrame(sorted(edges), "src long, dst long"), hops).collect()
            want = {p for n in range(2, hops + 1) for p in permutations(range(9), n) if p[0] == min(p) and all((a, b) in edges for a, b in zip(p, p[1:] + p[:1]))}
            assert sorted(tuple(x.path) for x in out) == sorted(want) and all(x.length == len(x.path) for x in out)
            assert len(made) == (2 if hops < 4 else 3)
    finally:
        graph.Stash.put = put


def test_chunks_are_cut_from_slices_of_a_batch(spark):
    """a worker makes strings of a small slice of a batch only."""
    import pyarrow as pa

    from marlstone.operators import chunking

    batch = pa.RecordBatch.from_pydict({"k": list(range(900)), "t": ["x" * 10_000] * 900})
    cut = list(chunking._few(batch))
    assert sum(b.num_rows for b in cut) == 900 and max(b.num_rows for b in cut) <= 110
    rows = [(1, "ab. " * 3000), (None, "z" * 25), (3, None), (4, "")] + [(i, "q." * i) for i in range(5, 60)]
    docs = spark.createDataFrame(rows, "k int, t string").repartition(2)
    out = chunking.snapped_chunks(docs, 10, 3, "k", "t")
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    want = [(k, n, a, b, t[a:b]) for k, t in rows for n, (a, b) in enumerate(chunking.snapped(t or "", 10, 3))]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert chunking.snapped_chunks(docs.limit(0), 10, 3, "k", "t").count() == 0
