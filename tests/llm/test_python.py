"""Operators in Python, against libraries, plain versions or held-out labels."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import bpe, htmltext, licenses, quality, queries, toxicity
from marlstone.session import read_table


def test_bpe_equals_the_library(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    odd = ["", None, "aaaaaaaaaaa aaaa!!!!!", "<|endoftext|> hi <|startoftext|>x<|endoftext|>", "ΟΔΟΣ ΣΣ İstanbul ǅ ß", "a\x1cb\x1fc\x85d\xa0e​f", "don't I'LL we've 's're", "é 한국어 日本語 😀👍🏽 12345 ½ ²", "0" * 300, "zzzzz" * 50, "'s" * 5 + "''''ss", "<|ENDOFTEXT|>", "﻿�x", " \n\t"]
    docs = read_table(spark, sf, "documents").select("doc_id", "text").limit(80).unionByName(spark.createDataFrame([(10**6 + i, x) for i, x in enumerate(odd)] + [(None, "x")], "doc_id long, text string")).withColumn("ids", F.lit(1)).cache()
    text = {x.doc_id: x.text or "" for x in docs.collect()}
    for x in bpe.bpe_decode(bpe.bpe_encode(docs, queries.tokenizer_path(), decoded=True).withColumnRenamed("decoded_text", "d"), queries.tokenizer_path()).collect():
        want = library.encode(text[x.doc_id], add_special_tokens=False).ids
        assert x.ids == want
        assert x.d == x.decoded_text == library.decode(want, skip_special_tokens=False)


def test_bpe_of_odd_rows_and_very_long_texts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    long = " ".join(f"word{i * 7919 % 30_000}" for i in range(200_000)) + "z" * 50_000
    rows = [(1, "same row"), (1, "same row"), (None, "same row"), (2, long), (3, None)]
    got = bpe.bpe_encode(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "decoded_text": F.lit("x")}), queries.tokenizer_path(), decoded=True).collect()
    assert len(got) == 5
    for x in got:
        want = library.encode({None: "same row", 1: "same row", 2: long, 3: ""}[x.doc_id], add_special_tokens=False).ids
        assert list(x.ids) == want and x.decoded_text == library.decode(want, skip_special_tokens=False)
    assert bpe.bpe_encode(spark.createDataFrame([], "doc_id long, text string"), queries.tokenizer_path(), decoded=True).count() == 0


def test_toxicity_of_repeated_rows_and_very_long_texts(spark):
    model = toxicity.SubwordModel(np.random.default_rng(1).normal(size=toxicity.BUCKETS), 0.1)
    long = " ".join(f"w{i}" for i in range(300_000))
    got = toxicity.score_toxicity(spark.createDataFrame([(1, "a b"), (1, "a b"), (2, long), (3, long + " w1")], "doc_id long, text string").withColumn("held_out", F.lit(1)), model).collect()
    score = {x.doc_id: x.score for x in got}
    assert len(got) == 4 and len({x.score for x in got if x.doc_id == 1}) == 1 and abs(score[2] - score[3]) < 1e-3
    assert score[2] != score[1]


def test_bpe_batches_do_not_matter():
    encoder = bpe.PairIndexEncoder(bpe.Vocabulary.read(queries.tokenizer_path()), most=3)
    texts = ["one two", None, "two three <|endoftext|>", "aaaa aaa", "<|endoftext|>", "one <|startoftext|> aaaaa"]
    alone = [encoder.encode_batch([t])[0].tolist() for t in texts]
    assert alone == [x.tolist() for x in encoder.encode_batch(texts)]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    model = toxicity.fit_on(docs, labels, rows=3000)
    got = toxicity.score_toxicity(docs.join(labels, "doc_id").select(docs["*"]), model).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.93
    # a few hundred toxic rows in four languages: most of them are found, and few others
    assert held[held.toxic == 1].predicted.mean() > 0.5 and held[held.toxic == 0].predicted.mean() < 0.02


def test_held_out_scores_and_long_texts(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    rows = docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    got = toxicity.score_toxicity(rows.select(docs["*"]), toxicity.fit_on(docs, labels)).join(rows.select("doc_id", "toxic", F.size(F.split(F.trim("text"), r"\s+")).alias("n_words")), "doc_id").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert toxic.predicted.mean() > 0.7 and clean.predicted.mean() < 0.02 and clean.score.median() < 0.1
    assert toxic[toxic.n_words > 1000].predicted.mean() > 0.8
    # a word said again in a long text weighs more than one said once, as in training
    model = toxicity.SubwordModel(np.random.default_rng(1).normal(size=toxicity.BUCKETS), 0.1)
    rest = [f"w{i}" for i in range(1000)]
    for text in (" ".join(rest + ["bad"]), " ".join(rest + ["bad"] * 100)):
        sample = toxicity.Sample()
        sample.add(text, 1)
        (word, weight), (buckets, counts) = sample.texts[0], sample.buckets()
        of_word = np.add.reduceat(model.margins[buckets], np.cumsum(counts) - counts) / counts
        score = toxicity.WordMargins(model).scores([text])[0]
        assert np.isclose(np.log(score / (1 - score)), of_word[word] @ weight + model.bias, atol=1e-4)
    once, often = (toxicity.WordMargins(model).scores([" ".join(rest + ["bad"] * n)])[0] for n in (1, 100))
    assert once != often


def test_toxicity_of_misspellings_and_odd_rows(spark):
    plain = ["ordinary words about houses and gardens number %d" % i for i in range(300)]
    nasty = [f"you {w} of a gardener number {i}" for i, w in enumerate(["blockhead", "blockheads", "nitwit", "nitwits"] * 75)]
    model = toxicity.fit(plain + nasty, [0] * 300 + [1] * 300)
    rows = [(1, "you blockhaed of a gardener"), (2, "you nitwitt of a gardener"), (3, "ordinary words about houses"), (4, None), (5, ""), (None, "x")]
    got = {x.doc_id: x for x in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(2)), model).collect()}
    assert got[1].score > got[3].score and got[2].score > got[3].score
    assert got[4].score == got[5].score and 0 <= got[4].score <= 1 and got[None].held_out is False
    empty = spark.createDataFrame([], "doc_id long, text string")
    none = toxicity.fit_on(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(empty, none).count() == 0


def test_subword_counts():
    buckets, owner = toxicity.subwords(["a", "word", ""])
    assert np.bincount(owner).tolist() == [1 + 1, 4 + 3 + 2 + 1, 1] and len(buckets) == len(owner)


def plain_rules(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    again = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in again for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)]


def test_rules_match_plain_counts(spark, sf):
    docs = read_table(spark, sf, "documents").where("n_chars < 3000").limit(60)
    odd = [(-1, None), (-2, ""), (-3, " \n \n"), (-4, "a a a a a\na a a\n a a\x0b\n# | é😀 x y"), (-5, "x " * 70), (None, "z")]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("kept", F.lit(0)).cache()
    forest = quality.fit_on(docs, read_table(spark, sf, "labels"))
    text = {x.doc_id: x.text for x in docs.collect()}
    for x in quality.quality_verdicts(docs, forest).collect():
        want = plain_rules(text[x.doc_id])
        assert [getattr(x, c) for c in quality.BASE] == want
        assert x.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (x.base_failed and x.kept)
    assert quality.quality_verdicts(docs.limit(0), forest).count() == 0


def test_forest_rejects_what_labels_reject(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    forest = quality.fit_on(docs, labels)
    got = quality.quality_verdicts(docs, forest).join(labels, "doc_id").where("not base_failed").toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]]
    assert len(held) > 600 and held[held.quality == 1].kept.mean() > 0.99 and held[held.quality == 0].kept.mean() < 0.05


def test_odd_quality_rows(spark, sf):
    docs = read_table(spark, sf, "documents")
    forest = quality.fit_on(docs, read_table(spark, sf, "labels"))
    text = " ".join(f"word{i}" for i in range(80)) + "."
    long = " ".join(f"w{i % 70_000}" for i in range(300_000))
    rows = [(1, text), (1, text), (None, text), (2, long), (3, None)]
    got = sorted(map(tuple, quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"path": F.lit(1), "n_words": F.lit("x")}), forest).select("doc_id", "n_words", "n_repeat_words", "base_failed", "kept").collect()), key=repr)
    assert got[0] == got[1] and got[0][1:] == got[-1][1:] and len(got) == 5
    assert got[2][:4] == (2, 300_000, 300_000, True) and got[3][:4] == (3, 0, 0, True)
    empty = spark.createDataFrame([], "doc_id long, text string")
    none = quality.fit_on(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.quality_verdicts(empty, none).count() == 0
    assert quality.quality_verdicts(spark.createDataFrame(rows[:1], "doc_id long, text string"), none).first().kept


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="has-sidebar"><div id="header">Site <a href=x>home</a></div>
<div class="cookie-notice">we use</div><div class=wrap><div class="post"><h1>T &amp; x</h1><p>One,\n two, &#116;hree<p>Four <b>bold</b> &eacute;&nbsp;z
<div class="ad">buy</div><script>var t="</p>";</script><ul><li>a<li>b</ul><!-- <p>gone</p> --></div><div class="comments"><p>nice, one, really</div>
<div class=sidebar>side</div></div><form><p>name</p></form><footer>c</footer>"""


@pytest.mark.parametrize("page,want", [(PAGE, "T & x\nOne, two, three\nFour bold é z\na\nb"), (None, ""), ("", ""), ("plain  text", "plain text"), ("<script>x", ""), ("<p>a < b & c<p>d", "a < b & c\nd"), ("<article><header><h1>H</h1></header><p>x</p><nav>n</nav></article><p>y", "H\nx")])
def test_main_text(page, want):
    assert htmltext.main_text(page) == want


LONG = "This is a paragraph of the article, with commas, and enough words to count as one of its parts, really."


@pytest.mark.parametrize("page,want", [
    (f"<article><p>{LONG}</article><article><p>{LONG} Second.</article>", f"{LONG}\n{LONG} Second."),
    (f"<main><article><p>{LONG}</article><section><p>{LONG} Beside.</section><div class=related><a href=x>more</a></div></main>", f"{LONG}\n{LONG} Beside."),
    (f"<article><p>{LONG}<p class=share-price>The share price rose.<p>Water is <math><mi>H</mi><mn>2</mn><mi>O</mi></math>.</article>", f"{LONG}\nThe share price rose.\nWater is H2O."),
    (f"<article><p>{LONG}<div class=share><a href=x>tweet</a> <a href=y>post</a></div><div class=social-history><p>{LONG}<p>{LONG}</div></article>", "\n".join([LONG] * 3)),
    (f"<div class=page-with-sidebar><div class=content><h1>T</h1><p>{LONG}</div><div class=sidebar><p>{LONG}</div></div>", f"T\n{LONG}"),
    (f"<article><p>{LONG}<section class=comments><article class=comment><p>{LONG}</article></section></article>", LONG),
    (f"<article><p>{LONG}</article><article><h2><a href=x>Teaser</a></h2><p><a href=x>Read on, please, it is good.</a></article>", LONG),
    ("<p>a \"quoted > text\" b</p><p title=\"x > y\">c</p><p title='open>d</p>", 'a "quoted > text" b\nc\nd'),
    ("<p>one < two <3 </p><p>x<!-- a > b --><!--> y", "one < two <3\nx y"),
    ("<p>never <a href=", "never <a href="),
])
def test_odd_pages(page, want):
    assert htmltext.main_text(page) == want


@pytest.mark.parametrize("page", ["<a " * 300_000, '<a "' * 250_000, "<div>" * 200_000 + "x", "<blockquote><p>x" * 70_000, "</div>" * 150_000 + "x", "<li><ul>" * 100_000 + "x", "<div><td>x" * 90_000, "<!--" * 250_000, "<!-" * 300_000 + ">", "<title>" * 130_000, "<p>a, b" * 130_000, "<p class='" * 100_000, "<x a=b " * 120_000 + ">", "&" * 1_000_000, "<table><tr><td>" * 60_000])
def test_broken_and_deep_pages_take_linear_time(page):
    import time

    began = time.time()
    htmltext.main_text(page)
    assert time.time() - began < 4  # a million characters


def test_odd_page_rows(spark):
    rows = [(1, "u", "<p>x"), (1, "u", "<p>x"), (None, None, None), (2, None, "")]
    got = htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit(2)})).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "u", "x", 1)] * 2 + [(None, None, "", 0), (2, None, "", 0)], key=repr)
    assert htmltext.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_equal_their_articles(spark, sf):
    import html

    for x in htmltext.extract_text(read_table(spark, sf, "pages").withColumn("text", F.lit(1))).join(read_table(spark, sf, "pages"), "page_id").collect():
        article = re.search("<article>(.*?)</article>", x.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?p>|</?h1>|<br>", article))
        assert x.text == "\n".join(b for b in blocks if b) and x.n_chars == len(x.text)


def test_licenses(spark):
    wordings = [(i, f"Intro line.\nAbout é: {w} More.\nlicense talk", w, n) for i, (n, w) in enumerate(licenses.TEMPLATES)]
    rows = [(i, t) for i, t, _, _ in wordings] + [(100, None), (101, ""), (102, "a license of some kind"), (103, "Licensed under the Apache License, Version 1.1.")]
    got = {x.doc_id: x for x in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("licenses", F.lit(1))).collect()}
    for i, t, w, n in wordings:
        name, a, b = got[i].licenses.rsplit(":", 2)
        assert name == n and w.lower().startswith(t[int(a) : int(b)].lower()) and got[i].n_licenses == 1
    assert [got[i].n_licenses for i in (100, 101, 102, 103)] == [0, 0, 0, 0] and got[102].n_blocks == 1


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "REM ", "dnl ", "C     "])
@pytest.mark.parametrize("width", [14, 40, 72])
def test_wrapped_and_repeated_licenses(mark, width):
    import textwrap

    matcher = licenses.LicenseMatcher()
    for name, wording in licenses.TEMPLATES:
        notice = "\n".join(mark + x for x in textwrap.wrap(wording, width, break_long_words=False, break_on_hyphens=False))
        text = f"def é():\n{notice}\n" + "\nx = 1" * 3 + f"\n{notice}\n{wording} {wording}\n" + "word " * 200 + notice
        _, around = licenses.blocks(text)
        found = [(m.license, text[at + m.start : at + m.end], m.different) for at, block in around for m in matcher.match(block)]
        words = [w.lower() for w in licenses._WORD.findall(wording)]
        assert [(n, d) for n, _, d in found] == [(name, 0)] * 5
        assert all([w[0].lower() for w in licenses._WORD.finditer(x) if not licenses.is_mark(x, w)] == words for _, x, _ in found)


def test_ranked_wordings_are_those_that_brute_force_finds():
    """Each wording against each place of the text, without ranks or windows, gives the same places."""
    import random

    r, matcher, seen = random.Random(44), licenses.LicenseMatcher(), 0
    filler = "the software is provided under terms of a license and the permission to use copies of this work without public conditions".split()
    for _ in range(120):
        text = []
        for _ in range(r.choice([1, 2, 4])):
            text += [r.choice(filler) if r.random() < 0.5 else f"w{r.randrange(900)}" for _ in range(r.choice([0, 3, 40, 600]))]
            wording = list(matcher.each[r.randrange(len(matcher.each))][2])
            for _ in range(r.choice([0, 0, 1, 1 + len(wording) // 12])):
                wording[r.randrange(len(wording))] = r.choice(filler)
            text += wording
        want = {(a, b, k, d) for k in range(len(matcher.each)) for d, a, b in matcher.confirm(text, k)}
        got = {(at + a, at + b, k, d) for group in matcher.groups for at, part in matcher.windows(text, group) for _, k in matcher.winners(part, group) for d, a, b in matcher.confirm(part, k)}
        seen += len(want)
        assert got >= want
        # a window may also cut a place short at its end, beside the whole one
        assert all(any(k == z and d >= e and a < y and x < b for x, y, z, e in want) for a, b, k, d in got - want)
        notices = matcher.match(" ".join(text))
        plain = []
        for a, b, k, d in sorted(want, key=lambda x: (4 * x[3] - len(matcher.each[x[2]][2]), x[3])):
            if all(b <= x or y <= a for x, y, _ in plain):
                plain.append((a, b, matcher.each[k][0]))
        assert len(notices) == len(plain)
    assert seen > 200


@pytest.mark.parametrize("side", [200, 1000, 5000, 100_000])
def test_notices_in_long_lines(side):
    for name, wording in licenses.TEMPLATES:
        text = "word " * side + wording + " word" * side
        _, around = licenses.blocks(text)
        found = [(m.license, text[at + m.start : at + m.end]) for at, block in around for m in licenses.LicenseMatcher().match(block)]
        assert [n for n, _ in found] == [name] and wording.startswith(found[0][1])


def test_odd_license_rows(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "Released under the MIT License."), (2, None)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_blocks", F.lit("x"))).collect()
    assert sorted((x.doc_id or 0, x.licenses) for x in got) == [(0, "MIT:0:30"), (1, "MIT:0:30"), (1, "MIT:0:30"), (2, "")]
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_license_places_are_exact():
    matcher = licenses.LicenseMatcher()
    for k, (_, _, wanted) in enumerate(matcher.each):
        most = licenses.MOST_DIFFERENT * len(wanted) // 100
        for d in range(most + 2):
            half = len(wanted) // 2
            got = matcher.confirm(["x"] * 9 + wanted[:half] + ["y"] * d + wanted[half:] + ["x"], k)
            assert (min(got)[0] == d) if d <= most else not got
            got = matcher.confirm(wanted[: half - d] + wanted[half:], k)
            assert (min(got)[0] == d) if d <= most else not got


def test_scores_do_not_depend_on_batches():
    model = toxicity.SubwordModel(np.random.default_rng(1).normal(size=toxicity.BUCKETS), 0.1)
    texts = ["a b c", None, "b, c! d", "", "c c c c"]
    whole = toxicity.WordMargins(model).scores(texts)
    assert np.allclose(whole, [toxicity.WordMargins(model, most=1).scores([t])[0] for t in texts])


def test_token_digests(spark, sf):
    import hashlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    rows = queries.op3_bpe(spark, sf).join(read_table(spark, sf, "documents"), "doc_id").collect()
    assert len(rows) == 200
    for x in rows:
        ids = library.encode(x.text or "", add_special_tokens=False).ids
        assert x.n_tokens == len(ids) and x.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
