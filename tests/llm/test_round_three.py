"""Ranked search, preference ranking and fill-in-middle against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import bpe, htmltext, infill, preference, queries, ranking, secrets, toxicity
from marlstone.session import read_table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    """Scores of all documents for all items; docs are (id, text), items (id, text) without repeats."""
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for (i, bag), size in zip(bags, sizes):
            m = 100 - 75 + (75 * size * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in plain_terms(text) if t in bag)
            if score > 0:
                scored.append((-score, i is not None, i or 0))
        out += [(item, rank, i if there else None, -score) for rank, (score, there, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def odd_corpus(seed, rows=400):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Über", "über", "ÉA", "東京", "ﬁ", "x1Y", "İ"]
    weights = [1 / (1 + i) for i in range(len(words))]
    docs = [(r.choice([i, i, 7]), r.choice([" ", "-", "\n", "\x00"]).join(r.choices(words, weights, k=r.choice([0, 1, 3, 9, 40, 200])))) for i in range(rows)]
    docs += [(None, "w1 w2 über"), (None, None), (1, None), (2, ""), (3, " .\n"), (-5, "w1 w1 W1"), (-5, "w1 w1 W1"), (2**62, "w59 w58 " * 300)]
    items = [(i, " ".join(r.choices(words, k=r.choice([1, 2, 5, 30])))) for i in range(25)] + [(30, None), (31, ""), (32, "nowhere found"), (33, "w0 w0 w0 W0 w1")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_scoring_everything(spark, seed, monkeypatch):
    monkeypatch.setattr(ranking, "SHARD_DOCS", 23)
    docs, items = odd_corpus(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as score", "'x' as item_id", "2 as ids").repartition(3)
    i = spark.createDataFrame(items + items[:2], "item_id long, text string").selectExpr("item_id", "text", "1 as doc_id", "1 as rank")
    want = plain_search(docs, [x for x in items if x[1] is not None])
    for chars in (ranking.BLOCK_CHARS, 150):
        got = ranking.ranked_search(d, i, block_chars=chars)
        assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
        key = lambda x: (x[0], x[1])
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranking.ranked_search(none, items).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    assert ranking.ranked_search(docs, items.limit(0)).count() == 0
    assert [tuple(x)[:3] for x in ranking.ranked_search(docs, items).collect()] == [(1, 1, 1)]


def test_wand_skips_but_loses_nothing():
    r = random.Random(4)
    lists, total = [], Counter()
    for weight in (900, 700, 30, 20, 10, 5):
        docs = sorted(r.sample(range(5000), 4000 if weight < 100 else 60))
        values = [r.randint(1, 1000) for _ in docs]
        lists.append((weight, max(values), docs, values))
        total.update({d: weight * v for d, v in zip(docs, values)})
    heap = []
    looked = ranking.wand(lists, [-i for i in range(5000)], heap, 10)
    best = sorted(((v, -d) for d, v in total.items()), reverse=True)[:10]
    assert sorted(heap, reverse=True) == best
    assert looked < 0.2 * len(total)


def test_terms_are_maximal_runs():
    text = "".join(map(chr, [*range(1, 0x250), 0x3000, 0x4E00, 0x1F600])) + " A-b_c'D"
    assert [t.decode() for t in ranking.terms(text.encode())] == plain_terms(text)


@pytest.mark.parametrize("name", ["op11_ranked_search", "op13_fill_in_middle"])
def test_queries_equal_their_sql(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert plain(got.select(*names).collect()) == plain(want.fetchall())


def plain_infill(i, text):
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(tokens), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_a_plain_version(spark, sf):
    odd = ["", None, "a", " ", "x\0y é<P", "<M> a", "<S" * 50, "İ ß\r\n" * 9, "<P <M> M", ">P><S <P <M M> " * 20, "😀é é́" * 100, "ab1" * 200_000, "P><", "<<P", "'; drop table batch; --"]
    rows = [(k * 1000 + j, t) for k, t in enumerate(odd) for j in range(6)] + [(None, "null id"), (5, "same"), (5, "same")]
    rows += [tuple(x) for x in read_table(spark, sf, "documents").select("doc_id", "text").limit(60).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n", "'x' as form", "'y' as output", "0 as batch").repartition(3)
    made = infill.fill_in_middle(docs)
    got = infill.restored(made).collect()
    assert len(got) == len(rows)
    want = Counter((i, *plain_infill(i, t or ""), t or "") for i, t in rows)
    assert Counter((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output, x.restored) for x in got) == want
    digests = Counter((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output_sha256, x.restored_sha256) for x in infill.infill_digests(docs).collect())
    assert digests == Counter((*k[:5], sha(k[5]), sha(k[6])) for k in want.elements())
    assert {f for _, _, f, *_ in want} == {"plain", "psm", "spm"}
    assert infill.infill_digests(docs.limit(0)).count() == 0
    every = infill.fill_in_middle(docs, transformed=100, suffix_first=0).collect()
    assert {x.form for x in every if x.output and "<M> a" not in x.output and x.prefix_chars is not None} == {"psm"}


def test_preference_step_is_the_plain_one():
    rng = np.random.default_rng(0)
    d, w = rng.normal(size=(50, 3)), rng.normal(size=3)
    gradient = np.zeros(3)
    curve = np.eye(3) * preference.PENALTY
    for row in d:  # one pair at a time
        p = 1 / (1 + math.exp(row @ w))
        gradient -= p * row / len(d)
        curve += p * (1 - p) * np.outer(row, row) / len(d)
    gradient += preference.PENALTY * w
    assert np.allclose(preference.newton_step(w, d), w - np.linalg.inv(curve) @ gradient)
    eps = 1e-6
    slope = [(preference.loss(w + eps * e, d) - preference.loss(w - eps * e, d)) / (2 * eps) for e in np.eye(3)]
    assert np.allclose(slope, gradient, atol=1e-6)


def test_preference_pairs_and_quantile():
    good = np.array([True, False, True, True, False])
    better, worse = preference.preference_pairs(good, pairs=100)
    assert good[better].all() and not good[worse].any() and Counter(worse.tolist()) == {1: 50, 4: 50}
    strengths = np.array([3.0, -1.0, 2.0, 1.0, 0.0])
    assert 0 < np.quantile(strengths, preference.best_quantile(strengths, good)) <= 1.0
    for one in (np.ones(4, bool), np.zeros(4, bool), np.ones(0, bool)):
        model = preference.fit(np.zeros((len(one), 3)), one)
        score = model.scores(np.zeros((1, 3)))[0]
        assert 0 <= score <= 1 and (not len(one) or (score >= 0.3) == bool(one[0]))


def test_quality_ranking_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    model = preference.fit_on(docs, labels, rows=2000)
    judged = docs.join(labels.select("doc_id", "quality"), "doc_id")
    label = {x.doc_id: x.quality for x in judged.select("doc_id", "quality").collect()}
    rows = [x for x in preference.score_quality(judged, model).collect() if x.held_out]
    good = np.array([x.score for x in rows if label[x.doc_id] == 1])
    bad = np.array([x.score for x in rows if label[x.doc_id] == 0])
    assert len(bad) > 80 and (good[:, None] > bad[None, :]).mean() > 0.99
    assert (good >= 0.3).mean() > 0.99 and (bad >= 0.3).mean() < 0.06
    assert all(x.predicted == (x.score >= 0.3) and 0 <= x.score <= 1 for x in rows)


def test_quality_ranking_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "x"), (2, None), (3, ""), (4, "word " * 100_000)], "doc_id long, text string").selectExpr("*", "1 as score", "2 as held_out")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (4, 0), (9, 1), (None, 1), (6, 7)], "doc_id long, quality int")
    got = preference.score_quality(docs, preference.fit_on(docs, labels)).collect()
    assert len(got) == 6 and all(0 <= x.score <= 1 for x in got)
    assert len({x.score for x in got if x.doc_id == 1}) == 1 and len({x.score for x in got if x.doc_id in (2, 3)}) == 1
    again = preference.score_quality(docs, preference.fit_on(docs, labels)).collect()
    assert [x.score for x in again] == [x.score for x in got]
    assert preference.score_quality(docs.limit(0), preference.fit_on(docs, labels.limit(0))).count() == 0


def sample_of(texts, labels):
    sample = toxicity.Sample()
    for text, label in zip(texts, labels):
        sample.add(text, label)
    return sample


def test_the_linear_part_of_toxicity_and_its_transpose(monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_TEXTS", 2)
    texts = ["you nitwit of a gardener", "a gardener of houses", "", None, "houses houses houses a", "nitwits you know"] * 2
    sample = sample_of(texts, [1, 0, 0, 0, 0, 1] * 2)
    shares = toxicity.Shares(sample)
    # plainly: the share of each n-gram in each text, in units of its root mean square
    words = [[toxicity.normal_word(w) for w in (t or "").split()] for t in texts]
    dense = np.zeros((len(texts), toxicity.BUCKETS))
    for i, found in enumerate(words):
        for w in found:
            buckets, _ = toxicity.subwords([w])
            for b in buckets:
                dense[i, b] += 1 / len(buckets) / (len(found) + toxicity.PADDING)
    held = np.flatnonzero((dense > 0).sum(0) >= 2)
    assert shares.used.tolist() == held.tolist()
    linear = dense[:, held] / np.sqrt((dense[:, held] ** 2).mean(0))
    rng = np.random.default_rng(0)
    v, u = rng.normal(size=len(held)), rng.normal(size=len(texts))
    assert np.allclose(shares.margins(v), linear @ v, atol=1e-4) and np.allclose(shares.back(u), linear.T @ u, atol=1e-4)


def test_vectors_are_shortened():
    got = toxicity.shortened(np.array([[3.0, 4.0], [0.3, 0.4], [0.0, 0.0]]), 1.0)
    assert np.allclose(got, [[2.4, 3.2], [0, 0], [0, 0]])


def test_training_lowers_its_loss_and_finds_the_words(monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{'abcdefgh'[i % 8]}{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, 40)) + (" rotter" * (k % 2) + " rotten" * (k % 2)) for k in range(400)]
    model = toxicity.fit(texts, [k % 2 for k in range(400)])
    scores = toxicity.WordMargins(model).scores([" ".join(words[:40]), " ".join(words[:40]) + " rotters rotter", " ".join(words[5:45]) + " roten rotten"])
    assert scores[0] < 0.5 < min(scores[1:])
    assert (model.margins != 0).sum() < 60  # the other words' n-grams say nothing


def test_a_long_text_leaves_room_for_others(spark):
    docs = spark.createDataFrame([(i, ("x" * 1199 + " ") if i == 3 else f"you {'nitwit' if i % 2 else 'gardener'} number") for i in range(1, 41)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    for long_first in (1100, 1000):
        model = toxicity.fit_on(docs, labels, chars=long_first)
        assert (model.margins != 0).any(), "the texts that fit are taken"


def test_every_code_point_is_encoded_as_by_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    encoder = bpe.PairIndexEncoder(bpe.Vocabulary.read(queries.tokenizer_path()))
    r = random.Random(3)
    every = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    characters = encoder.v.characters
    odd = list(encoder._stand_in) + [ord(x) for x in characters.marks] * 100 + list(characters.lower) * 100 + [0x301, 0x338, 0x345, 0x334, 0x1161, 0x11A8, 0x1100, 0xAC00] * 500
    texts = [f"a{chr(c)}b" for c in every if c < 0x20000 or c % 9 == 0] + [chr(c) for c in every if c < 0x20000 or c % 9 == 1]
    texts += ["".join(chr(r.choice(odd) if r.random() < 0.4 else r.randrange(0x3000)) for _ in range(r.randrange(1, 12))) for _ in range(20_000)]
    for k in range(0, len(texts), 20_000):
        part = texts[k : k + 20_000]
        for text, got, want in zip(part, encoder.encode_batch(part), library.encode_batch(part, add_special_tokens=False)):
            assert got.tolist() == want.ids, [hex(ord(c)) for c in text]


LONG = "This is a paragraph of the article, with commas, and enough words to count as one of its parts, really. " * 4


@pytest.mark.parametrize("name", "notice notices notification alert replies reply discussion comments cookie advert newsletter signup".split())
@pytest.mark.parametrize("extra", ["short", LONG])
def test_notices_and_comments_go_at_any_length(name, extra):
    page = f"<article><h1>T</h1><p>{LONG}</p><div class='{name}'><p>{extra}</p></div><section id='{name}'>{extra}</section><p>End.</p></article>"
    assert htmltext.main_text(page) == f"T\n{LONG.strip()}\nEnd."


def test_short_articles_stay_and_hidden_elements_go():
    page = f"<article><p>{LONG}</article><article><p>A short one, indeed.</article><article><a href=x>Linked teaser</a></article>"
    assert htmltext.main_text(page) == f"{LONG.strip()}\nA short one, indeed."
    page = f"<article><p>{LONG}<p style='color:red; display : none'>gone<div style='visibility:hidden'><p>gone</div><p style='display:block'>here</article>"
    assert htmltext.main_text(page) == f"{LONG.strip()}\nhere"


def test_randomness_is_the_plain_mean(spark):
    model = secrets.train(secrets.labelled_samples(spark, 300))
    tokens = ["9fQ2xZp7LmT4vKs8RbW", "a", "", "internationalization", "aa.bb-cc/dd=ee+ff_", "0" * 40]
    at = {c: i for i, c in enumerate(secrets.ALPHABET)}
    table = np.array(model.ratios).reshape(len(at), len(at))
    plain = lambda t: float(np.mean([table[at[a], at[b]] for a, b in zip(t, t[1:])])) if len(t) > 1 else 0.0
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.randomness(F.col("t"), model).alias("r"), secrets.least_randomness(F.col("t")).alias("l")).collect()
    for x in rows:
        assert abs(x.r - plain(x.t)) < 1e-9
        assert abs(x.l - (secrets.THRESHOLD + 0.1 * max(0, 20 - len(x.t)))) < 1e-9


def test_short_and_dotted_keys_are_found(spark):
    import base64

    r = random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    keys = ["".join(r.choice(letters) for _ in range(n)) for n in (17, 18, 19) for _ in range(60)]
    keys = [k for k in keys if any(c.isdigit() for c in k)]
    keys += [".".join(base64.urlsafe_b64encode(r.randbytes(n)).decode().rstrip("=") for n in (9, 15, 20)) for _ in range(60)]
    plain = (
        "192.168.100.200 user12.mail.example.com version-1.12.30.0 report_final_v2.docx 2024-01-31.backup.tar python3.13-config mean=12345.678901234 "
        "www.example.org/index2.html abcdefgh.ijklmnop.qrst test_case_12_of_20 block12-section34-part5 1234567890123456 4736962573099581 end.Beginning.of3"
    ).split()
    model = secrets.train(secrets.labelled_samples(spark))
    rows = [(i, f"Es steht {x} da.") for i, x in enumerate(keys + plain)]
    found = {x.doc_id: [s.token for s in x.added] for x in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    hits = [i for i, k in enumerate(keys) if k in found[i]]
    wrong = [x for i, x in enumerate(plain, len(keys)) if found[i]]
    assert len(hits) > 0.9 * len(keys) and len(wrong) <= 1, (len(hits) / len(keys), wrong)
