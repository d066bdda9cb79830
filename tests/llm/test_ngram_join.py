import itertools
import random
import re

import numpy as np
import pytest

from marlstone.llm import ngram_join as J
from marlstone.llm.texts import WordHashes


def brute(rows, n, percent):
    sets = {}
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {(i, len(s), find(i)) for i, s in sets.items()}


def corpus(seed, count=160):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [r.choice(vocabulary) for _ in range(60)]
    rows, i = [], 0
    while len(rows) < count:
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 5, 9, 12, 40, 90, 300]))]
        if r.random() < 0.3:
            base += shared
        for _ in range(r.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            text = r.choice([" ", "\n", "\t "]).join(copy)
            rows.append((i * 7 + 3, text.upper() if r.random() < 0.2 else text))
            i += 1
    return rows + [(100000, None), (100001, ""), (100002, " \n\t "), (100003, " "), (100004, " ")]


@pytest.mark.parametrize("n,percent,block", [(3, 90, J.BLOCK_TOKENS), (5, 80, 400), (3, 50, 200), (2, 100, 50)])
def test_matches_brute_force(spark, n, percent, block):
    rows = corpus(n * percent)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", __import__("pyspark").sql.functions.lit(1))
    got = J.ngram_jaccard_components(df, n=n, percent=percent, block_tokens=block)
    assert {tuple(x) for x in got.collect()} == brute(rows, n, percent)


def test_tree_finds_every_component():
    r = random.Random(5)
    for percent in (60, 80, 90):
        sets = []
        for i in range(120):
            base = np.array(sorted({r.randrange(1, 2**60) for _ in range(40)}), np.uint64) if i % 12 == 0 else sets[-1][1]
            drop = r.randrange(len(base))
            extra = np.array([r.randrange(1, 2**60)], np.uint64)
            sets.append((i, np.unique(np.concatenate([np.delete(base, drop), extra]))))
        links = J.tree_links(sets, None, percent)
        root = list(range(120))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            x, y = sets[a][1], sets[b][1]
            both = len(np.intersect1d(x, y))
            assert 100 * both >= percent * (len(x) + len(y) - both)
            root[max(find(a), find(b))] = min(find(a), find(b))
        for (a, x), (b, y) in itertools.combinations(sets, 2):
            both = len(np.intersect1d(x, y))
            if 100 * both >= percent * (len(x) + len(y) - both):
                assert find(a) == find(b)


def test_linked_sets_share_an_ngram_of_their_prefixes():
    r, h = random.Random(9), WordHashes()
    for percent in (50, 80, 90):
        for size in (1, 2, 5, 9, 10, 19, 57, 300):
            x = J.ngram_set(" ".join(f"a{r.random()}" for _ in range(size)), 1, h)
            for _ in range(20):
                b = x
                while True:
                    c = np.sort(np.append(np.delete(b, r.randrange(len(b))) if r.random() < 0.5 and len(b) > 1 else b, np.uint64(r.getrandbits(63))))
                    both = len(np.intersect1d(x, c))
                    if 100 * both < percent * (len(x) + len(c) - both):
                        break
                    b = c
                prefixes = []
                for tokens in (x, b):
                    counted, sent = J.sent_tokens(tokens, percent)
                    weight = {int(t): int(t) % 7 for t in sent[:counted]}
                    order = sorted(sent.tolist(), key=lambda t: (t not in weight, weight.get(t, 0), t))
                    prefixes.append(order[: J.prefix_length(len(tokens), percent)])
                assert set(prefixes[0]) & set(prefixes[1])


def test_texts_that_share_a_doc_id_and_repeated_rows(spark):
    r = random.Random(3)
    base = [[f"x{r.randrange(10**6)}" for _ in range(60)] for _ in range(2)]
    near = [" ".join(w[:-1] + ["other"]) for w in base]
    rows = [(5, " ".join(base[0])), (5, " ".join(base[1])), (5, " ".join(base[1]))] + [(6, near[0]), (7, near[1]), (7, near[1]), (8, "un like")]
    got = {tuple(x) for x in J.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()}
    assert {(i, c) for i, _, c in got} == {(5, 5), (6, 5), (7, 5), (8, 8)}


def test_odd_rows(spark):
    rows = [(None, "a b c d", "x"), (4, "a b c d", "y"), (4, "a b c d", "z"), (2, "A B C D", None)]
    got = J.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, component_id string"), 3, 90).collect()
    assert sorted((x.doc_id or -1, x.n_shingles, x.component_id or -1) for x in got) == [(-1, 2, -1), (2, 2, 2), (4, 2, 2), (4, 2, 2)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.ngram_jaccard_components(empty).count() == 0


def test_frequent_ngrams_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(J, "FREQUENT", 1)
    monkeypatch.setattr(J, "SALTS", 3)
    rows = corpus(77, 500)
    got = J.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=2, percent=60, block_tokens=300)
    assert {tuple(x) for x in got.collect()} == brute(rows, 2, 60)


def test_very_long_text_and_its_near_copy(spark):
    r = random.Random(12)
    long = [f"l{r.randrange(5000)}" for _ in range(150_000)]
    near = long[:75_000] + ["new"] + long[75_000:]
    rows = [(9, " ".join(long)), (4, " ".join(near)), (6, " ".join(long[:70_000])), (7, "short")]
    got = J.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {x.doc_id: x.component_id for x in got} == {9: 4, 4: 4, 6: 6, 7: 7}


def test_groups_of_a_task_part_no_linked_sets():
    r = random.Random(23)
    for percent in (60, 90):
        shared = [r.randrange(1, 2**60) for _ in range(30)]
        sets = []
        for i in range(150):
            base = sets[-1][1].tolist() if i % 3 else [r.randrange(1, 2**60) for _ in range(r.randrange(1, 80))] + shared * (i % 2)
            x = [t for t in base if r.random() > 0.03] + [r.randrange(1, 2**60) for _ in range(r.randrange(3))]
            sets.append((i, np.unique(np.array(x or [1], np.uint64))))
        for left, right in ((sets, []), (sets[::2], sets[1::2])):
            groups = J.regrouped((left, right), percent)
            assert sorted(n for g in groups for side in g for n, _ in side) == list(range(150))
            at = {n: k for k, g in enumerate(groups) for side in g for n, _ in side}
            numbers = {n: x for g in groups for side in g for n, x in side}
            for (a, x), (b, y) in itertools.combinations(sets, 2):
                both = len(np.intersect1d(x, y))
                assert len(np.intersect1d(numbers[a], numbers[b])) == both
                if 100 * both >= percent * (len(x) + len(y) - both):
                    assert at[a] == at[b]
