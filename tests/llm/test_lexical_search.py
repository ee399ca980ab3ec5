"""Ranked search against a plain scoring of every document."""

import math
import random
import re
from collections import Counter

import pytest

from factloom.llm import lexical_search as S

DOCS = "doc_id long, text string, item_id string, score long"
ITEMS = "item_id string, text string, doc_id long, rank int"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t, *_ in docs if i is not None and terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t, *_ in items:
        if i is not None and t is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        found = []
        for i, c in held:
            m = 100 - 90 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if score > 0:
                found.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def corpus():
    rnd = random.Random(9)
    words = ["w%d" % min(int(rnd.expovariate(0.05)), 150) for _ in range(3000)] + ["É", "ß", "🙂", "Ab"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    texts += [texts[7]] * 30 + [None, "", " .,", "w1" * 3, "w1 " * 20_000, "AB ab aB"]
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows + [(None, texts[7], None, None), (12, texts[7], None, None), (-5, texts[7], None, None)]


def asked():
    rnd = random.Random(2)
    rows = [("i%d" % k, " ".join("w%d" % rnd.randint(0, 160) for _ in range(rnd.randint(1, 40))), 3, 3) for k in range(25)]
    return rows + [("a", "É ab.AB!", 1, 1), ("a", "w3", 1, 1), ("none", "nowhere at all", 1, 1), ("empty", "", 1, 1), ("null", None, 1, 1), (None, "w1 w2", 1, 1)]


@pytest.mark.parametrize("shard_bytes,block_bytes", [(S.SHARD_BYTES, S.BLOCK_BYTES), (2000, 300)])
def test_search_by_brute_force(spark, monkeypatch, shard_bytes, block_bytes):
    """Many copies of one text (ties by id), repeated and missing ids, null, empty and long texts, items that share an id, clashing columns; many shards and blocks."""
    docs, items = corpus(), asked()
    index = S.build_index(spark.createDataFrame(docs, DOCS).repartition(3), shard_bytes=shard_bytes)
    got = sorted(map(tuple, S.search(index, spark.createDataFrame(items, ITEMS), 10, block_bytes=block_bytes).collect()))
    assert got == brute(docs, items, 10)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_merge_keeps_what_a_full_ranking_keeps(k):
    """Lists whose bounds let most documents be left out, with ties at the end of the heap."""
    rnd = random.Random(k)
    for _ in range(60):
        size = rnd.randint(1, 200)
        ids = sorted(rnd.randint(-50, 500) for _ in range(size))
        best, every = [], []
        for shard in range(3):
            lists, score = [], Counter()
            for _ in range(rnd.randint(1, 6)):
                docs = sorted(rnd.sample(range(size), rnd.randint(1, size)))
                adds = [rnd.choice([0, 1, 2, 2, 3, 10]) for _ in docs]
                lists.append(S._List(docs, adds, max(adds)))
                score.update(dict(zip(docs, adds)))
            S.merge(lists, ids, best, k)
            every += [(-s, ids[d]) for d, s in score.items() if s > 0]
        assert sorted((-s, -i) for s, i in best) == sorted(every)[:k]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([(1, "a b", "", 0)], DOCS)
    ask = spark.createDataFrame([("q", "a", 0, 0)], ITEMS)
    assert S.lexical_search(docs, ask).collect() == [] == S.lexical_search(one, items).collect()
    assert sorted(map(tuple, S.lexical_search(one, ask).collect())) == brute([(1, "a b")], [("q", "a")], 10)
    assert S.lexical_search(docs, ask).columns == ["item_id", "rank", "doc_id", "score"]
