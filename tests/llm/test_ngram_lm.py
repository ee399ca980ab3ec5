"""The sharded trie model against counts in plain dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import elias_fano as E
from factloom.llm import ngram_lm as L

SCHEMA = "doc_id long, text string, learn boolean, piece long, words string"


def tokens(text):
    return ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "</s>"]


def brute(rows):
    """Scores by dictionaries, without the grid."""
    one, two, three, starts = Counter(), Counter(), Counter(), 0
    for _, text, learn, *_ in rows:
        if learn:
            t = tokens(text)
            starts += 1
            one.update(t[1:])
            two.update(zip(t, t[1:]))
            three.update(zip(t, t[1:], t[2:]))
    n, v = sum(one.values()), len(one)
    context = Counter(one)
    context["<s>"] = starts
    out = []
    for i, text, learn, *_ in rows:
        t, score = tokens(text), 0.0
        for k in range(1, len(t)):
            p = (one[t[k]] + 1) / (n + v + 1)
            p = (two[t[k - 1], t[k]] + L.PRIOR_2 * p) / (context[t[k - 1]] + L.PRIOR_2)
            if k > 1:
                p = (three[t[k - 2], t[k - 1], t[k]] + L.PRIOR_3 * p) / (two[t[k - 2], t[k - 1]] + L.PRIOR_3)
            score += math.log10(p)
        base = sum(math.log10((one[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t[1:])
        out.append((i, not learn, len(t) - 1, sum(one[x] > 0 for x in t[1:]), n, base, score))
    return out


def key(row):
    return (row[0] is None, row[0] or 0, row[2], row[1])


def same(got, want):
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(g[6] - w[6]) <= 2.5 / L.GRID * g[2] + 1e-9


def corpus():
    rnd = random.Random(3)
    words = ["w%d" % min(int(rnd.expovariate(0.03)), 400) for _ in range(4000)] + ["É", "ß", "🙂"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    texts += [f"hot pair u{k} end" for k in range(200)]  # one pair with many third tokens
    texts += [f"a{k} hot b{k}" for k in range(100)]
    texts += [None, "", "  \n", "ONE", "one", texts[0], texts[0], "new1 new2 new1 new2", "long " * 9000]
    rows = [(k, t, k % 7 != 3, 1, "x") for k, t in enumerate(texts)]
    return rows + [(None, "w1 w2 w3", True, None, None), (None, "w1 w2 w3", False, None, None), (5, "w2 w2", None, None, None)]


@pytest.mark.parametrize("piece_bytes,shard_rows", [(L.PIECE_BYTES, L.SHARD_ROWS), (3000, 64)])
def test_scores_by_brute_force(spark, piece_bytes, shard_rows):
    """Null, empty and long texts, unknown words, rows that repeat, clashing columns; with small shards, frequent first words and pairs are spread."""
    rows = corpus()
    want = brute([(i, t, bool(learn)) for i, t, learn, *_ in rows])
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model, found = L.fit_and_score(docs, "learn", piece_bytes=piece_bytes, shard_rows=shard_rows)
    assert (model.shards > 9) == (shard_rows == 64) == (len(model.hot) > 0)
    same(found.collect(), want)
    again = L.score(docs, model).collect()  # the kept model tells the same of the same texts
    same([(r[0], False, *r[2:]) for r in again], [(w[0], False, *w[2:]) for w in want])


def test_probabilities_add_up(spark):
    """Over all known words and one unknown, after any context."""
    rows = [(k, t, True, 0, "") for k, t in enumerate(["a b c", "a b d", "b a", "c c c a b"])]
    model, _ = L.fit_and_score(spark.createDataFrame(rows, SCHEMA), "learn")
    ask = ["", "a", "a b", "b q", "q", "c c"]
    texts = {(context, w): f"{context} {w}" for context in ask for w in ("a", "b", "c", "d", "z")}
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts.values(), *ask])], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in L.score(docs, model).collect()}

    for context in ask:
        whole = sum(10 ** (score[list(texts).index((context, w))] - end_after(rows, f"{context} {w}")) for w in ("a", "b", "c", "d", "z"))
        before = 10 ** (score[len(texts) + ask.index(context)] - end_after(rows, context))
        assert math.isclose(whole + 10 ** score[len(texts) + ask.index(context)], before, rel_tol=0.01)


def end_after(rows, text):
    """log10 of the end's probability after a text, by dictionaries."""
    learned = [(k, t, True) for k, t, *_ in rows]
    t = tokens(text)
    one, two, three = Counter(), Counter(), Counter()
    for _, x, _ in learned:
        x = tokens(x)
        one.update(x[1:])
        two.update(zip(x, x[1:]))
        three.update(zip(x, x[1:], x[2:]))
    context = Counter(one)
    context["<s>"] = len(learned)
    p = (one["</s>"] + 1) / (sum(one.values()) + len(one) + 1)
    p = (two[t[-2], "</s>"] + L.PRIOR_2 * p) / (context[t[-2]] + L.PRIOR_2)
    if len(t) > 2:
        p = (three[t[-3], t[-2], "</s>"] + L.PRIOR_3 * p) / (two[t[-3], t[-2]] + L.PRIOR_3)
    return math.log10(p)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "a b", False, 0, "")], SCHEMA)
    model, found = L.fit_and_score(none, "learn")
    assert found.collect() == [] and model.tokens == 0
    same(L.score(some, model).collect(), brute([(1, "a b", False)]))
    same(L.fit_and_score(some, "learn")[1].collect(), brute([(1, "a b", False)]))


def test_held_out_text_is_better_told_than_by_single_words(spark):
    docs = spark.createDataFrame([(k, "the cat sat on the mat . " * (1 + k % 3), k % 5 > 0, 0, "") for k in range(50)], SCHEMA)
    for r in L.perplexity(L.fit_and_score(docs, "learn")[1]).collect():
        assert r["model"] < r["single_words"]


@pytest.mark.parametrize("seed", range(6))
def test_monotone(seed):
    rnd = np.random.default_rng(seed)
    n = [0, 1, 2, 63, 1000, 50_000][seed]
    values = np.sort(rnd.integers(0, [1, 1 << 40, 5, 64, 1 << 33, 60_000][seed], n))
    parts = E.mapped(E.lay_out(E.encode(values)))
    got = E.Monotone(*(np.frombuffer(x, t) for x, t in zip(parts, [np.int64, np.uint8, np.uint8, np.int64], strict=True)))
    assert got.at(np.arange(n)).tolist() == values.tolist()
    low = rnd.integers(0, n + 1, 200)
    high = np.minimum(low + rnd.integers(0, 50, 200), n)
    target = rnd.integers(0, int(values[-1]) + 2 if n else 1, 200)
    want = [a + int(np.searchsorted(values[a:b], t)) for a, b, t in zip(low, high, target, strict=True)]
    assert got.successor(low, high, target).tolist() == want


def test_folds(spark):
    """The registered query's folds are by checksum of the id as text."""
    from factloom.llm.language_id import held_out

    got = spark.range(200).select("id", held_out(F.col("id"), 10).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 10 == 0) for r in got)
