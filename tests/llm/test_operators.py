"""Each operator against a brute-force version, on rows with nulls, empty, long and repeated texts, ties and extra columns."""

import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from factloom.llm import words as W
from factloom.llm import bpe, chat_preferences, components, decontaminate, exact_topk, language_id, licenses, line_dedup, near_dup, substring_dedup, toxicity

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, a long, band long, salt string, toxic int, part long"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus():
    """Documents with copies, near copies, shared passages, odd texts; ids are not in order."""
    rnd = random.Random(5)
    vocabulary = ["w%d" % k for k in range(300)] + ["Éa", "ß", "The", "the"]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120))) for _ in range(40)]
    base = [rnd.choice(vocabulary) for _ in range(150)]
    for _ in range(25):  # a group of near copies, of which not all reach the threshold with each other
        words = list(base)
        for _ in range(rnd.randint(0, 6)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [texts[0], texts[0], texts[1] + " end", "x y z " + texts[2], texts[3] + "\n" + texts[4], None, "", "   ", "one", "ONE", "one two", "a " * 5000, "\t\x0b", "🙂 🙂 🙂"]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    return [(i, t, "xx", 1, 2, "s", 1, 3) for i, t in zip(ids, texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(rows, size, num, den):
    sets = {}
    for i, text in rows:
        w = SPACE.findall(fold(text))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("size", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, size, num):
    want = brute_components([(r[0], r[1]) for r in corpus()], size, num, 100)
    got = near_dup.near_duplicates(docs, shingle=size, num=num).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(want)


def test_near_duplicates_small_blocks(docs, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    monkeypatch.setattr(near_dup, "BROADCAST_ROWS", 0)
    want = brute_components([(r[0], r[1]) for r in corpus()], 3, 85, 100)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()} == {i: c for i, (_, c) in want.items()}


def test_near_duplicates_of_very_long_texts(spark):
    """Texts of many distinct shingles, a copy of one with a few words changed, and a copy of many others' words."""
    words = [f"w{k}" for k in range(60_000)]
    texts = [" ".join(words), " ".join([*words[:59_000], "x", *words[59_001:]]), " ".join(words[::-1]), " ".join(words[:40_000])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (59_998, 0), 1: (59_998, 0), 2: (59_998, 2), 3: (39_998, 3)}


def test_near_duplicates_edges(spark, none):
    assert near_dup.near_duplicates(none).columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    assert near_dup.near_duplicates(none).collect() == []
    rows = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (2, "a b c"), (9, None), (8, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(rows).collect())
    assert got == [(2, 2, True), (3, 2, False), (3, 2, False), (8, 8, True), (9, 9, True)]


@pytest.mark.parametrize("n", [2, 64, 400])
def test_components_of_chains(spark, n, monkeypatch):
    """Ids that rise from both ends to the middle are the slow case for passing on minima; rounds stay logarithmic."""
    rounds = []
    cut = components.cut_in_loop
    monkeypatch.setattr(components, "cut_in_loop", lambda df: rounds.append(1) or cut(df))
    chain = [*range(1, n + 1, 2), *range(n - n % 2, 0, -2)]
    links = spark.createDataFrame([*zip(chain, chain[1:]), (n, n), (1000, 1001), (1001, 1000)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == dict.fromkeys(range(1, n + 1), 1) | {1000: 1000, 1001: 1000}
    assert len(rounds) <= 30


def test_components_of_random_links(spark):
    rnd = random.Random(8)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)]
    parent = {x: x for p in pairs for x in p}
    for _ in range(300):
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    want = {x: parent[x] for a, b in pairs if a != b for x in (a, b)}
    assert {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == want


def test_links_across_is_exact():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 40, 30).astype(np.uint64)) for _ in range(60)]
    comp = rnd.integers(0, 5, 60)
    every = np.ones(60, dtype=bool)
    got = {tuple(sorted(p)) for p in near_dup.links_across(sets, comp, every, every, 60, 100)}
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if comp[i] != comp[j] and 100 * len(set(sets[i]) & set(sets[j])) >= 60 * len(set(sets[i]) | set(sets[j]))}
    assert got == want and want


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_bpe_matches_tiktoken(name):
    ranks = bpe.load_ranks(public_tokenizers.path(name))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, vocabulary = bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.Vocabulary(ranks)
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcdeeee  \n\t'sđß漢🙂é́,.!01<|endoftext|>") for _ in range(rnd.randint(0, 80))) for _ in range(400)]
    texts += ["", "a" * 3000, "=" * 500, " " * 300, "ab" * 700, "🙂" * 100, "<|endoftext|>"]
    for text in texts:
        ids = np.frombuffer(encoder.encode(text), dtype="<u4")
        assert ids.tolist() == reference.encode_ordinary(text)
        assert vocabulary.decode(ids, chunk=3) == text == vocabulary.decode_bytes(ids).decode()


def test_idle_workers_give_their_tables_back(monkeypatch):
    monkeypatch.setattr(W, "IDLE", 0.3)
    code = bpe._coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, False)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a text"]})
    for _ in range(3):  # tasks that follow on each other share them
        assert [b.num_rows for b in code(iter([batch]))] == [1]
        assert W.kept["bpe"]
    first = next(task := code(iter([batch, batch])))
    time.sleep(0.6)
    assert W.kept["bpe"] and next(task).equals(first)  # a task at work is not idle
    assert not list(task)
    time.sleep(0.6)
    assert not W.kept["bpe"]


def test_bpe_stream_and_full_tables(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_STATES", 5)
    monkeypatch.setattr(bpe, "KEEP_PAIRS", 5)
    transducer = bpe.Transducer(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    for piece in (b"internationalisation", b"aaaaaaaaaaaaab", b"\xff\xfe\x00"):
        assert list(transducer.stream(iter(piece))) == transducer.encode(piece) or transducer.ranks.get(piece) is not None


def test_decoder_replaces_broken_bytes():
    vocabulary = bpe.Vocabulary({b"\xf0\x9f": 0, b"\x99\x82": 1, b"a": 2, b"\xe9": 3})
    assert vocabulary.decode(np.array([0, 1, 2]), chunk=1) == "🙂a"
    assert vocabulary.decode(np.array([0, 2, 3, 0])) == b"\xf0\x9fa\xe9\xf0\x9f".decode(errors="replace")


def test_bpe_rows(docs, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = {r.doc_id: r for r in bpe.encode_decode(docs, path, public_tokenizers.PATTERN).collect()}
    for i, text, *_ in corpus():
        assert got[i].decoded == (text or "") and got[i].n_tokens == len(got[i].ids)
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert got[i].ids_sha256 == hashlib.sha256(np.array(got[i].ids, dtype="<u4").tobytes()).hexdigest()
    assert bpe.encode_decode(none, path, public_tokenizers.PATTERN).collect() == []


@pytest.mark.parametrize("size", [60, 4 << 20])
def test_substring_dedup(docs, none, monkeypatch, size):
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", size)
    words = {r[0]: SPACE.findall(r[1] or "") for r in corpus()}
    first = {}
    for i, w in words.items():
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), i), i)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    assert len(got) == len(words)
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(gone), kept)
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert gone == {k for a, b in zip(got[i].removed_from, got[i].removed_to) for k in range(a, b)}
    assert substring_dedup.substring_dedup(none).collect() == []


def test_substring_dedup_of_repeated_ids(spark, monkeypatch):
    """Rows that share an id do not count as smaller than each other; rows without one are left out; many partitions."""
    monkeypatch.setattr(substring_dedup, "PARTITION_BYTES", 100)
    run, own = " ".join(f"w{k}" for k in range(13)), " ".join(f"v{k}" for k in range(20))
    rows = [(5, run), (5, run), (5, f"a {run}"), (9, f"{run} tail"), (None, run), (7, own), (7, own), (2, None)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, part string, level int")).collect())
    assert got == [(2, 0, 0), (5, 13, 0), (5, 13, 0), (5, 14, 0), (7, 20, 0), (7, 20, 0), (9, 14, 13)]


def test_bpe_of_odd_rows(spark):
    """Null and repeated ids, null, empty and very long texts, clashing columns: a row for each row."""
    long = "Straße 漢字 🙂 1234 " * 20_000
    rows = [(None, "a"), (1, "a"), (1, "a"), (1, None), (2, ""), (3, long)]
    got = bpe.encode_decode(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_tokens int, ids string"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert sorted(((r.doc_id, r.decoded_sha256) for r in got), key=repr) == sorted(((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)


def test_substring_levels_at_most_double():
    for window in range(1, 200):
        chain = substring_dedup.lengths(window)
        assert chain[-1] == window and all(b <= 2 * a for a, b in zip(chain, chain[1:]))


def test_chat_preferences(spark):
    a = [(1, 0, "user", "hi", 9), (1, 1, "assistant", "yes <|im_end|>", 9), (1, 2, "user", None, 9), (2, 0, None, "x", 9), (None, 0, "user", "x", 9), (1, 0, "user", "hi", 9), (3, 0, "user", "only", 9)]
    b = [(1, 0, "user", "hi", 9), (1, 1, "assistant", "no", 9), (2, 0, None, "x", 9), (1, None, "user", "x", 9)]
    schema = "pair_id long, turn long, role string, text string, sides int"
    df = chat_preferences.format_preferences(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    got = sorted((r.pair_id, r.side, r.turn, r.role, r.content, r.train, r.paired) for r in df.collect())
    say = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got == [
        (1, "chosen", 1, "assistant", say("assistant", "yes < |im_end|>"), True, True),
        (1, "chosen", 2, "user", say("user", ""), False, True),
        (1, "prompt", 0, "user", say("user", "hi"), False, True),
        (1, "rejected", 1, "assistant", say("assistant", "no"), True, True),
        (2, "prompt", 0, "unknown", say("unknown", "x"), False, False),
        (3, "chosen", 0, "user", say("user", "only"), False, False),
    ]
    assert {r.content[r.train_from : r.train_to] for r in df.where("train").collect()} == {"yes < |im_end|>", "no"}
    (pair,) = chat_preferences.render(df).collect()
    assert (pair.pair_id, pair.prompt, pair.chosen, pair.rejected) == (1, say("user", "hi"), say("assistant", "yes < |im_end|>") + say("user", ""), say("assistant", "no"))
    assert [pair.chosen[x["from"] : x["to"]] for x in pair.chosen_spans] == ["yes < |im_end|>"] and [pair.rejected[x["from"] : x["to"]] for x in pair.rejected_spans] == ["no"]
    empty = spark.createDataFrame([], schema)
    assert chat_preferences.format_preferences(empty, empty).collect() == []


def test_stale_preferences(spark, monkeypatch):
    """Pairs of a very long conversation, one without an answer, one that ends with the refusal, with turns after it, repeated rows, empty and long texts, clashing columns."""
    from factloom.llm import scratch

    monkeypatch.setattr(scratch, "SHARE", 3)
    long = [(1, k, "assistant" if k % 2 else "user", f"m{k} " * (20_000 if k == 3 else 1)) for k in range(200)]
    rows = [*long, (2, 0, "user", "hi"), (3, 0, "user", ""), (3, 1, "assistant", chat_preferences.REFUSAL), (4, 0, "user", "q"), (4, 1, "assistant", chat_preferences.REFUSAL), (4, 2, "user", "why"), (5, 0, "assistant", None), (5, 0, "assistant", None), (None, 0, "user", "x"), (6, 0, "user", "u"), (6, 1, "assistant", "a"), (6, 1, "assistant", "b"), (6, 2, "user", "z")]
    df = chat_preferences.stale_preferences(spark.createDataFrame([(*r, 1, "s", 2) for r in rows], "conv_id long, turn int, role string, text string, n int, side string, last int"))
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.pair_id, r.side, r.turn, r.content)):
        got.setdefault((r.pair_id, r.paired), {}).setdefault(r.side, []).append(r.content[len(f"<|im_start|>{r.role}\n") : -len("<|im_end|>\n")])
    assert got.pop((1, True)) == {"prompt": [t for *_, t in long[:-1]], "chosen": ["m199 "], "rejected": [chat_preferences.REFUSAL]}
    assert got == {
        (2, False): {"prompt": ["hi"]},
        (3, False): {"prompt": ["", chat_preferences.REFUSAL]},
        (4, False): {"prompt": ["q", chat_preferences.REFUSAL], "chosen": ["why"]},
        (5, True): {"chosen": [""], "rejected": [chat_preferences.REFUSAL]},
        (6, True): {"prompt": ["u"], "chosen": ["a", "b", "z"], "rejected": [chat_preferences.REFUSAL]},
    }


LANGS = {"aa": "the house and the mouse with the other mother", "bb": "der hund und die katze sind nicht hier geworden", "cc": "que los años son como las olas del mar español"}


def labelled(spark, n=240):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        lang = sorted(LANGS)[i % 3]
        text = " ".join(rnd.choice(LANGS[lang].split()) + rnd.choice(["", "ing", "es", "t"]) for _ in range(60))
        bad = i % 4 == 0
        rows.append((i, text + (". you total IDIOTa fool. " if bad else ". all fine. ") + text, lang, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def test_language_id(spark, none):
    docs = labelled(spark)
    model = language_id.fit(docs)
    more = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(900, None, "aa"), (901, "12 34 !!", None), (902, "", "bb"), (903, "".join(random.Random(9).choices("абвгдежзиклмнопрстуфхцчшщэюя ", k=600)), None), (None, "the house", "aa"), (904, "a", None)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in language_id.predict(more, model, {"doc_id": "long"}).collect()}
    assert all(got[r.doc_id].lang_pred == r.lang and not got[r.doc_id].rejected for r in docs.collect())
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].rejected and got[903].lang_pred in LANGS and not got[904].rejected and len(got) == 246
    assert language_id.predict(none, model, {"doc_id": "long"}).collect() == []
    nothing = language_id.predict(docs, language_id.fit(none.select("doc_id", "text", "lang")), {"doc_id": "long"})
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_language_id_judges_short_texts(spark):
    """Texts of few trigrams in a script that no training text has go, short clean ones and long ones of few words stay."""
    docs = labelled(spark).select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    far = ["Сегодня хорошая погода, мы идём гулять", "Привет", "今天天气很好。", "我们去公园散步吧", "Καλημέρα σας", "안녕하세요"]
    own = [" ".join(words.split()[k : k + 3]) for words in LANGS.values() for k in range(0, 6, 2)] + [" ".join(LANGS["aa"].split()[:2] * 300), "a"]
    rows = spark.createDataFrame(list(enumerate(far + own)), "doc_id long, text string")
    got = {r.doc_id: r.rejected for r in language_id.predict(rows, model, {"doc_id": "long"}).collect()}
    assert [got[k] for k in range(len(far))] == [True] * len(far)
    assert not any(got[k] for k in range(len(far), len(far + own)))


def brute_language(text, model):
    """Language and cosine of a text, trigram by trigram."""
    data = b" " + (text or "").encode() + b" "
    folded = [c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalpha() else c for c in data]
    counts = np.zeros(language_id.DIMENSIONS)
    for a, b, c in zip(folded, folded[1:], folded[2:]):
        if not (b == 32 and 32 in (a, c)):
            counts[((a * 2654435761 + b * 2246822519 + c * 3266489917) % 2**32) >> 20] += 1
    vector = np.log1p(counts) * model.idf
    norm = np.linalg.norm(vector)
    cosines = model.centroids @ (vector / (norm or 1))
    return model.langs[int(cosines.argmax())], float(np.clip(cosines.max(), 0, 1))


def test_language_id_by_brute_force(spark):
    """Repeated rows, null ids, a very long text and columns with clashing names."""
    docs = labelled(spark)
    model = language_id.fit(docs)
    rows = [(r.doc_id, r.text) for r in docs.limit(30).collect()]
    rows += [rows[0], (None, rows[1][1]), (None, rows[1][1]), (500, LANGS["bb"] * 20_000), (501, "The HOUSE, the 42 mice? Übergrößenträger")]
    df = spark.createDataFrame([(i, t, "x", "y", True) for i, t in rows], "doc_id long, text string, lang string, lang_pred string, rejected boolean")
    got = language_id.predict(df, model, {"doc_id": "long", "text": "string"}).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, score = brute_language(r.text, model)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4)


def test_language_id_has_a_centroid_for_each_of_many_languages(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=9)) for _ in range(3000)]
    rows = [(k, f"{w} {w[::-1]} {w}", f"l{k % 3000}") for k, w in enumerate(words + words[:100])]
    docs = spark.createDataFrame([r for r in rows for _ in range(2)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    trained = {r.lang for r in docs.where(~language_id.held_out(F.col("doc_id"))).collect()}
    assert len(trained) > 2000 and set(model.langs) == trained and len(model.langs) <= 3000


def test_language_id_learns_the_largest_of_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGS", 3)
    words = {"a": "anna banana", "b": "bobby blob", "c": "cecily coco", "d": "daddy dodo"}
    rows = [(k, f"{words[x]} {k}", x) for k, x in enumerate("aaaaaaaaaaaaaaaaaaaabbbbbbbbbbbbbbbbbbbbccccccccccccccccccccd")]
    assert set(language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs) == {"a", "b", "c"}


def test_language_id_rejection_survives_an_odd_row(spark):
    """One training row of junk does not switch rejection by distance off."""
    docs = labelled(spark).select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(k, "".join(random.Random(k).choices("абвгдежзиклмнопрстуфхцчшщэюя ", k=600)), "aa") for k in (1001, 1002)], docs.schema)
    model = language_id.fit(docs.unionByName(odd))
    far = "".join(random.Random(9).choices("αβγδεζηθικλμνξοπρστυφχψω ", k=600))
    got = language_id.predict(spark.createDataFrame([(1, far), (2, LANGS["cc"] * 5)], "doc_id long, text string"), model, {"doc_id": "long"}).collect()
    assert {r.doc_id: r.rejected for r in got} == {1: True, 2: False}


def brute_toxicity(text, model):
    """Score of a text, sentence by sentence."""
    clean = 0.0
    for sentence in re.split(r"[.!?\n]", text or ""):
        words = ALNUM.findall(fold(sentence))
        if words:
            z = model.bias
            for w in words:
                z += model.weights[W.word_hash(w.encode()) & (toxicity.BUCKETS - 1)]
                for n in toxicity.PREFIXES:
                    if len(w.encode()) >= n:
                        name = int.from_bytes(bytes([n]) + w.encode()[:n], "big") % 2**64
                        z += model.weights[int(W.mix(np.array([name], dtype=np.uint64))[0]) & (toxicity.BUCKETS - 1)]
            clean += np.logaddexp(0, np.clip(z, -30, 30))
    return 1 - np.exp(-clean)


def test_toxicity(spark, none):
    docs = labelled(spark)
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.score(docs.unionByName(spark.createDataFrame([(900, None, None, None), (901, "", None, None)], docs.schema)), model).collect()}
    held = [r for r in docs.withColumn("out", language_id.held_out(F.col("doc_id"))).where("out").collect()]
    assert held and np.mean([got[r.doc_id].predicted == r.toxic for r in held]) > 0.95
    assert all("IDIOTa" in s for r in docs.collect() if r.toxic for s in got[r.doc_id].offending)
    assert got[900].score == got[901].score == 0 and got[900].offending == []
    for r in docs.limit(40).collect():
        assert got[r.doc_id].score == pytest.approx(brute_toxicity(r.text, model), abs=1e-5)
    assert toxicity.score(none, model).collect() == []
    assert toxicity.fit(none, none.select("doc_id", F.lit(1).alias("toxic"))).bias < 0


def test_toxicity_of_odd_rows(spark):
    """Very long labelled texts train, repeated rows and labels, null ids and clashing columns do no harm, and other scripts' sentences end."""
    rnd = random.Random(7)
    filler = "a calm day with nothing else to tell. "
    rows = []
    for k in range(120):
        bad = k % 3 == 0
        rows.append((k, filler * rnd.randint(1, 6) + ("what a vilebogus remark. " if bad else "") + filler * (9000 if k < 9 else 1), int(bad)))
    rows += [rows[3], (None, filler, 0), (None, None, 1), (7, filler, None)]
    docs = spark.createDataFrame([(i, t, s, 0.5, s) for i, t, s in rows], "doc_id long, text string, toxic int, score double, predicted int")
    assert max(len(t) for _, t, _ in rows if t) > 300_000
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(r.predicted == (r.doc_id is not None and r.doc_id % 3 == 0) for r in got)
    text = "今天天气很好。你是个大笨蛋！我们去公园。"
    own = toxicity.score(spark.createDataFrame([(1, text), (2, "यह अच्छा है। वह नहीं। ठीक"), (3, "هل هذا صحيح؟ نعم۔ حسنا")], "doc_id long, text string"), model).collect()
    assert [r.n_sentences for r in own] == [3, 3, 3]


def test_toxicity_learns_in_a_script_without_spaces(spark):
    rnd = random.Random(4)
    calm = ["今天天气很好", "我们去公园散步", "晚饭非常好吃", "他昨天读了一本书"]
    rows = [(k, "。".join([*rnd.choices(calm, k=3), *(["你真是大笨蛋呀"] if k % 2 else []), rnd.choice(calm)]) + "。", k % 2) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, docs.select("doc_id", "toxic"))).collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.95


def test_licenses(spark, none):
    texts = ["Foo. Licensed under CC BY-NC 4.0. All rights reserved!", "This work is licensed under the GNU General Public License, version 3.", "general public licenses; cc  BY x cc by", None, "", "by license all the 2 0", "Released under the MIT License." + " all rights reserved" * 3, "Ünder the Apache License, Version 2.0, Licensed under the Apache License, Version 2.0"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(rows).collect()}
    for i, text in enumerate(texts):
        w = ALNUM.findall(fold(text))
        at = sorted((k, label) for p, label in licenses.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        want = (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == want
    assert [got[i].labels for i in range(8)] == ["cc-by,cc-by-nc-4.0,reserved", "gpl,gpl-3.0", "cc-by", "", "", "", "mit,reserved", "apache-2.0"]
    assert got[5].score == 0 and got[1].score == 1
    assert licenses.scan_licenses(none).collect() == []


def brute_labels(words, documents):
    """Labels of a file's words: every shift of every template at which two of the rarest words held agree, but for a drift."""
    found = set()
    for label, text, must in licenses.TEMPLATES:
        seq = text.split()
        held = sorted({w for w in seq if w in words}, key=documents)[: licenses.RARE_WORDS]
        shifts = {}
        for w in held:
            for k in (k for k, x in enumerate(seq) if x == w):
                for p in (p for p, y in enumerate(words) if y == w):
                    shifts.setdefault(p - k, set()).add(w)
        for shift in sorted(shifts):
            if len(set().union(*(shifts.get(shift + d, ()) for d in range(licenses.DRIFT + 1)))) >= min(licenses.AGREE, len(set(seq))):
                around = " " + " ".join(words[max(0, shift - licenses.DRIFT) : max(0, shift + len(seq) + 2 * licenses.DRIFT)]) + " "
                if all(f" {m} " in around for m in must):
                    found.add(label)
    return found


def test_licenses_by_brute_force(spark):
    """Notices whole, with words put in, left out or swapped, cut off, in long texts, without an id and twice; clashing columns."""
    rnd = random.Random(12)
    filler = "the of this and software license to copy public version use a fine day in may".split()
    texts = []
    for label, text, must in licenses.TEMPLATES:
        for _ in range(4):
            words = text.split()
            for _ in range(rnd.randint(0, 3)):
                k = rnd.randrange(len(words))
                words[k : k + rnd.randint(0, 1)] = rnd.choices(filler, k=rnd.randint(0, 2))
            pad = rnd.choices(filler, k=rnd.randint(0, 60)), rnd.choices(filler, k=rnd.randint(0, 60))
            texts.append(" ".join([*pad[0], *words, *pad[1]]).replace("a fine", "A-fine"))
        texts += [text.upper(), " ".join(must), " ".join(text.split()[:-3]), " ".join(reversed(text.split()))]
    texts += [" ".join(filler * 1000) + " " + licenses.TEMPLATES[0][1], texts[0]]
    rows = [(None if k % 50 == 0 else k, t, "x", 1) for k, t in enumerate(texts)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string, word int")).collect()
    docs = [ALNUM.findall(fold(t)) for t in texts]
    index = licenses.vocabulary()
    number = {h: k for k, h in enumerate(index.hashes.tolist())}
    sets = [set(d) for d in docs]
    rank = {w: (sum(w in d for d in sets), number[W.word_hash(w.encode())]) for t in licenses.TEMPLATES for w in t[1].split()}
    want = []
    for (i, *_), words in zip(rows, docs):
        base = {label for p, label in licenses.BASE_PHRASES.items() if f" {p} " in f" {' '.join(words)} "}
        want.append((i or -1, len(words), ",".join(sorted(base | brute_labels(words, rank.get)))))
    assert sorted((r.doc_id or -1, r.n_words, r.labels) for r in got) == sorted(want)
    whole = {t: label for label, t, _ in licenses.TEMPLATES}
    by_id = {r.doc_id: r.labels.split(",") for r in got}
    assert all(whole[t.lower()] in by_id[k] for k, (i, t, *_) in enumerate(rows) if i is not None and t.lower() in whole)


def brute_lines(rows, m):
    first, runs = {}, {}
    lines = {i: t.split("\n") for i, t in rows if t is not None}
    for i in sorted(lines):
        for k in range(len(lines[i]) - m + 1):
            first.setdefault(tuple(lines[i][k : k + m]), (i, k))
    for i, x in lines.items():
        gone = {k + j for k in range(len(x) - m + 1) if first[tuple(x[k : k + m])] < (i, k) for j in range(m)}
        runs[i] = (len(x), len(gone), "\n".join(s for k, s in enumerate(x) if k not in gone))
    return runs


def brute_runs(rows, m):
    """Maximal runs of later copies: (doc, start, stop, first copy's doc and line)."""
    lines = {i: t.split("\n") for i, t in rows if t is not None}
    deepest = {}
    for k in sorted({m, *(2**e for e in range(10) if 2**e >= m)}):
        first = {}
        for i in sorted(lines):
            for p in range(len(lines[i]) - k + 1):
                f = first.setdefault(tuple(lines[i][p : p + k]), (i, p))
                if f < (i, p):
                    deepest[i, p] = k, f
    runs = []
    for (i, p), (k, (fi, fp)) in sorted(deepest.items()):
        last = runs[-1] if runs else None
        if last and last["at"] == (i, p - 1) and last["of"] == (fi, fp - 1):
            last |= {"at": (i, p), "of": (fi, fp), "stop": max(last["stop"], p + k)}
        else:
            runs.append({"at": (i, p), "of": (fi, fp), "start": p, "stop": p + k, "first": (fi, fp)})
    out, reach = set(), {}
    for r in runs:
        i = r["at"][0]
        if r["stop"] > reach.get(i, 0):
            out.add((i, r["start"], r["stop"], *r["first"]))
            reach[i] = r["stop"]
    return out


@pytest.mark.parametrize("m", [1, 2, 3, 4, 5])
def test_line_dedup(spark, m):
    rnd = random.Random(m)
    texts = ["\n".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12))) for _ in range(25)] + [None, "", "\n\n\n\n", "z", "z", "q\n" * 300, "p\n" + "q\n" * 300]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "k", 1, "r") for i, t in rows], "doc_id long, text string, name string, row int, mask string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(df, min_lines=m).collect()}
    runs = brute_runs(rows, m)
    assert {tuple(r) for r in line_dedup.repeated_runs(df, min_lines=m).collect()} == runs
    for i, want in brute_lines(rows, m).items():
        mine = [b - a for d, a, b, *_ in runs if d == i]
        assert (got[i].n_lines, got[i].n_removed, got[i].text) == want
        assert (got[i].n_runs, got[i].longest_run) == (len(mine), max(mine, default=0))
    assert got[25].text is None and got[25].n_lines == 0 and got[31].shared_run == 256
    if m == 2:
        shallow = {r.doc_id: r.text for r in line_dedup.line_dedup(df, min_lines=m, depth=m).collect()}
        assert shallow == {i: r.text for i, r in got.items()}
        assert line_dedup.line_dedup(df.limit(0)).collect() == []
        with pytest.raises(ValueError):
            line_dedup.line_dedup(df, min_lines=0)


def test_line_dedup_of_odd_ids(spark):
    """Rows that share an id or have none are documents of their own, those without an id last; a repeated row is a later copy."""
    rows = [(None, "a\nb\nend"), (7, "a\nb"), (7, "a\nb"), (7, "c\nd"), (9, "a\nb\nnine"), (3, "x"), (None, None), (None, "")]
    got = [(r.doc_id, r.n_removed, r.text) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(None, 2, "end"), (7, 0, "a\nb"), (7, 2, ""), (7, 0, "c\nd"), (9, 2, "nine"), (3, 0, "x"), (None, 0, None), (None, 0, "")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_line_dedup_of_many_lines(spark):
    """Work grows with a document's lines, not with their square: alternating runs in a text of 200,000 lines."""
    lines = [f"u{k}" if k % 4 < 2 else f"dup{k % 4}" for k in range(200_000)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame([(1, "\n".join(lines)), (2, "dup2\ndup3")], "doc_id long, text string"), depth=2).collect()}
    assert got[1].n_removed == 2 * (50_000 - 1) and got[1].text.split("\n") == [x for k, x in enumerate(lines) if k < 4 or k % 4 < 2]
    assert got[2].text == ""


def test_line_dedup_of_single_lines(spark):
    """A line of more words than ``lone_words`` is a run by itself; a shorter one alone is not."""
    long, other, short = (" ".join(f"{w}{k}" for k in range(n)) for w, n in (("a", 51), ("b", 51), ("c", 50)))
    rows = [(1, f"x\n{long}\ny"), (2, f"p\n \t{long}\nq"), (3, f"p\n{long}\nq\n{short}"), (4, long), (5, f"{short}\nz\n{other}\n{other}"), (6, f"{other}\n{long}\nr"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.line_dedup(docs, lone_words=50).collect()}
    assert got == {1: (0, rows[0][1]), 2: (0, rows[1][1]), 3: (1, f"p\nq\n{short}"), 4: (1, ""), 5: (1, f"{short}\nz\n{other}"), 6: (2, "r"), 7: (0, None)}
    assert all(r.n_removed == 0 for r in line_dedup.line_dedup(docs).collect())


def test_line_dedup_of_long_runs(spark):
    """Planning stays short over many rounds; the frequent line is dealt to several tasks."""
    long = "q\n" * 2500
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame([(1, long), (2, long), (3, "x\nq\nq")], "doc_id long, text string")).collect()}
    assert [got[i].shared_run for i in (1, 2, 3)] == [2048, 2048, 2] and [got[i].n_lines for i in (1, 2, 3)] == [2501, 2501, 3]
    assert got[1].text == "q\n" and got[2].text == "" and got[3].text == "x"


@pytest.mark.parametrize("block", [1 << 24, 40])
def test_decontaminate(spark, docs, none, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    texts = [r[1] for r in corpus()]
    items = [("i1", " ".join(texts[5].split()[3:30])), ("i2", "ONE"), ("i3", None), ("i4", ""), ("i10", texts[0]), ("i2", "end"), (None, texts[6]), ("i5", "a " * 30)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = {}
    for name, text in items:
        w = ALNUM.findall(fold(text))
        for k in range(max(1, len(w) - 9) if w and name else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(name)
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    for i, text, *_ in corpus():
        w = ALNUM.findall(fold(text))
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names |= windows[tuple(w[k : k + n])]
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (len(w), len(hit), len(names), digest, bool(hit))
        assert hit == {k for a, b in zip(got[i].hit_from, got[i].hit_to) for k in range(a, b)}
    odd = spark.createDataFrame([(None, "ONE"), (4, "ONE"), (4, "ONE"), (4, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_hit) for r in decontaminate.decontaminate(odd, bench).collect()) == [(0, 1), (4, 0), (4, 1), (4, 1)]
    assert decontaminate.decontaminate(none, bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


def test_decontaminate_proximity(spark):
    """Passages with a changed, a missing or an added word are near their item, at their place; others are near none."""
    item = " ".join(f"term{k}" for k in range(30))
    words = item.split()
    texts = ["x y " + item, "x " + " ".join([*words[:5], "other", *words[6:]]), " ".join([*words[:5], *words[6:12]]), " ".join([*words[:4], "new", *words[4:10]]), " ".join(words[::-1]), " ".join(words[:5]), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = decontaminate.build_index(docs)
    bench = spark.createDataFrame([("a", item), ("a", item), ("b", "nothing of this sort stands in any of the texts here")], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.search(index, bench).collect()}
    assert [got[k].near_items for k in range(7)] == [["a"]] * 4 + [[]] * 3 and 2 in got[0].near_from and 1 in got[1].near_from
    assert [got[k].contaminated for k in range(7)] == [True, True, False, False, False, False, False]
    other = spark.createDataFrame([("c", " ".join(words[::-1]))], "item_id string, text string")
    assert [r.doc_id for r in decontaminate.search(index, other).collect() if r.contaminated] == [4]


def test_plan_of_a_large_benchmark_is_small():
    """Windows are arrays: a benchmark of 4 MB makes a plan of bounded size."""
    import pickle

    rnd = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rnd.integers(0, 50_000, 300)) for _ in range(2200)]
    assert 3.5e6 < sum(map(len, texts)) < 4.5e6
    the = decontaminate.plan([f"i{k}" for k in range(len(texts))], texts, 10)
    assert len(the.windows) == 2200 * 291 and len(pickle.dumps(the)) < 50e6


def test_exact_topk(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([-0.5, 0.1, 0.25, 0.9]) for _ in range(4)]) for i in range(120)]
    rows += [(200, None), (201, [0.1, None, 0.2, 0.3]), (202, [float("nan")] * 4), (203, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (204, [0.5, 0.5]), (250, [0.5, 0.25]), (7, [0.9] * 4), (300, [1e30, 0.0, 0.0, 0.0]), (50, [0.9] * 4), (350, [])]
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for at, (q, v) in enumerate(usable):
        if q % 50 == 0:
            ranked = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, c)))), i) for k, (i, c) in enumerate(usable) if k != at and len(c) == len(v))[:5]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(ranked, 1)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, row int")
    assert sorted(map(tuple, exact_topk.exact_topk(df).collect())) == sorted(want)
    for name, value in (("QUERY_BYTES", 50), ("TILE", 7), ("QUERY_TILE", 2), ("SHARD_TILES", 1), ("FAN_IN", 2)):
        monkeypatch.setattr(exact_topk, name, value)
    assert sorted(map(tuple, exact_topk.exact_topk(df).collect())) == sorted(want)
    assert exact_topk.exact_topk(df.limit(0)).collect() == []


def test_language_id_learns_from_every_row(spark):
    """Each training row moves the centroids, and a second fit is the same."""
    docs = labelled(spark, 60).select("doc_id", "text", "lang")
    more = spark.createDataFrame([(5000 + k, LANGS["aa"] * 3, "aa") for k in range(3000)], docs.schema)
    a, b = (language_id.fit(docs.unionByName(more).repartition(n)) for n in (2, 5))
    rare = docs.unionByName(more).where("doc_id >= 5000 or lang <> 'aa'")
    assert a.langs == b.langs and np.allclose(a.centroids, b.centroids) and np.allclose(a.short, b.short)
    assert (a.idf != language_id.fit(rare).idf).any() and not hasattr(language_id, "SAMPLE_ROWS")
