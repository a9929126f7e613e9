"""Operators on documents against brute force and on odd input."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from standlab.llm import bpe, decontaminate, language, ngram_join, quality, substring_dedup
from standlab.llm.tables import components, without_ids

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (None, "one two"), (None, None)]


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("abcdefgh") * 3
    return words


def near_copies(rng, groups=6, size=25, length=120):
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(length)]
        rows += [" ".join(edited(base, rng, rng.choice([0, 1, 1, 2, 3, 6]))) for _ in range(size)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [passage + " " + " ".join(f"w{rng.randrange(3000)}" for _ in range(80)) for _ in range(40)]
    return list(enumerate(rows, 10))


def brute_components(rows, width, num, den):
    table = {i: i + 32 for i in range(65, 91)}
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(table))
        sets[i] = frozenset(tuple(w[j:j + width]) for j in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("width,num", [(4, 85), (5, 80)])
def test_join_finds_every_component(spark, docs_of, width, num):
    rows = near_copies(random.Random(5)) + [(i, t) for i, t in ODD if i] + [(900, "ONE"), (901, "a b c"), (902, "A b C")]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in
           ngram_join.jaccard_components(docs_of(rows + [(None, "one")]), width, num, 100).collect() if r["doc_id"]}
    assert got == {(i, *v) for i, v in brute_components(rows, width, num, 100).items()}


@pytest.mark.parametrize("small", [1, 3])
def test_join_of_large_groups_finds_every_component(spark, docs_of, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "SALT", 2)
    rows = near_copies(random.Random(6), groups=3, size=30) + [(i, t) for i, t in ODD if i]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs_of(rows)).collect()}
    assert got == {(i, *v) for i, v in brute_components(rows, 4, 85, 100).items()}


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 62, k, dtype=np.uint64) for k in (1, 3, 500, 2000, 5000)]
    sets += [rng.integers(0, 1 << 62, k, dtype=np.uint64) for k in (3, 520, 2100, 4900)]
    sets += [np.concatenate([s[len(s) // 10:], rng.integers(0, 1 << 62, len(s) // 9, dtype=np.uint64)]) for s in sets[2:5]]
    n = np.array([len(s) for s in sets])
    sketch, folded = ngram_join.sketches(np.repeat(np.arange(len(sets)), n), np.concatenate(sets), n)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            apart = ngram_join.sketch_distance([sketch[i]], [sketch[j]])[0]
            assert np.bitwise_count((folded[i] ^ folded[j]).view(np.uint64)).sum() <= apart <= len(np.setxor1d(x, y))
            if i < 9 and j < 9 and i != j and min(n[i], n[j]) > 400 and 100 * min(n[i], n[j]) >= 85 * max(n[i], n[j]):
                assert apart * 185 > (n[i] + n[j]) * 15  # unrelated sets of like size are told apart


def test_rarity_tells_counts_about_the_mean_apart():
    for mean in (6, 30, 1800):
        cells = np.array([mean - 2 * mean**0.5, mean, mean + 2 * mean**0.5])
        assert (np.diff(ngram_join.rarity_class(cells).astype(int)) > 0).all()


def test_join_of_nothing_and_one_per_component(spark, docs_of):
    assert ngram_join.jaccard_components(docs_of([])).collect() == []
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, None), (4, "A B c d e f"), (None, "a b c d e f")]
    kept = ngram_join.one_per_component(docs_of(rows))
    assert kept.columns == docs_of([]).columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, "a b c d e f"), (1, "a b c d e f"), (2, "")]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, **{100 + i: 100 for i in range(1, 20)}}


def test_without_ids_keeps_rows_without_id(spark, docs_of):
    ids = spark.createDataFrame([(4,), (5,)], "doc_id long")
    assert sorted(r["doc_id"] or 0 for r in without_ids(docs_of(ODD), ids).collect()) == [0, 0, 1, 2, 3]


def brute_removed(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    places = defaultdict(list)
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            places[tuple(w[i:i + window])].append((d, i))
    gone = [set() for _ in rows]
    for at in places.values():
        if len(at) > 1:
            for d, i in at:
                gone[d].update(range(i, i + window))
    return [([x for j, x in enumerate(w) if j not in g], len(w), len(g)) for w, g in zip(words, gone)]


@pytest.mark.parametrize("window", [35, 6, 1])
def test_substrings_against_brute_force(spark, docs_of, window):
    rng = random.Random(window)
    words = [f"v{i}" for i in range(200)]
    passages = [[rng.choice(words) for _ in range(rng.choice([20, 35, 36, 60, 90]))] for _ in range(8)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(words) for _ in range(rng.randrange(50))] + rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(parts)))
    rows += [*ODD, (77, "z " * 90), (78, rows[5][1]), (78, rows[5][1])]
    want = sorted((str(i), n, g, hashlib.sha256(" ".join(k).encode()).hexdigest())
                  for (i, _), (k, n, g) in zip(rows, brute_removed(rows, window)))
    got = substring_dedup.remove_repeats(docs_of(rows), window, digest=True).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    texts = substring_dedup.remove_repeats(docs_of(rows), window).collect()
    assert sorted((str(r["doc_id"]), hashlib.sha256(" ".join(WORD.findall(r["text"] or "")).encode()).hexdigest())
                  for r in texts) == sorted((i, h) for i, _, _, h in want)
    assert {r["part"] for r in texts} == {"x"} and {r["id"] for r in texts} == {5}
    assert substring_dedup.remove_repeats(docs_of([])).count() == 0


def test_spans_and_cut_text(spark, docs_of):
    passage = " ".join(f"k{i}" for i in range(6))
    rows = [(1, f"Alpha\nbeta {passage}\n gamma"), (2, f"{passage} delta")]
    got = {r["doc_id"]: (r["spans"], r["text"]) for r in substring_dedup.remove_repeats(docs_of(rows), 6).collect()}
    assert got == {1: ([[2, 8]], "Alpha\nbeta gamma"), 2: ([[0, 6]], "delta")}


def test_quality_keeps_good_and_drops_bad(spark, docs_of):
    rng = random.Random(3)
    good = [(i, " ".join(rng.choice(["the", "river", "runs", "and", "house", "tree"]) for _ in range(rng.randrange(5, 60)))) for i in range(200)]
    bad = [(i, " ".join(rng.choice(["$$$", "BUY!!", "###"]) for _ in range(40))) for i in range(200, 240)]
    labels = spark.createDataFrame([(i, int(i < 200), None) for i in range(0, 240, 3)] + [(1, 0, 0), (1, 1, 0), (2, None, 1), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    out = quality.resample(docs_of(good + bad), labels)
    chosen = {r["doc_id"] for r in out.filter("selected").collect()}
    assert len(chosen & set(range(200))) >= 197 and not chosen & set(range(200, 240))
    assert out.columns == [*docs_of([]).columns, "log_ratio", "gumbel_key", "selected"]
    again = quality.resample(docs_of(good + bad), labels, share=0.25)
    assert again.filter("selected").count() == 60


def test_quality_on_odd_input(spark, docs_of):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.resample(docs_of(ODD), empty).filter("selected").count() == len(ODD)
    assert quality.resample(docs_of([]), empty).count() == 0
    one = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.resample(docs_of(ODD), one).collect()
    assert len(rows) == len(ODD) and all(r["log_ratio"] == 0 for r in rows if not (r["text"] or "").strip())


def test_importance_is_the_log_ratio_of_the_two_models(spark, docs_of):
    rows = [(1, "a b a"), (2, "c c")]
    target, raw = quality.bucket_counts(docs_of(rows).selectExpr("text", "doc_id = 1 AS good"), 1 << 10)
    assert target.sum() == 5 and raw.sum() == 8
    weights = quality.log_ratios(target, raw)
    doc, bucket = quality.features([b"a b a"], 1 << 10)
    got = docs_of(rows).select(quality.importance(spark, weights)("text").alias("w")).first()["w"]
    assert got == pytest.approx(weights[bucket].sum())


def bm25(items, passage, threshold):
    """Normalised scores of all items, by definition."""
    words = {i: decontaminate._plain(t).decode().lower().split() for i, t in items}
    words = {i: w for i, w in words.items() if w}
    df = Counter(x for w in words.values() for x in set(w))
    mean = sum(map(len, words.values())) / len(words)
    out = {}
    for i, w in words.items():
        tf, total, hit = Counter(w), 0.0, 0.0
        for x, f in tf.items():
            idf = np.log1p((len(words) - df[x] + 0.5) / (df[x] + 0.5))
            s = idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean))
            total += s
            hit += s * (x in passage)
        out[i] = hit / total
    return {i for i, s in out.items() if s >= threshold}


def test_wand_retrieves_what_scores_above_the_threshold(spark):
    rng = random.Random(9)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 12)))) for i in range(80)] + [(80, ""), (81, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    index, = decontaminate._shards(bench)
    for _ in range(40):
        passage = {rng.choice(vocabulary) for _ in range(rng.randrange(1, 30))}
        hashes = decontaminate.Words([" ".join(passage).encode()]).hashes[0]
        terms = np.unique(index.terms(hashes)[index.terms(hashes) >= 0])
        found = {int(index.ids[k]) for k, _ in index.search(terms.tolist(), 0.5)}
        assert found == bm25([x for x in items if x[1]], passage, 0.5)


def test_leaks_are_found_and_other_texts_left(spark, docs_of):
    rng = random.Random(4)
    say = lambda n: " ".join(f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.randrange(40)}" for _ in range(n))
    items = [(i, f"{say(12)}? {say(6)}." if i % 2 else f"{say(9)}. {say(4)}. {say(7)}") for i in range(30)] + [(98, None), (99, "?!")]
    rows = [(50 + i, f"{say(70)} {items[i][1].upper()} {say(150)}") for i in range(10)] + [(60 + i, say(200)) for i in range(20)]
    rows += [(40, items[3][1].split("?")[0]), (41, items[4][1]), (41, items[4][1]), *ODD]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs_of(rows), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == sorted([(50 + i, i) for i in range(10)] + [(41, 4)])
    left = decontaminate.without_leaks(docs_of(rows), bench)
    assert left.count() == len(rows) - 12 and left.columns == docs_of([]).columns
    assert decontaminate.contaminated(docs_of(rows), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs_of([]), bench).count() == 0


def test_question_and_answer():
    assert decontaminate.question_and_answer("Who? Me. You.") == ("Who?", " Me. You.")
    assert decontaminate.question_and_answer("One. Two. Three.") == ("One. Two.", " Three.")
    assert decontaminate.question_and_answer("One.") == ("One.", "")


def test_language_held_out_accuracy(spark):
    out = language.op2_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = [r["lang"] == r["lang_pred"] for r in out.filter("held_out").join(docs, "doc_id").collect()]
    assert sum(right) >= 0.95 * len(right) > 100


def test_language_on_odd_input(spark, docs_of):
    content = {"en": b"the and of that with from", "fr": "le la les été où de des".encode()}
    rows = [*ODD, (9, "123 !!"), (10, "LES LES de des été"), (11, "The and the of that")]
    got = {r["doc_id"]: r["p"] for r in docs_of(rows).select("doc_id", language.identify(spark, content)("text").alias("p")).collect()}
    assert [got[i]["lang"] for i in (1, 2, 3, 9, 10, 11)] == ["und"] * 4 + ["fr", "en"]
    assert all(0 <= p["score"] <= 1 for p in got.values())
    assert docs_of(rows).select(language.identify(spark, {})("text").alias("p")).filter("p.lang = 'und'").count() == len(rows)
    assert language.dictionaries(spark.createDataFrame([], "text string, lang string")) == {}


def test_language_sample_counts_a_text_once(spark):
    texts = ["word" + "abcdefghij"[i] * 3 for i in range(10)]
    rows = [(t, "en") for t in texts for _ in range(50)] + [("1 2 3 " * 400 + "behind", "xx"), (None, "xx"), ("4", "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    content = language.dictionaries(df, sample=10)
    assert sorted(content["en"].decode().split()) == texts and content["xx"] == b"behind"
    assert len(set(language.dictionaries(df, sample=4)["en"].decode().split())) == 4
    assert language.dictionaries(df, sample=10, each=5)["xx"] == b"behin"


@pytest.fixture(scope="module")
def coder():
    with open(bpe.tokenizer_path(), encoding="utf-8") as file:
        return bpe.Encoder(json.load(file))


def test_bpe_equals_the_library(coder):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.tokenizer_path())
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzABC'ÉÈéñßİΣσς0123½²!?<>|.,-_ ​\t\n日本語한국🎉ǄÅé\x00\x1f\x85"
    syllables = ["th", "in", "an", "er", "on", "re", "he", "ing", "the", "tion", "ab", "s", "es", "ed"]
    texts = ["", " ", "<|endoftext|>a<|startoftext|> b", "a" * 3000, "aab" * 500, "!" * 300, "don't I'LL we'd",
             *["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(800)],
             *["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]]
    for text, want in zip(texts, own.encode_batch(texts, add_special_tokens=False)):
        ids = coder.encode(text)
        assert ids == want.ids
        assert coder.decode(ids).decode() == own.decode(ids, skip_special_tokens=False)
    assert coder.encode(None) == [] and coder.decode([]) == b""


def test_bpe_digest_equals_ids_and_text(spark, docs_of):
    texts = ["", None, "Hello  world", "x<|endoftext|>y  z", "naïve ﬁne Σίσυφος 🙂 1234567", "a " * 300]
    docs = docs_of(list(enumerate(texts)))
    path = bpe.tokenizer_path()
    both = docs.select("doc_id", bpe.coder(spark, path)("text").alias("e"), bpe.coder(spark, path, digest=True)("text").alias("d"))
    for r in both.collect():
        assert r["e"]["n_tokens"] == r["d"]["n_tokens"] == len(r["e"]["ids"])
        assert r["d"]["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["e"]["ids"])).encode()).hexdigest()
        assert r["d"]["decoded_sha256"] == hashlib.sha256(r["e"]["decoded"].encode()).hexdigest()


def test_bpe_tasks_do_not_merge_the_vocabulary_again(monkeypatch):
    config = json.load(open(bpe.tokenizer_path()))
    never = bpe.Encoder(config).never
    monkeypatch.setattr(bpe.Encoder, "_merged", None)
    assert bpe.Encoder(config, never).encode("whole words and zxqjvkw") == bpe.Encoder(config, never).encode("WHOLE words and zxqjvkw")


def test_bpe_column(spark, docs_of):
    rows = docs_of(ODD).select("doc_id", bpe.coder(spark, bpe.tokenizer_path())("text").alias("e"), "part").collect()
    assert len(rows) == len(ODD) and [r["e"]["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)] == [0, 0, 0]
    assert {r["e"]["decoded"] for r in rows if r["doc_id"] in (4, 5)} == {"one</w>"}
    assert docs_of([]).select(bpe.coder(spark, bpe.tokenizer_path())("text")).count() == 0
