"""SimHash groups, collocations and hard negatives against brute force, on odd tables."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

from standlab.llm import collocations, hard_negatives, simhash

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
SCHEMA = "doc_id long, text string, lang string, fp long, n int, id int"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, None, 1, 2) for r in rows], SCHEMA)


# -- op11 -----------------------------------------------------------------------------------

def _prints(texts, width=4):
    out = []
    for text in texts:
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(UPPER)) if w]
        grams = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return np.array(out, np.uint64)


def _components(prints, distance=4):
    label = list(range(len(prints)))
    for i, j in combinations(range(len(prints)), 2):
        if int(prints[i] ^ prints[j]).bit_count() <= distance and label[i] != label[j]:
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    return label


def test_simhash_equals_brute_force_on_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 500, 400)]
    rows = [(1, None, "en"), (2, "", None), (3, " \t\n", "en"), (4, "one two", "en"), (5, "ONE  two", "en"), (5, "other words", "en"),
            (None, "ONE two", "en"), (6, "É é É é", "fr"), (7, "x " * 50_000, "en"), (8, "X\x0bx " * 25_000, "en")]
    for i in range(60):
        words = list(base)
        for at in rng.integers(0, len(words), i % 4):
            words[at] = "changed"
        rows.append((100 + i, " ".join(words), "en"))
    prints = _prints([r[1] for r in rows])
    label = _components(prints)
    low = {k: min([r[0] for r, x in zip(rows, label) if x == k and r[0] is not None], default=None) for k in set(label)}
    want = sorted(((r[0], f"{int(p):016x}", low[k]) for r, p, k in zip(rows, prints, label)), key=str)
    assert len(set(label)) < len(rows) - 20
    for limit in (simhash.LIMIT, 2):
        got = simhash.simhash_components(_docs(spark, rows), limit=limit).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    assert simhash.simhash_components(_docs(spark, [])).count() == 0


def test_simhash_finds_every_link_of_random_prints(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = centres[rng.integers(0, 40, 1500)].copy()
    for _ in range(4):
        prints ^= np.uint64(1) << rng.integers(0, 64, len(prints)).astype(np.uint64)
    prints = np.unique(prints)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    for limit in (simhash.LIMIT, 5):
        links = simhash.links(df, 4, limit).collect()
        at = {int(x): i for i, x in enumerate(prints.view(np.int64))}
        a, b = (np.array([at[r[k]] for r in links]) for k in (0, 1))
        got = simhash.roots(len(prints), a, b)
        near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
        i, j = np.nonzero(near)
        assert np.array_equal(got, simhash.roots(len(prints), i, j))


def test_manhattan_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    counts = lambda x: np.array([np.bitwise_count(x >> np.uint64(2 * s) & np.uint64(3)) for s in range(32)], int)
    manhattan = np.abs(counts(a) - counts(b)).sum(axis=0)
    assert np.array_equal(np.bitwise_count(simhash.embedding(a) ^ simhash.embedding(b)), manhattan)
    assert (manhattan <= np.bitwise_count(a ^ b)).all()


def test_large_cells_are_met_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 500)
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 256, 300).astype(np.uint64)
    a, b = simhash.cell_links(prints, np.zeros(300, np.int64), 2)
    i, j = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2)
    assert np.array_equal(simhash.roots(300, a, b), simhash.roots(300, i, j))


# -- op12 -----------------------------------------------------------------------------------

def _phrases(rows, top=2000, least=10, within=50):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i:i + size])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            cuts = []
            for k in range(1, len(p)):
                l, r = f[lang, p[:k]], f[lang, p[k:]]
                cuts.append((1_000_000 * a * a // (l * r), k, l, r))
            longer = [c for (g, q), c in f.items() if g == lang and len(q) == 3 and len(p) == 2 and c >= least and p in (q[:2], q[1:])]
            if not any(100 * c >= within * a for c in longer):
                found.setdefault(lang, []).append((-min(cuts)[0], -a, " ".join(p).encode(), *min(cuts)[2:]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, some in found.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(some)[:top]))


@pytest.mark.parametrize("head,ranked", [(collocations.HEAD, collocations.PAIRS), (3, 2), (0, 1)])
def test_collocations_equal_brute_force_with_and_without_ids(spark, head, ranked):
    rng = np.random.default_rng(7)
    words = ["Alpha", "beta", "GAMMA", "été", "dé", "x\x00y", " ", "delta"]
    rows = [(1, None, "en"), (2, "", None), (3, " .,\t;!", "en")]
    for i in range(300):
        some = [words[k] for k in np.minimum(rng.geometric(0.3, 30), len(words)) - 1]
        rows.append((i, " ".join(w + rng.choice(["", "", ".", "\t", "\n"]) for w in some), [None, "en", "und", "fr"][i % 4]))
    rows += [(9, "over and over " * 400, "en")] * 2
    want = _phrases(rows, top=15)
    got = collocations.collocations(_docs(spark, rows), top=15, head=head, ranked=ranked).collect()
    assert sorted(tuple(r) for r in got) == want and want
    assert collocations.collocations(_docs(spark, [])).count() == 0


def test_collocations_of_long_texts_by_pieces(spark, monkeypatch):
    rows = [(1, "a b c d e, f g " * 500, "en"), (2, "no gap" * 300 + " a b c", "en")]
    want = _phrases(rows)
    monkeypatch.setattr(collocations, "PIECE", 64)
    for head in (2, 100):
        got = collocations.collocations(_docs(spark, rows), head=head).collect()
        assert sorted(tuple(r) for r in got) == want


def test_collocations_split_each_text_once(spark, monkeypatch, tmp_path):
    split, seen = collocations.pieces, str(tmp_path / "seen")

    def noted(text, size):
        with open(seen, "a") as f:
            f.write(f"{len(text)}\n")
        return split(text, size)

    rows = [(i, "one two three. four " * 5 + f"five{i % 3} six", ["en", "de"][i % 2]) for i in range(120)] + [(1, None, None), (2, "", "en")]
    monkeypatch.setattr(collocations, "pieces", noted)
    got = collocations.collocations(_docs(spark, rows), head=3, ranked=2).collect()
    assert sorted(tuple(r) for r in got) == _phrases(rows)
    texts = sum(len(t or "") for _, t, _ in rows)
    assert texts <= sum(map(int, open(seen))) <= texts + len(rows)


def test_tiles_count_dense_and_sparse_addresses(monkeypatch):
    monkeypatch.setattr(collocations, "SIDE", 4)
    monkeypatch.setattr(collocations, "FULL", 3)
    rng = np.random.default_rng(1)
    tiles = collocations.Tiles(40, 30)
    left, right = np.minimum(rng.geometric(0.1, 3000), 60) - 1, np.minimum(rng.geometric(0.1, 3000), 30) - 1
    for i in range(0, 3000, 500):
        tiles.add(left[i:i + 500], right[i:i + 500])
        tiles.count()
    assert tiles.dense
    keys, counts = tiles.out()
    want = Counter((left << collocations.BITS | right).tolist())
    assert dict(zip(keys.tolist(), counts.tolist())) == want and (np.diff(keys) > 0).all()


# -- op13 -----------------------------------------------------------------------------------

def _negatives(rows, anchor, positives=5, negatives=10):
    use = [(i, x, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v, x in rows
           if i is not None and x is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for i, x, v in use:
        if anchor(i):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j, y) for j, y, w in use if j != i and len(w) == len(v))
            for s, j, y in [r for r in scored if r[2] == x][:positives]:
                fit = [r for r in scored if r[2] != x and 30 * -s <= 100 * -r[0] <= 90 * -s][:negatives]
                out += [(i, j, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block,size,members", [(1024, 8192, 128), (3, 17, 4)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, size, members):
    for name, value in (("BLOCK", block), ("SLICE", size), ("MEMBERS", members), ("STEP", 16)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(11)
    rows = [(1000 + i, (rng.normal(size=6) * rng.choice([0.01, 1, 3]) + 0.4).tolist(), int(rng.integers(0, 4))) for i in range(300)]
    rows += [(5, None, 1), (10, [], 1), (15, [], 2), (20, [0.0] * 6, 1), (25, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (None, [1.0] * 6, 1),
             (30, [float("nan")] * 6, 1), (35, [float("inf")] * 6, 2), (40, [1.0, 2.0], 1), (41, [1.0, 2.0], 1), (42, [0.5, 1.0], 3),
             (45, [1.0] * 6, None), (50, [1.0] * 6, 2), (50, [1.0] * 6, 2), (50, [-1.0] * 6, 1)]
    df = spark.createDataFrame([(*r, 3, "s") for r in rows], "vec_id long, embedding array<float>, label int, no int, slice string")
    got = hard_negatives.hard_negatives(df, lambda i: i % 5 == 0).collect()
    want = _negatives(rows, lambda i: i % 5 == 0)
    assert sorted(tuple(r) for r in got) == want and len(want) > 500
    assert hard_negatives.hard_negatives(df.limit(0), lambda i: i % 5 == 0).count() == 0


def test_walk_ends_where_the_bound_certifies():
    rng = np.random.default_rng(0)
    c = np.floor(rng.normal(size=(4000, 3)) * 50)
    c = c[np.argsort(-np.linalg.norm(c, axis=1))]
    bound = np.linalg.norm(c, axis=1)
    seen = []
    real = hard_negatives.products
    try:
        hard_negatives.products = lambda a, b: seen.append(len(b)) or real(a, b)
        a = np.floor(rng.normal(size=(4, 3)) * 50)
        whole = [np.full((4, 1), x) for x in (hard_negatives.NONE, hard_negatives.NEVER, hard_negatives.NONE)]
        i, _, found, score = hard_negatives.walk(a, np.full(4, -1), c, bound, np.arange(4000), *whole, 5)
    finally:
        hard_negatives.products = real
    assert sum(seen) < 4000
    for row in range(4):
        best = sorted((-int(s), k) for k, s in enumerate(c @ a[row]))[:5]
        assert [(int(-s), int(k)) for s, k in zip(score[i == row], found[i == row])] == best
