import random

import numpy as np
import pytest
import xxhash

from brinemark.llm.common import Scratch
from brinemark.llm.near_dedup import components, keep_one, links, majority, masks, near_groups, op9_simhash_dedup


def brute_fp(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode()
    w = t.split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))


def brute_components(items, linked):
    low = list(range(len(items)))
    root = lambda i: i if low[i] == i else root(low[i])
    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = root(i), root(j)
                low[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(items))]


def test_every_near_pair_meets_under_a_mask():
    r = random.Random(1)
    for radius in (1, 2, 3, 4):
        for level in (0, 1, 3):
            m = [x % (1 << 64) for x in masks(radius, level)]
            assert len(m) == 2 ** (radius + 1) - 1
            for _ in range(500):
                d = sum(1 << i for i in r.sample(range(64), radius))
                assert any(not d & x for x in m)


@pytest.mark.parametrize("small", [2, 24])
def test_links_equal_all_pairs(spark, small):
    r = random.Random(small)
    centres = [r.getrandbits(64) for _ in range(5)]
    fps = {c ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 3))) for c in centres for _ in range(40)} | {r.getrandbits(64) for _ in range(50)}
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(0, x) for x in fps], "grp int, fp long")
    got = {(x.a, x.b) for x in links(Scratch(spark, "t"), df, 2, small).collect()}
    want = {(min(x, y), max(x, y)) for x in fps for y in fps if x < y and bin((x ^ y) % (1 << 64)).count("1") <= 2}
    assert got == want and len(want) > 100


def test_components_of_a_long_chain(spark):
    r = random.Random(2)
    names = r.sample(range(10**6), 300)
    edges = [(names[i], names[i + 1]) for i in range(299) if i != 150]
    got = {x.node: x.root for x in components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(names[:151] if i < 151 else names[151:]) for i, n in enumerate(names)}


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(9)
    vocabulary = ["sea", "Level", "ÉTÉ", "été", "a", "b", "warm", "x\ty"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 40))) for _ in range(60)]
    texts += [t + " tail" for t in texts[:30]] + [t.upper() for t in texts[:5]] + [None, "", "one", "one two"]
    rows = [(i * 3 + 1, t, "x") for i, t in enumerate(texts)] + [(2, texts[3], "y"), (None, texts[4], "y"), (1, texts[0], "x")]
    spark.createDataFrame(rows, "doc_id long, text string, fp string").write.parquet(str(tmp_path / "documents.parquet"))
    out = op9_simhash_dedup(spark, str(tmp_path)).collect()
    rows.sort(key=lambda x: (x[0] is None, x[0] or 0))
    fps = [brute_fp(t) for _, t, _ in rows]
    root = brute_components(fps, lambda a, b: bin(a ^ b).count("1") <= 2)
    want = sorted((str(d), f"{f:016x}", rows[k][0]) for (d, _, _), f, k in zip(rows, fps, root, strict=True))
    assert sorted((str(x.doc_id), x.fingerprint, x.component_id) for x in out) == want
    assert near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert majority(np.array([1, 3], np.uint64)) == 1


def test_one_of_each_group_stays(spark, tmp_path):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    base = [[word() for _ in range(200)] for _ in range(30)]
    rows = [(i, " ".join(w), None) for i, w in enumerate(base)]
    for g in range(8):
        for c in range(6):
            w = list(base[g])
            for i in r.sample(range(200), c % 4):
                w[i] = word()
            rows.append((100 + g * 10 + c, " ".join(w) if c else " ".join(w).upper(), "copy"))
    rows += [(900, None, "n"), (901, "", "n"), (None, "short text", "n"), (7, rows[7][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep string")
    for frame in (df, None):
        if frame is None:
            df.write.parquet(str(tmp_path / "d"))
            frame = spark.read.parquet(str(tmp_path / "d"))
        kept = keep_one(frame)
        assert kept.columns == df.columns
        ids = [x.doc_id for x in kept.collect()]
        assert sum(i is not None and 8 <= i < 30 for i in ids) == 22
        assert sum(i in (900, 901) for i in ids) == 1 and None in ids
        for g in range(8):
            assert sum(i == g or i is not None and 100 + g * 10 <= i < 110 + g * 10 for i in ids) == 1
    assert keep_one(df.limit(0)).count() == 0


def brute_kept(texts):
    """The number of groups, and the group of each text, by all pairs of sets of five-word shingles."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    root = brute_components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    return len(set(root)), root


def test_revision_chains_keep_one(spark):
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    texts = []
    for _ in range(20):
        w = [word() for _ in range(300)]
        for _ in range(10):
            texts.append(" ".join(w))
            for i in r.sample(range(300), 4):
                w[i] = word()
    n, root = brute_kept(texts)
    kept = [x.doc_id for x in keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    assert n == 20 and sorted(root[i] for i in kept) == sorted(set(root))


def test_appended_cut_and_replaced_texts_near_the_limit(spark):
    r = random.Random(47)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(3000)]
    prose = lambda n: [vocabulary[min(int(r.paretovariate(0.7)), 3000) - 1] for _ in range(n)]
    texts = []
    for n in (60, 150, 300, 1000):
        for _ in range(12):
            w = prose(n)
            texts += [" ".join(w), " ".join(w + prose(n // 5))]
            w = prose(n)
            texts += [" ".join(w), " ".join(w[: n - n // 6])]
            w = prose(n)
            texts += [" ".join(w), " ".join("changed" if i % 50 == 20 else x for i, x in enumerate(w))]
    n, root = brute_kept(texts)
    kept = [x.doc_id for x in keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    assert n < len(texts) - 100 and sorted(root[i] for i in kept) == sorted(set(root))


def test_every_pair_of_each_similarity_band(spark):
    r = random.Random(71)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    bands = {60: 2, 59: 1, 52: 1, 44: 1, 32: 1, 29: 1, 12: 1, 6: 1}  # words cut of 300: similarity 0.797, 0.801 … 0.98; rows that stay
    rows = []
    for cut in bands:
        for _ in range(60):
            w = [word() for _ in range(300)]
            rows += [(cut, " ".join(w)), (cut, " ".join(w[cut:]))]
    kept = keep_one(spark.createDataFrame([(i, t, c) for i, (c, t) in enumerate(rows)], "doc_id long, text string, cut int"))
    assert {x["cut"]: x["count"] for x in kept.groupBy("cut").count().collect()} == {c: 60 * n for c, n in bands.items()}


def test_links_of_rows_that_left(spark):
    r = random.Random(72)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    texts, copy = [], lambda n: [word() for _ in range(n)]
    for _ in range(30):  # A twice; A and x link, x and y link, A and y don't
        w = copy(300)
        texts += [" ".join(w), " ".join(w), " ".join(w[30:]), " ".join(w[62:])]
    for _ in range(30):  # chains of cuts
        w = copy(300)
        texts += [" ".join(w)] + [" ".join(w[13 * i :]) for i in range(7)]
    n, root = brute_kept(texts)
    kept = [x.doc_id for x in keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    assert n == 60 and sorted(root[i] for i in kept) == sorted(set(root))


def test_bitmaps_drop_no_similar_pair(spark):
    from brinemark.llm.near_dedup import parities, plausible

    r = np.random.default_rng(2)
    sets = []
    for n in [1, 2, 5, 40, 63, 64, 65, 80, 127, 128, 129, 500, 1000, 1030]:
        base = r.integers(-(2**63), 2**63 - 1, n)
        sets += [base, *[np.concatenate([base[int(n * x) :], r.integers(-(2**63), 2**63 - 1, int(n * y))]) for x, y in ((0.05, 0), (0.19, 0), (0.1, 0.1), (0, 0.2), (0.3, 0.3), (0.9, 0.9))]]
    rows = [(i, len(s), parities(s).tolist()) for i, s in enumerate(map(np.unique, sets))]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    got = {(x.a, x.b) for x in plausible(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(rows, "rep long, n int, bits array<long>"), 0.8).collect()}
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    similar = {(i, j) for i, j in pairs if jaccard(sets[i], sets[j]) >= 0.8}
    assert similar <= got and len(similar) > 40 and len(got) < 0.2 * len(pairs)


def test_clashing_names(spark):
    words = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, words, 1, 2, "x"), (2, words + " y", 3, 4, "y"), (3, "other", 5, 6, "z")], "doc_id long, text string, _f long, _r long, _metadata string")
    kept = keep_one(df)
    assert kept.columns == df.columns and len(kept.collect()) == 2


def test_fingerprints_link_near_copies_by_themselves(spark, monkeypatch):
    from pyspark.sql import functions as F

    from brinemark.llm import near_dedup

    r = random.Random(73)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    texts = []
    for _ in range(20):  # one word of 600 changed, then another one
        w = [word() for _ in range(600)]
        for _ in range(3):
            texts.append(" ".join(w))
            w[r.randrange(600)] = word()
    whole = near_dedup.prefixes
    monkeypatch.setattr(near_dedup, "prefixes", lambda *a: whole(*a).withColumn("pre", F.array().cast("array<bigint>")))
    hashes = [[xxhash.xxh64_intdigest(f"{x} {y}".encode(), 42) for x, y in zip(w, w[1:], strict=False)] for w in map(str.split, texts)]
    fps = [sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h)) for h in hashes]
    root = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= near_dedup.WIDE)
    kept = [x.doc_id for x in keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    assert len(set(root)) < 25 and sorted(root[i] for i in kept) == sorted(set(root))


@pytest.mark.parametrize("small", [2, 24])
def test_fingerprint_pairs_equal_all_pairs(spark, small):
    from brinemark.llm.near_dedup import WIDE, fingerprint_pairs

    r = random.Random(74)
    flip = lambda x, most: x ^ sum(1 << i for i in r.sample(range(64), r.randint(0, most)))
    centres = [r.getrandbits(64) for _ in range(40)]
    fps = centres + [flip(c, 6) for c in centres for _ in range(10)] + [r.getrandbits(64) for _ in range(50)]
    rows = [(i, 9 if i < 40 else 1, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)]
    got = {(x.a, x.b) for x in fingerprint_pairs(Scratch(spark, "t"), spark.createDataFrame(rows, "rep long, copies long, fp long"), WIDE, small).collect()}
    near = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= WIDE}
    tops = {x: min((j for j in range(len(fps)) if fps[j] == x), key=lambda j: (-rows[j][1], -j)) for x in fps}
    want = {(i, j) for i, j in near if fps[i] != fps[j] and tops[fps[i]] == i and tops[fps[j]] == j}
    equal = {tuple(sorted((i, tops[x]))) for i, x in enumerate(fps) if tops[x] != i}
    assert got <= want | equal and equal <= got and len(want) > 300 and len(equal) > 20
    # every link of small buckets, and of larger ones those to the fingerprint of most copies
    assert got == want | equal if small == 24 else {(i, j) for i, j in want if i < 40} <= got


def test_pairs_that_first_meet_in_a_small_bucket_then_in_a_large_one(spark):
    r = random.Random(75)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(5, 9)))
    texts = []
    for _ in range(5):  # 46 shingles in 62 texts, two more in a pair at exactly 0.8; the other texts are below it
        common, end = [word() for _ in range(50)], [word(), word()]
        texts += [" ".join([word() for _ in range(12)] + common + end), " ".join(common + end)]
        texts += [" ".join([word() for _ in range(10)] + common) for _ in range(60)]
    n, root = brute_kept(texts)
    kept = [x.doc_id for x in keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    assert n == 5 * 61 and sorted(root[i] for i in kept) == sorted(set(root))
