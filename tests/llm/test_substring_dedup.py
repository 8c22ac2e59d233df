import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from brinemark.llm import substring_dedup
from brinemark.llm.substring_dedup import halves, op3_substring_dedup, remove_repeats, repeats, without


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def corpus(r, n, words):
    passages = [" ".join(r.choice(words) for _ in range(r.randint(20, 120))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(r.randint(0, 3))]
        parts += r.sample(passages, r.randint(0, 2))
        r.shuffle(parts)
        texts.append(r.choice(["\n", "  ", "\t\x0b"]).join(parts))
    return texts + [None, "", "a " * 300, "a b " * 100, texts[0], texts[1] + " end", "x", "é " * 35]


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(31)
    texts = corpus(r, 120, [f"w{i}é" for i in range(400)])
    rows = [(None if i == 7 else i, t, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, kept string").write.parquet(str(tmp_path / "documents.parquet"))
    out = op3_substring_dedup(spark, str(tmp_path)).collect()
    want = brute(texts, 35)
    assert sum(g for _, g, _ in want) > 1000
    told = lambda k: hashlib.sha256(k.encode()).hexdigest()
    assert sorted((str(x.doc_id), x.n_words, x.n_removed, x.kept_sha256) for x in out) == sorted((str(d), n, g, told(k)) for (d, _, _), (n, g, k) in zip(rows, want, strict=True))


@pytest.mark.parametrize("part_bytes", [1, 700])
def test_oversized_parts_are_split_by_longer_prefixes(spark, part_bytes):
    r = random.Random(part_bytes)
    texts = corpus(r, 60, ["a", "b", "c"])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in remove_repeats(df, window=24, gram=5, part_bytes=part_bytes).collect()}
    assert got == dict(enumerate(brute(texts, 24)))


def test_one_gram_in_every_document(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    line = [f"common{i}" for i in range(12)]
    near = [[r.choice(words) for _ in range(30)] for _ in range(3)]
    texts = []
    for _ in range(150):
        left = r.choice([[r.choice(words) for _ in range(r.randint(0, 40))], near[0][-r.randint(1, 30) :]])
        right = r.choice([[r.choice(words) for _ in range(r.randint(0, 40))], near[1][: r.randint(1, 30)], near[2]])
        texts.append(" ".join(left + line + right))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for part_bytes in (500, 5000, 1 << 22):
        got = {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in remove_repeats(df, part_bytes=part_bytes).collect()}
        assert got == dict(enumerate(brute(texts, 35)))


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_in_blocks(spark, monkeypatch):
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdef") for _ in range(3000)) for _ in range(3)] + ["few words", "x " * 50]
    texts[1] += " " + " ".join(texts[0].split()[500:1500])
    w = substring_dedup.Words(*substring_dedup.text_bytes(pa.array(texts)))
    whole = [np.concatenate(x) for x in zip(*substring_dedup.runs(w, 35, 8), strict=True)]
    for block in (1, 64, 1000):
        monkeypatch.setattr(substring_dedup, "BLOCK", block)
        parts = [np.concatenate(x) for x in zip(*substring_dedup.runs(w, 35, 8), strict=True)]
        each = lambda rows: sorted((d, s, x + a - s, k) for d, a, b, x, k in zip(*(v.tolist() for v in rows[:5]), strict=True) for s in range(a, b + 1))
        assert each(parts) == each(whole)


def test_repeats_equal_counts():
    r = random.Random(4)
    for _ in range(200):
        window = r.randint(1, 9)
        segs = [" ".join(r.choice("ab") for _ in range(r.randint(window, 20))) for _ in range(r.randint(1, 6))]
        n = np.array([r.randint(1, 2) for _ in segs])
        seen = Counter()
        for s, c in zip(segs, n, strict=True):
            w = s.split()
            for i in range(len(w) - window + 1):
                seen[tuple(w[i : i + window])] += c
        want = {(k, i + j) for k, s in enumerate(segs) for i in range(len(s.split()) - window + 1) if seen[tuple(s.split()[i : i + window])] > 1 for j in range(window)}
        got = [(k, i) for k, a, b in zip(*repeats(pa.array(segs), n, window), strict=True) for i in range(a, b)]
        assert len(got) == len(set(got)) and set(got) == want


def test_halves_hold_each_window_once():
    for window, gram in ((35, 8), (24, 5), (9, 8), (5, 1)):
        todo = [(m, x, x + gram, 0) for m in range(window, 2 * window - gram + 1) for x in range(m - gram + 1) if m - window <= x and x + gram <= window]
        for m, x, y, _ in todo:
            parts, steps = [(m, x, y, 0)], 0
            while any(b - a < window for _, a, b, _ in parts):
                assert all(k - window <= a and b <= window and a >= 0 and b <= k for k, a, b, _ in parts)
                parts, steps = [(j - i, p, q, at + i) for k, a, b, at in parts for _, i, j, p, q in halves(k, a, b, window)] if parts else [], steps + 1
                assert steps < 8
            assert sorted(at for _, _, _, at in parts) == list(range(m - window + 1))


def test_words_outside_ranges_stay():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice("ab \n\té") for _ in range(r.randint(0, 60)))
        words = text.encode().split()
        ranges = [{"a": a, "b": r.randint(a, len(words))} for a in (r.randint(0, len(words)) for _ in range(r.randint(0, 3)))]
        gone = {i for x in ranges for i in range(x["a"], x["b"])}
        assert without(text.encode(), ranges) == (len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone))
