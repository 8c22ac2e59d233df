import random
from collections import Counter

import numpy as np
import pytest

from brinemark.llm.quality import keep_good, op7_quality_rules, score_quality, trigrams


def brute(t):
    t = t or ""
    words = t.encode().split()
    windows = list(zip(words, words[1:], words[2:]))
    c, cov = Counter(windows), set()
    for i, w in enumerate(windows):
        if c[w] > 1:
            cov |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    n, rep = len(words), len(cov)
    return n, sum(len(w.decode()) for w in words), sum(ch in "#*$%&|<>" for ch in t), dup, rep, n < 50 or 100 * rep > 50 * n


PARTS = ["a", "b", "é", "中😀", "#", "word", " ", "\n", "\n\n", "\t", " | ", "\x0b", "a b c ", "line\n", "&<>"]


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(17)
    rows = [(i, None if i % 11 == 0 else "".join(r.choice(PARTS) for _ in range(r.randint(0, 300))), "s") for i in range(400)] + [(None, "x", "s"), (5, "long " * 200_000, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, kept string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    out = op7_quality_rules(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(tuple(x[k] for k in names) for x in out) == sorted(brute(t) for _, t, _ in rows)
    assert not any(x.kept and x.base_failed for x in out)


def test_score_equals_the_formula(spark):
    docs = [(1, "abcabc"), (2, "xyzxyz"), (3, "abc"), (4, None), (5, "ab")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x.score for x in score_quality(df, spark.createDataFrame([(1,), (9,), (None,)], "doc_id long")).collect()}
    grams = lambda t: [t[i : i + 3] for i in range(len(t or "") - 2)]
    raw, target = Counter(g for _, t in docs for g in grams(t)), Counter(grams("abcabc"))
    for i, t in docs:
        own = [np.log((target[g] + 1) / (sum(target.values()) + 65536)) - np.log((raw[g] + 1) / (sum(raw.values()) + 65536)) for g in grams(t)]
        assert got[i] == pytest.approx(np.mean(own) if own else 0.0)
    assert len(trigrams(np.frombuffer(b"abcdef", np.uint8), np.array([0, 2, 2, 6]))[0]) == 2


def test_good_text_stays_and_junk_goes(spark):
    r = random.Random(3)
    prose = lambda: " ".join(r.choice(["the", "sea", "level", "rises", "over", "warm", "water", "slowly"]) + r.choice(["", "s", "ed"]) for _ in range(120))
    junk = lambda: " ".join(r.choice("ABCDEFGH") * 3 + "%%%" + str(r.random()) for _ in range(120))
    rows = [(i, junk() if i % 5 == 0 else prose(), i) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    kept = keep_good(df, spark.createDataFrame([(i,) for i in range(0, 60) if i % 5], "doc_id long"))
    assert kept.schema == df.schema and {x.doc_id for x in kept.collect()} == {i for i in range(200) if i % 5}
    assert keep_good(df, spark.createDataFrame([], "doc_id long")).count() == 200
    assert keep_good(df.limit(0), spark.createDataFrame([], "doc_id long")).count() == 0


def test_equality_is_by_bytes(monkeypatch):
    from brinemark.llm import quality

    x = [0]
    for _ in range(11):
        x += [1 - b for b in x]
    one, two = ("".join("ab"[b ^ f] for b in x) for f in (0, 1))  # equal under any polynomial hash modulo a power of two
    texts = [f"{one}\n{two}\n{one[:-1]}", f"{one} p q {two} p q {one} p q", "a b c d e f a b c", "a b c"] + [" ".join(random.Random(i).choice("ab") for _ in range(40)) for i in range(20)]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for hashed in (quality.gram_hash, lambda h, starts, k: np.zeros(len(starts), np.uint64)):  # the second meets every two windows of a text
        monkeypatch.setattr(quality, "gram_hash", hashed)
        got = quality.measures(*quality.text_bytes(quality.pa.array(texts)))
        assert [tuple(got[k][i] for k in names) for i in range(len(texts))] == [brute(t)[:5] for t in texts]
