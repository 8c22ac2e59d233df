import random
import re
from collections import Counter

import numpy as np

from brinemark.llm.decontaminate import RADIUS, Index, drop_contaminated, find_items, op6_decontaminate
from brinemark.llm.near_dedup import majority

PUNCT = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def words_of(t):
    return re.sub(f"[{PUNCT}]", " ", t or "").encode().lower().split()


def brute(texts, items):
    """The best similarity of each text and item that match, by every window."""
    out = {}
    grams = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for i, t in enumerate(texts):
        w = words_of(t)
        for j, x in enumerate(items):
            a = words_of(x)
            if not a or not w:
                continue
            k, size = min(5, len(a)), min(len(a), len(w))
            if size < k:
                continue
            A = grams(a, k)
            best = 0
            for s in range(len(w) - size + 1):
                B = grams(w[s : s + size], k)
                both = sum((A & B).values())
                best = max(best, both / (sum(A.values()) + sum(B.values()) - both))
            if best >= 0.8:
                out[i, j] = best
    return out


def corpus(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    items = [" ".join(word() for _ in range(r.randint(12, 60))) for _ in range(12)] + ["ab cd", "", None, "x " * 20]
    texts = []
    for _ in range(n):
        body = [word() for _ in range(r.randint(0, 80))]
        if r.random() < 0.6:
            part = (r.choice(items) or "").split()
            for _ in range(r.randint(0, 2)):
                if part:
                    part[r.randrange(len(part))] = word()
            at = r.randint(0, len(body))
            body[at:at] = [p.upper() + "," if p.isascii() else p for p in part]
        texts.append(" ".join(body))
    return texts + [None, "", "x " * 50], items


def test_query_equals_brute_force(spark, tmp_path):
    texts, items = corpus(3, 200)
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = brute(texts, items)
    got = {(x.doc_id, x.item_id): x.similarity for x in op6_decontaminate(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and len(want) > 40
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    docs, bench = spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "benchmark.parquet"))
    small = {(x.doc_id, x.item_id) for x in find_items(docs, bench, block_chars=200).collect()}
    assert small == want.keys()
    clean = drop_contaminated(docs, bench, block_chars=500)
    assert clean.columns == docs.columns and {x.doc_id for x in clean.collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert find_items(docs, bench.limit(0)).count() == 0 == find_items(docs.limit(0), bench).count()
    assert drop_contaminated(docs, bench.limit(0)).count() == len(texts)


def test_parts_give_every_item_within_the_radius():
    r = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 30, 20)) for _ in range(300)]
    index = Index(list(range(300)), texts, 0.8, RADIUS)
    for _ in range(200):
        fp = int(r.integers(0, 1 << 63)) * 2
        assert set(index.near(fp).tolist()) == {i for i, p in enumerate(index.prints.tolist()) if bin(p ^ fp).count("1") <= RADIUS}
    assert majority(np.array([], np.uint64)) == 0
