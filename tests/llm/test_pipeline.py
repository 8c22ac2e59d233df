import random
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from brinemark.llm.mixing import mix_sql
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_quality import brute as measures
from tests.llm.test_secret_scan import brute as secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(tmp_path, spark):
    r = random.Random(77)
    vocabulary = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 9))) for _ in range(900)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [" ".join(prose(30)) for _ in range(6)]
    texts = []
    for i in range(60):
        words = prose(r.randint(60, 200))
        if i % 10 == 3:
            words[20:20] = r.choice(items).split()
        if i % 10 == 4:
            words[30:30] = ["token", "=", '"0123456789abcdef0123456789abcdef"']
        texts.append(" ".join(words))
    for i in range(10):
        words = texts[i].split()
        words[r.randrange(len(words))] = "changed"
        texts += [" ".join(words), texts[i]]
    texts += ["%$#" + " %$# &&&".join(str(r.random()).upper() + "|*|" for _ in range(80)) for _ in range(25)] + ["few words", "", None, "same again " * 200]
    rows = [(i if i != 30 else None, t, "en", r.choice(["a", "b", "b", "b", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return items


def test_stages_equal_brute_force(spark, tmp_path):
    items = make(tmp_path, spark)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "mixing"]
    docs, told = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        before, docs = docs.collect(), spark.read.parquet(str(tmp_path / f"s{k}"))
        told.append((before, docs.collect()))
    # 1: base rules and the ratio of byte trigrams
    before, after = told[0]
    grams = lambda t: [t.encode()[i : i + 3] for i in range(len((t or "").encode()) - 2)]
    raw, target = Counter(), Counter()
    for x in before:
        raw.update(grams(x.text or ""))
        if x.doc_id is not None and x.doc_id < 30:
            target.update(grams(x.text))
    R, T = sum(raw.values()), sum(target.values())
    score = lambda t: np.mean([np.log((target[g] + 1) / (T + 65536) * (R + 65536) / (raw[g] + 1)) for g in grams(t)] or [0])
    want = sorted(x.text for x in before if not measures(x.text)[5] and score(x.text) >= -0.25)
    assert sorted(x.text for x in after) == want and 70 <= len(want) <= 80
    # 2: one of each group of similar texts
    before, after = told[1]
    sets = [{tuple(x.text.split()[i : i + 5]) for i in range(len(x.text.split()) - 4)} for x in before]
    group = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    of = {}
    for x, g in zip(before, group, strict=True):
        of.setdefault(x.text, g)
    assert sorted(of[x.text] for x in after) == sorted(set(group)) and len(before) - len(after) >= 20
    # 3: no window near an item
    before, after = told[2]
    bad = {i for i, _ in leaks([x.text for x in before], items)}
    assert sorted(x.text for x in after) == sorted(x.text for i, x in enumerate(before) if i not in bad) and bad
    # 4: no secret is left, other text stays
    before, after = told[3]
    assert sum(bool(secrets(x.text)) for x in before) >= 4 and not any(secrets(x.text) for x in after)
    assert all(x.n_chars == len(x.text) for x in after)
    assert {x.text for x in before if not secrets(x.text)} <= {x.text for x in after} and len(before) == len(after)
    # 5: the SQL of mixing
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/s3/*.parquet'")
    want = con.execute(f"select doc_id, source, size, taken from ({mix_sql()}) where taken > 0").fetchall()
    after = told[4][1]
    assert sorted(((x.doc_id, x.source, x.size, x.taken) for x in after), key=str) == sorted(want, key=str)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, after))


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "w " * 3000, None, None, None)]])
def test_small_and_null_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() <= len(rows)
