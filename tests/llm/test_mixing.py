import random

import duckdb
import pytest

from brinemark.llm.mixing import SQL, mix, op1_mix_sources


def water(sizes):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    got, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return got | {s: left * weight[s] / total for s in open_}
        for s in over:
            got[s] = 3.0 * sizes[s]
        open_ -= over
        left = sum(sizes.values()) - sum(got.values())
    return got


def rows_of(r, n):
    texts = [None, "", "a b c", "é\x0bß x", "w " * 40, "## ** a", "one"]
    return [(None if i == 5 else i % (n - 3), r.choice(texts), r.choice(["b", "a", "Z", "é", None, "big", "big", "big", "big"]), "x") for i in range(n)]


@pytest.mark.parametrize("n", [3, 40, 900])
def test_targets_budgets_and_sql(spark, tmp_path, n):
    rows = rows_of(random.Random(n), n) if n > 3 else [(1, "a b", "s", "x"), (2, None, "t", "x"), (3, "a", None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, taken string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, op1_mix_sources(spark, str(tmp_path)).collect()), key=str)
    again = sorted(map(tuple, op1_mix_sources(spark, str(tmp_path)).collect()), key=str)
    assert got == again and len(got) == n
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(SQL).fetchall(), key=str) == got
    full = mix(spark.read.parquet(str(tmp_path / "documents.parquet"))).toPandas()
    sizes = {None if s != s else s: int(v) for s, v in full.groupby("source", dropna=False)["size"].sum().items()}
    want = water(sizes)
    for s, part in full.groupby("source", dropna=False):
        s = None if s != s else s
        assert part.target.iloc[0] == pytest.approx(want[s]) and part.source_size.iloc[0] == sizes[s]
        assert abs(part.taken.sum() - want[s]) <= 1
    assert (full.taken <= 3 * full["size"]).all() and (full.taken >= 0).all()


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_heavier_documents_come_first(spark):
    from pyspark.sql import functions as F

    rows = [(i, "a b c d", "a" if i < 1000 else "b", 1.0 if i % 2 else 0.1) for i in range(1500)]
    out = mix(spark.createDataFrame(rows, "doc_id long, text string, source string, q double"), quality=F.col("q")).where("source = 'a'").toPandas()
    share = lambda odd: out[out.id % 2 == odd].taken.sum()
    assert share(1) > 2 * share(0)


def test_carried_columns_with_names_of_the_mix(spark, tmp_path):
    df = spark.createDataFrame([(i, "a b c", "s", 9, "t", i) for i in range(5)], "doc_id long, text string, source string, size long, taken string, _f long")
    df.write.parquet(str(tmp_path / "d"))
    out = mix(spark.read.parquet(str(tmp_path / "d")), carry=df.columns)
    assert out.columns == ["doc_id", "text", "source", "_size", "_taken", "_f", "size", "source_size", "target", "taken"]
    assert sorted((x.doc_id, x["_size"], x["_taken"], x["_f"], x["size"]) for x in out.collect()) == [(i, 9, "t", i, 3) for i in range(5)]
