import hashlib
import random
import re
import time

from brinemark.llm.pii import BASE, base_spans, candidates, find_personal_data, op2_personal_data


def passes_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and passes_luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], BASE.index(x[0])))


PARTS = ["a.b", "@", "@@", "mail", ".com", "-", "+", "1", "22", "255", "256", "0001", ".", ".", "4111111111111111", "4111 1111-1111 1111", "+1 (523) 555-1055", " ", "(", ")", "é", "٣", "\n", "%", "_", "0000000000000", "1.2.3.4"]


def test_base_equals_the_whole_expressions():
    r = random.Random(11)
    for _ in range(30000):
        t = "".join(r.choice(PARTS) for _ in range(r.randint(0, 14)))
        assert sorted(base_spans(t), key=lambda x: (x[1], BASE.index(x[0]))) == brute(t), t


def test_long_runs_take_linear_time():
    began = time.time()
    for t in ("a" * 400_000, "1" * 400_000, "a@" * 200_000, "1." * 200_000, "1 " * 200_000, "+1(" * 100_000, "a." * 200_000 + "@"):
        base_spans(t)
    assert time.time() - began < 20


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"please call customer phone +1 (523) 555-{1000 + i} today") for i in range(8)]
    rows += [(100, "please call customer phone 5235551055 today"), (101, "the year 20240101 was fine"), (102, None), (103, "")]
    got = {r.doc_id: [tuple(x) for x in r.personal] for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == [("id", 27, 37)]
    assert got[101] == [] and got[102] == [] and got[103] == []
    assert all([x[0] for x in got[i]] == ["phone"] for i in range(8))


def test_query_and_awkward_rows(spark, tmp_path):
    r = random.Random(13)
    rows = [(i, None if i % 9 == 0 else "".join(r.choice(PARTS) for _ in range(r.randint(0, 60))), "x") for i in range(250)] + [(None, "a@b.cc", "y"), (3, "1.2.3.4", "z"), (3, "1.2.3.4", "z")]
    spark.createDataFrame(rows, "doc_id long, text string, personal string").write.parquet(str(tmp_path / "documents.parquet"))
    want = sorted(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute(t or "")).encode()).hexdigest() for _, t, _ in rows)
    out = op2_personal_data(spark, str(tmp_path)).collect()
    assert sorted(x.base_sha256 for x in out) == want
    by = {x.doc_id: x for x in out}
    for i, t, _ in rows[:3] + rows[4:250]:
        spans = brute(t or "")
        assert [by[i][f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in spans) for k in BASE]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(by[i].spans.split(","))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert find_personal_data(empty).count() == 0


def test_identifiers_before_punctuation_and_long_ones():
    found = lambda t: [t[c[0] : c[1]] for c in candidates(t, [])]
    for x in ("12345678", "AB-123456", "a_b--1234/x", "9" * 60, "id-" * 20 + "1234"):
        for after in ("", " is", ".", ". Next", "/", "-", "_ x", "...", ", x", ")"):
            assert found(f"the number {x}{after}") == [x], (x, after)
    assert found("the number 123 is") == [] and found("my numbers 1234 and 5678, too") == ["1234", "5678"]
    began = time.time()
    for t in ("1" * 400_000, "a." * 200_000 + "1", "a-" * 200_000, "1." * 200_000, "é1234" * 50_000):
        candidates("the number " + t, [])
    assert time.time() - began < 20


def test_found_identifiers_support_patterns_without_seeds(spark):
    rows = [(i, f"please call customer phone +1 (523) 555-{1000 + i} today") for i in range(60)]
    rows += [(100 + i, f"please call customer phone 52355510{i:02} today") for i in range(10)]
    rows += [(200 + i, f"record of member 52355510{i:02} closed") for i in range(10)] + [(300, "record of member 99887766 closed")]
    got = {r.doc_id: [x.kind for x in r.personal] for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == ["id"] and got[200] == ["id"] and got[300] == ["id"]


def test_contexts_at_any_distance():
    from brinemark.llm.pii import candidates

    near, far = "my account number 12345678 is", "my account" + " 1" * 500 + " number" + " -" * 500 + "12345678" + " +" * 500 + " is"
    assert candidates(near, [])[0][4] == candidates(far, [])[-1][4] and len(candidates(near, [])[0][4]) == 2
    assert candidates("12345678", []) == []
