import hashlib
import random
import re

from brinemark.llm.secret_scan import BASE62, Scanner, checksum62, find_secrets, mask_secrets, op5_secret_scan

ORDER = ["assign", "access", "hex"]


def brute(text):
    out = []
    ci = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    keys = "|".join(map(ci, ["password", "passwd", "secret", "token"])) + "|" + ci("api") + "_?" + ci("key")
    for m in re.finditer(rf"""({keys})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], ORDER.index(x[0])))


PARTS = ["password", "passwd", "Secret", "TOKEN", "api_key", "apikey", "APIKey", "to", "ken", ":", "=", " ", '"', "'", "abc", "AKIA", "AKIAAKIA", "QWERTY123456", "0123456789abcdef", "é", "İ", "K", "ſecret", "\n", "-", "secretsecret", "x" * 9]


def test_base_equals_the_whole_expressions():
    r, s = random.Random(5), Scanner()
    for _ in range(20000):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 14)))
        got = [x for x in s.spans(text) if x[0] in ORDER]
        assert sorted(got, key=lambda x: (x[1], ORDER.index(x[0]))) == brute(text), text


def test_checksum_decides():
    body = "".join(random.Random(1).choice(BASE62) for _ in range(30))
    good = "ghp_" + body + checksum62(body)
    bad = good[:-1] + ("A" if good[-1] != "A" else "B")
    s = Scanner()
    assert ("checked", 2, 42) in s.spans("a " + good + " b")
    assert not [x for x in s.spans("a " + bad) if x[0] == "checked"]
    assert not [x for x in s.spans("a" + good) if x[0] == "checked"]


def test_rows(spark):
    rows = [(1, "token = abcdefgh", 0), (1, "token = abcdefgh", 0), (None, None, 1), (2, "", 2), (3, "x" * 500_000 + " AKIA" + "Q" * 16, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, secrets int")
    got = sorted(find_secrets(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [len(r.secrets) for r in got] == [0, 1, 1, 0, 1]
    assert got[-1].secrets[0].start == 500_001
    masked = {r.doc_id: r.text for r in mask_secrets(df).collect()}
    assert masked[1] == "<assign>" and masked[None] is None and masked[2] == ""
    assert find_secrets(df.limit(0)).count() == 0 and mask_secrets(df.limit(0)).columns == df.columns


def test_query(spark, tmp_path):
    r = random.Random(7)
    rows = [(i, None if i % 9 == 0 else "".join(r.choice(PARTS) for _ in range(r.randint(0, 40)))) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    texts = dict(rows)
    out = op5_secret_scan(spark, str(tmp_path)).collect()
    assert len(out) == 300
    for row in out:
        spans = brute(texts[row.doc_id] or "")
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert row.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(x[0] == k for x in spans) for k in ORDER]
        assert set(told.split(",")) <= set(row.spans.split(","))
