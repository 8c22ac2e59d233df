import random

import public_tokenizers
import sentencepiece

from brinemark.llm.common import Words, text_bytes
from brinemark.llm.token_counts import PieceCounter, count_tokens, frequent_pretokens, op8_token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_equal_the_library():
    model, ours, r = sentencepiece.SentencePieceProcessor(model_file=PATH), PieceCounter(PATH), random.Random(3)
    assert not ours.whole
    for _ in range(5000):
        text = "".join(r.choice(" ▁  ab<s></s>é\n\t中😀the%\x00") for _ in range(r.randint(0, 30)))
        assert ours.count(text) == len(model.encode(text)), text
    assert ours.count("x" * 20000) == len(model.encode("x" * 20000))


def test_rows_and_tables(spark):
    texts = [None, "", " ", "the the the", "<s> a </s>", "wörd " * 5000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a", "y"), (3, "the the the", "z")], "doc_id long, text string, n_tokens string")
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for frequent in (None, [], ["the", "nothere"]):
        got = count_tokens(df, PATH, frequent=frequent).collect()
        assert len(got) == 8
        for row in got:
            if row.doc_id is not None:
                t = texts[row.doc_id] or ""
                assert (row.n_tokens, row.n_bytes) == (len(model.encode(t)), len(t.encode())) and row.over_limit == (row.n_tokens > 4096)
    assert count_tokens(df.limit(0), PATH).count() == 0
    assert frequent_pretokens(df).first().token == "wörd"


def test_query(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, None if i % 7 == 0 else " ".join(r.choice(["the", "and", "größe", "x" * 60, "", "a\tb"]) for _ in range(r.randint(0, 50)))) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert {x.doc_id: x.n_tokens for x in op8_token_counts(spark, str(tmp_path)).collect()} == {i: len(model.encode(t or "")) for i, t in rows}


def test_words_of_many_texts():
    import pyarrow as pa

    r = random.Random(4)
    for _ in range(2000):
        texts = [None if r.random() < 0.1 else "".join(r.choice(" \n\tabé") for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 6))]
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        w = Words(data, offsets)
        got = [(int(d), bytes(data[s:e])) for d, s, e in zip(w.doc, w.start, w.end, strict=True)]
        assert got == [(i, x) for i, t in enumerate(texts) for x in (t or "").encode().split()]
