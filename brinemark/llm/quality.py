"""Quality rules: fixed measures of each text, and a likelihood ratio of hashed n-grams.

The ratio compares two multinomials over BUCKETS hashed byte trigrams: one of trusted texts (labelled
rows, at most TRUSTED of them by a hash of their ids, a documented bound), one of every text of the
corpus. A text's score is the mean log ratio of its trigrams, so length doesn't count; a text below
THRESHOLD is rejected. Threshold and smoothing are constants: the same text and counts give the same
verdict. Both counts come from one pass in which each task adds up its texts and emits a row a bucket; a
second pass scores. Texts are never shuffled. What the driver gets and broadcasts is BUCKETS numbers and
TRUSTED ids, whatever the input.

Byte trigrams rather than words: any corpus fills their buckets, so a score means the same at every size.

Measures, with words as runs of bytes other than white space: n_words; word_chars, code points in words;
n_symbols, characters of #*$%&|<>; n_dup_lines, lines with a word that equal an earlier line;
n_repeat_words, words in three-word windows that occur twice or more in the text. base_failed: under 50
words, or more than half of them in repeated windows. Lines and windows are equal if their bytes are.

Cases: a null or empty text has zeros, base_failed and isn't kept; a null id stays null and is never
trusted; repeated rows count each; without a trusted row the ratio says nothing and only base rules
decide; an empty table gives an empty table; other columns aren't read, so their names can't clash.
keep_good() returns the columns of its input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Words, arrow_map, chunks, gram_hash, mix, table, text_bytes

BUCKETS = 1 << 16
TRUSTED = 50_000
THRESHOLD = -0.25
ALPHA = 1.0
MIN_WORDS, MAX_REPEAT = 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NOT_NEWLINE = np.zeros(256, bool)
_NOT_NEWLINE[0x0A] = True


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _later_copies(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key stands at an earlier place, and places whose key stands at any other."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later = np.zeros(len(key), bool)
    later[order[1:][same]] = True
    twice = later.copy()
    twice[order[:-1][same]] = True
    return later, twice


def _equal_grams(words: Words, starts: np.ndarray, k: int) -> np.ndarray:
    """A key for the k-word window at each start, equal for windows of the same words in the same text and no others."""
    columns = [words.number[starts + j] for j in range(k)] + [words.doc[starts]]
    key = gram_hash(words.hash, starts, k) ^ mix(columns[-1].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    if all((c[order[same]] == c[order[same + 1]]).all() for c in columns):
        return key
    key = columns[0]  # a hash met two windows: numbers of pairs, then of triples and so on
    for c in columns[1:]:
        key = np.unique(key, return_inverse=True)[1] * (int(c.max(initial=0)) + 1) + c
    return key


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The fixed measures of the texts that lie between offsets."""
    n = len(offsets) - 1
    word = ~SPACE[data]
    words, lines = Words(data, offsets), Words(data, offsets, _NOT_NEWLINE)
    in_words = np.zeros(len(data) + 1, np.int64)
    np.cumsum(word, out=in_words[1:])
    real = in_words[lines.end] > in_words[lines.start]
    doc = lines.doc[real]
    later, _ = _later_copies(lines.number[real] * n + doc)
    starts = words.windows(3)
    _, twice = _later_copies(_equal_grams(words, starts, 3))
    covered = np.zeros(len(words.start) + 2, bool)
    for j in range(3):
        covered[starts[twice] + j] = True
    return {
        "n_words": words.count.astype(np.int64),
        "word_chars": _per_doc(word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_doc(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(doc[later], minlength=n),
        "n_repeat_words": np.bincount(words.doc[covered[: len(words.doc)]], minlength=n),
    }


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of each byte trigram that lies in one text."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = data.astype(np.uint32)
    code = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(0x9E3779B1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[:-2] == doc[2:]
    return (code[inside] >> np.uint32(16)).astype(np.int64), doc[:-2][inside]


def fit(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text: str = "text", bound: int = TRUSTED) -> np.ndarray | None:
    """The log ratio of each bucket; None without a trusted text. trusted_ids: one column of ids."""
    spark, name = docs.sparkSession, trusted_ids.columns[0]
    ids = trusted_ids.where(F.col(name).isNotNull()).distinct().orderBy(F.xxhash64(name), name).limit(bound)
    trusted = spark.sparkContext.broadcast([r[0] for r in ids.collect()])

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            good = pc.is_in(b.column(0), value_set=pa.array(trusted.value, b.column(0).type)).to_numpy(zero_copy_only=False) if trusted.value else np.zeros(len(b), bool)
            for i, j in chunks(b.column(1)):
                bucket, doc = trigrams(*text_bytes(b.column(1)[i:j]))
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[i:j][doc]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    sums = docs.select(id_col, text).mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[sums.bucket], target[sums.bucket] = sums.raw, sums.target
    if not target.sum():
        return None
    return np.log((target + ALPHA) / (target.sum() + ALPHA * BUCKETS)) - np.log((raw + ALPHA) / (raw.sum() + ALPHA * BUCKETS))


def verdicts(text: pa.Array, ratio: np.ndarray | None, threshold: float) -> dict[str, np.ndarray]:
    """Measures, score, base_failed and kept of each text of an Arrow array."""
    parts = []
    for i, j in chunks(text):
        data, offsets = text_bytes(text[i:j])
        x = measures(data, offsets)
        x["base_failed"] = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > MAX_REPEAT * x["n_words"])
        x["score"] = np.zeros(j - i)
        if ratio is not None:
            bucket, doc = trigrams(data, offsets)
            n = np.bincount(doc, minlength=j - i)
            x["score"] = np.bincount(doc, weights=ratio[bucket], minlength=j - i) / np.maximum(n, 1)
        x["kept"] = ~x["base_failed"] & (x["score"] >= threshold)
        parts.append(x)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in names}


def score_quality(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bound: int = TRUSTED) -> DataFrame:
    """id, the measures, base_failed, kept and score of each row."""
    ratio = docs.sparkSession.sparkContext.broadcast(fit(docs, trusted_ids, id_col, text, bound))
    names = {k: "long" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"base_failed": "boolean", "kept": "boolean", "score": "double"}

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        v = verdicts(b.column(1), ratio.value, threshold)
        kind = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
        return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v[k]).cast(kind[t]) for k, t in names.items()]], names=["id", *names])

    id_kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text), one, f"`{id_col}` {id_kind}, " + ", ".join(f"{k} {t}" for k, t in names.items()))


def keep_good(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bound: int = TRUSTED) -> DataFrame:
    """The rows of docs that are kept, unchanged and unshuffled."""
    ratio = docs.sparkSession.sparkContext.broadcast(fit(docs, trusted_ids, id_col, text, bound))
    at = docs.columns.index(text)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(verdicts(b.column(at), ratio.value, threshold)["kept"].astype(bool)))

    return arrow_map(docs, one, docs.schema)


def trusted(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), trusted(table(spark, sf_dir, "labels")))


def quality_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed measures alone, which SQL can express."""
    return op7_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


_WORD_SQL = r"'[^\x20\x09-\x0D]+'"
MEASURES_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, {_WORD_SQL}), []) AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORD_SQL})) AS lines FROM documents),
p AS (SELECT rid, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d),
t AS (SELECT rid, j, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM p WINDOW o AS (PARTITION BY rid ORDER BY j)),
c AS (SELECT rid, j, CASE WHEN z IS NOT NULL AND count(*) OVER (PARTITION BY rid, x, y, z) > 1 THEN 1 ELSE 0 END AS twice FROM t),
r AS (SELECT rid, sum(hit) AS n FROM (SELECT rid, max(twice) OVER (PARTITION BY rid ORDER BY j ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM c) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN r USING (rid))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM m"""
