"""Token counts by a two-tier lookup on the map side.

A pre-token is a run of word-boundary marks with the characters up to the next one. No piece of
such a vocabulary spans the start of a run (this is checked when the model is loaded), so a text has
the tokens of its pre-tokens. The first tier is a broadcast table of the most frequent pre-tokens'
lengths, the second a bounded cache in each Python worker, filled by the tokenizer on a miss. The
table decides speed only. It is found by a pass over every text in which each task keeps a bounded
summary of its own; only summaries are shuffled, never pre-tokens.

Cases: a null or empty text has 0 tokens; a null id stays null; repeated rows count each; an empty
table gives an empty table; other columns of the input aren't read, so their names can't clash.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

MARK = "▁"
LONGEST = 48  # characters of a pre-token that is kept in a table or cache; longer ones are encoded each time
CACHE = 300_000  # entries of a worker's cache
FREQUENT = 32_768  # entries of the broadcast table
PER_TASK = 4_096  # entries of a task's summary
LIMIT = 4096


class PieceCounter:
    """Counts the tokens of texts as the sentencepiece model at path gives them."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.whole = any(MARK in self.model.id_to_piece(i).lstrip(MARK) for i in range(self.model.get_piece_size()))
        self.frequent, self.cache = frequent or {}, {}
        n = lambda s: len(self.model.encode(s))
        # the rules of this kind of model: a mark is put before the text, spaces are marks, nothing else changes
        self.whole |= n("x y") != n("x") + n("y") or n("a\tb c") != n("a\tb") + n("c")
        self.lone = n("x ") - n("x")  # a mark with nothing after it

    def pieces(self, keys: list[str]) -> None:
        """Put the lengths of unknown pre-tokens into the cache."""
        if len(self.cache) + len(keys) > CACHE:
            self.cache.clear()
        for key, ids in zip(keys, self.model.encode(keys, num_threads=1), strict=True):
            self.cache[key] = len(ids)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.whole:
            return len(self.model.encode(text))
        keys = pre_tokens(text)
        seen = Counter(keys)
        frequent, total, unknown = self.frequent, 0, []
        for key, times in seen.items():
            n = frequent.get(key)
            if n is None:
                n = self.cache.get(key)
                if n is None:
                    if key == "":
                        n = self.lone
                    elif len(key) > LONGEST:
                        n = len(self.model.encode(key))
                    else:
                        unknown.append(key)
                        continue
            total += n * times
        if unknown:
            self.pieces(unknown)
            total += sum(self.cache[k] * seen[k] for k in unknown)
        return total


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first mark; the tokenizer puts that one back."""
    parts = text.replace(MARK, " ").split(" ")
    if "" not in parts:
        return parts
    out, run = [], 0  # each part has a mark before it; an empty one hands its mark to the next
    for p in parts:
        if p:
            out.append(" " * run + p)
            run = 0
        else:
            run += 1
    if run:
        out.append(" " * (run - 1))
    return out


def summary(batches):
    """(pre-token, count) of a task's most frequent pre-tokens; memory is bounded by dropping rare ones on the way."""
    seen: Counter = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            if text:
                seen.update(k for k in pre_tokens(text) if len(k) <= LONGEST)
                if len(seen) > 50 * PER_TASK:
                    seen = Counter(dict(seen.most_common(10 * PER_TASK)))
    top = seen.most_common(PER_TASK)
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["token", "n"])


def frequent_pretokens(docs: DataFrame, text: str = "text", size: int = FREQUENT) -> DataFrame:
    """The size most frequent pre-tokens of the corpus with their counts, from one summary a task."""
    return docs.select(text).mapInArrow(summary, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(size)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text", frequent: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of each row.

    frequent: pre-tokens of an earlier run's table, at most FREQUENT of them; found from docs if absent.
    """
    spark = docs.sparkSession
    if frequent is None:
        frequent = [r.token for r in frequent_pretokens(docs, text).collect()]
    counter = PieceCounter(model_path)
    keys = [k for k in frequent[:FREQUENT] if k and len(k) <= LONGEST]
    lengths = dict(zip(keys, map(len, counter.model.encode(keys, num_threads=1)), strict=True)) if keys else {}
    shipped = spark.sparkContext.broadcast(lengths)
    made: list[PieceCounter] = []

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(PieceCounter(model_path, shipped.value))
        texts = b.column(1)
        n = [made[0].count(t.as_py()) for t in texts]
        size = [len(t.as_buffer()) if t.is_valid else 0 for t in texts]
        n = np.array(n, np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], names=["id", "b", "n", "o"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text), one, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
