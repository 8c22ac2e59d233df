"""Personal data: fixed expressions give seeds, the contexts of seeds become patterns, patterns find more.

Base kinds, in the order used for ties: email, ip (four parts of at most 255), card (12 to 19 digits that
pass Luhn's test), phone ('+' and 9 to 15 digits). Each is found leftmost and without overlaps; a match
that fails its test is dropped and isn't tried again from inside.

The method, after the scan of whole texts that finds base spans (seeds) and candidates (other tokens
of ASCII letters and digits joined by . _ / -, of any length, with at least four digits) with their contexts:
1. an edge joins a pattern (two words on the left, or one on each side) and an instance it surrounds;
2. a pattern's confidence is the share of its instances' scores of one kind, smoothed; one with enough
   confidence and support (distinct seeds, and instances found in earlier rounds with enough confidence) is good. An instance's score is one minus the product of what its good
   patterns leave in doubt; seeds keep 1. These two steps alternate for a number of rounds;
3. a candidate inside a good pattern is reported as kind id.
Contexts and instances are 64-bit hashes; only distinct edges, pre-aggregated on the map side, are
shuffled, never texts.

Cases: a null text counts as empty and has no spans; repeated rows are scanned each (they add nothing to
a pattern, whose instances are distinct); a null id stays null; an empty table gives an empty table; other columns
aren't read, so their names can't clash. The scan takes time linear in a text's length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, table
from .secret_scan import digest_columns

BASE = ("email", "ip", "card", "phone")
KINDS = {k: i for i, k in enumerate((*BASE, "id"))}
ROUNDS, MIN_SEEDS, MIN_CONFIDENCE, SMOOTHING = 3, 3, 0.8, 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# possessive, so a long run without digits costs one pass; it ends on a letter or digit
_TOKEN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]++(?:[._/-]++[A-Za-z0-9]++)*+")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return sum(d[0::2]) % 10 == -sum(x * 2 - 9 * (x > 4) for x in d[1::2]) % 10


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    at, past = text.find("@"), 0
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            past = m.end()
            at = text.find("@", past)
        else:
            past = at + 1  # the next local part can't reach over this sign
            at = text.find("@", past)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


class _Contexts:
    """The patterns around places of a text; its words are found once."""

    def __init__(self, text: str):
        self.text, self.spans = text, None

    def word(self, i: int) -> str:
        start, stop = self.spans[i]
        return self.text[start:stop].lower()

    def at(self, start: int, stop: int) -> list[int]:
        """Hashes of the patterns: the two words before the place, and one word on each side, however far."""
        if self.spans is None:
            self.spans = np.fromiter((x for m in _WORD.finditer(self.text) for x in m.span()), np.int64).reshape(-1, 2)
        before = int(np.searchsorted(self.spans[:, 1], start, side="right"))
        after = int(np.searchsorted(self.spans[:, 0], stop))
        out = []
        if before > 1:
            out.append(_hash("b\x00" + self.word(before - 2) + "\x00" + self.word(before - 1)))
        if before and after < len(self.spans):
            out.append(_hash("a\x00" + self.word(before - 1) + "\x00" + self.word(after)))
        return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int, str | None, list[int]]]:
    """(start, stop, instance, kind of a seed, patterns) of the seeds and the other tokens with several digits."""
    contexts = _Contexts(text)
    out = [(s, e, _hash(text[s:e].lower()), k, c) for k, s, e in base if (c := contexts.at(s, e))]
    taken = sorted((s, e) for _, s, e in base)
    i, reach = 0, 0
    last = 0
    for d in _DIGIT.finditer(text):
        at = d.start()
        if at < last:
            continue
        start = at
        while start > last and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._/-")):
            start -= 1
        while start < at and not text[start].isalnum():
            start += 1
        m = _TOKEN.match(text, start)
        last = m.end() if m else at + 1
        if not m or m.end() <= at:
            continue
        start, stop = m.span()
        if sum("0" <= c <= "9" for c in m[0]) < 4:
            continue
        while i < len(taken) and taken[i][0] < stop:
            reach = max(reach, taken[i][1])
            i += 1
        if reach > start:
            continue
        if c := contexts.at(start, stop):
            out.append((start, stop, _hash(m[0].lower()), None, c))
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
_CAND = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("inst", pa.int64()), ("kind", pa.string()), ("pats", pa.list_(pa.int64()))])


def scan(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, base spans and candidates of each row."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        base, cand = [], []
        for x in b.column(1):  # one text at a time
            t = x.as_py()
            spans = base_spans(t) if t else []
            base.append([{"kind": k, "start": s, "stop": e} for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS[x[0]]))])
            cand.append([dict(zip(("start", "stop", "inst", "kind", "pats"), c, strict=True)) for c in (candidates(t, spans) if t else [])])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(cand, pa.list_(_CAND))], names=["id", "base", "cand"])

    kind = docs.schema[id_col].dataType.simpleString()
    span = "struct<kind:string,start:long,stop:long>"
    return arrow_map(docs.select(id_col, text), one, f"`{id_col}` {kind}, base array<{span}>, cand array<struct<start:long,stop:long,inst:long,kind:string,pats:array<long>>>")


def good_patterns(scratch: Scratch, edges: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """pat, kind, conf of the patterns that hold after the rounds. edges: pat, inst, kind (of a seed), each pair once."""
    # a pattern with fewer instances can't have the support in any round
    counts = edges.groupBy("pat").agg(F.count("*").alias("n")).where(F.col("n") >= min_seeds).select("pat")
    edges = scratch.keep(edges.join(counts, "pat"))
    seeds = edges.where("kind is not null").groupBy("inst").agg(F.min("kind").alias("as"), F.lit(1.0).alias("score"))
    state, good = seeds, None
    for _ in range(rounds):
        scored = edges.join(state, "inst", "left")
        sums = scored.groupBy("pat").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= min_confidence).alias("support"), *[F.sum(F.when(F.col("as") == k, F.col("score")).otherwise(0.0)).alias(k) for k in BASE])
        best = F.greatest(*[F.col(k) for k in BASE])
        named = F.coalesce(*[F.when(F.col(k) == best, F.lit(k)) for k in BASE])
        good = scratch.keep(sums.select("pat", "support", named.alias("as"), F.least(best / (F.col("n") + SMOOTHING), F.lit(0.999)).alias("conf")).where((F.col("conf") >= min_confidence) & (F.col("support") >= min_seeds)))
        found = edges.where("kind is null").join(good.select("pat", "as", "conf"), "pat").groupBy("inst").agg(F.max_by("as", F.struct("conf", "as")).alias("as"), (1 - F.exp(F.sum(F.log1p(-F.col("conf"))))).alias("score"))
        state = seeds.unionByName(found)
    return good.select("pat", "as", "conf")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """id and personal, an array of (kind, start, stop) by start and kind; places count code points."""
    scratch = Scratch(docs.sparkSession, "pii")
    occ = scratch.keep(scan(docs, id_col, text).withColumn("rid", F.monotonically_increasing_id()))
    each = occ.select("rid", F.explode("cand").alias("c")).select("rid", "c.*")
    pairs = each.select("inst", "kind", F.explode("pats").alias("pat"))
    good = good_patterns(scratch, pairs.groupBy("pat", "inst").agg(F.min("kind").alias("kind")), rounds, min_seeds, min_confidence)
    unseen = each.where("kind is null").select("rid", "start", "stop", F.explode("pats").alias("pat"))
    added = unseen.join(good, "pat").groupBy("rid").agg(F.collect_set(F.struct(F.lit("id").alias("kind"), "start", "stop")).alias("added"))
    order = F.create_map(*[F.lit(x) for k, i in KINDS.items() for x in (k, i)])
    every = F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:string,start:long,stop:long>>")))
    ranked = F.array_sort(F.transform(every, lambda x: F.struct(x.start.alias("a"), order[x.kind].alias("b"), x.stop.alias("c"), x.kind.alias("d"))))
    return occ.select(id_col, "rid", "base").join(added, "rid", "left").select(id_col, F.transform(ranked, lambda x: F.struct(x.d.alias("kind"), x.a.alias("start"), x.c.alias("stop"))).alias("personal"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(find_personal_data(table(spark, sf_dir, "documents")), "personal", list(BASE), ["n_id"])


def personal_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of base spans alone, which SQL can express."""
    return op2_personal_data(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in BASE])


_DIGITS_SQL = "regexp_replace(x, '[^0-9]', '', 'g')"
BASE_COUNTS_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email,
    list_filter(regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) < 4 AND CAST(right(p, 4) AS INT) <= 255)) = 4) AS ip,
    list_filter(list_transform(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), lambda x: {_DIGITS_SQL}), lambda x: length(x) BETWEEN 12 AND 19) AS card,
    list_filter(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length({_DIGITS_SQL}) BETWEEN 9 AND 15) AS phone FROM d)
SELECT doc_id, len(email) AS n_email, len(ip) AS n_ip, len(list_filter(card, lambda x: list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(x[-i] AS INT) ELSE 2 * CAST(x[-i] AS INT) - 9 * CAST(CAST(x[-i] AS INT) > 4 AS INT) END)) % 10 = 0)) AS n_card, len(phone) AS n_phone FROM c"""


__all__ = ["find_personal_data", "op2_personal_data", "personal_base_counts", "base_spans", "luhn"]
