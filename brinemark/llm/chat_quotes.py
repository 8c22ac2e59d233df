"""Conversations in reply order without quotes: quoted passages are linked to the messages they come from.

1. Each message is split by line into passages at quote levels: the level is the number of '>' or '|'
   marks before a line; a line "On … wrote:" before a quote belongs to it. Level 0 is the message's own text.
2. A passage is normalised (marks and case gone, white space one space, punctuation at its ends trimmed)
   and hashed with 128 bits: own paragraphs, own lines and the whole own text of each message,
   and likewise whole quotes, their paragraphs and lines.
3. A passage's origin is the earliest message of the conversation that has it as own text. Origins are minima,
   pre-aggregated on the map side; quotes join them by conversation and hash, and only those before the quoting message count.
   Of a quote's known passages the longest decides, then the latest origin, so a common short line doesn't outweigh its paragraph.
4. A message replies to the latest origin of its level-1 quotes, or of deeper ones if none is known. It
   belongs to the thread of what it replies to, found by doubling parent links; a message without a known
   quote begins a thread. The reply order of a conversation is by thread and then turn, so a message always stands
   after what it replies to, and without quotes the order is by turn.

No conversation is collected or sorted in one task: in_reply_order() deals ranges of (conversation, thread, turn) out to tasks,
so the messages of a conversation follow each other in reply order and a huge conversation spans several tasks.

Cases: a null text counts as empty; a message whose text is only quotes has an empty text and stays; a null
conversation or turn is kept, without links; repeated rows and equal turns link as one; a quote without an
origin is removed and counted in n_unlinked; an empty table gives an empty table; columns besides the four
aren't read, so their names can't clash. Texts of any length are read whole, in linear time.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, table

_MARKS = re.compile(r"[ \t]{0,3}(?:[>|][ \t]?)+")
# How a line that introduces a quote begins, and the verb in it.
_BEGINS = re.compile(r"(?:on|am|le|el|il)\b", re.I)
_VERB = re.compile(r"\b(?:wrote|schrieb|écrit|escribió|scritto)", re.I)
_TRIM = " \t\"'.,;:!?*_-"


def introduces(line: str) -> bool:
    """Whether a line like "On … wrote:" introduces a quote: its verb stands after the last colon but the one at its end."""
    line = line.strip()
    return line.endswith(":") and bool((m := _BEGINS.match(line)) and _VERB.search(line, max(m.end(), line.rfind(":", 0, -1) + 1)))


def split_levels(text: str) -> list[tuple[int, str]]:
    """(level, passage) of the runs of lines at one level, in order."""
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        level = m[0].count(">") + m[0].count("|") if m else 0
        if level and ">" not in m[0] and not out and "|" in line[m.end() :]:
            level = 0  # a table's row rather than a quote
        rest = line[m.end() :] if level else line
        if out and out[-1][0] == level:
            out[-1][1].append(rest)
        else:
            out.append((level, [rest]))
    for i, (level, lines) in enumerate(out[:-1]):
        if level < out[i + 1][0]:  # a quote's introduction
            at = len(lines) - 1
            while at >= 0 and not lines[at].strip():
                at -= 1
            if at >= 0 and introduces(lines[at]):
                del lines[at:]
    return [(level, "\n".join(lines)) for level, lines in out]


def normalised(passage: str) -> str:
    return " ".join(passage.lower().split()).strip(_TRIM)


def passage_hashes(passage: str) -> dict[bytes, int]:
    """Hashes of the whole passage, its paragraphs and its lines, with their lengths."""
    parts = [passage, *re.split(r"\n[ \t]*\n", passage), *passage.split("\n")]
    return {xxhash.xxh3_128_digest(n.encode("utf-8", "surrogatepass")): len(n) for p in parts if (n := normalised(p))}


_QUOTE = pa.struct([("level", pa.int32()), ("n", pa.int32()), ("hash", pa.binary()), ("size", pa.int32())])


def parse(chats: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, own text, hashes of own passages, quotes (level, number, hash) of each message."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        own_text, own, quotes = [], [], []
        for t in b.column(3).to_pylist():
            runs = split_levels(t or "")
            mine = "\n".join(p for level, p in runs if not level)
            mine = re.sub(r"\n{3,}", "\n\n", mine).strip() if len(runs) > 1 or runs[0][0] else t or ""
            own_text.append(mine)
            own.append([*passage_hashes("\n\n".join(p for level, p in runs if not level))] + ([] if len(runs) == 1 else [h for level, p in runs if not level for h in passage_hashes(p)]))
            quotes.append([{"level": level, "n": i, "hash": h, "size": size} for i, (level, p) in enumerate(runs) if level for h, size in passage_hashes(p).items()])
        return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(own_text, b.column(3).type), pa.array(own, pa.list_(pa.binary())), pa.array(quotes, pa.list_(_QUOTE))], names=["c", "t", "r", "x", "o", "q"])

    kind = lambda c: chats.schema[c].dataType.simpleString()
    return arrow_map(chats.select(conv, turn, role, text), one, f"conv {kind(conv)}, turn {kind(turn)}, role {kind(role)}, text string, own array<binary>, quotes array<struct<level:int,n:int,hash:binary,size:int>>")


def link_quotes(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text without quotes, reply_to, thread, quoted, n_quotes, n_unlinked of each message.

    reply_to: the turn it replies to by its quotes, else null; thread: the first turn of its thread; quoted: the
    turns its quotes come from, sorted. Sorted by (conv, thread, turn), a conversation is in reply order.
    """
    scratch = Scratch(chats.sparkSession, "quotes")
    rows = scratch.keep(parse(chats, conv, turn, role, text).withColumn("rid", F.monotonically_increasing_id()))
    known = rows.where("conv is not null and turn is not null")
    quotes = scratch.keep(known.where(F.size("quotes") > 0).select("rid", "conv", "turn", F.explode("quotes").alias("q")).select("rid", "conv", "turn", "q.*"))
    asked = quotes.select("conv", "hash").distinct()
    origins = known.select("conv", "turn", F.explode("own").alias("hash")).groupBy("conv", "hash").agg(F.min("turn").alias("origin")).join(asked, ["conv", "hash"], "left_semi")
    linked = quotes.join(origins, ["conv", "hash"], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    each = linked.groupBy("rid", "conv", "turn", "n", "level").agg(F.max(F.when(F.col("origin").isNotNull(), F.struct("size", "origin")))["origin"].alias("origin"))
    told = each.groupBy("rid", "conv", "turn").agg(
        F.coalesce(F.max(F.when(F.col("level") == 1, F.col("origin"))), F.max("origin")).alias("reply_to"),
        F.sort_array(F.collect_set("origin")).alias("quoted"),
        F.count("*").alias("n_quotes"),
        F.count_if(F.col("origin").isNull()).alias("n_unlinked"),
    )
    told = scratch.keep(told)
    roots = scratch.keep(told.where("reply_to is not null").groupBy("conv", "turn").agg(F.max("reply_to").alias("root")))
    while True:  # a message's root becomes its root's root
        up = roots.select("conv", F.col("turn").alias("root"), F.col("root").alias("top"))
        now = scratch.keep(roots.join(up, ["conv", "root"], "left").select("conv", "turn", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            break
        roots = now.select("conv", "turn", "root")
    threads = now.select("conv", "turn", F.col("root").alias("thread"))
    out = rows.select("rid", "conv", "turn", "role", "text").join(told.select("rid", "reply_to", "quoted", "n_quotes", "n_unlinked"), "rid", "left").join(threads, ["conv", "turn"], "left")
    none = F.array().cast(told.schema["quoted"].dataType)
    return out.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), F.col("text").alias(text), "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("quoted", none).alias("quoted"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_unlinked", F.lit(0)).alias("n_unlinked")
    )


def in_reply_order(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The conversations of link_quotes(), one after the other, each in reply order."""
    return messages.orderBy(conv, "thread", turn)


def chat_text(role: F.Column, text: F.Column) -> F.Column:
    """One message in a plain chat format."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def op4_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of conversations in reply order, one row each, with its links and its formatted text."""
    out = in_reply_order(link_quotes(table(spark, sf_dir, "conversations")))
    return out.withColumn("chat", chat_text(F.col("role"), F.col("text")))
