"""Mixing of sources to target weights with DataFrame functions only.

Each source gets a target number of words: its weight's share of a total, but at most max_epochs times
what it has; what is cut off goes to the other sources by weight until none is above. The closed form is
a water level: with sources in the order of cap / weight, the first whose cap isn't reached by
(total - caps so far) / (weights from here on) fixes the level for itself and the rest.

Within a source, whole epochs come first: floor(target / size) copies of every document. The rest of the
target is drawn without replacement by exponential keys, -ln(u) / quality (Efraimidis and Spirakis):
documents in key order are taken until their words fill the rest; the document that crosses the end
gives the words that are missing, its first ones. u is made of a hash of seed, id and text, so
reruns agree.

No source is sorted as a whole. Keys fall into equal shares of the unit interval; sums of words by
source and share, pre-aggregated on the map side, tell in which share the budget ends. Shares before
it are taken, shares after it aren't, and only that one share of each source is sorted.

Cases: a null or empty text has size 0 and takes 0; a null source is a source of its own, ordered last;
a null id is an id like any other; repeated rows have equal keys and are drawn one after another; a
source without words has target 0; an empty table gives an empty table. Columns besides the id, text and
source aren't read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, col, fresh, located, table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SHARES = 4096
MAX_EPOCHS = 3.0
SEED = "mix-1"
_OWN = ("size", "source_size", "target", "taken")


def size_of(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: str) -> F.Column:
    """A document's weight in the draw: words without symbols count in full; each symbol for each character costs."""
    chars = F.length(text)
    kept = F.length(F.translate(F.col(text), SYMBOLS, ""))
    return F.when(chars > 0, 0.05 + 0.95 * (kept / chars)).otherwise(F.lit(1.0))


def uniform(*cols: F.Column) -> F.Column:
    """A number in (0, 1) from the first 52 bits of a hash of the columns."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, total: F.Column | None = None, weight: F.Column | None = None, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, weight, target from source, source_size.

    The windows are over one row for each source. weight: 1, 2, 3, repeating by source name, if absent; total: all words.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.select("source", "source_size", F.row_number().over(by_name).alias("rank"))
    rows = rows.select("source", "source_size", (weight if weight is not None else ((F.col("rank") - 1) % 3 + 1)).cast("double").alias("weight"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    rows = rows.withColumns({"cap": F.col("source_size") * max_epochs, "ratio": F.col("source_size") * max_epochs / F.col("weight"), "total": (total if total is not None else F.sum("source_size").over(W.partitionBy())).cast("double")})
    rows = rows.withColumns({"before": F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)), "rest": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))})
    rows = rows.withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(W.partitionBy()).level
    rows = rows.withColumn("water", level)
    return rows.select("source", "source_size", "weight", F.when(F.col("water").isNull() | (F.col("water") >= F.col("ratio")), F.col("cap")).otherwise(F.col("weight") * F.col("water")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", quality: F.Column | None = None, max_epochs: float = MAX_EPOCHS, seed: str = SEED, shares: int = SHARES, carry: list[str] | None = None) -> DataFrame:
    """id, source, size, source_size, target, taken of each row; taken is at most max_epochs * size.

    carry: columns of docs to return instead of id and source; rows are then found again by file and place. A carried
    column with the name of one of the mix's own gets an underscore before it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    if carry is not None:
        docs = located(scratch, docs)
    q = quality if quality is not None else quality_of(text)
    at = list(docs.place_columns) if carry is not None else []
    place = fresh([*(carry or ()), *_OWN, "id", "source", "key", "share"], "_f", "_r")[: len(at)]
    rows = docs.select(*[col(x).alias(y) for x, y in zip(at, place, strict=True)], F.col(id_col).alias("id"), F.col(source).alias("source"), size_of(text).alias("size"), (-F.log(uniform(F.lit(seed), F.col(id_col), F.md5(text))) / q).alias("key"))
    # 1 - exp(-key) lies in the unit interval and keeps the order
    rows = scratch.keep(rows.withColumn("share", F.floor((1 - F.exp(-F.col("key"))) * shares).cast("int")))
    sums = scratch.keep(rows.groupBy("source", "share").agg(F.sum("size").alias("words")))
    each = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), max_epochs=max_epochs)
    each = each.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    each = each.withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    each = scratch.keep(each)
    so_far = W.partitionBy("source").orderBy("share")
    running = sums.withColumn("upto", F.sum("words").over(so_far))
    joined = running.alias("a").join(each.alias("b"), F.expr("a.source <=> b.source"))
    ends = joined.where("upto >= budget and words > 0").groupBy("b.source").agg(F.min(F.struct("share", (F.col("upto") - F.col("words")).alias("done"))).alias("end"))
    plan = scratch.keep(
        each.alias("b").join(ends.alias("e"), F.expr("b.source <=> e.source"), "left").select("b.*", F.coalesce(F.col("end.share"), F.lit(shares)).alias("edge"), F.coalesce(F.col("end.done"), F.lit(0)).alias("done"))
    )
    with_plan = rows.alias("r").join(plan.alias("p"), F.expr("r.source <=> p.source")).select("r.*", "p.source_size", "p.target", "p.epochs", "p.budget", "p.edge", "p.done")
    told = [*place, "id", "source", "size", "source_size", "target"]
    clear = with_plan.where("share <> edge").select(*told, (F.col("size") * (F.col("epochs") + (F.col("share") < F.col("edge")).cast("long"))).alias("taken"))
    inner = W.partitionBy("source").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("done") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    edge = with_plan.where("share = edge").withColumn("before", before)
    edge = edge.select(*told, (F.col("size") * F.col("epochs") + F.greatest(F.lit(0), F.least("size", F.col("budget") - F.col("before")))).cast("long").alias("taken"))
    mixed = clear.unionByName(edge)
    if carry is None:
        return mixed
    names = fresh([*_OWN], *carry)
    return docs.select(*[col(x).alias(y) for x, y in zip([*at, *carry], [*place, *names], strict=True)]).join(mixed.select(*place, *_OWN), place).select(*map(col, names), *_OWN)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


_SIZE = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT"
_KEY = r"""-ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(md5(text), '-')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
   / (CASE WHEN length(text) > 0 THEN 0.05 + 0.95 * (length(translate(text, '#*$%&|<>', '')) / length(text)) ELSE 1.0 END)"""


def mix_sql(docs: str = "documents", key: str = _KEY) -> str:
    """DuckDB SQL with source besides the columns of the query."""
    return rf"""
WITH d AS (SELECT doc_id, source, {_SIZE} AS size, {key} AS key FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
r AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS ratio FROM w),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
        sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r),
l AS (SELECT *, (total - before) / rest AS level FROM o),
m AS (SELECT *, (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1) AS water FROM l),
t AS (SELECT source, source_size, CASE WHEN water IS NULL OR water >= ratio THEN cap ELSE weight * water END AS target FROM m),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
b AS (SELECT *, round(target - epochs * source_size)::BIGINT AS budget FROM e),
x AS (SELECT d.*, b.source_size, b.target, b.epochs, b.budget,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, size, source_size, target, (size * epochs + greatest(0, least(size, budget - before)))::BIGINT AS taken FROM x"""


SQL = f"SELECT doc_id, size, source_size, target, taken FROM ({mix_sql()})"
