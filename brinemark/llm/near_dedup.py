"""Near-duplicate groups by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the hashes of the text's features
(word shingles with repeats; a text with fewer words has one, the whole; a text without words has
fingerprint zero). Two fingerprints link if at most r bits differ.

Covering masks. Give each bit position a vector of r + 1 bits, not zero, in turn; mask v, one for each of the
2**(r+1) - 1 vectors v that aren't zero, keeps the positions whose vector has an odd product with v. The
vectors of at most r differing positions never span the whole space, so some v is orthogonal to
all of them: mask v keeps none of these positions, and the pair has the same masked bits. No linked pair
is missed. Buckets of up to SMALL fingerprints compare their members; the members of a larger one are hashed
again with masks that also keep some of the bits left out, down to where distinct fingerprints can't fill a bucket.
Equal texts are one fingerprint from the start, so no copies are paired.

Components come from rounds of minimum labels over neighbours with parent jumps. A fingerprint has a bounded number of
neighbours; a leader's many edges (below) meet only in partial minima and in joins whose large side Spark splits.
Rounds are written to the shared folder, and only a count comes to the driver.

keep_one() is the pipeline's form. A link there is a Jaccard similarity of at least 0.8 between sets of five-word
shingles. First come fingerprints (of two-word shingles, which an edit changes less) under covering masks for WIDE bits: buckets of
up to SMALL compare their members, larger ones theirs with that of most copies; texts whose fingerprints link, checked by their
exact sets, make components. A radius that reaches every pair at 0.8 would need far too many masks, so what fingerprints
don't reach comes from an exact way, over keys that texts of several components have: prefixes. With every set in one order of shingles (rarer ones first, by a sample), two sets of that similarity share one of
SHARED of the first n - ceil(0.8 n) + SHARED of each (or all they have in common), and what follows their first one in both must be long enough for the
overlap. No such pair is missed, whatever the order. Buckets of up to BUCKET members count what two members share. Members of larger ones are first compared with leaders of their buckets
(with that of most copies, then with others) and joined to components; a bucket whose members are in one component is settled. In the others, every
two members of different components are compared. So a group of n copies costs about n comparisons and not n * n, and
only pairs that a chain of links joins already are left out. A bitmap of each set's parities rules out pairs that can't be similar, and no
others; every candidate left is checked with the exact sets.

Cases: null texts count as empty; empty texts have fingerprint zero and are copies of each other; null ids
stay, and a component's id is the smallest that isn't null; repeated rows are copies; an empty table gives
an empty table; columns besides id and text aren't read by near_groups(), and keep_one() returns the columns of its input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, col, likely, located, place, signed, table

BITS = 64
SEED = 42
SMALL = 24
LEVELS = 5
RADIUS, SHINGLE = 2, 3
SIMILARITY, VERIFY_SHINGLE = 0.8, 5
WIDE, WIDE_SHINGLE = 4, 2
LEADER_ROUNDS, SAMPLE, FREQUENT, SLACK = 2, 10_000, 1 << 16, 1e-9
SHARED, BUCKET = 3, 48
BLOCK = 1 << 14  # shingles of a text that are worked on at once

_BIT_OF = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(2048, np.int64)
    for i in range(0, n, BLOCK):  # a long text's lanes would be many times its size
        lanes = hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.bincount((lanes + np.arange(8, dtype=np.int64) * 256).ravel(), minlength=2048)
    counts = counts.reshape(8, 256)
    ones = (counts @ _BIT_OF).ravel()  # lane by lane, lowest bit first
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def shingle_hashes(words: list[bytes], k: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each k-word shingle, words joined by one space."""
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(b" ".join(words), seed)], np.uint64)
    whole = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start, end = (end - size)[: len(words) - k + 1], end[k - 1 :]
    out = np.empty(len(start), np.uint64)
    for i in range(0, len(start), BLOCK):
        out[i : i + BLOCK] = [h(whole[a:b], seed) for a, b in zip(start[i : i + BLOCK].tolist(), end[i : i + BLOCK].tolist(), strict=True)]
    return out


def lowered(column: pa.Array) -> Iterator[bytes]:
    """The texts' bytes with A-Z in lower case, one at a time; nulls are empty."""
    for x in column:
        yield x.as_buffer().to_pybytes().lower() if x.is_valid else b""


def to_signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """id and fp, the fingerprint as a signed long."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = [to_signed(majority(shingle_hashes(t.split(), shingle))) for t in lowered(b.column(1))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["id", "fp"])

    return arrow_map(docs.select(id_col, text), one, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def masks(radius: int, level: int = 0) -> list[int]:
    """The covering masks as signed longs; each level deals the vectors out to the bits in another order."""
    n = (1 << (radius + 1)) - 1
    deal = np.random.Generator(np.random.PCG64(level)).permutation(BITS) if level else np.arange(BITS)
    vector = np.empty(BITS, np.int64)
    vector[deal] = np.arange(BITS) % n + 1
    out = []
    for v in range(1, n + 1):
        odd = np.bitwise_count(vector & v) & 1
        out.append(to_signed(int.from_bytes(np.packbits(odd.astype(bool), bitorder="little").tobytes(), "little")))
    return out


def close_in(lists: str, radius: int) -> Column:
    """The pairs a < b of a list of fingerprints that link."""
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    return F.flatten(F.transform(lists, lambda x: F.transform(F.filter(lists, lambda y: (y > x) & near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def links(scratch: Scratch, rows: DataFrame, radius: int, small: int = SMALL) -> DataFrame:
    """Pairs a < b of fp from rows (fp, distinct within grp; grp) that link within their grp."""
    out, now = [], rows.select("grp", "fp", F.lit(0).cast("long").alias("mask"))
    for level in range(LEVELS):
        more = F.explode(F.array(*[F.lit(m).cast("long") for m in masks(radius, level)])).alias("m")
        keyed = now.select("grp", "fp", "mask", more).select("grp", "fp", F.col("mask").bitwiseOR(F.col("m")).alias("mask"))
        keyed = keyed.select("grp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        if level:
            keyed = keyed.distinct()  # different paths lead to one mask
        # a table of its own, so that the join deals both sides anew and can split a hot bucket
        counts = scratch.keep(keyed.groupBy("grp", "mask", "key").agg(F.count("*").alias("n")).where("n > 1"))
        met = scratch.keep(keyed.join(counts, ["grp", "mask", "key"]), counts)
        fits = F.col("n") <= small if level < LEVELS - 1 else F.lit(True)
        lists = met.where(fits).groupBy("grp", "mask", "key").agg(F.sort_array(F.collect_list("fp")).alias("l"))
        out.append(lists.select("grp", F.explode(close_in("l", radius)).alias("p")).select("grp", "p.a", "p.b"))
        now = met.where(~fits).select("grp", "fp", "mask")
        if level == LEVELS - 1 or now.isEmpty():
            break
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every.distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """node and root, the smallest node that a chain of edges (a, b) reaches."""
    both = scratch.keep(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")))
    labels = scratch.keep(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("root")))
    while True:
        of = labels.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        seen = both.join(of, "v").groupBy("u").agg(F.min("rv").alias("low"))
        own = labels.join(seen, labels.node == seen.u).select("node", "root", F.least("root", "low").alias("low"))
        # a node's better label is also an offer to its old root
        offers = own.select("node", "low").unionByName(own.select(F.col("root").alias("node"), "low"))
        better = offers.groupBy("node").agg(F.min("low").alias("root"))
        up = better.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = better.join(up, "root").join(labels.select("node", F.col("root").alias("old")), "node").select("node", F.col("top").alias("root"), "old")
        now = scratch.keep(jumped)
        moved = now.where("root <> old").count()
        if not moved:
            return now.select("node", "root")
        labels = now.select("node", "root")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """id, fp (signed long) and component, the smallest id of the linked group, of each row."""
    scratch = Scratch(docs.sparkSession, "near")
    rows = scratch.keep(fingerprints(docs, id_col, text, shingle))
    distinct = scratch.keep(rows.groupBy("fp").agg(F.min(id_col).alias("low")))
    found = components(scratch, scratch.keep(links(scratch, distinct.select(F.lit(0).alias("grp"), "fp"), radius)))
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    of_fp = scratch.keep(rooted.join(lowest, "root").select("fp", "component"))
    return rows.join(of_fp, "fp", "left").select(id_col, "fp", "component")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles met most often in about SAMPLE rows, sorted, and how often. They only order shingles: any order gives the same links."""

    def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for t in lowered(b.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.unique(shingle_hashes(t.split(), shingle))), pa.int64())], names=["gram"])

    every = max(1, docs.count() // SAMPLE)
    grams = arrow_map(docs.where(F.pmod(F.xxhash64("_f", "_r"), F.lit(every)) == 0).select("text"), one, "gram long")
    top = grams.groupBy("gram").count().where("count > 1").orderBy(F.desc("count"), "gram").limit(FREQUENT).toPandas().sort_values("gram")
    return top["gram"].to_numpy(np.int64), top["count"].to_numpy(np.int64)


def prefix(grams: np.ndarray, often: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first of a set of shingles in the order by (frequency, hash): enough that two similar sets share SHARED, or as many as they have in common."""
    n, (known, count) = len(grams), often
    rank = np.zeros(n, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        rank = np.where(known[at] == grams, count[at], 0)
    return grams[np.lexsort((grams, rank))[: n - math.ceil(similarity * n - SLACK) + SHARED]]


def parities(grams: np.ndarray) -> np.ndarray:
    """A bitmap of a set: the parity of the shingles at each place; as many places as the power of two from the set's size up, 64 at least."""
    places = 1 << max(6, (len(grams) - 1).bit_length() if len(grams) else 0)
    odd = np.bincount(grams & (places - 1), minlength=places) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    flat = pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), pa.int64())
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), flat)


def prefixes(docs: DataFrame, shingle: int, similarity: float, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """_f, _r, id, same (hash of the words), fp (fingerprint for WIDE), n (size of the set of shingles), pre (its prefix) and bits (its parities) of each row (_f, _r, id, text)."""
    shipped = docs.sparkSession.sparkContext.broadcast(often)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        same, fp, size, pre, bits = [], [], [], [], []
        for t in lowered(b.column(3)):
            words = t.split()
            same.append(xxhash.xxh3_128_digest(b" ".join(words)))
            fp.append(to_signed(majority(shingle_hashes(words, WIDE_SHINGLE))))
            grams = np.sort(signed(np.unique(shingle_hashes(words, shingle))))
            size.append(len(grams))
            pre.append(prefix(grams, shipped.value, similarity))
            bits.append(parities(grams))
        return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(same, pa.binary()), pa.array(fp, pa.int64()), pa.array(size, pa.int32()), _lists(pre), _lists(bits)], names=["f", "r", "id", "same", "fp", "n", "pre", "bits"])

    return arrow_map(docs, one, f"_f long, _r long, id {docs.schema['id'].dataType.simpleString()}, same binary, fp long, n int, pre array<long>, bits array<long>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """rep and grams, the sorted set of shingle hashes, of rows (rep, text)."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), _lists([np.sort(signed(np.unique(shingle_hashes(t.split(), shingle)))) for t in lowered(b.column(1))])], names=["rep", "grams"])

    return arrow_map(docs.select("rep", "text"), one, "rep long, grams array<long>")


#: Where two sets x and y first meet, what is left of both must hold the whole overlap, but for what they may have shared before.
_FITS = "least({0}.rest, {1}.rest) + {before} >= {s!r}D / (1 + {s!r}D) * ({0}.n + {1}.n) - {slack!r}D"
#: A bitmap as long as the shorter of two; its halves are added where it is longer.
_FOLDED = "if(size({0}) > size({1}), transform(slice({0}, 1, size({1})), (v, i) -> v ^ {0}[i + size({1})]), {0})"


def plausible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that their bitmaps (rep, n, bits) allow to be similar.

    Each shingle that only one of two sets has changes one bit of the bitmaps' difference, so these sets have at least as
    many of them as the difference has bits; no similar pair is dropped. Sets whose bitmaps differ in length by more than a factor
    of two aren't similar.
    """
    of = lambda c: sketches.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"t{c}"))
    both = pairs.join(of("a"), "a").where(F.expr("na > 0")).join(of("b"), "b").where(f"least(na, nb) >= {similarity!r}D * greatest(na, nb) - {SLACK!r}D")
    apart = f"aggregate(zip_with({_FOLDED.format('ta', 'tb')}, {_FOLDED.format('tb', 'ta')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    return both.where(F.expr(f"{apart} <= (1 - {similarity!r}D) / (1 + {similarity!r}D) * (na + nb) + {SLACK!r}D")).select("a", "b")


def similar(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of grams (rep, grams) have at least this Jaccard similarity."""
    x = pairs.join(grams.select(F.col("rep").alias("a"), F.col("grams").alias("ga")), "a").join(grams.select(F.col("rep").alias("b"), F.col("grams").alias("gb")), "b")
    both = F.size(F.array_intersect("ga", "gb"))
    return x.where(both >= F.lit(float(similarity)) * (F.size("ga") + F.size("gb") - both)).select("a", "b")


def unsettled(met: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of met (key, rep, root, …) with new roots from labels (node, root), in buckets that hold several roots."""
    now = met.drop("root").join(labels.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return now.join(mixed, "key").select(*met.columns)


def fingerprint_pairs(scratch: Scratch, own: DataFrame, radius: int = WIDE, small: int = SMALL) -> DataFrame:
    """Pairs a < b of rep from rows (rep, copies, fp) that fingerprints make: of each fingerprint's texts with that of most copies, and of those
    with such texts of linked fingerprints; in buckets above small, links to the fingerprint of most copies alone, one a member."""
    fps = scratch.keep(own.groupBy("fp").agg(F.max(F.struct("copies", "rep")).alias("top")).select("fp", F.col("top.copies").alias("copies"), F.col("top.rep").alias("rep")))
    keyed = fps.select("fp", "copies", F.explode(F.array(*[F.lit(m).cast("long") for m in masks(radius)])).alias("mask"))
    keyed = keyed.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "copies")
    counts = scratch.keep(keyed.groupBy("mask", "key").agg(F.count("*").alias("n"), F.max(F.struct("copies", "fp"))["fp"].alias("lead")).where("n > 1"))
    met = scratch.keep(keyed.join(counts, ["mask", "key"]).select("mask", "key", "fp", "n", "lead"), counts)
    lists = met.where(F.col("n") <= small).groupBy("mask", "key").agg(F.sort_array(F.collect_list("fp")).alias("l"))
    near = lists.select(F.explode(close_in("l", radius)).alias("p")).select("p.a", "p.b")
    led = met.where(F.col("n") > small).where(F.col("fp") != F.col("lead")).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("lead"))) <= radius)
    linked = scratch.keep(near.unionByName(led.select(F.least("fp", "lead").alias("a"), F.greatest("fp", "lead").alias("b"))).distinct(), met)
    of = lambda c: fps.select(F.col("fp").alias(c), F.col("rep").alias(f"r{c}"))
    across = linked.join(of("a"), "a").join(of("b"), "b").select("ra", "rb")
    equal = own.select("fp", F.col("rep").alias("ra")).join(fps.select("fp", F.col("rep").alias("rb")), "fp").where("ra <> rb").select("ra", "rb")
    return across.unionByName(equal).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = VERIFY_SHINGLE) -> DataFrame:
    """The rows of docs that stay when each group of near duplicates keeps one; of equal texts that with the smallest id, null first."""
    scratch = Scratch(docs.sparkSession, "keep-one")
    whole = located(scratch, docs)
    placed = place(whole, id=id_col, text=text)
    rows = scratch.keep(prefixes(placed, shingle, similarity, frequent(placed, shingle)))
    # a class of equal texts is one row here; rep is a number for it
    first = rows.groupBy("same").agg(F.min(F.struct("id", "_f", "_r")).alias("first"), F.count("*").alias("copies"))
    first = scratch.keep(first.select("copies", F.xxhash64("same").alias("rep"), F.col("first._f").alias("_f"), F.col("first._r").alias("_r")))
    own = scratch.keep(rows.join(first, ["_f", "_r"]).where("n > 0").select("rep", "copies", "fp", "n", "pre", "bits"), rows)
    sizes, sketches = own.select("rep", "n", "copies"), own.select("rep", "n", "bits")

    def linked(asked: DataFrame) -> DataFrame:
        """The similar ones of plausible pairs; only texts in them are read again."""
        reps = asked.select(F.col("a").alias("rep")).union(asked.select("b")).distinct()
        at = scratch.keep(first.join(reps, "rep", "left_semi").select("_f", "_r", "rep"))
        grams = scratch.keep(shingle_sets(likely(placed.select("_f", "_r", "text"), at).join(at, ["_f", "_r"]), shingle), at)
        return scratch.keep(similar(asked, grams, similarity), grams)

    edges = linked(scratch.keep(plausible(fingerprint_pairs(scratch, own), sketches, similarity)))
    labels = components(scratch, edges)
    # rest: what of the set begins at the key
    rooted = own.select("rep", "n", "pre").join(labels, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep"))
    keyed = rooted.select("rep", "root", "n", F.posexplode("pre").alias("pos", "key")).select("key", "rep", "root", (F.col("n") - F.col("pos")).alias("rest"))
    # a table of its own, so that the join deals both sides anew and can split a hot key; texts of one component need no key
    mixed = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    mixed = scratch.keep(mixed.select("key", "size"))
    every = scratch.keep(keyed.join(mixed, "key"), mixed)
    fits = lambda x, y, before=0: _FITS.format(x, y, s=similarity, slack=SLACK, before=before)
    small = every.where(F.col("size") <= BUCKET).join(sizes, "rep")
    pairs = small.alias("x").join(small.alias("y"), "key").where("x.rep < y.rep and x.root <> y.root").groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    pairs = pairs.agg(F.count("*").alias("shared"), F.max(F.expr(fits("x", "y"))).alias("fits"), F.max(F.greatest("x.n", "y.n")).alias("most"))
    # a pair with fewer shared keys than it needs meets in larger buckets too, or isn't similar
    pairs = scratch.keep(pairs.where(f"fits and shared >= least({SHARED}, ceil({similarity!r}D * most - {SLACK!r}D))").select("a", "b"))
    met = scratch.keep(every.where(F.col("size") > BUCKET).join(sizes, "rep").select("key", "rep", "n", "rest", "copies", "root"), every)
    pairs = scratch.keep(plausible(pairs, sketches, similarity), pairs)
    for turn in range(1 + LEADER_ROUNDS):
        if met.isEmpty():
            break
        best = F.struct((F.xxhash64(F.lit(turn), "rep") if turn else F.col("copies")).alias("top"), "rep", "root", "n", "rest")
        lead = met.groupBy("key").agg(F.max(best).alias("l"))
        led = met.alias("m").join(lead, "key").where("root <> l.root and " + fits("m", "l")).select(F.col("m.rep").alias("a"), F.col("l.rep").alias("b"), F.col("l.top").alias("top"))
        # at first only the leader with most copies of all that a member meets: most of a large group links to it
        led = led.select("a", "b").distinct() if turn else led.groupBy("a").agg(F.max_by("b", F.struct("top", "b")).alias("b"))
        asked = scratch.keep(plausible(led, sketches, similarity))
        if not asked.isEmpty():
            edges = edges.unionByName(linked(asked))
            labels = components(scratch, edges)
            met = scratch.keep(unsettled(met, labels), met)
    # pairs that no chain of links joins yet; fewer than SHARED keys of smaller buckets may come before their first one here
    large = met.alias("x").join(met.alias("y"), "key").where("x.rep < y.rep and x.root <> y.root and " + fits("x", "y", SHARED - 1)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    of = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    small = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("ra is null or rb is null or ra <> rb").select("a", "b")
    asked = scratch.keep(plausible(large.distinct(), sketches, similarity).unionByName(small).distinct(), pairs, met)
    gone = components(scratch, scratch.keep(edges.unionByName(linked(asked)), asked)).where("node <> root").select(F.col("node").alias("rep"))
    stay = scratch.keep(first.join(gone, "rep", "left_anti").select("_f", "_r"), own)
    f, r = whole.place_columns
    return whole.join(stay.select(F.col("_f").alias(f), F.col("_r").alias(r)), [f, r], "left_semi").select(*map(col, docs.columns))
