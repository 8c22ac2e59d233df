"""Removal of passages that repeat: every word covered by a window of words that also starts elsewhere.

The suffixes that start at the words of a corpus form a tree; a window repeats if the node at its depth has two
leaves or more, and below such a node lie the maximal repeats. The tree is built in parts, each of the suffixes that share a prefix:

1. Each window is dealt by a short prefix of one of its suffixes: of its GRAM-word grams the one with the
   smallest hash, leftmost first. Equal windows choose the same gram at the same place, so they meet in one part, and
   neighbouring windows mostly share a gram: one row, with hashes of the gram and of all its words, stands for a run of windows.
2. Counts of equal runs and of runs of a gram, pre-aggregated on the map side, tell what a part holds. A gram that occurs once
   has no repeated window. A part of equal runs is one path; its nodes have as many leaves as there are runs, and no text is needed.
   For the others, the words of one run of each kind are cut out of the texts.
3. Prefixes have variable length. A part of more than PART_BYTES is split by longer prefixes, of 22, 29, 33 and 35 words or so, until it fits: the
   windows that hold the longer prefix to the right go by that; the others hold words before the prefix, and go by
   the prefix of equal length that begins there. A run becomes two runs at most, equal ones are merged again, and with whole
   windows as prefixes every part is one path.
4. In a part, prefix doubling sorts the suffixes (the suffix array), and the names of its steps give the longest common prefix of
   neighbours. Neighbours with WINDOW words or more in common lie below one deep internal node; the longest such prefix of
   a suffix is the maximal repeat that starts there.
5. Repeats go back to their documents by row, and texts are cut.

Words are runs of bytes other than white space, compared as they are; runs of a gram are told apart by a 64-bit hash of their words
besides the gram's. Windows are judged on the input.

Cases: a null, empty or short text has no window and loses nothing; repeated rows repeat each other's windows; a
null id stays null; ties between grams go to the leftmost; an empty table gives an empty table; other columns aren't
read, so their names can't clash. Texts of any length are read whole; one text's words are in memory at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Scratch, Words, arrow_map, chunks, gram_hash, likely, located, mix, place, signed, table, text_bytes

WINDOW = 35
GRAM = 8
PART_BYTES = 4 << 20  # words of a part that one task sorts at once
BLOCK = 1 << 20  # windows that are dealt at once
_PLACE = np.uint64((1 << 21) - 1)
# Odd factors of two polynomial hashes.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _power(base: int, at: np.ndarray) -> np.ndarray:
    """base to the powers at, modulo 2**64, from two short tables."""
    small = np.full(4096, base, np.uint64)
    small[0] = 1
    small = np.multiply.accumulate(small)
    large = np.full(int(at.max(initial=0)) // 4096 + 1, pow(base, 4096, 1 << 64), np.uint64)
    large[0] = 1
    return np.multiply.accumulate(large)[at >> 12] * small[at & 4095]


def range_hash(h: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of consecutive hashes, by two polynomials."""
    out, here = np.zeros(len(first), np.uint64), np.arange(len(h))
    for base in _FACTORS:
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * _power(base, here), out=total[1:])
        out = mix(out + (total[stop] - total[first]) * _power(pow(base, -1, 1 << 64), first))
        h = mix(h)
    return out


def runs(w: Words, window: int, gram: int):
    """(text, first window, last window, gram's place in the run, gram hash, hash of the run's words) of the runs of windows that choose one gram.

    Window numbers are word numbers in the text.
    """
    every = w.windows(window)
    span = window - gram + 1
    for i in range(0, len(every), BLOCK):
        starts = every[i : i + BLOCK]
        # texts shorter than a window may lie between two windows; pieces of BLOCK words keep places small
        for cut in np.split(starts, np.searchsorted(starts, np.arange(starts[0] + BLOCK, starts[-1] + 1, BLOCK))):
            if not len(cut):
                continue
            base, stop = int(cut[0]), int(cut[-1]) + window
            h = w.hash[base:stop]
            g = gram_hash(h, np.arange(len(h) - gram + 1), gram)
            best, width = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64), 1  # the place decides ties
            while width * 2 <= span:
                best = np.minimum(best[: len(best) - width], best[width:])
                width *= 2
            at = (np.minimum(best[cut - base], best[cut - base + span - width]) & _PLACE).astype(np.int64)
            new = np.flatnonzero((at[1:] != at[:-1]) | (cut[1:] != cut[:-1] + 1)) + 1
            first, last = np.concatenate([[0], new]), np.concatenate([new, [len(at)]]) - 1
            doc = w.doc[cut[first]]
            yield doc, cut[first] - w.first[doc], cut[last] - w.first[doc], at[first] - (cut[first] - base), g[at[first]], range_hash(h, cut[first] - base, cut[last] - base + window)


def repeats(segments: pa.Array, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first word, stop) of the maximal repeats of at least window words in segments that occur counts times, merged where they touch."""
    w = Words(*text_bytes(segments))
    n, owner = len(w.start), w.doc
    end, here = (w.first + w.count)[owner], np.arange(n)
    names, step = [w.number], 1
    while step < int(w.count.max(initial=0)):
        # the order of the first 2 * step words; a suffix that ends before them comes first
        later = np.zeros(n, np.int64)
        inside = here + step < end
        later[inside] = names[-1][here[inside] + step] + 1
        names.append(np.unique(names[-1] * (int(later.max(initial=0)) + 1) + later, return_inverse=True)[1])
        step *= 2
    suffix = np.flatnonzero(here + window <= end)
    suffix = suffix[np.argsort(names[-1][suffix], kind="stable")]
    # the longest common prefix of neighbours in the suffix array, by steps that get shorter
    x, y = suffix[:-1], suffix[1:]
    common = np.zeros(len(x), np.int64)
    for k in range(len(names) - 1, -1, -1):
        i, j = x + common, y + common
        fits = (i + (1 << k) <= end[x]) & (j + (1 << k) <= end[y])
        same = np.zeros(len(x), bool)
        same[fits] = names[k][i[fits]] == names[k][j[fits]]
        common += same << k
    common[common < window] = 0  # not below a deep node
    longest = np.where(counts[owner[suffix]] >= 2, end[suffix] - suffix, 0)
    longest[1:] = np.maximum(longest[1:], common)
    longest[:-1] = np.maximum(longest[:-1], common)
    hit = np.flatnonzero(longest)
    hit = hit[np.argsort(suffix[hit])]
    a, b = suffix[hit], suffix[hit] + longest[hit]
    if not len(a):
        return a, a, b
    new = np.flatnonzero((a[1:] > b[:-1]) | (owner[a[1:]] != owner[a[:-1]])) + 1  # b doesn't fall along a segment
    first, last = np.concatenate([[0], new]), np.concatenate([new, [len(a)]]) - 1
    seg = owner[a[first]]
    return seg, a[first] - w.first[seg], b[last] - w.first[seg]


def _subtrees(window: int):
    """Over rows (part, sh, n, seg) sorted by part: part, sh, a and b of the repeats."""

    def build(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        seg, a, b = repeats(t.column(3).combine_chunks().cast(pa.string()), t.column(2).to_numpy(), window)
        part, sh = (t.column(i).to_numpy()[seg] for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (part, sh, a, b)], names=["part", "sh", "a", "b"])

    def over(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for x in batches:
            held.append(x)
            size += x.column(3).nbytes
            if size >= CHUNK_BYTES:
                t = pa.Table.from_batches(held)
                part = t.column(0).to_numpy()
                other = np.flatnonzero(part != part[-1])
                if len(other):
                    cut = int(other[-1]) + 1
                    yield build(t.slice(0, cut))
                    held = t.slice(cut).combine_chunks().to_batches()
                    size = sum(y.column(3).nbytes for y in held)
        if held:
            yield build(pa.Table.from_batches(held))

    return over


def longer(length: int, window: int) -> int:
    """The next length of a prefix: half of the windows hold it, the others one of equal length that begins before."""
    return (length + window + 2) // 2


def halves(m: int, x: int, y: int, window: int):
    """(side, first word, stop, x, y) of the runs into which a run of m words with the prefix from x to y is split."""
    size = longer(y - x, window)
    low, high = max(0, x + size - window), min(m - window, x + size - window - 1)
    if low <= m - window:
        yield 0, low, m, x - low, x + size - low
    if high >= 0:
        yield 1, 0, high + window, x + size - window - 1, y


def _split(window: int):
    """Over rows (part, sh, n, x, y, seg): the halves of each, with the run they come from and where they begin in it."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for part, sh, n, x, y, seg in zip(*[c.to_pylist() for c in b.columns], strict=True):
            words = seg.split(b" ")
            for side, i, j, p, q in halves(len(words), x, y, window):
                own = words[i:j]
                rows.append((part, sh, i, xxhash.xxh3_64_intdigest(b" ".join(own[p:q]), part % (1 << 63) + side) - (1 << 63), xxhash.xxh3_64_intdigest(b" ".join(own)) - (1 << 63), n, p, q, b" ".join(own)))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list("abcdefghi"))

    return one


def subtree_repeats(scratch: Scratch, segs: DataFrame, window: int, part_bytes: int) -> DataFrame:
    """part, sh, a, b: the repeats in each of segs (part, sh, n, x, y, seg), part by part; x, y: the prefix of the part."""
    found, links = None, []
    while True:
        sizes = scratch.keep(segs.groupBy("part").agg(F.count("*").alias("paths"), F.sum(F.length("seg")).alias("bytes")))
        sized = segs.join(sizes, "part")
        fits = sized.where(f"paths > 1 and bytes <= {part_bytes}").select("part", "sh", "n", "seg")
        got = fits.repartition("part").sortWithinPartitions("part").mapInArrow(_subtrees(window), "part long, sh long, a long, b long")
        path = sized.where("paths = 1 and n > 1").select("part", "sh", F.lit(0).cast("long").alias("a"), F.size(F.split(F.col("seg").cast("string"), " ")).cast("long").alias("b"))
        got = scratch.keep(got.unionByName(path))
        for link in reversed(links):  # back to the runs that were split
            back = link.join(got, ["part", "sh"]).select(F.col("from_part").alias("part"), F.col("from_sh").alias("sh"), (F.col("a") + F.col("at")).alias("a"), (F.col("b") + F.col("at")).alias("b"))
            got = scratch.keep(back, got)
        found = got if found is None else found.unionByName(got)
        large = sized.where(f"paths > 1 and bytes > {part_bytes}").select("part", "sh", "n", "x", "y", "seg")
        if sizes.where(f"paths > 1 and bytes > {part_bytes}").isEmpty():
            return found
        split = scratch.keep(arrow_map(large, _split(window), "from_part long, from_sh long, at int, part long, sh long, n long, x int, y int, seg binary"))
        links.append(split.select("from_part", "from_sh", "at", "part", "sh"))
        # equal halves merge; those of one hash have the same words
        segs = scratch.keep(split.groupBy("part", "sh").agg(F.sum("n").alias("n"), F.first("x").alias("x"), F.first("y").alias("y"), F.first("seg").alias("seg")), sizes)


def repeated_ranges(scratch: Scratch, placed: DataFrame, window: int = WINDOW, gram: int = GRAM, part_bytes: int = PART_BYTES) -> DataFrame:
    """_f, _r and ranges, the word ranges of each row (_f, _r, text) that repeated windows cover; rows without any are absent."""

    def scan(b: pa.RecordBatch):
        for i, j in chunks(b.column(2)):
            for doc, first, last, x, kh, sh in runs(Words(*text_bytes(b.column(2)[i:j])), window, gram):
                take = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *[pa.array(v.astype(np.int32)) for v in (first, last, x)], pa.array(signed(kh)), pa.array(signed(sh))], names=["_f", "_r", "a", "b", "x", "part", "sh"])

    anchors = scratch.keep(arrow_map(placed.select("_f", "_r", "text"), scan, "_f long, _r long, a int, b int, x int, part long, sh long"))
    # tables of their own, so that joins deal both sides anew and can split a hot gram
    parts = anchors.groupBy("part", "sh").agg(F.count("*").alias("n")).groupBy("part").agg(F.count("*").alias("paths"), F.sum("n").alias("runs"))
    parts = scratch.keep(parts.where("runs > 1").select("part", "paths"))
    met = scratch.keep(anchors.join(parts, "part"), anchors, parts)
    kinds = met.where("paths > 1").groupBy("part", "sh").agg(F.count("*").alias("n"), F.min(F.struct("_f", "_r", "a", "b", "x")).alias("at"))
    cuts = scratch.keep(kinds.groupBy("at._f", "at._r").agg(F.collect_list(F.struct("part", "sh", "n", "at.a", "at.b", "at.x")).alias("cuts")))

    def cut(b: pa.RecordBatch):
        for i, j in chunks(b.column(0)):
            data, offsets = text_bytes(b.column(0)[i:j])
            w, flat = Words(data, offsets), b.column(1)[i:j]
            doc = np.repeat(np.arange(len(flat)), pc.list_value_length(flat).to_numpy())
            part, sh, n, first, last, x = (v.to_numpy() for v in flat.flatten().flatten())
            begin, stop = w.start[w.first[doc] + first].tolist(), w.end[w.first[doc] + last + window - 1].tolist()
            whole = data.tobytes()
            seg = [b" ".join(whole[p:q].split()) for p, q in zip(begin, stop, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (part, sh, n, x, x + np.int32(gram))] + [pa.array(seg, pa.binary())], names=["part", "sh", "n", "x", "y", "seg"])

    texts = likely(placed.select("_f", "_r", "text"), cuts).join(cuts, ["_f", "_r"]).select("text", "cuts")
    segs = scratch.keep(arrow_map(texts, cut, "part long, sh long, n long, x int, y int, seg binary"), cuts)
    found = scratch.keep(subtree_repeats(scratch, segs, window, part_bytes).groupBy("part", "sh").agg(F.collect_list(F.struct("a", "b")).alias("own")))
    several = met.where("paths > 1").join(found, ["part", "sh"]).select("_f", "_r", F.transform("own", lambda x: F.struct((x.a + F.col("a")).alias("a"), (x.b + F.col("a")).alias("b"))).alias("own"))
    one = met.where("paths = 1").select("_f", "_r", F.array(F.struct(F.col("a").cast("long").alias("a"), (F.col("b") + window).cast("long").alias("b"))).alias("own"))
    return scratch.keep(several.unionByName(one).groupBy("_f", "_r").agg(F.flatten(F.collect_list("own")).alias("ranges")), met, segs, found)


def without(text: bytes, ranges: list[dict] | None) -> tuple[int, int, bytes]:
    """Words of a text, words in the ranges, and the other words joined by one space."""
    if not ranges and len(text) < CHUNK_BYTES:
        words = text.split()
        return len(words), 0, b" ".join(words)
    data = np.frombuffer(text + b" ", np.uint8).copy()
    w = Words(data, np.array([0, len(data)]))
    change = np.zeros(len(w.start) + 1, np.int64)
    for r in ranges or ():
        change[r["a"]] += 1
        change[r["b"]] -= 1
    stay = np.cumsum(change[:-1]) == 0
    edge = np.zeros(len(data) + 1, np.int8)
    edge[w.start[stay]] = 1
    data[w.end[stay]] = 0x20  # each word that stays takes the place after it along
    edge[w.end[stay] + 1] -= 1  # another word may begin there
    kept = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)].tobytes()
    return len(stay), int((~stay).sum()), kept[:-1]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, part_bytes: int = PART_BYTES) -> DataFrame:
    """id, n_words, n_removed and kept, the words that stay joined by one space, of each row."""
    scratch = Scratch(docs.sparkSession, "repeats")
    placed = place(located(scratch, docs), id=id_col, text=text)
    ranges = repeated_ranges(scratch, placed, window, gram, part_bytes)

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [without(t.as_buffer().to_pybytes() if t.is_valid else b"", r.as_py()) for t, r in zip(b.column(1), b.column(2), strict=True)]
        n, gone, kept = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n", "g", "k"])

    joined = placed.join(ranges, ["_f", "_r"], "left").select("id", "text", "ranges")
    return arrow_map(joined, cut, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT rid, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM d),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS n FROM s) WHERE n > 1),
p AS (SELECT rid, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d),
c AS (SELECT p.rid, j, x, max(CASE WHEN i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.rid ORDER BY j ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM p LEFT JOIN r ON r.rid = p.rid AND i = j),
k AS (SELECT rid, sum(gone) AS n, string_agg(x, ' ' ORDER BY j) FILTER (gone = 0) AS t FROM c GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)"""
