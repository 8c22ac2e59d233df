"""Benchmark decontamination: item-sized windows of texts whose shingles nearly equal an item's.

Words are lower-cased with ASCII punctuation as white space; shingles have five words (a shorter item is one shingle).
An item and a window match if the weighted Jaccard similarity of their shingle multisets, the sum of
smaller over the sum of larger counts, is at least SIMILARITY.

1. A bitmap and a sorted array tell which of a text's shingles stand in which items. A window of an item's
   size can only match if it holds SIMILARITY of the item's shingles or more; the places of the item's shingles
   give these windows without looking at others.
2. Each such window gets a SimHash fingerprint from its shingle hashes. BLOCKS tables lead from the values of one part of a
   fingerprint to the items with that value: two fingerprints within RADIUS bits differ by at most RADIUS // BLOCKS bits in
   one part, so the tables' entries for all values that near hold every item within the radius. A table has an entry an item.
3. Candidates within the radius are checked exactly. RADIUS is wide: at similarity 0.8 the expected
   distance is about 10 of 64 bits with a deviation of 3, and RADIUS is more than 3 deviations above.

The benchmark is the query set: it is read in blocks of at most BLOCK_CHARS characters, one pass over the
corpus each, so what is broadcast has a fixed bound. Documents are never shuffled.

Cases: a null or empty text, or item, matches nothing; a text shorter than an item is one window; repeated rows and items match
each; null ids stay null; of equally similar windows the first counts; an empty table on either side gives no matches;
other columns aren't read by find_items(), and drop_contaminated() returns the columns of its input.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Words, arrow_map, chunks, gram_hash, table, text_bytes
from .near_dedup import majority

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS = 20, 4
BLOCK_CHARS = 8_000_000
_BITMAP = 1 << 22
_PART = 64 // BLOCKS

_PLAIN = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def plain(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case and ASCII punctuation as spaces; lengths stay."""
    return np.frombuffer(data.tobytes().translate(_PLAIN), np.uint8)


class Index:
    """The items of one block."""

    def __init__(self, ids: list, texts: list[str], similarity: float, radius: int):
        self.similarity, self.radius = similarity, radius
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        w = Words(plain(data), offsets)
        self.ids, self.items, prints = [], [], []
        self.sizes: dict[int, dict[int, list[int]]] = {}  # shingle length, window size: items
        for i, item in enumerate(ids):
            h = w.hash[w.first[i] : w.first[i] + w.count[i]]
            if len(h):
                k = min(SHINGLE, len(h))
                grams = gram_hash(h, np.arange(len(h) - k + 1), k)
                self.sizes.setdefault(k, {}).setdefault(len(h), []).append(len(self.items))
                self.ids.append(item)
                self.items.append(Counter(grams.tolist()))
                prints.append(majority(grams))
        self.prints = np.array(prints, np.uint64)
        self.size_of = np.array([sum(c.values()) for c in self.items])
        self.known, self.bitmap, self.owners = {}, {}, {}
        for k, sizes in self.sizes.items():
            pairs = [(g, i) for x in sizes.values() for i in x for g in self.items[i]]
            all_grams, at = np.unique(np.array([g for g, _ in pairs], np.uint64), return_inverse=True)
            order = np.argsort(at, kind="stable")
            # the items of each shingle: a slice of one array
            self.owners[k] = np.searchsorted(at[order], np.arange(len(all_grams) + 1)), np.array([i for _, i in pairs])[order]
            bits = np.zeros(_BITMAP, bool)
            bits[(all_grams & np.uint64(_BITMAP - 1)).astype(np.int64)] = True
            self.known[k], self.bitmap[k] = all_grams, bits
        self.flips = np.flatnonzero(np.bitwise_count(np.arange(1 << _PART)) <= radius // BLOCKS)
        self.tables = []
        for b in range(BLOCKS):
            part = (self.prints >> np.uint64(b * _PART)) & np.uint64((1 << _PART) - 1)
            order = np.argsort(part, kind="stable").astype(np.int32)
            self.tables.append((np.searchsorted(part[order], np.arange((1 << _PART) + 1)).astype(np.int32), order))

    def near(self, fp: int) -> np.ndarray:
        """The items within the radius of a fingerprint, by the tables of its parts."""
        found = []
        for b, (start, order) in enumerate(self.tables):
            values = self.flips ^ (fp >> (b * _PART) & ((1 << _PART) - 1))
            first, stop = start[values], start[values + 1]
            hit = np.flatnonzero(stop > first)
            first, n = first[hit], (stop - first)[hit]
            found.append(order[np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)])
        items = np.unique(np.concatenate(found))
        return items[np.bitwise_count(self.prints[items] ^ np.uint64(fp)) <= self.radius]

    def places(self, grams: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the k-word shingles that stand in an item and their numbers: a bitmap first, then the sorted hashes."""
        at = np.flatnonzero(self.bitmap[k][(grams & np.uint64(_BITMAP - 1)).astype(np.int64)])
        known = self.known[k]
        number = np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)
        hit = known[number] == grams[at]
        return at[hit], number[hit]

    def matches(self, grams: np.ndarray, at: np.ndarray, number: np.ndarray, n: int, k: int, best: dict[int, tuple[float, int, int]]) -> None:
        """Puts the best window for each item into best.

        grams: the k-word shingles of a text of n words; at, number: places and numbers of those in items.
        """
        start, owner = self.owners[k]
        times = start[number + 1] - start[number]
        place = np.repeat(at, times)
        item = owner[np.repeat(start[number], times) + np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)]
        order = np.lexsort((place, item))
        place, item = place[order], item[order]
        prints: dict[tuple[int, int], tuple[np.ndarray, Counter]] = {}
        for i, first, count in zip(*(x.tolist() for x in np.unique(item, return_index=True, return_counts=True)), strict=True):
            size = int(self.size_of[i]) + k - 1
            wide = min(size, n)
            m = wide - k + 1
            need = self.similarity * (size - k + 1) - 1e-9
            if m < need or count < need:
                continue
            own = place[first : first + count]
            low, high = max(0, int(own[0]) - m + 1), min(len(grams) - m, int(own[-1]))
            s = np.arange(low, high + 1)
            s = s[np.searchsorted(own, s + m) - np.searchsorted(own, s) >= need]
            for s in s.tolist():
                if (s, m) not in prints:
                    window = grams[s : s + m]
                    prints[s, m] = self.near(majority(window)), Counter(window.tolist())
                near, seen = prints[s, m]
                if i not in near:
                    continue
                both = sum(min(c, seen[g]) for g, c in self.items[i].items() if g in seen)
                sim = both / (m + int(self.size_of[i]) - both)
                if sim >= self.similarity - 1e-12 and sim > best.get(i, (0,))[0]:
                    best[i] = (sim, s, wide)

    def texts(self, column: pa.Array):
        """The matches (item, first word, words, similarity) of each text of an Arrow array that has any, and the text's number.

        Shingles of all texts of a chunk are looked up at once; only texts with enough known ones for the smallest item go on.
        """
        for i, j in chunks(column):
            data, offsets = text_bytes(column[i:j])
            w = Words(plain(data), offsets)
            found: dict[int, dict] = {}
            for k, sizes in self.sizes.items():
                if len(w.hash) < k:
                    continue
                grams = gram_hash(w.hash, np.arange(len(w.hash) - k + 1), k)
                at, number = self.places(grams, k)
                inside = w.doc[at] == w.doc[at + k - 1]
                at, number = at[inside], number[inside]
                doc, first, times = np.unique(w.doc[at], return_index=True, return_counts=True)
                enough = times >= self.similarity * (min(sizes) - k + 1) - 1e-9
                for d, f, t in zip(doc[enough].tolist(), first[enough].tolist(), times[enough].tolist(), strict=True):
                    start, n = int(w.first[d]), int(w.count[d])
                    self.matches(grams[start : start + n - k + 1], at[f : f + t] - start, number[f : f + t], n, k, found.setdefault(d, {}))
            for d in sorted(found):
                if found[d]:
                    yield i + d, [(x, s, wide, sim) for x, (sim, s, wide) in sorted(found[d].items())]


def blocks(benchmark: DataFrame, item_col: str, text: str, limit: int = BLOCK_CHARS):
    """(ids, texts) of the items, at most limit characters at a time (a longer item is alone); items come one by one to the driver."""
    ids, texts, size = [], [], 0
    for row in benchmark.where(f"{text} IS NOT NULL").select(item_col, text).toLocalIterator():
        if texts and size + len(row[1]) > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0]), texts.append(row[1])
        size += len(row[1])
    if texts:
        yield ids, texts


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """id, item, start_word, n_words, similarity of the best window of each text and item that match."""
    spark = docs.sparkSession
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{item_col}` {benchmark.schema[item_col].dataType.simpleString()}, start_word long, n_words long, similarity double"
    out = spark.createDataFrame([], schema)
    for ids, texts in blocks(benchmark, item_col, item_text, block_chars):
        index = spark.sparkContext.broadcast(Index(ids, texts, similarity, radius))

        def one(b: pa.RecordBatch, index=index) -> pa.RecordBatch:
            rows = [(d, *m) for d, found in index.value.texts(b.column(1)) for m in found]
            item_type = pa.array(index.value.ids).type
            columns = [b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([index.value.ids[r[1]] for r in rows], item_type), *[pa.array([r[i] for r in rows], pa.float64() if i == 4 else pa.int64()) for i in (2, 3, 4)]]
            return pa.RecordBatch.from_arrays(columns, names=["id", "item", "s", "n", "x"])

        out = out.unionByName(arrow_map(docs.select(id_col, text), one, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that match no item, unchanged and unshuffled."""
    at = docs.columns.index(text)
    for ids, texts in blocks(benchmark, item_col, item_text, block_chars):
        index = docs.sparkSession.sparkContext.broadcast(Index(ids, texts, similarity, radius))

        def one(b: pa.RecordBatch, index=index) -> pa.RecordBatch:
            keep = np.ones(len(b), bool)
            keep[[d for d, _ in index.value.texts(b.column(at))]] = False
            return b.filter(pa.array(keep))

        docs = arrow_map(docs, one, docs.schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


__all__ = ["find_items", "drop_contaminated", "op6_decontaminate"]
