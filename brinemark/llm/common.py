"""What the operators share: reading tables, row identity, scratch tables, Arrow maps, word scans."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a map function holds as arrays at once; one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 18
FILTER_WORDS = 1 << 18
_FOLDERS: dict[str, SparkSession] = {}
_OWN: list[str] = []
#: Spark deletes the shuffle files of a finished write; what was written is read from the shared folder, never from them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where the setting is absent, a temporary one on a single machine and an error on a cluster."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='brinemark-')}")
        there = _OWN[0]
    return there.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for path, spark in list(_FOLDERS.items()):
        if spark._jvm is not None and spark.sparkContext._jsc is not None:  # else the session has ended; the cluster clears its checkpoint folder
            _delete(spark, path)


atexit.register(_sweep)


class Scratch:
    """Tables written to the shared folder: lineage ends there and any executor can read them again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}
        _FOLDERS[self.path] = spark

    def keep(self, df: DataFrame, *done: DataFrame) -> DataFrame:
        """Write df once and read it back; delete the tables in done, which only df has read."""
        self.n += 1
        at = f"{self.path}/{self.n}"
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(at)
        finally:
            self.spark.conf.set(_CLEANUP, before) if before is not None else self.spark.conf.unset(_CLEANUP)
        kept = self.spark.read.schema(df.schema).parquet(at)
        kept.scratch_path = at
        for x in done:
            self.drop(x)
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that keep() returned and nothing reads any more."""
        for df in tables:
            _delete(self.spark, df.scratch_path)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col(quoted(name))


def fresh(names: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores put before those that stand in names in either case."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w = "_" + w
        out.append(w)
    return out


def located(scratch: Scratch, df: DataFrame) -> DataFrame:
    """df with a hash of a row's file and its place there: an identity that holds over scans and repeated rows.

    The two columns are _f and _r, or what fresh() makes of these names; place() gives a frame with their names.
    Frames that aren't scans of files are written to the scratch folder first.
    """
    f, r = fresh(df.columns, "_f", "_r")

    def named(x: DataFrame) -> DataFrame:
        at = x.metadataColumn("_metadata")
        out = x.select("*", F.xxhash64(at["file_path"]).alias(f), at["row_index"].alias(r))
        out.place_columns = (f, r)
        return out

    try:
        return named(df)
    except AnalysisException:  # a frame derived from files has no such columns
        return named(scratch.keep(df))


def place(df: DataFrame, **columns: str) -> DataFrame:
    """_f, _r and, under new names, some columns of a frame that located() returned."""
    f, r = df.place_columns
    return df.select(col(f).alias("_f"), col(r).alias("_r"), *[col(c).alias(n) for n, c in columns.items()])


def likely(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows (_f, _r, …) that may be among asked (_f, _r), by a bitmap of FILTER_WORDS longs, whatever the input.

    It only spares the shuffle of most other rows before an exact join; full of bits, it lets every row pass.
    """
    word = F.expr(f"CAST(pmod(shiftright(xxhash64(_f, _r), 6), {FILTER_WORDS}) AS INT)")
    bit = F.expr("shiftleft(1L, CAST(pmod(xxhash64(_f, _r), 64) AS INT))")
    bitmap = asked.select(word.alias("_w"), bit.alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_b"))
    return rows.withColumn("_w", word).join(F.broadcast(bitmap), "_w").where(F.col("_b").bitwiseAND(bit) != 0).drop("_w", "_b")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def over(batches):
        for b in batches:
            out = fn(b)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out
            del b, out
            pa.default_memory_pool().release_unused()  # workers live as long as executors; a batch's memory goes back

    return df.mapInArrow(over, schema)


def chunks(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK_BYTES of text."""
    sizes = text_bytes(text)[1]
    start = 0
    while start < len(text):
        stop = int(np.searchsorted(sizes, sizes[start] + CHUNK_BYTES, side="right")) - 1
        stop = min(max(stop, start + 1), len(text))
        yield start, stop
        start = stop


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array and the len + 1 offsets into them; nulls are empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null("")
    text = text.cast(pa.large_string())
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    if data is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


# A word is a run of bytes other than these; none of them is part of a longer UTF-8 sequence.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def numbered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte range, equal for equal bytes alone, and XXH3 of the bytes of each number. Ranges are in order and don't overlap."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edges = np.empty(2 * len(start), np.int64)
    edges[0::2], edges[1::2] = start, end
    every = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    coded = every.dictionary_encode()  # ranges and, at odd places, what lies between them
    _, cuts, values = coded.dictionary.buffers()
    at = np.frombuffer(cuts, np.int64)[: len(coded.dictionary) + 1].tolist()
    values, h = memoryview(values) if values is not None else b"", xxhash.xxh3_64_intdigest
    hashes = np.fromiter((h(values[i:j]) for i, j in zip(at, at[1:], strict=False)), np.uint64, len(at) - 1)
    return coded.indices.to_numpy()[0::2].astype(np.int64), hashes


class Words:
    """The words of several texts at once: document, start, end (bytes), and of each its number and a 64-bit hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
        n = len(offsets) - 1
        inside = ~space[data]
        edge = np.zeros(len(data) + 1, bool)
        if len(data):
            edge[1:-1] = inside[1:] != inside[:-1]
            edge[0], edge[-1] = inside[0], inside[-1]
            cut = offsets[1:-1]
            cut = cut[(cut > 0) & (cut < len(data))]
            both = cut[inside[cut] & inside[cut - 1]]  # one text's last word touches the next one's first
        else:
            both = np.zeros(0, np.int64)
        at = np.flatnonzero(edge)
        if len(both):
            at = np.sort(np.concatenate([at, both, both]), kind="stable")
            # a text boundary within a run is both an end and a start; empty texts repeat it
            at = _even(at, both)
        self.start, self.end = at[0::2], at[1::2]
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, offsets[:-1], side="left")
        self.count = np.searchsorted(self.start, offsets[1:], side="left") - self.first
        self.data, self.offsets, self.n = data, offsets, n
        self._number: np.ndarray | None = None
        self._hash: np.ndarray | None = None

    def _code(self) -> None:
        self._number, of = numbered(self.data, self.start, self.end)
        self._hash = of[self._number]

    @property
    def number(self) -> np.ndarray:
        if self._number is None:
            self._code()
        return self._number

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._code()
        return self._hash

    def windows(self, k: int) -> np.ndarray:
        """Starts of the k-word windows that lie in one text."""
        m = len(self.start) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[:m] == self.doc[k - 1 :])


def _even(at: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Word edges with each inner text boundary exactly twice."""
    twice = np.unique(both)
    rest = at[~np.isin(at, twice)]
    return np.sort(np.concatenate([rest, twice, twice]), kind="stable")


def gram_hash(h: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k consecutive hashes from each start."""
    out = np.zeros(len(starts), np.uint64)
    for j in range(k):
        out = mix(out ^ h[starts + j]) + np.uint64((j + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def join_spans(spans: list[tuple[str, int, int]], order: dict[str, int]) -> str:
    """kind:start:end by start, then kind, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))
