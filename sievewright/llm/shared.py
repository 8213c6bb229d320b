"""Shared parts of the training-data operators: folders, byte-level words, group splitting, components."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored

_U = np.uint64
_TAIL = 8


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path in the shared folder, for files that Spark has no writer for."""
    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{uri}"
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def mapped(uri: str) -> np.memmap:
    """The bytes of a file of the shared folder: mapped where it lies if the folder is mounted, else from a copy without a
    name, which takes no room once the worker lets go of it."""
    store, path = filesystem(uri)
    if store.type_name == "local":
        return np.memmap(path, np.uint8, "r")
    with tempfile.TemporaryFile() as own, store.open_input_stream(path) as f:
        while block := f.read(1 << 22):
            own.write(block)
        own.flush()
        return np.memmap(own, np.uint8, "r")


#: Rows up to which a table of a few numbers a row is broadcast, some 50 to 100 MB; beyond, it is merged.
LOOKUP_ROWS = 1_000_000


def looked_up(df: DataFrame) -> DataFrame:
    """A stored table of narrow rows as a side of a join: its size is looked at first."""
    return F.broadcast(df) if df.count() <= LOOKUP_ROWS else df.hint("merge")


def tidy() -> None:
    """Give memory that is free back to the system. Workers live on between tasks and stages, beside the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- bytes and words -------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], _U)


def text_chunks(column: pa.Array, max_bytes: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string column into runs of rows of about max_bytes: (first row, end row, bytes, offsets).

    The bytes have eight zero bytes behind the last text. Null counts as empty. A single longer text is one run.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        out = np.zeros(offs[hi] - offs[lo] + _TAIL, np.uint8)
        out[:-_TAIL] = raw[offs[lo] : offs[hi]]
        yield lo, hi, out, offs[lo : hi + 1] - offs[lo]
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: starts, ends, and per text the index of its first word (one more at the end)."""
    n = int(offs[-1])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = _SPACE[data[:n]]
    begin, finish = ~space, ~space
    begin[1:] &= space[:-1]
    finish[:-1] &= space[1:]
    inner = offs[(offs > 0) & (offs < n)]
    begin[inner] = ~space[inner]
    finish[inner - 1] = ~space[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes a step; data needs the tail of text_chunks."""
    view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    size = ends - starts
    h = size.astype(_U) * _U(0x9E3779B97F4A7C15)
    long = np.flatnonzero(size > 512)
    live, at = np.flatnonzero((size > 0) & (size <= 512)), 0
    while len(live):
        left = np.minimum(size[live] - at, 8)
        h[live] = mix(h[live] ^ (view[starts[live] + at] & _MASK[left]))
        at += 8
        live = live[size[live] > at]
    for i in long:
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


_POWER = _U(0xD6E8FEB86659FD93)


def window_hash(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of `width` words; callers drop those that cross from one text into the next."""
    if len(words) < width:
        return np.zeros(0, _U)
    n = len(words) - width + 1
    h = words[:n].copy()
    for k in range(1, width):
        h = h * _POWER + words[k : k + n]
    return mix(h)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct word shingles as 64-bit hashes.

    Texts with fewer words than `width` have one shingle, their whole sequence; without words they have none.
    Letters A-Z are lower-cased first.
    """
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, offs)
    words = span_hash(data, starts, ends)
    grams = window_hash(words, width)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            s = np.sort(grams[a : b - width + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            yield mix(window_hash(words[a:b], int(b - a)) + _U(b - a))
        else:
            yield np.zeros(0, _U)


# --- groups ----------------------------------------------------------------------------------------------------

def whole_groups(batches: Iterator[pa.RecordBatch], key: str, limit: int) -> Iterator[tuple[pa.Table, bool]]:
    """Stream rows sorted by `key` as tables of whole groups; the flag is True for each table of a group over `limit` rows.

    Such a group comes in several tables, none of which holds another group; each row comes once. At most one batch
    and `limit` rows are held.
    """
    held: pa.Table | None = None
    crowded = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        k = t.column(key).to_numpy()
        if crowded is not None:
            other = np.flatnonzero(k != crowded)
            end = int(other[0]) if len(other) else len(k)
            if end:
                yield t.slice(0, end), True
            t, k, held = t.slice(end), k[end:], None
            if not len(k):
                continue
            crowded = None
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
        if cut:
            yield t.slice(0, cut), False
        held = t.slice(cut).combine_chunks()
        if held.num_rows > limit:
            yield held, True
            held, crowded = None, k[-1]
    if held is not None and held.num_rows:
        yield held, False


def in_units(members: DataFrame, sizes: DataFrame, group: str, member: str, done: str | None = None) -> DataFrame:
    """Deal groups to units for pairwise work. sizes: (group, parts), and (group, parts, done_parts) with `done`.

    A group of one part is one unit; one of g parts makes g * (g + 1) / 2 units, each with two parts (or one), and
    every pair of members meets in exactly one unit as a pair of its own parts. Members whose column `done` is true
    need not meet each other: they fill done_parts of their own, numbered behind the others, which meet the others only.
    Adds part, part_a, part_b and unit (a hash of group and parts). Only groups of several parts take part in the join,
    and they are stored first: Spark then knows their size and broadcasts them if it is small, without dealing out the
    members."""
    some = (F.col("parts") > 1) if done is None else (F.col("parts") != 1) | (F.col("done_parts") != 0)
    sizes = stored(sizes.filter(some), "crowded")
    full, rest = F.coalesce("parts", F.lit(1)).cast("int"), F.lit(0) if done is None else F.coalesce("done_parts", F.lit(0)).cast("int")
    is_done = F.lit(False) if done is None else F.col(done)
    hashed = F.xxhash64(F.col(member))
    own = F.when(is_done, full + F.pmod(hashed, F.greatest(rest, F.lit(1)))).otherwise(F.pmod(hashed, F.greatest(full, F.lit(1)))).cast("int")
    others = F.when(is_done, full).otherwise(full + rest) - 1
    others = F.when(others >= 0, F.sequence(F.lit(0), others))
    df = members.join(sizes, group, "left").withColumn("part", own).withColumn("_other", F.explode(others))
    df = df.withColumn("part_a", F.least("part", "_other")).withColumn("part_b", F.greatest("part", "_other"))
    return df.withColumn("unit", F.xxhash64(group, "part_a", "part_b")).drop("_other", "parts", "done_parts")


class Labels:
    """Components of a small set of indices, by relabelling arrays."""

    def __init__(self, n: int, known: np.ndarray | None = None):
        """known: indices that are one component from the start."""
        self.of = np.arange(n)
        if known is not None and len(known):
            self.of[known] = known[0]

    def join(self, i: int, others: np.ndarray) -> None:
        found = np.unique(self.of[np.append(others, i)])
        if len(found) > 1:
            self.of[np.isin(self.of, found)] = found[0]

    def join_pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[k] with b[k] for every k: each label hooks to the smallest that it meets, until none is apart."""
        while True:
            x, y = self.of[a], self.of[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            to = np.arange(len(self.of))
            np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(to, to[to]):
                to = to[to]
            self.of = to[self.of]

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """(centre, member) of each index that isn't its own label."""
        i = np.flatnonzero(self.of != np.arange(len(self.of)))
        return self.of[i], i


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components: (node, component), component being the smallest node; nodes without an edge are left out.

    A round hooks each node to its smallest neighbour if that is smaller, follows the pointers to their ends, and
    contracts the edges, until none is left. A node that stays either takes in a neighbour or has a smaller one in the
    next round, so two rounds halve the nodes at least; the pointers of a round are followed in a number of steps that
    is the logarithm of their longest chain. A path in the order of its ids is one round. Steps are joins and
    aggregations with map-side combine over stored tables.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    e = stored(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    labels, rounds = None, 0
    while not e.isEmpty():
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        p = both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
        p, moved = stored(p, "parents"), True
        while moved:
            q = p.select(F.col("u").alias("p"), F.col("p").alias("q"))
            p = stored(p.join(q, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "parents")
            moved = not p.filter("moved").isEmpty()
            p = p.drop("moved")
        if labels is None:
            labels = p.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            hop = p.select(F.col("u").alias("component"), "p")
            labels = labels.join(hop, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        rounds += 1
        if rounds % 4 == 0:
            labels = stored(labels, "labels")
        pu, pv = p.select("u", F.col("p").alias("pu")), p.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        e = e.join(pu, "u").join(pv, "v").filter("pu <> pv")
        e = stored(e.select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct(), "edges")
    if labels is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stored(labels, "components")
