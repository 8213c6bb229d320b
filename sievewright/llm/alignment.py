"""Alignment of two tokenizers over a corpus: token groups with common borders, and counts of the id pairs that meet."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import fresh_path, stored
from .packing import _byte_letters
from .shared import filesystem, mapped, partitions_of, span_hash, text_chunks, tidy

SPACE = "▁"
#: Distinct units, and links of them, that a worker keeps; it starts anew beyond.
CACHE_UNITS, CACHE_LINKS = 600_000, 6_000_000
#: Pairs of a partition that are held before they are merged, and merged ones before they are handed on.
HELD_PAIRS, MERGED_PAIRS = 4_000_000, 2_000_000

#: First two bytes of three-byte characters some of which are white space: no cut behind any of them.
_WIDE_SPACE = np.zeros(1 << 16, bool)
_WIDE_SPACE[[0xE19A, 0xE1A0, 0xE280, 0xE281, 0xE380]] = True


def _with_space(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each, in the form of text_chunks."""
    n, size = len(offs) - 1, np.diff(offs)
    out = np.full(int(offs[-1]) + n + 8, 0x20, np.uint8)
    out[np.arange(offs[-1]) + np.repeat(np.arange(1, n + 1), size)] = data[: offs[-1]]
    out[int(offs[-1]) + n :] = 0
    return out, offs + np.arange(n + 1)


def _closed(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the character before each place surely isn't white space."""
    last = data[ends - 1]
    ok = (last > 0x20) & (last != 0x7F)
    odd = np.flatnonzero(last >= 0x80)
    two, three = data[ends[odd] - 2].astype(np.int64), data[np.maximum(ends[odd] - 3, 0)].astype(np.int64)
    ok[odd[(two == 0xC2) & np.isin(last[odd], (0x85, 0xA0)) | _WIDE_SPACE[three << 8 | two]]] = False
    return ok


def unit_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where units begin: at each text, and at each space behind a character that isn't white space."""
    spaces = np.flatnonzero(data[1 : int(offs[-1])] == 0x20) + 1
    begin = np.zeros(int(offs[-1]), bool)
    begin[spaces[_closed(data, spaces)]] = True
    begin[offs[:-1]] = True
    return np.flatnonzero(begin)


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... size[0] of them, then those of first[1], and so on."""
    end = np.cumsum(size)
    return np.repeat(first - end + size, size) + np.arange(end[-1] if len(end) else 0)


class _Side:
    """One tokenizer's tokens as bytes, and their ids as text, by id."""

    def __init__(self, raw: list[bytes], end: bytes):
        self.size = np.array([len(r) for r in raw], np.int64)
        self.first, self.flat = np.append(0, np.cumsum(self.size))[:-1], np.frombuffer(b"".join(raw), np.uint8)
        names = [b"%d," % i for i in range(len(raw))] + [b"%d%s" % (i, end) for i in range(len(raw))]
        self.names, self.name_size = np.array(names, object), np.array([len(x) for x in names], np.int64)

    def covers(self, ids: np.ndarray, count: np.ndarray, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which units have tokens that join to their bytes. data: all units' bytes, size: of each."""
        unit = np.repeat(np.arange(len(count)), count)
        own = self.size[ids]
        ok = (np.bincount(unit, own, len(count)) == size) & (np.bincount(unit, own == 0, len(count)) == 0)
        ids, bytes_of = ids[np.repeat(ok, count)], np.flatnonzero(ok)
        joined = self.flat[_runs(self.first[ids], self.size[ids])]
        wrong = joined != data[_runs((np.cumsum(size) - size)[ok], size[ok])]
        ok[np.repeat(bytes_of, size[ok])[wrong]] = False
        return ok


#: Fixed value: how byte-level BPE splits a text before it merges.
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of a unit up to which A's merges are done by tiktoken, whose time grows with the square of a word.
SHORT = 256


class Units:
    """What the tokenizers A and B make of each distinct unit, by the unit's 64-bit hash.

    A unit is a run of white space that begins with a space, and what follows up to the next such run. Byte-level BPE
    splits a text there before it merges, and pieces that have no white space behind other characters don't cross: so a
    text's tokens are those of its units, and each distinct unit is encoded once for a worker. Whether that holds is
    read from A's file and from B's pieces; where it doesn't, a whole text is one unit.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in _byte_letters().items()}
        raw_a = [b""] * (max(self.a.get_vocab().values()) + 1)
        for word, i in spec["model"]["vocab"].items():
            raw_a[i] = bytes(back[c] for c in word) if all(c in back for c in word) else b""
        raw_b = [b""] * sp.get_piece_size()
        for i in range(len(raw_b)):
            if sp.is_byte(i):
                raw_b[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                raw_b[i] = sp.id_to_piece(i).replace(SPACE, " ").encode()
        self.side_a, self.side_b, self.n_b = _Side(raw_a, b"|"), _Side(raw_b, b";"), len(raw_b)
        joined = lambda text: b"".join(raw_b[i] for i in sp.encode(text))
        # B writes a space before a text by itself, or it is given one.
        self.prefix = joined("a") == b" a"
        split = spec.get("pre_tokenizer") or {}
        apart = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        own = [sp.id_to_piece(i) for i, r in enumerate(raw_b) if r and not sp.is_byte(i)]
        self.whole = not (apart and self.prefix and joined("a  b ") == b" a  b " and not any(SPACE in p.lstrip(SPACE) for p in own))
        self.lone = [] if self.whole else sp.encode("a ")[-1:]
        # Merges whose results are numbered in their order can be done by rank.
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"].get("merges", [])]
        special = {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {raw_a[i]: i for w, i in spec["model"]["vocab"].items() if raw_a[i] and w not in special}
        ordered = len(ranks) == 256 + len(merges) and all(spec["model"]["vocab"].get(m) == 256 + k for k, m in enumerate(merges))
        self.fast = tiktoken.Encoding("a", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}) if apart and ordered else None
        self.lookup: Lookup | None = None
        self.clear()

    def clear(self) -> None:
        self.keys, self.of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sizes = np.zeros((0, 3), np.int64)  # tokens of A and of B, groups; all zero where the bytes differ
        self.at, self.links, self.texts = np.zeros(1, np.int64), np.zeros(0, np.int64), []
        self.weights = np.zeros((0, 2), np.int64)  # links whose count is their A id's highest, sum of counts

    def _encode_a(self, units: list[bytes], n_fast: int) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all units, and how many each has. The first n_fast are short and end in no white space, so they
        can be encoded as one text."""
        ids = np.zeros(0, np.int64)
        if n_fast:
            ids = np.array(self.fast.encode_ordinary(b"".join(units[:n_fast]).decode()), np.int64)
        ends = np.cumsum([len(u) for u in units[:n_fast]])
        count = np.bincount(np.searchsorted(ends, np.cumsum(self.side_a.size[ids])), minlength=n_fast) if n_fast else np.zeros(0, np.int64)
        more = [x.ids for x in self.a.encode_batch_fast([u.decode() for u in units[n_fast:]], add_special_tokens=False)]
        return np.concatenate([ids, np.fromiter(chain.from_iterable(more), np.int64)]), np.concatenate([count, np.array([len(x) for x in more], np.int64)])

    def add(self, keys: np.ndarray, units: list[bytes], fast: np.ndarray) -> None:
        order = np.argsort(~fast, kind="stable")
        keys, units = keys[order], [units[i] for i in order]
        a, count_a = self._encode_a(units, int(fast.sum()))
        texts = [u[1:].decode() if self.prefix else u.decode() for u in units]
        lists = self.b.encode(texts, num_threads=1)
        if not self.whole:
            lists = [x if t else self.lone for t, x in zip(texts, lists)]
        b, count_b = np.fromiter(chain.from_iterable(lists), np.int64), np.array([len(x) for x in lists], np.int64)
        data, size = np.frombuffer(b"".join(units), np.uint8), np.array([len(u) for u in units], np.int64)
        ok = self.side_a.covers(a, count_a, data, size) & self.side_b.covers(b, count_b, data, size)
        a, b = a[np.repeat(ok, count_a)], b[np.repeat(ok, count_b)]
        count_a, count_b = count_a * ok, count_b * ok
        n, unit_a = len(units), np.repeat(np.arange(len(units)), count_a)
        # Both sides now cover the same bytes.
        end_a, end_b = np.cumsum(self.side_a.size[a]), np.cumsum(self.side_b.size[b])
        low, high = np.searchsorted(end_b, end_a - self.side_a.size[a], "right"), np.searchsorted(end_b, end_a)
        links = np.repeat(a, high - low + 1) * self.n_b + b[_runs(low, high - low + 1)]
        ends = np.cumsum(np.bincount(unit_a, high - low + 1, n)).astype(np.int64)
        # Tokens that end a group, and all tokens in the order of the groups, A's before B's.
        last_a = end_b[high] == end_a if len(a) else np.zeros(0, bool)
        last_b = np.zeros(len(b), bool)
        last_b[high[last_a]] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        groups_b, groups_a = np.append(0, np.flatnonzero(last_b) + 1), np.flatnonzero(last_a) + 1
        words = np.empty(len(a) + len(b), object)
        name_a, name_b = a + last_a * len(self.side_a.size), b + last_b * self.n_b
        words[np.arange(len(a)) + groups_b[group_a]] = self.side_a.names[name_a]
        words[np.arange(len(b)) + (groups_a[group_b] if len(b) else 0)] = self.side_b.names[name_b]
        text = b"".join(words.tolist())
        long = np.bincount(unit_a, self.side_a.name_size[name_a], n) + np.bincount(np.repeat(np.arange(n), count_b), self.side_b.name_size[name_b], n)
        cut = np.append(0, np.cumsum(long)).astype(np.int64).tolist()
        self.texts += [text[x:y] for x, y in zip(cut, cut[1:])]
        if self.lookup is not None:
            self.weights = np.concatenate([self.weights, self._weigh(links, np.append(0, ends))])
        sizes = np.stack([count_a, count_b, np.bincount(unit_a, last_a, n).astype(np.int64)], axis=1)
        old = len(self.sizes)
        self.at, self.links = np.concatenate([self.at, self.at[-1] + ends]), np.concatenate([self.links, links])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.keys, self.of = np.concatenate([self.keys, keys]), np.concatenate([self.of, old + np.arange(n)])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.of = self.keys[order], self.of[order]

    def _weigh(self, links: np.ndarray, at: np.ndarray) -> np.ndarray:
        count, best = self.lookup.counts(links)
        sums = lambda x: np.diff(np.append(0, np.cumsum(x))[at])
        return np.stack([sums(best.astype(np.int64)), sums(count)], axis=1)

    def look_up_in(self, lookup: "Lookup") -> None:
        """Weigh the links of all units, those that are known too, by these counts."""
        if self.lookup is None or self.lookup.name != lookup.name:
            self.lookup = lookup
            self.weights = self._weigh(self.links, self.at)

    def find(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of these texts in order, and where each text's begin (and the last's end)."""
        if len(self.keys) > CACHE_UNITS or len(self.links) > CACHE_LINKS:
            self.clear()
        starts = offs[:-1] if self.whole else unit_starts(data, offs)
        ends = np.append(starts[1:], offs[-1])
        keys, index, which = np.unique(span_hash(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        new = np.flatnonzero(new)
        for k in range(0, len(new), 50_000):
            some = new[k : k + 50_000]
            x, y = starts[index[some]], ends[index[some]]
            fast = _closed(data, y) & (y - x <= SHORT) & (self.fast is not None)
            self.add(keys[some], [data[i:j].tobytes() for i, j in zip(x.tolist(), y.tolist())], fast)
        return self.of[np.searchsorted(self.keys, keys)][which], np.searchsorted(starts, offs)

    def links_of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All links of these units one behind the other, and how many each has."""
        size = self.at[units + 1] - self.at[units]
        return self.links[_runs(self.at[units], size)], size


_held: dict[tuple[str, str], Units] = {}


def _units(path_a: str, path_b: str) -> Units:
    """The tokenizers and their units, once a worker."""
    if (path_a, path_b) not in _held:
        _held.clear()
        _held[path_a, path_b] = Units(path_a, path_b)
    return _held[path_a, path_b]


def _texts(units: Units, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each run of texts: numbers of the units, where each text's begin, and which texts have tokens."""
    for _, _, data, offs in text_chunks(column):
        of, first = units.find(*_with_space(data, offs))
        bad = np.append(0, np.cumsum(units.sizes[of, 0] == 0))
        yield of, first, (np.diff(offs) > 0) & (np.diff(bad[first]) == 0)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, which, np.concatenate(counts))
    return found, total


def _partial(path_a: str, path_b: str):
    """Partial counts (key, n) of a partition: in how many of its texts a pair is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(path_a, path_b)
        every = len(units.side_a.size) * units.n_b
        keys, counts, held = [], [], 0
        out = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["key", "n"])
        for batch in batches:
            for of, first, good in _texts(units, batch.column(0)):
                text = np.repeat(np.arange(len(good)), np.diff(first))
                code = np.unique(text[good[text]] * (1 << 32) + of[good[text]])
                links, size = units.links_of(code & ((1 << 32) - 1))
                linked = np.unique(np.repeat(code >> 32, size) * every + links) % every
                k, n = np.unique(linked, return_counts=True)
                keys.append(k)
                counts.append(n)
                held += len(k)
                if held > HELD_PAIRS:
                    k, n = _merged(keys, counts)
                    keys, counts, held = [k], [n], len(k)
                    if held > MERGED_PAIRS:
                        yield out(k, n)
                        keys, counts, held = [], [], 0
        if held:
            yield out(*_merged(keys, counts))
        tidy()

    return run


def _shards(folder: str, n_b: int):
    """Sum the sorted partial counts of a range into a shard, and say where it is, and for each A id its best B ids there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get()
        name = f"{folder}/{at.partitionId():06d}-{at.taskAttemptId()}"
        store, path = filesystem(name)
        store.create_dir(os.path.dirname(path), recursive=True)
        keys = counts = np.zeros(0, np.int64)
        total, low, high = 0, None, None
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def best(k, n):
            a = k // n_b
            begin = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            most = np.repeat(np.maximum.reduceat(n, begin), np.diff(np.append(begin, len(a))))
            top = n == most
            return a[top], k[top] % n_b, n[top]

        with store.open_output_stream(f"{path}.keys") as f, store.open_output_stream(f"{path}.counts") as g:

            def put(k, n):
                nonlocal total, low, high
                f.write(k.astype("<i8").tobytes())
                g.write(n.astype("<i8").tobytes())
                rows.append(best(k, n))
                total, low, high = total + len(k), int(k[0]) if low is None else low, int(k[-1])

            for batch in batches:
                k, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                if not len(k):
                    continue
                k, n = np.concatenate([keys, k]), np.concatenate([counts, n])
                begin = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
                k, n = k[begin], np.add.reduceat(n, begin)
                # The last key may go on in the next batch.
                if len(k) > 1:
                    put(k[:-1], n[:-1])
                keys, counts = k[-1:], n[-1:]
            if len(keys):
                put(keys, counts)
        for a, b, n in rows:
            fill = lambda x, kind: pa.array(np.full(len(a), x), kind)
            where = pa.array([name] * len(a), pa.string())
            yield pa.RecordBatch.from_arrays([where, fill(low, pa.int64()), fill(high, pa.int64()), fill(total, pa.int64()), pa.array(a), pa.array(b), pa.array(n)], ["shard", "low", "high", "size", "a", "b", "n"])

    return run


class Lookup:
    """Counts of packed pairs in the sorted shards, by binary search; a shard is opened when a pair falls into it."""

    def __init__(self, name: str, shards: list[tuple[str, int, int, int]], most: np.ndarray, n_b: int):
        self.name, self.n_b, self.most = name, n_b, most
        self.shards = sorted(shards, key=lambda s: s[1])
        self.lows = np.array([s[1] for s in self.shards], np.int64)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def counts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each pair, and whether it is the highest of its A id."""
        found, which = np.unique(keys, return_inverse=True)
        out = np.zeros(len(found), np.int64)
        cut = np.append(np.searchsorted(found, self.lows), len(found))
        for s in np.flatnonzero(np.diff(cut)):
            if s not in self.open:
                at = self.shards[s][0]
                self.open[s] = mapped(f"{at}.keys").view("<i8"), mapped(f"{at}.counts").view("<i8")
            known, counts = self.open[s]
            some = found[cut[s] : cut[s + 1]]
            spot = np.minimum(np.searchsorted(known, some), len(known) - 1)
            out[cut[s] : cut[s + 1]] = np.where(known[spot] == some, counts[spot], 0)
        best = out == self.most[found // self.n_b]
        return out[which], best[which]


@dataclass
class PairCounts:
    """Corpus-wide counts. partners: (shard, low, high, size, a, b, n), for each A id its best B ids of each shard."""

    path_a: str
    path_b: str
    partners: DataFrame
    n_a: int
    n_b: int

    def lookup(self) -> Lookup:
        """What tasks need to look counts up: a row for each shard, a number for each A id."""
        shards = [tuple(r) for r in self.partners.groupBy("shard", "low", "high", "size").count().select("shard", "low", "high", "size").collect()]
        most = np.zeros(self.n_a, np.int64)
        for r in self.partners.groupBy("a").agg(F.max("n").alias("n")).collect():
            most[r.a] = r.n
        return Lookup(shards[0][0] if shards else "", shards, most, self.n_b)

    def best_partners(self) -> DataFrame:
        """(a, b, n): for each A id the B ids that it is linked with in most texts, ties included."""
        top = self.partners.groupBy("a").agg(F.max("n").alias("most"))
        return self.partners.join(top, "a").filter("n = most").select("a", "b", "n")


def count_pairs(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> PairCounts:
    """In how many texts each pair of an A id and a B id is linked, as sorted shards in the shared folder.

    A pair is one number, the A id times B's pieces plus the B id. A partition's texts are counted by sorted distinct
    numbers; these partial counts are written, dealt to ranges, sorted, and summed run by run into a shard for each
    range, a file of keys and one of counts. A pair that every text holds is one row for each partition. A task that
    runs again writes files of another name; the table that it returns names those that count.
    """
    spark = docs.sparkSession
    units = Units(path_a, path_b)
    src = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    partial = stored(src.mapInArrow(_partial(path_a, path_b), "key long, n long"), "pairs")
    dealt = partial.repartitionByRange(partitions_of(spark), "key").sortWithinPartitions("key")
    shards = dealt.mapInArrow(_shards(fresh_path(spark, "shards"), units.n_b), "shard string, low long, high long, size long, a long, b long, n long")
    return PairCounts(path_a, path_b, stored(shards, "partners"), len(units.side_a.size), units.n_b)


def _aligned(path_a: str, path_b: str, lookup: Lookup, with_groups: bool):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * with_groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(path_a, path_b)
        units.look_up_in(lookup)
        for batch in batches:
            at = 0
            for of, first, good in _texts(units, batch.column(1)):
                sums = lambda x: np.where(good, np.diff(np.append(0, np.cumsum(x))[first]), 0)
                a, b, groups = (sums(units.sizes[of, k]) for k in range(3))
                best, total = (sums(units.weights[of, k]) for k in range(2))
                every, texts = of.tolist(), units.texts
                joined = [b"".join([texts[u] for u in every[x:y]])[:-1] if ok else None for x, y, ok in zip(first[:-1].tolist(), first[1:].tolist(), good.tolist())]
                digests = ["" if t is None else hashlib.sha256(t).hexdigest() for t in joined]
                # Two tokens that overlap are a stop on the way along both; each group saves one.
                cols = [batch.column(0).slice(at, len(good)), *map(pa.array, (a, b, groups, a + b - groups, best, total)), pa.array(digests, pa.string())]
                if with_groups:
                    cols.append(pa.array([t and t.decode() for t in joined], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)
                at += len(good)
        tidy()

    return run


def align(docs: DataFrame, path_a: str, path_b: str, counts: PairCounts | None = None, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True) -> DataFrame:
    """Align each text's tokens of A and B: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups).

    A (a byte-level BPE file) encodes the text behind a space, B (a sentencepiece model) adds that space itself; special
    tokens are added by neither, and their strings within texts are plain text. Where tokens of both end at one byte, a
    group ends: `a1,a2|b1;a3|b2`, ids in order. Links are pairs of tokens whose bytes overlap. counts: of another corpus,
    or those of docs. n_best: links whose count is the highest that their A id has; count_sum: over all links.

    Two passes over the texts, as their tokens would take more room than they do: the first counts, the second looks the
    counts up. Both work unit by unit, so what reaches a table are a few numbers a text, and the counts' partial sums.
    The driver gets a row for each shard and a number for each A id.

    Null and empty texts, and those whose tokens don't join to the space and the text in both (with U+2581 in them, say),
    have no tokens: zeros, an empty digest, null groups. Repeated rows are texts of their own in counts and in the result;
    null ids stay null. Texts of any length are encoded in whole. Other columns are not read.
    """
    counts = counts or count_pairs(docs, path_a, path_b, text_col)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * with_groups
    return src.mapInArrow(_aligned(path_a, path_b, counts.lookup(), with_groups), kinds)
