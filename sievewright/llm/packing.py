"""Packing of token sequences by best-fit decreasing."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .shared import LOOKUP_ROWS, lower_ascii, span_hash, text_chunks, tidy, word_spans

#: Distinct words whose ids a worker keeps; it starts anew beyond.
CACHE_WORDS = 500_000


_ALNUM, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK[list(b".,;:!?*#$%&)\"")] = True
#: Words that the tokenizer's normalizer and splitter leave alone, so that its model can be asked directly.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: bytes that print stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: Fixed value: how a tokenizer of whole words splits a text, white space being dropped.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _splits_words(spec: dict) -> bool:
    """Whether the file says that a text is lower-cased, split as by _SPLIT, and merged within the parts alone, each after
    normal forms and white space have been made even: nothing else may look across a part's border."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    even = all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x.get("pattern") == {"Regex": r"\s+"} and x.get("content") == " ") for x in steps)
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = len(parts) == 2 and parts[0]["type"] == "Split" and parts[0]["pattern"] == {"Regex": _SPLIT} and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
    plain = split and parts[1]["type"] == "ByteLevel" and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
    model = spec["model"]
    return even and any(x["type"] == "Lowercase" for x in steps) and bool(plain) and model.get("type") == "BPE" and not model.get("dropout") and not spec.get("truncation")


class WordIds:
    """Ids of each word, kept in flat arrays by the word's 64-bit hash.

    For a tokenizer that lower-cases, drops white space, and whose tokens span neither white space nor the border from
    a letter or digit to a punctuation mark: a text's ids then are those of its parts in order, and each distinct part
    is encoded once for a worker. Whether a tokenizer does so is read from its file (see _splits_words); with any other,
    and where a probe disagrees, whole texts are encoded.
    """

    PROBE = "Ab  Cd, efÉ. It's 12!\nx-y (z) ... ü"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.clear()
        with open(path, encoding="utf-8") as f:
            self.whole = not _splits_words(json.load(f))
        if self.whole:
            return
        raw = self.PROBE.encode()
        ids, _ = self.texts(np.frombuffer(raw + bytes(8), np.uint8), np.array([0, len(raw)]))
        self.whole = ids.tolist() != self.tokenizer.encode(self.PROBE, add_special_tokens=False).ids
        self.clear()

    def encode(self, words: list[str]) -> list[list[int]]:
        model, letters = self.tokenizer.model, self.letters
        out = [[t.id for t in model.tokenize(w.encode().decode("latin-1").translate(letters))] if _PLAIN.fullmatch(w) else None for w in words]
        odd = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(odd, self.tokenizer.encode_batch_fast([words[i] for i in odd], add_special_tokens=False)):
            out[i] = x.ids
        return out

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0

    def add(self, keys: np.ndarray, words: list[str]) -> None:
        got = self.encode(words)
        size = np.array([len(x) for x in got], np.int32)
        ids = np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        at = (self.used + np.append(0, np.cumsum(size)[:-1])).astype(np.int32)
        self.used += len(ids)
        self.keys, self.at, self.size = (np.concatenate(x) for x in ((self.keys, keys), (self.at, at), (self.size, size)))
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.at, self.size = self.keys[order], self.at[order], self.size[order]

    def texts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one behind the other, and where each text's begin (and the last's end)."""
        if self.whole:
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:])]
            got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(got), np.uint32), np.append(0, np.cumsum([len(x) for x in got])).astype(np.int64)
        if b"<|" not in data.tobytes():  # else there may be special tokens, which are told by their case
            data = lower_ascii(data)
        starts, ends, _ = word_spans(data, offs)
        n = int(offs[-1])
        border = np.zeros(n + 1, bool)
        if n:
            latin = np.zeros(n, bool)
            latin[1:] = (data[: n - 1] == 0xC3) & (data[1:n] != 0x97) & (data[1:n] != 0xB7)
            border[1:n] = (_ALNUM[data[: n - 1]] | latin[: n - 1]) & _MARK[data[1:n]]
            border[offs] = False
        border = np.flatnonzero(border)
        starts, ends = np.sort(np.concatenate([starts, border])), np.sort(np.concatenate([ends, border]))
        first = np.searchsorted(starts, offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        keys, index, which = np.unique(span_hash(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        new = np.flatnonzero(new)
        for k in range(0, len(new), 5000):
            some = new[k : k + 5000]
            self.add(keys[some], [data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in index[some]])
        at = np.searchsorted(self.keys, keys)[which]
        size = self.size[at]
        ptr = np.append(0, np.cumsum(size, dtype=np.int64))
        return self.flat[np.repeat(self.at[at] - ptr[:-1], size) + np.arange(ptr[-1])], ptr[first]


_cache: dict[str, WordIds] = {}


def _words(path: str) -> WordIds:
    """The tokenizer and its words, once a worker."""
    if path not in _cache:
        _cache[path] = WordIds(path)
    return _cache[path]


def _pieces(path: str, end_id: int, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column(1)):
                flat, ptr = words.texts(data, offs)
                # All ids of the run with end_id behind each text, and the borders of the pieces among them.
                total = np.diff(ptr) + 1
                first = np.append(0, np.cumsum(total))
                ids = np.full(first[-1], end_id, "<u4")
                ids[np.arange(len(flat)) + np.repeat(np.arange(hi - lo), np.diff(ptr))] = flat
                n = -(-total // window)
                doc = np.repeat(np.arange(hi - lo), n)
                start = (np.arange(len(doc)) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)) * window
                length = np.minimum(window, total[doc] - start)
                at = first[doc] + start
                # The number of each piece among those of its length in this part.
                order = np.argsort(length, kind="stable")
                size, begin, count = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(doc), np.int64)
                nth[order] = np.arange(len(doc)) - np.repeat(begin, count) + np.repeat(seen[size], count)
                seen[size] += count
                if with_ids:
                    body = pa.ListArray.from_arrays(pa.array(np.append(at, first[-1]).astype(np.int32)), pa.array(ids.view(np.int32)))
                else:
                    body = pa.array([zlib.crc32(ids[x : x + k]) for x, k in zip(at.tolist(), length.tolist())], pa.int64())
                cols = [batch.column(0).take(pa.array(lo + doc)), pa.array(start), pa.array(length), body, pa.array(total[doc]), pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids" if with_ids else "ids_crc32", "doc_tokens", "part", "nth"])
        tidy()

    return run


class _Open:
    """Segment tree over remaining capacities: which have open windows."""

    def __init__(self, top: int):
        self.n = 1 << (top + 1).bit_length()
        self.any = [False] * (2 * self.n)

    def set(self, c: int, open_: bool) -> None:
        i = self.n + c
        self.any[i] = open_
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def least(self, c: int) -> int | None:
        """The smallest open capacity of c or more."""
        i = self.n + c
        if self.any[i]:
            return c
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.n
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int) -> tuple[np.ndarray, int]:
    """Place counts[length] pieces of each length. Rows (length, first piece, pieces a window, first window, offset).

    Pieces of one length can stand for each other, so runs of equal windows are placed at once: piece r of its length,
    counted from the row's first, goes to window r // per, at offset + r % per * length. A piece goes to the tightest
    open window, which then is the tightest for the next as long as it has room. Returns the rows and the windows used.
    """
    tree, free, rows, used = _Open(window), {}, [], 0
    for length in sorted(counts, reverse=True):
        first, left = 0, counts[length]
        while left:
            c = tree.least(length)
            if c is None:
                c, at, most = window, used, left
            else:
                at, most = free[c][-1]
            per = min(c // length, left)
            n = min(most, left // per)
            rows.append((length, first, per, at, window - c))
            if c == window:
                used += n
            elif n == most:
                free[c].pop()
                tree.set(c, bool(free[c]))
            else:
                free[c][-1] = (at + n, most - n)
            first, left = first + n * per, left - n * per
            rest = c - per * length
            if rest:
                free.setdefault(rest, []).append((at, n))
                tree.set(rest, True)
    return np.array(sorted(rows), np.int64).reshape(-1, 5), used


def _place(rows: np.ndarray, window: int):
    key = rows[:, 0] * (1 << 48) + rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank, length = b.column("rank").to_numpy(), b.column("length").to_numpy()
            row = rows[np.searchsorted(key, length * (1 << 48) + rank, "right") - 1]
            r = rank - row[:, 1]
            keep = [i for i, name in enumerate(b.schema.names) if name != "rank"]
            cols = [b.column(i) for i in keep] + [pa.array(row[:, 3] + r // row[:, 2]), pa.array(row[:, 4] + r % row[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(cols, [*(b.schema.names[i] for i in keep), "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, window: int = 2048, with_ids: bool = True) -> DataFrame:
    """Pack whole texts into sequences of at most `window` ids, a row for each piece.

    Columns: doc_id, start, length, ids (array of int; ids_crc32 of their unsigned little-endian 32-bit form instead
    without with_ids), doc_tokens, sequence_id, offset. A text is its ids and end_id; it is cut into full windows and
    a rest. The lengths' histogram, at most `window` rows, is all that reaches the driver and is packed there by best
    fit decreasing; each piece then finds its place from its rank among those of its length: its number within its part,
    and how many the parts before have.

    Null and empty texts are one piece of end_id alone. Repeated rows are pieces of their own; null ids stay null; very
    long texts are encoded in whole. Other columns are not read.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    body = "ids array<int>" if with_ids else "ids_crc32 long"
    schema = f"doc_id long, start long, length long, {body}, doc_tokens long, part int, nth long"
    pieces = stored(src.mapInArrow(_pieces(tokenizer, end_id, window, with_ids), schema), "pieces")
    counts = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    hist = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    rows, _ = best_fit_decreasing(hist, window)
    slot = F.col("part").cast("long") * (window + 1) + F.col("length")
    before = counts.selectExpr("part", "length", "sum(n) over (partition by length order by part) - n as before").select(slot.alias("slot"), "before")
    # A row for each length of each part: no small table where there are many parts, so its size is looked at.
    before = F.broadcast(before) if counts.count() <= LOOKUP_ROWS else before.hint("merge")
    ranked = pieces.withColumn("slot", slot).join(before, "slot").withColumn("rank", F.col("before") + F.col("nth"))
    ranked = ranked.select("doc_id", "start", "length", "ids" if with_ids else "ids_crc32", "doc_tokens", "rank")
    return ranked.mapInArrow(_place(rows, window), f"doc_id long, start long, length long, {body}, doc_tokens long, sequence_id long, offset long")
