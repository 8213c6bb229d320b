"""Quality rules: word statistics and compression bands."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import span_hash, text_chunks, tidy, window_hash, word_spans

#: Limits by size, see Bands.
DEFAULT = ((0, 0.0, 1.7), (200, 1.1, 1.75), (300, 1.25, 2.0), (500, 1.35, 2.15), (1000, 1.6, 2.25), (2000, 1.8, 2.4), (4096, 1.95, 2.5), (8192, 2.05, 2.6), (20_000, 2.15, 2.65))
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Bytes that begin a code point.
_LEAD = (np.arange(256) & 0xC0) != 0x80


#: Bytes from which on the limits of a band hold.
SIZES = (0, 200, 300, 500, 1000, 2000, 4096, 8192, 20_000)


@dataclass(frozen=True)
class Bands:
    """Limits of raw size over zstandard size, by size in bytes: (from this size on, least, most) in ascending order.

    Short texts hardly compress, so low ratios only count from 200 bytes on; long ones compress better. The limits are
    those that calibrate() gives for labelled good texts, rounded outwards.
    """

    limits: tuple[tuple[int, float, float], ...] = DEFAULT
    level: int = 3
    chunk: int = 4096
    #: Chunks have the limits of texts of their size, so many times wider on either side.
    chunk_slack: float = 1.1
    #: Reject when more than this share of a text's bytes lies in chunks outside their bands.
    chunk_share: float = 0.1

    def inside(self, size: int, ratio: float, slack: float = 1.0) -> bool:
        _, low, high = next(x for x in reversed(self.limits) if size >= x[0])
        return low / slack <= ratio <= high * slack

    def judge(self, text: bytes, squeeze: Callable[[bytes], bytes]) -> tuple[float, float]:
        """Ratio of the whole text (1 if empty), and the share of its bytes in chunks outside their bands."""
        if not text:
            return 1.0, 0.0
        whole = len(text) / len(squeeze(text))
        if len(text) <= self.chunk:
            return whole, float(not self.inside(len(text), whole, self.chunk_slack))
        bad = 0
        for k in range(0, len(text), self.chunk):
            piece = text[k : k + self.chunk]
            bad += len(piece) * (not self.inside(len(piece), len(piece) / len(squeeze(piece)), self.chunk_slack))
        return whole, bad / len(text)


def calibrate(docs: DataFrame, good: DataFrame, rows: int = 20_000, margin: float = 0.06, id_col: str = "doc_id", text_col: str = "text") -> Bands:
    """Bands fitted to labelled good texts: their 0.1 % and 99.9 % quantiles by size, widened by `margin`.

    good has the ids of good texts; those `rows` with the smallest hashes are the sample, whose bound is this parameter.
    Texts that the base rules reject don't count; a size without texts has the limits of the next smaller one. What
    reaches the driver is a row for each size.
    """
    ids = good.select(F.col(id_col).cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(ids, "doc_id")
    seen = quality_rules(some, bands=Bands()).filter("not base_failed")
    sized = seen.join(some.select("doc_id", F.octet_length("text").alias("size")), "doc_id")
    band = F.greatest(*(F.when(F.col("size") >= x, x).otherwise(0) for x in SIZES))
    q = F.percentile("ratio", F.array(F.lit(0.001), F.lit(0.999)))
    found = {r.band: r.q for r in sized.groupBy(band.alias("band")).agg(q.alias("q")).collect()}
    limits, last = [], (0.0, float("inf"))
    for x in SIZES:
        if x in found:
            last = (found[x][0] / (1 + margin) if x >= 200 else 0.0, found[x][1] * (1 + margin))
        limits.append((x, *last))
    return Bands(tuple(limits))


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _repeated(grams: np.ndarray) -> int:
    """Words in windows that occur twice or more."""
    s = np.sort(grams)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    cover = np.zeros(len(grams) + _WINDOW, np.int64)
    at = np.flatnonzero(np.isin(grams, twice))
    np.add.at(cover, at, 1)
    np.add.at(cover, at + _WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def _dup_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def measure(column: pa.Array, bands: Bands) -> dict[str, np.ndarray]:
    squeeze = zstandard.ZstdCompressor(level=bands.level, write_content_size=False).compress
    out: dict[str, list[np.ndarray]] = {}
    for _, _, data, offs in text_chunks(column):
        n = int(offs[-1])
        starts, ends, first = word_spans(data, offs)
        inside = np.zeros(n + 1, np.int8)
        inside[starts] = 1
        np.add.at(inside, ends, -1)
        grams = window_hash(span_hash(data, starts, ends), _WINDOW)
        raw = data[:n].tobytes()
        texts = [raw[a:b] for a, b in zip(offs[:-1], offs[1:])]
        judged = [bands.judge(t, squeeze) for t in texts]
        n_words = np.diff(first)
        found = {
            "n_words": n_words,
            "word_chars": _sums((np.cumsum(inside[:-1], dtype=np.int8) > 0) & _LEAD[data[:n]], offs),
            "n_symbols": _sums(_SYMBOL[data[:n]], offs),
            "n_dup_lines": np.array([_dup_lines(t) for t in texts], np.int64),
            "n_repeat_words": np.array([_repeated(grams[a : b - _WINDOW + 1]) if b - a > _WINDOW else 0 for a, b in zip(first[:-1], first[1:])], np.int64),
            "ratio": np.array([x[0] for x in judged]),
            "bad_share": np.array([x[1] for x in judged]),
        }
        found["base_failed"] = (n_words < 20) | (100 * found["n_repeat_words"] > 30 * n_words)
        good = np.array([bands.inside(len(t), x[0]) and x[1] <= bands.chunk_share for t, x in zip(texts, judged)], bool)
        found["kept"] = good & ~found["base_failed"]
        for k, v in found.items():
            out.setdefault(k, []).append(v)
    return {k: np.concatenate(v) for k, v in out.items()}


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """Statistics and verdict of each whole text, one row for each input row; no shuffle.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio, bad_share, base_failed, kept.
    Null texts count as empty: all counts 0, ratio 1, base_failed. Null ids stay null; repeated rows get equal
    results; other columns are not read. Repeats of word windows are found by 64-bit hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = measure(b.column(1), bands)
            names = [*_STATS, "ratio", "bad_share", "base_failed", "kept"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[k]) for k in names)], ["doc_id", *names])
        tidy()

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in _STATS) + ", ratio double, bad_share double, base_failed boolean, kept boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def keep_quality(docs: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of docs, with all their columns, whose text quality_rules keeps."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(measure(b.column(at), bands)["kept"]))
        tidy()

    return docs.mapInArrow(run, docs.schema)
