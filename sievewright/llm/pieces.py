"""SentencePiece encoding by unigram Viterbi over a double-array trie, and decoding."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import span_hash, text_chunks

SPACE = "▁"
#: Score of an unknown character below the worst piece, and distinct units whose ids a worker keeps.
UNKNOWN, CACHE_UNITS = 10.0, 1_000_000
#: Scores are whole multiples of 1 / GRAIN, so that sums are exact and don't depend on their order.
GRAIN = 1 << 20
#: What Zipf's law adds to a rank (Mandelbrot's form).
ZIPF_SHIFT = 2.7


def log_scores(scores: list[float]) -> list[float]:
    """Log scores of pieces: the model's own, if it is a unigram model.

    A model of merges has ranks 0, -1, -2, ... for scores (and large ones for pieces that no merge makes), whose sums mean
    nothing. By Zipf's law a piece of rank r has a probability in proportion to 1 / (r + ZIPF_SHIFT), which needs no
    corpus and no training; its logarithm is the score.
    """
    ranks = -np.array(scores, np.float64)
    if len(ranks) < 2 or (ranks != np.floor(ranks)).any() or ranks.min() < 0:
        return list(scores)
    ranks = np.minimum(ranks, len(ranks))
    weight = 1 / (ranks + ZIPF_SHIFT)
    return np.log(weight / weight.sum()).tolist()


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a serialized message; a value is a number or bytes."""

    def number(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (message[at] & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if message[at - 1] < 0x80:
                return out, at

    at = 0
    while at < len(message):
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
        else:
            size, at = number(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = message[at : at + size], at + size
        yield tag >> 3, value


#: Numbers of fields in a model's file, and of the type of a piece that a user defined.
_PIECE, _NORMALIZER, _TYPE, _USER_DEFINED = 1, 3, 3, 4
_CHARS, _DUMMY_PREFIX, _NO_EXTRA_SPACE, _ESCAPE = 2, 3, 4, 5


def check_model(serialized: bytes) -> None:
    """Raise where a model does to a text what the encoder here doesn't: replaces characters, adds no space before a text,
    drops extra spaces, keeps them unescaped, or has pieces that a user defined, which are cut out first."""
    odd = []
    for field, value in _fields(serialized):
        if field == _NORMALIZER:
            spec = {_DUMMY_PREFIX: 1, _NO_EXTRA_SPACE: 1, _ESCAPE: 1} | dict(_fields(value))
            odd += [what for what, is_so in (("replaces characters", spec.get(_CHARS)), ("adds no space before a text", not spec[_DUMMY_PREFIX]), ("drops extra spaces", spec[_NO_EXTRA_SPACE]), ("keeps spaces unescaped", not spec[_ESCAPE])) if is_so]
        elif field == _PIECE and dict(_fields(value)).get(_TYPE) == _USER_DEFINED:
            odd.append("has pieces that a user defined")
    if odd:
        raise ValueError(f"the model {', '.join(dict.fromkeys(odd))}: its ids would be others")


class DoubleArray:
    """A trie over bytes in two arrays: the child of state s by byte b is base[s] + b + 1 if check there is s."""

    def __init__(self, words: list[bytes]):
        tree: list[dict[int, int]] = [{}]
        ends = {}
        for i, w in enumerate(words):
            s = 0
            for b in w:
                if b not in tree[s]:
                    tree[s][b] = len(tree)
                    tree.append({})
                s = tree[s][b]
            ends[s] = i
        size = 8 * len(tree) + 8192
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[0] = False
        todo, low = [(0, 0)], 1
        while todo:
            node, state = todo.pop()
            value[state] = ends.get(node, -1)
            if not tree[node]:
                continue
            need = np.array(sorted(tree[node]), np.int64) + 1
            # The lowest place where all children find free slots: free slots for the first, then the others there.
            look, at = low, -1
            while at < 0:
                slots = look + np.flatnonzero(free[look : look + 2048])
                if look == low and len(slots) < 64:
                    low += 2048  # nearly full: leave it
                bases = slots - need[0]
                ok = bases >= 0
                for b in need[1:]:
                    ok &= free[np.maximum(bases, 0) + b]
                hit = np.flatnonzero(ok)
                at = int(bases[hit[0]]) if len(hit) else -1
                look += 2048
            base[state] = at
            free[at + need] = False
            check[at + need] = state
            todo += [(tree[node][b], at + b + 1) for b in tree[node]]
        top = int(np.flatnonzero(~free)[-1]) + 258
        self.base, self.check, self.value = base[:top], check[:top], value[:top]

    def walk(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next state of each, -1 where there is none."""
        to = np.minimum(self.base[state] + byte.astype(np.int32) + 1, len(self.check) - 1)
        return np.where(self.check[to] == state, to, -1)


class Unigram:
    """Pieces with log scores: the segmentation of the highest sum, unknown characters as bytes."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], skip: set[int]):
        self.pieces, self.byte_ids = pieces, np.array(byte_ids, np.uint32)
        ids = [i for i in range(len(pieces)) if i not in skip]
        if any(SPACE in pieces[i].lstrip(SPACE) for i in ids):
            raise ValueError("a piece has white space inside: units can't be encoded alone")
        self.trie = DoubleArray([pieces[i].encode() for i in ids])
        self.ids, self.scores = np.array(ids, np.uint32), np.round(np.array([scores[i] for i in ids], np.float64) * GRAIN) / GRAIN
        self.unknown = float(self.scores.min()) - UNKNOWN
        self.raw = [pieces[i].replace(SPACE, " ").encode() if i not in skip else b"" for i in range(len(pieces))]
        for b, i in enumerate(byte_ids):
            self.raw[i] = bytes([b])
        self.clear()

    @classmethod
    def load(cls, path: str) -> "Unigram":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        check_model(sp.serialized_model_proto())
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        skip = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        own = [i for i in range(n) if i not in skip]
        scores = [0.0] * n
        for i, x in zip(own, log_scores([sp.get_score(i) for i in own])):
            scores[i] = x
        return cls(names, scores, byte_ids, skip)

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def viterbi(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one behind the other, and how many each has. All units go forward together.

        Of equal sums the longer last piece wins.
        """
        data = np.frombuffer(b"".join(units), np.uint8)
        lens = np.array([len(u) for u in units], np.int64)
        unit = np.repeat(np.arange(len(units)), lens)
        begin = np.append(0, np.cumsum(lens))[:-1]
        end = np.repeat(begin + lens, lens)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(np.append(lead, len(data)))
        starts, stops, words = [], [], []
        at, state, depth = lead, np.zeros(len(lead), np.int32), 0
        while len(at):
            state = self.trie.walk(state, data[at + depth])
            live = state >= 0
            at, state, depth = at[live], state[live], depth + 1
            hit = np.flatnonzero(self.trie.value[state] >= 0)
            starts.append(at[hit])
            stops.append(at[hit] + depth)
            words.append(self.trie.value[state[hit]])
            live = at + depth < end[at]
            at, state = at[live], state[live]
        s, t, w = (np.concatenate(x) for x in (starts, stops, words))
        alone = np.ones(len(data), bool)
        alone[s[np.isin(t - s, (1, 2, 3, 4)) & (t == s + _width_at(lead, width, len(data))[s])]] = False
        odd = alone[lead]
        s = np.concatenate([s, lead[odd]])
        t = np.concatenate([t, lead[odd] + width[odd]])
        score = np.concatenate([self.scores[w], np.full(int(odd.sum()), self.unknown)])
        w = np.concatenate([w, np.full(int(odd.sum()), -1)])
        # Every segmentation has a border where no arc crosses, so each stretch between two such places goes alone: a
        # long unit takes as many steps as its longest stretch.
        cover = np.zeros(len(data) + 1, np.int64)
        np.add.at(cover, s + 1, 1)
        np.add.at(cover, t, -1)
        free = np.cumsum(cover)[:-1] == 0
        whole, unit, begin = unit, np.cumsum(free) - 1, np.flatnonzero(free)
        lens = np.diff(np.append(begin, len(data)))
        # Best sums by the distance from the stretch's begin. Slot p + unit is position p of the joined bytes as a border.
        own = unit[s]
        far = t - begin[own]
        order = np.lexsort((s, own, far))
        s, t, w, score, own, far = (x[order] for x in (s, t, w, score, own, far))
        best, back = np.zeros(len(data) + len(begin) + 1), np.zeros(len(data) + len(begin) + 1, np.int64)
        cut = np.append(np.flatnonzero(np.concatenate(([True], far[1:] != far[:-1]))), len(far)) if len(far) else np.zeros(1, np.int64)
        for a, b in zip(cut[:-1], cut[1:]):
            v = best[s[a:b] + own[a:b]] + score[a:b]
            g = np.concatenate(([True], own[a + 1 : b] != own[a : b - 1]))
            head = np.flatnonzero(g)
            top = np.maximum.reduceat(v, head)
            which = np.cumsum(g) - 1
            win = np.flatnonzero(v == top[which])
            win = win[np.concatenate(([True], which[win[1:]] != which[win[:-1]]))]
            slot = t[a + win] + own[a + win]
            best[slot], back[slot] = top, a + win
        # Walk back, all units at once.
        pos, alive = begin + lens, np.flatnonzero(lens > 0)
        arcs, owner = [], []
        while len(alive):
            arc = back[pos[alive] + alive]
            arcs.append(arc)
            owner.append(alive)
            pos[alive] = s[arc]
            alive = alive[pos[alive] > begin[alive]]
        arc, owner = np.concatenate(arcs), np.concatenate(owner)
        order = np.lexsort((s[arc], owner))
        arc, owner = arc[order], owner[order]
        # Unknown characters become their bytes.
        n = np.where(w[arc] < 0, t[arc] - s[arc], 1)
        ptr = np.append(0, np.cumsum(n))
        ids = np.repeat(np.where(w[arc] < 0, 0, self.ids[np.maximum(w[arc], 0)]), n).astype(np.uint32)
        unk = np.repeat(w[arc] < 0, n)
        where = np.repeat(s[arc] - ptr[:-1], n) + np.arange(ptr[-1])
        ids[unk] = self.byte_ids[data[where[unk]]]
        return ids, np.bincount(np.repeat(whole[s[arc]], n), minlength=len(units))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (bytes and offsets) one behind the other, and where each text's begin.

        Each text that isn't empty gets a leading space. A unit is a run of spaces with what follows; no piece
        reaches from one unit into the next, so distinct units are encoded once.
        """
        n, full = int(offs[-1]), np.flatnonzero(np.diff(offs) > 0)
        out = np.zeros(n + len(full) + 8, np.uint8)
        at = np.arange(n) + np.repeat(np.arange(1, len(full) + 1), np.diff(offs)[full])
        out[at] = data[:n]
        heads = offs[full] + np.arange(len(full))
        out[heads] = 0x20
        begin = (out[: n + len(full)] == 0x20) & np.concatenate(([True], out[: n + len(full) - 1] != 0x20))[: n + len(full)]
        begin[heads] = True
        starts = np.flatnonzero(begin)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        ends = np.append(starts[1:], n + len(full))
        keys, index, which = np.unique(span_hash(out, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_UNITS:
            self.clear()
        pos = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = pos < len(self.keys)
        new[inside] = self.keys[pos[inside]] != keys[inside]
        new = np.flatnonzero(new)
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            ids, size = self.viterbi([out[starts[i] : ends[i]].tobytes().replace(b" ", SPACE.encode()) for i in index[some]])
            first = len(self.flat) + np.append(0, np.cumsum(size)[:-1])
            self.flat = np.concatenate([self.flat, ids])
            self.keys, self.at, self.size = (np.concatenate(x) for x in ((self.keys, keys[some]), (self.at, first), (self.size, size)))
        if len(new):
            order = np.argsort(self.keys, kind="stable")
            self.keys, self.at, self.size = self.keys[order], self.at[order], self.size[order]
        pos = np.searchsorted(self.keys, keys)[which]
        size = self.size[pos]
        ptr = np.append(0, np.cumsum(size))
        first = np.zeros(len(offs), np.int64)
        first[full] = np.searchsorted(starts, heads)
        first[-1] = len(starts)
        empty = np.flatnonzero(np.diff(offs) == 0)
        if len(empty):
            # An empty text begins where the next full one does.
            follow = np.searchsorted(full, empty)
            first[empty] = np.append(first[full], len(starts))[follow]
        return self.flat[np.repeat(self.at[pos] - ptr[:-1], size) + np.arange(ptr[-1])], ptr[first]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces with markers as spaces, byte pieces as bytes, without the leading space."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.raw):
            raise ValueError(f"ids are from 0 to {len(self.raw) - 1}")
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def _width_at(lead: np.ndarray, width: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n + 1, np.int64)
    out[lead] = width
    return out


_models: dict[str, Unigram] = {}


def _model(path: str) -> Unigram:
    if path not in _models:
        _models[path] = Unigram.load(path)
    return _models[path]


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each whole text, a row for each input row; no shuffle.

    The model's file must leave texts as they are, but for a space before them that is added here too, and have no pieces
    that a user defined; another is an error (check_model).

    Null and empty texts have no ids, null ids stay null, repeated rows get equal results; very long texts are encoded
    in whole; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni = _model(model)
        for b in batches:
            for lo, hi, data, offs in text_chunks(b.column(1)):
                flat, ptr = uni.encode(data, offs)
                ids = pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), ids], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of each row's ids, a row for each input row.

    Null ids arrays and empty ones give an empty text; a null id within one is passed over, one that no piece has is an
    error. Null doc_ids stay null; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni = _model(model)
        for b in batches:
            texts = [uni.decode(np.array([i for i in x or () if i is not None], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def piece_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_pieces and decode_pieces in one pass: doc_id, n_ids, n_bytes (byte fallbacks), ids_crc32 (of unsigned
    little-endian 32-bit ids), text_sha256 of the decoded text, exact (whether it is the source)."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni = _model(model)
        for b in batches:
            for lo, hi, data, offs in text_chunks(b.column(1)):
                flat, ptr = uni.encode(data, offs)
                is_byte = np.append(0, np.cumsum(np.isin(flat, uni.byte_ids)))
                rows = []
                for d in range(hi - lo):
                    ids = flat[ptr[d] : ptr[d + 1]]
                    text = uni.decode(ids).encode()
                    same = text == data[offs[d] : offs[d + 1]].tobytes()
                    rows.append((len(ids), int(is_byte[ptr[d + 1]] - is_byte[ptr[d]]), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(text).hexdigest(), same))
                cols = [pa.array(x) for x in zip(*rows)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *cols], ["doc_id", "n_ids", "n_bytes", "ids_crc32", "text_sha256", "exact"])

    schema = "doc_id long, n_ids long, n_bytes long, ids_crc32 long, text_sha256 string, exact boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
