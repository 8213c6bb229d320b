"""Plain Python versions of the operators, written from their contracts."""

import hashlib
import re
import struct
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def near_duplicates(rows, width=5, per_cent=85):
    sets = {}
    for i, text in rows:
        w = WORD.findall(lower(text))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = {}
    for i, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in having[x] if j < i).items():
            if 100 * k >= per_cent * (len(s) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = {k + d for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for d in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))
    n = Counter(x[2] for x in out)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(joined.encode()).hexdigest()


def check_packing(rows, pieces, encode, window=2048):
    """Every text's ids lie in exactly one piece, and sequences are gapless; the share of padding."""
    got = {}
    for p in pieces:
        got.setdefault(p["doc_id"], []).append(p)
    for i, text in rows:
        ids = [*encode(text or ""), 1]
        at = 0
        for p in sorted(got[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            own = ids[at : at + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            at += p["length"]
        assert at == len(ids)
    seqs = {}
    for p in pieces:
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(seqs) == list(range(len(seqs)))
    return 1 - sum(p["length"] for p in pieces) / (window * len(seqs))


KEY_ID = re.compile(r"""(?i:access_?key(?:_?id)?|client_?id|account_?id|user_?name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.-]{6,}|AKIA[A-Z0-9]{4,}""")
KEY_SECRET = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(r"""(?i:https?|s3|amqps?|postgres(?:ql)?|mysql|redis|mongodb)://[^\x20\x09-\x0D"'<>]+""")


def secret_spans(text, scope=300):
    """All spans (start, rank, end, kind), weak parts by comparing every pair."""
    text = text or ""
    of = lambda p: [(m.start(), m.end(), m) for m in p.finditer(text)]
    assign = of(ASSIGN)
    access = [x for x in of(re.compile("AKIA[A-Z0-9]+")) if x[1] - x[0] >= 18]
    hexes = of(re.compile("[0-9a-f]{16,}"))
    key_id, endpoint = of(KEY_ID), of(ENDPOINT)
    key_secret = [x for x in of(KEY_SECRET) if all(re.search(c, x[2][0]) for c in ("[0-9]", "[A-Z]", "[a-z]"))]
    strong, weak = [x for x in assign if len(x[2][2]) >= 12], [x for x in assign if len(x[2][2]) < 12]
    ids, secret = access + key_id, assign + hexes + key_secret
    near = lambda a, others: any(o[0] <= a[1] + scope and o[1] >= a[0] - scope for o in others)
    out = [(x, 0, "assign") for x in strong] + [(x, 1, "access") for x in access] + [(x, 2, "hex") for x in hexes]
    out += [(x, 3, "key_id") for x in key_id if near(x, secret) and x[0] not in {a[0] for a in access}]
    out += [(x, 4, "key_secret") for x in key_secret if near(x, ids)]
    out += [(x, 5, "endpoint") for x in endpoint if near(x, ids) and near(x, secret)]
    out += [(x, 6, "weak_assign") for x in weak if near(x, ids)]
    return sorted((x[0], rank, x[1], kind) for x, rank, kind in out)


def masked(text, spans):
    out, at = "", 0
    for start, _, end, _ in spans:
        if start >= at:
            out += text[at:start] + "[REDACTED]"
        at = max(at, end)
    return out + text[at:]


def compression_verdict(text, limits, slack, share, chunk=4096, level=3):
    """Whether a text's size over its zstandard size lies within the limits of its size, and its chunks' too."""
    import zstandard

    raw = (text or "").encode()
    pack = zstandard.ZstdCompressor(level=level, write_content_size=False).compress

    def within(piece, wider):
        if not piece:
            return True
        low, high = [(a, b) for size, a, b in limits if len(piece) >= size][-1]
        return low / wider <= len(piece) / len(pack(piece)) <= high * wider

    pieces = [raw[k : k + chunk] for k in range(0, len(raw), chunk)]
    odd = sum(len(x) for x in pieces if not within(x, slack))
    return within(raw, 1.0) and odd <= share * len(raw)
