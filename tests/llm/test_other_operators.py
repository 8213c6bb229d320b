"""WARC archives, embeddings, URL filters, licences, pieces and chats against brute force and on edge cases."""

import base64
import gzip
import hashlib
import io
import json
import math
import pathlib
import re
import time
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import chat, embeddings, licenses, pieces, queries, urls, warc

LONG = "long and "


# --- WARC


def warc_want(rows):
    last = {}
    for i, html in rows:
        p = (html or "").encode()
        last[p] = max(i, last.get(p, i))
    out = set()
    for i, html in rows:
        p = (html or "").encode()
        d = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.add((i, len(p), d, "response" if last[p] == i else "revisit", None if last[p] == i else last[p]))
    return out


def test_warc(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()]
    assert {tuple(r) for r in queries.op3_warc(spark, sf_dir).collect()} == warc_want(rows)


def test_warc_edges(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "é" * 70_000), (4, "same"), (5, "same"), (6, "a\r\n\r\nb"), (7, LONG * 30_000)]
    df = spark.createDataFrame([(i, f"http://x/{i}\n%20" if i > 1 else None, h, "clash", 5) for i, h in rows], "page_id long, url string, html string, sha1 string, response int")
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 500)
    monkeypatch.setattr(warc, "READ_BYTES", 300)
    monkeypatch.setattr(warc, "SPLIT_LINES", 2)
    archives = warc.write_archives(df, warc.archive_folder(spark))
    assert archives.count() > 1
    got = warc.read_archives(archives).collect()
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == warc_want(rows)
    by = dict(rows)
    assert all(bytes(r.payload).decode() == (by[r.page_id] or "") for r in got if r.record_type == "response")
    assert {r.url for r in got if r.page_id < 3} == {None, "http://x/2%0A%20"}
    path = archives.filter("records > 0").first().path.removeprefix("file://")
    with zipfile.ZipFile(path) as z:  # another reader agrees
        assert z.testzip() is None and {x.compress_type for x in z.infolist()} == {0}
    assert warc.read_archives(warc.write_archives(df.limit(0), warc.archive_folder(spark))).count() == 0
    small = warc.read_archives(warc.write_archives(df, warc.archive_folder(spark), min_bytes=5), with_payload=False)
    assert all(r.record_type == "response" for r in small.collect())


def test_warc_members_without_an_id_and_of_other_tools(spark, monkeypatch, tmp_path):
    rows = [(None, "same"), (None, "alone"), (None, "alone"), (3, "same"), (5, "same"), (5, "same"), (-2, "x"), (5, "other")]
    df = spark.createDataFrame([(i, None, h) for i, h in rows], "page_id long, url string, html string")
    monkeypatch.setattr(warc, "MEMBER_BYTES", 300)
    monkeypatch.setattr(warc, "SPLIT_LINES", 2)
    archives = warc.write_archives(df.coalesce(1), warc.archive_folder(spark))
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload and bytes(r.payload)) for r in warc.read_archives(archives).collect()), key=str)
    want = [(None, "revisit", 5, None), (None, "response", None, b"alone"), (None, "response", None, b"alone"), (3, "revisit", 5, None), (5, "response", None, b"same"), (5, "response", None, b"same"), (-2, "response", None, b"x"), (5, "response", None, b"other")]
    assert got == sorted(want, key=str)
    members = [m.filename for r in archives.collect() for m in zipfile.ZipFile(r.path.removeprefix("file://")).infolist()]
    assert sum(m.endswith(".warc.gz") for m in members) > archives.count() and len(members) % 2 == 0
    # An archive of another tool: one member without an index, one packed as a whole, one plain, one indexed.
    one = warc.record(1, "http://a/", b"<p>", warc.base32_sha1(b"<p>"), None, "2020-01-01T00:00:00Z")
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    gz = [gzip.compress(x) for x in (info, one, one)]
    path, empty = tmp_path / "o.wacz", tmp_path / "e.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/a.warc.gz", b"".join(gz))
        z.writestr("archive/b.warc.gz", gzip.compress(info + one * 3))
        z.writestr("archive/c.warc", one * 2 + info)
        z.writestr("archive/d.warc.gz", b"".join(gz))
        z.writestr("indexes/index.cdx", "a 2020 " + json.dumps({"filename": "d.warc.gz", "offset": str(len(gz[0])), "length": str(len(gz[1]))}) + "\n")
        z.writestr("indexes/other.idx", "not lines")
    with zipfile.ZipFile(empty, "w") as z:
        z.writestr("datapackage.json", "{}")
    monkeypatch.setattr(warc, "READ_BYTES", 50)
    back = warc.read_archives(spark.createDataFrame([(str(path),), (str(empty),), (None,)], "path string")).collect()
    assert Counter((r.page_id, r.record_type, r.url, r.payload_bytes) for r in back) == {(1, "response", "http://a/", 3): 2 + 3 + 2 + 1, (None, "warcinfo", None, 5): 3}
    (tmp_path / "cut.zip").write_bytes(path.read_bytes()[:-30])
    with pytest.raises(Exception, match="not a ZIP archive"):
        warc.read_archives(spark.createDataFrame([(str(tmp_path / "cut.zip"),)], "path string")).collect()


def test_zip_directories():
    class Sized(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    plain = Sized()
    with zipfile.ZipFile(plain, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a/b.txt", b"hello world")
        z.comment = b"a note"
    z = warc.ZipFile(plain)
    assert z.read(z.members[0], 6, 5) == b"world"
    with zipfile.ZipFile(plain, "a", zipfile.ZIP_DEFLATED) as w:
        w.writestr("packed", b"x" * 100)
    with pytest.raises(ValueError):
        z = warc.ZipFile(plain)
        z.read(z.members[1])
    with pytest.raises(ValueError):
        warc.ZipFile(Sized(b"not a zip"))


# --- embeddings


def vectors_want(rows, limit=0.98):
    ok = [(i, lab, np.array(v, np.float64)) for i, lab, v in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    parent, links = {r[0]: r[0] for r in rows}, dict.fromkeys((r[0] for r in rows), 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for lab in {x[1] for x in ok}:
        own = [x for x in ok if x[1] == lab]
        for d in {len(x[2]) for x in own}:
            ids = [x[0] for x in own if len(x[2]) == d]
            m = np.array([x[2] for x in own if len(x[2]) == d])
            m = m / np.abs(m).max(axis=1, keepdims=True)
            m = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
            near = m @ m.T >= limit
            for a, b in zip(*np.nonzero(near)):
                if a != b:
                    links[ids[a]] += 1
                    x, y = sorted((root(ids[a]), root(ids[b])))
                    parent[y] = x
    return {(i, links[i], root(i), root(i) == i) for i, _, _ in rows}


def test_embeddings(spark, sf_dir):
    rows = [(r.vec_id, r.label, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert {tuple(r) for r in queries.op4_embeddings(spark, sf_dir).collect()} == vectors_want(rows)


def test_embedding_edges(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((6, 12))
    rows = [(i, int(i % 2), (base[i % 6] + 0.05 * rng.standard_normal(12)).tolist()) for i in range(150)]
    rows += [(i, 0, base[0].tolist()) for i in range(150, 190)]
    rows += [(200, None, base[0].tolist()), (201, 0, None), (202, 0, [0.0] * 12), (203, 0, [float("nan")] + [1.0] * 11), (204, 0, [None] + [1.0] * 11), (205, 0, []), (206, 0, [1.0]), (207, 0, [2.0]), (208, 0, (base[0] * 1e200).tolist()), (209, 0, (base[0] * 1e-200).tolist())]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, cell int, unit string")
    want = vectors_want(rows)
    assert {tuple(r) for r in embeddings.near_vectors(df).collect()} == want
    for part, cell, leaf in ((3, 2048, 24), (4096, 8, 3), (2, 16, 2)):
        monkeypatch.setattr(embeddings, "PART", part)
        monkeypatch.setattr(embeddings, "PART_NEAR", part)
        monkeypatch.setattr(embeddings, "CELL", cell)
        monkeypatch.setattr(embeddings, "LEAF", leaf)
        assert {tuple(r) for r in embeddings.near_vectors(df).collect()} == want, (part, cell, leaf)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_embeddings_that_repeat_an_id(spark):
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, x), (1, y), (2, [1.0, 0.01, 0.0]), (None, [1.0, 0.02, 0.0]), (3, [0.01, 1.0, 0.0]), (None, [0.0, 0.0, 1.0])]
    got = embeddings.near_vectors(spark.createDataFrame([(i, 0, v) for i, v in rows], "vec_id long, label int, embedding array<double>"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (None, 2, 1, False), (3, 1, 1, False), (None, 0, None, True)], key=str)


def test_block_join_prunes():
    """Against all pairs, and with a share of comparisons that falls with the number of vectors."""
    rng = np.random.default_rng(6)
    shares = []
    for n in (1000, 4000, 16_000):
        x = (rng.standard_normal((n, 8)) / 8).astype("<f4").astype(float)
        x[: n // 10] = x[n // 10 : 2 * (n // 10)] + 0.01 * rng.standard_normal((n // 10, 8))
        compared, found = 0, []
        for i, j, k in embeddings.near_in_block(x, x, 0.005):
            compared += k
            found.append(i * n + j)
        shares.append(8 * compared / n**2)
        if n == 1000:
            near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= 0.005
            assert np.array_equal(np.sort(np.concatenate(found)), np.flatnonzero(near.ravel()))
    assert shares[0] > shares[1] > shares[2] and shares[0] < 1 and shares[2] < 0.4


@pytest.mark.parametrize("d", [64, 384, 768])
def test_copies_in_cells_do_not_grow_with_the_width(d):
    """Random unit vectors, the worst case: how many cells a vector's ball reaches in a block, by the size of its label."""
    blocks = embeddings.cuts(d)
    assert max(b - a for a, b in blocks) <= (embeddings.NARROW if d <= 64 else embeddings.WIDE) and (blocks[0][0], blocks[-1][1]) == (0, d)
    x = np.random.default_rng(1).standard_normal((500, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    deviation = x.std(axis=0)
    for size, most in ((embeddings.CELL, 1), (1 << 17, 2), (1 << 20, 6), (1 << 24, 25)):
        copies = 0
        for (a, b), budget in zip(blocks, embeddings.budgets(d, 0.98)):
            bits = embeddings._bits(size, b - a, embeddings.CELL)
            borders = [deviation[a + c] * np.array(embeddings._BORDERS[n]) if n else np.zeros(0) for c, n in enumerate(bits)]
            row, _, home = embeddings._dealt(x[:, a:b], borders, budget)
            assert home.sum() == len(x)
            copies += len(row)
        assert copies <= most * len(blocks) * len(x), (size, copies / len(blocks) / len(x))


def test_wide_vectors(spark, monkeypatch):
    """All links of vectors of many blocks, their space split and their cells in parts."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 200))
    rows = [(i, i % 2, (base[i % 60] + rng.choice([0.05, 0.12, 0.15]) * rng.standard_normal(200)).tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    monkeypatch.setattr(embeddings, "CELL", 16)
    monkeypatch.setattr(embeddings, "PART", 8)
    got = {tuple(r) for r in embeddings.near_vectors(df).collect()}
    assert got == vectors_want(rows) and any(r[1] for r in got) and not all(r[1] for r in got)


# --- URLs


def url_want(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        k = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:k])
        path = rest[k:].split("?")[0].split("#")[0]
    fit = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


def test_urls(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()]
    assert {tuple(r) for r in queries.op7_urls(spark, sf_dir).collect()} == {(i, *url_want(u)) for i, u in rows}


def test_url_edges(spark):
    rows = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/71?x#y", "http://example.com/en/6", "ftp://a.b.example.net#f", "x://example.net/de/80/", "x://notcom/en/", "x://com/en/", "a://b://com/en/", "x://ÄB.org/es/é", "http://x.org/es", "x://" + "a." * 5000 + "com/en/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(rows)] + [(4, rows[4], "h")], "page_id long, url string, host string")
    got = urls.filter_urls(spark, df, queries.RULES).collect()
    assert len(got) == len(rows) + 1 and all(tuple(r)[1:] == url_want(rows[r.page_id]) for r in got)
    assert urls.filter_urls(spark, df.limit(0), []).count() == 0
    assert {r.verdict for r in urls.filter_urls(spark, df, []).collect()} == {"allow"}


def test_rules_that_no_url_fits(spark):
    for host, path in (("a.com/x", ""), ("a.com?", ""), ("a#", "/x"), ("a.co", "m/x")):
        with pytest.raises(ValueError):
            urls.Rule(host, path)
    df = spark.createDataFrame([(1, "http://a.com/x/y"), (2, "http://b.a.com/z")], "page_id long, url string")
    table = spark.createDataFrame([("a.com", "/x", "block"), ("a.com/x", None, "look"), ("a.co", "m/x", "look")], "host string, path string, verdict string")
    assert {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(spark, df, table).collect()} == {1: ("a.com/x", "block"), 2: (None, "allow")}


def test_only_lengths_under_a_host_are_probed(tmp_path):
    path = tmp_path / "d.bin"
    rules = [urls.Rule("a.com", "/" + "x" * k) for k in range(50)] + [urls.Rule("b.com", "/yy"), urls.Rule("c.com")]
    path.write_bytes(urls.DigestArray.pack(rules))
    found = urls.RuleFiles([str(path)]).path_lengths(["a.com", "b.com", "c.com", "com", "d.com"])
    assert found == {"a.com": list(range(1, 51)), "b.com": [3], "c.com": [0]}


def test_digest_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh3_64_intdigest", lambda b: len(b))
    path = tmp_path / "d.bin"
    path.write_bytes(urls.DigestArray.pack([urls.Rule("aa"), urls.Rule("bb", verdict="allow"), urls.Rule("c")]))
    index = urls.DigestArray(str(path))
    found = index.find([b"bb", b"aa", b"zz", b"c"])
    assert [index.verdicts[index.verdict[k]] if k >= 0 else None for k in found] == ["allow", "block", None, "block"]


def test_rules_in_several_files(spark, monkeypatch):
    rng = np.random.default_rng(5)
    hosts = [f"h{k}.example" for k in range(150)]
    rules = [urls.Rule(h, str(rng.choice(["", "/a", "/a/b", "/long/path"])), str(rng.choice(["block", "allow", "look"]))) for h in hosts for _ in range(2)]
    pages = [(i, f"http://www.{rng.choice(hosts)}{rng.choice(['', '/', '/a', '/a/b/c', '/long/path?x'])}") for i in range(600)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    last = {r.host + r.path: r for r in rules}

    def want(url):
        host, path = urls.split_url(url)
        fit = [r for r in last.values() if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.host + r.path), default=None)
        return (best.host + best.path, best.verdict) if best else (None, "allow")

    for n in (7, 1000):
        paths = urls.write_rules(spark, rules, n)
        assert len(paths) == -(-len(last) // n)
        monkeypatch.setattr(urls, "write_rules", lambda *a, paths=paths: paths)
        assert {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(spark, df, rules).collect()} == {i: want(u) for i, u in pages}
        monkeypatch.undo()
    table = spark.createDataFrame([(r.host, r.path or None, r.verdict) for r in last.values()] + [(None, "/x", "block"), ("h", "/x", None)], "host string, path string, verdict string")
    paths = urls.write_rules(spark, table, 40)
    assert len(paths) > 4
    monkeypatch.setattr(urls, "write_rules", lambda *a: paths)
    assert {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(spark, df, table).collect()} == {i: want(u) for i, u in pages}
    monkeypatch.undo()
    assert urls.filter_urls(spark, df, table.limit(0)).filter("verdict <> 'allow'").count() == 0


# --- licences


def licence_want(files, templates=licenses.TEMPLATES):
    """path -> (license, score) by every segment of every file, in plain Python."""
    terms = lambda t: re.findall(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*", t.lower())
    n, df = len(files), Counter(x for _, t in files for x in set(terms(t or "")))
    weigh = lambda t: {x: k * (math.log((1 + n) / (1 + df[x])) + 1) for x, k in Counter(terms(t)).items()}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
    marks, out = [(name, weigh(t)) for name, t in templates], {}
    for path, text in files:
        found = []
        segments = {*(text or "").split("\n"), *re.split(r"\n[\x20\x09-\x0D]*\n", text or "")}
        if re.search(licenses.FILE_NAME, str(path)):
            segments.add(text or "")
        for seg in segments:
            w, near = weigh(seg), {}
            for name, v in marks:
                if set(w) & set(v):
                    near[name] = max(near.get(name, 0), round(sum(x * v.get(k, 0) for k, x in w.items()) / (norm(w) * norm(v)), 6))
            ranked = sorted(((-x, name) for name, x in near.items()), key=lambda y: y)
            if ranked and -ranked[0][0] >= 0.5 and not re.search(r"\b(not|never|cannot|isn t|aren t|no longer) (\S+ ){0,2}(licensed|relicensed|released|dedicated)\b", " ".join(terms(seg))):
                unsure = len(ranked) > 1 and round(ranked[1][0] - ranked[0][0], 6) < 0.02
                found.append((unsure, ranked[0][0], "unknown" if unsure else ranked[0][1]))
        out[path] = (min(found)[2], -min(found)[1]) if found else (None, None)
    return out


def test_licenses(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op8_licenses(spark, sf_dir).collect()}
    want = licence_want([(i, d.text) for i, d in docs.items()])
    assert set(got) == set(docs)
    for i, (name, score) in want.items():
        assert (got[i].license, got[i].origin) == (name, "own" if name else "none") and (name is None or abs(got[i].score - score) < 2e-6), i
    marks = {"Apache License, Version 2.0": "Apache-2.0", "the MIT License": "MIT", "General Public License, version 3": "GPL-3.0", "CC BY-NC 4.0": "CC-BY-NC-4.0"}
    for i, d in docs.items():
        own = {v for k, v in marks.items() if k in d.text}
        assert (got[i].license in own) if own else got[i].license is None, i


def test_documents_inherit_licenses(spark, tmp_path):
    """A document without an id may be a licence file by name; each document has a row, also where names repeat."""
    import duckdb

    apache, mit = "Licensed under the Apache License, Version 2.0", "Released under the MIT License"
    rows = [(None, "LICENSE", "web", apache), (1, "en", "web", "some text"), (2, "de", "web", mit), (3, None, "web", None), (4, "en", "forum", "x"), (4, "en", "forum", "x"), (None, "7", "forum", mit), (None, None, None, ""), (5, None, None, "y")]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op8_licenses(spark, str(tmp_path)).collect()]
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        assert Counter(got) == Counter(con.execute(queries.SQL["op8_licenses"]).fetchall())
    assert {r[0]: r[1:] for r in got if r[0] in (1, 2, 3)} == {1: ("Apache-2.0", 1.0, "inherited", "web"), 2: ("MIT", 1.0, "own", None), 3: ("Apache-2.0", 1.0, "inherited", "web")}
    assert Counter(r[0] for r in got) == {None: 3, 1: 1, 2: 1, 3: 1, 4: 2, 5: 1}


def test_license_edges(spark):
    odd = " ".join(f"w{k}" for k in range(300))
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.c", None), ("a/b/c/y.c", "int main;"), ("a/b/LICENSE", "text\nLicensed under the Apache License, Version 2.0."), ("z/none.c", "licence to kill"), ("top.c", ""), ("long.c", odd + "\n" + "z " * 200_000 + "\n# Released under\n# the MIT License\n\n" + odd)]
    df = spark.createDataFrame([(p, t, 1) for p, t in [*rows, rows[0], (None, "Released under the MIT License")]], "path string, text string, score int")
    got = {r.path: r for r in licenses.scan_licenses(df).collect()}
    assert {p: (r.license, r.origin, r.from_dir) for p, r in got.items()} == {
        "a/LICENSE": ("MIT", "own", None), "a/b/x.c": ("Apache-2.0", "inherited", "a/b"), "a/b/c/y.c": ("Apache-2.0", "inherited", "a/b"), "a/b/LICENSE": ("Apache-2.0", "own", None),
        "z/none.c": (None, "none", None), "top.c": (None, "none", None), None: (None, "none", None), "long.c": ("MIT", "own", None),
    }
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    assert {r.origin for r in licenses.scan_licenses(df, templates=df.select(F.lit("").alias("license"), F.lit("").alias("notice")).limit(0)).collect()} == {"none"}
    assert {r.origin for r in licenses.scan_licenses(df, templates=()).collect()} == {"none"}


MIT_TEXT = """MIT License

Copyright (c) 2020 Jane Roe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_full_licence_texts(spark):
    notice = "Licensed under the Apache License, Version 2.0"
    rows = [("r/LICENSE", MIT_TEXT), ("r/src/x.c", "int main;"), ("r/y.c", notice), ("s/license.py", MIT_TEXT), ("s/z.c", "int"), ("q/COPYING.txt", MIT_TEXT.replace("\n", "\r\n")), ("q/a/b/c.c", None), (None, MIT_TEXT)]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: (r.license, r.origin, r.from_dir) for r in licenses.scan_licenses(df).collect()}
    assert got["r/LICENSE"] == ("MIT", "own", None) and got["r/src/x.c"] == ("MIT", "inherited", "r")
    assert got["r/y.c"] == ("Apache-2.0", "own", None)
    assert got["s/z.c"] == (None, "none", None)
    assert got["q/a/b/c.c"] == ("MIT", "inherited", "q") and got["q/COPYING.txt"][:2] == ("MIT", "own")


def test_whole_files_of_many_licences(spark):
    top = pathlib.Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "GPL-2": "GPL-2.0", "LGPL-3": "LGPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    names = {k: v for k, v in names.items() if (top / k).exists()}
    rows = [("mit/COPYING", MIT_TEXT)] + [(f"{k}/LICENSE", (top / k).read_text()) for k in names]
    names = names | {"mit": "MIT"}
    rows += [(f"{k}/src/deep/x{n}.c", "int main() {}") for k in names for n in range(3)]
    got = {r.path: (r.license, r.origin) for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    for k, want in names.items():
        assert got[f"{k}/src/deep/x1.c"] == (want, "inherited"), k


def test_wrapped_headers(spark):
    """Notices wrapped in comments, above code, that differ in a word or a number."""
    by = {"GPL-3.0": ("program", ":", "", ",", "3"), "GPL-2.0": ("program", ";", "", ";", "2"), "LGPL-2.1": ("library", ";", "Lesser ", ";", "2.1"), "LGPL-3.0": ("library", ":", "Lesser ", ",", "3"), "AGPL-3.0": ("program", ":", "Affero ", ",", "3")}
    notice = "/*\n * This {} is free software{} you can redistribute it and/or\n * modify it under the terms of the GNU {}General Public License as\n * published by the Free Software Foundation{} either version {} of the\n * License, or (at your option) any later version.\n */\n\nint main(void) {{ return 0; }}\n"
    apache = '# Copyright 2020 Jane Roe\n#\n# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#     http://www.apache.org/licenses/LICENSE-2.0\nimport os\n'
    rows = [(k, notice.format(*v)) for k, v in by.items()] + [("Apache-2.0", apache), ("none", "int main(void) { return 0; }\n// see the manual for the terms of use of this software and its copies\n")]
    got = {r.path: r.license for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {k: k for k in [*by, "Apache-2.0"]} | {"none": None}


ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by
a source language processor.
"""
ZLIB = """Copyright (c) 1999 Jane Roe

This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
BSD_2 = """Copyright (c) 2020, Jane Roe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
THIRD = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE"""


def test_licences_that_resemble_others(spark, sf_dir):
    """Whole files among ordinary documents: each is told from those that share its sentences."""
    isc = ZERO_BSD.replace("granted.", "granted, provided that the above\ncopyright notice and this permission notice appear in all copies.")
    files = {"0BSD": ZERO_BSD, "ISC": isc, "BSL-1.0": BOOST, "Zlib": ZLIB, "MIT": MIT_TEXT, "BSD-2-Clause": BSD_2, "BSD-3-Clause": BSD_2.replace("THIS SOFTWARE", THIRD, 1)}
    rows = [(f"{k}/LICENSE", t) for k, t in files.items()] + [(f"{k}/src/x.c", "int main;") for k in files]
    comment = lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.split("\n")) + " */\nint main;\n"
    rows += [(f"head/{k}.c", comment(t)) for k, t in files.items()]
    denied = ["This file is not licensed under the Apache License, Version 2.0", "It is no longer released under the MIT License.", "This isn't released under the MIT License"]
    rows += [(f"denied/{k}.txt", t) for k, t in enumerate(denied)] + [("both.txt", denied[0] + "\nReleased under the MIT License")]
    rows += [(f"docs/{r.doc_id}", r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.path: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    for k in files:
        assert (got[f"{k}/LICENSE"].license, got[f"{k}/LICENSE"].origin) == (k, "own") and (got[f"{k}/src/x.c"].license, got[f"{k}/src/x.c"].origin) == (k, "inherited"), k
        assert got[f"head/{k}.c"].license == k and got[f"{k}/LICENSE"].score > 0.85, k
    assert [got[f"denied/{k}.txt"].license for k in range(3)] == [None] * 3 and got["both.txt"].license == "MIT"
    want = licence_want(rows)
    assert all((want[p][0], "own" if want[p][0] else got[p].origin) == (got[p].license if got[p].origin == "own" else None, got[p].origin) for p, _ in rows)
    assert all(want[p][0] is None or abs(want[p][1] - got[p].score) < 2e-6 for p, _ in rows)


def test_near_several_licences(spark, monkeypatch):
    rows = [("x/LICENSE", "may be copied freely by all"), ("x/y.c", "int;"), ("z.c", "may be copied freely by none")]
    some = [("A", "may be copied freely"), ("B", "may be copied freely"), ("C", "copied by none freely")]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: (r.license, r.origin) for r in licenses.scan_licenses(df, templates=some).collect()}
    assert got == {"x/LICENSE": ("unknown", "own"), "x/y.c": ("unknown", "inherited"), "z.c": ("C", "own")}
    table = spark.createDataFrame([*some, some[0]], "license string, notice string")
    monkeypatch.setattr(licenses, "LOOKUP_ROWS", 0)
    assert {r.path: (r.license, r.origin) for r in licenses.scan_licenses(df, templates=table).collect()} == got


def test_root_licence(spark):
    apache = "Licensed under the Apache License, Version 2.0"
    rows = [("LICENSE", MIT_TEXT), ("setup.cfg", "x"), ("src/x.c", "int;"), ("src/a/b/y.c", None), ("lib/LICENSE", apache), ("lib/z/z.c", "int;"), (None, "text")]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: (r.license, r.origin, r.from_dir) for r in licenses.scan_licenses(df).collect()}
    assert {p: got[p] for p in ("setup.cfg", "src/x.c", "src/a/b/y.c")} == dict.fromkeys(("setup.cfg", "src/x.c", "src/a/b/y.c"), ("MIT", "inherited", ""))
    assert got["lib/z/z.c"] == ("Apache-2.0", "inherited", "lib") and got[None] == (None, "none", None)
    full = spark.createDataFrame([("/LICENSE", apache), ("/src/x.c", "int;"), ("/y.c", "int;")], "path string, text string")
    assert {r.path: (r.origin, r.from_dir) for r in licenses.scan_licenses(full).collect()}["/src/x.c"] == ("inherited", "")


def test_licence_file_names():
    import re

    is_file = lambda x: bool(re.search(licenses.FILE_NAME, x))
    assert all(map(is_file, ["LICENSE", "a/licence.md", "COPYING.LESSER", "COPYING3", "x/LICENSE-MIT", "LICENSE-2.0.txt", "MIT-LICENSE", "NOTICE", "UNLICENSE"]))
    assert not any(map(is_file, ["license.py", "LICENSE/x.c", "third-party-licenses.txt", "a/licensed.txt", "web/en/12"]))


# --- pieces


def test_models_that_change_texts():
    field = lambda number, kind, body: bytes([number << 3 | kind]) + (bytes([len(body)]) + body if kind == 2 else body)
    piece = lambda kind: field(1, 2, field(1, 2, b"ab") + field(2, 5, bytes(4)) + field(3, 0, bytes([kind])))
    plain = field(4, 0, b"\x00")
    pieces.check_model(piece(1) + piece(6) + field(3, 2, field(1, 2, b"identity") + plain))
    odd = {"replaces": field(2, 2, b"xyz") + plain, "no space": field(3, 0, b"\x00") + plain, "extra": field(1, 2, b"identity"), "unescaped": plain + field(5, 0, b"\x00")}
    for what, spec in odd.items():
        with pytest.raises(ValueError, match=what):
            pieces.check_model(piece(1) + field(3, 2, spec))
    with pytest.raises(ValueError, match="user"):
        pieces.check_model(piece(4) + field(3, 2, plain))


@pytest.fixture(scope="module")
def uni():
    return pieces.Unigram.load(queries.tokenizer_path("piece_bpe_32k.model"))


def ids_of(uni, text):
    raw = text.encode()
    return uni.encode(np.frombuffer(raw + b"\0" * 8, np.uint8), np.array([0, len(raw)]))[0].tolist()


def viterbi(uni, text):
    """Straight dynamic program over the whole text."""
    if not text:
        return []
    chars = " " + text
    chars = chars.replace(" ", pieces.SPACE)
    index = uni.__dict__.setdefault("index", {uni.pieces[i]: (int(i), float(s)) for i, s in zip(uni.ids, uni.scores)})
    best = [(0.0, None, None)] + [None] * len(chars)
    for t in range(1, len(chars) + 1):
        for s in range(max(0, t - 40), t):
            hit = index.get(chars[s:t])
            score = hit[1] if hit else uni.unknown if t - s == 1 else None
            if score is not None and best[s] is not None and (best[t] is None or best[s][0] + score > best[t][0]):
                best[t] = (best[s][0] + score, s, hit[0] if hit else None)
    out, t = [], len(chars)
    while t:
        _, s, i = best[t]
        out = ([i] if i is not None else [int(uni.byte_ids[b]) for b in chars[s:t].encode()]) + out
        t = s
    return out


def test_pieces(uni, spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op9_sentencepiece(spark, sf_dir).collect()
    assert len(got) == len(rows) and all(r.exact for r in got)
    for r in got:
        want = viterbi(uni, rows[r.doc_id] or "")
        assert r.n_ids == len(want) and r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        assert r.text_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()


def test_log_scores(uni):
    assert pieces.log_scores([-3.5, -1.25, -0.5]) == [-3.5, -1.25, -0.5]
    zipf = pieces.log_scores([0.0, -2.0, -1.0])
    assert zipf[0] > zipf[2] > zipf[1] and abs(sum(map(math.exp, zipf)) - 1) < 1e-9
    # The likeliest segmentation has few pieces; sums of ranks would take common letters.
    assert len(ids_of(uni, "the international organization")) <= 5


def test_pieces_of_a_long_text_without_spaces(uni):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789日本語é"), 60_000))
    began = time.monotonic()
    got = ids_of(uni, text)
    assert time.monotonic() - began < 10 and len(got) > 10_000
    assert got[:1000] == viterbi(uni, text[:5000])[:1000]
    assert uni.decode(np.array(got)) == text


def test_piece_edges(uni, spark):
    texts = ["", None, " ", "  a  b ", "a\nb\t\0", "日本語 \U0001f600 \u00ad", "▁ marker", "x" * 3000, "ariear", "é́"]
    for t in texts:
        assert ids_of(uni, t or "") == viterbi(uni, t or "")
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    model = queries.tokenizer_path("piece_bpe_32k.model")
    enc = pieces.encode_pieces(df, model)
    back = {r.doc_id: r.text for r in pieces.decode_pieces(enc, model).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    assert all(r.ids == viterbi(uni, texts[r.doc_id] or "") for r in enc.collect())
    odd = spark.createDataFrame([(None, None), (1, [None, 1050, None]), (2, []), (2, [])], "doc_id long, ids array<int>")
    assert sorted((tuple(r) for r in pieces.decode_pieces(odd, model).collect()), key=str) == sorted([(None, ""), (1, uni.decode(np.array([1050]))), (2, ""), (2, "")], key=str)
    with pytest.raises(Exception, match="ids are from 0 to"):
        pieces.decode_pieces(spark.createDataFrame([(1, [40_000])], "doc_id long, ids array<int>"), model).collect()
    assert pieces.encode_pieces(df.limit(0), model).count() == 0


def test_double_array():
    words = [b"a", b"ab", b"abc", b"b", b"ba", bytes([255, 0]), b"zzzz"]
    trie = pieces.DoubleArray(words)

    def find(w):
        state = np.zeros(1, np.int32)
        for b in w:
            state = trie.walk(state, np.array([b], np.uint8))
            if state[0] < 0:
                return -1
        return int(trie.value[state[0]])

    assert [find(w) for w in words] == list(range(len(words)))
    assert find(b"zz") == -1 and find(b"q") == -1 and find(b"abcd") == -1


# --- chats


def chat_want(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        lost = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest())
    return out


def test_chat(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r[0]: tuple(r)[1:5] for r in queries.op10_chat(spark, sf_dir).collect()}
    assert got == chat_want(rows)


def test_chat_edges(spark):
    odd = ["", None, "</s>", "<s>[INST:user]x</s>", "\\l\\b\\", "a]b", "</", "s>", "/e]", "[/INST] <s>", "é\U0001f600\n", "x" * 20_000, "<", "</s"]
    rows = [(c, t, role, text) for c, text in enumerate(odd) for t, role in enumerate(["user", "assistant", "odd]/e</s>role", None])]
    rows += [(None, None, "user", "a"), (None, 1, "assistant", "b"), (99, 1, "assistant", "b"), (99, 1, "assistant", "b"), (99, 1, "assistant", "a"), (100, 0, "user", "</"), (100, 1, "assistant", "s>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = chat.format_chats(df).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("lost", chat.loss_text(F.col("formatted"), F.col("loss"))).collect()
    want = chat_want(rows)
    for r in got:
        assert r.intact
        said = "".join(f"{t.role}\n{t.text}\n" for t in r.turns)
        assert (r.n_turns, hashlib.sha256(said.encode()).hexdigest(), len(r.lost), hashlib.sha256(r.lost.encode()).hexdigest()) == want[r.conv_id]
    assert len(got) == len(want)
    assert chat.format_chats(df.limit(0)).count() == 0
