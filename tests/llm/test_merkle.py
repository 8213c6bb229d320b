"""Merkle manifests against a plain version."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sievewright.llm import merkle, queries

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """The last node over these, and each one's siblings (left, right) level by level."""
    proofs, spots = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, s in zip(proofs, spots):
            a = s // fanout * fanout
            p.append(("".join(nodes[a:s]), "".join(nodes[s + 1 : a + fanout])))
        nodes = [h(*nodes[a : a + fanout]) for a in range(0, len(nodes), fanout)]
        spots = [s // fanout for s in spots]
    return nodes[0], proofs


def want(rows, fanout=16):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        below[g] = climb([leaf(r) for r in groups[g]], fanout)
    root, above = climb([below[g][0] for g in names], fanout)
    out = []
    for g, top in zip(names, above):
        for r, p in zip(groups[g], below[g][1]):
            x = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                x = leaf(r[:4] + ("".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]),))
            for a, b in p + top:
                x = h(a, x, b)
            out.append((r[0], leaf(r), below[g][0], root, h(*(s for side in p + top for s in side)), x, x == root))
    return sorted(out, key=repr)


def query(spark, rows, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return sorted(map(tuple, queries.op11_merkle(spark, path).collect()), key=repr)


def test_smallest_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS).collect()]
    got = queries.op11_merkle(spark, sf_dir)
    assert sorted(map(tuple, got.collect()), key=repr) == want(rows)
    assert 0 < got.filter("not verified").count() < len(rows)


def test_runs_of_every_size_and_odd_rows(spark, tmp_path):
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(300)]
    for n in (1, 2, 16, 17):
        rows += [(1000 * n + i, f"s{n}", None, None, "abc" if i % 2 else "ABC") for i in range(n)]
    # Null and empty sources, sources that sort by bytes, null and repeated ids, null, empty and long texts, whole rows twice.
    rows += [(5, None, "de", 3, None), (6, "", "", 0, ""), (7, "-", "de", 3, "Z" * 100_000), (7, "é", "x", 1, "Éa"), (7, "Z", None, 1, "q"), (7, "z", None, 1, "q")]
    rows += [(None, "hot", None, None, "no id")] * 3 + [(9, "hot", "en", 9, "same id"), (12, "hot", "en", 12, "Text 12")]
    assert query(spark, rows, tmp_path) == want(rows)


@pytest.mark.parametrize("rows", [[], [(3, "a", None, 1, "Alone")], [(None, None, None, None, None)]])
def test_none_and_one(spark, tmp_path, rows):
    assert query(spark, rows, tmp_path) == want(rows) if rows else query(spark, rows, tmp_path) == []


def test_another_shape(spark):
    rows = [(i, "g" if i % 3 else "k", "w" * i) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, part string, body string").withColumn("leaf", F.lit("clash")).withColumn("proof", F.lit(1)).withColumn("grp", F.lit(2))
    got = merkle.manifest(df, ["id", "body"], key="id", group="part", fanout=2)
    assert got.columns == ["id", "part", "leaf", "subroot", "root", "proof"]
    sides = {}
    for g in ("g", "k"):
        sides[g] = climb([leaf((r[0], r[2])) for r in rows if r[1] == g], 2)
    root = h(sides["g"][0], sides["k"][0])
    out = got.withColumn("again", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert len(out) == 40 and all(r.again == r.root == root and r.subroot == sides[r.part][0] for r in out)
