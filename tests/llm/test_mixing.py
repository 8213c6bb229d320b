"""Mixes against exact fractions, and their edge cases."""

from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sievewright.llm import mixing, queries


def shared(sizes, weights=(5, 2, 1), most=3):
    """Targets by source, in fractions, one source stopped at a time."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in stopped]
        if not left:
            return {s: Fraction(most * sizes[s]) for s in names}
        rate = Fraction(total - sum(stopped.values()), sum(w[s] for s in left))
        over = [s for s in left if rate * w[s] > most * sizes[s]]
        if not over:
            return {s: Fraction(stopped[s]) if s in stopped else rate * w[s] for s in names}
        stopped |= {s: most * sizes[s] for s in over}


def check(rows, out, most=3):
    """rows: (id, source, words); out: rows of mix."""
    sizes, largest = Counter(), Counter()
    for _, s, n in rows:
        sizes[s] += n
        largest[s] = max(largest[s], n)
    want = shared(sizes, most=most)
    assert Counter((r.doc_id, r.source, r.size) for r in out) == Counter(rows)
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]), rel=1e-12)
        expected = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert expected - 1 < r.copies < expected + 1 and 0 <= r.copies <= most
        taken[r.source] += r.size * r.copies
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    return taken, want


def frame(spark, rows):
    return spark.createDataFrame([(i, s, None if n is None else "w " * n) for i, s, n in rows], "doc_id long, source string, text string")


def test_smallest_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.source, r.n) for r in docs.select("doc_id", "source", mixing.words(F.col("text")).alias("n")).collect()]
    out = mixing.mix(docs).collect()
    check(rows, out)
    again = queries.op13_mixing(spark, sf_dir).repartition(3).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.size * r.copies) for r in out)


def settled(rows, near=0.001):
    """The greedy rounding of one source in plain Python. rows: (place, size, expected, copies), target: the last."""
    *rows, target = rows
    miss = target - sum(s * c for _, s, _, c in rows)
    left, turned = int(abs(miss)), set()
    if abs(miss) > near * target:
        for place, size, expected, copies in sorted(rows, key=lambda r: (-r[1], r[0])):
            if size and (copies < expected if miss > 0 else copies > expected) and size <= left:
                left -= size
                turned.add(place)
    return turned, 1 if miss > 0 else -1


def test_rounding_the_other_way(spark):
    import random

    rng = random.Random(5)
    groups = {g: [(k, rng.choice([1, 3, 50, 400, 3000]) + rng.randrange(5), e, rng.choice([int(e), int(e) + 1])) for k in range(n)] for g, n, e in (("a", 40, 0.3), ("b", 300, 1.6), ("c", 5, 2.5), ("d", 60, 0.9), ("e", 30, 3.0))}
    groups["e"] = [(k, s, 3.0, 3) for k, s, _, _ in groups["e"]]
    target = {g: sum(s * e for _, s, e, _ in rows) for g, rows in groups.items()}
    df = spark.createDataFrame([(g, k, s, target[g], e, c) for g, rows in groups.items() for k, s, e, c in rows], "grp string, place long, size long, target double, expected double, copies long")
    got = {(r.grp, r.place): r.copies for r in mixing._settle(df.withColumn("expected", F.col("expected").cast(mixing.EXACT)), 0.001).collect()}
    for g, rows in groups.items():
        turned, way = settled([*rows, target[g]])
        assert {k: got[g, k] for k, *_ in rows} == {k: c + (way if k in turned else 0) for k, _, _, c in rows}, g
        if g in "abd":
            assert abs(sum(s * got[g, k] for k, s, _, _ in rows) - target[g]) < 0.01 * target[g]


def test_stops_ties_and_odd_rows(spark):
    rows = [(i, "big", 7 + i % 90) for i in range(1500)] + [(i, "a", 1 + i % 5) for i in range(30)] + [(i, "b", 3) for i in range(40)]
    rows += [(i, "é", 50) for i in range(20)] + [(1, "Z", 900), (2, "Z", 1), (5, None, 11), (6, None, 12), (None, None, 4), (None, None, 4), (8, "", 3)]
    rows += [(9, "none", 0), (10, "none", 0), (7, "big", 5), (7, "big", 5)]
    df = frame(spark, rows).withColumn("copies", F.lit("clash")).withColumn("_part", F.lit(1)).withColumn("target", F.lit(1))
    taken, want = check(rows, mixing.mix(df).collect())
    assert any(want[s] == 3 * sum(n for _, x, n in rows if x == s) > 0 for s in want) and want["none"] == 0
    # A source of many rows comes as near as is asked for.
    assert abs(taken["big"] - want["big"]) <= 0.001 * want["big"]
    empty = frame(spark, [(1, "a", None), (2, None, 0)])
    assert [(r.size, r.target, r.copies) for r in mixing.mix(empty).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mix(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, keep=["target"])


def test_reruns_agree_however_rows_are_dealt(spark):
    df = frame(spark, [(i % 400, f"s{i % 7}", i * i % 97) for i in range(3000)]).withColumn("note", F.concat(F.lit("n"), "doc_id"))
    first = Counter(map(tuple, mixing.mix(df, keep=["note"]).collect()))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert Counter(map(tuple, mixing.mix(df.repartition(5, "text"), keep=["note"]).collect())) == first
        assert Counter(map(tuple, mixing.mix(df, seed=2, keep=["note"]).collect())) != first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    mixed = mixing.mix(df, keep=["note"])
    out = defaultdict(int)
    for r in mixing.emit(mixed).collect():
        out[r.source] += r.size
        assert 1 <= r["copy"] <= r.copies and r.note == f"n{r.doc_id}"
    assert out == {s: n for s, n in _taken(mixed.collect()).items() if n}


def _taken(rows):
    out = Counter()
    for r in rows:
        out[r.source] += r.size * r.copies
    return dict(out)


def test_targets_of_many_sources(spark):
    sizes = {f"s{k:03d}": (k * 7919) % 1000 + (k % 3 == 0) * 50_000 for k in range(200)} | {None: 5}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = shared(sizes)
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == {s: pytest.approx(float(v), rel=1e-12) for s, v in want.items()}
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))
