"""Alignment of two tokenizers against whole-text encoding and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievewright.llm import alignment, queries

A, B = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokens():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in own)}

    def one(text):
        if not text:
            return None
        want = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(raw_a) != want or b"".join(raw_b) != want:
            return None
        spans = []
        for ids, raw in ((ids_a, raw_a), (ids_b, raw_b)):
            at, out = 0, []
            for i, r in zip(ids, raw):
                out.append((i, at, at + len(r)))
                at += len(r)
            spans.append(out)
        return spans

    return one


def want(rows, tokens):
    spans = [(i, tokens(t)) for i, t in rows]
    links, count = [], Counter()
    for _, s in spans:
        met, k = [], 0
        for x, lo, hi in s[0] if s else []:
            while s[1][k][2] <= lo:
                k += 1
            m = k
            while m < len(s[1]) and s[1][m][1] < hi:
                met.append((x, s[1][m][0]))
                m += 1
        links.append(met)
        count.update(set(met))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(n, best.get(x, 0))
    out = []
    for (i, s), met in zip(spans, links):
        if s is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        borders = sorted({x[2] for x in s[0]} & {x[2] for x in s[1]})
        inside = lambda side, lo, hi: ",".join(str(x) for x, _, e in side if lo < e <= hi)
        ends = [{x[2]: k for k, x in enumerate(side)} for side in s]
        groups, at = [], (0, 0)
        for e in borders:
            to = ends[0][e] + 1, ends[1][e] + 1
            groups.append("|".join(",".join(str(x[0]) for x in side[f:t]) for side, f, t in zip(s, at, to)))
            at = to
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((i, len(s[0]), len(s[1]), len(groups), len(met), sum(count[p] == best[p[0]] for p in met), sum(count[p] for p in met), digest))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_smallest_table(spark, sf_dir, tokens):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op12_alignment(spark, sf_dir)) == want(rows, tokens)


ODD = [None, "", " ", "  ", "a ", " a", "\n", "\n ", "x \n\n  y", "x  y", "x　 y", "x  y", "日本語 テスト", "naïve café 🙂 ok", "a▁b", "<s> </s> <0x41> <|endoftext|> <unk>", "don't we'll", "\x00\x7f \x1c x", "a" * 3000, "long and " * 4000, "ß" * 700, "\t\t tab", "é é"]


def test_odd_texts(spark, tokens):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "a "), (3, "a "), (3, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("groups", F.lit(1)).withColumn("n_a", F.lit("x"))
    out = alignment.align(df, A, B)
    assert got(out.drop("groups")) == want(rows, tokens)
    groups = {r.groups for r in out.filter("doc_id = 4").collect()}
    assert len(groups) == 1 and groups.pop().count("|") == out.filter("doc_id = 4").first().n_groups
    assert alignment.align(df.limit(0), A, B).count() == 0
    nothing = alignment.align(df.filter("text is null"), A, B).collect()
    assert [(r.n_a, r.count_sum, r.groups_sha256, r.groups) for r in nothing] == [(0, 0, "", None)]


def test_random_texts_by_units_and_in_whole(tokens):
    random.seed(7)
    letters = list("abcdeé ſ  \n\t'.,!?0123<|>_-AZ") + [" ", "　", " ", " ", "\u0085", "日", "本", "▁", "🙂", "́", "\x00", "\x7f", "'s", "'ll", " don't", "  ", "﻿", "᠎", "​"]
    texts = ["".join(random.choice(letters) for _ in range(random.randint(1, 40))) for _ in range(1500)]
    units = alignment.Units(A, B)
    assert not units.whole and units.fast
    import pyarrow as pa

    at = 0
    for of, first, good in alignment._texts(units, pa.array(texts)):
        for x, y, ok in zip(first[:-1], first[1:], good):
            s = tokens(texts[at])
            assert ok == (s is not None)
            if ok:
                assert units.sizes[of[x:y], :2].sum(axis=0).tolist() == [len(s[0]), len(s[1])]
                ids = [[], []]
                for g in b"".join(units.texts[u] for u in of[x:y]).decode()[:-1].split(";"):
                    for k, part in enumerate(g.split("|")):
                        ids[k] += map(int, part.split(","))
                assert ids == [[t[0] for t in s[0]], [t[0] for t in s[1]]]
            at += 1


def test_whole_texts_as_units(spark, tokens):
    units = alignment.Units(A, B)
    units.whole = True
    import pyarrow as pa

    texts = [t for t in ODD if t]
    sizes = [units.sizes[of[x:y]].sum(axis=0).tolist() for of, first, _ in alignment._texts(units, pa.array(texts)) for x, y in zip(first[:-1], first[1:])]
    expected = want(list(enumerate(texts)), tokens)
    assert sizes == [list(r[1:4]) for r in sorted(expected, key=lambda r: r[0])]


def test_caches_that_start_anew_and_partial_counts(spark, sf_dir, monkeypatch):
    import pyarrow as pa

    texts = pa.array([r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()])
    batch = pa.RecordBatch.from_arrays([texts], ["text"])

    def counted():
        total = Counter()
        for b in alignment._partial(A, B)([batch] * 3):
            total.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
            assert (np.diff(b.column(0).to_numpy()) > 0).all()
        return total

    plain = counted()
    alignment._held.clear()
    monkeypatch.setattr(alignment, "CACHE_UNITS", 50)
    monkeypatch.setattr(alignment, "HELD_PAIRS", 500)
    monkeypatch.setattr(alignment, "MERGED_PAIRS", 400)
    assert counted() == plain and len(plain) > 400


def test_counts_and_partners(spark, sf_dir, tokens):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = alignment.count_pairs(docs, A, B)
    pairs = Counter()
    for (text,) in docs.select("text").collect():
        s = tokens(text)
        if s:
            pairs.update({(x, y) for x, lo, hi in s[0] for y, p, q in s[1] if p < hi and lo < q})
    lookup, most = counts.lookup(), {}
    for (x, _), n in pairs.items():
        most[x] = max(n, most.get(x, 0))
    keys = np.array([x * counts.n_b + y for x, y in pairs] + [3], np.int64)
    n, best = lookup.counts(keys)
    assert n.tolist() == [*pairs.values(), 0] and best[:-1].tolist() == [pairs[p] == most[p[0]] for p in pairs]
    assert {tuple(r) for r in counts.best_partners().collect()} == {(x, y, n) for (x, y), n in pairs.items() if n == most[x]}
    assert len(lookup.shards) > 1
