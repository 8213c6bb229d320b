"""MinHash near-duplicates by tensored banding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored, unused
from .shared import Labels, components, in_units, looked_up, mix, partitions_of, shingle_sets, text_chunks, tidy, whole_groups

#: Each of two collections has SIDE tuples of ROWS minhashes; the SIDE * SIDE tables take a tuple of each as their
#: key. A pair of similarity 0.85 shares a table but for 2 * (1 - 0.85**ROWS)**SIDE = 2e-5.
SIDE, ROWS = 12, 3
N_HASH = 2 * SIDE * ROWS
#: Candidates whose minhashes agree in fewer places are dropped; at similarity 0.85 that loses about 1e-6 of pairs.
AGREE = 0.6
#: Rows of a first tuple that a task holds at once. What is over is dealt out again by both tuples, in parts of this
#: many that meet pairwise.
BUCKET = 20_000
#: Texts and shingles of one part of a group in the exact check.
PART_TEXTS, PART_SHINGLES = 128, 500_000

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 2**31, N_HASH, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _rng.integers(0, 2**32, N_HASH, dtype=np.uint32)[:, None]


def minhashes(shingles: np.ndarray) -> np.ndarray:
    low = np.full(N_HASH, 2**32 - 1, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    for k in range(0, x.shape[1], 2048):
        low = np.minimum(low, (_A * x[:, k : k + 2048] + _B).min(axis=1))
    return low


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _sign(width: int):
    """doc_id, text, text_key -> doc_id, text_key, n_shingles, node (a hash of the shingle set), low (its minhashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, low = [], [], []
            for _, _, data, offs in text_chunks(batch.column(1)):
                for s in shingle_sets(data, offs, width):
                    n.append(len(s))
                    node.append(_node(xxhash.xxh3_128_digest(s.tobytes())) if len(s) else None)
                    low.append(minhashes(s).tobytes() if len(s) else None)
            cols = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(low, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "n_shingles", "node", "low"])
        tidy()

    return run


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tuple of the first collection, with all tuples of the second and a byte of each minhash."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        low = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, 2, SIDE, ROWS)
        h = np.broadcast_to((np.arange(SIDE, dtype=np.uint64) + np.uint64(1))[None, None, :], (n, 2, SIDE))
        for r in range(ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + low[..., r].astype(np.uint64))
        body = np.concatenate([h[:, 1].astype(np.uint32).view(np.uint8).reshape(n, -1), low.reshape(n, -1).astype(np.uint8)], axis=1)
        rows = pa.array([x.tobytes() for x in body], pa.binary())
        for a in range(SIDE):
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0, a].view(np.int64)), batch.column(0), rows], ["key", "node", "body"])


def _split(bodies: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of _tables: the second collection's tuples, and the bytes of the minhashes."""
    body = np.frombuffer(b"".join(bodies.to_pylist()), np.uint8).reshape(len(bodies), -1)
    return np.ascontiguousarray(body[:, : 4 * SIDE]).view(np.uint32), body[:, 4 * SIDE :]


def _bucket_edges(ids: np.ndarray, low: np.ndarray, run: np.ndarray) -> list[np.ndarray]:
    """Edges that connect what agrees in one bucket: each open component against all members."""
    labels, sig, need = Labels(len(run)), low[run], AGREE * low.shape[1]
    for i in range(len(run)):
        if labels.of[i] == i:
            near = np.flatnonzero((sig == sig[i]).sum(axis=1) >= need)
            labels.join(i, near)
            if not labels.of.any():
                break
    # What joined by its label alone has not been compared itself; compare it while components are apart.
    for i in range(len(run)):
        if not labels.of.any():
            break
        near = np.flatnonzero((sig == sig[i]).sum(axis=1) >= need)
        labels.join(i, near)
    c, m = labels.stars()
    return [np.stack([ids[run[c]], ids[run[m]]], axis=1)] if len(m) else []


def _candidates(limit: int):
    """Edges (a, b) within the tables, and rows (a, key, body) of first tuples that more than `limit` texts share."""
    names = ["a", "b", "key", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, more in whole_groups(batches, "key", limit):
            key, ids = t.column("key").to_numpy(), t.column("node").to_numpy()
            if more:
                for part in t.to_batches():
                    yield pa.RecordBatch.from_arrays([part.column("node"), pa.nulls(part.num_rows, pa.int64()), part.column("key"), part.column("body")], names)
                continue
            edges: list[np.ndarray] = []
            twin = np.zeros(len(key), bool)
            twin[1:] = key[1:] == key[:-1]
            twin[:-1] |= twin[1:]
            keep = np.flatnonzero(twin)
            if not len(keep):
                continue
            key, ids = key[keep], ids[keep]
            second, low = _split(t.column("body").take(pa.array(keep)))
            for b in range(SIDE):
                order = np.lexsort((second[:, b], key))
                same = (key[order][1:] == key[order][:-1]) & (second[order, b][1:] == second[order, b][:-1])
                if not same.any():
                    continue
                head = np.flatnonzero(np.concatenate(([True], ~same)))
                size = np.diff(np.append(head, len(order)))
                first = np.repeat(head, size)
                rest = np.flatnonzero(np.concatenate(([False], same)))
                i, j = order[first[rest]], order[rest]
                ok = (low[i] == low[j]).sum(axis=1) >= AGREE * low.shape[1]
                edges.append(np.stack([ids[i[ok]], ids[j[ok]]], axis=1))
                open_ = np.unique(first[rest[~ok]])
                for s in open_:
                    run = order[s : s + size[np.searchsorted(head, s)]]
                    if len(run) > 2:
                        edges += _bucket_edges(ids, low, run)
            found = np.unique(np.concatenate(edges), axis=0) if edges else np.zeros((0, 2), np.int64)
            none = len(found)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary())], names)
        tidy()

    return run


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of crowded first tuples by both tuples: SIDE rows each, with the bytes of the minhashes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        second, low = _split(batch.column(2))
        key, rows = batch.column(1).to_numpy().view(np.uint64), pa.array([x.tobytes() for x in low], pa.binary())
        for b in range(SIDE):
            both = mix(mix(key + np.uint64(b + 1)) ^ second[:, b].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(both.view(np.int64)), batch.column(0), rows], ["key", "node", "low"])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Connecting edges (a, b) of each unit's texts whose minhashes agree."""
    for t in _by_unit(batches):
        ids, low = t.column("node").to_numpy(), np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        part, a, b = (t.column(c).to_numpy() for c in ("part", "part_a", "part_b"))
        labels, right = Labels(len(ids)), part == b
        for i in np.flatnonzero(part == a):
            apart = np.flatnonzero(right & (labels.of != labels.of[i]))
            if len(apart):
                labels.join(i, apart[(low[apart] == low[i]).sum(axis=1) >= AGREE * low.shape[1]])
        c, m = labels.stars()
        yield pa.RecordBatch.from_arrays([pa.array(ids[c]), pa.array(ids[m])], ["a", "b"])


def _by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Each unit of two rows or more; units are of bounded size."""
    for t, _ in whole_groups(batches, "unit", 1 << 40):
        k = t.column("unit").to_numpy()
        cuts = np.append(np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))), len(k))
        for x, y in zip(cuts[:-1], cuts[1:]):
            if y - x > 1:
                yield t.slice(x, y - x).combine_chunks()


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, per_cent: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the components that links (intersection at least per_cent of union) between left and right make.

    known are connected already. Intersections are counted over an inverted index, and only while two components are still apart.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    _, slot = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(slot, kind="stable")
    owners, ptr = owner[order], np.append(0, np.cumsum(np.bincount(slot)))
    at = np.append(0, np.cumsum(size))
    labels = Labels(n, known)
    is_right = np.zeros(n, bool)
    is_right[right] = True
    for i in left:
        apart = is_right & (labels.of != labels.of[i]) & (100 * np.minimum(size, size[i]) >= per_cent * np.maximum(size, size[i]))
        if not apart.any():
            continue
        s = slot[at[i] : at[i + 1]]
        lens = ptr[s + 1] - ptr[s]
        take = np.repeat(ptr[s] - np.append(0, np.cumsum(lens)[:-1]), lens) + np.arange(lens.sum())
        both = np.bincount(owners[take], minlength=n)
        labels.join(i, np.flatnonzero(apart & (100 * both >= per_cent * (size + size[i] - both))))
    c, m = labels.stars()
    if known is not None and len(known):
        new = ~(np.isin(c, known) & np.isin(m, known))
        c, m = c[new], m[new]
    return c, m


def _confirm(width: int, per_cent: int):
    """Confirmed links (a, b) that connect what each unit's parts part_a and part_b link; `done` texts are connected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_unit(batches):
            ids = t.column("node").to_numpy()
            part, a, b = (t.column(c).to_numpy() for c in ("part", "part_a", "part_b"))
            sets = [s for _, _, data, offs in text_chunks(t.column("text")) for s in shingle_sets(data, offs, width)]
            known = np.flatnonzero(t.column("done").to_numpy(zero_copy_only=False))
            # The smaller side asks: links are symmetric.
            left, right = np.flatnonzero(part == a), np.flatnonzero(part == b)
            c, m = linked(sets, *sorted((left, right), key=len), per_cent, known)
            yield pa.RecordBatch.from_arrays([pa.array(ids[c]), pa.array(ids[m])], ["a", "b"])
        tidy()

    return run


def _consensus(key, t):  # hints would be taken for a choice of protocol
    """The commonest value of each minhash of one group."""
    low = np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint32).reshape(t.num_rows, -1)
    most = []
    for column in low.T:
        values, n = np.unique(column, return_counts=True)
        most.append(values[n.argmax()])
    return pa.table({"grp": [key[0].as_py()], "most": [np.array(most, np.uint32).tobytes()]}, pa.schema([("grp", pa.int64()), ("most", pa.binary())]))


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            low, most = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(b.num_rows, -1) for c in ("low", "most"))
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("node"), pa.array((low == most).sum(axis=1).astype(np.int32))], ["grp", "node", "agree"])


def _hubs(crowd: DataFrame) -> DataFrame:
    """(grp, hub) of groups of several parts (crowd: grp, node, low, parts): the text whose minhashes agree most with
    the commonest ones of the group.

    The commonest ones come from about PART_TEXTS / 2 texts of each group; which text is the hub decides how many are
    confirmed at once, not what is found.
    """
    some = crowd.filter(F.pmod(F.xxhash64("node"), F.col("parts") * 2) == 0).select("grp", "low")
    most = some.groupBy("grp").applyInArrow(_consensus, "grp long, most binary")
    close = crowd.select("grp", "node", "low").join(most, "grp").mapInArrow(_agreement, "grp long, node long, agree int")
    hubs = close.groupBy("grp").agg(F.max(F.struct("agree", "node")).alias("m")).select("grp", F.col("m.node").alias("hub"))
    return stored(hubs, "hubs")


def _links(texts: DataFrame, reps: DataFrame, width: int, per_cent: int) -> DataFrame:
    """Confirmed connecting links (a, b) of groups. texts: node, grp, n, parts, text.

    Groups of one part are a unit. In larger ones all texts are first held against a hub; those it links are connected,
    and only the others meet the whole group, part by part. So a crowd of copies of one text takes time in proportion.
    """
    n_parts = partitions_of(texts.sparkSession)
    confirm = lambda units: units.repartition(n_parts, "unit").sortWithinPartitions("unit").mapInArrow(_confirm(width, per_cent), "a long, b long")
    columns = ("unit", "node", "part", "part_a", "part_b", "done", "text")
    zero = [F.lit(0).alias(c) for c in ("part", "part_a", "part_b")]
    links = stored(confirm(texts.filter("parts = 1").select(F.col("grp").alias("unit"), "node", *zero, F.lit(False).alias("done"), "text")), "links")
    big = texts.filter("parts > 1")
    if big.isEmpty():
        return links
    crowd = stored(big.select("grp", "node", "n", "parts").join(reps.select("node", "low"), "node"), "crowd")
    hubs, words = _hubs(crowd), big.select("node", "text")
    own = crowd.select("grp", "node", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("is_hub"))
    own = own.join(hubs.select(F.col("hub").alias("node")), "node", "left_anti").select("grp", "node", "part", "is_hub")
    asks = crowd.join(hubs.select(F.col("hub").alias("node")), "node", "left_semi")
    asks = asks.select("grp", "node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_hub"))
    # The hub stands in a part of its own, -1, in each unit.
    met = own.unionByName(asks).select(F.xxhash64("grp", "part").alias("unit"), "node", F.when(F.col("is_hub"), -1).otherwise(F.col("part")).alias("part"), F.lit(-1).alias("part_a"), F.col("part").alias("part_b"), F.lit(False).alias("done"))
    first = stored(confirm(met.join(words, "node").select(*columns)), "hub-links")
    sure = first.select(F.col("a").alias("node")).union(first.select(F.col("b").alias("node"))).union(hubs.select(F.col("hub").alias("node"))).distinct()
    split = crowd.select("grp", "node", "n").join(sure.withColumn("sure", F.lit(True)), "node", "left")
    split = stored(split.select("grp", "node", "n", F.coalesce("sure", F.lit(False)).alias("done")), "open")
    parts = split.groupBy("grp").agg(_parts(~F.col("done")).alias("parts"), _parts(F.col("done")).alias("done_parts"))
    units = in_units(split, parts, "grp", "node", "done")
    rest = confirm(units.join(words, "node").select(*columns))
    return links.unionByName(first).unionByName(rest)


def _parts(of: Column) -> Column:
    """Parts that a group's texts fill, counting those where `of` holds."""
    texts, shingles = F.count(F.when(of, 1)), F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0))
    return F.ceil(F.greatest(texts / PART_TEXTS, shingles / PART_SHINGLES)).cast("int")


def _judged(docs: DataFrame, id_col: str, text_col: str, width: int, per_cent: int) -> DataFrame:
    """For each row doc_id, text_key, n_shingles, and of its component: component_id and `first`, the least of its rows
    as (no_id, doc_id, text_key)."""
    if per_cent < 70:
        raise ValueError("the tables and the agreement are laid out for similarities of 0.7 and more")
    n_parts = partitions_of(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    signed = stored(docs.mapInArrow(_sign(width), "doc_id long, text_key long, n_shingles long, node long, low binary"), "signed")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    reps = signed.filter("n_shingles > 0").groupBy("node").agg(F.min(row).alias("first"), F.first("low").alias("low"), F.first("n_shingles").alias("n"))
    reps = stored(reps, "sets")
    tables = reps.select("node", "low").mapInArrow(_tables, "key long, node long, body binary")
    cand = tables.repartition(n_parts, "key").sortWithinPartitions("key").mapInArrow(_candidates(BUCKET), "a long, b long, key long, body binary")
    cand = stored(cand, "candidates")
    edges, crowded = cand.filter("body is null").select("a", "b"), cand.filter("body is not null").select(F.col("a").alias("node"), "key", "body")
    if not crowded.isEmpty():
        finer = stored(crowded.mapInArrow(_finer, "key long, node long, low binary"), "crowded-tables")
        units = in_units(finer, finer.groupBy("key").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("parts")), "key", "node")
        more = units.select("unit", "node", "part", "part_a", "part_b", "low").repartition(n_parts, "unit").sortWithinPartitions("unit")
        edges = edges.unionByName(more.mapInArrow(_agreeing, "a long, b long"))
    groups = components(edges, "a", "b").select("node", F.col("component").alias("grp"))
    member = stored(groups.join(reps.select("node", "n", "first"), "node"), "members")
    member = member.join(member.groupBy("grp").agg(_parts(F.lit(True)).alias("parts")), "grp")
    # One text of each set; rows that repeat it, id and all, are one.
    of = member.select("node", "grp", "n", "parts", F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"))
    # Where the members can be looked up, the other texts aren't dealt out at all.
    texts = docs.join(looked_up(stored(of, "wanted")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    texts = stored(texts.groupBy("node", "grp", "n", "parts").agg(F.first("text").alias("text")), "texts")
    found = components(_links(texts, reps, width, per_cent), "a", "b")
    firsts = found.join(reps.select("node", "first"), "node")
    least = firsts.groupBy("component").agg(F.min("first").alias("least"))
    of_set = reps.select("node", "first").join(found.join(least, "component").select("node", "least"), "node", "left")
    # Stored, so that both sides of the next join are dealt out for it, and Spark can split a set that many rows share.
    of_set = stored(of_set.select("node", F.coalesce("least", "first").alias("first")), "verdict-sets")
    out = signed.select("doc_id", "text_key", "n_shingles", "node").join(of_set, "node", "left")
    # A text without words is a component of its own.
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, per_cent: int = 80) -> DataFrame:
    """Near-duplicate groups of whole texts: (doc_id, n_shingles, component_id, kept), a row for each input row.

    Texts link where 100 * intersection >= per_cent * union of their sets of distinct `width`-word shingles;
    component_id is the smallest id reachable. Candidates come from the SIDE * SIDE tables of tensored banding, and
    every link is confirmed on the full sets, held as 64-bit hashes.

    Equal sets are one node from the start, so a group of copies is an aggregation key and never pairs. The tables'
    keys stay in two halves: rows are dealt by the first tuple, the second is matched in the task, which needs SIDE
    rows a text instead of SIDE * SIDE; first tuples that too many texts share are dealt out again by both. Only
    connecting edges leave a task.

    Null and empty texts have an empty set and are a component of their own. A row without an id belongs to its text's
    group; the component is null if no row of it has an id. kept holds for rows whose id is the component, also where
    they are repeated, and for all rows of a component without ids. Rows that repeat an id with another text are told
    apart by their texts. Very long texts are read in whole. Other columns are not read.
    """
    found = _judged(docs, id_col, text_col, width, per_cent)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, one of each group of near_duplicates: that with the smallest id.

    Rows without an id count behind all others, and of rows that repeat an id and a text one stays. Texts without words
    are no copies of each other, and all their rows stay.
    """
    key, no, who = unused(docs, "_text_key", "_dropped", "_who")
    found = stored(_judged(docs, id_col, text_col, width, per_cent).filter("n_shingles > 0"), "verdicts")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    dropped = stored(found.filter(~is_first).select(F.col("doc_id").alias(who), F.col("text_key").alias(no)).distinct(), "dropped")
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(who)) & (F.col(key) == F.col(no))
    left = keyed.join(looked_up(dropped), same, "left_anti")
    if found.filter(is_first).groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty():
        return left.drop(key)
    words = F.coalesce(F.regexp_like(text_col, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    return left.filter(words).dropDuplicates([id_col, key]).unionByName(left.filter(~words)).drop(key)
