"""Merkle manifests of a dataset: leaves by row, trees by group, a root over the groups, proofs for every row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import numbered
from ..storage import stored

#: Children of a node.
FANOUT = 16


def encode(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value; so no two lists of fields join to the same text."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts joined."""
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(*fields: Column) -> Column:
    """The leaf of a row with these fields, in this order."""
    return digest(*map(encode, fields))


@dataclass
class Tree:
    """Trees of all groups, level by level.

    runs[k]: (grp, run, children), a row for each run of up to `fanout` nodes of level k; a child has `hash`, on level 0
    also `rest`, what its leaf brought along. tops: (grp, level, hash, rest), the node that each group ends in.
    """

    fanout: int
    tops: DataFrame
    runs: list[DataFrame]


def _joined(children: Column) -> Column:
    return F.array_join(F.transform(children, lambda c: c["hash"]), "")


def build(leaves: DataFrame, order: Sequence[Column], fanout: int = FANOUT) -> Tree:
    """Trees over leaves (grp, hash, rest, and what `order` names), each group's ascending by `order`; grp isn't null.

    Leaves are numbered by ranges of (grp, order), so a group of any size fills many tasks. A level is one aggregation:
    the number divided by the fanout names the run, its children come as an array sorted by number, and their joined
    hashes make the parent. Every run becomes a parent, the last too, though it may have one child only, until its group
    has one node left. Levels shrink by the fanout and each is written, so a lost executor costs its tasks only.
    """
    numbers = numbered(leaves, "idx", order, by=["grp"], total="n")
    nodes, tops, runs = stored(numbers.select("grp", "idx", "n", "hash", "rest"), "leaves"), None, []
    while True:
        own = [c for c in ("hash", "rest") if c in nodes.columns]
        top = nodes.filter("n = 1").select("grp", F.lit(len(runs)).alias("level"), *own)
        tops = top if tops is None else tops.unionByName(top, allowMissingColumns=True)
        grouped = nodes.filter("n > 1").groupBy("grp", F.floor(F.col("idx") / fanout).alias("run"))
        made = grouped.agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", *own))).alias("children"))
        made = made.withColumn("children", F.transform("children", lambda c: F.struct(*(c[x].alias(x) for x in own))))
        made = stored(made, "runs")
        if made.isEmpty():
            return Tree(fanout, stored(tops, "tops"), runs)
        runs.append(made.drop("n"))
        parent = digest(_joined(F.col("children"))).alias("hash")
        nodes = made.select("grp", F.col("run").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), parent)


def _step(k: Column) -> Column:
    """Hashes of the siblings on the left and on the right of child k."""
    left, right = F.slice("children", F.lit(1), k), F.slice("children", k + 2, F.size("children"))
    return F.struct(_joined(left).alias("left"), _joined(right).alias("right"))


def paths(tree: Tree, above: DataFrame) -> DataFrame:
    """(grp, hash, rest, proof, and what else above has) of each leaf.

    proof is an array of (left, right): the joined hashes of the siblings on either side, level by level, and behind
    them the group's own path, which `above` (grp, proof, ...) gives. Downwards, a level is a join of its runs with
    their parents' paths. A path is written once for each run of leaves; it meets the leaves in the returned rows only.
    """
    keep = [c for c in above.columns if c not in ("grp", "proof")]
    tops, nodes = tree.tops.join(above, "grp"), None
    for level in range(len(tree.runs), -1, -1):
        own = ["hash", "rest"] if level == 0 else ["hash"]
        here = tops.filter(F.col("level") == level).select("grp", F.lit(0).cast("long").alias("idx"), *own, "proof", *keep)
        if nodes is not None:
            runs = tree.runs[level].join(nodes.drop("hash").withColumnRenamed("idx", "run"), ["grp", "run"])
            each = runs.select("grp", "run", "proof", *keep, "children", F.posexplode("children").alias("k", "c"))
            proof = F.concat(F.array(_step(F.col("k"))), "proof").alias("proof")
            each = each.select("grp", (F.col("run") * tree.fanout + F.col("k")).alias("idx"), *(f"c.{x}" for x in own), proof, *keep)
            here = each.unionByName(here)
        nodes = stored(here, "paths") if level else here.drop("idx")
    return nodes


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(proof, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def proof_digest(proof: Column) -> Column:
    """H of a path's siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(df: DataFrame, columns: Sequence[str], key: str = "doc_id", group: str = "source", fanout: int = FANOUT, carry: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of df: (key, group, leaf, subroot, root, proof, and `carry`).

    A leaf is the hash of the row's `columns`. Each group's leaves ascend by key and are a tree of their own, whose last
    node is the subroot; the subroots, by the group's UTF-8 bytes, are the leaves of the tree over the groups, whose last
    node is the root. fold(leaf, proof) is the root where nothing was changed. carry: further expressions over df that
    come along by name.

    Null groups are one group, the first; null keys come first in theirs; rows of an equal key come in the order of their
    leaves, and repeated rows are leaves of their own. A null value differs from an empty one. A group of one row is its
    own subroot, a single group's subroot is the root. An empty table gives no rows and no root. Columns that aren't
    named are not read, so their names can't clash. Texts of any length are hashed whole, in the scan; from there on
    only keys and hashes travel.
    """
    carry = carry or {}
    name, own = F.col(f"`{group}`").cast("string"), F.col(f"`{key}`").alias("key")
    rest = F.struct(own, name.alias("group"), *(v.alias(k) for k, v in carry.items()))
    # The salt is written with the leaf, so rows that are equal otherwise are dealt alike however often they are read.
    leaves = df.select(F.coalesce(F.concat(F.lit("+"), name), F.lit("")).alias("grp"), leaf_hash(*(F.col(f"`{c}`") for c in columns)).alias("hash"), rest.alias("rest"), F.rand(1).alias("salt"))
    leaves = stored(leaves, "rows")
    tree = build(leaves, [F.col("rest.key").asc_nulls_first(), F.col("hash"), F.col("salt")], fanout)
    groups = tree.tops.select(F.lit("").alias("grp"), "hash", F.struct(F.col("grp").alias("name")).alias("rest"))
    top = build(groups, [F.col("rest.name")], fanout)
    roots = top.tops.select("grp", F.array().cast("array<struct<left:string,right:string>>").alias("proof"), F.col("hash").alias("root"))
    above = paths(top, roots).select(F.col("rest.name").alias("grp"), "proof", F.col("hash").alias("subroot"), "root")
    found = paths(tree, stored(above, "groups"))
    return found.select(F.col("rest.key").alias(key), F.col("rest.group").alias(group), F.col("hash").alias("leaf"), "subroot", "root", "proof", *(F.col(f"rest.{k}").alias(k) for k in carry))
