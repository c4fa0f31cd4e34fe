"""A Merkle manifest of a dataset: digests of rows, of groups and of the whole, with proofs.

Rows of a group are leaves in the order of a key; runs of ``fanout`` consecutive nodes are
hashed to one until one is left, and the groups' roots are hashed to the dataset's root in
the same way. Every node is labelled with the interval of leaf ranks that it covers, so
parentage is containment: a node's ancestors are the nodes whose intervals contain its
own, and its siblings cover the difference between its parent's interval and its own.

Levels are built in strata of a few levels each. In a stratum the nodes of its lowest
level are bucketed by the ancestor that they will share at its top, so the join on
containment only meets nodes of one bucket, at most BUCKET on the lower side, however
large a group is. Each stratum has one node in BUCKET of the one below, and a row's proof
is the chain of its own path through a stratum and the path of the stratum's top. No task
sees a whole group, also not to number its leaves (``ranking``), and only the largest
group's size reaches the driver, which tells the number of strata.

Everything is DataFrame functions; every stratum is written to the shared folder.

Defined results: in a leaf a null is ``-`` and any other value its length in UTF-8 bytes,
a colon and the value, so no two rows have the same input; a null group is a group of its
own and comes first; rows without a key come first in their group, rows with one key are
in the order of their digests, and identical rows are leaves of their own; a group of one
leaf has that leaf as its root, and a lone node at the end of a level is hashed alone;
texts of any length are hashed whole; an empty table has no leaves, no nodes and no root;
columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysegments.functions.lineage import Scratch, materialise
from paysegments.llm.ranking import group_key, ranked

# Nodes that share a bucket of a stratum, at most.
BUCKET = 64
# The group of the groups' roots, which no group's name equals.
WHOLE = "all"

STEP = "struct<level:int,before:string,after:string>"


@dataclass(frozen=True)
class Manifest:
    """``nodes``: group, level, lo, hi (the covered ranks, hi exclusive) and digest; the tree
    over the groups' roots is the group WHOLE, and other groups are named by ``group_key``.
    ``leaves``: key, the carried columns, leaf, subroot, root and the proof, a list of
    (level, before, after): the digests of the siblings on both sides, level by level."""

    nodes: DataFrame
    leaves: DataFrame


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row."""

    def named(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*[named(v) for v in values])


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, start, lambda now, step: digest(step["before"], now, step["after"]))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def height(n: Column, fanout: int) -> Column:
    """Levels above the leaves of a group of ``n``."""
    powers = [fanout**i for i in range(63) if fanout**i < 1 << 62]
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p < n))


def _next_level(nodes: Column, fanout: int) -> Column:
    last = F.floor((F.size(nodes) - 1) / fanout).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.sha2(F.array_join(F.slice(nodes, i * fanout + 1, F.lit(fanout)), ""), 256)
    )


def _build(members: DataFrame, base: int, levels: int, fanout: int) -> DataFrame:
    """The nodes of a stratum, above its members: group, n, bucket, level, lo, hi, digest, children."""
    # an aggregate's state is its last level, so no level is worked out more than once
    start = F.array(F.struct(F.array().cast("array<string>").alias("below"), F.transform("m", lambda x: x["digest"]).alias("own")))

    def add(built: Column, _: Column) -> Column:
        own = F.element_at(built, -1)["own"]
        return F.concat(built, F.array(F.struct(own.alias("below"), _next_level(own, fanout).alias("own"))))

    steps = F.sequence(F.lit(1), F.least(F.lit(levels), height(F.col("n"), fanout) - base))
    by_level = (
        members.groupBy("group", "bucket")
        .agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("lo", "digest"))).alias("m"))
        .select("group", "bucket", "n", F.posexplode(F.aggregate(steps, start, add)).alias("up", "built"))
        .where("up > 0")
    )
    listed = F.transform(
        F.col("built.own"),
        lambda d, i: F.struct(
            i.cast("long").alias("i"), d.alias("digest"), F.slice(F.col("built.below"), i * fanout + 1, F.lit(fanout)).alias("below")
        ),
    )
    widths = F.array(*[F.lit(fanout ** (base + up)).cast("long") for up in range(levels + 1)])
    width, step = F.get(widths, F.col("up")), F.get(widths, F.col("up") - 1)
    first = F.col("bucket") * fanout ** (base + levels) + F.col("node.i") * width

    def child(d: Column, t: Column) -> Column:
        low = F.col("lo") + t * F.col("step")
        return F.struct(low.alias("lo"), F.least(low + F.col("step"), "n").alias("hi"), d.alias("digest"))

    nodes = by_level.select("group", "n", "bucket", "up", F.explode(listed).alias("node"))
    nodes = nodes.select("*", first.alias("lo"), width.alias("width"), step.alias("step"))
    return nodes.select(
        "group",
        "n",
        "bucket",
        (F.col("up") + base).cast("int").alias("level"),
        "lo",
        F.least(F.col("lo") + F.col("width"), "n").alias("hi"),
        "node.digest",
        F.transform("node.below", child).alias("children"),
    )


def _paths(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """group, bucket, lo and the path of every member through the stratum.

    Ancestors are attached by containment inside the bucket; what the parent covers and
    the ancestor's child with the member does not, are the siblings.
    """
    above = nodes.select("group", "bucket", "level", F.col("lo").alias("from"), F.col("hi").alias("to"), "children")
    contained = (F.col("from") <= F.col("lo")) & (F.col("hi") <= F.col("to"))
    met = members.select("group", "bucket", "lo", "hi").join(above, ["group", "bucket"]).where(contained)

    def side(keep) -> Column:
        return F.array_join(F.transform(F.filter("children", keep), lambda c: c["digest"]), "")

    before = side(lambda c: c["hi"] <= F.col("lo"))
    after = side(lambda c: c["lo"] >= F.col("hi"))
    step = F.struct("level", before.alias("before"), after.alias("after"))
    return met.groupBy("group", "bucket", "lo").agg(F.sort_array(F.collect_list(step)).alias("path"))


def _tree(leaves: DataFrame, fanout: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, roots (group, digest) and paths (group, lo, path) over leaves (group, rank, n, digest).

    The leaves of a group of one have no path.
    """
    levels = 1
    while fanout ** (levels + 1) <= BUCKET:
        levels += 1
    bottom = leaves.select(
        "group", "n", F.lit(0).alias("level"), F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest"
    )
    most = bottom.agg(F.max("n")).first()[0] or 0
    strata, paths = [bottom], []
    base = 0
    while fanout**base < most:
        unfinished = strata[-1].where((F.col("level") == base) & (height(F.col("n"), fanout) > base))
        bucket = F.floor(F.col("lo") / F.lit(fanout ** (base + levels))).cast("long")
        members = unfinished.withColumn("bucket", bucket)
        strata.append(scratch.write(_build(members, base, levels, fanout)))
        paths.append(scratch.write(_paths(members, strata[-1])))
        base += levels
    columns = ["group", "n", "level", "lo", "hi", "digest"]
    nodes = reduce(DataFrame.unionAll, [s.select(columns) for s in strata])
    roots = nodes.where(F.col("level") == height(F.col("n"), fanout)).select("group", "digest")
    whole = None
    for i, path in reversed(list(enumerate(paths))):
        if whole is not None:
            # the bucket's top is a member of the next stratum, at the same first rank
            top = F.col("bucket") * fanout ** ((i + 1) * levels)
            further = whole.select(F.col("group").alias("g"), F.col("lo").alias("top"), F.col("path").alias("further"))
            path = path.join(further, (F.col("group") == F.col("g")) & (top == F.col("top")), "left")
            path = path.withColumn("path", F.concat("path", F.coalesce("further", F.array().cast(f"array<{STEP}>"))))
        whole = path.select("group", "lo", "path")
    if whole is None:
        whole = bottom.where("false").select("group", "lo", F.array().cast(f"array<{STEP}>").alias("path"))
    return nodes, roots, whole


def manifest(
    docs: DataFrame,
    key: str,
    group: str,
    fields: Sequence[str],
    carry: Mapping[str, Column] | None = None,
    fanout: int = 2,
) -> Manifest:
    """The manifest of ``docs``: leaves from ``fields``, by ``group``, in the order of ``key``.

    ``carry`` names columns for ``leaves`` that are worked out along with the digests.
    """
    carry = dict(carry or {})
    none = F.array().cast(f"array<{STEP}>")
    with Scratch(docs.sparkSession) as scratch:
        digests = docs.select(
            F.col(key).alias("key"),
            group_key(F.col(group)).alias("group"),
            leaf([F.col(f) for f in fields]).alias("digest"),
            F.struct(F.lit(0).alias("_"), *[c.alias(name) for name, c in carry.items()]).alias("carried"),
        )
        order = [F.col("key"), F.col("digest")]
        leaves = scratch.write(ranked(scratch.write(digests), "group", order, scratch))
        nodes, roots, paths = _tree(leaves, fanout, scratch)
        roots = scratch.write(roots)
        names = roots.select(F.lit(WHOLE).alias("group"), "digest", F.col("group").alias("name"))
        tops = scratch.write(ranked(names, "group", [F.col("name")], scratch))
        over, root, further = _tree(tops, fanout, scratch)
        placed = tops.join(further.withColumnRenamed("lo", "rank"), ["group", "rank"], "left").join(
            root.withColumnRenamed("digest", "root"), "group"
        )
        subroots = scratch.write(
            placed.select(F.col("name").alias("group"), F.col("digest").alias("subroot"), F.coalesce("path", none).alias("further"), "root")
        )
        proved = leaves.join(paths.withColumnRenamed("lo", "rank"), ["group", "rank"], "left").join(subroots, "group")
        return Manifest(
            materialise(nodes.unionAll(over).drop("n")),
            materialise(
                proved.select(
                    F.col("key").alias(key),
                    *[F.col(f"carried.`{name}`").alias(name) for name in carry],
                    F.col("digest").alias("leaf"),
                    "subroot",
                    "root",
                    F.concat(F.coalesce("path", none), "further").alias("proof"),
                )
            ),
        )
