"""Merkle manifest of a table: one hash for all rows, and a proof for each row.

Rows are the leaves of one tree per group; the trees' roots, in the order of their groups,
are the leaves of the top tree. Every two consecutive nodes of a level become one of the
next, a last single one too. Built levels are stored as parent-linked node rows: a node row
leads ``STRIDE`` levels up and holds the siblings on the way, so that a tree of n leaves is
climbed in log(n) / STRIDE steps. A recursive query lets every leaf climb to the root; it
begins with the leaves' own node rows, so that only the few nodes above them are joined.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.tables import stored

# Levels between a node row and its parent; nodes are built in blocks of 2**STRIDE.
STRIDE = 10
# Leaves that climb through one copy of a node row. A node above more has more copies, so
# that no key of the climb's join has more rows than this.
SALTED = 4096
# Trees are numbered by their groups' order; this one has their roots as leaves.
TOP = -1

_BLOCK = 1 << STRIDE
# Settings of the climb: it has one row per leaf and step, which Spark's default bound would
# refuse, and its rounds are dealt out evenly, so that there is no skew to split.
_CLIMB_CONF = {
    "spark.sql.cteRecursionRowLimit": "-1",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "false",
}

_RESULT = (
    "leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
    "verified boolean"
)


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def framed(values: list[Column]) -> Column:
    """Values one after another, each with its length in bytes; ``-`` for null."""
    texts = [value.cast("string") for value in values]
    parts = [
        F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text), F.lit(":"), text))
        for text in texts
    ]
    return F.concat(*parts)


def _joint(left: str, right: str = "''") -> str:
    """SQL: the hash of two hashes' hex text, one after another."""
    shown = f"hex({right})" if right != "''" else right
    return f"unhex(sha2(lower(concat(hex({left}), coalesce({shown}, ''))), 256))"


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the leaves' node rows, with row, key and start. ``nodes``: the node rows above
    them, None if there are no leaves.
    """

    leaves: DataFrame
    nodes: DataFrame | None


def _numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows with ``row``, a number of their own, and ``pos`` and ``n`` in their group.

    A global sort, then counts by partition and group; no group meets in one task.
    """
    keys = [*group, *order]
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = stored(spread.withColumn("row", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("row", 33).alias("part")
    runs = ordered.groupBy(*group, part).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))
    own = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        *[F.col(name).alias(f"of_{name}") for name in group],
        F.col("part").alias("of_part"),
        "first",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"),
        F.sum("rows").over(own).alias("n"),
    )
    same = F.shiftright("row", 33) == F.col("of_part")
    for name in group:
        same &= F.col(name).eqNullSafe(F.col(f"of_{name}"))
    pos = F.col("row") - F.col("first") + F.col("before")
    return ordered.join(offsets, same).select(*ordered.columns, pos.alias("pos"), "n")


def _step(nodes: DataFrame, step: int, top: bool) -> DataFrame:
    """Node rows of one step from its nodes: tree, pos, n, hash, leaves, row, key, start.

    A block has 2**STRIDE nodes, so its levels fit in one row.
    """
    blocks = nodes.groupBy("tree", F.shiftright("pos", STRIDE).alias("block")).agg(
        F.first("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("pos", "hash", "leaves", "row", "key", "start"))).alias("members"),
        F.sum("leaves").alias("up_leaves"),
    )
    steps = ", ".join(map(str, range(1, STRIDE + 1)))
    height = f"CASE WHEN n > {_BLOCK} THEN {STRIDE} WHEN n = 1 THEN 0 ELSE length(bin(n - 1)) END"
    pair = _joint("get(element_at(acc, -1), 2 * i)", "get(element_at(acc, -1), 2 * i + 1)")
    upper = f"transform(sequence(0, (size(element_at(acc, -1)) + 1) div 2 - 1), i -> {pair})"
    siblings = (
        f"transform(slice(levels, 1, {height}), (level, l) -> "
        "get(level, cast(shiftright(i, l) ^ 1 AS INT)))"
    )
    # One expression, so that the levels are made once for all members.
    linked = (
        f"aggregate(slice(array({steps}), 1, {height}), array(members.hash), "
        f"(acc, l) -> concat(acc, array({upper})), levels -> transform(members, (m, i) -> "
        "struct(m.pos, m.leaves, m.row, m.key, m.hash, m.start, "
        f"get(element_at(levels, -1), 0) AS up_hash, {siblings} AS siblings)))"
    )
    done = F.col("n") <= _BLOCK
    up_leaves = F.col("up_leaves")
    return (
        blocks.select("tree", "block", "n", "up_leaves", F.explode(F.expr(linked)).alias("member"))
        .withColumn("salts", _salts(F.col("member.leaves")))
        .select(
            "tree",
            F.lit(step).alias("step"),
            F.col("member.pos").alias("pos"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"),
            "n",
            *[f"member.{name}" for name in ("row", "key", "hash", "start", "siblings", "up_hash")],
            "up_leaves",
            F.when(~done, F.col("tree")).when(F.lit(not top), F.lit(TOP)).cast("long").alias("up_tree"),
            F.when(done, 0).otherwise(step + 1).alias("up_step"),
            F.when(done, F.col("tree")).otherwise(F.col("block")).alias("up_pos"),
            _salts(up_leaves).alias("up_salts"),
        )
    )


def _salts(leaves: Column) -> Column:
    return F.ceil(leaves / SALTED).cast("long")


def _forest(nodes: DataFrame, most: int, top: bool) -> tuple[list[DataFrame], DataFrame]:
    """Stored node rows of all steps, and the trees' roots: tree, hash, leaves."""
    found, roots, step = [], [], 0
    carried = [(f.name, f.dataType) for f in nodes.schema.fields if f.name in ("row", "key", "start")]
    while True:
        rows = stored(_step(nodes, step, top), f"merkle-step-{step}")
        found.append(rows)
        # One row of each block tells its parent.
        firsts = rows.filter((F.col("pos") % _BLOCK == 0) & (F.col("salt") == 0))
        parents = firsts.select(
            "tree",
            F.col("up_pos").alias("pos"),
            F.expr(f"(n + {_BLOCK - 1}) div {_BLOCK}").alias("n"),
            F.col("up_hash").alias("hash"),
            F.col("up_leaves").alias("leaves"),
            *[F.lit(None).cast(kind).alias(name) for name, kind in carried],
        )
        roots.append(parents.filter(firsts["n"] <= _BLOCK))
        if most <= _BLOCK:
            return found, reduce(DataFrame.unionAll, roots)
        nodes, most, step = parents.filter(firsts["n"] > _BLOCK), -(-most // _BLOCK), step + 1


def build(
    docs: DataFrame,
    leaf: Column,
    start: Column,
    group: str = "lang",
    order: str = "doc_id",
) -> Manifest:
    """The manifest of all rows; ``leaf`` and ``start`` are hashes as 32 bytes.

    ``start`` is the hash to climb with, null where that is the leaf itself. Groups ascend,
    null first, and so do rows in a group by ``order``, then by leaf. Repeated rows are
    leaves of their own. An empty table has no nodes.
    """
    rows = docs.select(
        F.col(f"`{order}`").alias("key"),
        F.col(f"`{group}`").alias("kind"),
        leaf.alias("leaf"),
        start.alias("start"),
        F.monotonically_increasing_id().alias("seq"),
    )
    ordered = _numbered(stored(rows, "merkle-leaves"), ["kind"], ["key", "leaf", "seq"])
    kinds = ordered.groupBy("kind").agg(F.max("n").alias("size"))
    trees = stored(_numbered(kinds, [], ["kind"]), "merkle-trees")
    counts = trees.agg(F.max("size").alias("largest"), F.max("n").alias("trees")).first()
    joined = ordered.join(
        trees.select(F.col("kind").alias("of_kind"), F.col("pos").alias("tree")),
        F.col("kind").eqNullSafe(F.col("of_kind")),
    )
    one = F.lit(1).cast("long").alias("leaves")
    leaves = joined.select("tree", "pos", "n", F.col("leaf").alias("hash"), one, "row", "key", "start")
    if counts.trees is None:
        return Manifest(leaves, None)
    below, roots = _forest(leaves, counts.largest, False)
    tops = roots.select(
        F.lit(TOP).cast("long").alias("tree"),
        F.col("tree").alias("pos"),
        F.lit(counts.trees).cast("long").alias("n"),
        "hash",
        "leaves",
        "row",
        "key",
        "start",
    )
    above, _ = _forest(tops, counts.trees, True)
    return Manifest(below[0], reduce(DataFrame.unionAll, [*below[1:], *above]))


def _climb_sql(leaves: str, nodes: str) -> str:
    def fold(pos: str, folded: str) -> str:
        return (
            f"aggregate(transform(n.siblings, (hash, l) -> struct(hash, l)), {folded}, (h, x) -> "
            f"CASE WHEN x.hash IS NULL THEN {_joint('h')} "
            f"WHEN shiftright({pos}, x.l) & 1 = 0 THEN {_joint('h', 'x.hash')} "
            f"ELSE {_joint('x.hash', 'h')} END)"
        )

    def proof(begun: str) -> str:
        return f"aggregate(filter(n.siblings, s -> s IS NOT NULL), {begun}, (p, s) -> concat(p, s))"

    subroot = f"CASE WHEN n.up_tree = {TOP} THEN n.up_hash END"
    return f"""
    WITH RECURSIVE climb(row, tree, step, pos, salts, folded, proof, subroot)
      MAX RECURSION LEVEL 100 AS (
        SELECT n.row, n.up_tree, n.up_step, n.up_pos, n.up_salts,
          {fold("n.pos", "coalesce(n.start, n.hash)")}, {proof("CAST('' AS BINARY)")}, {subroot}
        FROM {leaves} n
      UNION ALL
        SELECT c.row, n.up_tree, n.up_step, n.up_pos, n.up_salts,
          {fold("c.pos", "c.folded")}, {proof("c.proof")}, coalesce(c.subroot, {subroot})
        FROM climb c JOIN {nodes} n
          ON c.tree = n.tree AND c.step = n.step AND c.pos = n.pos
            AND pmod(c.row, c.salts) = n.salt
      )
    SELECT row, folded, sha2(lower(hex(proof)), 256) AS proof_sha256, subroot
    FROM climb WHERE tree IS NULL
    """


def proofs(manifest: Manifest) -> DataFrame:
    """Per leaf: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    Each climb appends the siblings on its way and folds its start into the root that this
    start would give; it is verified if that is the manifest's root.
    """
    leaves, nodes = manifest.leaves, manifest.nodes
    spark = leaves.sparkSession
    if nodes is None:
        key = leaves.schema["key"].dataType.simpleString()
        return spark.createDataFrame([], f"key {key}, {_RESULT}")
    mark = uuid.uuid4().hex
    names = [f"merkle_{kind}_{mark}" for kind in ("leaves", "nodes")]
    leaves.createOrReplaceTempView(names[0])
    nodes.createOrReplaceTempView(names[1])
    before = {key: spark.conf.get(key) for key in _CLIMB_CONF}
    try:
        for key, value in _CLIMB_CONF.items():
            spark.conf.set(key, value)
        climbed = stored(spark.sql(_climb_sql(*names)), "merkle-climbs")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
        for name in names:
            spark.catalog.dropTempView(name)
    top = nodes.filter(F.col("up_tree").isNull()).select(F.col("up_hash").alias("root")).limit(1)
    shown = lambda name: F.lower(F.hex(name))
    return (
        leaves.select("row", "key", F.col("hash").alias("leaf"))
        .join(climbed, "row")
        .crossJoin(F.broadcast(top))
        .select(
            "key",
            shown("leaf").alias("leaf"),
            shown("subroot").alias("subroot"),
            shown("root").alias("root"),
            "proof_sha256",
            shown("folded").alias("folded_root"),
            (F.col("folded") == F.col("root")).alias("verified"),
        )
    )


def op13_merkle_manifest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Nulls in any column are ``-`` in the leaf; a null doc_id comes first in its language and
    is not tampered with, nor is a null n_chars. Repeated rows are leaves of their own, equal
    ones in any order. An empty table gives no rows.
    """
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = docs.select(*fields)
    columns = {name: F.col(name) for name in fields}
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    start = F.when(chosen, digest(framed([*(columns | {"n_chars": more}).values()])))
    manifest = build(docs, digest(framed([*columns.values()])), start)
    return proofs(manifest).withColumnRenamed("key", "doc_id")
