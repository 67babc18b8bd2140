"""Merkle manifest of a dataset with a witness for every row.

Leaves of a group stand in order of their id. They are cut into aligned blocks
of 2^BITS, each a whole subtree. A task appends a block's leaves one by one: a
leaf begins a subtree with an empty witness, and when a subtree's sibling is
complete, the two become one and the witness of every leaf in them grows by the
other's digest. What is appended so far is only a row of open subtrees. The
blocks' roots are further appends to the tree above, in blocks again, until a
group is one root; the groups' roots are appended in the same way. Witnesses of
upper trees then come down to the blocks, which extend those of their leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, importable, saved, slices

#: A block is a subtree of this height.
BITS = 10
#: The digest of a run: sha256 over the digests as hexadecimal text.
WITNESS = "array<struct<left: string, right: string>>"
_PAIR = pa.struct([("left", pa.string()), ("right", pa.string())])


def field(c: Column) -> Column:
    """A value with its length in bytes before it; ``-`` for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def fold(node: Column, witness: Column) -> Column:
    """The root that a leaf and a witness lead to."""
    return F.aggregate(witness, node, lambda h, w: F.sha2(F.concat(w["left"], h, w["right"]), 256))


def proof_digest(witness: Column) -> Column:
    """sha256 over all siblings of a witness from the leaf's level upwards."""
    return F.sha2(F.concat_ws("", F.transform(witness, lambda w: F.concat(w["left"], w["right"]))), 256)


def _join(*hexes: str) -> str:
    return sha256("".join(hexes).encode()).hexdigest()


class Frontier:
    """A tree that grows by appends: its open subtrees, and what each leaf's witness holds so far."""

    def __init__(self):
        self.open: list[tuple[int, str, int]] = []  # height, digest and first leaf, higher ones first
        self.witness: list[list[tuple[str, str]]] = []

    def _meet(self, left: tuple[int, str, int], right: tuple[int, str, int]) -> tuple[int, str, int]:
        height, digest, first = left
        _, other, middle = right
        for w in self.witness[first:middle]:
            w.append(("", other))
        for w in self.witness[middle:]:
            w.append((digest, ""))
        return height + 1, _join(digest, other), first

    def append(self, digest: str) -> None:
        tree = (0, digest, len(self.witness))
        self.witness.append([])
        while self.open and self.open[-1][0] == tree[0]:
            tree = self._meet(self.open.pop(), tree)
        self.open.append(tree)

    def close(self, height: int | None = None) -> str:
        """The root; with a ``height``, as a subtree of that height. A last run of one node is its own digest's digest."""
        tree = self.open.pop()
        while self.open or (height is not None and tree[0] < height):
            if self.open and self.open[-1][0] == tree[0]:
                tree = self._meet(self.open.pop(), tree)
            else:
                for w in self.witness[tree[2] :]:
                    w.append(("", ""))
                tree = (tree[0] + 1, _join(tree[1]), tree[2])
        self.open.append(tree)
        return tree[1]


def _grow(nodes: bytes, count: int, bits: int) -> tuple[Frontier, str]:
    """A block's tree from its digests; ``count``: nodes of the whole group on this level."""
    tree = Frontier()
    text = nodes.hex()
    for at in range(0, len(text), 64):
        tree.append(text[at : at + 64])
    return tree, tree.close(bits if count > 1 << bits else None)


def _packed(nodes: DataFrame, bits: int) -> DataFrame:
    """(g, block, count, ids, nodes, bad, root): one row a block of nodes (g, pos, count, node, id, bad)."""
    kind = nodes.schema["id"].dataType.simpleString()
    src = nodes.select("g", F.shiftright("pos", bits).alias("block"), "pos", "count", "node", "id", "bad")
    src = src.repartition("g", "block").sortWithinPartitions("g", "block", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            count, digests = t["count"][0].as_py(), b"".join(t["node"].to_pylist())
            one = lambda c: pa.array([c.to_pylist()], pa.list_(c.type))
            return pa.RecordBatch.from_arrays(
                [t["g"].chunk(0)[:1], t["block"].chunk(0)[:1], pa.array([count], pa.int64()), one(t["id"]), pa.array([digests], pa.binary()), one(t["bad"]), pa.array([bytes.fromhex(_grow(digests, count, bits)[1])], pa.binary())],
                names=["g", "block", "count", "ids", "nodes", "bad", "root"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            # a block begins where its number changes, or where its nodes start anew in another group
            n, pos = (b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            cuts = [0, *(np.flatnonzero((np.diff(n) != 0) | (np.diff(pos) <= 0)) + 1).tolist(), len(n)]
            if held and (held[-1].column(1)[-1].as_py() != int(n[0]) or held[-1].column(2)[-1].as_py() >= int(pos[0])):
                yield block()
                held = []
            for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
                if k:
                    yield block()
                    held = []
                held.append(b.slice(a, z - a))
        if held:
            yield block()

    return src.mapInArrow(run, f"g string, block long, count long, ids array<{kind}>, nodes binary, bad array<binary>, root binary")


def _opened(blocks: DataFrame, bits: int) -> DataFrame:
    """(g, pos, id, node, bad, witness, subroot) of every node of blocks with their own witness ``above`` and ``subroot``."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            block, count, nodes = (b.column(c)[0].as_py() for c in (1, 2, 4))
            above = [(w["left"], w["right"]) for w in b.column(6)[0].as_py()]
            tree, _ = _grow(nodes, count, bits)
            n = len(tree.witness)
            left, right = zip(*(w for own in tree.witness for w in (*own, *above))) if tree.witness[0] or above else ((), ())
            ends = np.cumsum([0] + [len(own) + len(above) for own in tree.witness]).astype(np.int32)
            witness = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], fields=list(_PAIR)))
            same = lambda c: b.column(c).take(pa.array(np.zeros(n, np.int64)))
            pos = pa.array(np.arange(n, dtype=np.int64) + (block << bits))
            node = pa.array([nodes[k : k + 32] for k in range(0, len(nodes), 32)], pa.binary())
            yield pa.RecordBatch.from_arrays([same(0), pos, b.column(3).flatten(), node, b.column(5).flatten(), witness, same(7)], names=["g", "pos", "id", "node", "bad", "witness", "subroot"])

    src = blocks.select("g", "block", "count", "ids", "nodes", "bad", "above", "subroot")
    return src.mapInArrow(run, f"g string, pos long, id {kind}, node binary, bad binary, witness {WITNESS}, subroot string")


def _climbed(nodes: DataFrame, name: str, bits: int) -> tuple[DataFrame, DataFrame]:
    """A level's packed blocks, and (g, block, above, subroot) of each: its root's witness in the tree above, up to the group's root."""
    blocks = saved(_packed(nodes, bits), f"merkle-{name}")
    own = blocks.select("g", F.col("block").alias("pos"), F.ceil(F.col("count") / (1 << bits)).alias("count"), F.col("root").alias("node"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("bad"))
    if own.filter("count > 1").isEmpty():
        return blocks, own.select("g", F.col("pos").alias("block"), F.array().cast(WITNESS).alias("above"), F.lower(F.hex("node")).alias("subroot"))
    upper, above = _climbed(own, name, bits)
    up = saved(_opened(_with_above(upper, above), bits).select("g", F.col("pos").alias("block"), F.col("witness").alias("above"), "subroot"), f"merkle-{name}-above")
    drop(upper)
    return blocks, up


def _with_above(blocks: DataFrame, above: DataFrame) -> DataFrame:
    a = above.withColumnsRenamed({"g": "_g", "block": "_block"})
    return blocks.join(a, F.col("g").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_block"))).drop("_g", "_block")


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``pos`` from 0 in their group ``g`` and the group's ``count``: a distributed sort, then the counts of its parts are added up."""
    # rows alike in all sort keys have one digest, so that any order of them gives the same tree
    s = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())).orderBy("g", *order, "_salt").drop("_salt").withColumn("_at", F.monotonically_increasing_id())
    s = saved(s.withColumn("_p", F.shiftright("_at", 33)), "merkle-sorted")
    parts = s.groupBy(F.col("_p").alias("_part"), F.col("g").alias("_g")).agg(F.count("*").alias("n"), F.min("_at").alias("_first"))  # a row a group and part
    w = Window.partitionBy("_g")
    parts = parts.select("_part", "_g", "_first", (F.sum("n").over(w.orderBy("_part")) - F.col("n")).alias("_before"), F.sum("n").over(w).alias("count"))
    out = s.join(parts, (F.col("_p") == F.col("_part")) & F.col("g").eqNullSafe(F.col("_g")))
    out = out.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).select(*rows.columns, "pos", "count")
    out._sorted = s
    return out


def manifest(docs: DataFrame, columns: tuple[str, ...], id_col: str = "doc_id", group_col: str = "lang", changed: dict[str, Column] | None = None, bits: int = BITS) -> DataFrame:
    """Leaf, group root, root and witness of every row: id, leaf, changed_leaf, subroot, root, witness.

    A leaf is the digest of ``columns``, each ``-`` if null, else its length in
    bytes, a colon and its value. Leaves of a group ascend by id (null first),
    then by leaf; while several nodes remain, each two consecutive ones (a last
    one alone) become their digest. Groups, null first and then bytewise, give
    the root in the same way. ``witness`` lists, from the leaf upwards, what
    stands left and right of the node in its run (both empty if it is alone).
    ``changed_leaf`` is the leaf with the values of ``changed`` in place of the
    columns', null where it is the same. ``bits`` is the height of a block.

    Null and empty texts, rows without an id or a group, and rows that repeat are
    leaves like all others; texts of any length are hashed whole; columns not
    named are ignored; an empty table gives an empty result.
    """
    importable(docs.sparkSession)
    own = leaf(*map(F.col, columns))
    bad = leaf(*((changed or {}).get(c, F.col(c)) for c in columns))
    rows = docs.select(F.col(group_col).cast("string").alias("g"), F.col(id_col).alias("id"), F.unhex(own).alias("node"), F.unhex(bad).alias("bad"))
    rows = saved(rows.withColumn("bad", F.when(F.col("bad") != F.col("node"), F.col("bad"))), "merkle-leaves")
    placed = _placed(rows, "id", "node", "bad")
    blocks, above = _climbed(placed, "blocks", bits)
    drop(rows, placed._sorted)

    # groups' roots are appends of one more tree
    tops = saved(above.filter("block = 0").select(F.lit("").alias("g"), F.col("g").alias("id"), F.unhex("subroot").alias("node"), F.lit(None).cast("binary").alias("bad")), "merkle-groups")
    placed = _placed(tops, "id")
    roots = _opened(_with_above(*_climbed(placed, "roots", bits)), bits).select(F.col("id").alias("_g"), F.col("witness").alias("_top"), F.col("subroot").alias("root"))
    up = above.join(roots, F.col("g").eqNullSafe(F.col("_g"))).select("g", "block", F.concat("above", "_top").alias("above"), F.to_json(F.struct("subroot", "root")).alias("subroot"))
    out = _opened(_with_above(blocks, saved(up, "merkle-above")), bits)
    ends = F.from_json("subroot", "subroot string, root string")
    return out.select(F.col("id").alias(id_col), F.lower(F.hex("node")).alias("leaf"), F.lower(F.hex("bad")).alias("changed_leaf"), ends["subroot"].alias("subroot"), ends["root"].alias("root"), "witness")


def oracle_sql(depth: int = 24) -> str:
    """The query's rows in DuckDB, for at most 2^depth leaves a group and 2^8 groups."""
    f = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    hashed = lambda n: "sha256(" + " || ".join(f(x) for x in ("doc_id", "source", "lang", n, "text")) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))), lambda c, b: xor(c >> 8, step[CAST((xor(c, b) & 255) + 1 AS INT)])), 4294967295)"

    def climb(first: str, levels: int, key: str) -> str:
        """CTEs {first}0 .. of (key, pos, n, h), each level from the one before it."""
        out = []
        for k in range(levels):
            a, b = f"{first}{k}", f"{first}{k + 1}"
            out.append(f"{b} AS (SELECT {key}, pos // 2 AS pos, CAST(ceil(any_value(n) / 2.0) AS BIGINT) AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {a} GROUP BY {key}, pos // 2)")
        return ",\n".join(out)

    def rise(first: str, levels: int, on: str) -> str:
        """Joins of a row with its siblings at each level: of ``at`` under ``on``."""
        return "\n".join(f"LEFT JOIN {first}{k} {first}s{k} ON {on.format(x=f'{first}s{k}')} AND {first}s{k}.pos = xor(r.{first}pos >> {k}, 1)" for k in range(levels))

    # folding is a row a level: as a chain of CTEs, so that texts of expressions do not nest
    steps, last = [], "j"
    for first, levels in (("l", depth), ("g", 8)):
        for k in range(levels):
            at, sib = f"({first}pos >> {k})", f"coalesce({first}s{k}, '')"
            steps.append(f"{first}f{k} AS (SELECT * REPLACE (CASE WHEN ceil({first}n / {2.0**k}) <= 1 THEN x ELSE sha256(CASE WHEN {at} % 2 = 1 THEN {sib} ELSE '' END || x || CASE WHEN {at} % 2 = 0 THEN {sib} ELSE '' END) END AS x) FROM {last})")
            last = f"{first}f{k}"
    sibs = ", ".join(f"{first}s{k}.h AS {first}s{k}" for first, levels in (("l", depth), ("g", 8)) for k in range(levels))
    proof = " || ".join(f"coalesce({first}s{k}, '')" for first, levels in (("l", depth), ("g", 8)) for k in range(levels))
    return f"""
WITH t AS (SELECT list(list_reduce(list_prepend(i, [CAST(0 AS BIGINT) FOR x IN range(8)]), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS step FROM range(256) r(i)),
d AS (SELECT doc_id, lang, {hashed('n_chars')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 7 = 0 THEN {hashed('n_chars + 1')} ELSE {hashed('n_chars')} END AS bad FROM documents, t),
r0 AS (SELECT *, coalesce(lang, '') AS k1, lang IS NULL AS k2, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS lpos, count(*) OVER (PARTITION BY lang) AS ln FROM d),
l0 AS (SELECT k1, k2, lpos AS pos, ln AS n, leaf AS h FROM r0),
{climb('l', depth, 'k1, k2')},
g0 AS (SELECT 1 AS one, k1, k2, row_number() OVER (ORDER BY NOT k2, encode(k1)) - 1 AS pos, count(*) OVER () AS n, h FROM l{depth}),
{climb('g', 8, 'one').replace('any_value(h)', 'min(h)')},
r AS (SELECT r0.*, g0.pos AS gpos, g0.n AS gn, g0.h AS subroot FROM r0 JOIN g0 USING (k1, k2)),
j AS (SELECT r.doc_id, r.leaf, r.subroot, r.lpos, r.ln, r.gpos, r.gn, r.bad AS x, {sibs} FROM r
{rise('l', depth, '{x}.k1 = r.k1 AND {x}.k2 = r.k2')}
{rise('g', 8, 'r.gn > 0')}),
{(', ' + chr(10)).join(steps)}
SELECT doc_id, leaf, subroot, g8.h AS root, sha256({proof}) AS proof_sha256, x AS folded_root, x = g8.h AS verified FROM {last}, g8"""
