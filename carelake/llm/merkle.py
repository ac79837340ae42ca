"""A Merkle manifest of a dataset, with an inclusion proof for every row.

Nodes are lowercase hex SHA-256. A row's leaf covers its columns; the leaves of one group (a source, say) stand in a
stated order, every run of `arity` consecutive nodes becomes one node of the next level until one is left, and the
groups' last nodes likewise give the root.

Blocks of arity ** levels consecutive leaves are reduced in parallel, and again while more than `top_nodes` nodes are
left. The driver builds the small tree above those, and broadcasts each node's path to the root. Executors then go
through the blocks once more, from the top down, and fold every row along its whole path. Nothing that grows with the
rows goes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.shared import Scratch
from carelake.shipping import ship

ARITY = 3
#: Levels that one distributed step reduces: blocks of 3 ** 6 = 729 nodes.
BLOCK_LEVELS = 6
#: At most so many nodes go to the driver, and as many paths into the broadcast (about 25 MB).
TOP_NODES = 3**9

#: A path lists, from a node up to the root, the siblings to the left and to the right at each level.
UP, SELF = "/", "."


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*columns: Column) -> Column:
    """The digest of a row: each column as `-` if null, else its UTF-8 byte count, `:` and its value."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (c.cast("string") for c in columns)]
    return F.sha2(F.concat(*parts), 256)


def levels_of(nodes: list[str], arity: int = ARITY, most: int | None = None) -> list[list[str]]:
    """nodes and the levels above them, until one node is left or so many levels are there."""
    out = [nodes]
    while len(out[-1]) > 1 if most is None else len(out) <= most:
        now = out[-1]
        out.append([h("".join(now[i : i + arity])) for i in range(0, len(now), arity)])
    return out


def paths_of(levels: list[list[str]], above: str = "", arity: int = ARITY) -> list[str]:
    """The path of each node of the lowest level, where `above` is that of the single highest node."""
    paths = [above]
    for nodes in reversed(levels[:-1]):
        runs = (nodes[i : i + arity] for i in range(0, len(nodes), arity))
        paths = [
            "".join(run[:k]) + SELF + "".join(run[k + 1 :]) + (UP + up if up else "")
            for run, up in zip(runs, paths)
            for k in range(len(run))
        ]
    return paths


def fold(digest: str, path: str) -> str:
    """The root that a node's digest and its path give."""
    for step in path.split(UP) if path else ():
        left, right = step.split(SELF)
        digest = h(left + digest + right)
    return digest


def proof(path: str) -> str:
    """All siblings of a path, level by level and from left to right."""
    return path.replace(UP, "").replace(SELF, "")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group get the task's number and their place among the task's rows of their group."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch.column("grp"))
        ends = runs.run_ends.to_numpy()
        starts = np.concatenate([[0], ends[:-1]])
        carried = n if runs.values[0].as_py() == last else 0
        place = np.arange(batch.num_rows) - np.repeat(starts, ends - starts)
        place[: ends[0]] += carried
        last, n = runs.values[-1].as_py(), int(place[-1]) + 1
        extra = [pa.array(np.full(batch.num_rows, part), pa.int64()), pa.array(place, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "part", "place"])


def _positions(scratch: Scratch, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with `pos`, their place within their group in the given order.

    One range sort over all groups: only a task's first group can have begun in earlier tasks, so the places that are
    to be added are one number a task at most.
    """
    ordered = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    placed = scratch.write(ordered.mapInArrow(_numbered, f"{fields}, part long, place long"), f"{name}-placed")
    runs = placed.groupBy("grp", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.sum("n").over(earlier)
    begun = runs.select("grp", "part", before.alias("begun")).where("begun > 0")
    found = placed.join(F.broadcast(begun), ["grp", "part"], "left")
    return found.withColumn("pos", F.col("place") + F.coalesce("begun", F.lit(0))).drop("part", "place", "begun")


def _blocks(nodes: DataFrame, held: list[str], size: int) -> DataFrame:
    """One row per block of so many consecutive nodes of a group: (grp, block, nodes), in order."""
    members = F.array_sort(F.collect_list(F.struct("pos", *held)))
    return nodes.groupBy("grp", F.floor(F.col("pos") / size).alias("block")).agg(members.alias("nodes"))


def _members(batch: pa.RecordBatch, field: str) -> Iterator[list]:
    """One list of a field's values for each block."""
    nodes = batch.column("nodes")
    values, ends = nodes.flatten().field(nodes.type.value_type.get_field_index(field)), nodes.value_lengths().to_numpy().cumsum()
    held = values.to_pylist()
    return (held[a:b] for a, b in zip([0, *ends[:-1]], ends))


def _reduced(block: int, nodes: list[str], arity: int, most: int) -> list[list[str]]:
    """Levels of a block: a later block of a group goes all levels up, a first one until it is a single node.

    A first block that is full ends as high, so both need not know how long the group is.
    """
    return levels_of(nodes, arity, most if block else None)


def _rooter(arity: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_pylist()
            roots = [_reduced(b, nodes, arity, most)[-1][0] for b, nodes in zip(blocks, _members(batch, "digest"))]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("block"), pa.array(roots, pa.string())], names=["grp", "pos", "digest"])

    return run


def _descender(arity: int, most: int):
    """Blocks with their own path to the path of each of their nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "path")), _members(batch, "digest"))
            for grp, block, above, nodes in blocks:
                paths = paths_of(_reduced(block, nodes, arity, most), above, arity)
                pos = np.arange(len(nodes)) + block * arity**most
                yield pa.RecordBatch.from_arrays([pa.array([grp] * len(nodes), pa.string()), pa.array(pos, pa.int64()), pa.array(paths, pa.string())], names=["grp", "pos", "path"])

    return run


def _finisher(arity: int, most: int):
    """Blocks of rows with their own path to what is known of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "path", "subroot", "root")]
            for block, above, subroot, root, ids, leaves, now in zip(*columns, *(_members(batch, f) for f in ("id", "digest", "now"))):
                paths = paths_of(_reduced(block, leaves, arity, most), above, arity)
                folded = [fold(d, p) for d, p in zip(now, paths)]
                n = len(ids)
                out = [
                    pa.array(ids, pa.int64()), pa.array(leaves, pa.string()), pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string()),
                    pa.array([h(proof(p)) for p in paths], pa.string()), pa.array(folded, pa.string()), pa.array([f == root for f in folded], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def _top(nodes: list[tuple[str, int, str]], arity: int) -> tuple[dict[str, str], str | None, list[tuple[str, int, str]]]:
    """Subroots by group, the root, and the path of each node, for what is left of the groups' trees."""
    groups: dict[str, list[str]] = {}
    for grp, _, digest in sorted(nodes):
        groups.setdefault(grp, []).append(digest)
    trees = {g: levels_of(held, arity) for g, held in groups.items()}
    subroots = {g: t[-1][0] for g, t in trees.items()}
    if not subroots:
        return {}, None, []
    upper = levels_of(list(subroots.values()), arity)
    above = dict(zip(subroots, paths_of(upper, "", arity)))
    found = [(g, i, p) for g, t in trees.items() for i, p in enumerate(paths_of(t, above[g], arity))]
    return subroots, upper[-1][0], found


def manifest(
    rows: DataFrame, arity: int = ARITY, block_levels: int = BLOCK_LEVELS, top_nodes: int = TOP_NODES
) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (id, grp, digest, now).

    grp is a non-null string that orders the groups by its bytes, digest the leaf, and now the leaf that is folded along
    the original path, so a row whose content changed is not verified. Leaves of a group stand by id, null first, then
    by digest, so rows that repeat an id have a stated order too; exact repetitions are leaves each. An empty table
    gives no rows. Columns other than the four are ignored.

    Groups with more than top_nodes members in all (as many sources as rows, say) are reduced by further distributed
    steps, in which a group's last node takes the place of a row; the result is the same.
    """
    spark = rows.sparkSession
    ship(spark)
    scratch, size = Scratch(spark, "manifest"), arity**block_levels
    spare = F.monotonically_increasing_id()
    rows = scratch.write(rows.select("id", "grp", "digest", "now", spare.alias("spare")), "rows")
    placed = _positions(scratch, rows, ["id", "digest", "spare"], "rows").drop("spare")
    leaves = scratch.write(_blocks(placed, ["id", "digest", "now"], size), "blocks")
    steps, nodes = [leaves], _roots(scratch, leaves, arity, block_levels, 0)
    while nodes.limit(top_nodes + 1).count() > top_nodes and nodes.where("pos > 0").limit(1).count():
        steps.append(scratch.write(_blocks(nodes, ["digest"], size), f"blocks-{len(steps)}"))
        nodes = _roots(scratch, steps[-1], arity, block_levels, len(steps) - 1)
    paths, root = _upper(scratch, nodes, arity, block_levels, top_nodes)
    for step in reversed(steps[1:]):
        found = _joined(step, paths).select("grp", "block", "path", "nodes", "subroot")
        descended = found.mapInArrow(_descender(arity, block_levels), "grp string, pos long, path string")
        subroots = paths.where("pos = 0").select("grp", "subroot")
        paths = scratch.write(descended.join(subroots, "grp"), f"paths-{steps.index(step)}")
    out = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _joined(leaves, paths).withColumn("root", F.lit(root)).mapInArrow(_finisher(arity, block_levels), out)


def _roots(scratch: Scratch, blocks: DataFrame, arity: int, levels: int, n: int) -> DataFrame:
    found = blocks.mapInArrow(_rooter(arity, levels), "grp string, pos long, digest string")
    return scratch.write(found, f"nodes-{n}")


def _joined(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Blocks with their paths, each of which is one node's, so both sides have one row a block."""
    return blocks.join(paths.withColumnRenamed("pos", "block"), ["grp", "block"])


def _upper(scratch: Scratch, nodes: DataFrame, arity: int, levels: int, top_nodes: int) -> tuple[DataFrame, str | None]:
    """(grp, pos, path, subroot) of nodes, and the root.

    nodes are few, and the driver builds their tree; or they are one for each of many groups, which are then numbered
    and reduced as the rows of a single group were.
    """
    spark = scratch.spark
    if nodes.limit(top_nodes + 1).count() <= top_nodes:
        subroots, root, found = _top([tuple(r) for r in nodes.collect()], arity)
        rows = [(*f, subroots[f[0]]) for f in found]
        return F.broadcast(spark.createDataFrame(rows, "grp string, pos long, path string, subroot string")), root
    single = nodes.select(F.lit("").alias("grp"), F.col("grp").alias("id"), "digest")
    placed = scratch.write(_positions(scratch, single, ["id"], "groups"), "groups")
    steps, up = [], placed
    while up.limit(top_nodes + 1).count() > top_nodes:
        held = ["id", "digest"] if not steps else ["digest"]
        steps.append(scratch.write(_blocks(up, held, arity**levels), f"groups-{len(steps)}"))
        up = scratch.write(steps[-1].mapInArrow(_rooter(arity, levels), "grp string, pos long, digest string"), f"group-nodes-{len(steps)}")
    _, root, found = _top([tuple(r) for r in up.select("grp", "pos", "digest").collect()], arity)
    paths = F.broadcast(spark.createDataFrame(found, "grp string, pos long, path string"))
    for step in reversed(steps):
        out = _joined(step, paths).select("grp", "block", "path", "nodes").mapInArrow(_descender(arity, levels), "grp string, pos long, path string")
        paths = scratch.write(out, f"group-paths-{steps.index(step)}")
    named = placed.select(F.col("id").alias("name"), "pos", F.col("digest").alias("subroot")).join(paths.select("pos", "path"), "pos")
    return named.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", "subroot"), root


def document_manifest(docs: DataFrame, **sizes: int) -> DataFrame:
    """The manifest of documents by source, in which every row with an even CRC-32 of its id has lost its line feeds.

    A leaf covers doc_id, source, lang, n_chars and text. A null source is a group of its own and comes first, a null
    id stands first in its source and is never tampered with, a null text stays null. Columns beyond these are ignored.
    """
    given = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("grp"),
        leaf(*given, text).alias("digest"),
        leaf(*given, F.coalesce(tampered, text)).alias("now"),
    )
    return manifest(rows, **sizes)
