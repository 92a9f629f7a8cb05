"""Merkle manifest of a table by an associative sparse forest.

Each row is a leaf. The leaves of a source, in order of their ids, make one tree, and the
roots of the sources, in order of their names, make the tree above them. Runs of ``ARITY``
neighbours become the node above; the arity of the last run follows from the number of
leaves, which is known.

A forest is a set of nodes by level and index whose runs aren't complete. Forests merge:
the union of two, where whatever run is now complete becomes its node. That is associative
and commutative, so any part of the table can be a forest; a part that is contiguous is a
small one, of a few nodes a level. Tasks make forests of up to ``CHUNK`` leaves and give
each leaf its siblings below its forest's nodes; ``treeReduce`` merges the forests, and
the siblings above are joined to the leaves by the node where their forest ended.

All that the driver gets are the nodes at and above those ends: about fifty for each chunk,
however many leaves and sources there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from statloom.llm.common import added, materialize, quoted

ARITY = 3
#: Leaves of a task's forest.
CHUNK = 1 << 18
#: The tree of the sources' roots; a source's tree has its rank.
TOP = -1
#: Runs (a source's rows in one partition; 60 bytes each) and ends of forests (2 KB each) that are broadcast; more are joined by a shuffle.
BROADCAST_RUNS, BROADCAST_ENDS = 500_000, 20_000

Node = tuple[int, int, int, int]  # tree, its leaves, level, index


def join_hash(hashes: Iterable[bytes]) -> bytes:
    return hashlib.sha256(b"".join(hashes).hex().encode()).digest()


def width(leaves: int, level: int) -> int:
    """Nodes of a level."""
    return -(-leaves // ARITY**level)


def run_of(node: Node) -> list[Node]:
    """The node and its siblings."""
    tree, leaves, level, at = node
    first = at - at % ARITY
    return [(tree, leaves, level, i) for i in range(first, min(first + ARITY, width(leaves, level)))]


@dataclass
class Forest:
    """Nodes whose runs aren't complete, and those that went into a run here."""

    trees: int
    open: dict[Node, bytes] = field(default_factory=dict)
    closed: dict[Node, bytes] = field(default_factory=dict)

    def add(self, nodes: Iterable[tuple[Node, bytes]]) -> Forest:
        for node, value in nodes:
            self.open[node] = value
            while node := self._close(node):
                pass
        return self

    def merge(self, other: Forest) -> Forest:
        one, two = sorted((self, other), key=lambda f: -len(f.open))
        one.closed |= two.closed
        return one.add(two.open.items())

    def above(self, node: Node) -> Node | None:
        """The node that the run of ``node`` becomes; a source's root goes to the top as it is."""
        tree, leaves, level, at = node
        if width(leaves, level) > 1:
            return tree, leaves, level + 1, at // ARITY
        return None if tree == TOP else (TOP, self.trees, 0, tree)

    def _close(self, node: Node) -> Node | None:
        up = self.above(node)
        run = run_of(node)
        if up is None or any(x not in self.open for x in run):
            return None
        values = [self.open.pop(x) for x in run]
        self.closed.update(zip(run, values, strict=True))
        self.open[up] = values[0] if width(node[1], node[2]) == 1 else join_hash(values)
        return up

    def climb(self, node: Node) -> tuple[bytes, bytes | None, Node]:
        """Siblings on the way up to an open node, the root of the source if it is passed, and that node."""
        siblings, subroot = [], None
        while node in self.closed:
            if node[0] != TOP and width(node[1], node[2]) == 1:
                subroot = self.closed[node]
            siblings += [self.closed[x] for x in run_of(node) if x != node]
            node = self.above(node)
        return b"".join(siblings), subroot, node


def leaf_hash(*fields: Column) -> Column:
    """Hex SHA-256 of the fields: ``-`` for null, else byte count, colon and value."""
    text = [x.cast("string") for x in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in text)), 256)


@dataclass
class Manifest:
    """``rows``: see ``build``; ``root``: hex, None for an empty table."""

    rows: DataFrame
    root: str | None


def _ordered(docs: DataFrame, id_col: str, source_col: str, leaf: Column, carry: Column) -> DataFrame:
    """(id, source, leaf, carry, first, pid, idx, leaves, rank, trees): each row's place, no order in one task."""
    read = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(source_col)).alias("source"), F.unhex(leaf).alias("leaf"), carry.alias("carry"))
    # the number decides between repeated rows, so that a crowd of them can be dealt out
    rows = materialize(read.withColumn("number", F.monotonically_increasing_id()), "leaves")
    order = [F.asc_nulls_first(c) for c in ("source", "id", "leaf", "number")]
    rows = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("number").withColumn("at", F.monotonically_increasing_id()), "sorted")
    rows = rows.withColumn("pid", F.shiftright("at", 33))
    runs = materialize(rows.groupBy("pid", "source").agg(F.min("at").alias("first"), F.count("*").alias("n")), "runs")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = runs.groupBy("source").agg(F.sum("n").alias("leaves"), F.min("first").alias("begin")).withColumn("pid", F.shiftright("begin", 33))
    begun = whole.groupBy("pid").agg(F.count("*").alias("k"))  # a row a partition
    begun = begun.select("pid", (F.sum("k").over(Window.orderBy("pid")) - F.col("k")).alias("ranks"), F.sum("k").over(Window.partitionBy()).alias("trees"))
    rank = (F.col("ranks") + F.row_number().over(Window.partitionBy("pid").orderBy("begin")) - 1).alias("rank")
    whole = whole.join(F.broadcast(begun), "pid").select(F.col("source").alias("s"), "leaves", rank, "trees")
    runs = runs.withColumn("before", before).join(whole, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    runs = materialize(runs.select(F.col("pid").alias("p"), F.col("source").alias("s"), "first", "before", "leaves", "rank", "trees"), "runs")
    few = runs.count() <= BROADCAST_RUNS
    placed = rows.join(F.broadcast(runs) if few else runs, (F.col("pid") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    placed = placed.select("id", "source", "leaf", "carry", (F.col("at") - F.col("first") + F.col("before")).alias("idx"), "leaves", "rank", "trees")
    return placed if few else placed.repartitionByRange("rank", "idx").sortWithinPartitions("rank", "idx")  # contiguous again


def _forests(placed: DataFrame, chunk: int) -> DataFrame:
    """Rows with their siblings as far as the task's forest goes, and the node where it ends; beside
    them rows of these nodes alone, with their values as leaf."""
    kind = StructType.fromDDL("subroot binary, siblings binary, tree bigint, width bigint, level bigint, at bigint, own boolean")
    schema = StructType([*placed.schema, *kind])
    names, kinds = schema.names, to_arrow_schema(schema).types

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk:
                yield from flushed(held)
                held, rows = [], 0
        yield from flushed(held)

    def flushed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, places = None, []
        for batch in held:
            rank, leaves, idx, trees, leaf = (batch.column(c).to_pylist() for c in ("rank", "leaves", "idx", "trees", "leaf"))
            places.append([(r, n, 0, i) for r, n, i in zip(rank, leaves, idx, strict=True)])
            forest = forest or Forest(trees[0] if trees else 0)
            forest.add(zip(places[-1], leaf, strict=True))
        for batch, nodes in zip(held, places, strict=True):
            found = [forest.climb(x) for x in nodes]
            ends = list(zip(*(x[2] for x in found), strict=True)) or [[]] * 4
            made = [[x[1] for x in found], [x[0] for x in found], *ends, [False] * len(found)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, k) for x, k in zip(made, kinds[-7:], strict=True))], names)
        if forest and forest.open:
            n = len(forest.open)
            known = {"leaf": list(forest.open.values()), "own": [True] * n, "trees": [forest.trees] * n} | dict(zip(("tree", "width", "level", "at"), zip(*forest.open, strict=True), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(known.get(c, [None] * n), k) for c, k in zip(names, kinds, strict=True)], names)

    return placed.mapInArrow(each, schema)


def build(docs: DataFrame, leaf: Column, id_col: str = "doc_id", source_col: str = "source", carry: Column | None = None, chunk: int = CHUNK) -> Manifest:
    """The manifest of ``docs``, whose rows have the hash ``leaf`` (hex, see ``leaf_hash``).

    Its rows are (id, source, leaf, carry, idx, leaves, rank, trees, subroot, siblings): a row's
    place among the ``leaves`` of its source and that source's among the ``trees`` sources, root
    of the source, and siblings (32 bytes each) level by level up to the root, left to right.
    ``carry`` is any expression over ``docs`` that goes with a row.

    Null ids come first, the null source too; rows of one id follow each other by their hash, and
    repeated rows are leaves of their own. Extra columns of any name are ignored. An empty table
    has no rows and no root.
    """
    made = materialize(_forests(_ordered(docs, id_col, source_col, leaf, F.lit(None).cast("string") if carry is None else carry), chunk), "forests")
    key = ["tree", "width", "level", "at"]
    ends = made.where("own").select(*key, "leaf", "trees")
    rows = made.where("not own").drop("own")
    if ends.isEmpty():
        return Manifest(rows.drop(*key).withColumn("subroot", F.lower(F.hex("subroot"))).withColumn("leaf", F.lower(F.hex("leaf"))), None)

    def forest(part: Iterable) -> Iterator[Forest]:
        found: Forest | None = None
        for r in part:
            found = (found or Forest(r["trees"])).add([((r["tree"], r["width"], r["level"], r["at"]), bytes(r["leaf"]))])
        if found:
            yield found

    spine = ends.rdd.mapPartitions(forest).treeReduce(Forest.merge)
    (root,) = spine.open.values()
    shared = docs.sparkSession.sparkContext.broadcast(spine)

    def upward(*nodes: list) -> list:
        found = [shared.value.climb(x) for x in zip(*nodes, strict=True)]
        return [[x[0] for x in found], [x[1] for x in found]]

    above = materialize(added(ends, key, [F.col(c) for c in key], "up binary, sub binary", upward), "ends")
    rows = rows.join(F.broadcast(above) if above.count() <= BROADCAST_ENDS else above, key).drop(*key)
    rows = rows.withColumns({"siblings": F.concat("siblings", "up"), "subroot": F.lower(F.hex(F.coalesce("subroot", "sub", F.lit(root)))), "leaf": F.lower(F.hex("leaf"))})
    return Manifest(rows.drop("up", "sub"), root.hex())


def fold(leaf: str, places: Iterable[tuple[int, int]], siblings: bytes) -> str:
    """The root that a leaf and its siblings give; places: (index, number of leaves) of each tree on the way up."""
    value, at = bytes.fromhex(leaf), 0
    for place, leaves in places:
        while leaves > 1:
            here = place % ARITY
            others = min(ARITY, leaves - place + here) - 1
            run = [siblings[i : i + 32] for i in range(at, at + 32 * others, 32)]
            value, at = join_hash([*run[:here], value, *run[here:]]), at + 32 * others
            place, leaves = place // ARITY, width(leaves, 1)
    return value.hex()


def folded(rows: DataFrame, leaf: Column, name: str = "folded_root") -> DataFrame:
    """``rows`` of a manifest with column ``name``: the root recomputed from ``leaf`` (hex) and the
    siblings; null for a null leaf. A column already called ``name`` is replaced."""

    def each(leaf: list, idx: list, leaves: list, rank: list, trees: list, siblings: list) -> list:
        return [[None if x is None else fold(x, ((i, n), (r, m)), s) for x, i, n, r, m, s in zip(leaf, idx, leaves, rank, trees, siblings, strict=True)]]

    return added(rows, [c for c in rows.columns if c != name], [leaf, *map(F.col, ("idx", "leaves", "rank", "trees", "siblings"))], f"{quoted(name)} string", each)
