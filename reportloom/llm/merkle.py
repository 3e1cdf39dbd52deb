"""Merkle manifest of a table: a digest a row, a subroot a group of rows, a root, and a proof for every row.

Leaves of a group stand in the order of their key; every ``arity`` consecutive nodes of a level (the last ones: what is left)
have the digest of their digests, end to end as hex texts, as parent, until one node is left. The groups' nodes are the
leaves of one more such tree, whose last node is the root.

Plan. The leaves, without the texts, are range-sorted by group and key and written, and numbered from the counts of each
(partition, group). Then come rounds of combining. A node is an event (group, level, index, digest). A parent gathers its
children by index, and as the group's size says how many it has, the last one to arrive makes the parent's digest, which is an
event itself. Round 0 runs on the sorted leaves where they lie, without a shuffle, up to trees of height ``HEIGHT``; what
it can't resolve, complete trees of that height and single nodes at the edges of partitions, is the frontier. Only that is
dealt again, by the next higher subtree, so each round meets ``arity ** HEIGHT`` nodes a key and leaves that much fewer,
however large a group is; 10 ** 12 rows take five rounds. Every event also leaves a reverse link, to the node that the
round ended it in, with the siblings on the way. A proof is the links of a leaf, joined round by round.

Defined results: a null value is told apart from every text; a null group is one of its own and comes first; null keys come
first; rows of one key stand in the order of their digests, so equal rows are interchangeable; an empty table has no rows and
no root. Texts of any length are hashed whole, in the JVM. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, discard, lean, numbered, written

ARITY = 3
#: Levels that a round combines.
HEIGHT = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ROWS = 8192
_PATH = "array<struct<before: string, after: string>>"
_LINK = f"g string, level int, at long, path {_PATH}, top_level int, top_at long, top_digest string, size long"


def leaf_digest(fields: Iterable[Column]) -> Column:
    """The digest of a row: of its values, each told with its length in bytes, a null as '-'."""
    told = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*told), 256)


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Node:
    """A node of a round: an event that arrived (``row`` holds it), or a parent that its children made."""

    __slots__ = ("at", "children", "digest", "level", "row")

    def __init__(self, level, at, digest, row=None, children=()):
        self.level, self.at, self.digest, self.row, self.children = level, at, digest, row, children


class Combiner:
    """Partial parents of any groups; ``top`` is the level at which trees are handed on."""

    def __init__(self, top: int, arity: int = ARITY):
        self.top, self.arity = top, arity
        self.partial: dict[tuple, dict[int, Node]] = {}

    def arrive(self, g: str, size: int, node: Node) -> Node | None:
        """Adds an event; the tree that it completes, if it does: the group's last node, or one of the level ``top``."""
        while True:
            width = -(-size // self.arity**node.level)
            if width == 1 or node.level >= self.top:
                return node
            parent = node.at // self.arity
            children = self.partial.setdefault((g, size, node.level, parent), {})
            children[node.at] = node
            if len(children) < min(self.arity, width - self.arity * parent):
                return None
            del self.partial[g, size, node.level, parent]
            found = [children[k] for k in sorted(children)]
            node = Node(node.level + 1, parent, digest(c.digest for c in found), children=found)

    def frontier(self) -> Iterator[tuple[str, int, Node]]:
        """The nodes whose parents aren't complete; none is left here."""
        for (g, size, _, _), children in self.partial.items():
            for node in children.values():
                yield g, size, node
        self.partial = {}


def linked(node: Node) -> Iterator[tuple[Node, list[dict]]]:
    """The events under a node, each with the siblings on its way up to it."""
    if node.row is not None:
        yield node, []
        return
    digests = [c.digest for c in node.children]
    for k, child in enumerate(node.children):
        step = {"before": "".join(digests[:k]), "after": "".join(digests[k + 1 :])}
        for event, path in linked(child):
            yield event, [*path, step]


def _round(events: DataFrame, top: int, carried: list[str], arity: int, by: tuple[str, ...] = ()) -> DataFrame:
    """A row an event, with its link; events are (g, size, level, at, digest) and the carried columns. Rows of a task may be
    in any order; those of one key of ``by`` stand together, so that a task holds one key's nodes only."""
    schema = ", ".join([_LINK, *(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in carried)])
    kind = arrow_type(schema)

    def run(batches):
        made, out, key = Combiner(top, arity), [], None

        def settle(g, size, node):
            for event, path in linked(node):
                out.append({**event.row, "g": g, "level": event.level, "at": event.at, "path": path, "top_level": node.level, "top_at": node.at, "top_digest": node.digest, "size": size})

        def told(rest=False):
            while len(out) >= _ROWS or (rest and out):
                yield pa.RecordBatch.from_pylist(out[:_ROWS], schema=kind)
                del out[:_ROWS]

        for batch in batches:
            for row in batch.to_pylist():
                if by and key != (key := tuple(row[c] for c in by)):
                    for g, size, node in made.frontier():
                        settle(g, size, node)
                found = made.arrive(row["g"], row["size"], Node(row["level"], row["at"], row["digest"], {c: row[c] for c in carried}))
                if found is not None:
                    settle(row["g"], row["size"], found)
            yield from told()
        for g, size, node in made.frontier():
            settle(g, size, node)
        yield from told(rest=True)

    return events.mapInArrow(lean(run), schema)


def _tops(links: DataFrame) -> DataFrame:
    """The nodes in which a round's links end, once each."""
    return links.groupBy("g", "size", F.col("top_level").alias("level"), F.col("top_at").alias("at")).agg(F.min("top_digest").alias("digest"))


def forest(leaves: DataFrame, order: list[str], carried: list[str], arity: int = ARITY, height: int = HEIGHT) -> tuple[DataFrame, list[DataFrame]]:
    """Of leaves (g, digest, the order's and the carried columns), a tree for each g: its rows with (g, path, subroot), and
    the scratch tables that they are read from. Carried columns must not be called like those of a link."""
    ranked = numbered(leaves, "g", order, "leaves")
    held = [*ranked.scratch_tables]
    events = ranked.select("g", F.col("_size").alias("size"), F.lit(0).alias("level"), F.col("_index").alias("at"), "digest", *carried)
    links = written(_round(events, height, carried, arity), "links")
    held.append(links)
    largest = links.agg(F.max("size")).first()[0] or 0
    found, top = links.select("g", *carried, "path", "top_level", "top_at", "top_digest"), height
    frontier = _tops(links)
    while arity**top < largest:
        top += height
        blocks = frontier.withColumn("block", F.expr(f"at div cast(pow({arity}, {top} - level) as bigint)"))
        links = written(_round(blocks.repartition("g", "block").sortWithinPartitions("g", "block"), top, [], arity, ("g", "block")), "links")
        held.append(links)
        above = links.select("g", F.col("level").alias("top_level"), F.col("at").alias("top_at"), F.col("path").alias("_above"), F.col("top_level").alias("_level"), F.col("top_at").alias("_at"), F.col("top_digest").alias("_digest"))
        joined = found.join(above, ["g", "top_level", "top_at"])
        found = joined.select("g", *carried, F.concat("path", "_above").alias("path"), F.col("_level").alias("top_level"), F.col("_at").alias("top_at"), F.col("_digest").alias("top_digest"))
        frontier = _tops(links)
    return found.select("g", *carried, "path", F.col("top_digest").alias("subroot")), held


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def manifest(docs: DataFrame, doc_id: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, arity: int = ARITY, also: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof) of every row, and the columns ``also`` computed from it. A proof is an array of
    (before, after): the digests to the left and right of the node on the way to the root."""
    also = also or {}
    kept = [f"_also{k}" for k in range(len(also))]
    # null and '' are different groups, and null comes first
    g = F.coalesce(F.concat(F.lit("x"), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = docs.select(g.alias("g"), F.col(f"`{doc_id}`").alias("_key"), leaf_digest(F.col(f"`{c}`") for c in fields).alias("digest"), *(c.alias(k) for k, c in zip(kept, also.values(), strict=True)))
    leaves = written(leaves.withColumn("_leaf", F.col("digest")), "digests")
    rows, scratch = forest(leaves, ["_key", "digest"], ["_key", "_leaf", *kept], arity, height)
    rows = written(rows, "proofs")
    discard(leaves, *scratch)
    groups = written(rows.groupBy("g").agg(F.min("subroot").alias("digest")), "subroots")
    tops, scratch = forest(groups.select(F.lit("").alias("g"), F.col("g").alias("_group"), "digest"), ["_group"], ["_group"], arity, height)
    tops = written(tops.select(F.col("_group").alias("g"), F.col("path").alias("_above"), F.col("subroot").alias("root")), "tops")
    discard(groups, *scratch)
    named = [F.col(k).alias(name) for k, name in zip(kept, also, strict=True)]
    return rows.join(tops, "g").select(F.col("_key").alias(doc_id), F.col("_leaf").alias("leaf"), "subroot", "root", F.concat("path", "_above").alias("proof"), *named)
