"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A document descends region, rack and shard.  At every level each child draws
``-ln(u) / weight`` from a hash of its own name and the document's key, and the
smallest draw wins, so a child gets its share by weight.  Weights of inner nodes are
the sums of their leaves.  If a weight grows, only draws on the path to that leaf
change: rows move into its subtree and nowhere else, and inside other subtrees nothing
moves.  ``grow`` puts each added shard into a region of its own; no draw of an older
node changes then, so the new shard takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataquarry.llm.common import let

#: Hex digits of an md5 that make a draw: 52 bits, exact in a double.
DIGITS = 13
SCALE = 2.0 ** (4 * DIGITS)


@dataclass(frozen=True)
class Node:
    """A leaf (``shard`` set) with its weight, or an inner node whose weight is its leaves' sum."""

    name: str
    own: float = 0.0
    shard: int | None = None
    children: tuple[Node, ...] = field(default=())

    @property
    def weight(self) -> float:
        return self.own if self.shard is not None else sum(c.weight for c in self.children)


def tree(shards: int, racks: int = 2, per_rack: int = 4, weights: dict[int, float] | None = None) -> Node:
    """Regions of ``racks`` racks of ``per_rack`` shards, numbered from 0; the last ones may be smaller."""
    leaves = [Node(f"shard{s}", (weights or {}).get(s, 1.0), s) for s in range(shards)]
    rack = [Node(f"rack{i}", children=tuple(leaves[i * per_rack : (i + 1) * per_rack])) for i in range(-(-shards // per_rack))]
    region = [Node(f"region{i}", children=tuple(rack[i * racks : (i + 1) * racks])) for i in range(-(-len(rack) // racks))]
    return Node("root", children=tuple(region))


def grow(root: Node, weight: float = 1.0) -> Node:
    """One more shard, alone in a rack and region of its own."""
    n = len(leaves(root))
    rack = Node(f"rack-of-{n}", children=(Node(f"shard{n}", weight, n),))
    return Node(root.name, children=(*root.children, Node(f"region-of-{n}", children=(rack,))))


def leaves(root: Node) -> list[Node]:
    return [root] if root.shard is not None else [x for c in root.children for x in leaves(c)]


def levels(root: Node) -> list[list[tuple[int, int, str, float]]]:
    """Per level: (parent's number, own number, name, weight); leaves are numbered by shard."""
    out, nodes = [], [(0, root)]
    while any(n.children for _, n in nodes):
        below, rows = [], []
        for number, node in nodes:
            for child in node.children:
                own = child.shard if child.shard is not None else len(below)
                below.append((own, child))
                rows.append((number, own, child.name, child.weight))
        out.append(rows)
        nodes = below
    return out


def uniform(text: Column) -> Column:
    """A number in (0, 1) from the md5 of a text."""
    return (F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") + 0.5) / SCALE


def _children(rows: Sequence[tuple[int, int, str, float]]) -> Column:
    parents = max(r[0] for r in rows) + 1
    groups = [
        F.array(*[F.struct(F.lit(n).alias("node"), F.lit(name).alias("name"), F.lit(float(w)).alias("weight"))
                  for p, n, name, w in rows if p == parent and w > 0])
        for parent in range(parents)
    ]
    return F.array(*groups)


def shard_of(key: Column, root: Node) -> Column:
    """The shard of a key.  A null key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))

    def draw(child: Column) -> Column:
        return F.struct((-F.log(uniform(F.concat_ws("|", child["name"], text))) / child["weight"]).alias("draw"), child["node"].alias("node"))

    node = F.lit(0)
    for rows in levels(root):
        node = let(node, partial(_descend, _children(rows), draw))
    return node


def _descend(table: Column, draw: Callable[[Column], Column], at: Column) -> Column:
    return F.array_min(F.transform(F.get(table, at), draw))["node"]


def with_slots(df: DataFrame, shard: str, key: str, rows_per_group: int = 50_000, ties: Sequence[str] = ()) -> DataFrame:
    """``slot``: gapless numbers from 0 inside each shard, in the order of a hash of the key.

    No shard is sorted whole: the hash order is cut into groups of about
    ``rows_per_group`` rows, which are numbered on their own and shifted by the counts
    of the groups before.  Rows with equal key and ``ties`` are interchangeable.
    """
    order = uniform(F.concat_ws("|", F.lit("slot"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    groups = 1 + df.select(key).count() // rows_per_group
    cut = df.withColumn("_order", order).withColumn("_group", F.floor(F.col("_order") * F.lit(float(groups))))
    sizes = cut.groupBy(shard, "_group").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(shard, "_group").orderBy("_order", key, *ties)
    return (
        cut.withColumn("_row", F.row_number().over(own))
        .join(starts, [shard, "_group"])
        .withColumn("slot", (F.col("_start") + F.col("_row") - 1).cast("bigint"))
        .drop("_order", "_group", "_row", "_start")
    )


def shard_documents(
    docs: DataFrame, root: Node | None = None, key: str = "doc_id", text: str = "text", rows_per_group: int = 50_000
) -> DataFrame:
    """Shard, slot and the shard after one more is added, per document; other columns are left out.

    A null text has no bytes, a null key counts as the empty text, repeated keys share
    a shard and get slots of their own, an empty table gives an empty one.
    """
    root = root or tree(24)
    rows = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        shard_of(F.col(key), root).alias("shard"),
        shard_of(F.col(key), grow(root)).alias("grown_shard"),
    ).withColumn("law", F.lit("key"))
    return with_slots(rows, "shard", key, rows_per_group, ("text_crc32",)).select(
        key, "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def sharding_sql(root: Node | None = None) -> str:
    """``shard_documents`` over ``documents`` in SQL."""
    root = root or tree(24)

    def descend(tag: str, tree_: Node) -> str:
        out, last = [], f"{tag}_0 as (select doc_id, 0 as node from (select distinct doc_id from documents))"
        out.append(last)
        for i, rows in enumerate(levels(tree_)):
            values = ", ".join(f"({p}, {n}, '{name}', {float(w)})" for p, n, name, w in rows)
            out.append(
                f"{tag}_{i + 1} as (select doc_id, arg_min(c.child, -ln((cast('0x' || substr(md5(concat_ws('|', c.name, coalesce(cast(doc_id as varchar), ''))), 1, {DIGITS}) as bigint) + 0.5) / {SCALE:.1f}) / c.weight) as node "
                f"from {tag}_{i} join (values {values}) as c(parent, child, name, weight) on c.parent = node group by doc_id)"
            )
        return ", ".join(out)

    depth = len(levels(root))
    table = ", ".join(str(_crc_entry(b)) for b in range(256))
    crc = (
        f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(rtrim(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1,', 'g'), ','), ','), "
        f"lambda h: cast('0x' || nullif(h, '') as bigint))), lambda c, b: case when b is null then c else xor(c >> 8, ([{table}])[1 + (xor(c, b) & 255)]) end))"
    )
    return f"""with {descend('a', root)}, {descend('b', grow(root))}
    select d.doc_id, cast(coalesce(strlen(d.text), 0) + 8 as bigint) as size, cast({crc} as bigint) as text_crc32, 'key' as law, a.node as shard,
      row_number() over (partition by a.node order by md5('slot|' || coalesce(cast(d.doc_id as varchar), '')), d.doc_id) - 1 as slot,
      b.node as grown_shard
    from documents d join a_{depth} a on a.doc_id is not distinct from d.doc_id join b_{depth} b on b.doc_id is not distinct from d.doc_id"""


def _crc_entry(byte: int) -> int:
    """One entry of the table of the reflected polynomial 0xEDB88320."""
    for _ in range(8):
        byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
    return byte
