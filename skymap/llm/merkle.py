"""Merkle manifest of a table: a hash for every row, one for every group, one for the whole.

Every row is a leaf. Per group the leaves, ordered, are hashed together in runs of 16, the hashes
again in runs of 16, until one is left, the group's subroot; the subroots, ordered by group, give
the root in the same way. ``manifest`` builds the levels bottom-up and stores them as rows linked
to their parents; ``proofs`` climbs them by a recursive query and folds every leaf, as it is now,
with its stored siblings: the result equals the root only if the row is unchanged.

* Order within a group comes from a range partitioning of the whole table by (group, key, leaf),
  the row's place in its partition and the counts of the partitions before. A group of any size is
  spread over partitions; no window goes over more rows than there are partitions, or over more
  groups than a partition holds.
* Levels shrink sixteenfold and are written one by one; a group of 16 is the largest that is
  collected.
* The climb has one row for each run of leaves, since from their first parent on their ways are
  one; the row carries the folded hash of each leaf. Upper nodes are met by many rows: a node with
  more than 4096 runs below is stored once for each block of 4096, so no key of the recursive join
  meets more rows than that.

Cases: a null field is hashed as ``-``; a null group is a group of its own and comes first, a null
key comes first in its group. Rows of one key are ordered by their leaves, equal rows have equal
leaves and each has its place. A lone leaf is its subroot, a lone subroot is the root; no siblings
make the proof of an empty text. Texts of any length are hashed whole, in the JVM. An empty table
gives empty results. Columns not named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skymap.llm.common import stored

FAN_OUT = 16
# Runs of leaves that meet one stored copy of a node: 16^2, about a megabyte of the climb.
BLOCK_LEVELS = 2
# Nodes of a level of the groups' tree that may be broadcast (about 1 KB each).
FEW_NODES = 4096
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon, the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(field(c) for c in fields)), 256)


def hash_of(children: Column) -> Column:
    """Hash of hashes, joined as hexadecimal text."""
    return F.sha2(F.array_join(children, ""), 256)


def _nulls_first(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_first() for n in names]


@dataclass(frozen=True)
class Manifest:
    """``runs``: (tree, run, n, leaves: array of (key, leaf, now)), ``nodes``: (tree, level, idx, n,
    hash, children), both stored; ``groups``: (tree, grp); ``n_groups``: how many groups there are."""

    runs: DataFrame
    nodes: list[DataFrame]
    groups: DataFrame
    n_groups: int


def _placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves with tree, idx, n, groups with tree): the place of each leaf in its group's order."""
    spark = leaves.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = _nulls_first("grp", "key", "leaf", "tie")
    dealt = leaves.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    pieces = dealt.groupBy(part.alias("part"), "grp").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    over = Window.partitionBy("grp")
    pieces = stored(
        pieces.withColumn("before", F.sum("rows").over(over.orderBy("part")) - F.col("rows")).withColumn(
            "n", F.sum("rows").over(over)
        )
    )
    begun = pieces.filter("before = 0").withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("first")))
    # One row a partition, so this window is as long as there are partitions.
    counts = begun.groupBy("part").agg(F.count("*").alias("groups"))
    counts = counts.withColumn("base", F.sum("groups").over(Window.orderBy("part")) - F.col("groups"))
    groups = stored(begun.join(counts, "part").select("grp", (F.col("base") + F.col("nth") - 1).alias("tree")))
    pieces = pieces.alias("p").join(groups.alias("g"), F.col("p.grp").eqNullSafe(F.col("g.grp")))
    pieces = stored(pieces.select("part", "p.grp", "first", "before", "n", "tree"))
    same_piece = (part == F.col("p.part")) & F.col("l.grp").eqNullSafe(F.col("p.grp"))
    placed = dealt.alias("l").join(pieces.alias("p"), same_piece)
    idx = F.col("place") - F.col("first") + F.col("before")
    return placed.select("tree", idx.alias("idx"), "n", "key", "leaf", "now"), groups


def _parents(nodes: DataFrame) -> DataFrame:
    """The level above the nodes (tree, level, idx, n, hash) of trees with more than one."""
    run = F.floor(F.col("idx") / FAN_OUT).cast("long")
    grouped = nodes.filter("n > 1").groupBy("tree", (F.col("level") + 1).alias("level"), run.alias("run"))
    found = grouped.agg(
        F.ceil(F.max("n") / FAN_OUT).cast("long").alias("n"),
        F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("of"),
    )
    return _node(found.withColumn("children", F.col("of.hash")).withColumnRenamed("run", "idx"))


def _node(found: DataFrame) -> DataFrame:
    return found.select("tree", "level", "idx", "n", hash_of(F.col("children")).alias("hash"), "children")


def _climbed(level: DataFrame, most: int) -> list[DataFrame]:
    """A stored level of nodes and all above it; ``most`` nodes has the largest tree."""
    levels = [level]
    while most > 1:
        levels.append(stored(_parents(levels[-1])))
        most = -(-most // FAN_OUT)
    return levels


def manifest(
    rows: DataFrame,
    fields: Sequence[str] = FIELDS,
    key: str = "doc_id",
    group: str = "source",
    now: dict[str, Column] | None = None,
) -> Manifest:
    """Built levels over all rows. ``now`` gives fields as they are found today where they may
    differ from those the manifest is made of."""
    columns = [F.col(f) for f in fields]
    leaf = leaf_of(columns)
    found = leaf_of([(now or {}).get(f, F.col(f)) for f in fields]) if now else leaf
    leaves = rows.select(
        F.col(group).alias("grp"),
        F.col(key).alias("key"),
        leaf.alias("leaf"),
        found.alias("now"),
        F.monotonically_increasing_id().alias("tie"),
    )
    placed, groups = _placed(stored(leaves))
    run = F.floor(F.col("idx") / FAN_OUT).cast("long").alias("run")
    runs = placed.groupBy("tree", run).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "key", "leaf", "now"))).alias("leaves")
    )
    runs = stored(runs)
    most, n_groups = runs.agg(F.max("n"), F.count(F.when(F.col("run") == 0, 1))).first()
    first = runs.filter("n > 1").select(
        "tree",
        F.lit(1).alias("level"),
        F.col("run").alias("idx"),
        F.ceil(F.col("n") / FAN_OUT).cast("long").alias("n"),
        F.col("leaves.leaf").alias("children"),
    )
    levels = _climbed(stored(_node(first)), -(-(most or 0) // FAN_OUT))
    if n_groups > 1:
        ends = runs.filter("n = 1").select("tree", F.col("leaves")[0]["leaf"].alias("hash"))
        for level in levels:
            ends = ends.unionByName(level.filter("n = 1").select("tree", "hash"))
        tops = ends.select(
            F.lit(TOP).cast("long").alias("tree"),
            F.lit(0).alias("level"),
            F.col("tree").alias("idx"),
            F.lit(n_groups).cast("long").alias("n"),
            "hash",
        )
        levels += _climbed(stored(_parents(tops)), -(-n_groups // FAN_OUT))
    return Manifest(runs, levels, groups, n_groups)


def _up(n_groups: int) -> list[Column]:
    """Where a node's parent stands: its tree, level and index, and the node's place in it."""
    inside, joins = F.col("n") > 1, (F.col("tree") != TOP) & F.lit(n_groups > 1)
    at = F.when(inside, F.col("idx")).when(joins, F.col("tree"))
    return [
        F.when(inside, F.col("tree")).when(joins, F.lit(TOP)).alias("up_tree"),
        F.when(inside, F.col("level") + 1).when(joins, F.lit(1)).alias("up_level"),
        F.floor(at / FAN_OUT).cast("long").alias("up_idx"),
        (at % FAN_OUT).cast("int").alias("slot"),
    ]


def _linked(made: Manifest) -> DataFrame:
    """Nodes with links to their parents, once for each block of runs below: (own, block) with
    (tree, level, idx) is the key of a copy."""
    size = FAN_OUT**BLOCK_LEVELS
    blocks = made.runs.select(F.col("tree").alias("own"), F.floor(F.col("run") / size).cast("long").alias("block")).distinct()
    blocks = stored(blocks)
    links, out = _up(made.n_groups), []
    n_top, top_level = made.n_groups, 0
    for level in made.nodes:
        nodes = level.select("tree", "level", "idx", "hash", "children", (F.col("n") == 1).alias("last"), *links)
        below = F.pow(F.lit(float(FAN_OUT)), F.col("level") - 1).cast("long")
        own = nodes.filter(F.col("tree") != TOP)
        runs = F.ceil(F.size("children") * below / FAN_OUT).cast("long")
        first = F.floor(F.col("idx") * below / size).cast("long")
        last = F.floor((F.col("idx") * below + F.greatest(runs, F.lit(1)) - 1) / size).cast("long")
        out.append(own.withColumn("own", F.col("tree")).withColumn("block", F.explode(F.sequence(first, last))))
    for level in made.nodes[_source_levels(made) :]:
        top_level += 1
        n_top = -(-n_top // FAN_OUT)
        nodes = level.select("tree", "level", "idx", "hash", "children", (F.col("n") == 1).alias("last"), *links)
        below = blocks.withColumn("idx", F.floor(F.col("own") / FAN_OUT**top_level).cast("long"))
        out.append(below.join(F.broadcast(nodes) if n_top <= FEW_NODES else nodes, "idx"))
    first, *rest = out
    for more in rest:
        first = first.unionByName(more)
    return stored(first)


def _source_levels(made: Manifest) -> int:
    """How many of the levels belong to the groups' own trees; those of the tree over them follow."""
    n, top = made.n_groups, 0
    while n > 1:
        n, top = -(-n // FAN_OUT), top + 1
    return len(made.nodes) - top


CLIMB = """
WITH RECURSIVE climb (own, run, block, folded, proof, subroot, hash, up_tree, up_level, up_idx, slot) AS (
  SELECT own, run, block, folded, proof, subroot, hash, up_tree, up_level, up_idx, slot FROM {start}
  UNION ALL
  SELECT c.own, c.run, c.block,
         transform(c.folded, f -> sha2(array_join(transform(p.children, (h, j) -> if(j = c.slot, f, h)), ''), 256)),
         concat(c.proof, array_join(filter(p.children, (h, j) -> j <> c.slot), '')),
         coalesce(c.subroot, if(p.last, p.hash, NULL)),
         p.hash, p.up_tree, p.up_level, p.up_idx, p.slot
  FROM climb c JOIN {nodes} p
    ON c.own = p.own AND c.block = p.block
   AND c.up_tree = p.tree AND c.up_level = p.level AND c.up_idx = p.idx
)
SELECT own, run, folded, proof, subroot, hash FROM climb WHERE up_level IS NULL LIMIT ALL
"""


def proofs(made: Manifest) -> DataFrame:
    """(key, grp, leaf, subroot, root, proof, folded_root, verified) of every leaf; ``proof`` holds
    all siblings on the way to the root, joined."""
    spark = made.runs.sparkSession
    size = FAN_OUT**BLOCK_LEVELS
    folded = F.transform(
        "leaves",
        lambda x, i: hash_of(F.transform("leaves", lambda y, j: F.when(i == j, x["now"]).otherwise(y["leaf"]))),
    )
    alone = F.col("n_leaves") == 1
    start = made.runs.withColumn("n_leaves", F.col("n"))
    # The node the run's hash is of: the leaf itself where it is alone in its group.
    start = start.select(
        F.col("tree").alias("own"),
        "run",
        F.floor(F.col("run") / size).cast("long").alias("block"),
        F.when(alone, F.col("leaves.now")).otherwise(folded).alias("folded"),
        F.lit("").alias("proof"),
        F.when(alone, F.col("leaves")[0]["leaf"]).otherwise(hash_of(F.col("leaves.leaf"))).alias("hash"),
        "tree",
        F.when(alone, 0).otherwise(1).alias("level"),
        F.col("run").alias("idx"),
        F.ceil(F.col("n_leaves") / FAN_OUT).cast("long").alias("n"),
    )
    start = start.withColumn("subroot", F.when(F.col("n") == 1, F.col("hash")))
    start = start.select("own", "run", "block", "folded", "proof", "subroot", "hash", *_up(made.n_groups))
    done = stored(spark.sql(CLIMB, start=stored(start), nodes=_linked(made)))
    # The leaves themselves stay below and are met again at the end.
    rows = done.join(made.runs.select(F.col("tree").alias("own"), "run", "leaves"), ["own", "run"])
    rows = rows.join(made.groups.withColumnRenamed("tree", "own"), "own")
    each = rows.select("grp", "leaves", "folded", "proof", "subroot", "hash", F.posexplode("leaves").alias("i", "x"))
    siblings = F.array_join(F.filter("leaves.leaf", lambda h, j: j != F.col("i")), "")
    folded_root = F.get("folded", F.col("i"))
    return each.select(
        F.col("x.key").alias("key"),
        "grp",
        F.col("x.leaf").alias("leaf"),
        "subroot",
        F.col("hash").alias("root"),
        F.concat(siblings, "proof").alias("proof"),
        folded_root.alias("folded_root"),
        (folded_root == F.col("hash")).alias("verified"),
    )


def tampered(text: Column, doc_id: Column) -> Column:
    """The text in lower case where 5 divides the checksum of the id."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
    upper = "".join(map(chr, range(65, 91)))
    return F.when(hit, F.translate(text, upper, upper.lower())).otherwise(text)


def verify_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, source) of every document."""
    now = {"text": tampered(F.col("text"), F.col("doc_id"))}
    found = proofs(manifest(docs, now=now))
    return found.select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2("proof", 256).alias("proof_sha256"),
        "folded_root",
        "verified",
        F.col("grp").alias("source"),
    )
