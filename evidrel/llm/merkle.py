"""Merkle manifest of a table: leaves, roots and a proof for every row.

Rows of a group ascend by their order column; every ``FANOUT`` consecutive
digests are hashed together, until one is left: the group's subroot. Subroots,
in the order of their groups, are joined in the same way to the root.

Built bottom-up: each level is a table of nodes with their children's digests,
in the shared folder. Proofs go top-down: a level's nodes join what their
parents were given, and each child prepends its siblings to that suffix. Rows are
placed by a range partitioning, so no task sees a whole group; a join's sides
are nodes, eight times fewer than the rows below them, and texts are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrel.llm.common import drop_scratch, written

#: Children of a node.
FANOUT = 8


def field_bytes(value: str | Column) -> Column:
    """A value in a leaf: its UTF-8 byte count, a colon and itself; ``-`` if null."""
    s = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*values: str | Column) -> Column:
    """The digest of a row's values; integers as decimals, nulls as ``-``."""
    return digest(*map(field_bytes, values))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof (place among its run, siblings; bottom-up) give."""
    up = lambda h, s: F.sha2(F.concat(F.array_join(F.slice(s["siblings"], F.lit(1), s["place"]), ""), h, F.array_join(F.slice(s["siblings"], s["place"] + 1, F.lit(FANOUT)), "")).cast("binary"), 256)
    return F.aggregate(proof, start, up)


def proof_digest(proof: Column) -> Column:
    """One digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda s: s["siblings"])), "").cast("binary"), 256)


NO_PROOF = "array<struct<place:int,siblings:array<string>>>"


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ``idx``, the place in their group g by the order columns, and ``n``, the group's rows; a table.

    Rows are dealt by ranges of (g, order) and sorted within a partition, so a
    partition's rows of a group are consecutive; only their counts are summed up.
    """
    rows = written(rows, "merkle-rows")  # placing reads rows twice, their texts once
    dealt = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    # the part and the place in it
    dealt = written(dealt.withColumn("__at", F.monotonically_increasing_id()), "merkle-dealt")
    part = F.shiftright("__at", 33)
    runs = dealt.groupBy("g", part.alias("part")).agg(F.min("__at").alias("first"), F.count(F.lit(1)).alias("k"))
    runs = written(runs, "merkle-runs")  # a row for each part and group in it
    before = F.coalesce(F.sum("k").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs_at = runs.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("k").over(Window.partitionBy("g")).alias("n"))
    out = dealt.withColumn("part", part).join(runs_at, ["g", "part"]).withColumn("idx", F.col("__at") + F.col("shift")).drop("part", "shift", "__at")
    out = written(out, "merkle-nodes")
    drop_scratch(rows, dealt, runs)
    return out


def _levels(nodes: DataFrame, carry: list[str]) -> list[DataFrame]:
    """Tables of nodes (g, idx, n, digest), bottom-up, from the leaves to the last subroots; upper ones have kids (place, digest, carry).

    A group ends at the level where it has one node (n = 1).
    """
    levels, extra = [nodes], carry
    while True:
        open_ = levels[-1].where("n > 1")
        if open_.isEmpty():
            return levels
        kid = F.struct((F.col("idx") % FANOUT).cast("int").alias("place"), "digest", *extra)
        up = open_.withColumns({"kid": kid, "idx": F.floor(F.col("idx") / FANOUT), "n": F.ceil(F.col("n") / FANOUT)})
        up = up.groupBy("g", "idx").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("kid")).alias("kids"))  # FANOUT kids at most
        up = up.withColumn("digest", F.sha2(F.array_join(F.transform("kids", lambda k: k["digest"]), "").cast("binary"), 256))
        levels.append(written(up, "merkle-level"))
        extra = []


def _pushed(levels: list[DataFrame], tops: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(g, idx, digest, carried columns, what tops gives) of every leaf, its proof, and the tables made.

    tops: (g, proof, ...) of each group's subroot.
    """
    made, more = [], [c for c in tops.columns if c not in ("g", "proof")]
    state = None  # proofs of the nodes of the level at hand that have a parent
    for k in range(len(levels) - 1, -1, -1):
        ended = levels[k].where("n = 1").join(tops, "g")
        own = levels[k].where("n > 1")
        given = ended if state is None else ended.unionByName(own.join(state, ["g", "idx"]))
        if k == 0:
            break
        kids = F.col("kids")
        others = F.transform(F.filter(kids, lambda x: x["place"] != F.col("kid.place")), lambda x: x["digest"])
        step = F.struct(F.col("kid.place").alias("place"), others.alias("siblings"))
        each = given.withColumn("kid", F.explode(kids))
        each = each.withColumn("proof", F.concat(F.array(step), F.col("proof"))).withColumn("idx", F.col("idx") * FANOUT + F.col("kid.place"))
        if k == 1:  # the leaves ride in their parents' rows
            rest = [f.name for f in levels[1].schema["kids"].dataType.elementType if f.name != "place"]
            leaves = each.select("g", "idx", *[F.col(f"kid.{c}").alias(c) for c in rest], "proof", *more)
            alone = levels[0].where("n = 1").join(tops, "g").select("g", "idx", *rest, "proof", *more)
            return leaves.unionByName(alone), made
        state = written(each.select("g", "idx", "proof", *more), "merkle-proofs")
        made.append(state)
    return given.drop("n"), made


def manifest(rows: DataFrame, leaf_value: Column, group: str | Column, order: list[str], carry: dict[str, Column], columns: list[str | Column] = ()) -> DataFrame:
    """Order and carried columns, leaf, subroot, root and proof (array of place and siblings, bottom-up) of every row.

    ``columns`` are made of these where given, and only they are written. Other
    columns of rows are not read, whatever their names. A null group is one of its own and the first; groups ascend by their bytes.
    Null orders come first; rows of equal order ascend by leaf, so rows that
    repeat an order value, or are equal in all, have one defined result. A group
    of one row has its leaf as subroot; a table of one group its subroot as
    root. An empty table gives an empty result.
    """
    g = (F.col(group) if isinstance(group, str) else group).cast("string")
    g = F.coalesce(F.concat(F.lit("="), g), F.lit(""))  # orders null first, then by bytes
    names = [*order, *carry]
    taken = rows.select(g.alias("g"), *order, *[c.alias(k) for k, c in carry.items()], leaf_value.alias("digest"))
    levels = _levels(_placed(taken, [*order, "digest"]), names)
    subroots = None
    for level in levels:
        ends = level.where("n = 1").select("g", F.col("digest").alias("subroot"))
        subroots = ends if subroots is None else subroots.unionByName(ends)
    # the subroots' own tree: one group, ordered by the groups' names
    named = written(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("subroot").alias("digest")), "merkle-subroots")
    above = _levels(_placed(named, ["name"]), ["name"])
    root = above[-1].where("n = 1").select("g", F.col("digest").alias("root"), F.array().cast(NO_PROOF).alias("proof"))
    tops, tables = _pushed(above, root)
    tops = written(tops.select(F.col("name").alias("g"), F.col("digest").alias("subroot"), "root", "proof"), "merkle-tops")
    leaves, more = _pushed(levels, tops)
    leaves = leaves.select(*names, F.col("digest").alias("leaf"), "subroot", "root", "proof")
    out = written(leaves.select(*columns) if columns else leaves, "merkle-manifest")
    drop_scratch(*levels, *above, named, tops, *tables, *more)
    return out
