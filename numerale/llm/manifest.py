"""Merkle manifest of a dataset: slot pivots up the tree, sibling columns down again.

Every row is a leaf, the hash of its fields; per group the leaves ascend by id, and
every ``fanout`` consecutive nodes become the hash of their digests (hex text, one
after the other; a last run may be shorter, even a single node) until one is left,
the group's subroot.  The subroots, ordered by group, make the root in the same way.

* Positions: rows (digests, no texts) are dealt by ranges of (group, id, leaf) and
  numbered inside each range; running totals of the ranges' counts per group are the
  offsets.  No group, however large, is in one task, and the running totals have one
  row per range and group.
* Slot pivot: the digests of ``fanout ** LEVELS`` neighbours are spread by conditional
  aggregates into as many columns of one row, so that a shuffle climbs LEVELS levels:
  concatenating the columns of a run hashes it, and leaving out the column on a slot's
  own way gives its siblings.  Neighbours lie in one range, so rows are merged before
  they are shuffled.
* Down: from the root, each pivot row meets its own way to the root and hands every
  slot the siblings inside the row followed by that way.  What the leaves carry with
  them (id, digests) travels as the bottom slots' columns and needs no join.

A proof is the list of (left, right) sibling digests, leaf level first.  A leaf folded
with it gives the root again; another leaf gives another root.

Defined cases: a null field is ``-``; null groups are one group, before all others; null
ids come first, equal ids are ordered by leaf, and equal rows are leaves each; an
empty table has no rows and no root.  One row alone is leaf, subroot and root.  Other
columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from numerale.llm.common import stored

#: Levels that one shuffle climbs; fanout ** LEVELS columns are pivoted.
LEVELS = 3

PATH = "array<struct<l:string,r:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as the leaf holds it: the number of its bytes, a colon, the value; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return digest(*map(field, fields))


def group_key(group: Column) -> Column:
    """Text that orders like the group, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("v"), group.cast("string")), F.lit(""))


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` stored, with pos (from 0, by ``order`` within the group) and size (the group's rows)."""
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = stored(dealt.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    runs = dealt.groupBy(group, part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offset = F.sum("n").over(before) - F.col("n") - F.col("first")
    runs = runs.select(group, "part", offset.alias("offset"), F.sum("n").over(whole).alias("size"))
    out = dealt.withColumn("part", part).join(runs, [group, "part"])
    return out.withColumn("pos", F.col("at") + F.col("offset")).drop("at", "part", "offset")


def levels_of(fanout: int) -> int:
    """As many levels as about sixteen slots hold, at least one."""
    return LEVELS if fanout == 2 else max(1, 2 if fanout <= 4 else 1)


def pivoted(nodes: DataFrame, fanout: int, levels: int, carried: list[str], name: str) -> DataFrame:
    """One row per ``fanout ** levels`` neighbours: parent, size, s (the slots) and up, the digest after ``levels`` levels.

    ``nodes``: g, pos, size (nodes of the group at this level), digest, and the ``carried`` columns.
    A slot is a struct (digest, carried, path), path being the siblings inside the row.
    """
    width = fanout**levels
    slot = F.col("pos") % width
    value = F.struct(F.unhex("digest").alias("digest"), *carried)
    spread = [F.max(F.when(slot == k, value)).alias(f"s{k}") for k in range(width)]
    row = nodes.groupBy("g", F.expr(f"pos div {width}").alias("parent")).agg(F.max("size").alias("size"), *spread)
    level = [F.lower(F.hex(F.col(f"s{k}.digest"))) for k in range(width)]
    row = row.withColumns({f"d0_{k}": x for k, x in enumerate(level)})
    for i in range(levels):  # nodes of a level are hashed as long as the group has more than one of them
        more = F.ceil(F.col("size") / fanout**i) > 1
        next_ = {}
        for r in range(width // fanout ** (i + 1)):
            run = [F.col(f"d{i}_{r * fanout + c}") for c in range(fanout)]
            held = F.concat_ws("", *run)
            next_[f"d{i + 1}_{r}"] = F.when(run[0].isNull(), None).when(more, F.sha2(held, 256)).otherwise(run[0])
        row = row.withColumns(next_)
    slots = []
    for k in range(width):
        steps = []
        for i in range(levels):
            own = k // fanout**i
            run = range(own // fanout * fanout, (own // fanout + 1) * fanout)
            left = F.concat_ws("", *(F.col(f"d{i}_{c}") for c in run if c < own))
            right = F.concat_ws("", *(F.col(f"d{i}_{c}") for c in run if c > own))
            step = F.struct(left.alias("l"), right.alias("r"))
            steps.append(F.when(F.ceil(F.col("size") / fanout**i) > 1, step))
        path = F.array_compact(F.array(*steps))
        own = F.struct(
            F.lit(k).alias("slot"), F.col(f"d0_{k}").alias("digest"), *(F.col(f"s{k}.{c}").alias(c) for c in carried), path.alias("path")
        )
        slots.append(F.when(F.col(f"s{k}").isNotNull(), own))
    row = row.select("g", "parent", "size", F.array_compact(F.array(*slots)).alias("s"), F.col(f"d{levels}_0").alias("up"))
    return stored(row, name)


def climbed(leaves: DataFrame, fanout: int, carried: list[str], name: str) -> list[DataFrame]:
    """The pivots from the leaves to the top, whose one row per group has the group's top digest as ``up``.

    ``leaves``: g (text), pos, size, digest (hex), carried columns.
    """
    levels = levels_of(fanout)
    width = fanout**levels
    most = leaves.agg(F.max("size")).first()[0] or 0
    rounds, nodes = [], leaves
    while not rounds or most > 1:
        rounds.append(pivoted(nodes, fanout, levels, [] if rounds else carried, f"{name}-{len(rounds)}"))
        size = F.ceil(F.col("size") / width).alias("size")
        nodes = rounds[-1].select("g", F.col("parent").alias("pos"), size, F.col("up").alias("digest"))
        most = -(-most // width)
    return rounds


def descended(rounds: list[DataFrame], above: DataFrame, fanout: int, carried: list[str]) -> DataFrame:
    """(digest, carried, path, and the columns of ``above`` but g, pos) per leaf.

    ``above``: g, pos (0), path - the way from the group's top on - and what all leaves of the group get.
    """
    kept = [c for c in above.columns if c not in ("g", "pos", "path")]
    width = fanout ** levels_of(fanout)
    for k in range(len(rounds) - 1, -1, -1):
        here = rounds[k].select("g", F.col("parent").alias("pos"), "s").join(above, ["g", "pos"])
        here = here.select("g", "pos", "path", *kept, F.explode("s").alias("x"))
        path = F.concat("x.path", "path").alias("path")
        above = here.select("g", (F.col("pos") * width + F.col("x.slot")).alias("pos"), path, *kept, "x")
        if k:
            above = above.drop("x")
    return above.select("x.digest", *(F.col(f"x.{c}").alias(c) for c in carried), "path", *kept)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, x: digest(x["l"], acc, x["r"]))


def manifest(rows: DataFrame, id_col: str, group_col: str, fields: list[str], tampered: dict[str, Column] | None = None, fanout: int = 2) -> DataFrame:
    """One row per row: id, leaf, subroot, root, path (the siblings, leaf level first) and seen.

    ``fields`` are hashed in their order; ``seen`` is the leaf of the row as it is found later, with the columns
    of ``tampered`` in place of the original ones: ``folded(seen, path)`` shows whether it is still the row of the manifest.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    changed = tampered or {}
    seen = leaf_of([changed.get(f, F.col(f)) for f in fields])
    leaves = rows.select(
        F.col(id_col).alias("id"), group_key(F.col(group_col)).alias("g"), leaf_of([F.col(f) for f in fields]).alias("digest"), seen.alias("seen")
    )
    seen = F.unhex(F.when(F.col("seen") != F.col("digest"), F.col("seen"))).alias("seen")  # only where it differs
    # equal rows may come in any order; the salt lets a range end among them
    leaves = stored(leaves.select("id", "g", "digest", seen, F.monotonically_increasing_id().alias("salt")), "manifest-rows")
    placed = numbered(leaves, "g", ["id", "digest", "salt"], "manifest-leaves").drop("salt")
    below = climbed(placed, fanout, ["id", "seen"], "manifest")
    subroots = below[-1].select("g", F.col("up").alias("digest"), F.lit("").alias("all"))
    tops = numbered(subroots, "all", ["g"], "manifest-subroots")
    tops = tops.select(F.col("all").alias("g"), F.col("g").alias("group"), "pos", "size", "digest")
    high = climbed(tops, fanout, ["group"], "manifest-top")
    root = high[-1].select("g", F.lit(0).cast("long").alias("pos"), F.array().cast(PATH).alias("path"), F.col("up").alias("root"))
    subroots = descended(high, root, fanout, ["group"])
    subroots = subroots.select(F.col("group").alias("g"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    out = descended(below, stored(subroots, "manifest-ways"), fanout, ["id", "seen"])
    seen = F.coalesce(F.lower(F.hex("seen")), F.col("digest")).alias("seen")
    return out.select("id", F.col("digest").alias("leaf"), "subroot", "root", "path", seen)


def proof_digest(path: Column) -> Column:
    """One hash for all siblings of a path, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), ""), 256)


def verified(found: DataFrame) -> DataFrame:
    """The rows of ``manifest`` with proof_sha256, folded_root and verified."""
    out = found.withColumn("folded_root", folded(F.col("seen"), F.col("path")))
    return out.select(
        "id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
