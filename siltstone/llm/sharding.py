"""Sharding by a hierarchical weighted hash tree, in Spark's own functions.

A tree has three levels: regions hold racks, racks hold shards, and a shard
has a weight; a rack or region weighs what stands below it.  A row descends
the levels.  At each it draws, for every child, an exponential variate from a
hash of its key and the child's path, divided by the child's weight; the least
draw wins.  So a child gets its share of its parent's rows, and the draw of a
child depends on nothing but the key, its path and its weight: when a weight
changes, only the draws on the way down to that shard change, and rows move only
into or out of (or within) the subtrees whose weights changed.

`grown` gives a new shard a region of its own.  No other draw changes then,
hence rows move only into the new shard.  (A shard put into a rack that is there
already, see `reweighted`, also draws rows to the other shards of its region.)

A null key counts as the empty key.  Repeated rows and ties (equal keys) go to
one shard and have slots of their own there.  Empty tables give no rows; of the
columns only the key and the text are read, so others may have any name.  Null
and empty texts have size 1 and checksum 0; texts of any length are one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.storage import stored

#: region -> rack -> shard -> weight
Tree = dict[int, dict[int, dict[int, float]]]

#: Hex digits of a digest that make a draw: 52 bits, which a double holds exactly.
_DIGITS = 13


def balanced(shards: int, per_rack: int = 4, racks: int = 2) -> Tree:
    """Shards 0, 1, ... of weight 1, filling racks and regions in turn."""
    tree: Tree = {}
    for s in range(shards):
        rack = s // per_rack
        tree.setdefault(rack // racks, {}).setdefault(rack, {})[s] = 1.0
    return tree


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a rack and a region of its own."""
    racks = [k for region in tree.values() for k in region]
    shards = [s for region in tree.values() for rack in region.values() for s in rack]
    return {**tree, max(tree, default=-1) + 1: {max(racks, default=-1) + 1: {max(shards, default=-1) + 1: weight}}}


def reweighted(tree: Tree, region: int, rack: int, shard: int, weight: float) -> Tree:
    """The tree with another weight of a shard, which may be new there; a weight of 0 takes no rows."""
    inside = {**tree.get(region, {}), rack: {**tree.get(region, {}).get(rack, {}), shard: weight}}
    return {**tree, region: inside}


def _children(tree: Tree) -> list[dict[str, dict[str, float]]]:
    """For each level, the children's names and weights by the path of their parent."""
    regions: dict[str, dict[str, float]] = {"": {}}
    racks: dict[str, dict[str, float]] = {}
    shards: dict[str, dict[str, float]] = {}
    for g, inside in tree.items():
        racks[f"/{g}"] = {}
        for k, leaves in inside.items():
            own = {str(s): float(w) for s, w in leaves.items() if w > 0}
            if own:
                shards[f"/{g}/{k}"] = own
                racks[f"/{g}"][str(k)] = sum(own.values())
        if racks[f"/{g}"]:
            regions[""][str(g)] = sum(racks[f"/{g}"].values())
    return [regions, racks, shards]


def _draw(key: Column, path: Column, weight: Column) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), path)), 1, _DIGITS), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(16**_DIGITS)) / weight


def _below(path: Column, key: Column, children: Column) -> Column:
    """The path one level down; `path` is bound to a variable, so that it is worked out once and not for every child."""
    draws = lambda p: F.transform(F.element_at(children, p), lambda c: F.struct(_draw(key, F.concat(p, F.lit("/"), c["name"]), c["weight"]).alias("draw"), c["name"].alias("name")))
    return F.element_at(F.transform(F.array(path), lambda p: F.concat(p, F.lit("/"), F.array_min(draws(p))["name"])), 1)


def shard_of(key: Column | str, tree: Tree) -> Column:
    """The shard that a key descends to; null if no shard has any weight."""
    key = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    path = F.lit("")
    for level in _children(tree):
        known = {p: c for p, c in level.items() if c}
        if not known:
            return F.lit(None).cast("int")
        rows = [x for p, c in known.items() for x in (F.lit(p), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in c.items()]))]
        path = _below(path, key, F.create_map(*rows))
    return F.substring_index(path, "/", -1).cast("int")


def assigned(docs: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, grown_shard): size is UTF-8 bytes plus 1, grown_shard the place with one more shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        shard_of(key, tree).alias("shard"), shard_of(key, grown(tree)).alias("grown_shard"),
    )


def slotted(placed: DataFrame, order: list[str], shard: str = "shard") -> DataFrame:
    """Adds `slot`: each shard's rows numbered from 0 without gaps, in the given order.

    The rows are written sorted by shard and order, in ranges over all tasks; a number that each row
    gets beforehand parts equal ones, so no group of copies need go to one task.  A row's place in its file less
    the first place of its shard there, plus what the shard has in earlier files, is its slot.
    """
    clash = {"slot", "_row", "_file", "_at", "_first", "_before"} & set(placed.columns)
    if clash:
        raise ValueError(f"columns that slots need for themselves: {sorted(clash)}")
    fixed = stored(placed.withColumn("_row", F.monotonically_increasing_id()), "assigned")
    by = [shard, *order, "_row"]
    ranges = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), fixed.rdd.getNumPartitions())
    laid = stored(fixed.repartitionByRange(ranges, *by).sortWithinPartitions(*by).drop("_row"), "sorted")
    rows = laid.select(*placed.columns, F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    held = rows.groupBy(shard, "_file").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(shard).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(F.col(shard).alias("_shard"), F.col("_file").alias("_in"), "_first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    joined = rows.join(starts, (F.col(shard).eqNullSafe(F.col("_shard"))) & (F.col("_file") == F.col("_in")))
    return joined.select(*placed.columns, (F.col("_at") - F.col("_first") + F.col("_before")).cast("long").alias("slot"))


def _crc_table() -> list[int]:
    """What each byte adds to a CRC-32, by its reflected polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return table


def oracle(shards: int = 16) -> str:
    """DuckDB's SQL of the sharding of `documents`; the checksum is worked out byte by byte from its table of 256 values."""
    now, after = balanced(shards), grown(balanced(shards))

    def level_sql(tree: Tree, name: str) -> str:
        out, before = [], "keyed"
        for i, level in enumerate(_children(tree)):
            rows = ", ".join(f"('{p}', '{c}', {w}::double)" for p, children in level.items() for c, w in children.items())
            parent = "''" if not i else "b.path"
            out.append(
                f"{name}{i} as (select b.rid, b.key, c.parent || '/' || arg_min(c.child, -ln((('0x' || substr(md5(b.key || ':' || c.parent || '/' || c.child), 1, {_DIGITS}))::bigint::double + 0.5::double) / {16**_DIGITS}::double) / c.weight) as path "
                f"from {before} b join (values {rows}) c(parent, child, weight) on c.parent = {parent} group by b.rid, b.key, c.parent)"
            )
            before = f"{name}{i}"
        return ", ".join(out)

    return f"""
with keyed as (select row_number() over () as rid, doc_id, coalesce(doc_id::varchar, '') as key, encode(coalesce(text, '')) as body from documents),
{level_sql(now, "a")}, {level_sql(after, "b")},
summed as (
  select k.rid, k.doc_id, (octet_length(k.body) + 1)::bigint as size,
    xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(k.body), '..'), lambda x: ('0x' || x)::bigint)),
      lambda c, x: xor(c >> 8, {_crc_table()}[(xor(c, x) & 255) + 1])), 4294967295)::bigint as text_crc32
  from keyed k)
select s.doc_id, s.size, s.text_crc32, 'key' as law, split_part(a2.path, '/', 4)::int as shard,
  (row_number() over (partition by split_part(a2.path, '/', 4) order by s.doc_id nulls first, s.size, s.text_crc32) - 1)::bigint as slot,
  split_part(b2.path, '/', 4)::int as grown_shard
from summed s join a2 using (rid) join b2 using (rid)"""
