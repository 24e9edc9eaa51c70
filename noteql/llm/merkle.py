"""Merkle manifest of a dataset: a tree of SHA-256 over the rows of every group, one over the groups' roots, and proofs.

A row is a leaf. Every two consecutive nodes of a level become the hash of both, an odd last one the hash of itself,
until one remains: the group's subroot. The subroots, in order of their groups, become the root the same way.

Levels are windows by group and parent index. The ordered list over a window's full frame holds the nodes of one
parent, so it is the parent's preimage and has a node's sibling as well. Only the first row under a parent speaks for
it at the next level. Blocks of ``2 ** HEIGHT`` rows go through that many levels in one exchange, as the windows of
all of them lie within a block; then one row a block goes on. A leaf's proof joins its block's by the block, so long
proofs are never shuffled with the leaves.

Equal rows are leaves of their own and stand next to each other; a null id comes first in its group, a null group first
of the groups. Texts of any length are hashed where they are read and do not travel. An empty table gives an empty
result. Columns of the input that are not named as fields are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, read

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of one exchange. A window holds 2 ** HEIGHT rows at most.
HEIGHT = 10
_STEPS = "array<struct<left:string,right:string>>"
_LOW_BITS = (1 << 33) - 1


def field_text(value) -> F.Column:
    """``-`` for a null, else byte count, ``:``, value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(values: list) -> F.Column:
    return F.sha2(F.concat(*(field_text(v) for v in values)), 256)


def number(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, int]:
    """Adds ``idx``, a row's number within its group from 0 on, and ``size``, the group's rows; returns the size of the
    largest group as well. Rows go to ranges of
    (group, order), so a group of any size is spread over many tasks; each range starts from the sum of those before."""
    spark = rows.sparkSession
    keys = [group, *order, "row"]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).drop("row")
    # Ranges are sampled, so their rows are written out before they are counted.
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS))))
    runs = materialize(dealt.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).withColumn("size", F.sum("n").over(Window.partitionBy(group)))
    most = runs.groupBy(group).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    return dealt.join(starts.drop("first", "n"), [group, "part"]).withColumn("idx", F.col("start") + F.col("at")).drop("part", "at", "start"), most


def _climb(nodes: DataFrame, height: int) -> DataFrame:
    """``height`` levels within blocks: ``h`` becomes the hash above, ``steps`` the siblings left and right on the way."""
    rest = [c for c in nodes.columns if c not in ("g", "idx", "size", "h")]
    out = nodes.select("g", "idx", "size", "h", F.shiftrightunsigned("idx", height).alias("block"), F.array().cast(_STEPS).alias("steps"), *rest)
    out = out.repartition(partitions(nodes.sparkSession), "g", "block")
    for k in range(height):
        parent = F.shiftrightunsigned("idx", k + 1).alias("parent")
        first = F.col("idx").bitwiseAND(F.lit((1 << k) - 1)) == 0
        frame = Window.partitionBy("g", "block", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = out.select("*", parent).withColumn("run", F.collect_list(F.when(first, F.col("h"))).over(frame))
        grows = F.ceil(F.col("size") / F.lit(float(1 << k))) > 1
        right = F.shiftrightunsigned("idx", k).bitwiseAND(F.lit(1)) == 1
        step = F.struct(
            F.when(right, F.col("run")[0]).otherwise("").alias("left"),
            F.when(~right & (F.size("run") > 1), F.get("run", F.lit(1))).otherwise("").alias("right"),
        )
        steps = F.when(grows, F.concat("steps", F.array(step))).otherwise(F.col("steps")).alias("steps")
        above = F.when(grows, F.sha2(F.array_join("run", ""), 256)).otherwise(F.col("h")).alias("h")
        out = out.select("g", "idx", "size", above, "block", steps, *rest)
    return out


def prove(nodes: DataFrame, most: int, height: int = HEIGHT) -> DataFrame:
    """Nodes (g, idx, size, h and any more; ``most`` in the largest group) with ``top``, the hash their group comes to,
    and ``steps``, the siblings up to it."""
    height = max(1, min(height, (most - 1).bit_length()))
    climbed = _climb(nodes, height)
    if most <= 1 << height:
        return climbed.withColumnRenamed("h", "top").drop("block")
    blocks = climbed.where(F.col("idx").bitwiseAND(F.lit((1 << height) - 1)) == 0)
    blocks = materialize(blocks.select("g", F.col("block").alias("idx"), F.ceil(F.col("size") / F.lit(float(1 << height))).cast("long").alias("size"), "h"))
    above = prove(blocks, -(-most >> height), height).select("g", F.col("idx").alias("block"), F.col("steps").alias("more"), "top")
    joined = climbed.drop("h").join(above, ["g", "block"])
    return joined.withColumn("steps", F.concat("steps", "more")).drop("more", "block")


def fold(claimed, steps) -> F.Column:
    """The root that a leaf and its siblings come to."""
    return F.aggregate(steps, claimed, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def manifest(docs: DataFrame, fields=FIELDS, id_col="doc_id", group_col="lang", claimed: list | None = None, height: int = HEIGHT) -> DataFrame:
    """id_col, leaf, subroot, root, steps (siblings left and right, level by level), proof_sha256, folded_root and
    verified for each row. ``claimed`` are the values, one for each field, of the row that is checked against the
    manifest; none: the row itself. ``verified`` tells whether what was claimed leads to the root."""
    own = [F.col(c) for c in fields]
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-"))  # orders nulls first
    rows = docs.select(F.col(id_col).alias("id"), group.alias("g"), leaf(own).alias("leaf"), (leaf(claimed) if claimed else leaf(own)).alias("claimed"))
    numbered, most = number(materialize(rows), "g", ["id", "leaf"])
    proved = prove(numbered.withColumn("h", F.col("leaf")), most, height)
    roots = materialize(proved.where("idx = 0").select("g", "top"))
    tops, groups = number(roots.select(F.lit("").alias("all"), F.col("g").alias("of"), F.col("top").alias("h")), "all", ["of"])
    above = prove(tops.withColumnRenamed("all", "g"), groups, height).select(F.col("of").alias("g"), F.col("top").alias("root"), F.col("steps").alias("more"))
    # One row a group.
    out = proved.join(materialize(above), "g").withColumn("steps", F.concat("steps", "more"))
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = out.select(F.col("id").alias(id_col), "leaf", F.col("top").alias("subroot"), "root", "steps", proof.alias("proof_sha256"), fold(F.col("claimed"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampers with n_chars where 7 divides the id's checksum; a row of a null id is left as it is."""
    docs = read(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    claimed = [F.col(c) for c in FIELDS]
    claimed[FIELDS.index("n_chars")] = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return manifest(docs, claimed=claimed).drop("steps")


def _hash_sql(n_chars: str) -> str:
    fields = ["doc_id::varchar", "source", "lang", f"({n_chars})::varchar", "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen({f})::varchar || ':' || {f}, '-')" for f in fields) + ")"


#: The lists of all levels, a group or the groups' own ('' as name) at a time; CRC-32 by its table.
ORACLE = f"""
with recursive bytes as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) order by i) as t from range(256) r(i)
), docs as (
  select *, coalesce('=' || lang, '-') as g, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc from documents, bytes
), leaves as (
  select doc_id, g, {_hash_sql("n_chars")} as leaf, case when doc_id is not null and crc % 7 = 0 then {_hash_sql("n_chars + 1")} else {_hash_sql("n_chars")} end as claimed from docs
), placed as (
  select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as idx from leaves
), levels as (
  select g, 0 as k, list(leaf order by idx) as nodes from placed group by g
  union all
  select g, k + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(array_to_string(nodes[i:i + 1], ''))) from levels where len(nodes) > 1
), subroots as (
  select g, nodes[1] as subroot, row_number() over (order by g) - 1 as gidx, (select max(k) from levels m where m.g = l.g) as depth from levels l where len(nodes) = 1
), tops as (
  select 0 as k, list(subroot order by gidx) as nodes from subroots
  union all
  select k + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(array_to_string(nodes[i:i + 1], ''))) from tops where len(nodes) > 1
), steps as (
  select p.doc_id, p.leaf, p.idx, p.g, l.k as k, (p.idx >> l.k) % 2 as bit, l.nodes[xor(p.idx >> l.k, 1) + 1] as sibling from placed p join levels l on p.g = l.g where len(l.nodes) > 1
  union all
  select p.doc_id, p.leaf, p.idx, p.g, s.depth + t.k, (s.gidx >> t.k) % 2, t.nodes[xor(s.gidx >> t.k, 1) + 1] from placed p join subroots s on p.g = s.g cross join tops t where len(t.nodes) > 1
), proofs as (
  select g, idx, sha256(string_agg(coalesce(sibling, ''), '' order by k)) as proof, list({{'bit': bit, 's': coalesce(sibling, '')}} order by k) as path from steps group by g, idx
), folded as (
  select g, idx, 0 as k, claimed as h, 0 as n from placed
  union all
  select f.g, f.idx, f.k + 1, case when path[f.k + 1].bit = 1 then sha256(path[f.k + 1].s || h) else sha256(h || path[f.k + 1].s) end, len(path) from folded f join proofs using (g, idx) where f.k < len(path)
), ends as (
  select g, idx, last(h order by k) as folded_root from folded group by g, idx
)
select p.doc_id, p.leaf, s.subroot, r.nodes[1] as root, coalesce(q.proof, sha256('')) as proof_sha256, e.folded_root, e.folded_root = r.nodes[1] as verified
from placed p join subroots s using (g) join ends e on e.g = p.g and e.idx = p.idx left join proofs q on q.g = p.g and q.idx = p.idx cross join (select nodes from tops where len(nodes) = 1) r
"""
