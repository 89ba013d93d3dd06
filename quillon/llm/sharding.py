"""Hierarchical weighted hash tree: a row descends region, rack and shard by weighted hash draws.

The law is ``key``: the document id and the tree decide, nothing else. At each level a child c of
weight w draws -ln(u)/w, u a hash of (key, path of c) in (0, 1), and the least draw wins; that is
an exponential race, so a child wins with probability w / sum of weights. When a weight changes,
only draws on the path to it change: rows move into or out of that subtree and nowhere else.
``grown`` opens a new region for a new shard, so that one more shard takes rows only into itself.

Defined cases: a null id is a key of its own; a null text has no bytes (size is the overhead, crc32
of nothing is 0); equal rows get the same shard and different slots; an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Bytes that a row costs besides its text.
ROW_OVERHEAD = 16
#: Sub-ranges of a shard that are numbered side by side; the table of their counts has shards x this rows.
SLOT_BUCKETS = 256
#: Parts that equal rows are numbered in, and rows from which a bucket of four times the mean is numbered so.
SALTS, LARGE_BUCKET = 64, 50_000


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(n_shards: int, racks: int = 2, shards_per_rack: int = 4) -> tuple[Shard, ...]:
    """Equal shards, filled region by region."""
    per_region = racks * shards_per_rack
    return tuple(Shard(i // per_region, i % per_region // shards_per_rack, i) for i in range(n_shards))


def grown(shards: tuple[Shard, ...], weight: float = 1.0) -> tuple[Shard, ...]:
    """One more shard, in a region of its own: no weight that rows have drawn under changes."""
    return (*shards, Shard(max(s.region for s in shards) + 1, 0, max(s.shard for s in shards) + 1, weight))


def _draw(path: Column, weight: Column) -> Column:
    """-ln(u) / weight; u has 52 bits and is never 0 or 1."""
    u = (F.conv(F.substring(F.md5(path), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    return -F.ln(u) / weight


def _winner(prefix: Column, weights: Column, width: int) -> Column:
    """Index of the least draw among the children of a node. weights: array; absent children have null."""
    draws = F.array(*[F.struct(_draw(F.concat(prefix, F.lit(f"/{i}")), F.get(weights, F.lit(i))).alias("d"), F.lit(i).alias("i")) for i in range(width)])
    return F.array_min(F.filter(draws, lambda x: x.d.isNotNull())).i


def _nested(values: list) -> Column:
    return F.array(*[_nested(v) if isinstance(v, list) else F.lit(v) for v in values])


def place(df: DataFrame, key: Column, shards: tuple[Shard, ...], out: str) -> DataFrame:
    """Adds column ``out``: the shard that key descends to."""
    by: dict[int, dict[int, list[Shard]]] = {}
    for s in shards:
        by.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    regions = sorted(by)
    width = max(len(racks) for racks in by.values())
    depth = max(len(leaves) for racks in by.values() for leaves in racks.values())
    pad = lambda xs, n, none: xs + [none] * (n - len(xs))
    none = float("nan")
    leaf_w, leaf_id, rack_w, region_w = [], [], [], []
    for r in regions:
        racks = [by[r][k] for k in sorted(by[r])]
        leaf_w.append(pad([pad([s.weight for s in leaves], depth, none) for leaves in racks], width, [none] * depth))
        leaf_id.append(pad([pad([s.shard for s in leaves], depth, -1) for leaves in racks], width, [-1] * depth))
        rack_w.append(pad([sum(s.weight for s in leaves) for leaves in racks], width, none))
        region_w.append(sum(s.weight for leaves in racks for s in leaves))
    known = lambda ws: F.transform(ws, lambda w: F.when(~F.isnan(w), w))
    # An absent child's weight is null, so its draw is null and it can't win.
    a, b, c = f"__{out}_region", f"__{out}_rack", f"__{out}_leaf"
    df = df.withColumn(a, _winner(key, _nested(region_w), len(regions)))
    df = df.withColumn(b, _winner(F.concat(key, F.lit("/"), F.col(a)), known(F.get(_nested(rack_w), F.col(a))), width))
    df = df.withColumn(c, _winner(F.concat(key, F.lit("/"), F.col(a), F.lit("/"), F.col(b)), known(F.get(F.get(_nested(leaf_w), F.col(a)), F.col(b))), depth))
    return df.withColumn(out, F.get(F.get(F.get(_nested(leaf_id), F.col(a)), F.col(b)), F.col(c)).cast("int")).drop(a, b, c)


def shard_documents(docs: DataFrame, n_shards: int = 40, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of docs.

    Texts are read once and never shuffled. Slots are gapless without a sort of a whole shard: a
    shard's rows fall into SLOT_BUCKETS hash ranges, each is numbered by itself, and the counts of
    the ranges before it (n_shards x SLOT_BUCKETS rows, so a broadcast has a fixed bound) are added.
    The hash is of all that a row shows, so ids that repeat or are null spread over the ranges; rows
    that are the same in everything fill a range of their own and are numbered in SALTS parts.
    """
    now, then = tree(n_shards), grown(tree(n_shards))
    content = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.length(content) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(content).cast("long").alias("text_crc32"),
        key.alias("__key"),
    )
    shown = F.md5(F.concat_ws(":", F.lit("slot"), "__key", F.col("text_crc32").cast("string"), F.col("size").cast("string")))
    rows = rows.withColumn("bucket", F.conv(F.substring(shown, 1, 2), 16, 10).cast("int")).withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    rows = place(place(rows, F.col("__key"), now, "shard"), F.col("__key"), then, "grown_shard").drop("__key")
    rows = written(rows, "shards")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("count")), "slot-counts")
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("n", F.row_number().over(within))
    mean = counts.agg(F.avg("count")).first()[0] or 0
    full = F.broadcast(counts.filter(F.col("count") > max(LARGE_BUCKET, 4 * mean)).select("shard", "bucket"))
    if full.limit(1).count():
        numbered = rows.join(full, ["shard", "bucket"], "left_anti").withColumn("n", F.row_number().over(within)).unionByName(_in_parts(rows.join(full, ["shard", "bucket"])))
    return numbered.join(F.broadcast(starts), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("n") - 1).cast("long").alias("slot"), "grown_shard"
    )


def _in_parts(rows: DataFrame) -> DataFrame:
    """Adds n, the number of a row in its (shard, bucket), where few rows are different but some are there very often.

    Equal rows may be numbered in any order, so their salts divide them: parts are counted map-side,
    the counts of the parts before are added, and each part is numbered by itself.
    """
    same = ["shard", "bucket", "doc_id", "text_crc32", "size", "salt"]
    earlier = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*same).count().select(*[F.col(c).alias(f"__{c}") for c in same], F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__before"))
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy(*same).orderBy("grown_shard")))
    matched = F.lit(True)
    for c in same:
        matched &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return numbered.join(parts, matched).withColumn("n", F.col("n") + F.col("__before")).select(*rows.columns, "n")


def oracle(n_shards: int = 40) -> str:
    """The same in DuckDB; crc32 is folded bytewise over its 256-entry table, built from the polynomial."""
    def winner(src: str, prefix: str, children: str, out: str) -> str:
        return f"arg_min({out}, -ln((('0x' || substr(md5({prefix}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / w)"
    return f"""
WITH RECURSIVE leaves AS (SELECT i AS shard, i // 8 AS region, i % 8 // 4 AS rack, i % 4 AS leaf, i < {n_shards} AS old FROM range({n_shards} + 1) t(i)),
grown AS (SELECT shard, CASE WHEN old THEN region ELSE (SELECT max(region) + 1 FROM leaves WHERE old) END AS region,
                 CASE WHEN old THEN rack ELSE 0 END AS rack, CASE WHEN old THEN leaf ELSE 0 END AS leaf, old FROM leaves),
trees AS (SELECT *, g FROM grown, (VALUES (0), (1)) x(g) WHERE old OR g = 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(text, '') AS t FROM documents),
regions AS (SELECT g, region, count(*)::DOUBLE AS w FROM trees GROUP BY ALL),
racks AS (SELECT g, region, rack, count(*)::DOUBLE AS w FROM trees GROUP BY ALL),
r1 AS (SELECT rid, k, g, {winner('', "k || '/' || region", '', 'region')} AS region FROM d, regions GROUP BY rid, k, g),
r2 AS (SELECT rid, k, r1.g, r1.region, {winner('', "k || '/' || r1.region || '/' || rack", '', 'rack')} AS rack FROM r1 JOIN racks USING (g, region) GROUP BY rid, k, r1.g, r1.region),
r3 AS (SELECT rid, g, {winner('', "k || '/' || region || '/' || rack || '/' || leaf", '', 'shard').replace('/ w)', '/ 1.0)')} AS shard FROM r2 JOIN trees USING (g, region, rack) GROUP BY rid, g),
step AS (SELECT i, 0 AS n, i::BIGINT AS c FROM range(256) t(i) UNION ALL SELECT i, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE n < 8),
crctab AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE n = 8),
sized AS (SELECT rid, doc_id, k, octet_length(encode(t)) + 16 AS size, encode(t) AS b, hex(encode(t)) AS h FROM d),
crcs AS (SELECT rid, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(b)), lambda i: ('0x' || substr(h, 2 * i::INT + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM sized, crctab)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, a.shard::INT AS shard,
       (row_number() OVER (PARTITION BY a.shard ORDER BY ('0x' || substr(md5('slot:' || k || ':' || crc || ':' || size), 1, 2))::INT, doc_id NULLS FIRST, crc, size) - 1)::BIGINT AS slot, z.shard::INT AS grown_shard
FROM sized JOIN crcs USING (rid) JOIN r3 a ON a.rid = sized.rid AND a.g = 0 JOIN r3 z ON z.rid = sized.rid AND z.g = 1"""
