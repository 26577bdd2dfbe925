"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Only the sums of the sources come to the driver. There targets are found by filling the sources up to
their caps, and the blocks of the mix go to the highest quotients target / (2 * blocks so far + 1). The
method is house-monotone, so the quotas of the first k shards of the mix are those of a smaller mix, and
each shard has an integer quota of blocks of each source.

The documents of a source are laid out in a seeded order as a stream of words cut into blocks. Each shard
selects its quota there: while the quotas last for a whole pass over the stream the shards share it out
among them, and in the pass that is left each shard takes its blocks at a seeded place of its own, none of
them twice. The blocks of a shard stand side by side, so documents stay whole but at the ends of these segments.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from rastrum.session import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUDGET = 1.5  # words of the mix for each word there is
CAP = 2  # times that a source may be repeated
BLOCK = 64
SEED = 17
SHARDS = 8  # shards of the mix that have quotas of their own
MAX_SOURCES = 1_000_000  # sums and quotas of sources are held on the driver, about a kilobyte each; more than these are refused
BUCKET_ROWS = 500
GROUP = 1024  # buckets that are summed in one task


def fill(sizes: Sequence[int], weights: Sequence[float], total: float, cap: float = CAP) -> list[float]:
    """Targets in proportion to the weights, none above cap times its size, the excess reshared by weight."""
    order = sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i))
    capped, rest = 0.0, float(sum(weights))
    for i in order:
        level = (total - capped) / rest
        if cap * sizes[i] / weights[i] >= level:
            return [min(float(cap * s), w * level) for s, w in zip(sizes, weights, strict=True)]
        capped += cap * sizes[i]
        rest -= weights[i]
    return [float(cap * s) for s in sizes]


def sainte_lague(votes: Sequence[float], seats: int, divisor: float) -> list[int]:
    """Seats by highest quotients votes / (2 * seats + 1); ties go to the earlier.

    It starts from the rounded votes / divisor and moves the few seats that are too many or missing, which
    gives the same seats as awarding all of them one by one.
    """
    quota = [int(v / divisor + 0.5) for v in votes]
    missing = seats - sum(quota)
    if missing > 0:
        heap = [(-v / (2 * q + 1), i) for i, (v, q) in enumerate(zip(votes, quota, strict=True)) if v > 0]
        heapq.heapify(heap)
        for _ in range(missing if heap else 0):
            _, i = heap[0]
            quota[i] += 1
            heapq.heapreplace(heap, (-votes[i] / (2 * quota[i] + 1), i))
    else:
        heap = [(v / (2 * q - 1), -i) for i, (v, q) in enumerate(zip(votes, quota, strict=True)) if q]
        heapq.heapify(heap)
        for _ in range(-missing):
            _, i = heapq.heappop(heap)
            i = -i
            quota[i] -= 1
            if quota[i]:
                heapq.heappush(heap, (votes[i] / (2 * quota[i] - 1), -i))
    return quota


def shard_quotas(targets: Sequence[float], shards: int, block: int = BLOCK) -> list[list[int]]:
    """Blocks of each source in each shard: the differences of the mixes of the first k shards."""
    seats = int(sum(targets) / block + 0.5)
    before, out = [0] * len(targets), []
    for k in range(1, shards + 1):
        now = sainte_lague(targets, seats * k // shards, block * shards / k)
        out.append([a - b for a, b in zip(now, before, strict=True)])
        before = now
    return out


def segments(key: str, blocks: int, quotas: Sequence[int], seed: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of the blocks that the shards select from a source's stream, none twice in a pass."""
    total, out, before = min(sum(quotas), CAP * blocks), [], 0
    places = sorted(int(hashlib.md5(f"{seed}:{key}:{k}".encode()).hexdigest()[:8], 16) for k in range(len(quotas)))
    for k, quota in enumerate(quotas):
        upto = min(before + quota, total)
        for j in range(CAP):
            first, last = max(before, j * blocks) - j * blocks, min(upto, (j + 1) * blocks) - j * blocks
            # what the last pass leaves free lies between the shards' blocks
            gap = places[k] * max(0, (j + 1) * blocks - total) >> 32
            if first < last:
                out.append((k, first + gap, last + gap))
        before = upto
    return out


def text_tag(text_col: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tag")


def _key(c) -> F.Column:
    """A source as a key that is never null: "=" before the name, or nothing for null."""
    return F.coalesce(F.concat(F.lit("="), c), F.lit(""))


def plan(sums: list[tuple[str, int]], block: int, seed: int, shards: int) -> list[tuple]:
    """(key, source_size, target, selected segments) for (key, words)."""
    sums = sorted(sums, key=lambda s: (s[0] == "", s[0]))
    sizes = [n for _, n in sums]
    weights = [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(sums))]
    targets = fill(sizes, weights, BUDGET * sum(sizes)) if sum(sizes) else [0.0] * len(sums)
    quotas = zip(*shard_quotas(targets, shards, block), strict=True) if sums else []
    return [(key, n, target, segments(key, -(-n // block), quota, seed)) for (key, n), target, quota in zip(sums, targets, quotas, strict=True)]


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = SEED, shards: int = SHARDS) -> DataFrame:
    """tag, key, doc_id, size, source_size, target, taken, start and selected.

    One row for each row of docs. size is the number of words; a null text has none. Null is a source of
    its own, the last. Rows with equal ids are documents of their own; equal rows are taken in any order.
    The order in a source is that of a seeded hash of the id, so reruns agree. start is the document's
    place in its source's stream; tag is a hash of the text; selected has the segments of the source's
    stream (shard, from, to, in blocks) that the shards take. An empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = checkpoint(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), _key(F.col(source_col)).alias("key"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), text_tag(text_col)
        ).withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    )
    sums = rows.groupBy("key").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    buckets = max([1, *(-(-s["rows"] // BUCKET_ROWS) for s in sums)])
    given = spark.createDataFrame(plan([(s["key"], s["n"]) for s in sums], block, seed, shards), "key string, source_size long, target double, selected array<struct<shard: int, from: long, to: long>>")
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / F.lit(float(1 << 32))).cast("long"))
    # places of buckets by two levels of sums, so that no task has all buckets of a source; the plan goes to the buckets, not to the rows
    before = lambda n, *keys: F.sum(n).over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1])) - F.col(n)
    level = rows.groupBy("key", "bucket").agg(F.sum("size").alias("n")).withColumn("group", F.floor(F.col("bucket") / GROUP))
    groups = level.groupBy("key", "group").agg(F.sum("n").alias("n")).select("key", "group", before("n", "key", "group").alias("offset"))
    level = level.select("key", "group", "bucket", before("n", "key", "group", "bucket").alias("before")).join(groups, ["key", "group"]).join(given, "key")
    here = F.sum("size").over(Window.partitionBy("key", "bucket").orderBy("h", "doc_id", "size", "tag").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = rows.withColumn("here", here).join(level, ["key", "bucket"]).withColumn("start", F.col("offset") + F.col("before") + F.col("here"))
    overlap = lambda x: F.greatest(F.lit(0), F.least(x["to"] * block, F.col("start") + F.col("size")) - F.greatest(x["from"] * block, F.col("start")))
    taken = F.aggregate("selected", F.lit(0).cast("long"), lambda n, x: n + overlap(x))
    return placed.select("tag", "key", "doc_id", "size", "source_size", "target", taken.alias("taken"), "start", "selected")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars", block: int = BLOCK, seed: int = SEED, shards: int = SHARDS) -> DataFrame:
    """The mix itself, in the columns of docs: a row for each time that a shard takes a document.

    A document within a shard's segment is taken whole; of one at an end of it only the words in the
    segment are taken, joined by single spaces. Documents of which nothing is taken go, as do those
    without words, null texts among them. Null ids, null sources and repeated rows are documents like any
    other. The column of lengths is made anew. An empty table gives an empty result.
    """
    same = Window.partitionBy("id", "tag", "key").orderBy(F.lit(1))
    plan_of = mixture(docs, id_col, text_col, source_col, block, seed, shards).where("taken > 0").withColumnRenamed("doc_id", "id")
    plan_of = plan_of.withColumn("copy", F.row_number().over(same))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), text_tag(text_col), _key(F.col(source_col)).alias("key")).withColumn("copy", F.row_number().over(same))
    joined = rows.alias("r").join(plan_of.alias("p"), F.col("r.id").eqNullSafe(F.col("p.id")) & (F.col("r.tag") == F.col("p.tag")) & (F.col("r.key") == F.col("p.key")) & (F.col("r.copy") == F.col("p.copy")))
    spans = F.transform("selected", lambda s: F.struct(F.greatest(s["from"] * block - F.col("start"), F.lit(0)).cast("int").alias("x"), F.least(s["to"] * block - F.col("start"), F.col("size")).cast("int").alias("y")))
    joined = joined.select("row", "size", F.filter(spans, lambda s: s["x"] < s["y"]).alias("spans"))
    cut = F.exists("spans", lambda s: s["y"] - s["x"] < F.col("size"))
    joined = joined.withColumn("words", F.when(cut, F.regexp_extract_all(F.col("row")[text_col], F.lit(WORD), F.lit(0))))
    texts = F.transform("spans", lambda s: F.when(s["y"] - s["x"] == F.col("size"), F.col("row")[text_col]).otherwise(F.array_join(F.slice("words", s["x"] + 1, s["y"] - s["x"]), " ")))
    out = joined.select("row", F.explode(texts).alias("t"))
    made = {text_col: F.col("t")} | ({length_col: F.length("t")} if length_col in docs.columns else {})
    return out.select(*[(made[c] if c in made else F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


ORACLE = r"""
with d as (select row_number() over () as k, doc_id, case when source is null then '' else '=' || source end as key,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size, md5('17:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
s as (select key, cast(sum(size) as bigint) as n from d group by key),
w as (select *, row_number() over (order by key = '', key) as i, 1.5 * sum(n) over () as total from s),
v as (select *, cast([3, 1, 2][((i - 1) % 3) + 1] as double) as weight from w),
c as (select *, coalesce(sum(2.0 * n) over (order by 2 * n / weight, i rows between unbounded preceding and 1 preceding), 0) as capped,
    sum(weight) over () - coalesce(sum(weight) over (order by 2 * n / weight, i rows between unbounded preceding and 1 preceding), 0) as rest from v),
f as (select min_by((total - capped) / rest, 2 * n / weight) as level from c where 2 * n / weight >= (total - capped) / rest and total > 0),
t as (select v.*, case when total > 0 then least(2.0 * n, weight * coalesce((select level from f), 1e300)) else 0.0 end as target from v),
z as (select *, cast(floor(sum(target) over () / 64.0 + 0.5) as bigint) as seats from t),
q as (select *, cast(floor(target / (64.0 * 8 / k) + 0.5) as bigint) as q0, seats * k // 8 as want from z, (select unnest(range(1, 9)) as k)),
m as (select *, want - sum(q0) over (partition by k) as missing from q),
up as (select k, i, missing, target / (2 * (q0 + x) + 1) as p from (select *, unnest(range(0, cast(greatest(missing, 0) as bigint))) as x from m) where target > 0),
up2 as (select k, i, count(*) as more from (select *, row_number() over (partition by k order by p desc, i) as r from up) where r <= missing group by k, i),
dn as (select k, i, missing, target / (2 * (q0 - x) - 1) as p from (select *, unnest(range(0, cast(least(greatest(-missing, 0), q0) as bigint))) as x from m)),
dn2 as (select k, i, count(*) as less from (select *, row_number() over (partition by k order by p, i desc) as r from dn) where r <= -missing group by k, i),
b as (select m.*, cast(ceil(n / 64.0) as bigint) as blocks, least(q0 + coalesce(more, 0) - coalesce(less, 0), 2 * cast(ceil(n / 64.0) as bigint)) as upto from m left join up2 using (k, i) left join dn2 using (k, i)),
g as (select *, max(upto) over (partition by i) as last, coalesce(lag(upto) over (partition by i order by k), 0) as before,
    list_sort(list_transform(range(0, 8), lambda x: cast('0x' || substr(md5('17:' || key || ':' || x), 1, 8) as bigint)))[k] as place from b),
o as (select *, greatest(before, j * blocks) - j * blocks as a, least(upto, (j + 1) * blocks) - j * blocks as z, cast(cast(place as hugeint) * cast(greatest(0, (j + 1) * blocks - last) as hugeint) >> 32 as bigint) as gap from g, (select unnest([0, 1]) as j)),
e as (select d.*, t.n, t.target, sum(d.size) over (partition by d.key order by d.h, d.doc_id, d.size, d.k) - d.size as start from d join t using (key))
select doc_id, size, n as source_size, round(target, 6) as target,
  cast(coalesce((select sum(greatest(0, least((o.z + o.gap) * 64, e.start + e.size) - greatest((o.a + o.gap) * 64, e.start))) from o where o.key = e.key and o.a < o.z), 0) as bigint) as taken
from e
"""
