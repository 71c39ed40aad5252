"""Mixing sources to target weights, without drawing any document twice.

Each source's quota of documents is cut into blocks. A splitting tree shares the
blocks of all sources out among output shards: at each node a multivariate
hypergeometric draw decides which of its blocks go left, and the rest go right,
so that every leaf's make-up is that of an exact random deal. Draws are seeded
by node, so a task works out its own shards by walking down from the root.

A source's documents are put in a random order by hash; its blocks are runs of
that order, hence ranges of the hash, found by exact ranks over ids alone. Where a
cut falls between rows of one hash (repeated rows), it also says how many of them
lie before it, and only there rows are numbered. Texts then move once, to their
shard, where they are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.common import cut, fresh, load
from tributary.llm.common import quoted as _quoted

#: Target weights are document counts to this power, where none are given.
POWER = 0.5
SHARD_ROWS, BLOCK, SEED = 4096, 16, 20_111
#: Rows that one task ranks, and blocks that numpy's draws can deal with.
RANK_ROWS, MOST_BLOCKS = 200_000, 500_000_000


def quotas(counts: dict[str, int], weights: dict[str, float] | None = None, total: int | None = None, power: float = POWER, fill: bool = False) -> dict[str, int]:
    """Documents to draw from each source.

    The total is ``total``, or the most that no source falls short of; shares are
    rounded by largest remainders, ties to the source that sorts first. A source
    without weight gets none. More than there is raises an error. With ``fill``,
    no source bounds the total: one that falls short gives all it has, the others
    share the rest by their weights, and the total is at most, and by default, all
    documents of the sources with a weight.
    """
    raw = {s: float(n) ** power for s, n in counts.items()} if weights is None else {s: float(weights.get(s, 0)) for s in counts}
    if any(w < 0 or not math.isfinite(w) for w in raw.values()):
        raise ValueError("weights must be finite and not negative")
    whole = sum(raw.values())
    if not whole:
        return dict.fromkeys(counts, 0)
    if fill:
        there = sum(counts[s] for s, w in raw.items() if w)
        goal, given = there if total is None else min(total, there), {}
        while short := {s: counts[s] for s in raw if s not in given and raw[s] and (goal - sum(given.values())) * raw[s] >= counts[s] * sum(w for t, w in raw.items() if t not in given)}:
            given |= short
        rest = quotas({s: n for s, n in counts.items() if s not in given}, {s: w for s, w in raw.items() if s not in given}, goal - sum(given.values()))
        return {s: given.get(s, rest.get(s, 0)) for s in counts}
    share = {s: w / whole for s, w in raw.items()}
    most = total if total is not None else min(int(counts[s] / p + 1e-9) for s, p in share.items() if p)
    out = {s: int(most * p) for s, p in share.items()}
    for s in sorted(share, key=lambda s: (out[s] - most * share[s], s))[: most - sum(out.values())]:
        out[s] += 1
    if total is None:
        out = {s: min(n, counts[s]) for s, n in out.items()}
    if short := [s for s, n in out.items() if n > counts[s]]:
        raise ValueError(f"too few documents in: {sorted(short)[:5]}")
    return out


def leaf(blocks: np.ndarray, shards: int, shard: int, seed: int) -> np.ndarray:
    """Blocks of each source that the tree deals to a shard."""
    low, high, own, node = 0, shards, blocks, 1
    while high - low > 1:
        middle = low + (high - low) // 2
        total = int(own.sum())
        left = total * (middle - low) // (high - low)
        drawn = np.random.default_rng([seed, node]).multivariate_hypergeometric(own, left, method="marginals") if total else own
        if shard < middle:
            high, own, node = middle, drawn, 2 * node
        else:
            low, own, node = middle, own - drawn, 2 * node + 1
    return own


def mix(
    df: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, power: float = POWER, shard_rows: int = SHARD_ROWS,
    block: int = BLOCK, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", manifest: tuple[str, str] = ("shard", "position"), fill: bool = False,
) -> DataFrame:
    """The drawn rows with all columns of ``df``, their shard and place in it, ordered within partitions.

    Both new columns get a leading ``_`` where ``df`` has one of their name. A null
    source is the source ''. Quotas are met exactly: of rows that agree in id and text
    as many are drawn as fall before the cut, by the hash of their other columns;
    null ids and texts count as values. ``fill`` is that of :func:`quotas`. Beyond
    ``MOST_BLOCKS`` blocks, blocks hold more documents than ``block``. An empty table,
    or weights that are all zero, give an empty one.
    """
    spark = df.sparkSession
    source, h, cell, copy, shard, position = fresh(df, "own_source", "own_hash", "own_cell", "own_copy", *manifest)
    keyed = df.withColumn(source, F.coalesce(F.col(_quoted(source_column)).cast("string"), F.lit("")))
    keyed = keyed.withColumn(h, F.xxhash64(F.lit(seed), F.col(_quoted(id_column)), F.col(_quoted(text_column))))
    keys = cut(spark, keyed.select(F.col(source).alias("source"), F.col(h).alias("h")), "mixing")
    counts = {r["source"]: r["count"] for r in keys.groupBy("source").count().collect()}  # a row a source
    own = quotas(counts, weights, total, power, fill)
    names = sorted(s for s, n in own.items() if n)
    drawn = sum(own.values())
    if not drawn:
        return df.limit(0).withColumns({shard: F.lit(0), position: F.lit(0)})
    block = max(block, -(-drawn // MOST_BLOCKS))
    shards = -(-drawn // shard_rows)
    blocks = np.array([-(-own[s] // block) for s in names], np.int64)

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in batch.column(0).to_pylist():
                got = leaf(blocks, shards, k, seed)
                which = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(np.full(len(which), k, np.int64)), pa.array(got[which])], names=["place", "shard", "blocks"])

    listed = spark.createDataFrame([(i, s, own[s]) for i, s in enumerate(names)], "place bigint, source string, quota bigint")
    by_source = Window.partitionBy("source").orderBy("shard")
    until = F.least(F.sum("blocks").over(by_source) * block, F.col("quota"))
    dealt = spark.range(shards).mapInArrow(deal, "place bigint, shard bigint, blocks bigint").join(listed, "place")
    dealt = dealt.select("source", "shard", "quota", until.alias("until"))
    since = F.coalesce(F.lag("until").over(by_source), F.lit(0))
    points = dealt.select("source", "shard", since.alias("rank"))
    points = points.unionByName(listed.select("source", F.lit(None).cast("bigint").alias("shard"), F.col("quota").alias("rank")))

    bits = max(0, math.ceil(math.log2(max(counts.values()) / RANK_ROWS))) if max(counts.values()) > RANK_ROWS else 0
    run = F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("bigint")
    runs = keys.withColumn("run", run)
    before = runs.groupBy("source", "run").count()
    before = before.select("source", "run", F.coalesce(F.sum("count").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    tied = Window.partitionBy("source", "run").orderBy("h")
    within, first = F.row_number().over(tied) - 1, F.rank().over(tied) - 1
    ranked = runs.withColumn("within", within).withColumn("copy", F.col("within") - first).join(before, ["source", "run"])
    ranked = ranked.select("source", (F.col("before") + F.col("within")).alias("rank"), "h", "copy")
    cuts = points.join(ranked, ["source", "rank"], "left")
    following = Window.partitionBy("source").orderBy("rank", F.col("shard").asc_nulls_last())
    ranges = cuts.withColumn("to", F.lead("h").over(following)).withColumn("to_copy", F.lead("copy").over(following))
    ranges = ranges.filter("shard is not null and (to is null or to > h or to_copy > copy)")
    top = F.coalesce(F.when(F.col("to_copy") > 0, F.col("to")).otherwise(F.col("to") - 1), F.lit(2**63 - 1))
    ranges = ranges.withColumn("cell", F.explode(F.sequence(F.shiftright("h", 56), F.shiftright(top, 56))))
    # Written, so that their size is known: Spark broadcasts them if it allows, and else joins by source and cell.
    columns = ("own_from", "own_from_copy", "own_to", "own_to_copy", "range_shard")
    low, low_copy, high, high_copy, target = fresh(keyed.withColumns({cell: F.lit(0), copy: F.lit(0)}), *columns)
    ranges = ranges.select("source", "cell", "h", "copy", "to", "to_copy", F.col("shard").cast("int")).toDF(source, cell, low, low_copy, high, high_copy, target)
    ranges = cut(spark, ranges, "mixing-ranges")
    # Hashes that a cut divides: only their rows need numbers.
    divided = ranges.filter(F.col(low_copy) > 0).select(source, F.col(low).alias(h)).unionByName(ranges.filter(F.col(high_copy) > 0).select(source, F.col(high).alias(h))).distinct()
    divided = cut(spark, divided, "mixing-divided")
    if divided.isEmpty():
        keyed = keyed.withColumn(copy, F.lit(0))
    else:
        others = [F.col(_quoted(f.name)) for f in df.schema if f.name not in (id_column, text_column) and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        number = F.row_number().over(Window.partitionBy(source, h).orderBy(F.xxhash64(F.lit(seed + 2), *others))) - 1
        some = keyed.join(divided, [source, h], "left_semi").withColumn(copy, number)
        keyed = keyed.join(divided, [source, h], "left_anti").withColumn(copy, F.lit(0)).unionByName(some)
    out = keyed.withColumn(cell, F.shiftright(h, 56)).join(ranges, [source, cell])
    out = out.filter((F.col(h) > F.col(low)) | (F.col(h) == F.col(low)) & (F.col(copy) >= F.col(low_copy)))
    out = out.filter(F.col(high).isNull() | (F.col(h) < F.col(high)) | (F.col(h) == F.col(high)) & (F.col(copy) < F.col(high_copy)))
    order = Window.partitionBy(target).orderBy(F.xxhash64(F.lit(seed + 1), F.col(h)), h, copy)
    out = out.withColumn(position, F.row_number().over(order) - 1)
    return out.select(*(F.col(_quoted(c)) for c in df.columns), F.col(target).alias(shard), position)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights of the square root of their sources' sizes."""
    return mix(load(spark, sf_dir, "documents"))
