"""MinHash near-duplicate search with sequential Bayesian verification.

Texts are signed with MinHashes of their word shingles. Copies of one text are
one node, named by their least id. Nodes that share a band of the signature are
candidates. A candidate pair's signatures are compared a batch of hashes at a
time; after each batch it is dropped if, given the matches so far, the posterior
probability (uniform prior) that its Jaccard similarity reaches the threshold is
under the chosen miss probability. What survives is verified on the exact shingle
sets. Verified pairs join nodes to groups, whose least id stays.

Only pairs that can still change the groups are looked at: first each bucket's
members against its least member; then, where a bucket still holds several
groups, every pair across them. No bucket is capped: a large one is cut into blocks,
and every two blocks meet in a task of their own, where signatures are compared as
arrays and only the pairs that survive leave.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.common import batches, cut, discard, fresh, load, slices, text_bytes
from tributary.llm.components import components
from tributary.llm.common import quoted as _quoted
from tributary.llm.shingles import mix64, shingles


@dataclass(frozen=True)
class Search:
    """Production parameters."""

    #: Words of a shingle, and the Jaccard similarity from which two documents are near duplicates.
    words: int = 3
    threshold: float = 0.55
    #: Bands and the hashes of each; all hashes are compared, ``batch`` at a time.
    bands: int = 32
    rows: int = 4
    batch: int = 16
    #: Posterior probability of reaching the threshold below which a pair is dropped.
    miss: float = 0.001
    seed: int = 41

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


SEARCH = Search()
#: Bits of the filter that keeps uninvolved texts from being moved; more ids only make it less sharp.
FILTER_BITS = 1 << 25
#: Members of a bucket that one task holds against as many others.
BLOCK = 1024


@functools.lru_cache(maxsize=4)
def _functions(search: Search) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(search.seed)
    return rng.integers(0, 1 << 32, search.hashes, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, search.hashes, np.uint32)


def signatures(hashes: np.ndarray, counts: np.ndarray, search: Search = SEARCH) -> np.ndarray:
    """MinHashes of documents that all have shingles, a row each."""
    times, plus = _functions(search)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), search.hashes), np.uint32)
    held = np.empty_like(x)
    for i in range(search.hashes):
        np.multiply(x, times[i], out=held)
        np.add(held, plus[i], out=held)
        out[:, i] = np.minimum.reduceat(held, starts)
    return out


def band_keys(signed: np.ndarray, search: Search = SEARCH) -> np.ndarray:
    """64-bit keys of the bands, of which no two bands share one."""
    parts = signed.reshape(len(signed), search.bands, search.rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, search.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for k in range(search.rows):
        keys = mix64(keys ^ parts[:, :, k]) * np.uint64(0xD6E8FEB86659FD93)
    return keys.view(np.int64)


@functools.lru_cache(maxsize=4)
def least_matches(search: Search = SEARCH) -> list[tuple[int, int]]:
    """(hashes compared, matches needed to go on) after each batch."""
    out, t = [], search.threshold
    for n in [*range(search.batch, search.hashes, search.batch), search.hashes]:
        # Pr[Beta(m + 1, n - m + 1) >= t] is the binomial probability of at most m in n + 1.
        total, m = (1 - t) ** (n + 1), 0
        while total < search.miss:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(left: np.ndarray, right: np.ndarray, search: Search = SEARCH) -> np.ndarray:
    """Which pairs of signatures (two rows of 16-bit hashes) no batch drops."""
    alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, least in least_matches(search):
        matches = matches + (left[alive, done:n] == right[alive, done:n]).sum(1)
        on = matches >= least
        alive, matches, done = alive[on], matches[on], n
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def _sign(docs: DataFrame, search: Search) -> DataFrame:
    """doc_id, digest, keys, signature of each row with an id and a text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            data, offsets, _ = text_bytes(batch.column(1))
            raw = data.tobytes()
            digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(offsets, offsets[1:], strict=False)]
            keys, signed = [], []
            for a, b in slices(offsets):
                hashes, counts = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], search.words)
                some = np.flatnonzero(counts)
                own = signatures(hashes, counts[some], search) if len(some) else np.zeros((0, search.hashes), np.uint32)
                own_keys: list = [None] * (b - a)
                own_signed: list = [None] * (b - a)
                for i, k, s in zip(some.tolist(), band_keys(own, search), (own >> np.uint32(16)).astype(np.uint16), strict=True):
                    own_keys[i], own_signed[i] = k, s.tobytes()
                keys += own_keys
                signed += own_signed
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(signed, pa.binary())], names=["doc_id", "digest", "keys", "signature"])

    return docs.mapInArrow(run, "doc_id bigint, digest binary, keys array<bigint>, signature binary")


def _compare(pairs: DataFrame, signed: DataFrame, search: Search) -> DataFrame:
    """The pairs (a, b) that sequential comparison doesn't drop."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, search.hashes) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(survivors(left, right, search)))

    own = pairs.join(signed.select(F.col("doc_id").alias("a"), F.col("signature").alias("left")), "a")
    own = own.join(signed.select(F.col("doc_id").alias("b"), F.col("signature").alias("right")), "b")
    return own.select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def _across(members: DataFrame, search: Search) -> DataFrame:
    """The pairs (a, b) of one bucket but of two groups that sequential comparison doesn't drop.

    ``members`` has key, id, root and signature. Each is sent to the cells of all
    pairs of blocks that hold its own.
    """

    def meet(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, roots, block = (np.concatenate([r.column(i).to_numpy() for r in rows]) for i in (3, 4, 6))
        signed = np.frombuffer(b"".join(x for r in rows for x in r.column(5).to_pylist()), np.uint16).reshape(-1, search.hashes)
        order = np.argsort(block, kind="stable")
        ids, roots, block, signed = ids[order], roots[order], block[order], signed[order]
        half = int(np.searchsorted(block, block[-1])) or len(ids)  # two blocks, or one that meets itself
        other = np.arange(half if half < len(ids) else 0, len(ids))
        (first, least), step = least_matches(search)[0], max(1, (1 << 20) // (len(other) * 2))
        for at in range(0, half, step):
            own = np.arange(at, min(half, at + step))
            apart = (roots[own, None] != roots[None, other]) & ((ids[own, None] < ids[None, other]) if len(other) == len(ids) else True)
            matches = np.zeros(apart.shape, np.int16)
            for k in range(first):
                matches += signed[own, k][:, None] == signed[other, k][None, :]
            i, j = np.nonzero(apart & (matches >= least))
            left, right = own[i], other[j]
            for s in range(0, len(left), 1 << 16):
                a, b = left[s : s + (1 << 16)], right[s : s + (1 << 16)]
                on = survivors(signed[a], signed[b], search)
                x, y = ids[a[on]], ids[b[on]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell = [], None
        for batch in it:
            cells = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cuts = np.flatnonzero((cells[1:] != cells[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a < b:
                    if held and tuple(cells[a]) != cell:
                        yield from meet(held)
                        held = []
                    cell = tuple(cells[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield from meet(held)

    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    own = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    own = own.withColumn("meets", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    own = own.select("key", F.least("block", "meets").alias("low"), F.greatest("block", "meets").alias("high"), "id", "root", "signature", "block")
    own = own.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return own.mapInArrow(run, "a bigint, b bigint").distinct()


def _involved(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The documents whose id may be in a pair: all that are, and few others."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(bit("id").alias("bit"))
    cells = ids.groupBy(F.expr("bit div 32768").alias("cell")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in cells.collect():  # FILTER_BITS / 8 bytes at most
        table[r["cell"] * 4096 : r["cell"] * 4096 + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shipped = docs.sparkSession.sparkContext.broadcast(table.tobytes())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shipped.value, np.uint8)
        for batch in batches(it):
            at = batch.column(2).to_numpy()
            yield batch.select([0, 1]).filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 == 1))

    return docs.withColumn("bit", bit("doc_id")).mapInArrow(run, "doc_id bigint, text string")


def _sets(column: pa.Array, search: Search) -> list[np.ndarray]:
    data, offsets, _ = text_bytes(column)
    out = []
    for a, b in slices(offsets):
        hashes, counts = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], search.words)
        out += [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])]
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; that of two empty ones is 0."""
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / max(1, len(a) + len(b) - shared)


def _verify(pairs: DataFrame, docs: DataFrame, search: Search) -> DataFrame:
    """The pairs whose exact shingle sets reach the threshold."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches(it, 512):
            a, sets, kept = batch.column(0).to_pylist(), _sets(batch.column(3), search), []
            for i, x in enumerate(a):
                if x != last:
                    last, own = x, _sets(batch.column(2).slice(i, 1), search)[0]
                kept.append(jaccard(own, sets[i]) >= search.threshold)
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    texts = _involved(docs, pairs)
    # An id that several rows share is compared by one of its texts.
    own = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right")), "b")
    own = own.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), "a")
    return own.select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def _groups(docs: DataFrame, search: Search) -> tuple[DataFrame, DataFrame]:
    """A row a document (doc_id, node): its text's least id; and (id, root) of the nodes that near duplicates join."""
    spark = docs.sparkSession
    docs = docs.filter("doc_id is not null and text is not null")
    order = Window.partitionBy("digest").orderBy("doc_id")
    signed = _sign(docs, search).withColumn("node", F.first("doc_id").over(order)).withColumn("place", F.row_number().over(order))
    first = F.col("place") == 1
    signed = cut(spark, signed.select("doc_id", "node", F.when(first, F.col("keys")).alias("keys"), F.when(first, F.col("signature")).alias("signature")), "signed")
    nodes = signed.filter("signature is not null")

    bucket = Window.partitionBy("key").orderBy("id")
    members = nodes.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"))
    members = members.withColumn("least", F.first("id").over(bucket)).withColumn("next", F.lead("id").over(bucket))
    members = cut(spark, members.filter("id <> least or next <> id").select("key", "least", "id"), "buckets")
    pairs = cut(spark, _compare(members.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct(), nodes, search), "pairs")
    edges = cut(spark, _verify(pairs, docs, search), "verified")
    roots = cut(spark, components(edges), "roots")

    placed = members.join(roots, "id", "left").select("key", "least", "id", F.coalesce("root", "id").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    rest = placed.join(mixed, "key").filter("id <> least").select("key", "id", "root")
    more = cut(spark, _across(rest.join(nodes.select(F.col("doc_id").alias("id"), "signature"), "id"), search), "pairs")
    if not more.isEmpty():
        found = cut(spark, _verify(more, docs, search), "verified")
        if not found.isEmpty():
            discard(spark, roots)
            roots = cut(spark, components(edges.unionByName(found)), "roots")
        discard(spark, found)
    discard(spark, members, pairs, edges, more)
    return signed.select("doc_id", "node"), roots


def _columns(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return df.select(F.col(_quoted(id_column)).cast("bigint").alias("doc_id"), F.col(_quoted(text_column)).cast("string").alias("text"))


def pairs(df: DataFrame, search: Search = SEARCH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row (doc_id, duplicate_of, exact) for each document that has a group and isn't its least id.

    ``exact`` says that the text is that of ``duplicate_of``. Rows without id or
    text are in no group. Texts without words (empty ones among them) are duplicates only of equal ones.
    Rows that share an id are one document, which is a duplicate if one of them is;
    each pair is listed once. An empty table gives an empty one. Texts are compared whole.
    """
    nodes, roots = _groups(_columns(df, id_column, text_column), search)
    out = nodes.join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("duplicate_of", F.coalesce("root", "node"))
    return out.filter("doc_id <> duplicate_of").groupBy("doc_id", "duplicate_of").agg(F.max(F.col("node") == F.col("duplicate_of")).alias("exact"))


def keep(df: DataFrame, search: Search = SEARCH, id_column: str = "doc_id", text_column: str = "text", one_an_id: bool = True) -> DataFrame:
    """The rows of ``df`` that stay, with its columns: one document of each group, by least id.

    Rows without text stay, as do, with ``one_an_id``, those without id; of rows that
    share an id, one stays then: that with the least MD5 of its text. Without it, rows
    that share an id or have none are documents of their own, told apart by their
    texts: only copies and near copies go. They are numbered after all ids, so that a
    document with an id of its own stays before them, or before all ids where there is
    no room after. An empty table gives an empty one.
    """
    spark = df.sparkSession
    own, place = fresh(df, "own_id", "own_place")
    keyed, unique = (df.withColumn(own, F.col(_quoted(id_column)).cast("bigint")), False) if one_an_id else _apart(df, own, id_column, text_column)
    gone = cut(spark, pairs(keyed, search, own, text_column).select(F.col("doc_id").alias(own)).distinct(), "duplicates")
    out = keyed.join(gone, own, "left_anti")
    if unique:
        return out.select(*(F.col(_quoted(c)) for c in df.columns))
    again = cut(spark, keyed.select(own).filter(F.col(own).isNotNull()).groupBy(own).count().filter("count > 1").select(own), "repeated")
    if not again.isEmpty():
        order = Window.partitionBy(own).orderBy(F.md5(F.col(_quoted(text_column)).cast("string").cast("binary")).asc_nulls_last())
        one = out.join(again, own, "left_semi").withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).drop(place)
        out = out.join(again, own, "left_anti").unionByName(one)
    return out.select(*(F.col(_quoted(c)) for c in df.columns))


def _apart(df: DataFrame, own: str, id_column: str, text_column: str) -> tuple[DataFrame, bool]:
    """``df`` with a number of its own, in column ``own``, for each pair of id and text (null without a text); whether no two rows share one.

    It is the id, unless rows share that or it is null: their pairs of id and MD5 of the
    text are numbered beyond all ids.
    """
    spark = df.sparkSession
    shared, digest = fresh(df, "own_shared", "own_digest")
    number, text = F.col(_quoted(id_column)).cast("bigint"), F.col(_quoted(text_column)).cast("string")
    df = df.withColumn(own, number)
    ids = df.filter(text.isNotNull()).groupBy(own).count()
    repeated = cut(spark, ids.filter(F.col(own).isNull() | (F.col("count") > 1)).select(F.col(own).alias(shared)), "shared")
    if repeated.isEmpty():
        return df.withColumn(own, F.when(text.isNotNull(), F.col(own))), True
    low, high = ids.agg(F.min(own), F.max(own)).first()
    some = df.filter(text.isNotNull()).join(repeated, F.col(own).eqNullSafe(F.col(shared)), "left_semi").withColumn(digest, F.md5(text.cast("binary")))
    names = some.select(F.col(own).alias(shared), F.col(digest)).distinct()
    room = 1 << 62
    if (high or 0) < room:
        numbered = F.monotonically_increasing_id() + F.lit((high or 0) + 1)
    elif low > -room:
        numbered = F.lit(low - 1) - F.monotonically_increasing_id()
    else:  # ids at both ends leave no room: a hash, whose chance of meeting another is 2^-64 a pair
        numbered = F.xxhash64(shared, digest)
    names = cut(spark, names.withColumn("number", numbered), "numbers").withColumnRenamed("number", "own_number")
    (to,) = fresh(some, "own_number")
    names = names.withColumnRenamed("own_number", to).withColumnRenamed(digest, digest + "_")
    some = some.join(names, F.col(own).eqNullSafe(F.col(shared)) & (F.col(digest) == F.col(digest + "_")))
    rest = df.join(repeated, F.col(own).eqNullSafe(F.col(shared)) & text.isNotNull(), "left_anti").withColumn(own, F.when(text.isNotNull(), F.col(own)))
    return rest.unionByName(some.withColumn(own, F.col(to)).select(*(F.col(_quoted(c)) for c in df.columns))), False


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents."""
    return pairs(load(spark, sf_dir, "documents"))
