"""BPE encoding and decoding with contiguous rank arrays.

A word is held as a contiguous row of part boundaries with the rank of each
adjacent pair beside it; the smallest rank is found by scanning the row, its
boundary is deleted and the two neighbouring ranks are refreshed. All distinct
words of a slice of text are worked on together, one row each, so that each
scan is one array operation. Words over ``SHORT`` bytes go through the same
scan one word at a time with a heap in place of the scan.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import SLICE_BYTES, batches, fresh, lists, load, map_texts, quoted, ragged, release, slices, text_bytes
from tributary.llm.pretokens import span_hashes, word_starts

#: Ranks of the 50k byte-level vocabulary; see the README beside it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Longest word, in bytes, that is worked on as a row of the rank array.
SHORT = 64
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32, SHORT)
NONE = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> rank of their concatenation, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(10, int(len(rank) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[won]]] = rank[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; NONE where the pair doesn't merge or a side is negative."""
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        todo = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


@dataclass
class Vocabulary:
    tokens: list[bytes]
    ranks: dict[bytes, int]

    def __post_init__(self):
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int32))
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.bytes_pairs = self.pairs.get(np.repeat(self.byte, 256), np.tile(self.byte, 256)).reshape(256, 256)
        lengths = np.array([len(t) for t in self.tokens])
        self.data = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.starts, self.lengths = np.cumsum(lengths) - lengths, lengths
        # Tokens that merging alone doesn't give are taken whole, as the public encoders do.
        self.whole: dict[bytes, int] = {}
        flat, counts, _ = self._merge(self.data, self.starts, self.lengths)
        for i in np.flatnonzero(counts != 1):
            if self.tokens[i] and self.ranks.get(self.tokens[i]) == i:
                self.whole[self.tokens[i]] = int(i)

    # -- words --

    def _rows(self, ids: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge each row of ids to its end; ranks[:, j] is that of the pair (j, j + 1)."""
        n, width = ids.shape
        out = np.full((n, width), -1, np.int32)
        rows = np.arange(n)
        columns = np.arange(width)
        while True:
            least = ranks.argmin(1)
            here = np.arange(len(rows))
            rank = ranks[here, least]
            active = rank != NONE
            if not active.all():
                done = ~active
                out[rows[done]] = ids[done]
                rows, ids, ranks, least, rank = rows[active], ids[active], ranks[active], least[active], rank[active]
                here = here[: len(rows)]
            if not len(rows):
                return out, (out >= 0).sum(1)
            take = columns + (columns > least[:, None])
            take[:, -1] = np.minimum(take[:, -1], width - 1)
            ids = np.take_along_axis(ids, take, 1)
            ids[:, -1] = -1
            ids[here, least] = rank
            take = columns + (columns >= least[:, None])
            take[:, -1] = width - 1
            ranks = np.take_along_axis(ranks, take, 1)
            ranks[:, -1] = NONE
            nxt = ids[here, np.minimum(least + 1, width - 1)]
            nxt[least + 1 >= width] = -1
            ranks[here, least] = np.where(nxt >= 0, self.pairs.get(rank, np.maximum(nxt, 0)), NONE)
            some = np.flatnonzero(least > 0)
            ranks[some, least[some] - 1] = self.pairs.get(ids[some, least[some] - 1], rank[some])

    def _merge(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words end to end, their counts and places."""
        n = len(starts)
        counts = np.zeros(n, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for width in WIDTHS:
            which = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for at in range(0, len(which), 1 << 15):
                own = which[at : at + (1 << 15)]
                index = starts[own][:, None] + np.arange(width)
                inside = np.arange(width) < lengths[own][:, None]
                raw = data[np.minimum(index, len(data) - 1)]
                ids = np.where(inside, self.byte[raw], -1).astype(np.int32)
                ranks = np.full((len(own), width), NONE, np.int32)
                ranks[:, :-1] = np.where(inside[:, 1:], self.bytes_pairs[raw[:, :-1], raw[:, 1:]], NONE)
                merged, count = self._rows(ids, ranks)
                counts[own] = count
                parts.append((own, merged[merged >= 0]))
        for i in np.flatnonzero(lengths > SHORT):
            ids = self.long_word(data[starts[i] : starts[i] + lengths[i]].tobytes())
            counts[i] = len(ids)
            parts.append((np.array([i]), np.array(ids, np.int32)))
        places = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        for own, ids in parts:
            flat[ragged(places[own], counts[own])] = ids
        return flat, counts, places

    def long_word(self, word: bytes) -> list[int]:
        """The same merges in the same order, with a heap: for words of any length."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        n = len(word)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1" * n)
        get = self.ranks.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or ends[i] >= n or ends[ends[i]] != end:
                continue
            gone = ends[i]
            alive[gone] = 0
            ends[i] = end
            if end < n:
                before[end] = i
                if (r := get(word[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (p := before[i]) >= 0 and (r := get(word[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : ends[i]]])
            i = ends[i]
        return out

    # -- documents --

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents end to end, and how many each has."""
        starts = word_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(starts[1:], len(data))
        lengths = ends - starts
        _, head, word = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        # Words that share a hash without being equal are rows of their own.
        same = lengths[head[word]] == lengths
        bad = ~same
        step = data[ragged(starts[head[word]], np.where(same, lengths, 0))] != data[ragged(starts, np.where(same, lengths, 0))]
        if step.any():
            bad[np.repeat(np.arange(len(starts)), np.where(same, lengths, 0))[step]] = True
        if bad.any():
            extra = np.flatnonzero(bad)
            word[extra] = len(head) + np.arange(len(extra))
            head = np.concatenate([head, extra])
        flat, counts, places = self._merge(data, starts[head], lengths[head])
        if self.whole:
            flat, counts, places = self._take_whole(data, starts[head], lengths[head], flat, counts)
        each = counts[word]
        ids = flat[ragged(places[word], each)]
        running = np.concatenate([[0], np.cumsum(each)])
        return ids, np.diff(running[np.searchsorted(starts, offsets)])

    def _take_whole(self, data, starts, lengths, flat, counts):
        places = np.cumsum(counts) - counts
        keep = np.ones(len(flat), bool)
        counts = counts.copy()
        flat = flat.copy()
        sizes = {len(t) for t in self.whole}
        for i in np.flatnonzero(np.isin(lengths, list(sizes))):
            if (whole := self.whole.get(data[starts[i] : starts[i] + lengths[i]].tobytes())) is not None:
                keep[places[i] + 1 : places[i] + counts[i]] = False
                flat[places[i]], counts[i] = whole, 1
        flat = flat[keep]
        return flat, counts, np.cumsum(counts) - counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all documents end to end, and how many each has."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens)):
            raise ValueError("an id is outside the vocabulary")
        sizes = self.lengths[ids]
        running = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(counts)
        return self.data[ragged(self.starts[ids], sizes)], running[ends] - running[ends - counts]


def parse(raw: bytes) -> Vocabulary:
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, r in ranks.items():
        tokens[r] = token
    return Vocabulary(tokens, ranks)


@functools.lru_cache(maxsize=2)
def parsed(raw: bytes) -> Vocabulary:
    return parse(raw)


def vocabulary_file(spark: SparkSession, path: str) -> Broadcast:
    """The file's bytes (under a MB, whatever the corpus), for executors that don't have it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoded(column: pa.Array, vocabulary: Vocabulary) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    data, offsets, null = text_bytes(column)
    ids, counts, right = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for a, b in slices(offsets, SLICE_BYTES // 2):  # arrays of words and ranks take many times their text
        own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        got, n = vocabulary.encode(own, at)
        back, sizes = vocabulary.decode(got, n)
        ids.append(got), counts.append(n)
        if np.array_equal(back, own) and np.array_equal(sizes, np.diff(at)):
            right.append(np.ones(b - a, bool))
        else:
            ends = np.cumsum(sizes)
            right.append(np.array([np.array_equal(back[e - s : e], own[at[i] : at[i + 1]]) for i, (s, e) in enumerate(zip(sizes, ends, strict=True))]))
    counts = np.concatenate(counts)
    return lists(np.concatenate(ids), counts, null, pa.int32()), counts, np.concatenate(right)


def encode(df: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a row of ``df``: its id, ``tokens``, ``n_tokens`` and ``round_trip``.

    ``round_trip`` says whether decoding the tokens gives the text's bytes back.
    A null text gives nulls in all three, an empty one no tokens; a null id stays
    null, repeated rows give repeated rows, other columns are left out, an empty
    table gives an empty one. A column of the result that has the id column's name
    gets a leading ``_``. A text of any length is encoded whole.
    """
    shipped = vocabulary_file(df.sparkSession, vocabulary)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parsed(shipped.value)
        for batch in batches(it):
            tokens, counts, right = _encoded(batch.column(1), own)
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), tokens, pa.array(counts, pa.int64(), mask=null), pa.array(right, pa.bool_(), mask=null)], names=["id", "tokens", "n_tokens", "round_trip"])

    return map_texts(df, run, "tokens array<int>, n_tokens bigint, round_trip boolean", id_column, text_column)


def decode(df: DataFrame, vocabulary: str = VOCABULARY, tokens_column: str = "tokens", to: str = "text") -> DataFrame:
    """``df`` with the text of its tokens in column ``to`` (replaced if it is there).

    Null tokens give a null text, none an empty one. Bytes that aren't UTF-8
    (tokens cut from a document) become U+FFFD; an id outside the vocabulary, or a
    null one, raises an error.
    """
    shipped = vocabulary_file(df.sparkSession, vocabulary)
    (text,) = fresh(df, "decoded_text")

    @F.arrow_udf("string")
    def run(tokens: pa.Array) -> pa.Array:
        own, ids = parsed(shipped.value), tokens.flatten()
        if ids.null_count:
            raise ValueError("an id is null")
        counts = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        data, sizes = own.decode(ids.to_numpy(zero_copy_only=False).astype(np.int64), counts)
        raw, ends = data.tobytes(), np.cumsum(sizes)
        texts = [raw[e - n : e].decode("utf-8", "replace") for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        out = pa.array(texts, pa.string(), mask=tokens.is_null().to_numpy(zero_copy_only=False))
        release()
        return out

    out = df.withColumn(text, run(F.col(quoted(tokens_column)).cast("array<bigint>")))
    return out.drop(to).withColumnRenamed(text, to) if to in df.columns else out.withColumnRenamed(text, to)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, with the round trip checked."""
    return encode(load(spark, sf_dir, "documents"))
