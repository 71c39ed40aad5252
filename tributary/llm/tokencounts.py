"""Token counts by finite-state transducers.

BPE over pre-tokenised text is compiled into one deterministic transducer, whose
transitions carry how many tokens more (or fewer) the text so far has with the
character that is read. A state holds the open word's class and, for the longest
end of the word that can begin a token, the last token and relative count of each
prefix: the last token of a longer prefix is the one that agrees with the last
token before it, so that much decides all to come. Last tokens that agree with
the same of the tokens still possible are one. The driver compiles what a bounded
sample of texts needs and sends it out; workers make further states on first use.

A text is read in chunks, all at once. A chunk's state map is constant from its
first reset on (a character of another class closes the open word, but after white
space and apostrophes, whose words depend on more). Of chunks without a reset, the
maps are worked out for the states that occur: every chunk is entered in a guessed
state, and what one leaves in, the next is entered in, until the maps lead into one
another; then a prefix scan composes them, in as many steps as the logarithm of
their number, from the last chunk whose map is constant. Summed over chunks, the
transitions' counts are the documents' token counts.
"""

from __future__ import annotations

import functools
import marshal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.bpe import VOCABULARY, Vocabulary, parsed, vocabulary_file
from tributary.llm.common import batches, load, map_texts, quoted, slices, text_bytes
from tributary.llm.pretokens import EDGE, LETTER, NUMBER, OTHER, SPACE, classes, code_points

#: Characters of a chunk; states after which a worker starts its automaton anew.
CHUNK, MOST_STATES = 128, 250_000
#: Fronts of more tokens than these keep tokens before them apart.
FEW = 24
#: Texts, and characters of each, that the driver compiles states from; and rounds in which guessed states are followed from chunk to chunk. Counts don't depend on them.
SAMPLE_ROWS, SAMPLE_CHARACTERS, ROUNDS = 2000, 2000, 6
END = 0x110000
START, WORD, DIGITS, MARKS, BLANK, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(9)
_OPENS = {LETTER: WORD, NUMBER: DIGITS, OTHER: MARKS, SPACE: BLANK}
_NOTHING, NEVER = (b"", (-1,), (0,)), -2


class Transducer:
    """The lazily made states and transitions for one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.ranks, self.tokens, self.long_word = vocabulary.ranks, vocabulary.tokens, vocabulary.long_word
        #: Tokens that begin with, and are longer than, each of their fronts.
        self.longer: dict[bytes, list[int]] = {}
        for token, data in enumerate(self.tokens):
            for i in range(1, len(data)):
                self.longer.setdefault(data[:i], []).append(token)
        #: What windows and tokens before them come down to.
        self.alike: dict[tuple[bytes, tuple], tuple] = {}
        self.likes: dict[tuple[bytes, int], int] = {}
        self.kinds: dict[tuple[bytes, int], int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.left, self.right = [-1] * len(self.tokens), [-1] * len(self.tokens)
        self.agrees = self._agrees_whole if vocabulary.whole else self._agrees
        for token in [] if vocabulary.whole else sorted(self.ranks.values()):
            data = self.tokens[token]
            for i in range(1, len(data)):
                a, b = self.ranks.get(data[:i]), self.ranks.get(data[i:])
                if a is not None and b is not None and a < token and b < token and self._agrees(a, b):
                    self.left[token], self.right[token], self.merged[a, b] = a, b, token
                    break
        self.kind = classes()
        self.clear()

    def clear(self) -> None:
        self.bits = 18
        self._empty()
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.used = 0
        self._id((START, *_NOTHING, 0))

    def _empty(self) -> None:
        size = 1 << self.bits
        self.keys, self.to, self.change = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int16)

    def _id(self, state: tuple) -> int:
        at = self.ids.get(state)
        if at is None:
            at = self.ids[state] = len(self.states)
            self.states.append(state)
        return at

    # -- the words --

    def _agrees(self, before: int, token: int) -> bool:
        """Whether BPE leaves these two tokens as they are, side by side.

        Their merges are undone from the last one on: no pair that was ever side by
        side may merge before the merges that part it.
        """
        merged, left, right, limit = self.merged, self.left, self.right, len(self.tokens)
        while merged.get((before, token), limit) >= limit:
            if before > token:
                limit = before
                if (part := right[before]) >= 0:
                    before = part
                    continue
                limit = token + 1
                if (part := left[token]) < 0:
                    return True
                token = part
            else:
                limit = token + 1
                if (part := left[token]) >= 0:
                    token = part
                    continue
                limit = before
                if (part := right[before]) < 0:
                    return True
                before = part
        return False

    def _agrees_whole(self, before: int, token: int) -> bool:
        """The same by merging the bytes, for vocabularies with tokens that merging alone doesn't give."""
        return self.long_word(self.tokens[before] + self.tokens[token]) == [before, token]

    def _read(self, word: tuple, data: bytes) -> tuple[tuple, int]:
        """A word's window after more bytes, and by how much its count grows."""
        end, last, count = word
        get, longer, agrees, alike, grown = self.ranks.get, self.longer, self.agrees, self.alike, 0
        for i in range(len(data)):
            end = end + data[i : i + 1]
            for k in range(len(end)):
                token = get(end[k:])
                if token is not None and ((before := last[k]) < 0 or agrees(before, token)):
                    break
            else:
                raise ValueError("the vocabulary lacks single bytes")
            new = count[k] + 1
            grown += new
            last, count = (*last, token), (*(c - new for c in count), 0)
            keep = 0
            while keep < len(end) and end[keep:] not in longer:
                keep += 1
            if keep:
                end, last, count = end[keep:], last[keep:], count[keep:]
        if (state := alike.get((end, last))) is None:
            state = alike[end, last] = tuple(self._like(end[k:], x) for k, x in enumerate(last))
        return (end, state, count), grown

    def _like(self, end: bytes, before: int) -> int:
        """The first token met that is as good as ``before``: that agrees with the same of the tokens that may yet be made of ``end`` and what follows."""
        if before < 0 or not end or len(tokens := self.longer.get(end, ())) > FEW:
            return before
        if not tokens:
            return NEVER
        if (like := self.likes.get((end, before))) is None:
            which = sum(1 << i for i, t in enumerate(tokens) if self.agrees(before, t))
            like = self.likes[end, before] = self.kinds.setdefault((end, which), before)
        return like

    def _next(self, state: tuple, point: int) -> tuple[tuple, int]:
        """The state after one more character, and the change in tokens."""
        mode, end, last, count, extra = state
        if point == END:
            return (START, *_NOTHING, 0), 0
        kind, data = int(self.kind[point]), chr(point).encode("utf-8", "surrogatepass")
        word = (end, last, count)

        def opened(front: bytes = b"") -> tuple[tuple, int]:
            new, n = self._read(_NOTHING, front + data)
            if kind == SPACE:
                return (BLANK, *new, (1, 0, point == 0x20, data)), n
            return (QUOTE if point == 0x27 and not front else _OPENS[kind], *new, 0), n

        def longer(now: int, more: object = 0) -> tuple[tuple, int]:
            new, n = self._read(word, data)
            return (now, *new, more), n

        if mode == BLANK:
            length, without, plain, final = extra
            if kind == SPACE:
                new, n = self._read(word, data)
                return (BLANK, *new, (2, -n, point == 0x20, data)), n
            # The run's last character leaves it: to the next word if it is a space, else by itself.
            left = without if length > 1 else -self._read(_NOTHING, final)[1]
            if plain:
                new, n = opened(final)
                return new, left + n
            alone = self._read(_NOTHING, final)[1]
            new, n = opened()
            return new, left + alone + n
        if mode in (QUOTE_R, QUOTE_V, QUOTE_L):
            if point == (0x6C if mode == QUOTE_L else 0x65):
                whole = b"'" + end[-1:] + data
                return (START, *_NOTHING, 0), self._read(_NOTHING, whole)[1] - self._read(_NOTHING, b"'")[1] - self._read(_NOTHING, whole[1:2])[1]
            mode = WORD
        if mode == QUOTE:
            if point in b"stmd":
                return (START, *_NOTHING, 0), self._read(_NOTHING, b"'" + data)[1] - self._read(_NOTHING, b"'")[1]
            if point in b"rvl":
                new, n = self._read(_NOTHING, data)
                return ({0x72: QUOTE_R, 0x76: QUOTE_V, 0x6C: QUOTE_L}[point], *new, 0), n
            return longer(MARKS) if kind == OTHER else opened()
        return longer(mode) if mode == _OPENS[kind] else opened()

    # -- many at once --

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys in the table, and which aren't there."""
        slot, mask = self._slot(keys), (1 << self.bits) - 1
        found = self.keys[slot]
        todo = np.flatnonzero(found != keys)
        missing = []
        while len(todo):
            free = found[todo] == -1
            if free.any():
                missing.append(todo[free])
                todo = todo[~free]
            slot[todo] = (slot[todo] + 1) & mask
            found[todo] = self.keys[slot[todo]]
            todo = todo[found[todo] != keys[todo]]
        return slot, np.concatenate(missing) if missing else todo

    def _insert(self, keys: np.ndarray, to: np.ndarray, change: np.ndarray) -> None:
        mask, slot, todo = (1 << self.bits) - 1, self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = keys[free]  # of several, one wins
            won = self.keys[slot[todo]] == keys[todo]
            own = todo[won]
            self.to[slot[own]], self.change[slot[own]] = to[own], change[own]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & mask
        self.used += len(keys)

    def _room(self, more: int) -> None:
        if (self.used + more) * 2 > len(self.keys):
            have = self.keys >= 0
            old = self.keys[have], self.to[have], self.change[have]
            while (self.used + more) * 4 > 1 << self.bits:
                self.bits += 1
            self._empty()
            self.used = 0
            self._insert(*old)

    def dump(self) -> bytes:
        """The states and transitions made so far."""
        have = self.keys >= 0
        return marshal.dumps((self.states, self.kinds, self.keys[have].tobytes(), self.to[have].tobytes(), self.change[have].tobytes()))

    def load(self, dumped: bytes) -> None:
        """Take them over, in place of the machine's own."""
        self.clear()
        self.states, self.kinds, *arrays = marshal.loads(dumped)
        self.ids = {s: i for i, s in enumerate(self.states)}
        keys, to, change = (np.frombuffer(x, k) for x, k in zip(arrays, (np.int64, np.int32, np.int16), strict=True))
        self._room(len(keys))
        self._insert(keys, to, change)

    def step(self, states: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = states.astype(np.int64) << 21 | points
        slot, missing = self._find(keys)
        if len(missing):
            new = np.unique(keys[missing])
            self._room(len(new))
            made = [self._next(self.states[k >> 21], k & 0x1FFFFF) for k in new.tolist()]
            self._insert(new, np.array([self._id(s) for s, _ in made], np.int32), np.array([n for _, n in made], np.int16))
            slot, _ = self._find(keys)
        return self.to[slot], self.change[slot]

    def run(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, entered: np.ndarray, change: np.ndarray) -> np.ndarray:
        """Read the spans of ``points`` side by side, noting each transition's count; the states at their ends."""
        out = entered.astype(np.int32).copy()
        order = np.argsort(starts - ends, kind="stable")
        lengths, first, states = (ends - starts)[order], starts[order], out[order]
        m = len(order)
        for t in range(int(lengths[0]) if m else 0):
            while lengths[m - 1] <= t:
                m -= 1
            at = first[:m] + t
            states[:m], change[at] = self.step(states[:m], points[at])
        out[order] = states
        return out

    def _compose(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, constant: np.ndarray, exits: np.ndarray, change: np.ndarray) -> None:
        """Fill in the exits of the chunks whose map isn't constant. The first chunk's is."""
        open_ = np.append(~constant, False)
        which = np.flatnonzero(open_)
        if not len(which):
            return
        contents: dict[bytes, int] = {}
        content = np.zeros(len(starts), np.int64)
        content[which] = [contents.setdefault(points[starts[j] : ends[j]].tobytes(), len(contents)) for j in which.tolist()]
        known, left = np.zeros(0, np.int64), np.zeros(0, np.int32)  # what a content entered in a state is left in
        nodes, after = np.zeros(0, np.int64), np.zeros(0, np.int32)  # the same of chunks
        first = which[~open_[which - 1]]
        begin = first << 32 | exits[first - 1]
        fresh = np.unique(np.concatenate([begin, which[open_[which - 1]] << 32]))  # guessed: nothing was open
        rounds = max(1, ROUNDS)
        while True:
            while len(fresh) and rounds:
                rounds -= 1
                j, entry = fresh >> 32, fresh & 0xFFFFFFFF
                asked, at = np.unique(content[j] << 32 | entry, return_index=True)
                new = ~np.isin(asked, known, assume_unique=True)
                j_new, spare = j[at[new]], np.zeros_like(change)
                got = self.run(points, starts[j_new], ends[j_new], entry[at[new]], spare)
                known = np.concatenate([known, asked[new]])
                order = np.argsort(known)
                known, left = known[order], np.concatenate([left, got])[order]
                out = left[np.searchsorted(known, content[j] << 32 | entry)]
                nodes = np.concatenate([nodes, fresh])
                order = np.argsort(nodes)
                nodes, after = nodes[order], np.concatenate([after, out])[order]
                on = open_[j + 1]
                fresh = np.unique((j[on] + 1) << 32 | out[on])
                fresh = fresh[~np.isin(fresh, nodes, assume_unique=True)]
            # The scan: where each chunk's map leads, then two chunks', four chunks' and so on.
            n = len(nodes)
            follows = ((nodes >> 32) + 1) << 32 | after
            jump = np.minimum(np.searchsorted(nodes, follows), n - 1)
            goes = open_[(nodes >> 32) + 1]
            jump = np.append(np.where(goes & (nodes[jump] == follows), jump, n), n)
            reached = np.zeros(n + 1, bool)
            reached[np.searchsorted(nodes, begin)] = True
            for _ in range(len(which).bit_length()):
                reached[jump[reached]] = True
                jump = jump[jump]
            mine = np.flatnonzero(reached[:n])
            stop = goes[mine] & ~np.isin(follows[mine], nodes)
            if not stop.any():
                exits[nodes[mine] >> 32] = after[mine]
                return
            fresh, rounds = np.unique(follows[mine][stop]), -1

    def counts(self, data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Tokens of each document."""
        if len(self.states) > MOST_STATES:
            self.clear()
        at, found = code_points(data)
        n = len(found)
        bounds = np.searchsorted(at, offsets)
        # A mark after each document closes it.
        points = np.full(n + len(offsets) - 1, END, np.int32)
        places = np.arange(n) + np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        points[places] = found
        change = np.zeros(len(points), np.int16)
        kind = self.kind[np.minimum(points, END - 1)]
        kind[points == END] = EDGE
        reset = np.zeros(len(points), bool)
        reset[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE) & ((points[:-1] != 0x27) | (kind[1:] != LETTER)) | (kind[:-1] == EDGE)
        if len(points):
            reset[0] = True
        starts = np.arange(0, len(points), chunk)
        ends = np.append(starts[1:], len(points))
        resets = np.flatnonzero(reset)
        where = np.searchsorted(resets, starts)
        front = np.minimum(np.append(resets, len(points))[where], ends)
        constant = front < ends
        exits = np.zeros(len(starts), np.int32)
        which = np.flatnonzero(constant)
        exits[which] = self.run(points, front[which], ends[which], np.zeros(len(which), np.int32), change)
        self._compose(points, starts, ends, constant, exits, change)
        entered = np.concatenate([[0], exits[:-1]])
        self.run(points, starts, front, entered, change)
        running = np.concatenate([[0], np.cumsum(change, dtype=np.int64)])
        shifted = bounds + np.arange(len(offsets))
        return running[shifted[1:]] - running[shifted[:-1]]


@functools.lru_cache(maxsize=2)
def compiled(raw: bytes, dumped: bytes = b"") -> Transducer:
    out = Transducer(parsed(raw))
    if dumped:
        out.load(dumped)
    return out


def sampled(df: DataFrame, raw: bytes, text_column: str) -> bytes:
    """States and transitions that a bounded sample of the texts needs: a few MB, whatever the corpus."""
    machine = compiled(raw)
    texts = df.select(F.substring(F.col(quoted(text_column)).cast("string"), 1, SAMPLE_CHARACTERS).alias("text")).take(SAMPLE_ROWS)  # reads as many partitions as that takes
    data, offsets, _ = text_bytes(pa.array([r["text"] for r in texts], pa.string()))
    for a, b in slices(offsets):
        machine.counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
    return machine.dump()


def count(df: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The tokens each text has: (id, n_tokens), a row a row of ``df``.

    A null text has a null count, an empty one 0; a null id stays null, repeated
    rows are counted again, other columns are left out, an empty table gives an
    empty one. ``n_tokens`` gets a leading ``_`` where the id column has that name. A
    text of any length is read whole.
    """
    shipped = vocabulary_file(df.sparkSession, vocabulary)
    made = df.sparkSession.sparkContext.broadcast(sampled(df, shipped.value, text_column))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(shipped.value, made.value)
        for batch in batches(it):
            data, offsets, null = text_bytes(batch.column(1))
            parts = [np.zeros(0, np.int64)]
            for a, b in slices(offsets):
                parts.append(machine.counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts), pa.int64(), mask=null)], names=["id", "n_tokens"])

    return map_texts(df, run, "n_tokens bigint", id_column, text_column)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return count(load(spark, sf_dir, "documents"))
