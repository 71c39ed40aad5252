import base64
import itertools

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tributary.llm import bpe, tokencounts
from tributary.llm.common import text_bytes

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ODD = [
    "", "it's 're 'll'llx  'd\n\n's", "   ", " a  b\n\n c\t\t", "x" * 300, "ab " * 100, "日本語テキスト 🎉🎉 é   x", "1² ½ ٣٤ ⅷ", "don't we're 'S 'lx '", "=" * 300, " \n", "\n x", "é'sé's'r 've",
    "​ a​", "a" * 70 + " " + "qwertyuiop" * 130, "\n\n\n'll", "''s '''re 'v'e 'vex", "     x y", " " * 500 + "x", "\n" * 300, "hello" * 400, "　\xa0 x",
]


@pytest.fixture(scope="module")
def raw():
    with open(bpe.VOCABULARY, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def public(raw):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(own, texts):
    data, offsets, _ = text_bytes(pa.array(texts))
    ids, counts = own.encode(data, offsets)
    ends = np.cumsum(counts)
    return [ids[e - n : e].tolist() for n, e in zip(counts, ends, strict=True)]


def test_odd_texts(raw, public):
    want = [public.encode_ordinary(t) for t in ODD]
    assert encoded(bpe.parsed(raw), ODD) == want
    for chunk in (5, 64, 1000):
        data, offsets, _ = text_bytes(pa.array(ODD))
        assert tokencounts.compiled(raw).counts(data, offsets, chunk).tolist() == [len(w) for w in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" '\n\tsreldmvtaeioX1²é.-日"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_any_text(raw, public, texts):
    want = [public.encode_ordinary(t) for t in texts]
    assert encoded(bpe.parsed(raw), texts) == want if texts else True
    if texts:
        data, offsets, _ = text_bytes(pa.array(texts))
        assert tokencounts.compiled(raw).counts(data, offsets, 7).tolist() == [len(w) for w in want]


def test_rows_and_heap_agree(raw):
    own = bpe.parsed(raw)
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 105, n, np.uint8)) for n in rng.integers(1, 64, 300)]
    data, lengths = np.frombuffer(b"".join(words), np.uint8), np.array(list(map(len, words)))
    flat, counts, places = own._merge(data, np.cumsum(lengths) - lengths, lengths)
    assert [flat[p : p + c].tolist() for p, c in zip(places, counts, strict=True)] == [own.long_word(w) for w in words]


def test_operator(awkward, public, documents):
    assert bpe.encode(awkward.limit(0)).count() == 0
    got = bpe.encode(awkward).collect()
    want = awkward.select("doc_id", "text").collect()
    assert sorted((str(r.doc_id), str(r.tokens)) for r in got) == sorted((str(r.doc_id), str(None if r.text is None else public.encode_ordinary(r.text))) for r in want)
    assert all(r.n_tokens == (None if r.tokens is None else len(r.tokens)) and r.round_trip in (None, True) for r in got)
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    own = bpe.encode(documents)
    assert {r.doc_id: r.tokens for r in own.collect()} == {k: public.encode_ordinary(t) for k, t in texts.items()}
    assert {r.doc_id: r.text for r in bpe.decode(own).collect()} == texts


def test_decode(spark):
    df = spark.createDataFrame([(1, [], "a"), (2, None, "b"), (3, [15496, 995], "c")], "doc_id bigint, tokens array<int>, text string")
    assert [r.text for r in bpe.decode(df).orderBy("doc_id").collect()] == ["", None, "Hello world"]
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [99_999])], "doc_id bigint, tokens array<int>")).collect()


def test_counts(awkward, documents, public):
    assert tokencounts.count(awkward.limit(0)).count() == 0
    for df in (awkward, documents):
        want = [(str(r.doc_id), None if r.text is None else len(public.encode_ordinary(r.text))) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(str, want)) == sorted(str((str(r.doc_id), r.n_tokens)) for r in tokencounts.count(df).collect())


def test_automaton_can_start_anew(raw, public, monkeypatch):
    machine = tokencounts.Transducer(bpe.parsed(raw))
    monkeypatch.setattr(tokencounts, "MOST_STATES", 10)
    for texts in itertools.batched(ODD, 4):
        data, offsets, _ = text_bytes(pa.array(list(texts)))
        assert machine.counts(data, offsets).tolist() == [len(public.encode_ordinary(t)) for t in texts]


def test_state_maps_compose(raw, public, monkeypatch):
    """Texts of one class, in whose chunks nothing fixes the state: letters, ideographs, repeats, white space, digits."""
    import random
    import time

    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=80_000)), "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(40_000)), "a" * 30_001, "ab" * 9000, " " * 7000 + "x", " \n" * 4000 + "x", "".join(rng.choices("0123456789", k=9000)), "=" * 9000 + "x" * 500, "aab" * 700 + " " + "ba" * 900]
    want = [len(public.encode_ordinary(t)) for t in texts]
    for rounds, chunk in ((6, 128), (1, 128), (0, 50), (6, 5)):
        monkeypatch.setattr(tokencounts, "ROUNDS", rounds)
        machine = tokencounts.Transducer(bpe.parsed(raw))
        some = texts if chunk == 128 else [t[-6000:] for t in texts]
        data, offsets, _ = text_bytes(pa.array(some))
        assert machine.counts(data, offsets, chunk).tolist() == (want if chunk == 128 else [len(public.encode_ordinary(t)) for t in some])
        began = time.process_time()
        machine.counts(data, offsets, chunk)
        assert chunk < 128 or rounds < 6 or time.process_time() - began < 2


def test_pairs_agree_as_merging_says(raw):
    """The quick test of two tokens against merging their bytes."""
    rng = np.random.default_rng(2)
    own = bpe.parsed(raw)
    machine, n = tokencounts.Transducer(own), len(own.tokens)
    for a, b in rng.integers(0, n, (4000, 2)).tolist():
        word = own.tokens[a] + own.tokens[b]
        k = int(rng.integers(0, len(word)))
        pairs = [(a, b)] + ([(own.ranks[word[:k]], own.ranks[word[k:]])] if word[:k] in own.ranks and word[k:] in own.ranks else [])
        for x, y in pairs:
            assert machine._agrees(x, y) == machine._agrees_whole(x, y)


def test_compiled_states_are_taken_over(raw, public):
    machine = tokencounts.Transducer(bpe.parsed(raw))
    data, offsets, _ = text_bytes(pa.array(ODD))
    want = machine.counts(data, offsets).tolist()
    other = tokencounts.compiled(raw, machine.dump())
    made = len(other.states)
    assert other.counts(data, offsets).tolist() == want and len(other.states) == made == len(machine.states)
