from collections import Counter

import pytest
from test_near import by_force

import corpus_pipeline
from tributary.llm import bpe, mixing, near, pii, quality

NAMES = ["quality rules", "MinHash near-dedup", "PII", "mixing sources to target weights", "BPE encoding and decoding"]


def test_stages_one_after_another(spark, sf, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    docs, seen = documents, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        seen.append(docs.collect())
    assert all(d and set(d[0].asDict()) == set(documents.columns) for d in seen[:4])
    before = {r.doc_id: r.text for r in documents.collect()}
    rules, single, private, mixed, last = ([r for r in d] for d in seen)
    assert {r.doc_id for r in rules} == {r.doc_id for r in quality.report(documents).collect()}
    gone = {i for i, _ in by_force([(r.doc_id, r.text) for r in rules])}
    assert len({r.doc_id for r in rules} - {r.doc_id for r in single} ^ gone) <= 0.05 * len(gone) + 1
    assert {r.doc_id: r.text for r in private} == {r.doc_id: pii.redacted(before[r.doc_id]) for r in single}
    assert all(r.n_chars == len(r.text) for r in private)
    want = mixing.quotas(Counter(r.source for r in private))
    assert Counter(r.source for r in mixed) == Counter({s: n for s, n in want.items() if n})
    own = bpe.parse(open(bpe.VOCABULARY, "rb").read())
    texts = {r.doc_id: r.text for r in mixed}
    assert {r.doc_id for r in last} == set(texts) and all(r.round_trip and b"".join(own.tokens[t] for t in r.tokens).decode() == texts[r.doc_id] for r in last)


def test_run_is_its_stages(spark, sf, documents):
    docs = documents
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, docs.collect()))


def test_mixing_writes_its_order(spark, sf, documents, tmp_path):
    """Shard by shard, each in its shuffled order, in the files."""
    corpus_pipeline.mixed(spark, documents, sf).write.parquet(str(tmp_path / "mixed"))
    place = {r.doc_id: (r.shard, r.position) for r in mixing.mix(documents).collect()}
    files = spark.read.parquet(str(tmp_path / "mixed")).selectExpr("_metadata.file_name AS f", "_metadata.row_index AS i", "doc_id").orderBy("f", "i").collect()
    assert len(files) == len(place)
    for a, b in zip(files, files[1:]):
        assert a.f != b.f or place[a.doc_id] < place[b.doc_id]


@pytest.mark.parametrize("place", range(4))
def test_stages_on_awkward_rows(spark, sf, awkward, place):
    stage = corpus_pipeline.STAGES[place][1]
    assert stage(spark, awkward, sf).columns == awkward.columns
    assert stage(spark, awkward.limit(0), sf).count() == 0


def test_whole_pipeline_on_awkward_rows(spark, sf, awkward):
    docs = awkward
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.columns == ["doc_id", "tokens", "n_tokens", "round_trip"] and docs.count() > 0


def test_without_these_operators_the_rest_works(tmp_path):
    """The library and the entry module import where these folders are gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(corpus_pipeline.__file__)
    shutil.copytree(os.path.join(root, "tributary"), tmp_path / "tributary", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=60)


def test_near_threshold_is_documented():
    assert near.SEARCH.threshold == 0.55 and near.SEARCH.words == 3
