from support import same
from pyspark.sql import types as T

from tributary.llm import quality
from tributary.llm.quality import LIMITS, Limits

GOOD = "A sensible sentence with enough ordinary words in it to be kept by every rule."


def test_agrees_with_sql(spark, sf, duck):
    same(quality.op1(spark, sf).toPandas(), duck.execute(quality.ORACLE).fetchdf())


def test_keep_is_report(documents):
    kept, reported = quality.keep(documents), quality.report(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in reported.collect())


def test_rules(make):
    bad = ["", None, " \n", "a*** b### c$$$ d%%% e&&& f", "STOP!! SHOUTING!! NOW!! PLEASE!! EVERYONE!!", "the the the the the the on on on on on", "x\ny\nx\ny\nx\ny\nx\ny\nz\n" * 3, "you idiot and pathetic clown, go away now please"]
    df = make(*enumerate([*bad, GOOD, "Short.", "one " + GOOD]))
    assert sorted(r.doc_id for r in quality.keep(df).collect()) == [8, 9, 10]


def test_bad_hosts_lose_lenient_failures_only(make):
    junk = [(i, "a*** b### c$$$ d%%% e&&& f", "bad") for i in range(50)]
    fine = [(100 + i, GOOD, "good") for i in range(300)]
    df = make(*junk, *fine, (1000, "Short.", "bad"), (1001, "Short.", "good"), (1002, GOOD, "bad"), (1003, "Short.", None))
    assert {r.doc_id for r in quality.keep(df).collect() if r.doc_id >= 1000} == {1001, 1002, 1003}
    verdicts = {r.host: r for r in quality.hosts(df.selectExpr("coalesce(source, '') AS host", "if(text like 'a%', 1, 0) AS strict")).collect()}
    m = 50 / 354
    assert verdicts["bad"].bad and not verdicts["good"].bad and m < verdicts["bad"].rate < 50 / 52 and 0 < verdicts["good"].rate < m
    # One document's failure says less than fifty's.
    assert verdicts[""].rate < m and verdicts[""].rate > verdicts["good"].rate


def test_prior_is_the_moment_estimate(spark):
    counts = {"a": (10, 3), "b": (200, 20), "c": (35, 30), "d": (1, 0)}
    df = spark.createDataFrame([(h, int(i < f)) for h, (n, f) in counts.items() for i in range(n)], "host string, strict int")
    w, f = sum(n for n, _ in counts.values()), sum(f for _, f in counts.values())
    m, h = f / w, len(counts)
    s = sum(f * f / n for n, f in counts.values()) - f * m
    r = (s - m * (1 - m) * (h - 1)) / (m * (1 - m) * (w - sum(n * n for n, _ in counts.values()) / w - (h - 1)))
    k = 1 / min(max(r, LIMITS.least_between), LIMITS.most_between) - 1
    for row in quality.hosts(df).collect():
        n, own = counts[row.host]
        assert abs(row.rate - (own + m * k) / (n + k)) < 1e-9


def test_awkward(awkward, make):
    kept = quality.keep(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "10", "10", "5", "6", "7", "8", "9", "None"]
    assert quality.keep(awkward.limit(0)).count() == 0 and quality.report(awkward.limit(0)).count() == 0
    assert quality.hosts(awkward.sparkSession.createDataFrame([], T.StructType([T.StructField("host", T.StringType()), T.StructField("strict", T.LongType())]))).count() == 0
    assert quality.keep(make((1, ""), (2, None))).count() == 0
    assert quality.keep(make((1, GOOD)), Limits(bad_rate=0.0)).count() == 1


def test_blank_lines_are_no_lines(make):
    """Paragraphs set apart by blank lines repeat nothing; repeated ones still do."""
    words = ("river", "garden", "market", "winter", "letter", "kitchen", "mountain", "teacher", "window", "harbour")
    for blank in ("\n\n", "\r\n\r\n", "\n \t\n\n\n"):
        paragraphs = [f"This paragraph tells of the {w} and of nothing else." for w in words]
        df = make((1, blank.join(paragraphs)), (2, blank.join(paragraphs[:4])), (3, blank.join([*paragraphs[:2]] * 4)))
        assert {r.doc_id: r.lenient_failures for r in quality.report(df).collect()} == {1: 0, 2: 0}


def test_insults_are_whole_words_judged_by_length(make):
    long_ = " ".join(f"word{i}" for i in range(20_000))
    texts = [
        "Clownfish live in anemones. The clownfish is orange and stays near its host.",
        f"The idiot {long_} was called stupid.",
        "Du Arschloch, du bist ein Trottel und bleibst es auch.",
        "Eres un imbécil y un gilipollas, vete de aquí ahora mismo.",
        "Espèce de connard, tu es un abruti fini et rien de plus.",
        "Those losers are idiots and nobody should listen to them.",
    ]
    assert {r.doc_id: r.lenient_failures for r in quality.report(make(*enumerate(texts))).collect()} == {0: 0, 1: 0}
