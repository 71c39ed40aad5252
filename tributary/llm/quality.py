"""Quality rules with host verdicts.

Every document is put to the rules. Failures are counted by host; each host's
rate is shrunk towards the corpus by a beta prior fitted to all hosts (the
moment estimator of the beta-binomial for unequal sizes); the verdict on the
host is joined back to its documents, where it decides how much a document may
get away with: one that fails a strict rule goes anywhere, one that fails only
a lenient rule goes if its host is bad. A document that fails none stays on any
host. All of it is built-in SQL functions, so the scan stays in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import cut, fresh, load
from tributary.llm.common import quoted as _quoted

#: Beginnings of insulting words.
INSULTS = ("idiot", "moron", "imbecile", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown", "dumbass", "bastard")
INSULT = rf"(?i)(?:^|[^a-z])(?:{'|'.join(INSULTS)})"
#: Insults as whole words, in English, German, French and Spanish; the oracle's SQL knows only the beginnings.
INSULTING = (
    *INSULTS, "idiotic", "idiocy", "moronic", "stupidity", "scumbag", "asshole", "arsehole", "bitch", "bitches", "cunt", "dickhead", "shithead", "fuckwit", "wanker", "twat", "douchebag", "jackass", "jackasses", "dumbasses", "motherfucker", "halfwit", "dimwit", "cretin", "lowlife",
    "idioten", "vollidiot", "vollidioten", "trottel", "dummkopf", "schwachkopf", "arschloch", "arschlöcher", "wichser", "hurensohn", "schlampe", "missgeburt", "drecksack",
    "connard", "connasse", "salaud", "salope", "abruti", "crétin", "enculé", "débile", "ordure", "imbécile",
    "idiota", "imbécil", "imbéciles", "estúpido", "estúpida", "gilipollas", "cabrón", "pendejo", "pendeja", "puta", "maricón", "escoria", "payaso",
)
INSULTING_WORDS = sorted({w + end for w in INSULTING for end in ("", "s")})
SYMBOL, BLANKS, CAPITAL = r"[#*$%&|<>{}~^]", r"[ \t\n\r\f]+", r"\p{Lu}"


@dataclass(frozen=True)
class Limits:
    """Production limits of the rules and the verdict."""

    symbols_a_word: float = 0.1
    shouts_a_word: float = 0.1
    #: So many symbols or exclamation marks are too few to count against a text.
    few_marks: int = 4
    capitals: float = 0.4
    repeated_words: float = 0.2
    repeated_lines: float = 0.4
    least_lines: int = 4
    insults: int = 2
    #: Fewer insults a word don't count against a text.
    insults_a_word: float = 0.002
    lenient_insults_a_word: float = 0.001
    least_words: int = 5
    lenient_capitals: float = 0.2
    lenient_repeated_lines: float = 0.2
    #: A host is bad if its shrunken rate of documents that fail a strict rule exceeds this many times the corpus rate, and this rate.
    bad_times: float = 2.0
    bad_rate: float = 0.3
    #: Bounds of the share of variance that lies between hosts.
    least_between: float = 1e-4
    most_between: float = 0.5


LIMITS = Limits()


def _failures(v: str, limits: Limits, rated: bool = True) -> tuple[str, str]:
    """SQL of how many strict and lenient rules fail, over a prefix of the features; both dialects take it.

    The oracle's counts insults whatever the length of the text: not ``rated``.
    """
    some = f"greatest({v}n_words, 1)"
    strict = (
        f"{v}n_words = 0",
        f"({v}n_symbols > {limits.few_marks} AND {v}n_symbols > {limits.symbols_a_word} * {some})",
        f"({v}n_shouts > {limits.few_marks} AND {v}n_shouts > {limits.shouts_a_word} * {some})",
        f"({v}n_words >= {limits.least_words} AND {v}n_capitals > {limits.capitals} * {v}n_chars)",
        f"({v}n_words >= {limits.least_words} AND {v}n_repeated > {limits.repeated_words} * {some})",
        f"({v}n_lines >= {limits.least_lines} AND {v}n_lines - {v}n_distinct_lines > {limits.repeated_lines} * {v}n_lines)",
        f"({v}n_insults >= {limits.insults} AND {v}n_insults > {limits.insults_a_word} * {some})" if rated else f"{v}n_insults >= {limits.insults}",
    )
    lenient = (
        f"{v}n_words < {limits.least_words}",
        f"{v}n_capitals > {limits.lenient_capitals} * {v}n_chars",
        f"({v}n_lines >= {limits.least_lines} AND {v}n_lines - {v}n_distinct_lines > {limits.lenient_repeated_lines} * {v}n_lines)",
        f"({v}n_insults >= 1 AND {v}n_insults > {limits.lenient_insults_a_word} * {some})" if rated else f"{v}n_insults >= 1",
    )
    total = lambda rules: " + ".join(f"CASE WHEN {r} THEN 1 ELSE 0 END" for r in rules)
    return total(strict), total(lenient)


def judged(df: DataFrame, limits: Limits, text_column: str, host_column: str) -> tuple[DataFrame, str, str]:
    """``df`` with a host column (null is the host '') and a struct of the rule failures; their names."""
    text, words, lines, counts, host, failures = fresh(df, "own_text", "own_words", "own_lines", "own_counts", "own_host", "own_failures")
    w = _quoted(words)
    out = df.withColumn(text, F.coalesce(F.col(_quoted(text_column)).cast("string"), F.lit("")))
    out = out.withColumn(words, F.array_remove(F.split(text, BLANKS), "")).withColumn(lines, F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\r\f]")))
    out = out.withColumn(
        counts,
        F.struct(
            F.size(words).alias("n_words"),
            F.length(text).alias("n_chars"),
            F.regexp_count(F.col(text), F.lit(SYMBOL)).alias("n_symbols"),
            F.regexp_count(F.col(text), F.lit("!")).alias("n_shouts"),
            F.regexp_count(F.col(text), F.lit(CAPITAL)).alias("n_capitals"),
            # Looking words up in a set costs half of what one pattern of so many words does.
            F.size(F.filter(F.split(F.lower(text), r"\P{L}+"), lambda x: x.isin(INSULTING_WORDS))).alias("n_insults"),
            # One pass that holds no second reference to the words, which would be split again for each.
            F.expr(f"aggregate({w}, named_struct('last', cast(null AS string), 'n', 0), (a, x) -> named_struct('last', x, 'n', a.n + if(x <=> a.last, 1, 0)), a -> a.n)").alias("n_repeated"),
            F.size(lines).alias("n_lines"),
            F.size(F.array_distinct(lines)).alias("n_distinct_lines"),
        ),
    )
    strict, lenient = _failures(f"{_quoted(counts)}.", limits)
    out = out.withColumn(failures, F.struct(F.col(counts)["n_words"].cast("bigint").alias("n_words"), F.expr(strict).cast("bigint").alias("strict"), F.expr(lenient).cast("bigint").alias("lenient")))
    out = out.withColumn(host, F.coalesce(F.col(_quoted(host_column)).cast("string"), F.lit("")))
    return out.drop(text, words, lines, counts), host, failures


def hosts(host_and_strict: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """host, docs, failed, rate, bad: of a table of ``host`` and ``strict``.

    The rate is (failed + m k) / (docs + k) where m is the corpus rate and k the
    prior's weight. One host alone, or a corpus where all fail or none, leaves the
    spread between hosts at its lower bound.
    """
    own = host_and_strict.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.when(F.col("strict") > 0, 1).otherwise(0)).cast("bigint").alias("failed"))
    n, f = F.col("docs").cast("double"), F.col("failed").cast("double")
    total = own.agg(F.sum(n).alias("w"), F.sum(f).alias("f"), F.sum(n * n).alias("q"), F.count(F.lit(1)).cast("double").alias("h"), F.sum(f * f / n).alias("s"))
    m = F.col("f") / F.col("w")
    within = m * (1 - m)
    below = within * (F.col("w") - F.col("q") / F.col("w") - (F.col("h") - 1))
    between = F.when(below > 0, (F.col("s") - F.col("f") * m - within * (F.col("h") - 1)) / below).otherwise(F.lit(0.0))
    total = total.select(m.alias("m"), F.least(F.greatest(between, F.lit(limits.least_between)), F.lit(limits.most_between)).alias("between"))
    total = total.select("m", (1 / F.col("between") - 1).alias("k"))
    rate = (f + F.col("m") * F.col("k")) / (n + F.col("k"))
    out = own.crossJoin(F.broadcast(total))  # one row
    return out.select("host", "docs", "failed", rate.alias("rate"), (rate > F.greatest(F.lit(limits.bad_times) * F.col("m"), F.lit(limits.bad_rate))).alias("bad"))


def _stays(strict: Column, lenient: Column, bad: Column) -> Column:
    """One condition, so that no part of it is pushed below the join and worked out twice there."""
    return F.when(strict == 0, (lenient == 0) | ~bad).otherwise(False)


def keep(df: DataFrame, limits: Limits = LIMITS, text_column: str = "text", host_column: str = "source") -> DataFrame:
    """The rows of ``df`` that stay, with its columns.

    A null text counts as an empty one, which fails; a null host is a host of its
    own, ''. Repeated rows are judged alike, each counted. Ids aren't used. An
    empty table gives an empty one. Texts are judged whole, once: the rows that fail
    no strict rule are written to the shared folder, and read again when the hosts'
    verdicts are known.
    """
    spark = df.sparkSession
    own, host, failures = judged(df, limits, text_column, host_column)
    (bad,) = fresh(own, "own_bad")
    strict, lenient = F.col(failures)["strict"], F.col(failures)["lenient"]
    # Judged once: verdicts, and the rows that may stay, are written; of the others only what their hosts need.
    columns = [f"c{i}" for i in range(len(df.columns))]
    row = F.when(strict == 0, F.struct(*(F.col(_quoted(c)).alias(to) for c, to in zip(df.columns, columns, strict=True))))
    own = cut(spark, own.select(F.col(host).alias("host"), strict.alias("strict"), lenient.alias("lenient"), row.alias("row")), "judged")
    # Written too, so that its size is known: only then is it broadcast, if that allows, without moving texts first.
    verdicts = cut(spark, hosts(own, limits).filter("bad").select("host", F.col("bad").alias(bad)), "hosts")
    own = own.filter("strict = 0").join(verdicts, "host", "left").filter((F.col("lenient") == 0) | ~F.coalesce(bad, F.lit(False)))
    return own.select(*(F.col(f"row.{c}").alias(to) for c, to in zip(columns, df.columns, strict=True)))


def report(df: DataFrame, limits: Limits = LIMITS, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """The documents that stay, each with its failures and its host's verdict; nulls, repeats and empty tables as in :func:`keep`.

    The failures of each document, without its text, are written to the shared
    folder, so that texts are read once.
    """
    own, host, failures = judged(df.select(F.col(_quoted(id_column)).alias("doc_id"), F.col(_quoted(text_column)).alias("text"), F.col(_quoted(host_column)).alias("source")), limits, "text", "source")
    own = cut(df.sparkSession, own.select("doc_id", F.col(host).alias("host"), f"{failures}.*"), "quality")
    out = own.join(cut(df.sparkSession, hosts(own, limits), "hosts"), "host").filter(_stays(F.col("strict"), F.col("lenient"), F.col("bad")))
    return out.select("doc_id", "host", "n_words", F.col("lenient").alias("lenient_failures"), F.col("docs").alias("host_docs"), F.col("failed").alias("host_failed"), F.round("rate", 6).alias("host_rate"), F.col("bad").alias("host_bad"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the rules and their hosts' verdicts keep."""
    return report(load(spark, sf_dir, "documents"))


def _oracle(limits: Limits = LIMITS) -> str:
    strict, lenient = _failures("", limits, rated=False)
    n = lambda pattern: f"len(regexp_extract_all(t, '{pattern}'))"
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS host, coalesce("text", '') AS t FROM documents),
parts AS (SELECT *, list_filter(string_split_regex(t, '{BLANKS}'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS l FROM texts),
counts AS (SELECT doc_id, host, len(w) AS n_words, length(t) AS n_chars, {n(SYMBOL)} AS n_symbols, {n('!')} AS n_shouts,
  {n(CAPITAL)} AS n_capitals, {n(INSULT)} AS n_insults, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_repeated,
  len(l) AS n_lines, len(list_distinct(l)) AS n_distinct_lines FROM parts),
judged AS (SELECT doc_id, host, n_words, {strict} AS strict, {lenient} AS lenient FROM counts),
hosts AS (SELECT host, count(*) AS docs, count(*) FILTER (WHERE strict > 0) AS failed FROM judged GROUP BY host),
sums AS (SELECT sum(docs)::DOUBLE AS w, sum(failed)::DOUBLE AS f, sum(docs::DOUBLE * docs) AS q, count(*)::DOUBLE AS h, sum(failed::DOUBLE * failed / docs) AS s FROM hosts),
rates AS (SELECT *, f / w AS m FROM sums),
spread AS (SELECT m, CASE WHEN m * (1 - m) * (w - q / w - (h - 1)) > 0 THEN (s - f * m - m * (1 - m) * (h - 1)) / (m * (1 - m) * (w - q / w - (h - 1))) ELSE 0 END AS r FROM rates),
prior AS (SELECT m, 1 / least(greatest(r, {limits.least_between}), {limits.most_between}) - 1 AS k FROM spread),
verdicts AS (SELECT host, docs, failed, (failed + m * k) / (docs + k) AS rate, (failed + m * k) / (docs + k) > greatest({limits.bad_times} * m, {limits.bad_rate}) AS bad FROM hosts, prior)
SELECT doc_id, host, CAST(n_words AS BIGINT) AS n_words, CAST(lenient AS BIGINT) AS lenient_failures, CAST(docs AS BIGINT) AS host_docs,
  CAST(failed AS BIGINT) AS host_failed, round(rate, 6) AS host_rate, bad AS host_bad
FROM judged JOIN verdicts USING (host) WHERE strict = 0 AND (lenient = 0 OR NOT bad)"""


ORACLE = _oracle()
