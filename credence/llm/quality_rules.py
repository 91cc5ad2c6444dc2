"""Quality rules with host-level verdicts.

Every document is measured in one pass. Two fixed rules reject a document outright. Further
soft rules are evidence: each has a ratio of how much likelier a bad document fails it than a
good one, counted on labelled documents that pass the fixed rules; a rule that is no sign of a
bad document there has no part in verdicts. Soft failures are summed by host (the `source` column), the host's
failure rate is shrunk towards the corpus rate by a beta prior whose two parameters are
estimated from the hosts themselves (moments, less the variance that sampling alone gives),
and the host's verdict is joined back: its rate is the prior of each of its documents. A
document goes if the odds of its host times the ratios of the soft rules it fails come to
REJECT_ODDS; so on a clean host it takes more to go than on a bad one, and a document that
fails no rule always stays, whatever its host.

The aggregation by host combines on the map side, so a host with a third of all rows is
one row per task; the join back streams the documents against one row per host, which is
sent to all tasks up to a bound on the number of hosts.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.llm.common import documents, materialize

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_WORD = re.compile(r"[^\x20\x09-\x0D]")
#: How many times likelier a bad document fails a soft rule than a good one, for tables without labels:
#: many symbols, many repeated lines, very short words, very long words on average.
RATIOS = {"symbols": 40.0, "lines": 4.0, "short": 10.0, "long": 10.0}
#: A rule that fewer labelled documents fail has a ratio of 1.
LEAST_FAILURES = 10
#: Up to so many bytes of hosts' names and rates they are sent to all tasks; beyond, documents are dealt by host.
SENT_BYTES = 32 << 20
#: A document goes if the odds against it are at least this.
REJECT_ODDS = 1.0


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of three words that the text has twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    own = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    pairs, distinct = pd.factorize(own[:-1] * len(numbers) + own[1:])
    windows, distinct = pd.factorize(pairs[:-1] * len(numbers) + own[2:])
    again = np.bincount(windows, minlength=len(distinct))[windows] >= 2
    repeated = np.zeros(len(words), bool)
    for k in range(3):
        repeated[k : k + len(again)] |= again
    return int(repeated.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of one text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: x20, x09-x0D only
    seen, duplicates, lines = set(), 0, 0
    for line in text.split("\n"):
        if _WORD.search(line):
            lines += 1
            if line in seen:
                duplicates += 1
            else:
                seen.add(line)
    code_points = len(text) - (len(data) - sum(map(len, words)))
    return len(words), code_points, len(_SYMBOL.findall(text)), duplicates, repeated_words(words), lines


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in MEASURES]))
def _measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(x) for x in texts], columns=MEASURES).astype("int64")


def base_failed():
    return (F.col("m.n_words") < 50) | (100 * F.col("m.n_repeat_words") > 50 * F.col("m.n_words"))


def soft_rules() -> dict:
    """Whether each soft rule fails, by its name in RATIOS."""
    return {"symbols": 10 * F.col("m.n_symbols") > F.col("m.n_words"), "lines": 10 * F.col("m.n_dup_lines") > 3 * F.col("m.n_lines"),
            "short": F.col("m.word_chars") < 3 * F.col("m.n_words"), "long": F.col("m.word_chars") > 12 * F.col("m.n_words")}


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """carried, id, host, m, base_failed and, as a struct `soft`, whether each soft rule fails."""
    named = lambda c: F.col(f"`{c}`")
    found = docs.select(F.struct(*map(named, carry)).alias("carried"), named(id_col).cast("bigint").alias("id"), named(host_col).alias("host"),
                        _measures(named(text_col).cast("string")).alias("m"))
    return found.withColumns({"base_failed": base_failed(), "soft": F.struct(*[failed.alias(name) for name, failed in soft_rules().items()])})


def rule_ratios(rows: DataFrame, labels: DataFrame) -> dict[str, float]:
    """For each soft rule how many times likelier a bad document fails it, by the labels of documents that pass the fixed rules.

    `rows` as `measured` has them; `labels` has doc_id and quality. A third of the ids (crc32 of the id as
    text, modulo 3, is 1) is held out and not used. Halves of a document are added on either side, so a
    rule that no good document fails has a finite ratio. At least 1.
    """
    good = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(F.pmod(F.crc32(F.col("doc_id").cast("bigint").cast("string")), F.lit(3)) != 1)
            .groupBy(F.bitwise_not(F.col("doc_id").cast("bigint")).alias("turned")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good")))
    joined = rows.filter("NOT base_failed").select(F.bitwise_not("id").alias("turned"), "soft").join(good, "turned")
    of = {r["good"]: r for r in joined.groupBy("good").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"soft.{name}")).alias(name) for name in RATIOS]).collect()}  # two rows
    count = lambda side, what: of[side][what] if side in of else 0
    out = {}
    for name in RATIOS:
        bad, good_ = count(0, name), count(1, name)
        ratio = ((bad + 0.5) / (count(0, "n") + 1.0)) / ((good_ + 0.5) / (count(1, "n") + 1.0))
        out[name] = max(1.0, ratio) if bad + good_ >= LEAST_FAILURES else 1.0
    return out


def _with_evidence(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """`rows` with the product of the failed soft rules' ratios, 1 without one."""
    ratios = RATIOS if labels is None else rule_ratios(rows, labels)
    evidence = F.lit(1.0)
    for name, ratio in ratios.items():
        evidence = evidence * F.when(F.col(f"soft.{name}"), ratio).otherwise(1.0)
    return rows.withColumn("evidence", evidence)


def host_verdicts(rows: DataFrame) -> tuple[DataFrame, bool]:
    """One row per host: rows, failures, shrunk rate; and whether the table is small.

    The prior beta(a, b) has the mean of all rows. a + b comes from the correlation within
    hosts, estimated from the weighted squares of the hosts' deviations less what sampling
    alone would give. With one host, or hosts that differ no more than by chance, the prior
    is so strong that all hosts get the corpus rate.
    """
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("evidence") > 1).alias("failed"))
    rate = F.col("failed") / F.col("n")
    sums = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"), F.sum("failed").alias("failed"),
                     F.sum(F.col("n").cast("double") * F.col("n")).alias("sizes"), F.sum(F.col("n") * rate * rate).alias("squares"),
                     F.sum(F.coalesce(F.octet_length(F.col("host").cast("string")), F.lit(0)) + 64).alias("bytes")).first()
    n, failed = sums["n"] or 0, sums["failed"] or 0
    mean = failed / n if n else 0.0
    free, strength = sums["hosts"] - 1, 1e12
    if 0 < mean < 1 and (wide := n - sums["sizes"] / n - free) > 0:
        within = ((sums["squares"] - n * mean * mean) / (mean * (1 - mean)) - free) / wide
        if within > 1e-12:
            strength = max(1 / within - 1, 1e-3)
    shrunk = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("host_rate", shrunk), (sums["bytes"] or 0) <= SENT_BYTES


def judge(rows: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """`rows` with evidence, host_rate and kept."""
    rows = _with_evidence(rows, labels)
    hosts, small = host_verdicts(rows)
    hosts = hosts.select(F.col("host").alias("host_name"), "host_rate")
    hosts = F.broadcast(hosts) if small else hosts
    joined = rows.join(hosts, rows["host"].eqNullSafe(hosts["host_name"]), "left").drop("host_name")
    # odds of rate / (1 - rate), so that a rate of 1 divides nothing by 0
    against = F.col("host_rate") * F.col("evidence") >= REJECT_ODDS * (1 - F.col("host_rate"))
    return joined.withColumn("kept", ~F.col("base_failed") & ~((F.col("evidence") > 1) & against))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *, labels: DataFrame | None = None) -> DataFrame:
    """One row per input row: id, measures, base_failed, soft_failed, host_rate, kept.

    Null and empty texts have no words and so fail; a null host is a host of its own.
    `labels` (doc_id, quality) give the soft rules' ratios; without them they are RATIOS.
    """
    rows = materialize(measured(docs, id_col, text_col, host_col, (id_col,)), "measures")
    return judge(rows, labels).select("carried.*", "m.*", "base_failed", (F.col("evidence") > 1).alias("soft_failed"), "host_rate", "kept")


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *, labels: DataFrame | None = None) -> DataFrame:
    """The rows of `docs` that pass, with their own columns, whatever their names."""
    return judge(materialize(measured(docs, id_col, text_col, host_col, tuple(docs.columns)), "measures"), labels).filter("kept").select("carried.*")


def labels_of(spark, sf_dir: str) -> DataFrame | None:
    """The labels beside the documents, None where there are none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/labels.parquet")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(f"{sf_dir}/labels.parquet") if there else None


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir), labels=labels_of(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
x AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS ls FROM d),
e AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM x),
g AS (SELECT r, i, word, lead(word, 1) OVER p AS second, lead(word, 2) OVER p AS third
      FROM e WINDOW p AS (PARTITION BY r ORDER BY i)),
tri AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, second, third) AS c FROM g WHERE third IS NOT NULL),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE c >= 2) GROUP BY r),
m AS (SELECT x.doc_id, x.source, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM x LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > n_words AS symbols,
             10 * n_dup_lines > 3 * n_lines AS lines, word_chars < 3 * n_words AS short, word_chars > 12 * n_words AS long FROM m),
crc AS (SELECT doc_id, quality, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
             lambda y, z: list_reduce([xor(y, z)] || range(8), lambda u, k: CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384::BIGINT) ELSE u >> 1 END)), 4294967295::BIGINT) AS crc
        FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good FROM crc WHERE crc % 3 <> 1 GROUP BY doc_id),
j AS (SELECT good, symbols, lines, short, long FROM b JOIN lab USING (doc_id) WHERE NOT base_failed),
t AS (SELECT count(*) FILTER (good = 0) + 1.0::DOUBLE AS bad, count(*) FILTER (good = 1) + 1.0::DOUBLE AS good FROM j),
k AS (SELECT name, count(*) FILTER (fails AND good = 0) AS bf, count(*) FILTER (fails AND good = 1) AS gf
      FROM (SELECT good, unnest(['symbols', 'lines', 'short', 'long']) AS name, unnest([symbols, lines, short, long]) AS fails FROM j) GROUP BY name),
q AS (SELECT name, CASE WHEN bf + gf >= 10 THEN greatest(1.0::DOUBLE, ((bf + 0.5::DOUBLE) / bad) / ((gf + 0.5::DOUBLE) / good)) ELSE 1.0::DOUBLE END AS ratio FROM k, t),
g4 AS (SELECT coalesce(max(ratio) FILTER (name = 'symbols'), 1.0) AS r1, coalesce(max(ratio) FILTER (name = 'lines'), 1.0) AS r2,
             coalesce(max(ratio) FILTER (name = 'short'), 1.0) AS r3, coalesce(max(ratio) FILTER (name = 'long'), 1.0) AS r4 FROM q),
f AS (SELECT b.*, CASE WHEN symbols THEN r1 ELSE 1.0 END * CASE WHEN lines THEN r2 ELSE 1.0 END * CASE WHEN short THEN r3 ELSE 1.0 END * CASE WHEN long THEN r4 ELSE 1.0 END AS evidence FROM b, g4),
h AS (SELECT source, count(*)::DOUBLE AS n, (count(*) FILTER (evidence > 1))::DOUBLE AS failed FROM f GROUP BY source),
s AS (SELECT count(*) - 1 AS free, sum(n) AS n, sum(failed) / sum(n) AS mean, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS wide,
             sum(failed * failed / n) AS squares FROM h),
w AS (SELECT mean, CASE WHEN mean > 0 AND mean < 1 AND wide > 0
             THEN ((squares - n * mean * mean) / (mean * (1 - mean)) - free) / wide ELSE 0 END AS within FROM s),
p AS (SELECT mean, CASE WHEN within > 1e-12 THEN greatest(1 / within - 1, 1e-3) ELSE 1e12 END AS strength FROM w),
v AS (SELECT source, (failed + mean * strength) / (n + strength) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (evidence > 1 AND rate * evidence >= 1 - rate) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
