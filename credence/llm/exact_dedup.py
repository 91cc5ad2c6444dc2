"""Exact dedup by distributed MSD radix partitioning.

Documents are split by their length and leading bytes, then each group of two or more by
its next bytes, and so on until a group is a single document or its texts have ended.
A group is named by its path, so texts are equal exactly when they end in the same
group: no digest takes part in the decision. Each round is one aggregation with map-side
combine (how many rows have these next bytes) and one join of the rows with it. The join
key is the negated group, so that Spark deals the counts anew and may split the rows'
side where a group of copies is hot. Singles leave after the first round, so
later rounds carry copies and long common beginnings only; the digit grows by a factor
each round, and a text of n bytes takes about log(n) rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import documents, materialize, text_column

FIRST_DIGIT = 64
DIGIT_GROWTH = 16
LARGEST_DIGIT = 64 << 20


def normalized(text):
    """Each run of x20, x09-x0D becomes one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                 carry: tuple[str, ...] = (), first_digit: int = FIRST_DIGIT) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 and `carry`.

    Null texts are empty texts and equal to them. The row with the smallest id stays (null
    ids come last); of rows that repeat that id too, exactly one stays. `carry` names
    input columns that are handed through; they come back as a struct `carried`, so that
    their names cannot clash.
    """
    body = F.encode(normalized(text_column(text_col)), "utf-8")
    extra = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    base = docs.select(F.col(id_col).alias("id"), *extra, body.alias("body"))
    rows = base.select("*", F.octet_length("body").alias("n_bytes"),
                       F.substring("body", 1, first_digit).alias("digit"))
    # the group's name: any number that no other group of this round has
    counts = (rows.select("n_bytes", "digit", F.monotonically_increasing_id().alias("row"))
              .groupBy("n_bytes", "digit").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("group"))
              .select("digit", "n", "group", (-F.col("n_bytes")).alias("key")))
    held = ["id", *(["carried"] if carry else [])]
    first = materialize(
        rows.withColumn("key", -F.col("n_bytes")).join(counts, ["key", "digit"]).select(
            *held, "n", "group", F.sha2("body", 256).alias("sha"),
            F.when(F.col("n") > 1, F.col("body")).alias("rest"),
            F.monotonically_increasing_id().alias("row")),
        "radix-1")
    done = [first.filter("n = 1").select(*held, "sha", F.col("id").alias("keep_id"),
                                         F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))]
    state, start, width = first.filter("n > 1").drop("n"), 1, first_digit
    level = 1
    while not state.isEmpty():
        level += 1
        keyed = state.select("*", F.expr(f"substring(rest, {start}, {width})").alias("digit"),
                             (F.octet_length("rest") < start + width).alias("ended"))
        # all rows of a group have one length, so they end together
        counts = (keyed.groupBy("group", "digit")
                  .agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("next"),
                       F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("least"))
                  .select("digit", "n", "next", "least", (-F.col("group")).alias("key")))
        split = materialize(
            keyed.withColumn("key", -F.col("group")).join(counts, ["key", "digit"]).select(
                *held, "sha", "row", "n", F.col("next").alias("group"), "least",
                (F.col("ended") | (F.col("n") == 1)).alias("over"),
                F.when(~F.col("ended") & (F.col("n") > 1), F.col("rest")).alias("rest")),
            f"radix-{level}")
        done.append(split.filter("over").select(
            *held, "sha", F.col("least.id").alias("keep_id"), F.col("n").alias("group_size"),
            (F.col("row") == F.col("least.row")).alias("kept")))
        state = split.filter("not over").select(*held, "sha", "row", "group", "rest")
        start, width = start + width, min(width * DIGIT_GROWTH, LARGEST_DIGIT)
    return reduce(DataFrame.unionByName, done).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"),
        *(["carried"] if carry else []))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with their own columns."""
    return (exact_groups(docs, id_col, text_col, carry=tuple(docs.columns))
            .filter("kept").select("carried.*"))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)
"""
