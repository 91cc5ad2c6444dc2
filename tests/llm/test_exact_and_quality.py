"""Exact dedup, quality rules, sharding and line dedup on small tables and against brute force."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from credence.llm import exact_dedup, line_dedup, quality_rules, sharding

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, texts, **more):
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [(0, "a b"), (1, "a  b"), (2, "a\tb"), (3, None), (4, ""), (5, "long " * 3000), (6, "long " * 3000), (6, "long " * 3000), (7, "long " * 2999 + "lone "), (8, "\n"), (9, "x" * 64), (10, "x" * 65), (None, "a b")]


def test_exact_groups(spark):
    got = exact_dedup.exact_groups(table(spark, ODD)).collect()
    assert len(got) == len(ODD)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in ODD:
        groups[norm(t)].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        for i in ids:
            want[(i, min(x for x in ids if x is not None), len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    clash = table(spark, ODD).withColumn("kept", F.lit("mine")).withColumn("group", F.lit(1))
    kept = exact_dedup.exact_dedup(clash)
    assert kept.columns == clash.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = collections.Counter(windows)
    repeated = {k + d for k, w in enumerate(windows) if times[w] >= 2 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


@pytest.mark.parametrize("text", [None, "", " \n\t ", "a b c a b c", "äß # ñ\n\nline\nline\nline ", "x " * 500, "a\x0bb\x0cc\x1cd e f", "   a b c"])
def test_measures(text):
    assert quality_rules.measure(text)[:5] == brute_quality(text)


def sql_rows(query, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    if (folder / "labels.parquet").exists():
        con.execute(f"CREATE VIEW labels AS SELECT * FROM '{folder}/labels.parquet/*.parquet'")
    return con.execute(query).fetchall()


GOOD, POOR, LINES = " ".join(f"word{k}" for k in range(60)), " ".join(f"w{k}#" for k in range(60)), "\n".join([" ".join(f"line{k}" for k in range(10))] * 2 + [" ".join(f"more{k}" for k in range(60))])


def test_host_verdicts(spark, tmp_path):
    # s0 has poor documents only, s1 one in forty, s2 none; each has a document with repeated lines and a poor one
    docs = [(3 * k, POOR) for k in range(60)] + [(3 * k + 1, POOR if k % 40 == 5 else GOOD) for k in range(200)] + [(3 * k + 2, GOOD) for k in range(200)]
    docs += [(3 * k + s, LINES) for s in range(3) for k in (1000,)] + [(3 * 1001 + 2, POOR)] + [(6000, "spam " * 80), (6001, None), (6002, "")]
    rows = {r["doc_id"]: r for r in quality_rules.quality_verdicts(table(spark, docs)).collect()}
    text = dict(docs)
    assert all(r["kept"] for i, r in rows.items() if text[i] == GOOD) and not any(rows[i]["kept"] for i in (6000, 6001, 6002))
    # the same repeated lines stay on the clean hosts and go on the bad one, symbols stay on the cleanest only
    assert [rows[3000 + s]["kept"] for s in range(3)] == [False, True, True]
    assert not rows[0]["kept"] and rows[3005]["kept"]
    assert rows[0]["host_rate"] > 0.9 and rows[2]["host_rate"] < 0.02 < rows[1]["host_rate"]
    frame = table(spark, docs).withColumn("m", F.lit("mine")).withColumn("kept", F.lit(0)).withColumn("host", F.lit("x"))
    passed = quality_rules.quality_filter(frame)
    assert passed.columns == frame.columns and {r["doc_id"] for r in passed.collect()} == {i for i, r in rows.items() if r["kept"]}
    assert quality_rules.quality_verdicts(table(spark, [])).count() == 0 and quality_rules.quality_filter(table(spark, [])).count() == 0
    null_host = table(spark, [(1, GOOD), (1, GOOD), (None, POOR)]).withColumn("source", F.lit(None).cast("string"))
    assert len(quality_rules.quality_verdicts(null_host).collect()) == 3
    # with labels: symbols are a sign of bad documents, repeated lines of good ones
    every = table(spark, docs).union(null_host)
    labels = [(i, 0 if t == POOR else 1, 0) for i, t in docs] + [(i, 1, 0) for i, t in docs if t == LINES] + [(None, 0, 0), (5, None, 0)]
    held = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = quality_rules.measured(table(spark, docs))
    used = [(i, t) for i, t in docs if t and zlib.crc32(str(i).encode()) % 3 != 1]
    bad, good = (sum(t == x for _, t in used) for x in (POOR, GOOD))
    ratios = quality_rules.rule_ratios(rows, held)
    assert ratios == {"symbols": ((bad + 0.5) / (bad + 1)) / (0.5 / (good + sum(t == LINES for _, t in used) + 1)), "lines": 1.0, "short": 1.0, "long": 1.0}
    assert set(quality_rules.rule_ratios(rows, held.limit(0)).values()) == {1.0}
    verdicts = {r["doc_id"]: r for r in quality_rules.quality_verdicts(table(spark, docs), labels=held).collect()}
    assert all(verdicts[3000 + k]["kept"] for k in range(3)) and not verdicts[0]["kept"]
    # what the hosts change: of the documents with symbols those on the cleanest host stay, with one rate for all hosts none does
    one_host = {r["doc_id"]: r["kept"] for r in quality_rules.quality_verdicts(table(spark, docs).withColumn("source", F.lit("all"))).collect()}
    by_host = {r["doc_id"]: r["kept"] for r in quality_rules.quality_verdicts(table(spark, docs)).collect()}
    assert {i for i in by_host if by_host[i] != one_host[i]} == {3000, 3005}
    every.write.parquet(str(tmp_path / "documents.parquet"))
    held.write.parquet(str(tmp_path / "labels.parquet"))
    order = lambda r: (r[0] is None, r[0] or 0, r)
    got = sorted((tuple(r) for r in quality_rules.op7_quality_rules(spark, str(tmp_path)).collect()), key=order)
    assert got == sorted(sql_rows(quality_rules.SQL, tmp_path), key=order)


def test_hosts_that_differ_by_chance_get_the_corpus_rate(spark):
    rng = random.Random(1)
    docs = [(k, POOR if rng.random() < 0.3 else GOOD) for k in range(600)]
    rates = {r["host_rate"] for r in quality_rules.quality_verdicts(table(spark, docs)).collect()}
    mean = sum(t == POOR for _, t in docs) / len(docs)
    assert all(abs(r - mean) < 0.02 for r in rates)


def test_shards(spark):
    docs = table(spark, [(k, f"text {k}") for k in range(103)] + [(5, "text 5")] * 50 + [(None, None)])
    got = sharding.shard(docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"), "text"), 7, size="size", bucket_rows=20, seed=3)
    rows = got.select("record.*", "shard", "slot").collect()
    assert len(rows) == 154
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(r["doc_id"] for r in docs.collect())
    assert sharding.shard(docs.limit(0), 7).count() == 0
    assert sorted(sharding.fisher_yates(50, (1, 2))) == list(range(50)) and sharding.fisher_yates(50, (1, 2)) != list(range(50))


def test_shards_do_not_depend_on_the_split(spark):
    docs = [(k, f"text {k}") for k in range(900)] + [(5, "text 5")] * 400 + [(None, None)] * 3
    frame = table(spark, docs)
    got = []
    for parts in (1, 2, 7):
        # 1000 rows a bucket: records that repeat more than ten times are numbered
        rows = sharding.shard(frame.repartition(parts), 7, bucket_rows=1000, seed=4).select("record.doc_id", "record.text", "shard", "slot")
        got.append(collections.Counter(map(tuple, rows.collect())))
    assert got[0] == got[1] == got[2] and got[0].total() == len(docs) and max(got[0].values()) == 1
    other = sharding.shard(frame, 7, bucket_rows=1000, seed=5).select("record.doc_id", "record.text", "shard", "slot")
    assert collections.Counter(map(tuple, other.collect())) != got[0]
    # brute force: buckets by the hash of contents, each sorted by it and shuffled, one after another
    hashed = [(r["key"], r["doc_id"]) for r in table(spark, docs[:900]).select("doc_id", F.xxhash64(F.lit(4), F.xxhash64(*frame.columns), F.lit(0).cast("long")).alias("key")).collect()]
    order = []
    for b in range(9):
        own = sorted(x for x in hashed if x[0] % 9 == b)
        order += [own[k][1] for k in sharding.fisher_yates(len(own), (4, b))]
    rows = sharding.shard(table(spark, docs[:900]), 7, bucket_rows=100, seed=4).select("record.doc_id", "shard", "slot").collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(i, p % 7, p // 7) for p, i in enumerate(order)}


def test_long_texts_and_maps_go_through_the_shards(spark):
    frame = table(spark, [(1, "long " * 100_000), (2, None), (3, "")]).withColumn("m", F.create_map(F.lit("a"), "doc_id")).withColumn("key", F.lit(1)).withColumn("copy", F.lit(2))
    rows = sharding.shard(frame, 2, bucket_rows=1).select("record.*", "shard").collect()
    assert len(rows) == 3 and {len(r["text"] or "") for r in rows} == {500_000, 0}


def test_texts_go_through_the_shards(spark, tmp_path, monkeypatch):
    docs = [(k, f"täxt {k} " * k) for k in range(60)] + [(60, None)]
    table(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    given, shard = [], sharding.shard

    def seen(records, *args, **options):
        given.extend(records.columns)
        return shard(records, *args, **options, bucket_bytes=4000)

    monkeypatch.setattr(sharding, "shard", seen)
    rows = sharding.op8_sharding(spark, str(tmp_path), 7).collect()
    assert "text" in given
    want = {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs}
    assert len(rows) == 61 and {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == want


def test_written_shards(spark, tmp_path):
    sharding.write_shards(table(spark, [(k, "t") for k in range(20)]), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 20 and back.select("shard").distinct().count() == 3


def test_permutation_is_uniform():
    seen = collections.Counter(tuple(sharding.fisher_yates(3, (s, 0))) for s in range(3000))
    assert len(seen) == 6 and min(seen.values()) > 400


def text_hash(spark, text):
    return spark.range(1).select(F.xxhash64(F.lit(text or "")).alias("h")).first()["h"]


def brute_lines(docs, least=8):
    """(place of a row, line) of lines with an earlier one of their kind within one edit; quadratic."""
    def near(a, b):
        if a == b:
            return True
        if a[0] != b[0] or min(len(a[1]), len(b[1])) < least or abs(len(a[1]) - len(b[1])) > 1:
            return False
        a, b = sorted((a[1], b[1]), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    places = []
    for row, (i, h, t) in enumerate(docs):
        for k, line in enumerate((t or "").split("\n")):
            words = re.findall(r"[^\x20\x09-\x0D]+", line)
            if words:
                places.append(((i is not None, i or 0, h, k), row, ("words", tuple(words)) if len(words) >= least else ("characters", " ".join(words))))
    return {(row, p[3]) for p, row, w in places if any(near(w, v) and q < p for q, _, v in places)}


def test_line_dedup(spark):
    base = [f"w{k}" for k in range(10)]
    edits = [base, base[:4] + base[5:], base[:4] + ["new"] + base[4:], base[:9] + ["end"], ["top"] + base[1:], base[1:], base[::-1], base[:4] + ["x", "y"] + base[6:]]
    docs = [(k, "\n".join(["", "short line", " ".join(e), f"unique {k} of these here now and then"])) for k, e in enumerate(edits)]
    docs += [(20, " ".join(base) + "\n" + " ".join(base) + "\n\n  "), (21, None), (22, ""), (23, "word " * 5000), (24, "word " * 5001), (25, "template one two three four five six A"), (26, "template one two three four five six B")]
    # short lines: one character inserted, deleted, replaced; too short for it; white space; seven against eight words
    docs += [(30, "Chapter 12\nchapter  12\nCharpter 12\nChapter 1\nChapters 13\nbrief\nbriex\ncafé olé\ncafe olé"), (31, "a b c d e f g\na b c d e f g h\na b c d e f gh\n1\n2\n- a\n- b")]
    # ids that repeat with other texts, with the same text, and none
    docs += [(4, "same line here"), (5, "x\nsame line here"), (5, "y\nunique line"), (5, "y\nunique line"), (None, "same line here\nown words"), (None, "another one")]
    rows = [(i, text_hash(spark, t), t) for i, t in docs]
    want = brute_lines(rows)
    names = {(i, h): row for row, (i, h, _) in enumerate(rows)}
    once = {(names[i, h], k) for row, k in want for i, h, _ in [rows[row]]}
    got = {(names[r["id"], r["h"]], r["line"]) for r in line_dedup.repeated_lines(table(spark, docs)).collect()}
    assert got == once
    report = collections.Counter((r["doc_id"], r["n_lines"], tuple(r["removed"])) for r in line_dedup.line_report(table(spark, docs)).collect())
    gone = lambda i, h: tuple(sorted(k for row, k in got if row == names[i, h]))
    assert report == collections.Counter((i, (t or "").count("\n") + 1, gone(i, h)) for i, h, t in rows)
    frame = table(spark, docs).withColumn("gone", F.lit("mine")).withColumn("gone_id", F.lit(1)).withColumn("record", F.lit(2)).withColumn("h", F.lit(3))
    dropped = line_dedup.drop_repeated_lines(frame)
    assert dropped.columns == frame.columns
    left = lambda i, h, t: t and "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone(i, h))
    assert collections.Counter((r["doc_id"], r["text"]) for r in dropped.collect()) == collections.Counter((i, left(i, h, t)) for i, h, t in rows)
    assert "unique line" in " ".join(r["text"] or "" for r in dropped.collect())
    assert line_dedup.line_report(table(spark, [])).count() == 0


def test_line_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(120).collect()]
    got = {(r["id"], r["line"]) for r in line_dedup.repeated_lines(table(spark, docs)).collect()}
    assert got == {(docs[row][0], k) for row, k in brute_lines([(i, 0, t) for i, t in docs])}


def test_one_edit():
    import numpy as np

    near = lambda a, b: line_dedup.within_one_edit(np.array(a), np.array(b))
    assert near([1, 2], [1, 2]) and near([1, 2, 3], [1, 3]) and near([1, 2], [3, 2]) and near([1, 1], [1, 1, 1]) and near([], [1])
    assert not near([1, 2], [2, 1]) and not near([1], [1, 2, 3]) and not near([1, 2, 3], [4, 2, 5])


def test_crc_and_size(spark):
    rows = sharding.op8_sharding.__globals__["text_column"]
    got = table(spark, [(1, "äö"), (2, None)]).select(F.crc32(F.encode(rows(), "utf-8")).alias("c"), F.octet_length(rows()).alias("n")).collect()
    assert [tuple(r) for r in got] == [(zlib.crc32("äö".encode()), 4), (0, 0)]
