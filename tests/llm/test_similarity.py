"""Near-dedup, components and substring dedup against brute force."""

import collections
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from credence.llm import exact_dedup, line_dedup, near_dedup, quality_rules, substring_dedup
from credence.llm.components import components
from test_exact_and_quality import table


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) or frozenset([tuple(words)])


def brute_components(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i, _ in docs}


def edited(rng, words, share):
    return [w if rng.random() > share else f"e{rng.random():.6f}" for w in words]


def test_near_groups(spark):
    rng = random.Random(2)
    docs = []
    for g in range(12):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 400]))]
        docs += [" ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05]))) for _ in range(9)]
    docs += [None, "", "  \n", "one two", "ONE  two", "one two three", "one two three four five", "x " * 40000]
    order = list(range(len(docs)))
    rng.shuffle(order)
    docs = [(i, docs[i]) for i in order] + [(order[0], docs[order[0]])]
    got = near_dedup.near_groups(table(spark, docs)).collect()
    want = brute_components(dict(docs).items())
    assert len(got) == len(docs)
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == {i: (want[i], len(shingles(t))) for i, t in docs}
    kept = near_dedup.near_dedup(table(spark, docs))
    assert {r["doc_id"] for r in kept.collect()} == set(want.values())
    assert near_dedup.near_groups(table(spark, [])).count() == 0


def doubled_turns(a, b, times):
    """Two sequences whose sums of powers modulo 2**64 are equal for every odd multiplier."""
    x, y = [a], [b]
    for _ in range(times):
        x, y = x + y, y + x
    return x, y


def test_built_collisions_stay_apart(spark):
    letters = ["".join(x) for x in doubled_turns("a", "b", 10)]
    words = [" ".join(x) for x in doubled_turns("a", "b", 10)]
    tail = [f" {w} x y q {v} x y" for w, v in (letters, letters[::-1])]
    for pair in (letters, words, tail):
        docs = list(enumerate(pair))
        rows = near_dedup.near_groups(table(spark, docs)).collect()
        want = brute_components(docs)
        assert {r["doc_id"]: r["component_id"] for r in rows} == want
        assert near_dedup.near_dedup(table(spark, docs)).count() == len(set(want.values()))
        assert [r["n_removed"] for r in line_dedup.line_report(table(spark, docs)).collect()] == [0, 0]
        assert line_dedup.drop_repeated_lines(table(spark, docs)).orderBy("doc_id").select("text").collect() == [(t,) for t in pair]
    assert quality_rules.measure(f"{letters[0]} x y q {letters[1]} x y")[4] == 0
    assert quality_rules.measure(f"{letters[0]} x y q {letters[0]} x y")[4] == 6


def test_names_with_dots_and_clashes(spark):
    frame = table(spark, [(1, "a b"), (2, "a  b"), (3, "c")]).withColumn("meta.lang", F.lit("x")).withColumn("record", F.lit("r")).withColumn("carried", F.lit("c"))
    for out in (exact_dedup.exact_dedup(frame), near_dedup.near_dedup(frame), line_dedup.drop_repeated_lines(frame)):
        assert out.columns == frame.columns and {r["doc_id"] for r in out.collect()} >= {1, 3}
        assert {r["meta.lang"] for r in out.collect()} == {"x"}


def all_against_all(sets, labels, **more):
    every = np.ones(len(sets), bool)
    same = np.zeros((len(sets), near_dedup.POSITIONS), np.uint16)
    return near_dedup.block_links(labels, every, every, same, sets, **more)


def test_chain_in_a_bucket_is_joined():
    # the first is far from the last, and only neighbours are linked
    sets = [np.arange(k * 10, k * 10 + 100, dtype=np.uint64) for k in range(6)]
    found = all_against_all(sets, np.arange(6))
    assert len(found) == 5 and all(abs(i - j) == 1 for i, j in found)


def brute_parts(labels, links):
    parent = {int(x): int(x) for x in labels}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        parent[find(int(labels[i]))] = find(int(labels[j]))
    return [find(int(x)) for x in labels]


def same_parts(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def linked(a, b):
    common = len(np.intersect1d(a, b))
    return 100 * common >= 75 * (len(a) + len(b) - common)


def test_block_links_equal_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(600):
        n = int(rng.integers(2, 14))
        sets = [np.arange(a, a + 100, dtype=np.uint64) for a in rng.permutation(n) * 10]
        sets = [x if rng.random() < 0.8 else x + np.uint64(5000) for x in sets]
        every = [(i, j) for j in range(n) for i in range(j) if linked(sets[i], sets[j])]
        known = [x for x in every if rng.random() < 0.3]
        labels = np.array(brute_parts(range(n), known))
        asks = labels != np.bincount(labels).argmax()
        # any split into blocks of askers and of members finds the same components
        cuts = [np.arange(n) % 2 == 0, np.arange(n) % 2 == 1] if n > 6 else [np.ones(n, bool)]
        same = np.zeros((n, near_dedup.POSITIONS), np.uint16)
        found = [x for a in cuts for b in cuts for x in near_dedup.block_links(labels, asks & a, b, same, sets)]
        assert all(linked(sets[i], sets[j]) for i, j in found)
        assert same_parts(brute_parts(labels, found), brute_parts(labels, every))


def test_a_pair_is_looked_at_in_its_first_bucket():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, (400, near_dedup.POSITIONS), dtype=np.uint16)
    b = np.where(rng.random(a.shape) < rng.random((400, 1)), a, a ^ 1).astype(np.uint16)
    keys_a, keys_b = near_dedup.chunk_keys(a), near_dedup.chunk_keys(b)
    first = near_dedup.first_shared(a != b)
    for k in range(400):
        shared = np.flatnonzero(keys_a[k] == keys_b[k])
        assert first[k] == (shared[0] if len(shared) else -1)


def test_blocks_of_any_size_find_all(spark):
    # drifting copies: neighbours are linked, the ends are not; all share buckets
    rng = random.Random(5)
    words = [f"v{rng.randrange(9000)}" for _ in range(300)]
    docs = []
    for k in range(40):
        docs.append((k * 7 % 40, " ".join(words)))
        for at in rng.sample(range(300), 4):
            words[at] = f"x{k}a{at}"
    want = brute_components(docs)
    for rows, most in ((3, near_dedup.BLOCK_SHINGLES), (near_dedup.BLOCK_ROWS, 700), (near_dedup.BLOCK_ROWS, near_dedup.BLOCK_SHINGLES)):
        # and with rounds of further heads in all buckets, or in none
        got = near_dedup.near_groups(table(spark, docs), block_rows=rows, block_shingles=most, large_rows=2 if rows == 3 else 10**9).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want
    # no link known: the blocks alone must find the whole graph
    keyed = near_dedup.chunk_keys(np.zeros((1, near_dedup.POSITIONS), np.uint16))[0]
    members = spark.createDataFrame([(int(keyed[0]), i) for i, _ in docs], "key bigint, rep bigint")
    sets = spark.createDataFrame([(i, sorted(hash(x) & (1 << 62) - 1 for x in shingles(t)), " ".join(map(str, t.split())).encode()) for i, t in docs], "rep bigint, shingles array<bigint>, words binary")
    classes = spark.createDataFrame([(i, len(shingles(t)), bytes(2 * near_dedup.POSITIONS)) for i, t in docs], "rep bigint, n bigint, sig binary")
    none = spark.createDataFrame([], "node bigint, component bigint")
    for rows in (1000, 7):
        links = near_dedup._across(near_dedup._labelled(members, classes, none), classes, sets, rows, near_dedup.BLOCK_SHINGLES)
        parts = {r["node"]: r["component"] for r in components(links).collect()}
        assert {i: parts.get(i, i) for i, _ in docs} == want
    # rounds of further heads join no more than what is linked, and leave what they cannot join
    labels, labelled = near_dedup._further_heads(members, classes, none, sets, 2)
    parts = {r["node"]: r["component"] for r in labels.collect()}
    assert parts and all(want[a] == want[b] for a, b in parts.items()) and labelled.count() == len(docs)


def brute_rows(docs):
    """Component (place of a row) of each row: rows are nodes, whatever their ids."""
    return brute_components([(k, t) for k, (_, t) in enumerate(docs)])


def test_ids_that_repeat_lose_nothing(spark):
    rng = random.Random(12)
    text = lambda: " ".join(f"v{rng.randrange(5000)}" for _ in range(40))
    a, b, c = text(), text(), text()
    near_c = c.replace(c.split()[20], "other", 1)
    for docs in ([(5, a), (5, b), (9, b)], [(3, a), (5, a), (5, b), (9, b)], [(1, a), (1, a), (1, b), (None, b), (None, c), (2, None), (2, None), (2, "")],
                 [(None, a), (None, a), (None, b)], [(7, c), (7, near_c), (8, near_c), (8, a), (7, c)]):
        parts = brute_rows(docs)
        least = {p: min((i is None, i) for k, (i, _) in enumerate(docs) if parts[k] == p) for p in parts.values()}
        want = collections.Counter((i, least[parts[k]][1] if shingles(t) else i) for k, (i, t) in enumerate(docs))
        got = near_dedup.near_groups(table(spark, docs)).collect()
        assert collections.Counter((r["doc_id"], r["component_id"]) for r in got) == want
        assert sum(r["kept"] for r in got) == len(set(parts.values()))
        frame = table(spark, docs).withColumn("gone_id", F.lit(1)).withColumn("h", F.lit("x")).withColumn("record", F.lit("y"))
        kept = near_dedup.near_dedup(frame)
        assert kept.columns == frame.columns
        left = collections.Counter((r["doc_id"], r["text"]) for r in kept.collect())
        # of every component one row, the least of its ids, and no text without a near copy that stays
        assert left.total() == len(set(parts.values())) and not left - collections.Counter(docs)
        assert {shingles(t) for _, t in left} <= {shingles(t) for _, t in docs}
        assert collections.Counter(i for i, _ in left.elements()) == collections.Counter(least[p][1] for p in set(parts.values()))


def test_pigeonhole_guarantee():
    rng = np.random.default_rng(0)
    most = near_dedup.CHUNKS * (near_dedup.ERRORS + 1) - 1
    a = rng.integers(0, 1 << 16, (50, near_dedup.POSITIONS), dtype=np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(near_dedup.POSITIONS, most, replace=False)] ^= 1
    keys = near_dedup.chunk_keys(a), near_dedup.chunk_keys(b)
    assert all((x == y).any() for x, y in zip(*keys))


def test_recall_at_the_bound():
    # sets with 75 of 100 shingles in common, and just above: how many pairs share a bucket within the distance looked at
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(1500):
        pool = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        a, b = (near_dedup.signature(np.unique(x)) for x in (pool[:88], pool[13:]))  # 75 in common of 100
        differ = (a != b)[None]
        missed += not (near_dedup.first_shared(differ)[0] >= 0 and differ.sum() <= near_dedup.FARTHEST)
    assert missed <= 1


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 400)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(5, 5)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_substrings(docs, length=100):
    """By (id, text), of documents in the order given; null ids have no order."""
    seen, out = set(), {}
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1 if i is not None else 0):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\x01" * length
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.setdefault((i, t), (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def substring_docs(rng):
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, copy = noise(260), noise(900)
    docs = [noise(50) + passage + noise(70), passage[:150] + noise(30) + passage[60:200], copy, copy, copy[:99], copy[:100], copy[300:650] + "!" + copy[650:],
            "ab" * 300, "ba" * 300, "z" * 450, None, "", passage + passage, noise(3000), noise(120) + copy[100:260] + passage[:120] + copy[250:420]]
    docs += [noise(40) + passage[30:230] + noise(40) for _ in range(12)]
    return list(enumerate(docs)), passage, noise


def report(frame, **more):
    return substring_dedup.substring_report(frame, **more).collect()


def test_substring_report(spark):
    docs, _, _ = substring_docs(random.Random(6))
    want = brute_substrings(docs)
    frame = table(spark, docs).withColumn("name", F.lit("mine")).withColumn("gone", F.lit(1)).withColumn("a", F.lit(2))
    for most in (substring_dedup.BUCKET_STRINGS, 3, 1):  # with few strings a bucket, anchors go by their windows
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in report(frame, bucket_strings=most)}
        assert got == {i: x for (i, _), x in want.items()}
    assert not report(table(spark, []))
    assert report(table(spark, [(1, "a" * 10)]), keep_text=True)[0]["kept"] == "a" * 10


def test_substrings_of_ids_that_repeat(spark):
    docs, passage, noise = substring_docs(random.Random(7))
    docs = [(i, t) for i, t in docs[:6]] + [(2, noise(330)), (2, "other words " * 3), (2, passage + noise(20)), (3, docs[3][1]), (9, passage), (9, passage), (None, passage), (None, passage)]
    hashed = {t: h for t, h in ((r["t"], r["h"]) for r in spark.createDataFrame([(t or "",) for _, t in docs], "t string").select("t", F.xxhash64(F.col("t").cast("binary")).alias("h")).collect())}
    order = sorted(docs, key=lambda x: (x[0] is None, x[0] or 0, hashed[x[1] or ""]))
    once = [x for k, x in enumerate(order) if x not in order[:k]]
    want = brute_substrings(once)
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in report(table(spark, docs)))
    assert got == collections.Counter((i, *want[i, t]) for i, t in docs)


def test_suffix_order_by_columns():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n, width = int(rng.integers(1, 12)), 15
        table = rng.integers(0, 4, (width, n)).astype(np.uint16)
        order, common = np.arange(n), np.zeros(n, np.int32)
        for column in range(width - 1, -1, -1):
            order, common = substring_dedup.insert_column(order, common, table[column])
            suffixes = [tuple(table[column:, k]) for k in range(n)]
            assert [suffixes[k] for k in order] == sorted(suffixes)
            for k in range(1, n):
                a, b = suffixes[order[k - 1]], suffixes[order[k]]
                assert common[k] == next((m for m in range(len(a)) if a[m] != b[m]), len(a))


def test_runs_cover_every_window_once():
    rng = random.Random(9)
    text = "".join(rng.choice("abc ") for _ in range(2000)).encode()
    _, _, first, more, offset = substring_dedup.runs(text)
    windows = collections.Counter(w for f, m in zip(first, more) for w in range(f, f + m + 1))
    assert windows == collections.Counter(range(len(text) - 99)) and offset.min() >= 0
    assert [len(x) for x in substring_dedup.runs(b"x" * 99)] == [0] * 5


def test_repeated_windows_equal_brute_force():
    rng = np.random.default_rng(9)
    size = substring_dedup.LENGTH
    for _ in range(150):
        n = int(rng.integers(2, 9))
        # few kinds of bytes on both sides of one anchor; a string ends `size` after the anchor's start
        left = [bytes(rng.choice([97, 98], substring_dedup.LEFT).astype(np.uint8)) for _ in range(2)]
        right = [b"A" * substring_dedup.K + bytes(rng.choice([97, 98], size - substring_dedup.K).astype(np.uint8)) for _ in range(2)]
        offset = rng.choice([0, 1, 30, 75, 76], n)
        more = np.array([int(rng.integers(0, o + 1)) for o in offset])
        strings = [left[rng.integers(2)][substring_dedup.LEFT - o :] + right[rng.integers(2)] for o in offset]
        rank, first = rng.permutation(n), rng.integers(0, 1000, n)
        who, start = substring_dedup.repeated_windows(strings, rank, first, more, offset)
        earliest = {}
        windows = [(rank[k], first[k] + s, k, s, s - offset[k]) for k in range(n) for s in range(more[k] + 1)]
        for r, place, k, s, column in sorted(windows):
            earliest.setdefault((column, strings[k][s : s + size]), (k, s))
        want = {(k, s) for _, _, k, s, column in windows if earliest[column, strings[k][s : s + size]] != (k, s)}
        assert set(zip(who.tolist(), start.tolist())) == want
