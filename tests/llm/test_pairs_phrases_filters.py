"""SimHash near-dedup, collocations and the audit of filters, against brute force."""

import random
import re
from collections import Counter
from itertools import combinations, permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from credence.llm import collocations, filter_audit, simhash_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \t\n", "one", "One two", "   ", "İÄA b c", "x" * 50_000, "a b c", "a b c"]
SCHEMA = "doc_id long, text string, lang string, source string, `x.doc_id` string, id string, row long, print string"


def _documents(spark, texts, langs=None, sources=None, ids=None):
    n = len(texts)
    rows = [((ids or range(n))[k], t, (langs or ["en"] * n)[k], (sources or ["s"] * n)[k], "x", "y", 7, "z") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def _print(text) -> int:
    words = WORDS.findall((text or "").translate(UPPER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(n, linked):
    least = list(range(n))

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, j in linked:
        a, b = sorted((top(i), top(j)))
        least[b] = a
    return [top(i) for i in range(n)]


def _near_texts(rng, n):
    base = [" ".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(3, 200))) for _ in range(12)]
    texts = []
    for _ in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice("uvwxyz")
        texts.append(" ".join(words))
    return texts


def test_simhash_against_brute_force(spark):
    texts = _near_texts(random.Random(1), 150) + ODD
    prints = [_print(t) for t in texts]
    want = _classes(len(texts), [(i, j) for i, j in combinations(range(len(texts)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2])
    got = {r["doc_id"]: r for r in simhash_dedup.simhash_groups(_documents(spark, texts)).collect()}
    assert [got[k]["fingerprint"] for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[k]["component_id"] for k in range(len(texts))] == want
    assert [k for k in got if got[k]["kept"]] and all(got[k]["kept"] == (want[k] == k) for k in got)


def test_simhash_empty_and_repeated_ids(spark):
    assert simhash_dedup.simhash_groups(_documents(spark, [])).collect() == []
    far = ["a b c d e", "k l m n o p q"]
    rows = simhash_dedup.simhash_groups(_documents(spark, [far[0], far[1], far[0], far[0]], ids=[5, 5, 3, None])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in rows) == [(-1, 3), (3, 3), (5, 3), (5, 5)]
    assert sum(r["kept"] for r in rows) == 2


def test_simhash_links_of_large_buckets(spark):
    """Buckets above the bound are split by further blocks, and no link is lost."""
    rng = random.Random(2)
    prints = {0, 1 << 63, 3 << 62}
    for low in (0, 16, 40):  # clusters that share all bits but 24, so their buckets stay large through two splits
        base = rng.getrandbits(64)
        while len(prints) % 500 or len(prints) < 500:
            flips = rng.sample(range(low, low + 24), rng.randint(0, 5))
            prints.add(base ^ sum(1 << b for b in flips))
        prints.add(rng.getrandbits(64))
    prints = sorted(prints)
    held = np.array(prints, np.uint64)
    near = np.bitwise_count(held[:, None] ^ held[None]) <= 2
    want = {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}
    classes = spark.createDataFrame([(k, int(np.uint64(p).view(np.int64))) for k, p in enumerate(prints)], "rep long, print long")
    got = [(r["a"], r["b"]) for r in simhash_dedup._links(classes, 256).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError):
        simhash_dedup.simhash_groups(classes.select(F.col("rep").alias("doc_id"), F.lit("").alias("text")), bucket=10)


def _phrases(texts, langs, minimum, top):
    counts, totals = Counter(), Counter()
    for text, lang in zip(texts, langs):
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 6):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    frequent = {k: a for k, a in counts.items() if a >= minimum}
    within = set()
    for (lang, words), a in frequent.items():
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                if frequent[lang, words[i : i + n]] == a:
                    within.add((lang, words[i : i + n]))
    rows = []
    for (lang, words), a in frequent.items():
        if len(words) > 1 and (lang, words) not in within:
            cuts = [(1000 * a * totals[lang] // (frequent[lang, words[:k]] * frequent[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            rows.append((lang, " ".join(words), a, frequent[lang, words[:k]], frequent[lang, words[k:]], totals[lang], score))
    out = []
    for lang in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(r[0], k + 1, *r[1:]) for k, r in enumerate(own)]
    return out


@pytest.mark.parametrize("settings", [{"sampled": 2}, {"sampled": 3, "threshold": 10**6}, {"sampled": 1, "chunk": 200}])
def test_collocations_against_brute_force(spark, settings):
    """With a good sample, with one that proposes nothing, so that all comes from failures of the border, and with small chunks."""
    rng = random.Random(3)
    texts, langs = [], []
    for _ in range(120):
        words = []
        while len(words) < rng.randint(0, 60):
            words += rng.choice([["New", "York"], ["de", "facto", "rule"], "to be or not to be".split(), [rng.choice("abcdefgh")], ["été", "É"], ["."], ["aa", "aa,"]])
        texts.append(rng.choice([" ", "  ", "\t"]).join(words))
        langs.append(rng.choice(["en", "fr", None]))
    texts += [None, "", ". , ;", "a\nb a\rb a b"] + ["same same same same"] * 30
    langs += ["en", "fr", "de", "en"] + ["es"] * 30
    got = collocations.collocations(_documents(spark, texts, langs), minimum=8, top=15, **settings).collect()
    assert sorted(map(tuple, got)) == sorted(_phrases(texts, langs, 8, 15)) and len(got) > 20


def test_collocation_scores_above_64_bits(spark):
    rows = spark.createDataFrame([(10**9, 10**15, 10**9, 10**9)], "a long, n long, l long, r long")
    score = F.expr("CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(16,0)) DIV (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    assert rows.select(score).first()[0] == 1000 * 10**9 * 10**15 // 10**18
    assert collocations.collocations(_documents(spark, [])).collect() == []


def _audit(texts, sources, ids, labels):
    bits = []
    for k, t in enumerate(texts):
        t = t or ""
        words = WORDS.findall(t)
        fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)),
                 any((u or "") == t and i is not None and (ids[k] is None or i < ids[k]) for u, i in zip(texts, ids))]
        bits.append(dict(zip("ABCDE", fails)))
    marked = lambda k, place: any(x[0] == ids[k] and x[place] == 1 for x in labels if x[0] is not None)
    out = {}
    for part in {s or "" for s in sources}:
        own = [k for k in range(len(texts)) if (sources[k] or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [k for k in left if bits[k][f]]
                failing = [k for k in own if bits[k][f]]
                left = [k for k in left if not bits[k][f]]
                unique = sum(all(bits[k][g] == (g == f) for g in "ABCDE") for k in failing)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), unique, sum(marked(k, 1) for k in gone), sum(marked(k, 2) for k in gone)]
    shapley = Counter()
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row[1]
    return sorted((*k, *row, shapley[k[0], k[1][k[2] - 1]]) for k, row in out.items())


@pytest.mark.parametrize("numbers", [filter_audit.RANGE, 4])
def test_filter_audit_against_brute_force(spark, numbers):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["a", "B", "word", "Long", "#tag", "x$", *map(str, range(90))], k=rng.choice([10, 49, 50, 80, 120]))) for _ in range(70)] + ODD
    texts += rng.choices(texts, k=20)
    sources = [rng.choice(["s", "t", None, ""]) for _ in texts]
    ids = [*range(len(texts) - 3), 0, 3, None]
    rng.shuffle(ids)
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 90, 2)] + [(4, 1, 1), (None, 1, 1)]
    held = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(_documents(spark, texts, sources=sources, ids=ids), held, numbers=numbers).collect()
    assert sorted(map(tuple, got)) == _audit(texts, sources, ids, labels)
    assert filter_audit.filter_audit(_documents(spark, []), held).collect() == []
    assert len(filter_audit.filter_audit(_documents(spark, ["a"]), held.limit(0)).collect()) == 600


def test_gallop():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(2))
        assert filter_audit.common(a, b) == len(set(a.tolist()) & set(b.tolist()))
    lists = {name: np.unique(rng.integers(0, 200, rng.integers(0, 100))) for name in (*"ABCDE", "good", "toxic")}
    for before, k, removed, good, toxic in filter_audit.differences(lists):
        union = set().union(*(lists["ABCDE"[j]].tolist() for j in range(5) if before >> j & 1))
        new = set(lists["ABCDE"[k]].tolist()) - union
        assert (removed, good, toxic) == (len(new), len(new & set(lists["good"].tolist())), len(new & set(lists["toxic"].tolist())))
