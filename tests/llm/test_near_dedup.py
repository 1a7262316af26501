"""Near-duplicates against brute force over all pairs, with appended, cut and swapped copies."""

import random

from pyspark.sql import functions as F

from tallyweave.llm import near_dedup
from tallyweave.llm.near_dedup import keep_one_each

SCHEMA = "doc_id long, text string"


def shingled(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows):
    s, root = [shingled(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if 9 * both >= 4 * (len(s[i]) + len(s[j])):
                n += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return n, {rows[i][0] for i in range(len(rows)) if find(i) == i}


def test_all_pairs(spark):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 9)))
    many = lambda n: [word() for _ in range(n)]
    line, rows = many(30), []
    for i in range(60):
        base = many(r.randint(60, 260)) + (line if i % 3 == 0 else [])
        n = len(base)
        swapped = list(base)
        for at in r.sample(range(n), max(1, n // 60)):
            swapped[at] = word()
        rows += [base, base + many(n // 5), many(n // 6) + base, base[n // 6 :], base[: n - n // 10], swapped, base[: n // 2]]
    family = many(150)  # larger than a bucket of which all pairs are candidates
    rows += [family[r.randint(0, 8) :] + many(r.randint(0, 22)) for _ in range(60)]
    r.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    pairs, want = brute(rows)
    assert pairs > 300
    assert {x.doc_id for x in keep_one_each(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()} == want


def test_shared_passage_is_no_prefix_however_many_texts_there_are(spark, monkeypatch):
    """A passage of 60 texts in 400 comes last in the order, though a sample of fixed size would hardly see it."""
    monkeypatch.setattr(near_dedup, "SAMPLE", 40)
    r = random.Random(3)
    many = lambda n: ["".join(r.choice("abcdefghijkl") for _ in range(9)) for _ in range(n)]
    passage = many(30)
    texts = [" ".join(many(100) + (passage if i < 60 else [])) for i in range(400)]
    keyed = spark.createDataFrame(list(enumerate(texts)), "d long, text string").withColumn("k", F.xxhash64("d", "text"))
    shared = set(near_dedup.shingles([w.encode() for w in passage]).tolist())
    prefixes = [set(x.p) for x in near_dedup._features(keyed).collect()]
    assert len(prefixes) == 400 and not any(p & shared for p in prefixes)
