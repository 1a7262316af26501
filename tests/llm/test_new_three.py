"""Spelling variants, collocations and licences against brute force on small fixtures."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import op11_spelling, op12_collocations, op13_licenses

DOCS = "doc_id long, text string, lang string, n long, word string, label string"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "aé÷ü"])
def test_near_pairs(spark, alphabet):
    rng = random.Random(len(alphabet))
    words = sorted({"".join(rng.choices(alphabet, k=rng.choice((6, 6, 7, 8, 9)))) for _ in range(300)} | {"a" * 40, "a" * 41, "a" * 42})
    got = {(r.a, r.b) for r in op11_spelling.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()}
    want = {(a, b) for a in words for b in words if a < b and near(a, b)}
    assert {tuple(sorted(p)) for p in got} == want and len(got) == len(want)


def test_bound_of_changed_grams(spark):
    words = ["".join("ab"[i >> k & 1] for k in range(6)) for i in range(64)]
    counts = Counter(g for w in words for g in {s[p : p + q] for s in ["\x02\x02" + w + "\x03\x03"] for q in (3, 4, 5) for p in range(len(s) - q + 1)})
    grams = op11_spelling.Grams({g: n for g, n in counts.items() if n > 1}, 4)
    assert grams.long
    for w in words:  # the bound holds for each edit
        s = "\x02\x02" + w + "\x03\x03"
        have = Counter(s[p:e] for p, e in grams.of(s))
        bound = grams.affected(s, grams.of(s))
        for i in range(len(w) + 1):
            for v in {w[:i] + c + w[i:] for c in "abc"} | {w[:i] + c + w[i + 1 :] for c in ("", "a", "b", "c") if i < len(w)}:
                t = "\x02\x02" + v + "\x03\x03"
                assert sum((have & Counter(t[p:e] for p, e in grams.of(t))).values()) >= len(grams.of(s)) - bound


def brute_forms(rows):
    n = Counter()
    for doc, text in rows:
        for run in op11_spelling.re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    form = {}
    for w in n:
        best = min(((-n[v], v) for v in n if near(w, v)), default=None)
        form[w] = best[1] if best and -best[0] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], sum(near(w, v) for v in n), n[form[w]] if form[w] else None)
    return out


def test_forms(spark):
    text = " ".join(["Kettle-kettlé"] * 2 + ["abcdef"] * 150 + ["abcdeg"] * 30 + ["abcdg"] * 40 + ["abcdgg"] * 5 + ["bcdefgh", "bcdefgi"] * 6 + ["ÉCOLES"] * 5 + ["écoles"] * 6)
    rows = [(d, text if d % 3 else "abcdef. " * d, "en", 1, "w", "l") for d in range(60)] + [(None, "nothing nothing", None, 1, "w", "l"), (7, None, "en", 1, "w", "l"), (8, "", "en", 1, "w", "l")]
    got = {r.word: tuple(r)[1:] for r in op11_spelling.spelling_forms(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_forms([(r[0], r[1]) for r in rows]) and any(v[1] != v[0] and v[0] for v in got.values())
    assert op11_spelling.spelling_forms(spark.createDataFrame([], DOCS)).collect() == []


def test_least_cut(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        n = 10 ** rng.randint(3, 13)
        a = rng.randint(1, n // 100 + 1)
        rows.append((a, n, [rng.randint(a, n) for _ in range(4)] + [a], [rng.randint(a, n) for _ in range(4)] + [a]))
    df = spark.createDataFrame(rows, "a long, n long, before array<long>, after array<long>")
    got = df.select("a", "n", "before", "after", op12_collocations.least_cut(F.col("a"), F.col("n"), F.col("before"), F.col("after")).alias("x")).collect()
    for r in got:
        assert tuple(r.x) == min((1000 * r.a * r.n // (r.before[k - 1] * r.after[4 - k]), k, r.before[k - 1], r.after[4 - k]) for k in range(1, 5))


def brute_phrases(rows, least=100, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in op11_spelling.re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in op11_spelling.re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for lang in n:
        rows = []
        for (g, p), a in cand.items():
            if g != lang or any(h == g and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (h, q), b in cand.items()):
                continue
            s, k = min((1000 * a * n[g] // (f[g, p[:k]] * f[g, p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), a, f[g, p[:k]], f[g, p[k:]], n[g], s))
        out += [(lang, i, r[2].decode(), *r[3:]) for i, r in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def test_phrases(spark):
    rng = random.Random(9)
    words = ["a", "b", "c", "the", "É", "\x1cx", "new york"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\t", "\n", " ,"]) for _ in range(60)), rng.choice(["en", "de", None]), 1, "w", "l") for i in range(400)]
    rows += [(1, "Say it now again please! " * 120, "en", 1, "w", "l"), (2, None, "en", 1, "w", "l"), (3, "", None, 1, "w", "l"), (4, "x " * 500, "fr", 1, "w", "l")]
    got = sorted(tuple(r) for r in op12_collocations.collocations(spark.createDataFrame(rows, DOCS)).collect())
    assert got == brute_phrases([(r[1], r[2]) for r in rows]) and len(got) > 30
    assert op12_collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []


def brute_licenses(text, templates, threshold):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in op11_spelling.re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if x]
    base = sorted((i, label) for p, label in op13_licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    stride = op13_licenses.stride_of(templates)
    found = {}
    for s in range(0, max(len(w) - 1 - stride, 0) + 1, stride):
        for label, t in templates:
            own = set(op13_licenses.plain_words(t))
            shared = len(own & set(w[s : s + 2 * stride]))
            if shared * threshold[1] >= len(own) * threshold[0]:
                found[label] = max(found.get(label, 0), shared / len(own))
    labels = {x for _, x in base}
    starts = [i for i, _ in base]
    return len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | set(found))), 1.0 if base else max(found.values(), default=0.0)


@pytest.mark.parametrize("threshold", [(9, 10), (1, 2)])
def test_licenses(spark, threshold):
    rng = random.Random(3)
    pool = [w for _, t in op13_licenses.TEMPLATES for w in t.split()] + ["word", "CC", "by", "É", "K", "rights"]
    texts = [" ".join(rng.choices(pool, k=rng.choice((0, 3, 30, 300)))) for _ in range(60)]
    texts += [f"{'word ' * k}{t[: len(t) // 2]}\n{t[len(t) // 2 :]} {'end ' * k}" for k in (0, 20, 45) for _, t in op13_licenses.TEMPLATES]
    texts += [None, "", "CC\nBY cc-by, ccby All rights\treserved GENERAL public  licensE general publIc license É", "all rights reserved " * 2000]
    rows = [(i, t, "en", 1, "w", "l") for i, t in enumerate(texts)]
    got = {r.doc_id: tuple(r)[1:] for r in op13_licenses.licenses(spark.createDataFrame(rows, DOCS), threshold=threshold).collect()}
    assert got == {i: brute_licenses(t, op13_licenses.TEMPLATES, threshold) for i, t in enumerate(texts)}
    assert op13_licenses.licenses(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError):
        op13_licenses.licenses(spark.createDataFrame(rows, DOCS), templates=(("x", "..."),))
