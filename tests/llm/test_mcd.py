"""The robust estimate against a plain numpy version of the same steps."""

import math
import random

import numpy as np

from tallyweave.llm import op2_quality as Q


def half_up(x):
    return math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)


def distances(x, m, cov):
    y = np.linalg.solve(np.linalg.cholesky(cov), (x - m).T)
    return (y * y).sum(0)


def estimate(x, factor):
    m = x.mean(0)
    return m, factor * ((x - m).T @ (x - m)) / len(x) + np.diag(np.square(np.array(Q.FLOOR, float)))


def starts(x):
    bins = np.sort(np.clip(np.floor(x / Q.CELL), Q.LOWEST, Q.HIGHEST), axis=0)
    at = lambda q: bins[math.ceil(q * len(x)) - 1] * Q.CELL + Q.CELL // 2
    yield at(0.5), np.diag(((at(0.75) - at(0.25)) / 1.349) ** 2 + np.square(np.array(Q.FLOOR, float)))
    yield estimate(x, 1.0)
    even = x[x.sum(1) % 2 == 0]
    if len(even):
        yield estimate(even, 1.0)


def mcd(x):
    """Of the starts the one that ends with the least determinant, reweighted."""
    ends = []
    for m, cov in starts(x):
        for _ in range(Q.STEPS):
            b = np.floor(16 * np.log2(1 + distances(x, m, cov)))
            last = np.sort(b)[max(0, math.ceil(Q.SHARE * len(x)) - 1)]  # whole bins until the share is reached
            m, cov = estimate(x[b <= last], Q.CONSISTENCY)
        ends.append((round(math.sqrt(np.linalg.det(cov)), 6), m, cov))
    _, m, cov = min(ends, key=lambda e: e[0])
    near = x[distances(x, m, cov) <= Q.REWEIGHT]
    return (len(near), *estimate(near, 1.0))


def drawn(own, wide):
    n, m, cov = own
    w = n * n / (n * n + Q.PRIOR**2)
    return n, w * m + (1 - w) * wide[1], w * cov + (1 - w) * wide[2]


def test_against_numpy(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 11)))
    rows = []
    for i in range(260):
        w = [word().capitalize() if r.random() < 0.1 else word() for _ in range(r.randint(60, 300))]
        if i % 9 == 0:
            w = [x + "%$#" for x in w]
        if i % 5 == 0:
            w = w[:40] * 2 + w
        rows.append((i, " ".join(w[:30]) + "\n" + "\n".join(" ".join(w[j : j + 7]) for j in range(30, len(w), 7)), ("en", "de")[i % 2], None if i % 4 == 1 else "s"))
    got = {x.doc_id: x for x in Q.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    groups = {}
    for i, text, lang, source in rows:
        g = got[i]
        upper = sum(c in Q.UPPER for c in text)
        if not g.base_failed:
            v = (math.log(g.word_chars / g.n_words), math.log1p(1000 * g.n_symbols / g.word_chars), math.log1p(100 * g.n_dup_lines / g.n_words), math.sqrt(g.n_repeat_words / g.n_words), math.log1p(1000 * upper / g.word_chars))
            groups.setdefault((lang, source), []).append((i, [half_up(1000 * a) for a in v]))
    assert len(groups) == 3
    of = lambda keep: np.array([v for k, rows in groups.items() if keep(k) for _, v in rows], float)
    every = mcd(of(lambda k: True))
    for key, members in groups.items():
        x = np.array([v for _, v in members], float)
        tongue = drawn(mcd(of(lambda k, lang=key[0]: k[0] == lang)), every)
        want = distances(x, *drawn(mcd(x), tongue)[1:])
        have = np.array([got[i].distance for i, _ in members])
        assert np.allclose(have, want, rtol=1e-6)
        assert [got[i].kept for i, _ in members] == (want <= Q.CUTOFF).tolist()
