"""Main text of pages and secret spans against brute force, names that say nothing, and long texts."""

import collections
import math
import random
import re
import time

import pytest

from tallyweave.llm import op4_style_tree, op6_secrets


@pytest.mark.parametrize("mark", ["class='overflow-hidden'", "class='navy'", "class='share-price'", "class='side-by-side'", "class='search-results'", "class='promontory'", 'aria-hidden="false"', 'data-x="hidden gem"', "data-id='sidebar'", "class='menus related'", "title='display:none'"])
def test_names_that_say_nothing(mark):
    page = f"<main><p>one</p><div {mark}><p>two</p></div></main>"
    assert op4_style_tree.main_text(page, frozenset()) == "one\n\ntwo"


@pytest.mark.parametrize("mark", ["hidden", "hidden=''", "aria-hidden='true'", "style='color:red; display: none'", "class='x comments'", "id=disqus_thread", "class='ad'", "role=navigation"])
def test_what_is_cut_within_an_article(mark):
    page = f"<article><p>one</p><div {mark}><p>two</p></div><p>three</p></article>"
    assert op4_style_tree.main_text(page, frozenset()) == "one\n\nthree"


def test_names_outside_an_article():
    page = "<div class='Side_Bar x'>a</div><div class='navbar'>b</div><div class='sidewalk'>c</div><div id='footer'>d</div>"
    assert op4_style_tree.main_text(page, frozenset()) == "c"


def brute_texts(pages, threshold=0.7, prior=8):
    """Importance of each node by counting, then each page's blocks."""
    parsed = [(re.sub(r"^\w+://([^/]*).*", r"\1", url or ""), *op4_style_tree.blocks(html)) for _, url, html in pages]
    seen, tree, pages_of = set(), collections.defaultdict(collections.Counter), collections.Counter()
    for host, found, styles in parsed:
        key = (host, tuple(f[3] for f in found), frozenset((f[0], f[3]) for f in found), frozenset(styles))
        if key in seen:
            continue
        seen.add(key)
        for h in (host, None):
            pages_of.update({(h, n) for n in {f[0] for f in found} | {s[0] for s in styles}})
            for kind, (node, x) in {(1, (f[0], f[3])) for f in found} | {(2, s) for s in styles}:
                tree[h, node, kind][x] += 1

    def parts(h, node):
        base = math.log(max(2, pages_of[h, node]))
        said, kids = tree[h, node, 1], tree[h, node, 2]
        n, m = sum(kids.values()), sum(said.values())
        return -sum(k / n * math.log(k / n) for k in kids.values()) / base if n else 0.0, 1 - sum(k * math.log(k) for k in said.values()) / base / m if m else None

    def low(host, node):
        (a, b), (c, d), m = parts(host, node), parts(None, node), pages_of[host, node]
        return b is not None and max((m * a + prior * c) / (m + prior), (m * b + prior * d) / (m + prior)) < threshold

    out = []
    for host, found, _ in parsed:
        left = [f for f in found if not f[2]]
        left = [f for f in left if f[1]] or left
        out.append("\n\n".join(f[3] for f in left if not low(host, f[0])))
    return out


def test_whole_extraction(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefg", k=5))
    pages = []
    for i in range(120):
        host = rng.choice(["a.example", "b.example", "c.example"])
        top = f"<div class='q1'>{host} says hello<span>to all</span></div>"
        body = "".join(f"<div class='q2'><p>{word()} {word()}</p>{'<i>x</i>' if rng.random() < 0.3 else ''}</div>" for _ in range(rng.randrange(4)))
        tail = f"<div class='q3'><p>Copyright of {host}</p><p>{rng.choice(['call us', 'write us'])}</p></div>"
        wrap = rng.choice(["{}", "<main>{}</main>", "<div class='navbar'>{}</div>"])
        pages.append((i, f"http://{host}/{i}", rng.choice([top, ""]) + wrap.format(body) + tail))
    pages += [(200, "http://a.example/none", pages[0][2].split("<div class='q2'>")[0]), (201, None, None), (202, "http://b.example/", "")]
    want = brute_texts(pages)
    got = {r.page_id: (r.text, r.n_chars) for r in op4_style_tree.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {p[0]: (w, len(w)) for p, w in zip(pages, want, strict=True)}
    # the tree does change pages: their boilerplate is no rule's
    plain = [op4_style_tree.main_text(p[2], frozenset()) for p in pages]
    assert sum(a != b for a, b in zip(plain, want)) > 60


ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_spans(text):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]{14,}", text)] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{16,}", text)]

    def limit(v):
        if not re.search("[A-Za-z0-9]", v):
            return None
        for name, rx in (("digits", "[0-9]+"), ("letters", "[A-Za-z]+"), ("hex", "[0-9a-f]+|[0-9A-F]+"), ("alnum", "[A-Za-z0-9]+")):
            if re.fullmatch(rx, v):
                return op6_secrets.BITS[name]
        return op6_secrets.BITS["base64" if all(re.search(x, v) for x in ("[a-z]", "[A-Z]", "[0-9]")) else "words"]

    def entropy(v):
        best = 0
        for i in range(len(v) - 19):
            n = collections.Counter(v[i : i + 20])
            best = max(best, -sum(c / 20 * math.log2(c / 20) for c in n.values()))
        return best

    named = lambda v: any(w in v.lower() for w in op6_secrets.ALLOWED)
    more = []
    for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", text):
        parts = [p for p in re.split("[/=_-]", m[0]) if len(p) >= 20 and not named(p)] if named(m[0]) else [m[0]]
        if any(limit(p) is not None and entropy(p) >= limit(p) - 1e-9 for p in parts) and not any(s <= m.start() and e >= m.end() for s, _, e in base):
            more.append((m.start(), 3, m.end()))
    return ",".join(f"{op6_secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base + more))


def test_all_spans(spark):
    rng = random.Random(5)
    pools = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "abcdefghijkl-_", "aab"]
    piece = lambda: rng.choice(["", "token=", "my_secret: ", "AKIA", "example", "é", "key ", "x/", "password = '", "-"]) + "".join(rng.choices(rng.choice(pools), k=rng.choice((5, 17, 21, 24, 40))))
    texts = [rng.choice([" ", "", ". "]).join(piece() for _ in range(rng.choice((1, 3, 9, 400)))) for _ in range(120)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r.spans for r in op6_secrets.secrets(df).orderBy("doc_id").collect()]
    want = [brute_spans(t) for t in texts]
    assert got == want and sum("entropy" in w for w in want) > 20


@pytest.mark.parametrize("one", ["0123456789abcdef0 ", "Xy7Kp2Qm9Rt4Vw8Zb3Nc6 ", "token=abcdefghijkl1 "])
def test_many_hits_in_one_text(spark, one):
    text = one * 20_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    op6_secrets.secrets(df.selectExpr("doc_id", "left(text, 1000) AS text")).collect()
    began = time.time()
    spans = op6_secrets.secrets(df).first().spans.split(",")
    assert len(spans) == 20_000 and time.time() - began < 20
    assert spans[-1].split(":")[1:] == [str(len(text) - len(one)), str(len(text) - 1)]
