"""Copies of benchmark items whose windows recur or are mostly placeholders."""

import random

import numpy as np

from tallyweave.llm.op7_templates import Words, item_windows, text_windows, verdict


def many(r, n):
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 9))) for _ in range(n)]


def found(item, text):
    """The item's windows joined with the text's, without Spark."""
    memo, at = Words(), {}
    for kind, size, total, tokens, h, q, mine in item_windows(item, memo):
        at.setdefault(h, []).append((kind, size, total, tokens, q, mine))
    sizes = sorted({(w[0], w[1]) for x in at.values() for w in x})
    hits = [(*w[:4], p, w[4], w[5], theirs) for h, p, theirs in text_windows(text, memo, sizes, lambda h: np.ones(len(h), bool)) for w in at.get(h, ())]
    return [7] if verdict(hits) else []


def test_window_twice():
    r = random.Random(1)
    for _ in range(20):
        w = many(r, 67)
        w[40:48] = w[20:28]  # of 60 windows, number 20 equals number 40
        item, around = " ".join(w), " ".join(many(r, 30))
        assert found(item, f"{around} {item} {around}") == [7]
        edited = " ".join([*w[:10], "inserted", *w[10:]])
        assert found(item, f"{around} {edited} {around}") == [7]
        assert found(item, f"{around} {' '.join(w[:24])} {around}") == []


def test_mostly_placeholders():
    sums = "12 + 7 = 19 and 30 + 4 = 34 and 8 + 8 = 16 and 5 + 6 = 11"
    names = "we saw Alice 4, Bob 5, Carol 6, Dave 7, Erin 8, Frank 9, Grace 10, Heidi 11, Ivan 12, Judy 13"
    for item in (sums, names, "1 2 3 4 5 6 7 8 9 10 11 12"):
        assert found(item, f"words before {item} and after") == [7]
        assert found(item, "we saw Tom 1, Ann 2, Kim 3 and 4 5 6 7 8 90 and 2 + 2 = 4 and no more of it") == []


def test_name_first():
    item = "Alice walks along the old river to town"
    assert found(item, f"then {item} today") == [7]


def test_other_values():
    """Questions with other numbers and names count if each value stands for one other, all over."""
    r = random.Random(4)
    for _ in range(20):
        w = many(r, 40)
        for i in range(3, 40, 5):
            w[i] = str(r.randint(2, 99))
        others = {x: str(1000 + i) for i, x in enumerate({x for x in w if x.isdigit()})}
        around = " ".join(many(r, 30))
        assert found(" ".join(w), f"{around} {' '.join(others.get(x, x) for x in w)} {around}") == [7]
    item = "he has 5 red balls and 5 blue balls then takes 5 green balls and 5 black balls out of 5 boxes"
    mixed = "he has 1 red balls and 2 blue balls then takes 3 green balls and 4 black balls out of 6 boxes"
    assert found(item, item.replace("5", "8")) == [7] and found(item, mixed) == []


def test_through_spark(spark):
    """The joins give what windows looked up one by one give."""
    from tallyweave.llm.op7_templates import contaminated, decontaminate

    r = random.Random(9)
    items = [" ".join(many(r, r.choice([3, 8, 20, 60]))) for _ in range(12)]
    items[3] = "Alice has 12 apples and gives 5 of them to Bob who eats 2 before 9 in the morning"
    items.append(items[0])
    texts = [" ".join(many(r, 20) + items[r.randrange(12)].split()[: r.choice([2, 10, 60])] + many(r, 9)) for _ in range(60)]
    texts += [f"now {items[3].replace('12', '40').replace('Alice', 'Eve')} ends", None, "", texts[0], texts[0]]
    docs = spark.createDataFrame([(i // 2, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, number string").repartition(4)
    bench = spark.createDataFrame([*enumerate(items), (99, None)], "item_id long, text string")
    want = sorted((i // 2, j) for i, t in enumerate(texts) for j, item in enumerate(items) if t and found(item, t))
    assert sorted((x.doc_id, x.item_id) for x in contaminated(docs, bench).collect()) == want and len(want) > 20
    clean = sorted(str((i // 2, t)) for i, t in enumerate(texts) if not t or not any(found(item, t) for item in items))
    assert sorted(str((x.doc_id, x.text)) for x in decontaminate(docs, bench).collect()) == clean
    assert decontaminate(docs, bench.limit(0)).count() == len(texts) and decontaminate(docs.limit(0), bench).count() == 0
