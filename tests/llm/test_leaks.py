import random

import numpy as np

from leafmill.llm import leaks as K


def test_index_counts_and_places():
    rng = random.Random(3)
    for n, sigma in ((1, 3), (50, 3), (400, 5), (3000, 40)):
        s = np.array([rng.randrange(sigma) for _ in range(n)])
        index = K.FMIndex(s, sigma)
        order = sorted(range(n + 1), key=lambda i: [*s[i:], 0][: n + 1 - i] + [-1])
        assert K._suffix_array(np.append(s, 0)).tolist() == order
        patterns = np.array([[rng.randrange(1, sigma) for _ in range(3)] for _ in range(60)])
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(n - 2) if (s[i : i + 3] == p).all()]
            got = sorted(index.locate(np.arange(a, b)).tolist()) if a < b else []
            assert got == want


def brute(docs, items, words=12):
    import re

    cut = lambda t: [w.casefold() for w in re.findall(r"[^\W_]+", t or "")]
    out = set()
    for i, t in items:
        w = cut(t)
        wins = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)}
        for d, x in docs:
            y = cut(x)
            if any(tuple(y[j : j + words]) in wins for j in range(len(y) - words + 1)):
                out.add((d, i))
    return out


def data():
    rng = random.Random(5)
    vocab = [a + b for a in "bcdfg" for b in ("ar", "el", "ong", "ü", "ß")]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice((8, 12, 20, 40)))) for i in range(25)] + [(100, None), (101, ""), (102, "one two")]
    items.append((103, items[3][1]))  # the same passage under another id
    docs = []
    for d in range(120):
        base = text(rng.randrange(0, 80)).split()
        if d % 3 == 0:
            _, t = rng.choice(items[:25])
            w = t.split()
            a = rng.randrange(0, max(1, len(w) - 11))
            part = w[a : a + rng.choice((11, 12, 15, 40))]
            at = rng.randrange(0, len(base) + 1)
            base[at:at] = [x.upper() if rng.random() < 0.5 else x + rng.choice((",", "-", " — ", "_")) for x in part]
        docs.append((d, " ".join(base)))
    docs += [(500, None), (501, ""), (502, "..."), (0, docs[0][1]), (503, (items[5][1] + " ") * 400)]
    return docs, items


def test_found(spark):
    docs, items = data()
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in docs], "doc_id long, text string, item_id string, start string")
    it = spark.createDataFrame([(a, b, "z") for a, b in items], "item_id long, text string, doc_id string")
    want = brute(docs, items)
    for shard in (K.SHARD_WORDS, 30):
        spans = K.leaked_spans(df, it, shard_words=shard).collect()
        assert {(r["doc_id"], r["item_id"]) for r in spans} == want and len(want) > 10
        texts = {d: t for d, t in docs}
        for r in spans:
            inside = texts[r["doc_id"]][r["start"] : r["stop"]]
            assert brute([(1, inside)], [(i, t) for i, t in items if i == r["item_id"]]) == {(1, r["item_id"])}
    cut = K.merged_spans(K.leaked_spans(df, it)).collect()
    assert {r["doc_id"] for r in cut} == {d for d, _ in want}
    for r in cut:
        s = r["spans"]
        assert all(a["stop"] < b["start"] for a, b in zip(s, s[1:]))
    assert K.leaked_spans(df.limit(0), it).count() == 0 and K.leaked_spans(df, it.limit(0)).count() == 0
