"""Leaks against a plain search for runs."""

import random

from claimloom.llm import leakage

VOCAB = [f"w{i}" for i in range(400)]


def longest(doc, item):
    best = 0
    for a in range(len(doc)):
        for b in range(len(item)):
            n = 0
            while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n]:
                n += 1
            best = max(best, n)
    return best


def test_words():
    assert leakage.words(r"The \emph{Big} gap~\cite[p. 3]{key2001}, % note" + "\n%% more \\begin{itemize}[x]\\item 1.5\\% of self-made~\\ref{s:1}.") == ["the", "big", "gap", "note", "more", "1.5", "of", "self-made"]
    assert leakage.words("") == []


def test_against_brute_force(spark):
    rng = random.Random(7)
    items = {i: rng.choices(VOCAB, k=rng.randint(10, 60)) for i in range(12)}
    items[12] = items[3][:]
    docs = {}
    for d in range(60):
        body = rng.choices(VOCAB, k=rng.randint(0, 200))
        if d % 3:
            it = items[rng.randrange(13)]
            n = rng.choice([12, 19, 20, 21, 35])
            a = rng.randrange(max(1, len(it) - n + 1))
            at = rng.randrange(len(body) + 1)
            body[at:at] = it[a : a + n]
        docs[d] = body
    noisy = {d: ", ".join(w.upper() if i % 5 == 0 else w for i, w in enumerate(b)).replace("w7,", "w7~\\cite{k}\n%") for d, b in docs.items()}
    rows = [(d, t, "clash") for d, t in noisy.items()] + [(100, None, "x"), (101, "", "x"), (5, noisy[5], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(3)
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(50, None), (51, ""), (52, "too short")], "item_id long, text string")
    got = leakage.leaks(df, it).where("kind = 'phrase'").collect()
    want = {(d, i): longest(docs[d], items[i]) for d in docs for i in items}
    want = {k: n for k, n in want.items() if n >= leakage.RUN}
    assert {(r["doc_id"], r["item_id"]): r["words"] for r in got} == want and len(want) > 10
    assert len(got) == len(want) + sum(d == 5 for d, _ in want)
    assert leakage.leaks(df.limit(0), it).count() == 0 and leakage.leaks(df, it.limit(0)).count() == 0


def test_proximity(spark):
    item = [f"k{i}" for i in range(30)]
    broken = " ".join(w for i, w in enumerate(item) if i % 8)
    df = spark.createDataFrame([(1, "lead " * 40 + broken), (2, "nothing " * 50 + "k0 k8 k16 k24 " * 3), (3, " ".join(item))], "doc_id long, text string")
    it = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {(r["doc_id"], r["kind"]) for r in leakage.leaks(df, it).collect()} == {(1, "proximity"), (3, "phrase")}


def test_very_long_document_and_blocks(spark, monkeypatch):
    item = [f"q{i}" for i in range(25)]
    df = spark.createDataFrame([(1, "filler text " * 200_000 + " ".join(item))], "doc_id long, text string")
    it = spark.createDataFrame([(i, " ".join(item)) for i in range(4)], "item_id long, text string")
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 20)
    assert {r["item_id"] for r in leakage.leaks(df, it).where("kind = 'phrase'").collect()} == {0, 1, 2, 3}


def test_lists_of_positions():
    import numpy as np

    for x in ([5], [0, 1, 2], [70_000, 70_255], [3, 300, 70_000, 3_000_000], list(range(0, 4_000_000, 40_007))):
        assert leakage._unpacked(leakage._packed(np.array(x))).tolist() == x


def test_one_index_serves_several_suites(spark):
    rng = random.Random(3)
    docs = [rng.choices(VOCAB, k=rng.randint(0, 150)) for _ in range(40)]
    suites = [[rng.choices(VOCAB, k=30) for _ in range(6)] for _ in range(2)]
    for d, doc in enumerate(docs):
        if d % 2:
            doc[5:5] = suites[d % 4 == 1][d % 6][: rng.choice([15, 20, 25, 30])]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string").repartition(2)
    corpus = leakage.index(df, shard_words=400)
    assert corpus.where("term = 0").count() > 4 and corpus.where("term <> 0").agg({"n": "sum"}).first()[0] == sum(map(len, docs))
    for suite in suites:
        it = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(suite)], "item_id long, text string")
        got = leakage.matches(corpus, it)
        assert "text" not in got._jdf.queryExecution().optimizedPlan().toString()
        want = {(d, i): n for d, doc in enumerate(docs) for i, w in enumerate(suite) if (n := longest(doc, w)) >= leakage.RUN}
        assert {(r["doc_id"], r["item_id"]): r["words"] for r in got.where("kind = 'phrase'").collect()} == want and want


def test_proximity_against_brute_force(spark):
    """Documents that hold an item with words left out or put in: each matches as its definition says, found by trying all places."""
    import numpy as np

    rng = random.Random(11)
    items = [rng.sample(VOCAB, k=40) for _ in range(5)]
    docs = []
    for d in range(40):
        body = [w for w in items[d % 5] if rng.random() > 0.02 * (d // 5)]
        for _ in range(d % 4):
            body.insert(rng.randrange(len(body)), "extra")
        docs.append(rng.choices(VOCAB, k=50) + body + rng.choices(VOCAB, k=50))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["kind"], r["words"]) for r in leakage.leaks(df, it).collect()}
    ids = {w: i for i, w in enumerate(sorted({w for x in items for w in x}), 1)}
    count = np.zeros(len(ids) + 1, dtype=np.int64)
    for doc in docs:
        for w in doc:
            if w in ids:
                count[ids[w]] += 1
    offsets = leakage.anchors({i: [ids[w] for w in x] for i, x in enumerate(items)}, count)
    want = {}
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            if (n := longest(doc, item)) >= leakage.RUN:
                want[d, i] = ("phrase", n)
                continue
            places = [(p - o, o) for o in offsets[i] for p, w in enumerate(doc) if w == item[o]]
            best = max((len({o for s, o in places if a <= s <= a + leakage.SLACK}) for a, _ in places), default=0)
            if best >= max(leakage.ANCHORS + 1, leakage.NEAR_SHARE * len(offsets[i])):
                want[d, i] = ("proximity", best)
    assert got == want and {k for k, _ in want.values()} == {"phrase", "proximity"}
