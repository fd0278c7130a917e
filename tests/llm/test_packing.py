"""Packing by sum of squares."""

import base64
import random

import pytest

from claimloom.llm import packing


def brute_level(levels, size, capacity):
    """The level whose change of the sum of squared counts is least, the fullest of equals."""
    best = None
    for level in [0, *[h for h, n in levels.items() if n and h + size <= capacity]]:
        after = dict(levels)
        if level:
            after[level] -= 1
        if level + size < capacity:
            after[level + size] = after.get(level + size, 0) + 1
        key = (sum(n * n for n in after.values()), -level)
        if best is None or key < best[0]:
            best = (key, level, after)
    return best[1], best[2]


def test_rule_against_brute_force():
    rng = random.Random(5)
    p, levels = packing.SumOfSquares(40), {}
    fill = {}
    for _ in range(600):
        size = rng.randint(1, 40)
        want, levels = brute_level(levels, size, 40)
        window, level = p.place(size)
        assert level == want and fill.get(window, 0) == level
        fill[window] = level + size
    assert max(fill.values()) <= 40 and sum(fill.values()) / (40 * len(fill)) > 0.9
    for bad in (0, 41):
        with pytest.raises(ValueError):
            p.place(bad)


@pytest.fixture(scope="module")
def ranks(tmp_path_factory):
    """A vocabulary of single bytes: as many tokens as bytes."""
    f = tmp_path_factory.mktemp("v") / "bytes.tiktoken"
    f.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" " + str(i).encode() for i in range(256)))
    return str(f)


def test_frames(spark, ranks):
    rng = random.Random(1)
    texts = ["a" * rng.randint(1, 60) for _ in range(300)] + ["é" * 77, "x" * 200, None, "", "z" * 50]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1)], "doc_id long, text string, piece int").repartition(3)
    got = packing.packed(df, ranks, capacity=50).collect()
    fill = {}
    for r in got:
        if r["container_id"] is not None:
            fill.setdefault(r["container_id"], []).append((r["token_offset"], r["n_tokens"]))
    for spans in fill.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 50
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        parts = sorted(by[i], key=lambda r: (r["piece"], r["start_char"]))
        if not t:
            assert len(parts) == 1 and parts[0]["container_id"] is None
        elif len(t.encode()) <= 50:
            assert len(parts) == (2 if i == 0 else 1)
        else:
            assert "".join(t[r["start_char"] : r["end_char"]] for r in parts) == t and all(r["n_tokens"] <= 50 for r in parts) and parts[0]["n_tokens"] == 50
    assert sum(n for s in fill.values() for _, n in s) / (50 * len(fill)) > 0.85
    c = packing.checked(packing.packed(df, ranks, capacity=50), 50).first()
    assert c["docs"] == len(texts) + 1 and c["chars"] == sum(len(t or "") for t in texts) + len(texts[0]) and c["fill"] == sum(n for s in fill.values() for _, n in s) / (50 * len(fill))
    assert c["over_capacity"] == c["misplaced"] == c["split_needlessly"] == 0
    bad = spark.createDataFrame([(1, 0, 7, 0, 40, 0, 40), (2, 0, 7, 30, 20, 0, 20), (3, 0, 8, 5, 5, 0, 5)], "doc_id long, piece int, container_id long, token_offset int, n_tokens int, start_char int, end_char int")
    c = packing.checked(bad, 50).first()
    assert (c["over_capacity"], c["misplaced"]) == (1, 2)
    assert packing.packed(df.limit(0), ranks).count() == 0


@pytest.mark.parametrize("parts", [1, 12])
def test_little_space_is_left_in_many_partitions(spark, ranks, parts):
    rng = random.Random(8)
    texts = ["a" * min(60, max(1, int(rng.gauss(22, 14)))) for _ in range(6000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a" * 9)], "doc_id long, text string").repartition(parts)
    c = packing.checked(packing.packed(df, ranks, capacity=60), 60).first()
    assert c["fill"] >= 0.98 and c["docs"] == 6001 and c["over_capacity"] == c["misplaced"] == 0
