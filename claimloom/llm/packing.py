"""Problem 6: documents of varying length packed into windows of fixed capacity.

Method: sum-of-squares online packing. Windows are kept only as counts per fill level. Each document, as it comes, goes to the
fill level for which the sum of squared counts of partially filled windows grows least; ties go to the
fuller level. A document over the capacity is cut: full windows first, and its rest is packed like any other.

Every scan partition packs its own stream of documents, so a task holds one level array and the documents of its open
windows, and a task that runs again on another executor gives the same windows. What is still open when a partition
ends is packed once more, together with that of other partitions: their documents (ids and sizes, no texts), the largest
first, by the same rule. Without that, many partitions of few documents would leave much space unused.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from claimloom.session import cut as checkpointed

CAPACITY = 2048
#: Partitions whose open windows are packed again together: 2 ** SHARED, a bounded number of documents for a task.
SHARED = 6

# Fixed value: the pattern that splits text before the merges of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str, pattern: str = PATTERN):
    """(encoding, bytes of each token) of a rank file; loaded once in each Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


class SumOfSquares:
    """Online packer: ``place(size)`` gives (window, offset in it) for 0 < size <= capacity."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, dtype=np.int64)  # windows at each fill level; level 0 and full ones count as none
        self.at: dict[int, list[int]] = {}
        self.windows = 0

    def place(self, size: int) -> tuple[int, int]:
        if not 0 < size <= self.capacity:
            raise ValueError("size must be over 0 and at most the capacity")
        top = self.capacity - size
        cost = 2 * self.open[size : self.capacity + 1] + 1  # a window more at level + size ...
        cost[top] = 0  # ... unless it's full then
        cost[1:] -= 2 * self.open[1 : top + 1] - 1  # and a window less at the level
        cost[1:][self.open[1 : top + 1] == 0] = np.iinfo(np.int64).max
        level = top - int(np.argmin(cost[::-1]))
        if level:
            stack = self.at[level]
            window = stack.pop()
            self.open[level] -= 1
        else:
            window = self.windows
            self.windows += 1
        if level + size < self.capacity:
            self.at.setdefault(level + size, []).append(window)
            self.open[level + size] += 1
        return window, level


def cut(text: str, tokens: list[int], size: np.ndarray, capacity: int) -> list[tuple[int, int, int]]:
    """[(start_char, end_char, tokens)] of a text over the capacity; cuts never part a character."""
    raw = text.encode("utf-8", "surrogatepass")
    ends = np.cumsum(size[np.asarray(tokens)])
    out, at, chars = [], 0, 0
    while at < len(tokens):
        to = min(at + capacity, len(tokens))
        while at < to < len(tokens) and raw[ends[to - 1]] & 0xC0 == 0x80:
            to -= 1
        lo, hi = (int(ends[at - 1]) if at else 0), int(ends[to - 1])
        n = len(raw[lo:hi].decode("utf-8", "surrogatepass"))
        out.append((chars, chars + n, to - at))
        at, chars = to, chars + n
    return out


PIECE = "doc_id long, piece int, container_id long, token_offset int, n_tokens int, start_char int, end_char int, is_open boolean"
_COLUMNS = [c.split()[0] for c in PIECE.split(", ")]


def _frame(rows: list[list]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({"doc_id": "Int64", "container_id": "Int64", "token_offset": "Int64"})


def _pack_batches(vocabulary: str, pattern: str, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, size = tokenizer(vocabulary, pattern)
        packer, first = SumOfSquares(capacity), TaskContext.get().partitionId() << 40
        held: dict[int, list[list]] = {}  # rows of the open windows
        for pdf in batches:
            rows: list[list] = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                doc = None if pd.isna(doc) else int(doc)
                tokens = encoding.encode_ordinary(text) if text else []
                parts = [(0, len(text or ""), len(tokens))] if len(tokens) <= capacity else cut(text, tokens, size, capacity)
                for i, (a, b, n) in enumerate(parts):
                    if not n:
                        rows.append([doc, i, None, None, 0, a, b, False])
                        continue
                    window, at = packer.place(n)
                    mine = held.setdefault(window, [])
                    mine.append([doc, i, first + window, at, n, a, b, False])
                    if at + n == capacity:
                        rows += held.pop(window)
            yield _frame(rows)
        yield _frame([[*row[:-1], True] for rows in held.values() for row in rows])

    return run


def _again_batches(capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, packer = None, SumOfSquares(capacity)
        for pdf in batches:
            where, at = [], []
            for g, n in zip(pdf["group"], pdf["n_tokens"]):
                if g != group:
                    group, packer = g, SumOfSquares(capacity)
                window, level = packer.place(int(n))
                where.append((1 << 62) | (int(g) << 36) | window)
                at.append(level)
            yield pdf.assign(container_id=where, token_offset=at, is_open=False)[_COLUMNS]

    return run


def packed(documents: DataFrame, vocabulary: str, pattern: str = PATTERN, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, container_id, token_offset, n_tokens, start_char, end_char): where each document lies.

    Input: doc_id long, text string; other columns are ignored. ``vocabulary`` is the path of a rank file that
    every executor can read. A document within the capacity is one piece; pieces of a longer one are consecutive
    slices of its text. Null and empty texts have no tokens: one row, without a container. Repeated rows are
    packed again, null ids like any other. Tokens are those of the whole text, whatever its length.
    """
    rows = checkpointed(documents.select("doc_id", "text").mapInPandas(_pack_batches(vocabulary, pattern, capacity), PIECE))
    left = rows.where("is_open").withColumn("group", F.shiftright("container_id", 40 + SHARED))
    left = left.repartition("group").sortWithinPartitions("group", F.desc("n_tokens"), "container_id", "token_offset")
    return rows.where("not is_open").unionByName(left.mapInPandas(_again_batches(capacity), PIECE)).drop("is_open")


def checked(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row that tells whether ``packed`` rows are a packing: docs (first pieces), chars they cover, over_capacity (containers
    filled beyond it), misplaced (pieces that don't begin where the one before ends), split_needlessly (cut documents that
    would have fit), containers, fill (share of the containers' space that is used; null without containers)."""
    before = Window.partitionBy("container_id").orderBy("token_offset")
    some = F.col("container_id").isNotNull()  # pieces without tokens have none, and would be one group
    p = pieces.where(some).withColumn("due", F.coalesce(F.lag(F.col("token_offset") + F.col("n_tokens")).over(before), F.lit(0))).unionByName(pieces.where(~some).withColumn("due", F.lit(0)))
    one = p.groupBy("container_id").agg(
        F.count_if(F.col("piece") == 0).alias("docs"), F.sum(F.col("end_char") - F.col("start_char")).alias("chars"), F.sum("n_tokens").alias("used"),
        F.count_if((F.col("token_offset") != F.col("due")) & some).alias("misplaced"), F.count_if((F.col("piece") > 0) & (F.col("start_char") == 0)).alias("split_needlessly"))
    n = F.count("container_id")
    return one.agg(
        F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.count_if((F.col("used") > capacity) & some).alias("over_capacity"),
        F.coalesce(F.sum("misplaced"), F.lit(0)).alias("misplaced"), F.coalesce(F.sum("split_needlessly"), F.lit(0)).alias("split_needlessly"), n.alias("containers"), (F.sum("used") / F.when(n > 0, n * capacity)).alias("fill"))
