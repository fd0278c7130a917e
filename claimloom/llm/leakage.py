"""Problem 7: passages of evaluation items that stand in training documents.

Method: a distributed positional inverted index. ``index`` reads every document once and stores, for every term of the corpus,
its posting lists: the positions at which it stands. Documents are grouped into shards of a bounded number of words; a term
has a list in each shard that holds it, so the lists of a frequent term are split by document range and no list
grows with the corpus. The index knows nothing of test items; any number of suites is matched against it (``matches``)
without reading a text again.

Matching takes the corpus frequencies of the items' terms from the index. Of every window of an item the rarest terms become
anchors; their posting lists are shifted by the anchors' offsets in the item and intersected: positions that agree on
(document, item, shift) are phrase candidates, which are then compared word by word through the posting lists of the item's
other terms. Nothing is shuffled but term counts, and a task holds one shard's lists of the items' terms.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from claimloom.session import cut

#: Words of a passage that make it a leak; rarest terms taken from each window of so many words.
RUN, ANCHORS = 20, 2
#: Proximity: shifts this close count as one place, if they hold at least this share of the item's anchors.
SLACK, NEAR_SHARE = 10, 0.5
#: Items are held by every task; sets with more words are matched in blocks of items, each a scan of the index, not of texts.
BLOCK_WORDS = 2_000_000
#: Words of a shard: documents are put into one until it has that many.
SHARD_WORDS = 4_000_000
#: Stands for a term in a shard's row of documents.
DOCUMENTS = 0
INDEX = "shard long, term long, n long, positions binary"

# Commands whose arguments are keys or names, environments, other commands; then words.
_WORDS = re.compile(
    r"\\[a-z]*(?:cite|ref|label)[a-z]*\*?\s*(?:\[[^\]]*\]\s*)*\{[^}]*\}"
    r"|\\(?:begin|end)\s*\{[^}]*\}(?:\[[^\]]*\])?"
    r"|\\[a-z@]+\*?"
    r"|([^\W_]+(?:[.'’\-][^\W_]+)*)"
)


def words(text: str) -> list[str]:
    """Words of a text in markup, in lower case: commands, keys of citations, comment signs and punctuation are gone."""
    return [w for w in _WORDS.findall(text.casefold()) if w]


def term_of(word: str) -> int:
    """The 64-bit hash by which a word is stored."""
    return max(1, xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1)


def _packed(positions: np.ndarray) -> bytes:
    """Rising positions: the width of the steps, the first position, the steps from each to the next."""
    steps = np.diff(positions)
    top = int(steps.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([width]) + int(positions[0]).to_bytes(4, "little") + steps.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.empty((len(data) - 5) // data[0] + 1, dtype=np.int64)
    out[0] = int.from_bytes(data[1:5], "little")
    out[1:] = np.frombuffer(data, dtype=f"<u{data[0]}", offset=5)
    return np.cumsum(out, out=out)


class _Shard:
    """Documents on the way to being a shard: each word's number here, and the numbers of all words in order."""

    def __init__(self, name: int):
        self.name, self.words, self.docs, self.numbers, self.ends = name, {}, [], [], []
        self.size = 0

    def add(self, doc: int, text: str) -> None:
        known = self.words
        seq = np.array([known.setdefault(w, len(known)) for w in words(text)], dtype=np.uint32)
        self.size += len(seq)
        self.docs.append(doc)
        self.numbers.append(seq)
        self.ends.append(self.size)

    def rows(self) -> pd.DataFrame:
        every = np.concatenate(self.numbers)
        order = np.argsort(every, kind="stable")
        sizes = np.bincount(every, minlength=len(self.words))
        at = np.concatenate(([0], np.cumsum(sizes))).tolist()
        lists = [_packed(order[a:b]) for a, b in zip(at, at[1:])]
        docs = np.array([self.docs, self.ends], dtype="<i8").tobytes()
        return pd.DataFrame({"shard": self.name, "term": [DOCUMENTS, *map(term_of, self.words)], "n": [len(self.docs), *sizes.tolist()], "positions": [docs, *lists]})


def _index_batches(shard_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = itertools.count(TaskContext.get().partitionId() << 32)
        shard = _Shard(next(names))
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                shard.add(doc, text)
                if shard.size >= shard_words:
                    yield shard.rows()
                    shard = _Shard(next(names))
        if shard.docs:
            yield shard.rows()

    return run


def index(documents: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The positional index of documents(doc_id, text): (shard, term, n, positions), in the shared checkpoint folder.

    One row per shard and term with the term's positions in the shard (its documents' words one after the other), and per
    shard one row with term DOCUMENTS, its documents' ids and ends. A shard's rows lie together, that row first. Null texts
    are left out; texts without a word and repeated documents are indexed like any other.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return cut(docs.mapInPandas(_index_batches(shard_words), INDEX))


def anchors(items: dict[int, list[int]], frequency: np.ndarray, run: int = RUN, per_window: int = ANCHORS) -> dict[int, list[int]]:
    """Offsets per item such that every window of ``run`` words holds its ``per_window`` rarest terms."""
    out = {}
    for item, seq in items.items():
        order = np.lexsort((np.arange(len(seq)), frequency[np.asarray(seq, dtype=np.int64)])) if seq else []
        rank = np.empty(len(seq), dtype=np.int64)
        rank[order] = np.arange(len(seq))
        keep: set[int] = set()
        for a in range(len(seq) - run + 1):
            keep.update(a + np.argsort(rank[a : a + run])[:per_window])
        out[item] = sorted(int(k) for k in keep)
    return out


def _match_batches(items: dict[int, list[int]], offsets: dict[int, list[int]], term_ids: dict[int, int], run: int):
    names = sorted(i for i in items if offsets[i])
    lists: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k, i in enumerate(names):
        for o in offsets[i]:
            lists[items[i][o]].append((k, o))
    heads = {t: np.array(v, dtype=np.int64) for t, v in lists.items()}
    seqs = [np.asarray(items[i], dtype=np.int32) for i in names]
    n_anchors = np.array([len(offsets[i]) for i in names], dtype=np.int64)

    def longest(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int]:
        """Longest run of equal words where item word 0 lies at ``shift``: (length, start in the document)."""
        lo, hi = max(0, shift), min(len(doc), shift + len(item))
        same = np.concatenate(([0], doc[lo:hi] == item[lo - shift : hi - shift], [0]))
        edge = np.flatnonzero(np.diff(same))
        if not len(edge):
            return 0, lo
        sizes = edge[1::2] - edge[::2]
        best = int(np.argmax(sizes))
        return int(sizes[best]), lo + int(edge[::2][best])

    def matched(shard: dict[int, np.ndarray], ids: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        columns = ["doc_id", "item_id", "kind", "words", "at_word"]
        begins = np.concatenate(([0], ends[:-1]))
        hits = []
        for term, at in shard.items():
            if (head := heads.get(term)) is not None:
                doc = np.searchsorted(ends, at, side="right")
                p, h = np.repeat(np.arange(len(at)), len(head)), np.tile(np.arange(len(head)), len(at))
                hits.append(np.stack((doc[p], head[h, 0], (at - begins[doc])[p] - head[h, 1], head[h, 1])))
        if not hits:
            return pd.DataFrame([], columns=columns)
        d, k, shift, off = np.concatenate(hits, axis=1)
        order = np.lexsort((shift, k, d))
        d, k, shift, off = d[order], k[order], shift[order], off[order]
        pair = np.concatenate(([True], (np.diff(d) != 0) | (np.diff(k) != 0)))
        place = pair | np.concatenate(([True], np.diff(shift) != 0))
        starts = np.flatnonzero(place)
        starts = starts[np.diff(np.append(starts, len(d))) > 1]  # lists of two anchors meet
        first = np.flatnonzero(pair)
        size = np.diff(np.append(first, len(d)))
        near = first[size >= np.maximum(ANCHORS + 1, NEAR_SHARE * n_anchors[k[first]])]
        # The words of the documents that are candidates, from the posting lists of all terms of the items.
        wanted = np.zeros(len(ids), dtype=bool)
        wanted[d[starts]] = True
        room = np.where(wanted, ends - begins, 0)
        base = np.cumsum(room) - room
        line = np.zeros(int(room.sum()), dtype=np.int32)
        if len(line):
            for term, at in shard.items():
                doc = np.searchsorted(ends, at, side="right")
                mine = wanted[doc]
                line[(at - begins[doc] + base[doc])[mine]] = term
        rows: dict[tuple[int, int], tuple] = {}
        for g in starts.tolist():
            n, start = longest(line[base[d[g]] : base[d[g]] + room[d[g]]], seqs[k[g]], int(shift[g]))
            if n >= run and n > rows.get((d[g], k[g]), ("", 0))[1]:
                rows[d[g], k[g]] = ("phrase", n, start)
        last = dict(zip(first.tolist(), (first + size).tolist()))
        for g in near.tolist():
            if (d[g], k[g]) in rows:
                continue
            s, o = shift[g : last[g]], off[g : last[g]]
            best = max(((len(np.unique(o[a : np.searchsorted(s, s[a] + SLACK, side="right")])), -a) for a in range(len(s))), default=(0, 0))
            if best[0] >= max(ANCHORS + 1, NEAR_SHARE * n_anchors[k[g]]):
                rows[d[g], k[g]] = ("proximity", best[0], max(0, int(s[-best[1]])))
        return pd.DataFrame([(ids[a], names[b], *v) for (a, b), v in rows.items()], columns=columns)

    def run_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, shard, docs = None, {}, None
        for pdf in batches:
            for name, term, data in zip(pdf["shard"], pdf["term"], pdf["positions"]):
                if name != at:
                    if docs is not None:
                        yield matched(shard, *docs)
                    at, shard, docs = name, {}, None
                if term == DOCUMENTS:
                    docs = np.frombuffer(data, dtype="<i8").reshape(2, -1)
                else:
                    shard[term_ids[term]] = _unpacked(data)
        if docs is not None:
            yield matched(shard, *docs)

    return run_batches


def matches(corpus: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, item_id, kind, words, at_word) for every document and item with a match; ``corpus`` is an ``index``.

    ``kind`` is ``phrase`` (at least ``run`` consecutive words of the item; ``words`` is the longest run) or ``proximity``
    (no such run, but half of the item's anchor terms lie at nearly the same shift; ``words`` counts them).
    ``at_word`` is the word of the document where the run starts. Input: items(item_id, text). Null texts match nothing, nor do
    items of under ``run`` words; items with equal text leak together; repeated documents are reported each. Empty
    tables give no rows.
    """
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // (4 * BLOCK_WORDS)))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    out = None
    for b in range(blocks):
        got = [(int(r[0]), words(r[1])) for r in items.where("text is not null").where(block == b).select("item_id", "text").toLocalIterator()]
        one = _matches_of(corpus, {i: seq for i, seq in got if len(seq) >= run}, run)
        out = one if out is None else out.unionByName(one)
    return out


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """``matches`` of one suite of items in documents(doc_id, text), which are indexed first."""
    return matches(index(documents), items, run)


def _matches_of(corpus: DataFrame, items: dict[int, list[str]], run: int) -> DataFrame:
    vocabulary = sorted({w for seq in items.values() for w in seq})
    term_ids = {term_of(w): i for i, w in enumerate(vocabulary, 1)}
    seqs = {i: [term_ids[term_of(w)] for w in seq] for i, seq in items.items()}
    # At most one term for each word of the items, of which a block has a bounded number.
    asked = F.broadcast(corpus.sparkSession.createDataFrame([(t,) for t in term_ids], "term long"))
    lists = corpus.join(asked, "term", "left_semi")
    frequency = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    for r in lists.groupBy("term").agg(F.sum("n").alias("n")).collect():
        frequency[term_ids[r["term"]]] = r["n"]
    match = _match_batches(seqs, anchors(seqs, frequency, run), term_ids, run)
    asked = F.broadcast(corpus.sparkSession.createDataFrame([(t,) for t in [DOCUMENTS, *term_ids]], "term long"))
    return corpus.join(asked, "term", "left_semi").select("shard", "term", "positions").mapInPandas(match, "doc_id long, item_id long, kind string, words int, at_word int")
