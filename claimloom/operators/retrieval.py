"""BM25 retrieval of chunks, each source a corpus of its own."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from claimloom.functions.text import tokens
from claimloom.session import cut

# The ranking's constants.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: A source with more than one chunk in so many is split into parts, but not into parts of fewer than LEAST chunks; none has more than about MOST.
HOT, LEAST, MOST = 64, 500, 20_000
#: Scores that are held at a time.
CELLS = 1 << 19


def index(chunks: DataFrame, key: str = "chunk_id", source: str = "source_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lengths, postings) of chunks: (source, key, chunk_len) and (source, key, chunk_len, term, tf), each chunk tokenised once.

    Columns of ``chunks`` other than the text stay in both. Chunks without a token have no postings and don't count in any
    statistic. Both are cut through the shared checkpoint folder: everything else is computed from them.
    """
    keep = [c for c in dict.fromkeys([source, key, *chunks.columns]) if c != text]
    t = cut(chunks.select(*keep, tokens(F.col(text)).alias("_t"))).where(F.size("_t") > 0).withColumn("chunk_len", F.size("_t"))
    columns = [*keep, "chunk_len"]
    post = t.select(*columns, F.explode("_t").alias("term")).groupBy(*columns, "term").agg(F.count("*").alias("tf"))
    return t.select(*columns), cut(post)


def postings(chunks: DataFrame, key: str = "chunk_id", source: str = "source_id", text: str = "text") -> DataFrame:
    """(source, key, chunk_len, term, tf) of ``index``."""
    return index(chunks.select(source, key, text), key, source, text)[1]


def term_stats(post: DataFrame, source: str = "source_id") -> DataFrame:
    """(source, term, df, cf): chunks that hold the term and its occurrences."""
    return post.groupBy(source, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(lengths: DataFrame, source: str = "source_id") -> DataFrame:
    """(source, n_chunks, avg_len) of chunks with their lengths, a row each."""
    return lengths.groupBy(source).agg(F.count("*").alias("n_chunks"), F.avg("chunk_len").alias("avg_len"))


def idf(stats: DataFrame, corpus: DataFrame, source: str = "source_id") -> DataFrame:
    """(source, term, idf, avg_len). Negative values become EPSILON times the mean over all terms of the source."""
    raw = stats.join(corpus, source).withColumn("_idf", F.ln(F.col("n_chunks") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = raw.groupBy(source).agg(F.avg("_idf").alias("_mean"))
    return raw.join(mean, source).select(source, "term", F.when(F.col("_idf") < 0, EPSILON * F.col("_mean")).otherwise(F.col("_idf")).alias("idf"), "avg_len")


class _Part:
    """Chunks of a source, or of a part of it, in memory: postings by term with what each adds to a score."""

    def __init__(self) -> None:
        self.known: dict[str, float] | None = None  # idf of the whole source's terms, if this is a part of it
        self.avg_len = 0.0
        self.vocab: dict[str, int] = {}
        self.words, self.lens, self.rows = array("q"), array("q"), []
        self.ready = False

    def learn(self, terms: list[str], idfs: list[float], avg_len: float) -> None:
        self.known = {} if self.known is None else self.known
        self.known.update(zip(terms, idfs))
        self.avg_len = avg_len

    def add(self, texts: list[str], rows: pa.RecordBatch) -> None:
        vocab = self.vocab
        for t in texts:
            words = t.split(" ")
            self.words.extend([vocab.setdefault(w, len(vocab)) for w in words])
            self.lens.append(len(words))
        self.rows.append(rows)

    def index(self) -> None:
        lens, self.n = np.array(self.lens, dtype="int64"), len(self.lens)
        at, tf = np.unique(np.array(self.words, dtype="int64") * self.n + np.repeat(np.arange(self.n), lens), return_counts=True)
        term, self.doc = np.divmod(at, max(1, self.n))
        self.df = np.bincount(term, minlength=len(self.vocab))
        self.first = np.concatenate([[0], np.cumsum(self.df)])
        if self.known is None:
            raw = np.log(self.n - self.df + 0.5) - np.log(self.df + 0.5)
            weight, self.avg_len = np.where(raw < 0, EPSILON * (raw.mean() if len(raw) else 0.0), raw), float(lens.mean()) if self.n else 0.0
        else:
            weight = np.array([self.known[w] for w in self.vocab], dtype="float64")
        self.adds = weight[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[self.doc] / self.avg_len)) if self.n else np.zeros(0)
        self.wide: dict[int, np.ndarray] = {}
        self.table = pa.Table.from_batches(self.rows).combine_chunks() if self.rows else None
        self.words = self.lens = self.rows = self.known = None
        self.ready = True

    def spread(self, t: int) -> np.ndarray:
        """What a frequent term adds to the scores of all chunks, then where it occurs."""
        if t not in self.wide:
            both, at = np.zeros(2 * self.n), slice(self.first[t], self.first[t + 1])
            both[self.doc[at]] = self.adds[at]
            both[self.doc[at] + self.n] = 1
            self.wide[t] = both
        return self.wide[t]

    def best(self, texts: list[str], k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(query, chunk, score, overlap, n_terms) of the k best chunks of each query, blocks of queries at a time."""
        step = max(1, CELLS // max(1, self.n))
        for start in range(0, len(texts), step):
            row, term, qtf, n_terms = [], [], [], []
            for r, t in enumerate(texts[start : start + step]):
                words = t.split(" ")
                counts = dict.fromkeys(words, 1) if len(set(words)) == len(words) else Counter(words)
                n_terms.append(len(counts))
                for w, n in counts.items():
                    if (i := self.vocab.get(w)) is not None:
                        row.append(r)
                        term.append(i)
                        qtf.append(n)
            if not row:
                continue
            row, term, qtf, n_terms = (np.array(x, dtype="int64") for x in (row, term, qtf, n_terms))
            wide = self.df[term] * 4 >= max(self.n, LEAST)
            r, t, f = row[~wide], term[~wide], qtf[~wide]
            size = self.df[t]
            at = np.repeat(self.first[t] - np.cumsum(size) + size, size) + np.arange(size.sum())
            cell = np.repeat(r, size) * (2 * self.n) + self.doc[at]
            both = np.bincount(np.concatenate([cell, cell + self.n]), np.concatenate([self.adds[at] * np.repeat(f, size), np.ones(len(cell))]), len(n_terms) * 2 * self.n)
            both = both.astype("float64", copy=False).reshape(len(n_terms), 2 * self.n)
            for x, y, z in zip(row[wide].tolist(), term[wide].tolist(), qtf[wide].tolist()):
                if z == 1:
                    both[x] += self.spread(y)
                else:
                    both[x, : self.n] += z * self.spread(y)[: self.n]
                    both[x, self.n :] += self.spread(y)[self.n :]
            score, overlap = both[:, : self.n], both[:, self.n :]
            score[overlap == 0] = -np.inf
            keep = overlap > 0
            if self.n > k:  # by a little more than rounding can move a score
                keep &= score >= np.partition(score, self.n - k, axis=1)[:, self.n - k, None] - 2e-9
            q, d = np.nonzero(keep)
            s, o = np.round(score[q, d], 9), overlap[q, d].astype("int64")
            order = np.lexsort((d, -o, -s, q))  # chunks lie in the order of chunk_index and key
            q = q[order]
            order, q = (x[np.arange(len(q)) - np.searchsorted(q, q) < k] for x in (order, q))
            yield q + start, d[order], s[order], o[order], n_terms[q]


def _score_parts(k: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (source, _part, _kind, query, key, chunk_index, _t, _idf, _avg) sorted by source, part and kind (0: a term's idf, 1: a chunk,
    2: a query) -> ``names`` of the k best chunks of each query in each part. Queries pass by; only a part's chunks are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part = None, _Part()
        for b in batches:
            source, which, kind, query, key, position, text, weight, avg = b.columns
            new = np.zeros(max(0, b.num_rows - 1), dtype=bool)
            for c in (source, which, kind):
                new |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:]) if b.num_rows else ():
                if now != (now := (source[lo].as_py(), which[lo].as_py())):
                    part = _Part()
                texts = text[lo:hi].to_pylist()
                if kind[lo].as_py() == 0:
                    part.learn(texts, weight[lo:hi].to_pylist(), avg[lo].as_py())
                elif kind[lo].as_py() == 1:
                    own = pa.array(range(lo, hi))  # take() copies; a slice would hold the whole batch
                    part.add(texts, pa.RecordBatch.from_arrays([key.take(own), position.take(own)], names=["key", "position"]))
                else:
                    if not part.ready:
                        part.index()
                    if part.n:
                        for q, d, s, o, n in part.best(texts, k):
                            q, d = pa.array(q + lo), pa.array(d)
                            columns = [query.take(q), source.take(q), part.table["key"].combine_chunks().take(d), part.table["position"].combine_chunks().take(d), pa.array(s), pa.array(o), pa.array(n)]
                            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def searchable(chunks: DataFrame, source: str = "source_id", key: str = "chunk_id") -> DataFrame:
    """(source, key, chunk_index, _t): the chunks with a source and a key, their tokens joined by blanks. ``top_k`` takes it for ``chunks``."""
    return chunks.where(F.col(source).isNotNull() & F.col(key).isNotNull()).select(source, key, "chunk_index", F.array_join(tokens(F.col("text")), " ").alias("_t"))


def top_k(queries: DataFrame, chunks: DataFrame, k: int = 5, query: str = "query_id", source: str = "source_id", key: str = "chunk_id", every: int | None = None) -> DataFrame:
    """The k best chunks of each (query, source): rank, score, overlap, overlap_ratio.

    ``queries``: (query, source, query_text); ``chunks``: (source, key, chunk_index, text), or ``searchable`` of them where the caller keeps it. A chunk must share a term with
    the query; scores may be negative (tiny corpora) and still rank. Order: score, overlap, chunk_index, key. Query
    terms count as often as they occur. Queries without tokens and sources without chunks give no row. Scores are rounded
    to 9 places before they rank, so that the order of summation doesn't matter.

    Every chunk of a source is scored for every query put to it, in the memory of one task, from which only the k best come:
    what queries and chunks have in common is never a row. Sources larger than a HOT-th of all chunks (or MOST) are dealt out
    over parts by their chunk's key. All queries of such a source go to each of its parts, along with the whole source's idf of the part's
    terms; the k best of all parts are ranked together. ``every`` is the number of all chunks, where ``chunks`` are only those of some sources.
    """
    if not 1 <= k <= 20:
        raise ValueError("k must be from 1 to 20")
    spark = chunks.sparkSession
    held = (chunks if "_t" in chunks.columns else cut(searchable(chunks, source, key))).where("_t <> ''")
    every = held.count() if every is None else every
    largest = max(LEAST, min(MOST, every // HOT))
    split = held.groupBy(source).agg(F.count("*").alias("_n")).where(F.col("_n") > largest).select(source, F.ceil(F.col("_n") / largest).cast("int").alias("_parts"))
    split = F.broadcast(cut(split))  # at most a row for each part that all chunks together fill
    held = held.join(split, source, "left").withColumn("_part", F.pmod(F.xxhash64(key), F.coalesce("_parts", F.lit(1))).cast("int"))
    # Of split sources only: terms by part and their idf in the whole source.
    words = held.where("_parts is not null").select(source, key, "_part", F.split("_t", " ").alias("_w"))
    df = words.select(source, "_part", F.explode(F.array_distinct("_w")).alias("term")).groupBy(source, "_part", "term").agg(F.count("*").alias("df"))
    lengths = words.select(source, F.size("_w").alias("chunk_len"))
    weights = df.join(idf(df.groupBy(source, "term").agg(F.sum("df").alias("df")), corpus_stats(lengths, source), source), [source, "term"])
    asked = queries.where(F.col(query).isNotNull() & F.col(source).isNotNull()).select(query, source, F.array_join(tokens(F.col("query_text")), " ").alias("_t"))
    asked = asked.join(split, source, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    kinds = dict(queries.select(query).dtypes + chunks.select(source, key, "chunk_index").dtypes)
    shape = [(source, kinds[source]), ("_part", "int"), ("_kind", "int"), ("_query", kinds[query]), ("_key", kinds[key]), ("chunk_index", kinds["chunk_index"]), ("_t", "string"), ("_idf", "double"), ("_avg", "double")]

    def rows(df: DataFrame, kind: int, **have: str) -> DataFrame:
        given = {source: source, "_part": "_part", **have}
        return df.select(*[(F.lit(kind) if c == "_kind" else F.col(given[c]) if c in given else F.lit(None)).cast(t).alias(c) for c, t in shape])

    stream = rows(weights, 0, _t="term", _idf="idf", _avg="avg_len").unionByName(rows(held, 1, _key=key, chunk_index="chunk_index", _t="_t")).unionByName(rows(asked, 2, _query=query, _t="_t").where("_t <> ''"))
    # Parts differ in work, so there are more tasks than usual to even it out.
    stream = stream.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), source, "_part").sortWithinPartitions(source, "_part", "_kind", "chunk_index", "_key")
    out = [(query, kinds[query]), (source, kinds[source]), (key, kinds[key]), ("chunk_index", kinds["chunk_index"]), ("score", "double"), ("overlap", "bigint"), ("n_terms", "bigint")]
    scored = stream.mapInArrow(_score_parts(k, [c for c, _ in out]), ", ".join(f"`{c}` {t}" for c, t in out))
    w = Window.partitionBy(query, source)
    order = [F.desc("score"), F.desc("overlap"), F.asc("chunk_index"), F.asc(key)]
    ranked = scored.withColumn("rank", F.row_number().over(w.orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select(query, source, "rank", key, "score", "overlap", (F.col("overlap") / F.col("n_terms")).alias("overlap_ratio"))


def searchable_counts(chunks: DataFrame, source: str = "source_id", text: str = "text") -> DataFrame:
    """(source, chunks, searchable_chunks)."""
    return chunks.groupBy(source).agg(F.count("*").alias("chunks"), F.count_if(F.size(tokens(F.col(text))) > 0).alias("searchable_chunks"))
