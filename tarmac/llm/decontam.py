"""Benchmark decontamination by an FM-index over every shard of the documents.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.  A window is 13
consecutive words of a benchmark item (an item of 1 to 12 words is one window).  Each task
turns its share of the documents into word ids, indexes it (suffix array, Burrows-Wheeler
transform, wavelet tree, sampled suffix positions), searches all windows backward at once,
locates every occurrence and merges the covered words into removal spans.

A word that no item holds can never be inside an occurrence, so a run of item words between
two such words is kept only if it is as long as the shortest window: the index stays small
and exact.  The items are a query set that does not grow with the documents; they are sent to
the tasks in blocks of at most ``block_bytes`` of text, one pass over the documents a block.

Defined results: a null or empty text has no words; items without an id or without words are
left out; a repeated item_id counts once; rows are independent, so repeated rows each get the
same result; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations


from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.inputs import WORD_TABLE, slices, table, with_results, written


RESULT = ("n_words long, n_hit long, n_items long, items array<string>, "
          "spans array<struct<start:int,stop:int>>")


class WaveletTree:
    """Rank queries over a sequence of small integers, one bit vector a level."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low = np.zeros_like(at)
        for k in range(self.bits):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = self.ones[k][at], self.ones[k][low]
            at = np.where(one, self.zeros[k] + a, at - a)
            low = np.where(one, self.zeros[k] + b, low - b)
        return at - low


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Sorted suffixes by prefix doubling."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:n - step] = rank[step:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        if new[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = new, step * 2


class FMIndex:
    """Backward search and location over a sequence of word ids (0 parts the runs)."""

    SAMPLE = 8

    def __init__(self, seq: np.ndarray):
        seq = np.append(seq, -1).astype(np.int64) + 1  # the end sorts first
        order = suffix_array(seq)
        self.n = len(seq)
        self.last = seq[order - 1]
        self.tree = WaveletTree(self.last, max(1, int(seq.max()).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq))])
        sampled = order % self.SAMPLE == 0
        self.sampled = np.append(0, np.cumsum(sampled))
        self.places, self.is_sampled = order[sampled], sampled

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each window (one length)."""
        low = np.zeros(len(windows), np.int64)
        high = np.full(len(windows), self.n, np.int64)
        alive = np.arange(len(windows))
        for k in range(windows.shape[1] - 1, -1, -1):
            symbol = windows[alive, k] + 1
            known = symbol < len(self.first) - 1
            low[alive[~known]] = high[alive[~known]] = 0
            alive, symbol = alive[known], symbol[known]
            base = self.first[symbol]
            low[alive] = base + self.tree.rank(symbol, low[alive])
            high[alive] = base + self.tree.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        high = np.where(np.isin(np.arange(len(windows)), alive), high, low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to the next sampled one."""
        out = np.zeros(len(rows), np.int64)
        steps = np.zeros(len(rows), np.int64)
        todo, at = np.arange(len(rows)), rows.copy()
        while len(todo):
            hit = self.is_sampled[at]
            out[todo[hit]] = self.places[self.sampled[at[hit]]] + steps[todo[hit]]
            todo, at = todo[~hit], at[~hit]
            symbol = self.last[at]
            at = self.first[symbol] + self.tree.rank(symbol, at)
            steps[todo] += 1
        return out


class Benchmark:
    """The windows of one block of items, by length, with the items each belongs to."""

    def __init__(self, items: list[tuple[str, bytes]], width: int = 13):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = _split(text) if text else []
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                found.setdefault(tuple(ids[i:i + width]), set()).add(item)
        by_length: dict[int, list] = {}
        for window, names in found.items():
            by_length.setdefault(len(window), []).append((window, sorted(names)))
        self.groups = [(n, np.array([w for w, _ in rows], np.int64), [x for _, x in rows])
                       for n, rows in sorted(by_length.items())]
        self.shortest = min(by_length, default=0)


def _split(data: bytes) -> list[bytes]:
    return data.translate(WORD_TABLE).split()


def scan_shard(texts: list[bytes | None], bench: Benchmark):
    """One shard: word ids, index, search, locate; words, merged spans and items of every text."""
    get = bench.vocabulary.get
    n_words, parts = np.zeros(len(texts), np.int64), []
    for k, text in enumerate(texts):
        words = _split(text) if text else []
        n_words[k] = len(words)
        parts.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
        parts.append(np.zeros(1, np.int64))
    seq = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    doc_start = np.concatenate([[0], np.cumsum(n_words + 1)])
    spans: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    if bench.groups and len(seq):
        edge = np.diff(np.concatenate([[0], seq > 0, [0]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long_enough = end - begin >= bench.shortest
        begin, end = begin[long_enough], end[long_enough]
        if len(begin):
            # Each kept run with the 0 that follows it; ``origin`` maps back to ``seq``.
            size = end - begin + 1
            origin = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            index = FMIndex(seq[origin])
            cover = np.zeros(len(seq) + 1, np.int64)
            for length, windows, names in bench.groups:
                low, high = index.search(windows)
                which = np.flatnonzero(low < high)
                count = (high - low)[which]
                if not len(which):
                    continue
                offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at = origin[index.locate(np.repeat(low[which], count) + offset)]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + length, -1)
                doc = np.searchsorted(doc_start, at, side="right") - 1
                pair = np.unique(np.stack([doc, np.repeat(which, count)]), axis=1)
                for d, w in pair.T:
                    items[d].update(names[w])
            hit = np.cumsum(cover[:-1]) > 0
            edge = np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8))
            for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                d = int(np.searchsorted(doc_start, a, side="right")) - 1
                spans[d].append((int(a - doc_start[d]), int(b - doc_start[d])))
    return n_words, spans, items


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def annotate(df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
             item_text_col: str = "text", width: int = 13, block_bytes: int = 16 << 20,
             shard_bytes: int = 8 << 20) -> DataFrame:
    """All columns of ``df`` plus n_words, n_hit, n_items, items (sorted ids) and spans of hit
    words (from, to); of the same name, theirs are replaced.

    With more items than one block holds, the table is written after each block and the next
    pass adds to its results.
    """
    spark = df.sparkSession
    rows = (items.select(F.col(item_col).cast("string").alias("item"),
                         F.col(item_text_col).cast("string").alias("text"))
            .filter("item is not null and text is not null"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    for k in range(blocks):
        mine = rows.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) if blocks > 1 else rows
        sent = spark.sparkContext.broadcast(
            Benchmark([(r[0], r[1].encode()) for r in mine.collect()], width))

        def scan(batch, sent=sent, again=k > 0):
            for part in slices(batch, text_col, shard_bytes):
                texts = [None if x is None else x.encode() for x in part.column(text_col).to_pylist()]
                n_words, spans, names = scan_shard(texts, sent.value)
                if again:
                    before = part.column("spans").to_pylist(), part.column("items").to_pylist()
                    spans = [x + [(s["start"], s["stop"]) for s in y] for x, y in zip(spans, before[0])]
                    names = [x | set(y) for x, y in zip(names, before[1])]
                spans = [_merged(x) for x in spans]
                yield part, {
                    "n_words": n_words, "n_hit": [sum(b - a for a, b in x) for x in spans],
                    "n_items": [len(x) for x in names], "items": [sorted(x) for x in names],
                    "spans": [[{"start": a, "stop": b} for a, b in x] for x in spans]}

        df = with_results(df, RESULT, scan)
        if k < blocks - 1:
            df = written(df, "decontam")
    return df


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """The rule of the contract: some word hit, and at least one in twenty."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return annotate(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"), "items", "spans")
