"""Spelling variants of a corpus vocabulary, by blocked Gram matrices of letter counts.

Words are maximal runs of letters (``[A-Za-z\\u00C0-\\u00FF]``) with A-Z in lower case.  Two words
one edit apart differ by one letter count (insertion) or two (replacement), so the squared
distance of their 90 letter counts is at most two.  Spark deals the vocabulary to cells (length
and the counts of some letter groups) and cells to blocks; two words one edit apart lie in the
same cell or in neighbouring ones.  For each pair of neighbouring blocks one NumPy product gives
all squared distances at once; the pairs at most two apart are verified as edits.  Only one row
a word and block pair leaves a task: the number of near words and the most frequent one.

A block holds a bounded number of words and bytes, so no task grows with a cell, and more letter
groups are used for a larger vocabulary, which leaves out products and never a pair.

Defined results: a null or empty text has no words; a null doc_id counts as ``null`` in the hash
that misspells runs; repeated rows count each; words of any length are compared; ties between
forms go to the smaller word in code-point order; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.inputs import arrow_schema, keyed_text, table, written

#: Fixed by the contract: letters (UTF-8 bytes, A-Z lowered before), least length and count,
#: the hash divisor of misspelt runs, and how much more frequent a form is.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){6,}")
ANY_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
LEAST_LENGTH, LEAST_COUNT, MISSPELT, RATIO = 6, 5, 199, 5
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
LETTERS = 26 + 64

BLOCK_WORDS = 2048
BLOCK_BYTES = 8 << 20


# --- the vocabulary -------------------------------------------------------------------------

def misspell(run: bytes, h: int) -> bytes:
    """The run without its code point number ``h % length``."""
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
               least_count: int = LEAST_COUNT, misspelt: int = MISSPELT) -> DataFrame:
    """(word, n) of words of at least so many letters and occurrences; counts of whole texts.

    One run in ``misspelt``, by a hash of document and run, loses a letter (0: none do).
    """
    pattern = RUN if least_length == LEAST_LENGTH else ANY_RUN
    schema = arrow_schema("word string, n long")

    def flush(counts):
        kept = [(w, n) for w, n in counts.items() if n]
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w, _ in kept], schema.field(0).type), pa.array([n for _, n in kept], pa.int64())],
            schema=schema)

    def run(batches):
        counts = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                text = text.as_py()
                if not text:
                    continue
                runs = pattern.findall(text.translate(LOWER))
                counts.update(runs)
                if misspelt:
                    start = zlib.crc32(b"null:" if doc_id is None else b"%d:" % doc_id)
                    for r in runs:
                        h = zlib.crc32(r, start)
                        if not h % misspelt:
                            counts[r] -= 1
                            counts[misspell(r, h)] += 1
                if len(counts) > 200_000:
                    yield flush(counts)
                    counts = Counter()
        yield flush(counts)

    found = keyed_text(df, id_col, text_col).mapInArrow(run, "word string, n long")
    return (found.filter(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= least_count))


# --- cells and blocks -----------------------------------------------------------------------

def letter_groups(words: int) -> int:
    """How many letter groups cells are cut by: one more for each fourfold vocabulary."""
    n, groups = words, 1
    while n > 16_384 and groups < 12:
        n, groups = n // 4, groups + 1
    return groups


def letter_numbers(words: list[str]) -> np.ndarray:
    """Letter numbers of equally long words, one row a word (a-z, then U+00C0 to U+00FF)."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(codes < 128, codes - 97, codes - 0xC0 + 26).reshape(len(words), -1)


def with_cells(words: DataFrame, groups: int) -> DataFrame:
    """Adds cell: the length and the letters in each group (a letter's number modulo ``groups``)."""
    schema = arrow_schema("word string, n long, cell array<int>")

    def run(batches):
        for batch in batches:
            cells = []
            for w in batch.column("word").to_pylist():
                of_group = np.bincount(letter_numbers([w])[0] % groups, minlength=groups)
                cells.append([len(w), *of_group.tolist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("word").cast(schema.field(0).type), batch.column("n"), pa.array(cells, schema.field(2).type)],
                schema=schema)

    return words.select("word", "n").mapInArrow(run, "word string, n long, cell array<int>")


def ahead(cell: list[int]) -> list[list[int]]:
    """The cell itself and half of its neighbours: one letter replaced, or one more letter."""
    length, counts = cell[0], list(cell[1:])
    found = [[length, *counts]]
    for i in range(len(counts)):
        more = list(counts)
        more[i] += 1
        found.append([length + 1, *more])
        for j in range(i + 1, len(counts)):
            moved = list(more)
            moved[j] -= 1
            if moved[j] >= 0:
                found.append([length, *moved])
    return found


def block_pairs(cells: DataFrame) -> DataFrame:
    """(cell, i, other, j): block i of a cell against block j of a neighbour, each pair once.

    ``cells`` is (cell, blocks).
    """
    schema = arrow_schema("cell array<int>, other array<int>, blocks int")

    def run(batches):
        for batch in batches:
            rows = [(c, o, b) for c, b in zip(batch.column("cell").to_pylist(), batch.column("blocks").to_pylist())
                    for o in ahead(c)]
            yield pa.RecordBatch.from_arrays([pa.array(x, schema.field(k).type) for k, x in
                                              enumerate(zip(*rows))] if rows else
                                             [pa.array([], f.type) for f in schema], schema=schema)

    near = cells.mapInArrow(run, "cell array<int>, other array<int>, blocks int")
    other = cells.select(F.col("cell").alias("other"), F.col("blocks").alias("other_blocks"))
    grid = (near.join(other, "other").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1))))
    return grid.filter((F.col("cell") != F.col("other")) | (F.col("i") <= F.col("j"))).select("cell", "i", "other", "j")


# --- one product of two blocks --------------------------------------------------------------

def letter_counts(numbers: np.ndarray) -> np.ndarray:
    n, length = numbers.shape
    flat = np.bincount((numbers + np.arange(n)[:, None] * LETTERS).ravel(), minlength=n * LETTERS)
    # Squares of a word's length must be exact in the number type.
    return flat.reshape(n, LETTERS).astype(np.float32 if length < 2048 else np.float64)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``b`` are the row of ``a`` with one letter replaced or, if longer, added."""
    n, length = a.shape
    if b.shape[1] == length:
        return (a != b).sum(1) == 1
    # Equal letters from the front and from the back have to cover the shorter word.
    front = np.argmin(np.c_[a == b[:, :length], np.zeros(n, bool)], axis=1)
    back = np.argmin(np.c_[(a == b[:, 1:])[:, ::-1], np.zeros(n, bool)], axis=1)
    return front + back >= length


def near_pairs(left: np.ndarray, right: np.ndarray, same: bool, strip: int = 512):
    """Places (in left, in right) of words one edit apart; each pair once if both are ``same``."""
    x, y = letter_counts(left), letter_counts(right)
    nx, ny = (x * x).sum(1), (y * y).sum(1)
    found = []
    for lo in range(0, len(x), strip):
        first = lo if same else 0
        d = x[lo:lo + strip] @ y[first:].T
        d *= -2
        d += nx[lo:lo + strip, None]
        d += ny[None, first:]
        at, to = np.nonzero(d <= 2)
        at, to = at + lo, to + first
        if same:
            at, to = at[at < to], to[at < to]
        step = max(1, (4 << 20) // right.shape[1])
        for k in range(0, len(at), step):
            ok = one_edit(left[at[k:k + step]], right[to[k:k + step]])
            found.append((at[k:k + step][ok], to[k:k + step][ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS, groups: int | None = None) -> DataFrame:
    """(word, n_near, near, near_n): words with near ones, how many, and the most frequent.

    ``words`` is (word, n), each word once; ties go to the smaller word.
    """
    groups = groups or letter_groups(words.count())
    placed = with_cells(words, groups)
    cells = placed.groupBy("cell").agg(F.count("*").alias("words")).select("cell", F.greatest(
        F.ceil(F.col("words") / block_words),
        F.ceil(F.col("words") * F.col("cell")[0] / BLOCK_BYTES)).cast("int").alias("blocks"))
    cells = written(cells, "spelling-cells")
    placed = written(placed.join(cells, "cell").select(
        "word", "n", "cell", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block")), "spelling-words")
    pairs = written(block_pairs(cells), "spelling-pairs")
    own = (F.col("cell") == F.col("other")) & (F.col("i") == F.col("j"))
    unit = ["cell", "i", "other", "j"]
    lefts = placed.withColumnRenamed("block", "i").join(pairs, ["cell", "i"]).select(*unit, F.lit(True).alias("left"), "word", "n")
    rights = (placed.select(F.col("cell").alias("other"), F.col("block").alias("j"), "word", "n")
              .join(pairs.filter(~own), ["other", "j"]).select(*unit, F.lit(False).alias("left"), "word", "n"))
    ddl = "word string, n_near long, near string, near_n long"
    schema = arrow_schema(ddl)

    def run(rows: pa.Table) -> pa.Table:
        is_left = np.array(rows.column("left").to_pylist(), bool)
        names = np.array(rows.column("word").to_pylist(), object)
        ns = rows.column("n").to_numpy()
        same = rows.column("cell")[0].as_py() == rows.column("other")[0].as_py() and \
            rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
        a = np.flatnonzero(is_left)
        b = a if same else np.flatnonzero(~is_left)
        if len(a) == 0 or len(b) == 0:
            return schema.empty_table()
        left = letter_numbers(names[a].tolist())
        at, to = near_pairs(left, left if same else letter_numbers(names[b].tolist()), same)
        if len(at) == 0:
            return schema.empty_table()
        in_order = np.argsort(names)
        rank = np.empty(len(names), np.int64)
        rank[in_order] = np.arange(len(names))
        word, near = np.concatenate([a[at], b[to]]), np.concatenate([b[to], a[at]])
        # Of each word the first by count, then by code points.
        order = np.lexsort((rank[near], -ns[near], word))
        word, near = word[order], near[order]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        return pa.table([pa.array(names[word[first]], schema.field(0).type), pa.array(np.diff(np.r_[first, len(word)])),
                         pa.array(names[near[first]], schema.field(2).type), pa.array(ns[near[first]], pa.int64())],
                        schema=schema)

    found = lefts.union(rights).groupBy(*unit).applyInArrow(run, ddl)
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("best.near").alias("near"), (-F.col("best.order")).alias("near_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form) links without cycles, by doubling the links followed."""
    at = written(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = written(at.join(on, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if at.filter("moved").limit(1).count() == 0:
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, block_words: int = BLOCK_WORDS, groups: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of (word, n) rows, each word once.

    A word's form is its most frequent near word if that has ``ratio`` times its occurrences;
    the root is the last of forms of forms.
    """
    near = near_words(words, block_words, groups)
    is_form = F.col("near_n") >= ratio * F.col("n")
    formed = written(words.select("word", "n").join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "spelling-forms")
    found = roots(formed.filter("form IS NOT NULL").select("word", "form"))
    return formed.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(written(vocabulary(table(spark, sf_dir, "documents")), "spelling-vocabulary"))
