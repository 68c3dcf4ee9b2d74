"""Collocations: phrases of two and three words scored by their parts, from suffix subtrees.

Suffixes are the one to three words that start at a word and stay within its piece of text.
As in ERA, the suffix tree is partitioned vertically: words are counted first; every word is a
prefix with a known number of suffixes, and a prefix with more suffixes than a task's budget is
lengthened by a word (twice at most).  Prefixes fall into slots by a hash, and neighbouring slots
into groups whose suffixes fit the budget.  Spark brings each group's suffixes together, counted
before the shuffle; a task sorts its own, which gives the subtrees below its prefixes, cut at
depth three, and reads every node's count as the total of the leaves under it.

A phrase is no more frequent than its words and its pairs of words, so suffixes end before a word
or a pair that is too rare.  Pairs are counted by 63-bit hashes, and rare ones are recognised by
bit maps of hashes of a fixed size: an equal hash only leaves a suffix longer than it need be.
Hashes never decide about equality of words.  Scores are integer divisions of 38-digit numbers,
exact for counts up to 10^16.

Defined results: a null or empty text has no words; a null language is ``und``; repeated rows
count each; ties are ordered by the phrase's bytes; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmac.llm.inputs import arrow_schema, mix64, raw_bytes, slices, spans, table, written

#: Fixed by the contract: least occurrences, share of a longer phrase that makes a shorter one
#: go (percent), phrases reported a language, and the characters that part pieces and words.
LEAST, SHARE, TOP = 10, 50, 2000
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

BUDGET = 1 << 20  # suffixes of a group, before equal ones are counted and rare ones left out
SLOTS = 1 << 16
RANKED_PARTS = 256  # parts of a language that are ranked before it
SLICE = 4 << 20  # bytes of text cut into words at a time
MAP_BITS = 1 << 26

_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
_IS_BREAK = np.isin(np.arange(256), list(BREAKS))
_IS_WORD = ~(_IS_BREAK | np.isin(np.arange(256), list(BLANKS)))


class Words:
    """The words of a slice of texts: codes into a dictionary, languages, and which are followed
    by another word of their piece."""

    def __init__(self, part: pa.RecordBatch):
        data, offsets = raw_bytes(part.column("text"))
        data = _LOWER[data]
        inside = _IS_WORD[data]
        starts, ends = spans(inside, offsets)
        bounds = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=bounds[1:])
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(bounds), pa.py_buffer(data[inside])]).dictionary_encode()
        self.words = packed.dictionary.to_pylist()
        self.code = packed.indices.to_numpy().astype(np.int64)
        breaks = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_IS_BREAK[data], out=breaks[1:])
        doc = np.searchsorted(offsets, starts, side="right") - 1
        self.linked = np.zeros(len(starts), bool)
        self.linked[:-1] = (doc[1:] == doc[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]])
        langs = part.column("lang").dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]

    def counted(self):
        """(language number, word number, n) of the distinct words."""
        key, n = np.unique(self.lang * max(1, len(self.words)) + self.code, return_counts=True)
        return key // max(1, len(self.words)), key % max(1, len(self.words)), n

    def links(self, frequent: np.ndarray):
        """Places of frequent words that a frequent word follows, and hashes of the two."""
        size = max(1, len(self.words))
        lang, word, _ = self.counted()
        at = lang * size + word
        self.word_key = np.zeros(len(self.langs) * size, np.int64)
        self.word_key[at] = [zlib.crc32(b"%s %s" % (self.langs[a].encode(), self.words[b])) for a, b in zip(lang.tolist(), word.tolist())]
        self.word_hash = np.array([zlib.crc32(w) for w in self.words], np.int64)
        often = np.zeros(len(self.word_key), bool)
        often[at] = has_bit(frequent, self.word_key[at])
        good = often[self.lang * size + self.code]
        on = np.flatnonzero(self.linked[:-1] & good[:-1] & good[1:])
        return on, longer_key(self.word_key[self.lang[on] * size + self.code[on]], self.word_hash[self.code[on + 1]])

    def suffixes(self, frequent: np.ndarray, pairs: np.ndarray):
        """(language, first, second, third word number or -1, n, hash of the first word, of the
        first two) of the distinct suffixes of two or three words whose pairs are frequent."""
        size = max(1, len(self.words))
        on, key = self.links(frequent)
        on = on[has_bit(pairs, key)]
        kept = np.zeros(len(self.code) + 1, bool)
        kept[on] = True
        third = np.full(len(on), -1, np.int64)
        more = np.flatnonzero(kept[on + 1])
        third[more] = self.code[on[more] + 2]
        # Numbers of (language, first, second), then of the whole suffix, stay below 63 bits.
        found, at = np.unique((self.lang[on] * size + self.code[on]) * size + self.code[on + 1], return_inverse=True)
        whole, n = np.unique(at * (size + 1) + third + 1, return_counts=True)
        pair, third = found[whole // (size + 1)], whole % (size + 1) - 1
        first, second = pair // size, pair % size
        one = self.word_key[first]
        return first // size, first % size, second, third, n, one, longer_key(one, self.word_hash[second])


def longer_key(key: np.ndarray, word_hash: np.ndarray) -> np.ndarray:
    """The hash of a prefix with one more word (not negative)."""
    both = mix64(key.astype(np.uint64)) + mix64(word_hash.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
    return (mix64(both) >> np.uint64(1)).astype(np.int64)


def has_bit(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key % MAP_BITS
    return (bits[at >> 3] >> (at & 7)) & 1 == 1


def _prepared(df: DataFrame, text_col: str, group_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(group_col).cast("string"), F.lit("und")).alias("lang"),
                     F.col(text_col).cast("string").alias("text"))


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of all words of (lang, text) rows."""
    schema = arrow_schema("lang string, word string, n long")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                w = Words(part)
                lang, word, n = w.counted()
                names = pa.array(w.words, pa.large_binary()).cast(pa.large_string()).cast(schema.field(1).type)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.langs, schema.field(0).type).take(pa.array(lang)), names.take(pa.array(word)), pa.array(n)], schema=schema)

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def bit_map(keys: DataFrame) -> np.ndarray:
    """One bit for each hash in ``key``, as MAP_BITS / 8 bytes, put together from blocks."""
    ddl = "block int, bits binary"
    schema = arrow_schema(ddl)
    per_block = min(1 << 16, MAP_BITS)

    def run(rows: pa.Table) -> pa.Table:
        at = rows.column("at").to_numpy()
        bits = np.zeros(per_block, bool)
        bits[at % per_block] = True
        return pa.table([pa.array([int(at[0]) // per_block], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())],
                        schema=schema)

    at = keys.select(F.pmod("key", F.lit(MAP_BITS)).cast("int").alias("at")).distinct()
    found = np.zeros(MAP_BITS // 8, np.uint8)
    for r in at.groupBy(F.floor(F.col("at") / per_block)).applyInArrow(run, ddl).toLocalIterator():
        found[r["block"] * per_block // 8:(r["block"] + 1) * per_block // 8] = np.frombuffer(r["bits"], np.uint8)
    return found


# --- vertical partitioning ------------------------------------------------------------------

class Partition:
    """Prefixes of bounded suffix counts in groups: bit maps of frequent words and pairs, hashes
    of prefixes to lengthen, and the group of every slot.  Bounded: two maps of MAP_BITS, SLOTS
    numbers, and at most SLOTS prefixes of each length."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray | None, long1: list[int], long2: list[int], groups: np.ndarray | None):
        self.words, self.pairs, self.groups = words, pairs, groups
        self.long1, self.long2 = np.array(sorted(long1), np.int64), np.array(sorted(long2), np.int64)


def partition(texts: DataFrame, words: DataFrame, budget: int, least: int) -> Partition:
    """Count pairs of the frequent (lang, word, n) ``words`` by hash and group the prefixes."""
    total = words.agg(F.sum("n")).first()[0] or 0
    budget = max(budget, -(-total // SLOTS))
    keyed = words.groupBy(F.crc32(F.concat_ws(" ", "lang", "word").cast("binary")).alias("key")).agg(F.sum("n").alias("n"))

    def over(rows):
        """Prefixes over the budget: at most SLOTS."""
        return [r["key"] for r in rows.filter(F.col("n") > budget).select("key").toLocalIterator()]

    def load(rows):
        """Suffixes of the prefixes within the budget, by slot."""
        found = np.zeros(SLOTS)
        for r in (rows.filter(F.col("n") <= budget).groupBy(F.pmod("key", F.lit(SLOTS)).cast("int").alias("slot"))
                  .agg(F.sum("n").alias("n")).toLocalIterator()):
            found[r["slot"]] = r["n"]
        return found

    frequent, long1 = bit_map(keyed.select("key")), over(keyed)
    sent = texts.sparkSession.sparkContext.broadcast(Partition(frequent, None, long1, [], None))
    schema = arrow_schema("key long, lengthened boolean, n long")

    def run(batches):
        parts = sent.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                w = Words(part)
                on, key = w.links(parts.words)
                key, first, n = np.unique(key, return_index=True, return_counts=True)
                one = w.word_key[w.lang[on[first]] * max(1, len(w.words)) + w.code[on[first]]]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.isin(one, parts.long1)), pa.array(n)], schema=schema)

    pairs = written(texts.mapInArrow(run, "key long, lengthened boolean, n long").groupBy("key").agg(
        F.bool_or("lengthened").alias("lengthened"), F.sum("n").alias("n")).filter(F.col("n") >= least), "phrase-pairs")
    of_long = pairs.filter("lengthened")
    long2 = over(of_long)
    # Suffixes of three words are dealt by their own hashes, evenly over the slots.
    slots = load(keyed) + load(of_long) + (of_long.filter(F.col("n") > budget).agg(F.sum("n")).first()[0] or 0) / SLOTS
    groups, number, held = np.zeros(SLOTS, np.int32), 0, 0
    for slot in range(SLOTS):
        if held and held + slots[slot] > budget:
            number, held = number + 1, 0
        groups[slot], held = number, held + slots[slot]
    return Partition(frequent, bit_map(pairs.select("key")), long1, long2, groups)


# --- subtrees -------------------------------------------------------------------------------

def grouped_suffixes(texts: DataFrame, parts: Partition) -> DataFrame:
    """(part, pair, third, deep, n): suffixes with the group of their prefix.

    ``pair`` is the first two words, a line feed (no word holds one) and the language.  Under a
    prefix of two words that is lengthened, the suffixes of three words are ``deep``: they count
    for nodes of depth three alone, and one suffix of the two words counts for all of them.
    """
    ddl = "part int, pair string, third string, deep boolean, n long"
    schema = arrow_schema(ddl)
    sent = texts.sparkSession.sparkContext.broadcast(parts)

    def run(batches):
        parts = sent.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                w = Words(part)
                lang, first, second, third, n, key, key2 = w.suffixes(parts.words, parts.pairs)
                if len(n) == 0:
                    continue
                longer = np.isin(key, parts.long1)
                key = np.where(longer, key2, key)
                deep = longer & np.isin(key, parts.long2)
                if deep.any():
                    on, rest = np.flatnonzero(deep), np.flatnonzero(~deep)
                    pair = (lang[on] * len(w.words) + first[on]) * len(w.words) + second[on]
                    _, place, at = np.unique(pair, return_index=True, return_inverse=True)
                    top, whole = on[place], on[third[on] >= 0]
                    take = np.concatenate([rest, top, whole])
                    deep = np.arange(len(take)) >= len(rest) + len(top)
                    key = np.concatenate([key[rest], key[top], longer_key(key[whole], w.word_hash[third[whole]])])
                    n = np.concatenate([n[rest], np.bincount(at, n[on]).astype(np.int64), n[whole]])
                    third = np.concatenate([third[rest], np.full(len(top), -1), third[whole]])
                    lang, first, second = lang[take], first[take], second[take]
                names = pa.array(w.words, pa.binary()).cast(pa.string())
                words = pc.binary_join_element_wise(names.take(pa.array(first)), names.take(pa.array(second)), " ")
                pair = pc.binary_join_element_wise(words, pa.array(w.langs, pa.string()).take(pa.array(lang)), "\n")
                yield pa.RecordBatch.from_arrays([
                    pa.array(parts.groups[key % SLOTS]), pair.cast(schema.field(1).type),
                    names.take(pa.array(third, mask=third < 0)).cast(schema.field(2).type), pa.array(deep), pa.array(n)], schema=schema)

    return texts.mapInArrow(run, ddl)


def subtree_nodes(suffixes: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, f): nodes of depth two and three with at least so many occurrences."""
    ddl = "lang string, phrase string, words int, f long"
    schema = arrow_schema(ddl)

    def codes(column):
        encoded = column.combine_chunks().dictionary_encode()
        return encoded.indices.fill_null(-1).to_numpy().astype(np.int64), encoded.dictionary

    def run(rows: pa.Table) -> pa.Table:
        (pair, pairs), (third, thirds) = codes(rows.column("pair")), codes(rows.column("third"))
        deep = rows.column("deep").to_numpy(zero_copy_only=False).astype(bool)
        n = rows.column("n").to_numpy()
        # Sorted suffixes are the leaves; a node is a run of leaves that share its words.
        order = np.lexsort((third, pair))
        pair, third, deep, n = pair[order], third[order], deep[order], n[order]
        other2 = np.r_[True, pair[1:] != pair[:-1]]
        node2, node3 = np.flatnonzero(other2), np.flatnonzero(other2 | np.r_[True, third[1:] != third[:-1]])
        f2, f3 = np.add.reduceat(np.where(deep, 0, n), node2), np.add.reduceat(n, node3)
        node2, f2 = node2[f2 >= least], f2[f2 >= least]
        keep = (f3 >= least) & (third[node3] >= 0)
        node3, f3 = node3[keep], f3[keep]
        at = np.concatenate([node2, node3])
        two_words = [p.split("\n", 1) for p in pairs.take(pa.array(pair[at])).to_pylist()]
        last = thirds.take(pa.array(third[node3])).to_pylist()
        phrase = [w for w, _ in two_words[:len(node2)]] + [f"{w} {t}" for (w, _), t in zip(two_words[len(node2):], last)]
        return pa.table([pa.array([g for _, g in two_words], schema.field(0).type), pa.array(phrase, schema.field(1).type),
                         pa.array(np.repeat([2, 3], [len(node2), len(node3)]), pa.int32()),
                         pa.array(np.concatenate([f2, f3]), pa.int64())], schema=schema)

    return suffixes.groupBy("part").applyInArrow(run, ddl)


# --- scores ---------------------------------------------------------------------------------

def score(a, left, right):
    """floor(1000000 * a * a / (l * r)) without rounding."""
    return F.expr(f"CAST((CAST({a} AS DECIMAL(19,0)) * CAST({a} AS DECIMAL(19,0)) * 1000000) "
                  f"DIV (CAST({left} AS DECIMAL(19,0)) * CAST({right} AS DECIMAL(19,0))) AS LONG)")


def scored(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of the cut with the lowest score (then the first)."""
    cuts = (nodes.withColumnRenamed("f", "a").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
            .withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
            .withColumn("right", F.expr("substring(phrase, length(left) + 2)")))
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", score("a", "l", "r"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "words", "a").agg(best).select(
        "lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def collocations(df: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, text_col: str = "text",
                 group_col: str = "lang", budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases.

    A phrase goes if a longer one that holds it has ``share`` percent of its occurrences.
    """
    texts = _prepared(df, text_col, group_col)
    words = written(count_words(texts), "phrase-words")
    often = words.filter(F.col("n") >= least)
    prefixes = partition(texts, often, budget, least)
    nodes = written(subtree_nodes(grouped_suffixes(texts, prefixes), least), "phrase-nodes")
    counts = often.select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")).union(nodes.select("lang", "phrase", "f"))
    inner = F.explode(F.array(F.expr("substring_index(phrase, ' ', 2)"), F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)")))
    longer = (nodes.filter("words = 3").select("lang", "f", inner.alias("phrase")).groupBy("lang", "phrase")
              .agg(F.max("f").alias("longest")))
    # The longer phrase's share is taken of the shorter one's own occurrences.
    kept = scored(nodes, counts).join(longer, ["lang", "phrase"], "left").filter(
        "longest IS NULL OR words > 2 OR CAST(longest AS DECIMAL(19,0)) * 100 < CAST(a AS DECIMAL(19,0)) * " + str(int(share)))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    # First the best of each part of a language by hash, so no task ranks all of a language.
    best = [F.desc("score"), F.desc("a"), "phrase"]
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(
        "lang", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_PARTS))).orderBy(*best))).filter(F.col("rank") <= top)
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
listed AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM pieces),
placed AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM listed),
suffixes AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3 FROM placed),
counts AS (
  SELECT lang, w1 AS phrase, 1 AS words, count(*) AS f FROM suffixes GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2, 2, count(*) FROM suffixes WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) FROM suffixes WHERE w3 IS NOT NULL GROUP BY ALL),
candidates AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS p FROM counts WHERE words > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, words, a, p[1] AS lhs, array_to_string(p[2:], ' ') AS rhs, 1 AS k FROM candidates
  UNION ALL SELECT lang, phrase, words, a, p[1] || ' ' || p[2], p[3], 2 FROM candidates WHERE words = 3),
scores AS (
  SELECT c.lang, c.phrase, c.words, c.a, x.f AS l, y.f AS r, k,
    CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.lhs JOIN counts y ON y.lang = c.lang AND y.phrase = c.rhs),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS longest FROM (
    SELECT lang, a, p[1] || ' ' || p[2] AS phrase FROM candidates WHERE words = 3
    UNION ALL SELECT lang, a, p[2] || ' ' || p[3] FROM candidates WHERE words = 3) GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase
  WHERE b.words = 3 OR g.longest IS NULL OR 100 * g.longest < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE words = 1 GROUP BY lang)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
