"""Near-duplicate groups of documents by DartMinHash signatures and banded joining.

Elements are shingles of five words (A-Z lower-cased; a document of 1 to 4 words has one
shingle, all its words), weighted by how often a document holds them; similarity is the
weighted Jaccard of those multisets.  DartMinHash throws hashed darts into each element's
weight region: a whole weight is a row of unit cells (shingle, occurrence), rank runs upward,
and every cell of unit weight and a short rank range holds a Poisson number of darts whose
rank and coordinate come from the cell's hash.  The earliest dart of each coordinate is the
signature.  Ranks are searched up to (k ln k + 2k) / weight, so long documents throw few darts
a shingle and all documents about the same number; the few that leave a coordinate empty
search on.

Bands of the signature are joined; texts that share a band (99.99 % of pairs at 0.8) and agree
in 174 of 250 coordinates (99.997 %) are candidates, compared exactly on whole shingle multisets.
First a few leaders of each bucket meet all its members: the member that shares most buckets,
then members of the bucket's largest group, which links most of a group of many by few pairs, and
copies make no pairs at all.  What is left are strangers, members outside the largest group of
their bucket: each is compared with all members of other groups, block by block inside tasks, and
only links come out.  A turn's links are closed over the groups so far by repeated joins; nothing
about all documents comes to the driver.

Defined results: texts with the same word sequence are one node whatever their number (a
group of copies costs one signature); documents without words (null, empty, only marks) are
each alone; a null doc_id takes part, and as representative only where no copy has an id;
rows with the same doc_id are rows of their own but named by that id; ties go to the smallest
doc_id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.inputs import (WORD_TABLE, PrefixHash, arrow_schema, dropped, giving_back, keyed_text, mix64, raw_bytes,
                               slices, spans, table, with_results, written)

#: Coordinates of a signature; the first BANDS * ROWS make the bands, all make the estimate.
COORDINATES, BANDS, ROWS = 250, 25, 5
SALTS = 16
#: Coordinates of 250 that a candidate pair agrees in: 200 are expected at 0.8, and all but
#: 0.003 % of such pairs have 174 or more, which is less than the bands lose (0.005 %).
AGREE = 174
#: Turns in which leaders meet their buckets, and leaders of a bucket in turn t (GROWTH ** t).
TURNS, GROWTH = 2, 4
#: Strangers and members of a task's blocks after that, and bytes of cells of either.
BLOCK, BLOCK_BYTES = (512, 2048), 16 << 20
#: Rank ranges thrown at a time, and bytes and rows signed at a time.
RANGES = 1 << 18
SLICE, SIGNED_ROWS = 1 << 20, 2000
_LOWER = np.frombuffer(WORD_TABLE, np.uint8)
#: Poisson(1) and Poisson(1/4) counts by inverting the cumulative probability of a uniform.
_POISSON = {w: np.cumsum([math.exp(-w) * w ** i / math.factorial(i) for i in range(16)])
            for w in (0.25, 0.5, 1.0)}


def shingles(part: pa.RecordBatch, size: int = 5):
    """Of each text: unit cells (shingle, occurrence) as (doc, hash), words, 128-bit sequence key."""
    data, offsets = raw_bytes(part.column("text"))
    data = _LOWER[data]
    n = len(offsets) - 1
    start, end = spans(data != 32, offsets)
    doc = np.searchsorted(offsets, start, side="right") - 1
    words = np.bincount(doc, minlength=n)
    hashes = PrefixHash(data, 1)
    word = hashes.of(start, end)
    first = np.concatenate([[0], np.cumsum(words)])
    # The key of a whole sequence, and shingles, from hashes of words.
    place = np.arange(len(word)) - first[doc]
    keys = []
    for seed in (3, 5):
        weighed = mix64(word + np.uint64(seed)) * (mix64(place.astype(np.uint64) + np.uint64(seed * 977)) | np.uint64(1))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(weighed)])
        keys.append(mix64(sums[first[1:]] - sums[first[:-1]] + words.astype(np.uint64)))
    mixed = np.zeros(len(word), np.uint64)
    for k in range(size):
        nxt = np.minimum(np.arange(len(word)) + k, len(word) - 1)
        inside = place + k < words[doc]
        mixed = mix64(mixed * np.uint64(0x100000001B3) + np.where(inside, word[nxt], np.uint64(k)))
    opens = (place + size <= words[doc]) | ((place == 0) & (words[doc] < size))
    h, d = mixed[opens], doc[opens]
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    begin = np.flatnonzero(new)
    occurrence = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
    return d, mix64(h + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), words, keys


def _throw(cells: np.ndarray, doc: np.ndarray, level: np.ndarray, k: int):
    """Darts of (unit cell, rank range): (doc, coordinate, packed rank and dart id)."""
    low = np.where(level == 0, 0.0, np.where(level == 1, 0.25, np.where(level == 2, 0.5, level - 2.0)))
    width = np.where(level < 2, 0.25, np.where(level == 2, 0.5, 1.0))
    seed = mix64(cells + level.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    uniform = (seed >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
    count = np.zeros(len(cells), np.int64)
    for w, cumulative in _POISSON.items():
        mine = width == w
        count[mine] = np.searchsorted(cumulative, uniform[mine])
    at = np.repeat(np.arange(len(cells)), count)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    dart = mix64(seed[at] ^ (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))
    rank = low[at] + width[at] * (dart >> np.uint64(40)).astype(np.float64) * 2.0 ** -24
    packed = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (dart & np.uint64(0xFFFFFFFF))
    return doc[at], (mix64(dart) % np.uint64(k)).astype(np.int64), packed


def signatures(doc: np.ndarray, cells: np.ndarray, n: int, k: int) -> np.ndarray:
    """The earliest dart of each of ``k`` coordinates for ``n`` documents (n x k)."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(n * k, none, np.uint64)
    weight = np.bincount(doc, minlength=n)
    reach = (k * math.log(k) + 2 * k) / np.maximum(weight, 1)
    done = np.zeros(n, np.int64)  # rank ranges searched so far
    open_ = weight > 0
    while open_.any():
        # Ranges 0, 1, 2 end at 1/4, 1/2, 1; range r >= 3 ends at r - 1.
        upto = np.where(reach <= 0.25, 1, np.where(reach <= 0.5, 2, np.where(reach <= 1, 3, np.ceil(reach) + 2))).astype(np.int64)
        upto = np.where(open_, np.maximum(upto, done), done)
        todo = (upto - done)[doc]
        # Parts of equally many rank ranges, so memory follows the darts and not the cells.
        total = np.cumsum(todo)
        cuts = np.searchsorted(total, np.arange(RANGES, int(total[-1]) + RANGES, RANGES))
        for some in np.split(np.arange(len(doc)), np.unique(cuts[:-1] + 1)):
            count = todo[some]
            at = np.repeat(some, count)
            level = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + done[doc[at]]
            d, j, packed = _throw(cells[at], doc[at], level, k)
            np.minimum.at(best, d * k + j, packed)
        done = upto
        # A found dart counts only below the searched rank, which each full range guarantees.
        open_ = open_ & (best.reshape(n, k) == none).any(axis=1)
        reach = reach * 2
    return best.reshape(n, k)


SIGNED = "doc_id long, k1 long, k2 long, n_words long, bands array<long>, darts array<tinyint>"


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n_words, bands) of each row of (doc_id, text)."""
    schema = arrow_schema(SIGNED)

    def run(batches):
        for batch in batches:
            for part in (some.slice(lo, SIGNED_ROWS) for some in slices(batch, "text", SLICE)
                         for lo in range(0, some.num_rows, SIGNED_ROWS)):
                doc, cells, words, keys = shingles(part)
                best = signatures(doc, cells, part.num_rows, COORDINATES)
                bands = np.zeros((part.num_rows, BANDS), np.uint64)
                for r in range(ROWS):
                    bands = mix64(bands * np.uint64(0x100000001B3) + best[:, r:BANDS * ROWS:ROWS])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, part.num_rows * BANDS + 1, BANDS), pa.int32()),
                    pa.array(bands.reshape(-1).view(np.int64)))
                darts = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, part.num_rows + 1) * best.shape[1], pa.int32()),
                    pa.array((mix64(best.reshape(-1)) & np.uint64(255)).astype(np.uint8).view(np.int8)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(keys[0].view(np.int64)),
                     pa.array(keys[1].view(np.int64)), pa.array(words.astype(np.int64)), lists, darts], schema=schema)

    return docs.mapInArrow(giving_back(run), SIGNED)


def _multisets(docs: DataFrame) -> DataFrame:
    """(k1, k2, cells): the sorted unit cells of each text, packed."""
    ddl = "k1 long, k2 long, cells binary"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                doc, cells, _, keys = shingles(part)
                order = np.lexsort((cells, doc))
                cells = cells[order]
                edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)),
                     pa.array([cells[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())], schema=schema)

    return docs.mapInArrow(giving_back(run), ddl)


def _alike(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether the weighted Jaccard similarity of two sorted multisets of cells is high enough."""
    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= threshold * (len(both) - shared)


def _verify(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs (a, b, a_cells, b_cells) that are similar enough."""
    ddl = "a struct<k1:long,k2:long>, b struct<k1:long,k2:long>"

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("a_cells"), batch.column("b_cells"))):
                keep[i] = _alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), threshold)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(giving_back(run), ddl)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected group of ``edges`` (a, b), written."""
    links = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .filter("a != b").distinct(), "links")
    while True:
        # Each node points its neighbours, then its smaller ones, at the smallest it sees.
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = (both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = large.filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").filter("a != b").distinct())
        new = written(small, "links")
        # Both hold distinct links: equal if equally many and none is new.
        changed = new.count() != links.count() or not new.join(links, ["a", "b"], "left_anti").isEmpty()
        dropped(links)
        links = new
        if not changed:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _strangers(members: DataFrame, texts: DataFrame, split, spread, threshold: float) -> DataFrame:
    """(a, b): links of the strangers of each bucket (members outside its largest group) to any
    other member, compared block by block inside tasks, so that only links come out.

    ``members`` is (band, value, node, part_of, strange), ``texts`` (node, bands, darts, cells).  A
    task holds a block of strangers and a block of members, bounded in rows and bytes.
    """
    weigh = members.join(texts.select("node", F.octet_length("cells").alias("bytes")), "node")
    sizes = weigh.groupBy("band", "value").agg(
        F.greatest(F.ceil(F.count_if("strange") / BLOCK[0]),
                   F.ceil(F.sum(F.when(F.col("strange"), F.col("bytes"))) / BLOCK_BYTES)).cast("int").alias("left_blocks"),
        F.greatest(F.ceil(F.count("*") / BLOCK[1]), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("right_blocks"))
    placed = split(members).join(spread(sizes.filter("left_blocks > 0")), ["band", "value", "salt"])
    block = lambda n: F.pmod(F.xxhash64("node", F.lit("block")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lefts = placed.filter("strange").select("band", "value", block("left_blocks").alias("i"), every("right_blocks").alias("j"),
                                            F.lit(True).alias("left"), "node", "part_of", "strange")
    rights = placed.select("band", "value", every("left_blocks").alias("i"), block("right_blocks").alias("j"),
                           F.lit(False).alias("left"), "node", "part_of", "strange")
    units = lefts.unionByName(rights).join(texts.select("node", "bands", "darts", "cells"), "node")
    ddl = "a struct<k1:long,k2:long>, b struct<k1:long,k2:long>"
    schema = arrow_schema(ddl)

    def run(rows: pa.Table) -> pa.Table:
        left = rows.column("left").to_numpy(zero_copy_only=False).astype(bool)
        one, other = np.flatnonzero(left), np.flatnonzero(~left)
        pair = lambda c: np.stack([c.combine_chunks().field(k).to_numpy() for k in ("k1", "k2")], axis=1)
        node, part = pair(rows.column("node")), pair(rows.column("part_of"))
        strange = rows.column("strange").to_numpy(zero_copy_only=False).astype(bool)
        wide = lambda c: rows.column(c).combine_chunks().flatten().to_numpy().reshape(len(left), -1)
        darts, bands, band = wide("darts"), wide("bands"), rows.column("band")[0].as_py()
        cells = rows.column("cells")
        kept: dict[int, np.ndarray] = {}

        def cell(i):
            if i not in kept:
                kept[i] = np.frombuffer(cells[i].as_buffer(), np.uint64)
            return kept[i]

        found = []
        for x in one if len(other) else ():
            to = other[(part[other] != part[x]).any(axis=1)]
            # Two strangers meet in both orders: the smaller key leads.
            less = (node[x, 0] < node[to, 0]) | ((node[x, 0] == node[to, 0]) & (node[x, 1] < node[to, 1]))
            to = to[~strange[to] | less]
            to = to[(darts[to] == darts[x]).sum(axis=1) >= AGREE]
            # In the first band that they share.
            to = to[np.argmax(bands[to] == bands[x], axis=1) == band] if len(to) else to
            for y in to:
                found += [(x, y)] if _alike(cell(x), cell(y), threshold) else []
        a, b = np.array([p[0] for p in found], np.int64), np.array([p[1] for p in found], np.int64)
        take = lambda at: rows.column("node").combine_chunks().take(pa.array(at)).cast(schema.field(0).type)
        return pa.table([take(a), take(b)], schema=schema)

    return units.groupBy("band", "value", "i", "j").applyInArrow(run, ddl)


def classes(df: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    docs = keyed_text(df, id_col, text_col)
    signed = written(sign(docs), "signatures")
    node = F.struct("k1", "k2").alias("node")
    texts = (signed.filter("n_words > 0").groupBy("k1", "k2")
             .agg(F.min("doc_id").alias("rep"), F.first(F.struct("bands", "darts")).alias("s"))
             .select(node, "rep", "s.bands", "s.darts"))
    texts = written(texts, "texts")
    bucket = texts.select("node", F.posexplode("bands").alias("band", "value"))
    sizes = bucket.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1")
    split = lambda x: x.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    spread = lambda x: x.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shared = written(split(bucket).join(spread(sizes), ["band", "value", "salt"]).drop("salt"), "buckets")
    # How many others a text meets over all bands: the middle of a group meets the most.
    wanted = written(shared.groupBy("node").agg(F.sum("n").alias("met")), "wanted")
    members = written(shared.select("band", "value", "node").join(wanted, "node")
                      .withColumn("part_of", F.col("node")).withColumn("strange", F.lit(True)), "buckets")
    dropped(shared)
    # Darts and cells of the texts that meet any other.
    darts = written(texts.join(wanted.select("node"), "node", "left_semi").select("node", "rep", "bands", "darts"), "darts")
    found = docs.join(darts.select("rep").distinct(), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    cells = (_multisets(found).dropDuplicates(["k1", "k2"])
             .select(node, "cells").join(wanted.select("node"), "node", "left_semi"))
    cells = written(cells, "cells")
    dropped(texts)
    groups = None
    for turn in range(TURNS + 1):
        if turn < TURNS:
            # At most ``leads`` leaders a bucket: of each part by hash the one that met the most,
            # from the bucket's largest group once there is one: they have strangers alone to meet.
            # Buckets of one group so mostly agree on a leader, and a pair is compared once.
            leaders = written(members.filter("NOT strange" if turn else "true")
                              .groupBy("band", "value", F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(GROWTH ** turn)).alias("part"))
                              .agg(F.max(F.struct("met", "node", "part_of")).alias("best"))
                              .select("band", "value", F.col("best.node").alias("leader"), F.col("best.part_of").alias("of")), "leaders")
            # Keys of pairs alone; their darts, then the cells of those that agree, come by joins that
            # the adaptive skew join splits by size.
            pairs = (split(members).join(spread(leaders), ["band", "value", "salt"]).filter("part_of != of")
                     .select("node", "leader").distinct())
            of = lambda t, key, what, name: t.select(F.col("node").alias(key), F.col(what).alias(name))
            alike = F.size(F.filter(F.zip_with("a_darts", "b_darts", lambda x, y: x == y), lambda x: x))
            pairs = (pairs.join(of(darts, "leader", "darts", "b_darts"), "leader").join(of(darts, "node", "darts", "a_darts"), "node")
                     .filter(alike >= AGREE).select("node", "leader"))
            pairs = (pairs.join(of(cells, "leader", "cells", "b_cells"), "leader").join(of(cells, "node", "cells", "a_cells"), "node")
                     .select(F.col("node").alias("a"), F.col("leader").alias("b"), "a_cells", "b_cells"))
            similar = written(_verify(pairs, threshold), "similar")
        else:
            similar = written(_strangers(members, darts.join(cells, "node"), split, spread, threshold), "similar")
        if turn == TURNS:
            members_left = members
        else:
            # Leaders have met their whole bucket and leave it; who is linked to one may link others.
            members_left = members.join(leaders.select("band", "value", F.col("leader").alias("node")), ["band", "value", "node"], "left_anti")
        if not similar.isEmpty():
            # New links join groups, so only roots of groups are closed again.
            if groups is not None:
                of_root = lambda x: groups.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
                similar_roots = similar.join(of_root("a"), "a", "left").join(of_root("b"), "b", "left").select(
                    F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
            else:
                similar_roots = similar
            moved = components(similar_roots)
            on_root = moved.select(F.col("node").alias("root"), F.col("root").alias("new_root"))
            before = groups
            if groups is not None:
                groups = groups.join(on_root, "root", "left").select("node", F.coalesce("new_root", "root").alias("root")).unionByName(moved)
            groups = written(groups if groups is not None else moved, "groups")
            if before is not None:
                dropped(before)
            members_left = (members_left.join(on_root.withColumnRenamed("root", "part_of"), "part_of", "left")
                            .withColumn("part_of", F.coalesce("new_root", "part_of")))
        if turn == TURNS:
            dropped(similar)
            break
        members_left = members_left.select("band", "value", "node", "met", "part_of")
        # Buckets whose members are of one group have no link to give.
        largest = (members_left.groupBy("band", "value", "part_of").agg(F.count("*").alias("n"))
                   .groupBy("band", "value").agg(F.max(F.struct("n", "part_of")).alias("most"), F.count("*").alias("groups"))
                   .filter("groups > 1").select("band", "value", F.col("most.part_of").alias("largest")))
        left = written(split(members_left).join(spread(largest), ["band", "value", "salt"]).select(
            "band", "value", "node", "met", "part_of", (F.col("part_of") != F.col("largest")).alias("strange")), "buckets")
        for t in (members, leaders, similar):
            dropped(t)
        members = left
    for t in (members, darts, cells, wanted):
        dropped(t)
    if groups is None:
        groups = docs.sparkSession.createDataFrame([], "node struct<k1:long,k2:long>, root struct<k1:long,k2:long>")
    rows = signed.select("doc_id", "n_words", node)
    rows = rows.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    alone = F.col("n_words") == 0
    # The row that stays: smallest id, rows without one last.
    mark = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")
    group = (rows.filter(~alone).groupBy("root")
             .agg(F.min(mark).alias("first"), F.count("*").alias("class_size"),
                  F.countDistinct("node").alias("n_texts")))
    salted = rows.filter(~alone).withColumn("salt", F.pmod(F.xxhash64("doc_id", "node"), F.lit(SALTS)).cast("int"))
    grouped = salted.join(spread(group), ["root", "salt"]).select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", "n_texts",
        (F.col("first") == mark).alias("kept"), "node")
    single = rows.filter(alone).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"),
        F.lit(1).cast("long").alias("n_texts"), F.lit(True).alias("kept"), "node")
    return grouped.unionByName(single)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = 0.8) -> DataFrame:
    """One row per row of ``df``: doc_id, class_id (its group's smallest doc_id), class_size
    (rows of the group), n_texts (different texts in it), kept (the row that stays)."""
    return classes(df, id_col, text_col, threshold).drop("node")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = 0.8) -> DataFrame:
    """The rows of ``df`` that stay: one of each group, and all without words."""
    def keys(batch):
        for part in slices(batch, text_col, SLICE):
            _, _, words, found = shingles(part.select([text_col]).rename_columns(["text"]))
            yield part, {"__n": words, "__1": found[0].view(np.int64), "__2": found[1].view(np.int64)}

    kept = (classes(df, id_col, text_col, threshold).filter("kept")
            .select(F.struct("doc_id", F.col("node.k1"), F.col("node.k2")).alias("__key")).distinct())
    rows = with_results(df, "__n long, __1 long, __2 long", keys).withColumn(
        "__key", F.struct(F.col(id_col).alias("doc_id"), F.col("__1").alias("k1"), F.col("__2").alias("k2")))
    stay = rows.join(kept, rows["__key"].eqNullSafe(kept["__key"]), "left_semi")
    worded = stay.filter("__n > 0").dropDuplicates(["__key"])
    return worded.unionByName(stay.filter("__n = 0")).drop("__n", "__1", "__2", "__key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
