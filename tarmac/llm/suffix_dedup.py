"""Removal of every byte covered by a 400-byte string that also starts elsewhere.

Suffix positions are ranked as in prefix doubling: (position, rank) pairs are regrouped by
longer and longer substrings, positions whose substring is unique drop out, and the rest go on
until the threshold length.  Two things keep this near the size of the input's repeats
instead of a row a byte and round:

* Positions are ranked in families.  Each 400-byte window is filed under its anchor, the
  place of the smallest hash among its 32-byte substrings (leftmost first): equal windows have
  equal anchors at equal distance, so only windows filed under the same 32 bytes can be equal,
  and about 185 neighbouring windows share an anchor.  Round one ranks the anchors' 32 bytes.
* A round ranks blocks of 64, then 8, then 1 of the distances from window to anchor, by the
  substring that all windows of the block share (337, 393, 400 bytes).  A block whose union of
  windows is found again is repeated as a whole; one whose shared substring is unique, or
  whose group has one union only, is settled; the others, one for each different union, go
  to the next round.

Ranks are 64-bit hashes of the substrings (128 bits where equality counts), so no order of all
suffixes has to be kept, and every step is a grouped count.  Texts that occur more than once
as a whole are searched once, with their number, and removed whole.

Defined results: a null or empty text has no bytes; a text under 400 bytes loses nothing; rows
with the same text are copies of each other whatever their ids, and get the same result; a
null doc_id keeps its row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.inputs import PrefixHash, arrow_schema, keyed_text, mix64, raw_bytes, slices, table, with_results, written

GRAM = 32
BLOCKS = (64, 8, 1)
CHUNK = 1 << 20


def _text_keys(batch):
    for part in slices(batch, "text", CHUNK):
        data, offsets = raw_bytes(part.column("text"))
        a, b = offsets[:-1], offsets[1:]
        yield part, {"k1": PrefixHash(data, 21, 21).of(a, b).view(np.int64),
                     "k2": PrefixHash(data, 22, 21).of(a, b).view(np.int64), "n": b - a}


def anchors(data: np.ndarray, offsets: np.ndarray, width: int):
    """Of all windows: (text, anchor, first and last window) by anchor, and the anchor's hash.

    Places are within the buffer.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < width or not len(offsets) > 1:
        return none, none, none, none, np.zeros(0, np.uint64)
    grams = n - GRAM + 1
    h = PrefixHash(data, 31, 21).of(np.arange(grams), np.arange(GRAM, n + 1))
    # Smallest of each run of ``reach`` places: high bits of the hash, then the leftmost place.
    reach = width - GRAM + 1
    least = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(grams, dtype=np.uint64)
    size = 1
    while size < reach:
        step = min(size, reach - size)
        least = np.minimum(least[:len(least) - step], least[step:])
        size += step
    place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(place)]
    inside = np.arange(len(place)) + width <= offsets[1:][doc]
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none, none, none, np.zeros(0, np.uint64)
    place, doc = place[at], doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return doc[first], place[first], at[first], at[last], h[place[first]]


def families(keyed: DataFrame, width: int) -> DataFrame:
    """(k1, k2, anchor, x, y, gram): windows that start x to y bytes before an anchor."""
    ddl = "k1 long, k2 long, anchor long, x int, y int, gram long"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                for data, offsets, keys in _pieces(part, width):
                    doc, place, lo, hi, gram = anchors(data, offsets, width)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[0][doc]), pa.array(keys[1][doc]), pa.array(place - offsets[doc] + keys[2][doc]),
                         pa.array((place - hi).astype(np.int32)), pa.array((place - lo).astype(np.int32)),
                         pa.array(gram.view(np.int64))], schema=schema)

    return keyed.select("k1", "k2", "text").mapInArrow(run, ddl)


def _pieces(part: pa.RecordBatch, width: int):
    """Buffers of at most 16 MB (places fit 24 bits); longer texts in pieces that overlap by
    a window, so that each window is in one piece."""
    data, offsets = raw_bytes(part.column("text"))
    k1, k2 = part.column("k1").to_numpy(), part.column("k2").to_numpy()
    if len(data) < 1 << 24:
        yield data, offsets, (k1, k2, np.zeros(len(k1), np.int64))
        return
    for i in range(part.num_rows):
        text = data[offsets[i]:offsets[i + 1]]
        for lo in range(0, max(1, len(text) - width + 1), 8 << 20):
            piece = text[lo:lo + (8 << 20) + width - 1]
            yield piece, np.array([0, len(piece)], np.int64), (k1[i:i + 1], k2[i:i + 1], np.array([lo], np.int64))


def _rank_rows(active: DataFrame, block: int, width: int) -> DataFrame:
    """Blocks of distances of active texts: group (shared substring) and union of windows."""
    ddl = "k1 long, k2 long, copies long, anchor long, x int, y int, gram long, shared long, whole long"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                data, offsets = raw_bytes(part.column("text"))
                lists = part.column("found")
                edge = lists.offsets.to_numpy()
                doc = np.repeat(np.arange(part.num_rows), np.diff(edge))
                rows = lists.values.slice(edge[0], edge[-1] - edge[0])
                anchor, x, y, gram = (rows.field(k).to_numpy() for k in range(4))
                # Cut each range of distances at multiples of the block.
                parts = y // block - x // block + 1
                at = np.repeat(np.arange(len(x)), parts)
                j = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts) + (x // block)[at]
                low, high = np.maximum(x[at], j * block), np.minimum(y[at], j * block + block - 1)
                here = (anchor + offsets[doc])[at]
                one, two = PrefixHash(data, 41, 21), PrefixHash(data, 42, 21)
                shared = one.of(here - j * block, here + width - (j * block + block - 1))
                shared = mix64(shared ^ mix64(gram[at].view(np.uint64) + j.astype(np.uint64)))
                whole = two.of(here - high, here + width - low)
                whole = mix64(whole ^ mix64((low.astype(np.uint64) << np.uint64(32)) + high.astype(np.uint64)))
                d = doc[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.column("k1").to_numpy()[d]), pa.array(part.column("k2").to_numpy()[d]),
                     pa.array(part.column("copies").to_numpy()[d]), pa.array(anchor[at].astype(np.int64)),
                     pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(gram[at]),
                     pa.array(shared.view(np.int64)), pa.array(whole.view(np.int64))], schema=schema)

    return active.select("k1", "k2", "copies", "text", "found").mapInArrow(run, ddl)


def _by_text(rows: DataFrame) -> DataFrame:
    return rows.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "x", "y", "gram")).alias("found"))


def repeated_spans(keyed: DataFrame, width: int = 400) -> DataFrame:
    """(k1, k2, gone): for each text that loses bytes the runs to remove, as (start, stop)."""
    texts = written(keyed.groupBy("k1", "k2", "n").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"))
                    .filter(F.col("n") >= width), "texts")
    # Written: the count of grams and the join read it, and both sides of the join are dealt
    # by gram alone, so the adaptive skew join can split a hot one.
    found = written(families(keyed, width), "anchors")
    place = F.struct("k1", "k2", "anchor")
    twice = written(found.groupBy("gram").agg(F.min(place).alias("a"), F.max(place).alias("b"))
                    .filter("a != b").select("gram"), "grams")
    # The families of each text once; copies of a text are dropped here.
    shared = _by_text(written(found.join(twice, "gram").distinct(), "families"))
    one = texts.join(shared, ["k1", "k2"]).select("k1", "k2", "copies", "rep", "found")
    some = keyed.select("k1", "k2", "doc_id", "text")
    active = some.join(one, (some["k1"] == one["k1"]) & (some["k2"] == one["k2"]) & some["doc_id"].eqNullSafe(one["rep"]))
    active = written(active.select(one["k1"], one["k2"], "copies", "text", "found").dropDuplicates(["k1", "k2"]), "active")
    whole_texts, gone = active.drop("found"), None
    for block in BLOCKS:
        rows = written(_rank_rows(active, block, width), "rank")
        # Each different union once, with its number and one place of it.
        unions = rows.groupBy("shared", "whole").agg(
            F.sum("copies").alias("times"), F.first(F.struct("k1", "k2", "anchor", "x", "y", "gram")).alias("at"))
        unions = written(unions, "unions")
        repeated = unions.filter("times > 1").select("shared", "whole")
        hits = (rows.filter("copies = 1").join(repeated, ["shared", "whole"])
                .select("k1", "k2", (F.col("anchor") - F.col("y")).alias("start"),
                        (F.col("anchor") - F.col("x") + width).alias("stop")))
        gone = hits if gone is None else gone.unionByName(hits)
        if block == 1:
            break
        mixed = (unions.groupBy("shared").agg(F.min("whole").alias("p"), F.max("whole").alias("q"))
                 .filter("p != q").select("shared"))
        rest = _by_text(unions.join(mixed, "shared").select("at.*"))
        active = whole_texts.join(rest, ["k1", "k2"])
    partial = gone.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))
    copies = texts.filter("copies > 1").select(
        "k1", "k2", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("stop"))).alias("gone"))
    return written(partial.unionByName(copies), "gone")


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"


def remove_repeats(df: DataFrame, width: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_bytes, n_removed, n_spans, kept_sha256, spans (removed runs of bytes)."""
    keyed = with_results(keyed_text(df, id_col, text_col), "k1 long, k2 long, n long", _text_keys)
    gone = repeated_spans(keyed, width)

    def cut(batch):
        for part in slices(batch, "text", CHUNK):
            data, offsets = raw_bytes(part.column("text"))
            out: dict = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
            for i, runs in enumerate(part.column("gone").to_pylist()):
                text = data[offsets[i]:offsets[i + 1]]
                edge = np.zeros(len(text) + 1, np.int64)
                for r in runs or ():
                    edge[r["start"]] += 1
                    edge[r["stop"]] -= 1
                inside = np.cumsum(edge)[:-1] > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[0], inside, [0]])))
                out["n_bytes"].append(len(text))
                out["n_removed"].append(int(inside.sum()))
                out["n_spans"].append(len(turn) // 2)
                out["kept_sha256"].append(hashlib.sha256(text[~inside].tobytes() if len(turn) else text.tobytes()).hexdigest())
                out["spans"].append([{"start": int(a), "stop": int(b)} for a, b in zip(turn[::2], turn[1::2])])
            yield part, out

    joined = keyed.join(gone, ["k1", "k2"], "left").select("doc_id", "text", "gone")
    return with_results(joined, RESULT, cut).drop("gone")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents")).drop("text")
    return found.withColumn("has_repeats", F.col("n_removed") > 0)
