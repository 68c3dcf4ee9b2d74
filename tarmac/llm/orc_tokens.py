"""Token ids written as ORC and read back.

Every text is encoded with a public tokenizer, an end id is appended, and the documents are
written in ascending doc_id order as ORC: integers in run-length encoding, row indexes in
every stripe, and Bloom filters on doc_id, so that readers take stripes in parallel and skip
stripes and row groups that cannot hold an id.

With the default file's rules (lower case, white space dropped, a fixed splitting pattern) white
space parts words, so a text's ids are its words' ids in turn.  Words are found in the bytes of
many texts at once; letters and the marks behind them go to the tokenizer's model by themselves,
all other words through its whole encoder, and a distinct one only once a worker.  Files with
other rules encode whole texts.

Defined results: a null or empty text has the end id alone; a null doc_id sorts first; rows
with the same doc_id keep one place each, ordered by a hash of the text, in the files and in their
starts; extra columns are ignored; an empty table writes an empty folder of the same schema.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmac.llm.inputs import arrow_schema, input_bytes, keyed_text, raw_bytes, slices, spans, table, written
from tarmac.session import shared_path

END_ID = 2
SLICE = 6 << 20  # bytes of text encoded at a time
#: Fixed rules of the default file, under which words can be encoded one by one.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
#: White space of the pattern, besides the bytes 9 to 13 and 32.
WIDE_SPACE = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
MARKS = b".,;:!?"
#: Lower-case letters up to U+00FF, which no rule changes.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
SPACE, LETTER, MARK, OTHER = range(4)

_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
_CLASS[list(MARKS)] = MARK
_WIDE_LEAD = np.isin(np.arange(256), sorted({x.encode()[0] for x in WIDE_SPACE}))
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


def _words(data: np.ndarray, offsets: np.ndarray):
    """Pieces of the words of a buffer of texts: their bytes in turn, and starts and ends.

    A word of letters (A-Z, U+00C0 to U+00FF) and marks behind them is two pieces, its letters in
    lower case; any other word is one piece as it stands.
    """
    kind, low = _CLASS[data], _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    second = data[lead + 1]
    lead, second = lead[(second != 0x97) & (second != 0xB7)], second[(second != 0x97) & (second != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    upper = lead[second < 0x9F]
    low[upper + 1] += 0x20
    # White space of two or three bytes, among the bytes that can begin it.
    begins = np.flatnonzero(_WIDE_LEAD[data])
    for c in (x.encode() for x in WIDE_SPACE if len(begins)):
        at = begins[(begins + len(c) <= len(data)) & (data[begins] == c[0])]
        for k in range(1, len(c)):
            at = at[data[at + k] == c[k]]
        for k in range(len(c)):
            kind[at + k] = SPACE
    start, end = spans(kind != SPACE, offsets)
    if len(start) == 0:
        return data[:0], start, end
    odd = np.zeros(len(data) + 1, np.int32)
    np.cumsum(kind == OTHER, out=odd[1:])
    turn = np.zeros(len(data) + 1, np.int32)  # letters behind a mark
    turn[2:] = np.cumsum((kind[1:] == LETTER) & (kind[:-1] == MARK))
    letters = np.zeros(len(data) + 1, np.int32)
    np.cumsum(kind == LETTER, out=letters[1:])
    plain = (odd[end] == odd[start]) & (turn[end] == turn[start + 1]) & (kind[start] == LETTER)
    split = np.where(plain, start + letters[end] - letters[start], end)
    # The odd words keep their bytes.
    step = np.zeros(len(data) + 1, np.int8)
    step[start[~plain]] += 1
    step[end[~plain]] -= 1
    found = np.where(np.cumsum(step[:-1], dtype=np.int8) > 0, data, low)
    both = split < end
    starts, ends = np.empty(len(start) + both.sum(), np.int64), np.empty(len(start) + both.sum(), np.int64)
    at = np.arange(len(start)) + np.concatenate([[0], np.cumsum(both)[:-1]])
    starts[at], ends[at] = start, split
    starts[at[both] + 1], ends[at[both] + 1] = split[both], end[both]
    return found[kind != SPACE], starts, ends


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts; under the known rules by a cache of pieces of words."""

    def __init__(self, path: str, cache: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = all(spec[k] == v for k, v in RULES.items()) and spec["model"]["type"] == "BPE" and not any(
            a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] or re.search(r"\s", a["content"]) or a["content"].isalpha()
            or not a["content"].strip(MARKS.decode()) for a in spec["added_tokens"])
        self.model = self.tokenizer.model
        self.most = cache
        bytewise = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: bytewise.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self._forget()

    def _forget(self) -> None:
        self.pieces: dict[bytes, int] = {}
        self.flat, self.ends = array("i"), array("q", [0])

    def _learn(self, pieces: list[bytes]) -> None:
        odd, known, flat, ends, tokenize = [], self.pieces, self.flat, self.ends, self.model.tokenize
        for p in pieces:
            # Lower-case letters; the model knows bytes by letters of its own, ASCII by itself.
            if p.isalpha() and p.islower():
                tokens = tokenize(p.decode())
            elif LETTERS.fullmatch(p):
                tokens = tokenize(p.decode().translate(self.letters))
            else:
                odd.append(p)
                continue
            known[p] = len(ends) - 1
            flat.extend([t.id for t in tokens])
            ends.append(len(flat))
        for lo in range(0, len(odd), 20_000):
            some = odd[lo:lo + 20_000]
            for p, e in zip(some, self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)):
                known[p] = len(ends) - 1
                flat.extend(e.ids)
                ends.append(len(flat))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts in turn, and how many each text has."""
        if not self.by_word:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64)
        data, offsets = raw_bytes(column)
        letters, starts, ends = _words(data, offsets)
        if len(starts) == 0:
            return np.zeros(0, np.int32), np.zeros(len(column), np.int64)
        # Without white space, pieces stand next to each other.
        bounds = np.concatenate([[0], np.cumsum(ends - starts)])
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
        distinct = packed.dictionary.to_pylist()
        if len(self.pieces) > self.most:
            self._forget()
        self._learn([p for p in distinct if p not in self.pieces])
        place = np.array([self.pieces[p] for p in distinct], np.int64)[packed.indices.to_numpy()]
        # Copies: an array that numpy looks into cannot grow.
        flat, edges = np.array(self.flat, np.int32), np.array(self.ends, np.int64)
        size = edges[place + 1] - edges[place]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(edges[place] - total[:-1], size) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(starts, offsets)])


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """One encoder a worker process: its words serve the next task too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenize(df: DataFrame, tokenizer: str | None = None, end_id: int = END_ID,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each text with the end id, in the order of the rows."""
    path = tokenizer or default_tokenizer()
    schema = arrow_schema("doc_id long, ids array<int>")

    def run(batches):
        encoder = encoder_for(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, counts = encoder.encode(part.column("text"))
                ends = np.cumsum(counts)
                whole = np.insert(ids, ends, np.int32(end_id))
                offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(whole, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), lists], schema=schema)

    return keyed_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def write_tokens(df: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text", partition_bytes: int = 16 << 20) -> None:
    """Tokenize and write as ORC in ascending doc_id order: files hold disjoint id ranges.

    Texts are dealt by id range before they are encoded, so finding the ranges samples ids of
    the scan and encodes nothing twice.
    """
    docs = keyed_text(df, id_col, text_col)
    parts = max(1, -(-input_bytes(df) // partition_bytes))
    # The hash parts rows that share an id (or lack one) into several files.
    order = ["doc_id", F.xxhash64("text")]
    ordered = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    (tokenize(ordered, tokenizer, end_id).write.option("compression", "zstd")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.create.index", "true").option("orc.row.index.stride", "1000")
     .option("orc.stripe.size", str(16 << 20)).orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of the files; filters on doc_id skip stripes and row groups."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def with_starts(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows read from the files, in the order of the files.

    Each task sums the ids of its own splits (parts of a file) row by row; the totals of splits,
    one row each, are summed in the order of files and bytes, and a row's start is both together.
    """
    ddl = "doc_id long, file string, block long, inside long, n_tokens long, ids_crc32 long"
    schema = arrow_schema(ddl)

    def run(batches):
        held = {}  # ids so far of the splits of this task
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
            n = np.diff(offsets).astype(np.int64)
            inside = np.zeros(len(n), np.int64)
            split = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
            lo = 0
            while lo < len(split):
                hi = lo + 1
                while hi < len(split) and split[hi] == split[lo]:
                    hi += 1
                before = held.get(split[lo], 0)
                sums = np.cumsum(n[lo:hi])
                inside[lo:hi] = before + sums - n[lo:hi]
                held[split[lo]] = before + int(sums[-1])
                lo = hi
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("file").cast(schema.field(1).type), batch.column("block"),
                pa.array(inside), pa.array(n), pa.array(crc, pa.int64())], schema=schema)

    rows = tokens.select("doc_id", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = written(rows.mapInArrow(run, ddl), "token-rows")
    totals = rows.groupBy("file", "block").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, ["file", "block"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = shared_path(spark, "token-files", unique=True)
    write_tokens(docs, path)
    return with_starts(read_tokens(spark, path))
