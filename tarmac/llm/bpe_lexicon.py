"""Byte-level BPE encoding by a memory-mapped lexicon of frequent words, and decoding.

Spark counts the words (the pieces the file's own splitting pattern makes) of all texts.  The
most frequent ones, a bounded number, are merged once and compiled into a minimal acyclic
transducer: equal suffixes share their states, arcs carry numbers that add up to a word's place,
and the place holds the word's ids.  The automaton is laid out as a double array in one file in
the shared folder, which Spark hands to every executor (``addFile``); all workers of a machine
map the same file.  Words are walked through it for a whole slice of texts at once, one byte of
all words a step; a word that is not in it is merged by the ranks of the file.  What the lexicon
holds changes speed only: its ids and those of merging are equal.

The splitting pattern works on classes of code points (letter, number, white space, other); each
worker asks the file's own splitter for the class of every code point it meets.  Added tokens
found in a text become their own ids, as the library does without ``encode_special_tokens``.

Defined results: a null or empty text has no ids and decodes to an empty text; rows with equal or
null doc_id keep a row each; words of any length are merged whole; extra columns are ignored; an
empty table gives no rows.  Truncation and padding of a file are not used.  Tokenizer files that
are not byte-level BPE with this pattern, or have other stages, are refused.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.inputs import arrow_schema, keyed_text, raw_bytes, slices, table, with_results, written
from tarmac.session import shared_path

#: Bounds of the lexicon (speed only): words, and bytes of a word.
LEXICON_WORDS = 131_072
LEXICON_BYTES = 48
#: Bytes of text that a worker cuts at a time (a longer text alone).
SLICE = 2 << 20

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
NEVER = 1 << 40


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


# --- the tokenizer file ---------------------------------------------------------------------

class Bpe:
    """Ranks, pieces and splitting of a byte-level BPE file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers.pre_tokenizers import ByteLevel
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        added = spec["added_tokens"]
        if (model["type"] != "BPE" or spec["normalizer"] or split.get("type") != "ByteLevel" or not split.get("use_regex", True)
                or split.get("add_prefix_space") or model.get("dropout") or model.get("ignore_merges")
                or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
                or any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added)):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        self.splitter = ByteLevel(add_prefix_space=False, use_regex=True)
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        # Fixed by the file format: printable bytes are their own letters, the others follow 255.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        vocab = model["vocab"]
        self.pieces = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.byte_ids = [-1] * 256
        for i, p in self.pieces.items():
            if len(p) == 1:
                self.byte_ids[p[0]] = i
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.special = {a["content"].encode(): a["id"] for a in added}
        self.pieces |= {i: t for t, i in self.special.items()}
        self.special_pattern = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if added else None
        # The merges once more as sorted keys, for many pairs at a time.
        self.size = max(vocab.values()) + 1
        self.byte_table = np.array(self.byte_ids)
        keys = np.array([a * self.size + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.rank_ids = np.zeros(len(model["merges"]), np.int64)
        for r, i in self.merges.values():
            self.rank_ids[r] = i

    def learn_kinds(self, points: np.ndarray) -> None:
        """The classes of code points, by what the splitter does with them."""
        for c in points.tolist():
            self.kinds[c] = next((kind for before, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER))
                                  if len(self.splitter.pre_tokenize_str(before + chr(c))) == 1), SPACE)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of lowest rank is merged first, from the left."""
        ids = [self.byte_ids[b] for b in word]
        merges, n = self.merges, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(merges[pair][0], i, *pair) for i, pair in enumerate(zip(ids, ids[1:])) if pair in merges]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a, b][1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (ids[i], ids[k]) in merges:
                    heapq.heappush(queue, (merges[ids[i], ids[k]][0], i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (ids[h], ids[i]) in merges:
                heapq.heappush(queue, (merges[ids[h], ids[i]][0], h, ids[h], ids[i]))
        return [i for i in ids if i >= 0]

    def ranks_of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids (NEVER: the file does not merge them)."""
        key = first.astype(np.int64) * self.size + second
        at = np.minimum(np.searchsorted(self.pair_keys, key), max(0, len(self.pair_keys) - 1))
        return np.where((self.pair_keys[at] == key) & (first >= 0) & (second >= 0), self.pair_ranks[at], NEVER) \
            if len(self.pair_keys) else np.full(key.shape, NEVER)

    def merge_together(self, words: list[bytes]) -> list[np.ndarray]:
        """``merge`` of many words of at most 32 bytes, one merge of every word a step."""
        found: list = [None] * len(words)
        sizes = np.array([len(w) for w in words])
        for low, width in ((0, 8), (8, 16), (16, 32)):
            chosen = np.flatnonzero((sizes > low) & (sizes <= width))
            for lo in range(0, len(chosen), 8_000):
                some = chosen[lo:lo + 8_000]
                data = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in some), np.uint8).reshape(-1, width)
                ids = np.where(np.arange(width) < sizes[some][:, None], self.byte_table[data], -1)
                for i, row in zip(some.tolist(), self._merge_rows(ids)):
                    found[i] = row
        return [self.merge(w) if x is None else x for w, x in zip(words, found)]

    def _merge_rows(self, ids: np.ndarray) -> list[np.ndarray]:
        n, width = ids.shape
        rank = np.full((n, width), NEVER)
        rank[:, :-1] = self.ranks_of(ids[:, :-1], ids[:, 1:])
        place, out = np.arange(width), ids
        row = np.arange(n)
        while len(row):
            best = rank.argmin(1)
            lowest = rank[np.arange(len(row)), best]
            more = lowest < NEVER
            out[row[~more]] = ids[~more]
            row, ids, rank, best, lowest = row[more], ids[more], rank[more], best[more], lowest[more]
            if len(row) == 0:
                break
            # Close the gap behind the merged pair, in the ids and in the ranks of pairs.
            at, k = best[:, None], np.arange(len(row))
            source = np.minimum(place + (place > at), width - 1)
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            ids[:, -1], rank[:, -1] = -1, NEVER
            ids[k, best] = self.rank_ids[lowest]
            after = np.minimum(best + 1, width - 1)
            rank[k, best] = np.where(best + 1 < width, self.ranks_of(ids[k, best], ids[k, after]), NEVER)
            before = np.maximum(best - 1, 0)
            rank[k, before] = np.where(best > 0, self.ranks_of(ids[k, before], ids[k, best]), rank[k, before])
        return [r[:e] for r, e in zip(out, (out >= 0).sum(1).tolist())]

    def specials(self, data: np.ndarray, offsets: np.ndarray):
        """(start, end, id) of the added tokens inside the texts of a buffer."""
        if self.special_pattern is None:
            return []
        whole = data.tobytes()
        if not self.special_pattern.search(whole):
            return []
        return [(int(a) + m.start(), int(a) + m.end(), self.special[m.group()]) for a, b in zip(offsets, offsets[1:])
                for m in self.special_pattern.finditer(whole[a:b])]

    def words(self, data: np.ndarray, offsets: np.ndarray):
        """Starts of all words of a buffer of texts (a word ends where the next starts), and
        {number of a word: id} of the added tokens among them."""
        special = self.specials(data, offsets)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        n = len(points)
        if n == 0:
            return np.zeros(0, np.int64), {}
        at = np.zeros(n + 1, np.int64)
        np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=at[1:])
        kind = self.kinds[points]
        if (kind == UNKNOWN).any():
            self.learn_kinds(np.unique(points[kind == UNKNOWN]))
            kind = self.kinds[points]
        edges = np.concatenate([offsets, *[s[:2] for s in special]]).astype(np.int64)
        edge = np.zeros(n + 1, bool)
        edge[np.searchsorted(at, edges)] = True
        edge[0] = edge[n] = True
        start = edge.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        # A run of white space gives its last character away, unless the text ends there.
        last = np.flatnonzero(space & start[1:] & ~edge[1:])
        start[last] = True
        start[last[points[last] == 32] + 1] = False
        # 's 't 'm 'd 're 've 'll where a word starts with the apostrophe.
        mark = np.flatnonzero((points == 39) & start[:n])
        if len(mark):
            padded = np.concatenate([points, [0, 0]])
            one, two = padded[mark + 1], padded[mark + 2]
            inside = ~edge[np.minimum(mark + 1, n)]
            single = inside & np.isin(one, [ord(c) for c in "stmd"])
            double = inside & ~edge[np.minimum(mark + 2, n)] & (
                (np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            for chosen, size in ((mark[single], 2), (mark[double], 3)):
                start[chosen + 1] = False
                start[chosen + size] = True
        starts = at[np.flatnonzero(start[:n])]
        if not special:
            return starts, {}
        # An added token is one word, whatever the pattern would make of it.
        keep = np.ones(len(starts), bool)
        for a, b, _ in special:
            lo, hi = np.searchsorted(starts, [a, b])
            keep[lo + 1:hi] = False
        starts = starts[keep]
        return starts, {int(np.searchsorted(starts, a)): i for a, _, i in special}


_FILES: dict[str, Bpe] = {}


def bpe_of(path: str) -> Bpe:
    """One reading of the file a worker process."""
    if path not in _FILES:
        _FILES[path] = Bpe(path)
    return _FILES[path]


# --- the lexicon ----------------------------------------------------------------------------

def count_words(df: DataFrame, tokenizer: str | None = None, longest: int = LEXICON_BYTES, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(word, n): how often each word of at most ``longest`` bytes occurs in all texts."""
    path = tokenizer or default_tokenizer()
    schema = arrow_schema("word binary, n long")

    def merged(parts):
        found = pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")])
        return pa.RecordBatch.from_arrays([found.column("word").combine_chunks().cast(schema.field(0).type),
                                           found.column("n_sum").combine_chunks()], schema=schema)

    def run(batches):
        bpe, parts, held = bpe_of(path), [], 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, offsets = raw_bytes(part.column("text"))
                starts, special = bpe.words(data, offsets)
                if len(starts) == 0:
                    continue
                words = word_array(data, np.append(starts, len(data)))
                short = np.diff(np.append(starts, len(data))) <= longest
                short[list(special)] = False
                counts = words.filter(pa.array(short)).value_counts()
                parts.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
                held += len(counts)
                if held > 200_000:
                    yield merged(parts)
                    parts, held = [], 0
        if parts:
            yield merged(parts)

    found = keyed_text(df, id_col, text_col).mapInArrow(run, "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def word_array(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Neighbouring pieces of a buffer as an array of byte strings."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def minimal_automaton(words: list[bytes]):
    """The minimal acyclic automaton of sorted distinct words, states numbered from the leaves.

    Words are added in order; a state is closed when the next word leaves it, and a closed state
    with the same arcs and the same finality as an earlier one is that earlier one.  Returns
    (final, labels, targets, words below) by state, and the root.
    """
    register: dict = {}
    final, labels, targets, below = [], [], [], []

    def close(node):
        key = node[0], bytes(node[1]), tuple(node[2])
        state = register.get(key)
        if state is None:
            state = register[key] = len(final)
            final.append(key[0])
            labels.append(key[1])
            targets.append(key[2])
            below.append(key[0] + sum(below[t] for t in key[2]))
        return state

    # Open states along the last word: [final, labels, targets]; the last arc has no target yet.
    path, last = [[False, bytearray(), []]], b""
    for word in words:
        shared = len(os.path.commonprefix([last, word]))
        while len(path) > shared + 1:
            node = path.pop()
            path[-1][2].append(close(node))
        for b in word[shared:]:
            path[-1][1].append(b)
            path.append([False, bytearray(), []])
        path[-1][0], last = True, word
    while len(path) > 1:
        node = path.pop()
        path[-1][2].append(close(node))
    return final, labels, targets, below, close(path[0])


def double_array(final, labels, targets, below):
    """Arcs of all states in one array of slots: state s has the arc of byte b at base[s] + b."""
    order = sorted(range(len(labels)), key=lambda s: -len(labels[s]))
    used, base, low, top = bytearray(1 << 16), [0] * len(labels), 0, 0
    for s in order:
        arcs = labels[s]
        if not arcs:
            break
        at, tries = low, 0
        while True:
            if at + 512 > len(used):
                used.extend(bytes(len(used)))
            at = used.find(0, at)
            if at < 0:
                at = len(used)
                continue
            b = at - arcs[0]
            if b >= 0 and not any(used[b + c] for c in arcs):
                break
            at, tries = at + 1, tries + 1
        if tries > 64:
            low = max(low, at - 256)  # what is left behind is nearly full
        base[s] = b
        for c in arcs:
            used[b + c] = 1
        top = max(top, b)
    slots = top + 256
    check, to, skip = np.full(slots, -1, np.int32), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
    for s, arcs in enumerate(labels):
        before = int(final[s])
        for c, t in zip(arcs, targets[s]):
            check[base[s] + c], to[base[s] + c], skip[base[s] + c] = s, t, before
            before += below[t]
    return np.array(base, np.int32), check, to, skip


class Lexicon:
    """A transducer from words to ids, in one block of memory (a mapped file)."""

    def __init__(self, block):
        head = np.frombuffer(block, np.int64, 6)
        at, parts = 48, []
        for size in (head[0], head[1], head[1], head[1], head[0], head[2], head[3]):
            parts.append(np.frombuffer(block, np.int32, int(size), at))
            at += 4 * int(size)
        self.base, self.check, self.to, self.skip, self.final, self.offsets, self.ids = parts
        self.root = int(head[4])

    @staticmethod
    def compiled(entries: list[tuple[bytes, list[int]]]) -> bytes:
        """The block of sorted distinct words and their ids."""
        final, labels, targets, below, root = minimal_automaton([w for w, _ in entries])
        base, check, to, skip = double_array(final, labels, targets, below)
        offsets = np.cumsum([0] + [len(i) for _, i in entries]).astype(np.int32)
        ids = np.array([i for _, x in entries for i in x], np.int32)
        head = np.array([len(base), len(check), len(offsets), len(ids), root, 0], np.int64)
        return b"".join(x.tobytes() for x in (head, base, check, to, skip, np.array(final, np.int32), offsets, ids))

    def places(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The places of the pieces of a buffer, -1 where a piece is no word of the lexicon."""
        found = np.full(len(bounds) - 1, -1, np.int32)
        word, at, end = np.arange(len(found)), bounds[:-1], bounds[1:]
        state, place = np.full(len(found), self.root, np.int32), np.zeros(len(found), np.int32)
        while len(word):
            slot = self.base[state] + data[at]
            on = np.flatnonzero(self.check[slot] == state)
            slot, word, at, end = slot[on], word[on], at[on] + 1, end[on]
            state, place = self.to[slot], place[on] + self.skip[slot]
            done = at == end
            ends = done & (self.final[state] == 1)
            found[word[ends]] = place[ends]
            on = np.flatnonzero(~done)
            word, at, end, state, place = word[on], at[on], end[on], state[on], place[on]
        return found


def publish(spark: SparkSession, block: bytes) -> str:
    """Write the block to the shared folder and have Spark hand it to all executors."""
    path = shared_path(spark, "lexicon", unique=True) + ".lexicon"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        for lo in range(0, len(block), 1 << 20):
            out.write(bytearray(block[lo:lo + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


_LEXICONS: dict[str, Lexicon] = {}


def mapped(name: str) -> Lexicon:
    """The lexicon file that Spark brought to this machine, mapped once a worker process."""
    if name not in _LEXICONS:
        with open(SparkFiles.get(name), "rb") as f:
            _LEXICONS[name] = Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    return _LEXICONS[name]


def build_lexicon(df: DataFrame, tokenizer: str | None = None, words: int = LEXICON_WORDS, longest: int = LEXICON_BYTES,
                  id_col: str = "doc_id", text_col: str = "text") -> str:
    """Compile the most frequent words of the texts, ``words`` at most; the name of the published file.

    Words are taken by classes of their counts (a sixteenth of a power of two wide), from the
    most frequent on, as long as a whole class fits: no task and not the driver sorts them all.
    At most ``words`` times ``longest`` bytes reach the driver, whatever the input's size.
    """
    path = tokenizer or default_tokenizer()
    level = F.floor(F.log2("n") * 16).cast("int")
    counted = written(count_words(df, path, longest, id_col, text_col).select("word", level.alias("level")), "lexicon-words")
    held, least = 0, None
    for r in counted.groupBy("level").agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():  # about a thousand classes
        held += r["words"]
        if held > words:
            break
        least = r["level"]
    rows = counted.filter(F.col("level") >= F.lit(least)).select("word").toArrow()
    bpe = bpe_of(path)
    entries = [(w, bpe.merge(w)) for w in sorted(rows.column("word").to_pylist())]
    return publish(df.sparkSession, Lexicon.compiled(entries))


# --- encoding and decoding ------------------------------------------------------------------

def encode_texts(bpe: Bpe, lexicon: Lexicon, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts of a buffer in turn, and where each text's ids end."""
    starts, special = bpe.words(data, offsets)
    bounds = np.append(starts, len(data))
    place = lexicon.places(data, bounds)
    place[list(special)] = -1
    missing = np.flatnonzero(place < 0)
    flat, ends = lexicon.ids, lexicon.offsets
    if len(missing):
        rest = word_array(data, bounds).take(pa.array(missing)).dictionary_encode()
        code = rest.indices.to_numpy().astype(np.int64)
        lists = bpe.merge_together(rest.dictionary.to_pylist())
        if special:
            number = {int(w): k for k, w in enumerate(missing)}
            for w, i in special.items():
                code[number[w]] = len(lists)
                lists.append([i])
        flat = np.concatenate([flat, np.concatenate(lists).astype(np.int32)])
        ends = np.concatenate([ends, ends[-1] + np.cumsum([len(x) for x in lists])])
        place = place.astype(np.int64)
        place[missing] = len(lexicon.offsets) - 1 + code
    size = (ends[place + 1] - ends[place]).astype(np.int64)
    total = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=total[1:])
    ids = flat[np.repeat(ends[place] - total[:-1], size) + np.arange(total[-1])]
    return ids, total[np.searchsorted(starts, offsets[1:])]


def texts_of(pieces: dict, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """The texts of lists of ids that stand one after the other; unknown ids give nothing."""
    found = [pieces.get(i, b"") for i in ids.tolist()]
    return [b"".join(found[a:b]).decode("utf-8", "replace") for a, b in zip([0, *ends], ends)]


def encode(df: DataFrame, lexicon: str, tokenizer: str | None = None, id_col: str = "doc_id",
           text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of every text; ``lexicon`` is the name that ``build_lexicon`` gave.

    With ``decoded`` also the text that the ids decode to, in the same pass (one Python worker a
    core instead of two).
    """
    path = tokenizer or default_tokenizer()
    ddl = "doc_id long, ids array<int>" + (", text string" if decoded else "")
    schema = arrow_schema(ddl)

    def run(batches):
        bpe, words = bpe_of(path), mapped(lexicon)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, ends = encode_texts(bpe, words, *raw_bytes(part.column("text")))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32()))
                columns = [part.column("doc_id").cast(pa.int64()), lists]
                if decoded:
                    columns.append(pa.array(texts_of(bpe.pieces, ids, ends.tolist()), schema.field(2).type))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return keyed_text(df, id_col, text_col).mapInArrow(run, ddl)


def decode(df: DataFrame, tokenizer: str | None = None, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``df`` with the text of its ids (null: empty; ids that the file lacks give nothing)."""
    path = tokenizer or default_tokenizer()

    def make(batch):
        pieces = bpe_of(path).pieces
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            lists = pc.fill_null(part.column(ids_col), pa.scalar([], part.column(ids_col).type))
            ends = np.cumsum(pc.list_value_length(lists).to_numpy())
            yield part, {text_col: texts_of(pieces, lists.flatten().to_numpy(), ends.tolist())}

    return with_results(df, f"{text_col} string", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encode(docs, build_lexicon(docs), decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))
