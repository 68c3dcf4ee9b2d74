"""Language-model score by context-tree weighting over binary-decomposed bytes.

A text, A-Z lower-cased, is its UTF-8 bytes and an end mark (byte 255, which no UTF-8 text
holds).  Each byte is eight binary decisions, and each of their 255 nodes has a context tree
over the bytes before.  Every context holds a Krichevsky-Trofimov estimate of its decisions in
the training texts; the weighted probability of a context is half its own estimate and half
the product of those of the contexts one byte longer, so all depths mix.  Estimates depend on
counts alone, so training is counting over all training texts.

The tree holds every context of up to ``DEPTH`` bytes that the training texts hold, so it grows
with them and is never in one place.  A context and the byte behind it are one number of 64 bits
with the nearest byte first.  Different numbers are counted by task and dealt to shards by their
three nearest bytes: all longer contexts of those bytes are in one shard, which weighs them and
passes on counts and weights of the three bytes.  Contexts of two bytes and fewer (at most 65,793,
whatever the texts) are weighed on the driver and sent to the tasks.  To score, each block of
texts asks the shards for its different numbers and gets their probabilities.  A context that
training never saw, or a decision never made in it, takes the mixture of the longest one that was.

The base is a unigram model of words: log10((c + 1) / (N + V + 1)) summed over the words of a
text and its end.  Words are dealt by hash to buckets, each task sending a bucket its distinct
words once with their counts and the documents they occur in; the bucket adds up counts and
answers with sums by document.  Nothing about all words meets in one place.

Defined results: null and empty texts have one token, the end; a null doc_id is in training
(its remainder is unknown) and keeps its own row; rows with the same doc_id and text are one
text in the result, and each counts in training; with no training text every decision is one
half; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.inputs import (PrefixHash, arrow_schema, dropped, give_back, giving_back, input_bytes, keyed_text, mix64,
                               raw_bytes, slices, spans, table, with_results, written)

END = 255
CHUNK = 1 << 20
#: Places that are walked together.
BLOCK = 1 << 15
#: Longest contexts in bytes (3 to 7): with the byte behind, eight bytes at most.
DEPTH = 6
#: Nearest bytes that decide a context's shard.
NEAR = 3
#: Bytes of texts that ask the shards together.
ASKED = 8 << 20
#: A byte that no UTF-8 text holds: contexts with it are never seen.
NEVER = 254

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Words: runs of anything but blank, tab and line ends.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def whole_bytes(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts, each after ``depth`` end marks and with one behind; places of its
    own bytes and its end mark."""
    out, mine, ends = _padded(data, offsets, depth)
    return out, np.flatnonzero(mine)


def _padded(data: np.ndarray, offsets: np.ndarray, depth: int):
    """The texts as in ``whole_bytes``, which places are their own, and where each ends."""
    n = len(offsets) - 1
    ends = offsets[1:] + (depth + 1) * np.arange(1, n + 1) - 1
    starts = ends - np.diff(offsets) - depth
    mine = np.ones(len(data) + n * (depth + 1), bool)
    for k in range(depth):
        mine[starts + k] = False
    mine[ends] = False
    out = np.full(len(mine), END, np.uint8)
    out[mine] = _LOWER[data]
    mine[ends] = True
    return out, mine, ends


class Tree:
    """Contexts by the bytes before, nearest first; node 0 knows nothing.  For models that fit in
    one place: ``Model.tree``."""

    def __init__(self):
        self.next = np.zeros((1, 256), np.uint32)
        self.parent, self.depth = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.byte = np.zeros(1, np.int64)

    @property
    def levels(self) -> int:
        return int(self.depth.max())

    def grow(self, node: np.ndarray, byte: np.ndarray) -> None:
        """Add the contexts (node, one byte further back)."""
        first = len(self.next)
        self.next = np.concatenate([self.next, np.zeros((len(node), 256), np.uint32)])
        self.next[node, byte] = np.arange(first, first + len(node))
        self.parent, self.byte = np.concatenate([self.parent, node]), np.concatenate([self.byte, byte])
        self.depth = np.concatenate([self.depth, np.full(len(node), self.depth.max() + 1)])

    def deepest(self, whole: np.ndarray, at: np.ndarray, only_full: bool = False):
        """The deepest context of each place; with ``only_full`` 0 where it ends early."""
        flat, found = self.next.reshape(-1), np.zeros(len(at), np.int64)
        # The two nearest bytes are looked up at once; nodes are numbered level by level.
        one = self.next[0]
        two = np.where((one[:, None] > 0) & (self.next[one] > 0), self.next[one], one[:, None]).reshape(-1)
        second = int(np.count_nonzero(self.depth <= 1))
        for lo in range(0, len(at), BLOCK):  # small parts stay in the processor's cache
            here, node = at[lo:lo + BLOCK], found[lo:lo + BLOCK]
            if self.levels < 2:
                node[:] = one[whole[here - 1]]
                continue
            now = two.take((whole.take(here - 1).astype(np.int64) << 8) + whole.take(here - 2)).astype(np.int64)
            live = np.flatnonzero(now >= second)
            if not only_full:
                node[:] = now
            here, now = here.take(live), now.take(live)
            for d in range(3, self.levels + 1):
                step = flat.take((now << 8) + whole.take(here - d))
                on = np.flatnonzero(step)
                live, here, now = live.take(on), here.take(on), step.take(on).astype(np.int64)
                if not only_full:
                    node[live] = now
            if only_full:
                node[live] = now
        return found


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma by Stirling's series after shifting the argument to 8 or more."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        if not low.any():
            break
        shift = np.where(low, shift + np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    inv = 1.0 / y
    inv2 = inv * inv
    series = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 * (1 / 1680 - inv2 / 1188))))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


#: Log gamma of n + 1/2 and of n + 1 for the counts that most contexts have.
_FEW = 1 << 12
_HALF, _WHOLE = _lgamma(np.arange(_FEW) + 0.5), _lgamma(np.arange(_FEW) + 1.0)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log Krichevsky-Trofimov probability of a sequence with these counts."""
    both = zeros + ones
    few = np.minimum(both, _FEW - 1).astype(np.int64)
    out = (_HALF[np.minimum(zeros, few).astype(np.int64)] + _HALF[np.minimum(ones, few).astype(np.int64)]
           - _WHOLE[few] - math.log(math.pi))
    i = np.flatnonzero(both >= _FEW)
    z, o = zeros[i].astype(np.float64), ones[i].astype(np.float64)
    out[i] = _lgamma(z + 0.5) + _lgamma(o + 0.5) - _lgamma(z + o + 1.0) - math.log(math.pi)
    return out


def _half_and_half(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of contexts with longer ones, and the share that their own estimate keeps."""
    estimate = _log_kt(zeros, ones)
    weighted = np.logaddexp(estimate, below) - math.log(2.0)
    return weighted, np.exp(estimate - math.log(2.0) - weighted)


def weigh(parent: np.ndarray, depth: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """P(1) in the deepest part of every context, for one of the 255 decisions.

    ``zeros`` and ``ones`` count decisions by deepest context: those of a context with deeper
    ones are its rest, a leaf of its own beside them.
    """
    own0, own1 = zeros.copy(), ones.copy()
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)]
    for i in reversed(levels[1:]):
        np.add.at(own0, parent[i], own0[i])
        np.add.at(own1, parent[i], own1[i])
    inner = np.zeros(len(parent), bool)
    inner[parent[1:]] = True
    below = _log_kt(zeros, ones)
    weighted, stay = _log_kt(own0, own1), np.ones(len(parent))
    for d in range(len(levels) - 1, -1, -1):
        i = levels[d][inner[levels[d]]]
        weighted[i], stay[i] = _half_and_half(own0[i], own1[i], below[i])
        if d:
            np.add.at(below, parent[levels[d]], weighted[levels[d]])
    own = (own1 + 0.5) / (own0 + own1 + 1.0)
    rest = (ones + 0.5) / (zeros + ones + 1.0)
    mixed, left = np.zeros(len(parent)), np.ones(len(parent))
    for d, i in enumerate(levels):
        before, share = (mixed[parent[i]], left[parent[i]]) if d else (0.0, 1.0)
        mixed[i] = before + share * stay[i] * own[i]
        left[i] = share * (1 - stay[i])
    return mixed + left * rest


# --- contexts as numbers ------------------------------------------------------------------

def numbers(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte of the texts and each end: the bytes before, nearest first, and itself last."""
    whole, mine, _ = _padded(data, offsets, 7)
    if not len(whole):
        return np.zeros(0, np.uint64)
    # Eight bytes up to each place, as they lie in memory: its own byte is the highest.
    windows = np.ndarray((len(whole) - 7,), "<u8", whole, strides=(1,))[mine[7:]]
    return ((windows << np.uint64(8)) & _CONTEXT) | (windows >> np.uint64(56))


_CONTEXT = np.uint64(((1 << 8 * DEPTH) - 1) << (64 - 8 * DEPTH))


def _each_once(some: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers in order, and how often each stands there."""
    if times is None:
        some = np.sort(some)
    else:
        order = np.argsort(some, kind="stable")
        some, times = some[order], times[order]
    if not len(some):
        return some, np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
    if times is None:
        return some[first], np.diff(np.append(first, len(some)))
    return some[first], np.add.reduceat(times.astype(np.int64), first)


def _dealt(some: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of numbers by shard, and where each shard begins."""
    near = some >> np.uint64(64 - 8 * NEAR)
    shard = ((mix64(near) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
    return np.argsort(shard, kind="stable"), np.searchsorted(np.sort(shard), np.arange(shards + 1))


def _planes(x: np.ndarray) -> bytes:
    """Numbers with their equal places together, which packs well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _steps_up(some: np.ndarray) -> bytes:
    """Ascending numbers as differences."""
    return _planes(np.diff(some, prepend=np.uint64(0)))


def _summed(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(raw, np.uint64), dtype=np.uint64)


class Branches:
    """The contexts of ``NEAR`` to ``DEPTH`` bytes of one shard, with the bytes behind them.

    Numbers that are only asked for count nothing.  For each length: the different (context, byte)
    in order, their counts, and which of the next shorter ones each belongs to.
    """

    def __init__(self, some: np.ndarray, counts: np.ndarray):
        byte = some & np.uint64(255)
        self.codes, self.counts, self.shorter = {}, {}, {}
        code = some
        for depth in range(DEPTH, NEAR - 1, -1):
            self.codes[depth], self.counts[depth] = code, counts
            if depth > NEAR:
                # One byte less before, the byte behind stays last.
                keep = np.uint64(((1 << 8 * (depth - 1)) - 1) << (64 - 8 * (depth - 1)))
                code, up = np.unique((code & keep) | (code & np.uint64(255)), return_inverse=True)
                counts = np.bincount(up, weights=counts, minlength=len(code)).astype(np.int64)
                self.shorter[depth] = up
        self.byte = byte

    def _bit(self, k: int) -> dict:
        """By length: which decision of its context each (context, byte) meets at bit ``k``, where each
        decision stands first, and its zeros and ones."""
        found = {}
        for depth, code in self.codes.items():
            part = (code & ~np.uint64(255)) | ((code & np.uint64(255)) >> np.uint64(8 - k))
            new = np.append(True, part[1:] != part[:-1])
            one = (code >> np.uint64(7 - k)) & np.uint64(1) == 1
            first = np.flatnonzero(new)
            both = np.add.reduceat(self.counts[depth], first)
            ones = np.add.reduceat(np.where(one, self.counts[depth], 0), first)
            found[depth] = (np.cumsum(new) - 1, first, both - ones, ones, one)
        return found

    def _up(self, found: dict) -> tuple[dict, dict]:
        """Log weighted probabilities and own shares of all decisions, from the longest contexts."""
        weighted, stay = {}, {}
        for depth in range(DEPTH, NEAR - 1, -1):
            which, first, zeros, ones, _ = found[depth]
            if depth == DEPTH:
                weighted[depth] = _log_kt(zeros, ones)
            else:
                up = which[self.shorter[depth + 1][found[depth + 1][1]]]
                below = np.bincount(up, weights=weighted[depth + 1], minlength=len(first))
                weighted[depth], stay[depth] = _half_and_half(zeros, ones, below)
        return weighted, stay

    def roots(self):
        """(two bytes, decision) of the shortest contexts here, with zeros, ones and log weights."""
        code = self.codes[NEAR]
        if not len(code):
            return
        for k in range(8):
            found = self._bit(k)
            weighted, _ = self._up(found)
            _, first, zeros, ones, _ = found[NEAR]
            yield _decisions(code[first], k), zeros, ones, weighted[NEAR]

    def log10(self, top: Top) -> np.ndarray:
        """log10 probabilities of all numbers of this shard."""
        out = np.zeros(len(self.codes[DEPTH]))
        for k in range(8 if len(out) else 0):
            found = self._bit(k)
            _, stay = self._up(found)
            for depth in range(NEAR, DEPTH + 1):
                which, first, zeros, ones, one = found[depth]
                if depth == NEAR:
                    mixed, left, value = top.at(_decisions(self.codes[depth][first], k))
                else:
                    up = found[depth - 1][0][self.shorter[depth][first]]
                    mixed, left, value = mixed[up], left[up], value[up]
                own, seen = (ones + 0.5) / (zeros + ones + 1.0), zeros + ones > 0
                value = np.where(seen, mixed + left * own, value)
                if depth < DEPTH:
                    mixed, left = mixed + left * stay[depth] * own, left * (1 - stay[depth])
            out += np.log10(np.where(one, value[which], 1.0 - value[which]))
        return out


def _decisions(some: np.ndarray, k: int) -> np.ndarray:
    """The two nearest bytes and, after them, a 1 and the first ``k`` bits of the byte behind."""
    decision = ((some & np.uint64(255)) | np.uint64(256)) >> np.uint64(8 - k)
    return ((some >> np.uint64(48) << np.uint64(8)) | decision).astype(np.int64)


class Top:
    """The mixtures of contexts of two bytes and fewer, by decision; sent to all tasks."""

    def __init__(self, decisions: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        """From the counts of each (two bytes, decision) in order, and the log weights of its contexts of three."""
        codes, counts, up, stay = [decisions], [(zeros, ones)], [], []
        for drop in (255, 65_535):   # the second byte, then the first too
            keep = ~np.int64(drop << 8)
            weighted, share = _half_and_half(*counts[-1], below)
            code, which = np.unique(codes[-1] & keep, return_inverse=True)
            total = lambda x: np.bincount(which, weights=x, minlength=len(code))  # noqa: B023, E731
            codes.append(code)
            counts.append((total(counts[-1][0]), total(counts[-1][1])))
            up.append(which)
            stay.append(share)
            below = total(weighted)
        stay.append(_half_and_half(*counts[-1], below)[1])
        self.codes, self.mixed, self.left, self.value = codes, [None] * 3, [None] * 3, [None] * 3
        mixed, left = np.zeros(len(codes[2])), np.ones(len(codes[2]))
        for level in (2, 1, 0):
            if level < 2:
                mixed, left = self.mixed[level + 1][up[level]], self.left[level + 1][up[level]]
            zeros, ones = counts[level]
            own = (ones + 0.5) / (zeros + ones + 1.0)
            self.value[level] = mixed + left * own
            self.mixed[level], self.left[level] = mixed + left * stay[level] * own, left * (1 - stay[level])

    def at(self, decisions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is mixed and left for contexts of three bytes, and the mixture if those were never seen."""
        n = len(decisions)
        mixed, left, value = np.zeros(n), np.ones(n), np.full(n, 0.5)
        for level, drop in ((2, 65_535), (1, 255), (0, 0)):
            code = decisions & ~np.int64(drop << 8)
            have = self.codes[level]
            place = np.minimum(np.searchsorted(have, code), max(len(have) - 1, 0))
            known = have[place] == code if len(have) else np.zeros(n, bool)
            i = place[known]
            mixed[known], left[known], value[known] = self.mixed[level][i], self.left[level][i], self.value[level][i]
        return mixed, left, value


# --- training -----------------------------------------------------------------------------

PACKED = "block long, keys binary, lengths binary, learns binary, text binary"
SOME = "shard int, some binary, times binary"
ASKS = "shard int, block long, some binary"
GIVES = "block long, shard int, logs binary"
SHARD = "kind int, shard int, some binary, times binary, decisions binary, weights binary"


def packed(docs: DataFrame) -> DataFrame:
    """Texts by blocks of about ``ASKED`` bytes, compressed, each with the keys of its documents."""
    schema = arrow_schema(PACKED)

    def run(batches):
        place = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", ASKED):
                data, offsets = raw_bytes(part.column("text"))
                learns = ~np.asarray(part.column("held_out").to_numpy(zero_copy_only=False), bool)
                # Hashes take 32 bytes a byte of text: by smaller parts.
                keys = b"".join(_keys(x, *raw_bytes(x.column("text"))).tobytes() for x in slices(part, "text", CHUNK))
                row = (keys, np.diff(offsets).tobytes(), learns.tobytes(), pa.compress(data.tobytes(), "zstd", asbytes=True))
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), *[pa.array([x], pa.binary()) for x in row]],
                                                 schema=schema)
                place += 1

    return docs.mapInArrow(giving_back(run), PACKED)


def _texts(table, i: int):
    """Bytes, offsets, keys and learning marks of one block."""
    get = lambda name: table.column(name)[i].as_py()
    offsets = np.append(0, np.cumsum(np.frombuffer(get("lengths"), np.int64)))
    data = pa.decompress(get("text"), int(offsets[-1]), "zstd", asbytes=True) if offsets[-1] else b""
    return (np.frombuffer(data, np.uint8), offsets, np.frombuffer(get("keys"), np.int64),
            np.frombuffer(get("learns"), bool))


def _chunks(data: np.ndarray, offsets: np.ndarray):
    """First and last documents, and the numbers, of parts of about ``CHUNK`` bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, side="right")) - 1))
        yield lo, hi, numbers(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


class Model:
    """Counts of all contexts by shard (a table) and the mixtures of the shortest."""

    #: log10 probabilities are kept in steps of 1 / 2000.
    STEPS = 2000.0

    def __init__(self, kept: DataFrame, top: Top, shards: int):
        self.kept, self.top, self.shards = kept, top, shards
        self.counts = kept.filter("kind = 0").select("shard", "some", "times")
        self._gathered = None

    def answers(self, asked: DataFrame) -> DataFrame:
        """(block, shard, logs) for (shard, block, some): log10 probabilities in the order asked."""
        schema, steps = arrow_schema(GIVES), self.STEPS
        sent = asked.sparkSession.sparkContext.broadcast(self.top)

        def answer(asks: pa.Table, known: pa.Table) -> pa.Table:
            lists = [_summed(x) for x in asks.column("some").to_pylist()]
            some, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if known.num_rows:
                some, times = _summed(known.column("some")[0].as_py()), _unplanes(known.column("times")[0].as_py(), np.int64)
            wanted = _each_once(np.concatenate([np.zeros(0, np.uint64), *lists]))[0]
            some, times = _each_once(np.concatenate([some, wanted]), np.concatenate([times, np.zeros(len(wanted), np.int64)]))
            found = np.minimum(np.rint(-steps * Branches(some, times).log10(sent.value)), 65_535).astype(np.uint16)
            logs = [_planes(found[np.searchsorted(some, x)]) for x in lists]
            return pa.Table.from_arrays([asks.column("block"), asks.column("shard"), pa.array(logs, pa.binary())], schema=schema)

        return asked.groupBy("shard").cogroup(self.counts.groupBy("shard")).applyInArrow(answer, GIVES)

    def scores(self, blocks: DataFrame) -> DataFrame:
        """(k, score) of the documents of ``packed`` blocks."""
        shards, steps, asks, ddl = self.shards, self.STEPS, arrow_schema(ASKS), "k long, score double"
        schema = arrow_schema(ddl)

        def ask(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    data, offsets, _, _ = _texts(batch, i)
                    parts = [_each_once(x)[0] for _, _, x in _chunks(data, offsets)]
                    some = _each_once(np.concatenate([np.zeros(0, np.uint64), *parts]))[0]
                    order, edge = _dealt(some, shards)
                    rows = [b for b in range(shards) if edge[b] < edge[b + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows, pa.int32()), pa.array([batch.column("block")[i].as_py()] * len(rows), pa.int64()),
                         pa.array([_steps_up(some[order[edge[b]:edge[b + 1]]]) for b in rows], pa.binary())], schema=asks)

        def score(texts: pa.Table, given: pa.Table) -> pa.Table:
            found = []
            for i in range(texts.num_rows):
                data, offsets, keys, _ = _texts(texts, i)
                parts, lists = [], []
                for lo, hi, some in _chunks(data, offsets):
                    order = np.argsort(some)
                    some = some[order]
                    new = np.append(True, some[1:] != some[:-1])
                    which = np.empty(len(some), np.int32)
                    which[order] = np.cumsum(new) - 1
                    parts.append((lo, hi, which))
                    lists.append(some[new])
                all_ = _each_once(np.concatenate([np.zeros(0, np.uint64), *lists]))[0]
                order, _ = _dealt(all_, shards)
                by_shard = np.argsort(given.column("shard").to_numpy())
                logs = given.column("logs").to_pylist()
                value = np.empty(len(all_))
                value[order] = np.concatenate([np.zeros(0, np.uint16), *[_unplanes(logs[b], np.uint16) for b in by_shard]]) / -steps
                total = np.zeros(len(keys))
                for (lo, hi, which), some in zip(parts, lists):
                    each = value[np.searchsorted(all_, some)][which]
                    begin = offsets[lo:hi] - offsets[lo] + np.arange(hi - lo)
                    total[lo:hi] = np.add.reduceat(each, begin)
                found.append((keys, total))
            join = lambda at, kind: np.concatenate([np.zeros(0, kind), *[f[at] for f in found]])
            give_back()
            return pa.Table.from_arrays([pa.array(join(0, np.int64)), pa.array(join(1, np.float64))], schema=schema)

        answers = self.answers(blocks.mapInArrow(giving_back(ask), ASKS))
        return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, ddl)

    # All of a model that fits in one place: to look at, and to compare with.

    def _gather(self) -> tuple[Tree, np.ndarray]:
        if self._gathered is None:
            spark = self.counts.sparkSession
            some = [_summed(r["some"]) for r in self.counts.select("some").collect()]
            some = np.sort(np.concatenate([np.zeros(0, np.uint64), *some]))
            tree, wanted, last = Tree(), [(0, 0)], {0: 0}   # node by the bits of its context
            for depth in range(1, DEPTH + 1):
                shift = np.uint64(64 - 8 * depth)
                now = np.unique(some >> shift)
                parents = np.array([last[int(c) >> 8] for c in now], np.int64)
                first = len(tree.next)
                if len(now):
                    tree.grow(parents, (now & np.uint64(255)).astype(np.int64))
                last = {int(c): first + i for i, c in enumerate(now)}
                wanted += [(int(c), depth) for c in now]
            never = sum(NEVER << 8 * k for k in range(8))
            asks = np.array([(c << (64 - 8 * d) | (never & ((1 << (64 - 8 * d)) - 1))) & int(_CONTEXT) for c, d in wanted], np.uint64)
            asks = (asks[:, None] + np.arange(256, dtype=np.uint64)).reshape(-1)
            names, back = np.unique(asks, return_inverse=True)
            order, edge = _dealt(names, self.shards)
            rows = [(b, 0, _steps_up(names[order[edge[b]:edge[b + 1]]])) for b in range(self.shards) if edge[b] < edge[b + 1]]
            got = sorted((r["shard"], r["logs"]) for r in self.answers(spark.createDataFrame(rows, ASKS)).collect())
            steps = np.empty(len(names), np.uint16)
            steps[order] = np.concatenate([_unplanes(x, np.uint16) for _, x in got])
            self._gathered = tree, steps[back].reshape(-1, 256)
        return self._gathered

    @property
    def tree(self) -> Tree:
        return self._gather()[0]

    @property
    def steps(self) -> np.ndarray:
        """-log10 P(byte | context) in steps, a row a context of ``tree``."""
        return self._gather()[1]

    def log10(self, whole: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probabilities of the bytes at some places."""
        return self.steps.reshape(-1)[self.tree.deepest(whole, at) * 256 + whole[at]] / -self.STEPS


def train(training: DataFrame, bucket_bytes: int = 12 << 20) -> Model:
    """Count and weigh every context of all training texts."""
    docs = training if "held_out" in training.columns else training.withColumn("held_out", F.lit(False))
    blocks = written(packed(docs), "texts")
    model = fitted(blocks, max(6, input_bytes(training) // bucket_bytes))
    dropped(blocks)
    return model


def fitted(blocks: DataFrame, shards: int) -> Model:
    """The model of the texts of ``packed`` blocks that are not held out."""
    counted, whole = arrow_schema(SOME), arrow_schema(SHARD)

    def count(batches):
        held: list = []

        def dealt():
            some, times = _each_once(np.concatenate([x for x, _ in held]), np.concatenate([n for _, n in held]))
            held.clear()
            order, edge = _dealt(some, shards)
            rows = [b for b in range(shards) if edge[b] < edge[b + 1]]
            cuts = [order[edge[b]:edge[b + 1]] for b in rows]
            return pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()), pa.array([_steps_up(some[c]) for c in cuts], pa.binary()),
                 pa.array([_planes(times[c].astype(np.uint32)) for c in cuts], pa.binary())], schema=counted)

        for batch in batches:
            for i in range(batch.num_rows):
                data, offsets, _, learns = _texts(batch, i)
                for lo, hi, some in _chunks(data, offsets):
                    held.append(_each_once(some[np.repeat(learns[lo:hi], np.diff(offsets[lo:hi + 1]) + 1)]))
                    if sum(len(x) for x, _ in held) > 4 << 20:
                        held[:] = [_each_once(np.concatenate([x for x, _ in held]), np.concatenate([n for _, n in held]))]
                        if len(held[0][0]) > 2 << 20:
                            yield dealt()
        if held:
            yield dealt()

    def merge(group: pa.Table) -> pa.Table:
        some = np.concatenate([_summed(x) for x in group.column("some").to_pylist()])
        times = np.concatenate([_unplanes(x, np.uint32) for x in group.column("times").to_pylist()])
        some, times = _each_once(some, times)
        shard = group.column("shard")[0].as_py()
        rows = [(0, shard, _steps_up(some), _planes(times), None, None)]
        for decisions, zeros, ones, weights in Branches(some, times).roots():
            # Contexts of three bytes with the same two: those of this shard are added up.
            each, which = np.unique(decisions, return_inverse=True)
            total = np.stack([np.bincount(which, weights=x, minlength=len(each)) for x in (zeros, ones, weights)])
            rows.append((1, shard, None, None, each.tobytes(), total.tobytes()))
        give_back()
        return pa.Table.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), whole.types)], schema=whole)

    kept = written(blocks.mapInArrow(giving_back(count), SOME).groupBy("shard").applyInArrow(merge, SHARD), "contexts")
    ddl = "decision long, zeros double, ones double, below double"
    out = arrow_schema(ddl)

    def loose(batches):
        for batch in batches:
            for each, total in zip(batch.column("decisions").to_pylist(), batch.column("weights").to_pylist()):
                z, o, w = np.frombuffer(total, np.float64).reshape(3, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(each, np.int64)), pa.array(z), pa.array(o), pa.array(w)],
                                                 schema=out)

    sums = kept.filter("kind = 1").select("decisions", "weights").mapInArrow(loose, ddl).groupBy("decision").agg(
        *[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toArrow().sort_by("decision")
    top = Top(*[sums.column(c).to_numpy() for c in ("decision", "zeros", "ones", "below")])
    return Model(kept, top, shards)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32(doc_id as text) mod folds is the fold; unknown ids are not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))


# --- the base: counts of words ------------------------------------------------------------

def _words(data: np.ndarray, offsets: np.ndarray):
    """Hashes and document numbers of all words, after lower-casing."""
    low = _LOWER[data]
    start, end = spans(~_SPACE[low], offsets)
    doc = np.searchsorted(offsets, start, side="right") - 1
    return PrefixHash(low, 11, 11).of(start, end), doc


def _keys(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A number for each (doc_id, text)."""
    ids = part.column("doc_id").cast(pa.int64())
    known = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
    text = PrefixHash(data, 13, 11).of(offsets[:-1], offsets[1:])
    absent = np.asarray(ids.is_null()).astype(np.uint64)
    return mix64(text ^ mix64(known + absent * np.uint64(0x5851F42D4C957F2D))).view(np.int64)


BLOCKS = "bucket int, hashes binary, train binary, pairs binary, docs binary, times binary, keys binary"
PARTIAL = "kind int, part long, keys binary, logs binary, known binary"
SUMS = "kind int, k long, logs double, known long"


def word_sums(docs: DataFrame, buckets: int) -> DataFrame:
    """kind 0: by document key, the sum of log10(c + 1) and the known words; kind 1: V and N."""
    schema, partial_schema, out_schema = arrow_schema(BLOCKS), arrow_schema(PARTIAL), arrow_schema(SUMS)

    def blocks(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 * CHUNK):
                data, offsets = raw_bytes(part.column("text"))
                h, doc = _words(data, offsets)
                learns = ~np.asarray(part.column("held_out").to_numpy(zero_copy_only=False), bool)
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(h)))
                h, doc = h[at], doc[at]
                head = np.ones(len(h), bool)
                head[1:] = h[1:] != h[:-1]
                first = np.flatnonzero(head)
                pairs = np.diff(np.append(first, len(h)))
                train = np.add.reduceat(times * learns[doc], first) if len(first) else np.zeros(0, np.int64)
                hashes = h[first]
                bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                edge = np.searchsorted(bucket, np.arange(buckets + 1))
                pair_edge = np.append(first, len(h))[edge]
                keys = _keys(part, data, offsets).tobytes()
                rows = [b for b in range(buckets) if edge[b] < edge[b + 1]]
                cut = lambda x, e, kind: pa.array([x[e[b]:e[b + 1]].astype(kind).tobytes() for b in rows], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int32()), cut(hashes, edge, np.uint64), cut(train, edge, np.uint32),
                     cut(pairs, edge, np.uint32), cut(doc, pair_edge, np.uint32), cut(times, pair_edge, np.uint32),
                     pa.array([keys] * len(rows), pa.binary())], schema=schema)

    def add(group: pa.Table) -> pa.Table:
        got = {n: [np.frombuffer(x, kind) for x in group.column(n).to_pylist()]
               for n, kind in (("hashes", np.uint64), ("train", np.uint32), ("pairs", np.uint32),
                               ("docs", np.uint32), ("times", np.uint32), ("keys", np.int64))}
        names, which = np.unique(np.concatenate(got["hashes"]), return_inverse=True)
        c = np.bincount(which, weights=np.concatenate(got["train"]), minlength=len(names))
        logs, known = np.log10(c + 1.0)[which], (c > 0)[which]
        edge = np.cumsum([0] + [len(x) for x in got["hashes"]])
        rows = [(1, 0, np.zeros(1, np.int64), np.array([c.sum()]), np.array([(c > 0).sum()], np.int64))]
        for i, keys in enumerate(got["keys"]):
            word = np.repeat(np.arange(edge[i], edge[i + 1]), got["pairs"][i])
            docs_, times = got["docs"][i], got["times"][i].astype(np.float64)
            total = np.bincount(docs_, weights=times * logs[word], minlength=len(keys))
            seen = np.bincount(docs_, weights=times * known[word], minlength=len(keys)).astype(np.int64)
            name = int.from_bytes(hashlib.md5(keys.tobytes()).digest()[:8], "little", signed=True)
            rows.append((0, name, keys, total, seen))
        # One packed row for each part that a bucket answers, not one a document.
        pack = lambda k: pa.array([r[k].tobytes() for r in rows], pa.binary())
        return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                                     pack(2), pack(3), pack(4)], schema=partial_schema)

    def total(group: pa.Table) -> pa.Table:
        read = lambda n, kind: [np.frombuffer(x, kind) for x in group.column(n).to_pylist()]
        keys, logs, known = read("keys", np.int64)[0], sum(read("logs", np.float64)), sum(read("known", np.int64))
        kind = np.full(len(keys), group.column("kind")[0].as_py(), np.int32)
        return pa.Table.from_arrays([pa.array(kind), pa.array(keys), pa.array(logs), pa.array(known)], schema=out_schema)

    partial = docs.mapInArrow(blocks, BLOCKS).groupBy("bucket").applyInArrow(add, PARTIAL)
    sums = partial.groupBy("kind", "part").applyInArrow(total, SUMS)
    # The same (doc_id, text) may stand in several parts.
    return sums.groupBy("kind", "k").agg(F.sum("logs").alias("logs"), F.sum("known").alias("known"))


SCORED = "k long, n_tokens long"


def score_documents(df: DataFrame, folds: int = 7, fold: int = 2, id_col: str = "doc_id",
                    text_col: str = "text", bucket_bytes: int = 24 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    docs = keyed_text(df, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id"), folds, fold))
    blocks = written(packed(docs), "texts")
    model = fitted(blocks, max(6, input_bytes(df) * 2 // bucket_bytes))
    # The same (doc_id, text) has the same score wherever it stands.
    scores = written(model.scores(blocks).groupBy("k").agg(F.max("score").alias("score")), "scores")
    dropped(blocks)
    dropped(model.kept)

    def run(batch):
        for part in slices(batch, "text", CHUNK):
            data, offsets = raw_bytes(part.column("text"))
            start, _ = spans(~_SPACE[data], offsets)
            words = np.bincount(np.searchsorted(offsets, start, side="right") - 1, minlength=len(offsets) - 1)
            yield part, {"k": _keys(part, data, offsets), "n_tokens": words.astype(np.int64) + 1}

    sums = written(word_sums(docs, max(6, input_bytes(df) // bucket_bytes)), "word-sums")
    scored = written(with_results(docs, SCORED, run).select("doc_id", "held_out", "k", "n_tokens",
                                                            F.octet_length("text").alias("bytes")), "scored")
    total = sums.filter("kind = 1").first()
    ends = scored.filter("not held_out").count()
    n = int(total["logs"] if total else 0) + ends
    v = int(total["known"] if total else 0) + (1 if ends else 0)
    # Rows with the same id and text share their key: each takes its part of the sums.
    rows = scored.groupBy("k").agg(F.count("*").alias("same"))
    found = sums.filter("kind = 0").join(rows, "k").select(
        "k", (F.col("logs") / F.col("same")).alias("logs"), (F.col("known") / F.col("same")).cast("long").alias("known"))
    joined = scored.join(scores, "k", "left").join(found, "k", "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens",
        (F.coalesce("known", F.lit(0)) + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.coalesce("logs", F.lit(0.0)) + F.lit(math.log10(ends + 1))
         - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        "score", (-F.col("score") * F.lit(math.log2(10)) / (F.coalesce("bytes", F.lit(0)) + 1)).alias("bits_per_byte"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
