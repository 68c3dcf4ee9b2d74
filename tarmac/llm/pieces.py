"""SentencePiece encoding and decoding by N-best search over the piece lattice.

The lattice of a text holds every piece of a SentencePiece model wherever it matches, scored
as in the model file, and the byte pieces of characters that no piece covers (scored below
every piece).  A forward Viterbi pass gives each position the best score of any path to it;
these are exact heuristics for an A* search that walks backward from the end, so only
hypotheses that belong to the N best paths are ever expanded.

No piece crosses from a character to a following blank (checked when the model is read), nor
covers a newline, so the lattice of a text falls into units: blanks with the word after them,
and newlines.  Units repeat: each distinct one of a task has its forward pass once, many at a
time in numpy, with a backward pass that tells how much its second-best path loses.  The N
best paths of a text can differ from the best one only in the N - 1 units that lose least, so
these are searched (a front of at most N hypotheses a unit) and the N best paths of the text
merged from theirs, lowest loss first.

Decoding joins the pieces, turns byte pieces into bytes and blanks back, and drops the blank
put before the text.  It restores every text that holds no U+2581 (the mark for a blank) and
keeps no trace of that difference otherwise.

Defined results: a null or empty text has no pieces, one path of score 0 and decodes to the
empty text; equal scores go to the path with the longer last piece; rows are independent, so
repeated rows repeat their result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from array import array
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.inputs import PrefixHash, arrow_schema, giving_back, keyed_text, slices, table

BLANK = "▁".encode()
NEWLINE_OR_UNIT = re.compile(rb"\n|(?:\xe2\x96\x81)*(?:(?!\xe2\x96\x81)[^\n])+|(?:\xe2\x96\x81)+")
#: Added to the lowest piece score for a character that only byte pieces can write.
UNKNOWN_PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Lexicon:
    """The pieces of a model: ids by bytes, scores, byte pieces."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[bytes, int] = {}
        n = sp.get_piece_size()
        self.scores = np.array([sp.get_score(i) for i in range(n)], np.float64)
        self.texts: list[bytes] = [b""] * n
        self.byte_id = np.full(256, -1, np.int64)
        self.crosses = False
        for i in range(n):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(text[3:5], 16)
                self.byte_id[value], self.texts[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[text.encode()] = i
                self.texts[i] = text.encode()
                self.crosses |= "▁" in text.lstrip("▁") or "\n" in text
        if self.crosses:
            raise ValueError("a piece of this model crosses from a character to a blank or newline")
        usable = np.array(sorted(self.ids.values()))
        self.lowest = float(self.scores[usable].min()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids))
        # Pieces by the hash of their bytes, in one open table.
        data = np.frombuffer(b"".join(self.ids), np.uint8)
        ends = np.cumsum([len(x) for x in self.ids])
        keys = PrefixHash(data, 7).of(np.concatenate([[0], ends[:-1]]), ends)
        self.bits = int(4 * len(keys)).bit_length()
        self.slots = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        for key, value in zip(keys.tolist(), self.ids.values()):
            at = key & ((1 << self.bits) - 1)
            while self.values[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.slots[at], self.values[at] = key, value

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        mask = np.uint64((1 << self.bits) - 1)
        at = keys & mask
        out = np.full(len(keys), -1, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            value = self.values[at]
            same = self.slots[at] == keys[todo]
            out[todo[same]] = np.where(value >= 0, value, -1)[same]
            go = ~same & (value >= 0)
            todo, at = todo[go], (at[go] + np.uint64(1)) & mask
        return out


def _groups(units: list[bytes], cells: int):
    """Numbers of units of about one length, as many as ``cells`` lattice cells allow."""
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    order = np.argsort(lengths, kind="stable")
    lengths = lengths[order]
    start = 0
    while start < len(order):
        longest = int(lengths[start]) + 2
        most = max(1, cells // (longest * min(longest, 48)))
        end = min(start + most, int(np.searchsorted(lengths, longest, side="right")))
        yield order[start:end].tolist()
        start = end


class Lattice:
    """Pieces and scores of some units; forward Viterbi scores and the steps they take."""

    def __init__(self, units: list[bytes], lex: Lexicon):
        n = len(units)
        self.units, self.lex = units, lex
        self.lengths = lengths = np.array([len(u) for u in units])
        size = int(lengths.max())
        data = np.frombuffer(b"".join(units), np.uint8)
        base = np.cumsum(lengths) - lengths
        hashes = PrefixHash(data, 7)
        char = np.ones(len(data) + 1, bool)
        char[:-1] = (data & 0xC0) != 0x80
        self.span = span = min(size, lex.longest)
        # piece[u, e, l - 1]: the piece of length l that ends at e, or -1; score likewise.
        self.piece = piece = np.full((n, size + 1, span), -1, np.int32)
        rows = np.repeat(np.arange(n), lengths)
        ends = np.arange(len(data)) - base[rows] + 1
        for length in range(1, span + 1):
            fits = np.flatnonzero(ends >= length)
            stop = fits + 1
            fits = fits[char[stop - length] & char[stop]]
            piece[rows[fits], ends[fits], length - 1] = lex.find(hashes.of(fits + 1 - length, fits + 1))
        # A character without a piece of its own is written by byte pieces (marked -2).
        for length in range(1, min(4, span) + 1):
            fits = np.flatnonzero(ends >= length)
            whole = char[fits + 1 - length] & char[fits + 1]
            for k in range(1, length):
                whole &= ~char[fits + 1 - k]
            fits = fits[whole]
            fits = fits[piece[rows[fits], ends[fits], length - 1] < 0]
            piece[rows[fits], ends[fits], length - 1] = -2
        self.score = score = np.append(lex.scores, [lex.lowest, -np.inf])[piece]
        # Forward Viterbi: the exact best score of a path to each position.
        self.best = best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0.0
        self.step = np.zeros((n, size + 1), np.int64)
        every = np.arange(n)
        for e in range(1, size + 1):
            k = min(e, span)
            to = best[:, e - k:e][:, ::-1] + score[:, e, :k]
            # Equal scores go to the longer last piece.
            self.step[:, e] = k - np.argmax(to[:, ::-1], axis=1)
            best[:, e] = to[every, self.step[:, e] - 1]

    def best_paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the best paths in turn, ids a unit, scores, losses of second-best paths."""
        n, size = self.best.shape
        every, at, trail = np.arange(n), self.lengths.copy(), []
        on_path = np.zeros(self.score.shape, bool)
        while (at > 0).any():
            take = np.where(at > 0, self.step[every, at], 0)
            live = np.flatnonzero(take)
            on_path[live, at[live], take[live] - 1] = True
            ids = np.full(n, -1, np.int64)
            ids[live] = self.piece[live, at[live], take[live] - 1]
            trail.append((ids, take, at.copy()))
            at = at - take
        # A second path leaves the best one at some piece: forward, piece and backward scores.
        back = np.full((n, size), -np.inf)
        back[every, self.lengths] = 0.0
        second = np.full(n, -np.inf)
        for e in range(size - 1, 0, -1):
            k = min(e, self.span)
            via = back[:, e:e + 1] + self.score[:, e, :k]
            other = np.where(on_path[:, e, :k], -np.inf, via + self.best[:, e - k:e][:, ::-1]).max(axis=1)
            np.maximum(second, other, out=second)
            back[:, e - k:e] = np.maximum(back[:, e - k:e], via[:, ::-1])
        total = self.best[every, self.lengths]
        ids = np.stack([t[0] for t in reversed(trail)], axis=1)
        counts = (ids != -1).sum(axis=1)
        flat = ids[ids != -1]
        if (flat == -2).any():  # some characters are bytes
            lists, edge = [], np.concatenate([[0], np.cumsum(counts)])
            odd = np.flatnonzero((ids == -2).any(axis=1))
            for u in range(n):
                lists.append(flat[edge[u]:edge[u + 1]])
            for u in odd:
                out = []
                for x, take, stop in reversed(trail):
                    if take[u]:
                        out += [int(x[u])] if x[u] >= 0 else \
                            self.lex.byte_id[np.frombuffer(self.units[u][stop[u] - take[u]:stop[u]], np.uint8)].tolist()
                lists[u] = np.array(out, np.int64)
            flat, counts = np.concatenate(lists), np.array([len(x) for x in lists])
        return flat.astype(np.int32), counts, total, total - second


class LongUnit:
    """The same searches over one very long unit (no blank or newline for ``BLOCK`` bytes and
    more), holding the lattice of one block of positions at a time."""

    BLOCK = 1 << 16

    def __init__(self, unit: bytes, lex: Lexicon, block: int = BLOCK):
        self.unit, self.lex, self.block, self.span = unit, lex, block, lex.longest
        n = len(unit)
        self.best = np.full(n + 1, -np.inf)
        self.best[0] = 0.0
        self.step = np.zeros(n + 1, np.int64)
        for lo in range(0, n, block):
            scores = self._scores(lo)
            for e in range(lo + 1, min(n, lo + block) + 1):
                k = min(e, self.span)
                to = self.best[e - k:e][::-1] + scores[e - lo - 1, :k]
                at = k - 1 - int(np.argmax(to[::-1]))
                self.step[e], self.best[e] = at + 1, to[at]

    def piece(self, e: int, length: int) -> list[int] | None:
        """Ids of the piece of some length that ends at ``e``, or None."""
        sub = self.unit[e - length:e]
        found = self.lex.ids.get(sub)
        if found is not None:
            return [found]
        first = sub[0]
        size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        alone = (first & 0xC0) != 0x80 and size == length
        return self.lex.byte_id[np.frombuffer(sub, np.uint8)].tolist() if alone else None

    def _scores(self, lo: int) -> np.ndarray:
        """Scores of the pieces that end at lo + 1 ... lo + block, by length."""
        n, span = len(self.unit), self.span
        start, stop = max(0, lo - span - 4), min(n, lo + self.block)
        data = np.frombuffer(self.unit[start:stop + 4], np.uint8)
        char = np.append((data & 0xC0) != 0x80, True)
        hashes = PrefixHash(data, 7)
        ends = np.arange(lo + 1, stop + 1) - start
        out = np.full((stop - lo, span), -np.inf)
        known = np.append(self.lex.scores, -np.inf)
        for length in range(1, span + 1):
            rows = np.flatnonzero(ends >= length)
            rows = rows[char[ends[rows] - length] & char[ends[rows]]]
            e = ends[rows]
            found = self.lex.find(hashes.of(e - length, e))
            score = known[found]
            if length <= 4:
                whole = found < 0
                for k in range(1, length):
                    whole &= ~char[e - k]
                score = np.where(whole, self.lex.lowest, score)
            out[rows, length - 1] = score
        return out

    def best_path(self) -> tuple[list[int], float, float]:
        """ids, score, and the loss of the second-best path."""
        n, span = len(self.unit), self.span
        e, ids = n, []
        taken = np.zeros(n + 1, np.int64)
        while e:
            taken[e] = length = int(self.step[e])
            ids.append(self.piece(e, length))
            e -= length
        back = np.full(n + 1, -np.inf)
        back[n], second = 0.0, -np.inf
        for lo in range((n - 1) // self.block * self.block, -1, -self.block):
            scores = self._scores(lo)
            for e in range(min(n, lo + self.block), lo, -1):
                k = min(e, span)
                via = back[e] + scores[e - lo - 1, :k]
                total = via + self.best[e - k:e][::-1]
                if taken[e]:
                    total[taken[e] - 1] = -np.inf
                second = max(second, float(total.max()))
                back[e - k:e] = np.maximum(back[e - k:e], via[::-1])
        return [i for x in reversed(ids) for i in x], float(self.best[n]), float(self.best[n] - second)

    def search(self, n_best: int) -> list[tuple[float, list[int]]]:
        """The N best (score, ids): backward A* with a front of at most N hypotheses."""
        front, done = [(float(self.best[-1]), 0.0, len(self.unit), None)], []
        while front:
            grown = list(done)
            for _, g, e, trail in front:
                for length in range(min(e, self.span), 0, -1):
                    ids = self.piece(e, length)
                    if ids is not None and self.best[e - length] > -np.inf:
                        step = self.lex.scores[ids[0]] if self.unit[e - length:e] in self.lex.ids else self.lex.lowest
                        grown.append((g + step + self.best[e - length], g + step, e - length, (ids, trail)))
            grown.sort(key=lambda x: -x[0])
            done = [x for x in grown[:n_best] if x[2] == 0]
            front = [x for x in grown[:n_best] if x[2] > 0]
        out = []
        for _, g, _, trail in done:
            ids = []
            while trail is not None:
                ids += trail[0]
                trail = trail[1]
            out.append((g, ids))
        return out


def search_units(units: list[bytes], lex: Lexicon, n_best: int) -> list[list[tuple[float, list[int]]]]:
    """The N best (score, ids) of each unit, best first."""
    out: list = [None] * len(units)
    short = [i for i, u in enumerate(units) if len(u) < LongUnit.BLOCK]
    for some in _groups([units[i] for i in short], 400_000 // n_best):
        some = [short[i] for i in some]
        for i, found in zip(some, _search(Lattice([units[i] for i in some], lex), n_best)):
            out[i] = found
    for i, u in enumerate(units):
        if out[i] is None:
            out[i] = LongUnit(u, lex).search(n_best)
    return out


def _search(lattice: Lattice, n_best: int):
    units, lex, lengths = lattice.units, lattice.lex, lattice.lengths
    piece, score, best, span = lattice.piece, lattice.score, lattice.best, lattice.span
    n = len(units)
    # Backward A*: fronts of at most N hypotheses, ordered by score so far plus heuristic.
    at = np.zeros((n, n_best), np.int64)
    at[:, 0] = lengths
    gone = np.full((n, n_best), -np.inf)
    gone[:, 0] = 0.0
    back: list[tuple[np.ndarray, np.ndarray]] = []
    steps = np.arange(1, span + 1)
    unit = np.arange(n)[:, None]
    while (at > 0).any():
        live = at > 0
        prev = np.maximum(at[:, :, None] - steps, 0)
        ok = live[:, :, None] & (at[:, :, None] >= steps)
        g = np.where(ok, gone[:, :, None] + score[unit, at], -np.inf)
        f = np.where(ok, g + best[unit[:, :, None], prev], -np.inf)
        # A finished hypothesis stays in the front as it is (kept in the last column).
        f = np.concatenate([f, np.where(live, -np.inf, gone)[:, :, None]], axis=2).reshape(n, -1)
        width = span + 1
        # Stable: equal scores keep the order of hypotheses, then the longer last piece.
        flip = f.reshape(n, n_best, width)[:, :, ::-1].reshape(n, -1)
        chosen = np.argsort(-flip, axis=1, kind="stable")[:, :n_best]
        parent, column = chosen // width, width - 1 - chosen % width
        value = np.take_along_axis(flip, chosen, axis=1)
        done = column == span
        old = np.take_along_axis(at, parent, axis=1)
        taken = np.where(done, 0, column + 1)
        real = value > -np.inf
        g_new = np.where(done, np.take_along_axis(gone, parent, axis=1),
                         g[unit, parent, np.minimum(column, span - 1)])
        gone = np.where(real, g_new, -np.inf)
        back.append((parent, np.where(real, taken, 0)))
        at = np.where(real, old - taken, 0)
    results = [[] for _ in range(n)]
    final = np.argsort(-gone, axis=1, kind="stable")
    for rank in range(n_best):
        hyp = final[:, rank].copy()
        total = np.take_along_axis(gone, hyp[:, None], axis=1)[:, 0]
        trail = []
        for parent, taken in reversed(back):  # walk from the text's start to its end
            trail.append(taken[np.arange(n), hyp])
            hyp = parent[np.arange(n), hyp]
        trail = np.array(trail) if trail else np.zeros((0, n), np.int64)
        for u in np.flatnonzero(total > -np.inf):
            ids, pos = [], 0
            for length in trail[:, u]:
                if length:
                    pos += int(length)
                    p = int(piece[u, pos, length - 1])
                    if p == -2:
                        ids += lex.byte_id[np.frombuffer(units[u][pos - length:pos], np.uint8)].tolist()
                    else:
                        ids.append(p)
            results[u].append((float(total[u]), ids))
    return results


def merge_paths(alternatives: list[list[tuple[float, list[int]]]], n_best: int):
    """The N best choices over units: (loss, {unit place: alternative}), least loss first.

    Only the N - 1 places with the smallest loss of a second choice can differ in any of them.
    """
    loss = np.array([a[0][0] - a[1][0] if len(a) > 1 else np.inf for a in alternatives])
    k = min(n_best - 1, len(loss))
    open_ = np.sort(np.argsort(loss, kind="stable")[:k])
    open_ = [int(i) for i in open_ if np.isfinite(loss[i])]
    tick = count()
    heap, seen, found = [(0.0, next(tick), (0,) * len(open_))], set(), []
    while heap and len(found) < n_best:
        lost, _, choice = heapq.heappop(heap)
        found.append((lost, {p: c for p, c in zip(open_, choice) if c}))
        for j, p in enumerate(open_):
            nxt = choice[:j] + (choice[j] + 1,) + choice[j + 1:]
            if nxt[j] < len(alternatives[p]) and nxt not in seen:
                seen.add(nxt)
                more = sum(alternatives[q][0][0] - alternatives[q][c][0] for q, c in zip(open_, nxt))
                heapq.heappush(heap, (more, next(tick), nxt))
    return found


def text_units(text: bytes | None) -> list[bytes]:
    """A text as the model sees it, one blank before it and blanks marked, cut into units."""
    return NEWLINE_OR_UNIT.findall(BLANK + text.replace(b" ", BLANK)) if text else []


def decode_bytes(ids, lex: Lexicon) -> bytes:
    raw = b"".join(map(lex.texts.__getitem__, ids)).replace(BLANK, b" ")
    return raw[1:] if raw[:1] == b" " else raw


def decode_ids(ids, lex: Lexicon) -> str:
    """The text of piece ids."""
    return decode_bytes(ids, lex).decode("utf-8", "replace")


class UnitCache:
    """Best paths of the distinct units a task has met, as flat arrays."""

    def __init__(self, lex: Lexicon, most: int):
        self.lex, self.most = lex, most
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.ends = array("i"), array("q")
        self.scores, self.loss = array("d"), array("d")

    def numbers(self, cut: list[list[bytes]]) -> list[np.ndarray]:
        """The number of each unit of each text."""
        units = set().union(*cut)
        new = units.difference(self.known)
        if len(self.known) + len(new) > self.most and self.known:
            self._forget()
            new = units
        known = self.known
        for u in [u for u in new if len(u) >= LongUnit.BLOCK]:
            new.discard(u)
            ids, total, loss = LongUnit(u, self.lex).best_path()
            known[u] = len(self.ends)
            self.flat.extend(ids)
            self.ends.append(len(self.flat))
            self.scores.append(total)
            self.loss.append(loss)
        new = list(new)
        for some in _groups(new, 1_500_000):
            flat, counts, total, loss = Lattice([new[i] for i in some], self.lex).best_paths()
            first = len(self.ends)
            base = len(self.flat)
            for k, i in enumerate(some):
                known[new[i]] = first + k
            self.flat.frombytes(flat.tobytes())
            self.ends.frombytes((base + np.cumsum(counts)).astype(np.int64).tobytes())
            self.scores.frombytes(total.astype(np.float64).tobytes())
            self.loss.frombytes(loss.astype(np.float64).tobytes())
        get = known.__getitem__
        return [np.fromiter(map(get, units), np.int64, len(units)) for units in cut]

    def arrays(self):
        """ids in turn, where each unit's end, scores, losses (copies: the cache still grows)."""
        return (np.array(self.flat, np.int32), np.array(self.ends, np.int64),
                np.array(self.scores, np.float64), np.array(self.loss, np.float64))


_MODELS: dict[str, Lexicon] = {}


def model_of(path: str) -> Lexicon:
    """One reading of the model a worker process."""
    if path not in _MODELS:
        _MODELS[path] = Lexicon(path)
    return _MODELS[path]


ENCODED = ("doc_id long, ids array<int>, n_pieces long, score double, "
           "n_best array<struct<score:double,n_pieces:int,changes:array<struct<unit:int,ids:array<int>>>>>, "
           "decoded boolean")


def encode_documents(docs: DataFrame, model: str | None = None, n_best: int = 3,
                     id_col: str = "doc_id", text_col: str = "text", cache: int = 400_000,
                     slice_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, ids of the best path, n_pieces, score, n_best, decoded (ids give back the text).

    Each of ``n_best`` has its score, its number of pieces and where it differs from the best
    path: the unit's place in the text and the ids there.  ``cache`` bounds the distinct units
    that a task remembers,
    ``slice_bytes`` the text it cuts at a time.
    """
    path = model or default_model()
    schema = arrow_schema(ENCODED)

    def run(batches):
        lex = model_of(path)
        units_of = UnitCache(lex, cache)
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                texts = [None if x is None else x.encode() for x in part.column("text").to_pylist()]
                cut = [text_units(x) for x in texts]
                at = units_of.numbers(cut)
                flat, ends, scores, loss = units_of.arrays()
                sizes = np.diff(ends, prepend=0)
                # Only the places of smallest loss can differ in an N-best path.
                near = []
                for x in at:
                    k = min(n_best - 1, len(x))
                    near.append(np.sort(np.argpartition(loss[x], k - 1)[:k]) if k else np.zeros(0, np.int64))
                wanted = list({cut[d][i] for d, places in enumerate(near) for i in places})
                found = dict(zip(wanted, search_units(wanted, lex, n_best)))
                whole = np.concatenate(at) if at else np.zeros(0, np.int64)
                n = sizes[whole]
                ids = flat[np.repeat(ends[whole] - np.cumsum(n), n) + np.arange(n.sum())]
                counts = np.array([int(sizes[x].sum()) for x in at], np.int64)
                edge = np.concatenate([[0], np.cumsum(counts)])
                total, paths, good = [], [], []
                for d, (text, x) in enumerate(zip(texts, at)):
                    total.append(float(scores[x].sum()))
                    here, mine = [], [found[cut[d][i]] for i in near[d]]
                    for lost, changes in merge_paths(mine, n_best):
                        size = int(counts[d]) + sum(len(mine[j][c][1]) - len(mine[j][0][1]) for j, c in changes.items())
                        here.append({"score": total[-1] - lost, "n_pieces": size, "changes": [
                            {"unit": int(near[d][j]), "ids": mine[j][c][1]} for j, c in sorted(changes.items())]})
                    paths.append(here)
                    plain = (text or b"").replace(BLANK, b" ")
                    good.append(decode_bytes(ids[edge[d]:edge[d + 1]].tolist(), lex) == plain)
                lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), lists, pa.array(counts), pa.array(total, pa.float64()),
                     pa.array(paths, schema.field("n_best").type), pa.array(good, pa.bool_())], schema=schema)

    return keyed_text(docs, id_col, text_col).mapInArrow(giving_back(run), ENCODED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
