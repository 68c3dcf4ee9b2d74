"""Toxicity by a linear-chain conditional random field over the words of each line.

Labels are given per document; words get theirs from them: in a toxic training document a
word is toxic if its form or one of its prefixes is clearly more frequent in the lines of
toxic than of other training documents.  A two-state CRF (state 1: toxic) is trained on all
their lines by gradient ascent on the exact conditional likelihood, with forward-backward run
over many lines at once.  Scoring runs forward-backward on every line of every text; the marginals
of a document (largest, and their sum) go through a logistic fit on the training documents to
a score of 0 to 1, and runs of words with a marginal of one half or more are the spans.

The model is fitted on a bounded sample of labelled rows: at most ``sample`` per class, taken
by a hash of the id from labels that have a document.  Both classes are counted over all such
rows and the score is fitted with weights that restore their shares, so it does not move with
the size of the table.  Everything else covers whole texts of all rows.

Defined results: null and empty texts have no words and get the score of no evidence; labels
that are null, or of ids without a document, are left out; an id with several labels counts
as toxic if one says so; with a single class in training the score is its share for all; rows
are scored independently, so repeated rows repeat their result; a null doc_id is not held out, as
its remainder is unknown; lines of any length are tagged whole, but the field is trained on pieces
of 64 words, so no transition is learned across their cuts; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmac.llm.inputs import give_back, keyed_text, slices, table, with_results, written

SAMPLE, SAMPLE_BYTES = 4000, 64 << 20
#: Words whose emission a task remembers, bytes of text scored at a time, and cells of a padded part of it.
KNOWN, SLICE, CELLS = 100_000, 1 << 20, 250_000
PREFIXES = (3, 4, 5, 6)
#: Lower-case A-Z, keep letters, digits, non-ASCII bytes and newlines; the rest parts words.
_TABLE = bytes(10 if i == 10 else (i + 32 if 65 <= i <= 90 else i)
               if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def held_out(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def word_lines(text: bytes | None) -> list[list[bytes]]:
    return [w for w in map(bytes.split, text.translate(_TABLE).split(b"\n")) if w] if text else []


def features_of(word: bytes) -> list[bytes]:
    """The whole word (marked by a blank) and its prefixes, in characters."""
    letters = word.decode("utf-8", "replace")
    return [word + b" "] + [letters[:k].encode() for k in PREFIXES if len(letters) >= k]


def forward_backward(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray, start: np.ndarray, weight=None):
    """Marginals, pair expectations (of weighted lines) and log partition of padded lines
    (lines x time x 2)."""
    n, t_max, _ = emit.shape
    alpha = np.empty_like(emit)
    alpha[:, 0] = start + emit[:, 0]
    for t in range(1, t_max):
        prev = alpha[:, t - 1]
        step = emit[:, t] + np.logaddexp(prev[:, :1] + trans[0], prev[:, 1:] + trans[1])
        alpha[:, t] = np.where(mask[:, t:t + 1], step, prev)
    log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    beta = np.zeros_like(emit)
    pair = np.zeros((2, 2))
    for t in range(t_max - 2, -1, -1):
        nxt = beta[:, t + 1] + emit[:, t + 1]
        step = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
        real = mask[:, t + 1]
        beta[:, t] = np.where(real[:, None], step, beta[:, t + 1])
        joint = np.exp(alpha[:, t, :, None] + trans + nxt[:, None, :] - log_z[:, None, None])
        pair += joint[real].sum(axis=0) if weight is None else np.einsum("n,nij->ij", weight[real], joint[real])
    marginal = np.exp(alpha[:, :, 1] + beta[:, :, 1] - log_z[:, None])
    return marginal, pair, log_z


class Tagger:
    """A fitted field: emissions of known features, transitions, start, and the calibration."""

    def __init__(self, weights: dict[bytes, float], bias: float, trans: np.ndarray,
                 start: np.ndarray):
        self.weights, self.bias, self.trans, self.start = weights, bias, trans, start
        self.scale = np.array([-2.0, 4.0, 0.0])
        self.constant: float | None = None
        self._quiet: dict[int, np.ndarray] = {}
        self._words: dict[bytes, float] = {}

    def emission(self, word: bytes) -> float:
        found = self._words.get(word)
        if found is None:
            if len(self._words) >= KNOWN:
                self._words.clear()
            get = self.weights.get
            found = sum(get(f, 0.0) for f in features_of(word))
            self._words[word] = found
        return found

    def _run(self, lines: list[np.ndarray]) -> list[np.ndarray]:
        size = max(map(len, lines))
        emit = np.zeros((len(lines), size, 2))
        mask = np.zeros((len(lines), size), bool)
        for i, x in enumerate(lines):
            emit[i, :len(x), 1] = x + self.bias
            mask[i, :len(x)] = True
        marginal = forward_backward(emit, mask, self.trans, self.start)[0]
        return [marginal[i, :len(x)] for i, x in enumerate(lines)]

    def quiet(self, n: int) -> np.ndarray:
        """Marginals of a line of ``n`` words without any known feature."""
        if n not in self._quiet:
            self._quiet[n] = self._run([np.zeros(n)])[0]
        return self._quiet[n]

    def marginals(self, lines: list[np.ndarray]) -> list[np.ndarray]:
        """Marginals of state 1 for the summed feature weights of each line's words."""
        out: list = [None] * len(lines)
        busy = []
        for i, x in enumerate(lines):
            if x.any():
                busy.append(i)
            else:
                out[i] = self.quiet(len(x))
        busy.sort(key=lambda i: len(lines[i]))
        while busy:  # padded together
            longest = len(lines[busy[-1]])
            some = busy[-max(1, CELLS // longest):]
            del busy[-len(some):]
            for i, m in zip(some, self._run([lines[i] for i in some])):
                out[i] = m
        return out

    def score(self, texts: list[bytes | None]):
        """(largest marginal, sum of marginals) and the marginals by line, of each text."""
        lines, owner = [], []
        for k, text in enumerate(texts):
            for words in word_lines(text):
                lines.append(np.fromiter(map(self.emission, words), np.float64, len(words)))
                owner.append(k)
        found = self.marginals(lines)
        top, total = np.zeros(len(texts)), np.zeros(len(texts))
        for k, m in zip(owner, found):
            top[k] = max(top[k], m.max())
            total[k] += m.sum()
        return top, total, owner, found

    def probability(self, top: np.ndarray, total: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(top), self.constant)
        z = self.scale[0] + self.scale[1] * top + self.scale[2] * np.log1p(total)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def toxic_features(docs: list[list[list[bytes]]], labels: np.ndarray, least: float = 25.0,
                   lift: float = 4.0) -> dict[bytes, float]:
    """Features clearly more frequent in lines of toxic documents: log-likelihood ratio and lift.

    A line counts once however many documents hold it, so that copies of one toxic document
    don't make its other words look toxic.
    """
    lines_of: dict[tuple[bytes, ...], int] = {}
    for lines, label in zip(docs, labels):
        for line in lines:
            key = tuple(line)
            lines_of[key] = min(lines_of.get(key, 1), int(label))
    counts = (Counter(), Counter())
    for words, label in lines_of.items():
        if label:
            counts[1].update({f for w in set(words) for f in features_of(w)})
    toxic = counts[1]
    for words, label in lines_of.items():  # features of no toxic line need no count
        if not label:
            counts[0].update({f for w in set(words) for f in features_of(w) if f in toxic})
    n1 = sum(lines_of.values())
    n0 = len(lines_of) - n1
    if not n1:
        return {}
    found = {}
    for f, a in counts[1].items():
        b = counts[0][f]
        share1, share0 = a / n1, b / max(n0, 1)
        if share1 <= lift * share0:
            continue
        both = (a + b) / (n0 + n1)

        def part(k, n):
            return (k * np.log(k / (n * both)) if k else 0.0) + \
                ((n - k) * np.log((n - k) / (n * (1 - both))) if k < n and both < 1 else 0.0)
        g2 = 2 * (part(a, n1) + part(b, n0))
        if g2 >= least:
            found[f] = float(np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)))
    return found


def _padded(rows: dict[tuple, float], cells: int = 1 << 17) -> list[tuple]:
    """Rows of similar length together, at most ``cells`` places a part: mask, decisions, weights
    and (row, place, feature) of what is active."""
    left = sorted(rows.items(), key=lambda x: len(x[0][0]))
    parts = []
    while left:
        size = len(left[-1][0][0])
        some = left[-max(1, cells // size):]
        del left[-len(some):]
        mask = np.arange(size) < np.array([[len(piece)] for (piece, _), _ in some])
        gold = np.zeros((len(some), size), np.int8)
        at = []
        for i, ((piece, toxic), _) in enumerate(some):
            for t, active in enumerate(piece):
                if active:
                    gold[i, t] = toxic
                    at += [(i, t, f) for f in active]
        parts.append((mask, gold, np.array([w for _, w in some]), *np.array(at, np.int32).reshape(-1, 3).T))
    return parts


def _gradient(theta: np.ndarray, k: int, mask, gold, weight, r, t, f) -> np.ndarray:
    """Of the log likelihood of some weighted rows, by (features, bias, transitions, start)."""
    emit = np.zeros((*mask.shape, 2))
    np.add.at(emit[:, :, 1], (r, t), theta[f])
    emit[:, :, 1] += theta[k]
    emit[~mask] = 0
    marginal, pair, _ = forward_backward(emit, mask, theta[k + 1:k + 5].reshape(2, 2), theta[k + 5:], weight)
    each = np.broadcast_to(weight[:, None], mask.shape)
    steps, real = gold[:, :-1] * 2 + gold[:, 1:], mask[:, 1:]
    seen = np.bincount(steps[real], each[:, 1:][real], minlength=4).reshape(2, 2)
    first = np.bincount(gold[:, 0], weight, minlength=2)
    error = np.where(mask, gold - marginal, 0.0) * each
    return np.concatenate([np.bincount(f, error[r, t], minlength=k), [error.sum()], (seen - pair).ravel(),
                           first - np.array([weight @ (1 - marginal[:, 0]), weight @ marginal[:, 0]])])


def fit(texts: list[bytes], labels: np.ndarray, weight: np.ndarray | None = None, rounds: int = 60) -> Tagger:
    """Label the words, train the field on lines, fit the document score to weighted documents."""
    weight = np.ones(len(labels)) if weight is None else weight
    one: dict[bytes, bytes] = {}  # equal words share one object
    docs = [[[one.setdefault(w, w) for w in line] for line in word_lines(t)] for t in texts]
    del one
    known = toxic_features(docs, labels) if 0 < labels.sum() < len(labels) else {}
    names = sorted(known)
    index = {f: i for i, f in enumerate(names)}
    # Every line counts: equal rows of features are one row with their summed weight.
    acts: dict[bytes, tuple] = {}
    rows: dict[tuple, float] = {}
    for lines, label, w in zip(docs, labels, weight):
        for line in lines if names else ():
            for x in line:
                if x not in acts:
                    acts[x] = tuple(index[f] for f in features_of(x) if f in index)
            active = [acts[x] for x in line]
            for s in range(0, len(active), 64):
                piece = tuple(active[s:s + 64])
                key = (piece, bool(label) and any(piece))
                rows[key] = rows.get(key, 0.0) + w
    del acts
    weights, bias = np.zeros(len(names)), -4.0
    trans, start = np.zeros((2, 2)), np.zeros(2)
    if rows:
        k = len(names)
        n = max(sum(w for (piece, _), w in rows.items() if any(piece)), 1.0)
        parts = _padded(rows)
        del rows
        theta = np.concatenate([weights, [bias], trans.ravel(), start])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, rounds + 1):  # Adam on the full likelihood with a small L2 term
            grad = sum(_gradient(theta, k, *part) for part in parts) / n - 1e-4 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
            theta = theta + 0.25 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        weights, bias = theta[:k], float(theta[k])
        trans, start = theta[k + 1:k + 5].reshape(2, 2), theta[k + 5:]
    model = Tagger(dict(zip(names, map(float, weights))), bias, trans, start)
    if not 0 < labels.sum() < len(labels):
        model.constant = float(labels.mean()) if len(labels) else 0.0
        return model
    top, total, _, _ = model.score(texts)
    x = np.stack([np.ones(len(top)), top, np.log1p(total)], axis=1)
    y, w = labels.astype(float), np.zeros(3)
    ridge = np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):  # Newton steps of the logistic fit
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        w = w + np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge @ w), -4, 4)
    model.scale = w
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5, sample_bytes: int = SAMPLE_BYTES) -> Tagger:
    """Fit on at most ``sample`` labelled rows and ``sample_bytes`` of text (and one text more) a class whose crc32(id) mod folds is not 0, weighted
    to the shares of the classes among all such rows."""
    marked = (labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label"))
              .filter("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label")))
    marked = marked.filter(held_out(F.col("id"), folds) != 0)
    texts = keyed_text(docs)
    times = texts.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
    present = written(marked.join(times, F.col("doc_id") == F.col("id")).select("id", "label", "n", "bytes"), "labelled")
    total = {r["label"]: r["n"] for r in present.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    rows = []
    for label in (1, 0):
        chosen = present.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(sample)
        before = F.sum("bytes").over(Window.orderBy(F.xxhash64("id"), "id")) - F.col("bytes")  # of at most ``sample`` rows
        chosen = chosen.withColumn("before", before).filter(F.col("before") < sample_bytes).select("id")
        some = (texts.join(chosen, F.col("doc_id") == F.col("id"))
                .select("doc_id", F.lit(label).alias("label"), F.coalesce("text", F.lit("")).alias("text")))
        # An id may have several rows.
        rows += some.orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(sample).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    label = np.array([r["label"] for r in rows], np.int64)
    taken = np.bincount(label, minlength=2)
    share = np.array([total.get(k, 0) / max(taken[k], 1) for k in (0, 1)])
    weight = share[label] * (len(rows) / max(sum(total.values()), 1))
    model = fit([r["text"].encode() for r in rows], label, weight)
    del rows
    give_back()
    return model


def char_spans(text: bytes, marginal: np.ndarray) -> list[dict]:
    """Character offsets of the runs of words with a marginal of one half or more."""
    plain = np.frombuffer(text.translate(_TABLE), np.uint8)
    inside = np.concatenate([[False], (plain != 32) & (plain != 10), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edge[::2], edge[1::2]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    hot = np.concatenate([[False], marginal >= 0.5, [False]])
    edge = np.flatnonzero(hot[1:] != hot[:-1])
    return [{"start": int(chars[start[a]]), "stop": int(chars[stop[b - 1]])}
            for a, b in zip(edge[::2], edge[1::2])]


SCORED = ("score double, top_marginal double, toxic_words double, "
          "spans array<struct<start:int,stop:int>>")


def annotate(df: DataFrame, model: Tagger, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` plus score, largest marginal, expected toxic words and spans
    (character offsets); columns of these names are replaced."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        tagger = sent.value
        for part in slices(batch, text_col, SLICE):
            texts = [None if x is None else x.encode() for x in part.column(text_col).to_pylist()]
            top, total, owner, found = tagger.score(texts)
            cuts: list[list] = [[] for _ in texts]
            pieces: dict[int, list] = {}
            for k, m in zip(owner, found):
                if top[k] >= 0.5:
                    pieces.setdefault(k, []).append(m)
            for k, m in pieces.items():
                cuts[k] = char_spans(texts[k], np.concatenate(m))
            yield part, {"score": tagger.probability(top, total), "top_marginal": top,
                         "toxic_words": total, "spans": cuts}

    return with_results(df, SCORED, run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return annotate(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "top_marginal", "toxic_words", "spans")
