"""Text operators against brute force on small tables, and their edge cases."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tarmac.llm.queries")

from pyspark.sql import functions as F  # noqa: E402

from tarmac.llm import (context_tree, crf, decontam, html_text, line_dedup, minhash, orc_tokens,  # noqa: E402
                        pieces, suffix_dedup)

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, n_words string, score string, kept_text string, k1 int"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def words(s):
    return WORD.findall(lower(s))


@pytest.fixture(scope="module")
def docs(spark, sf):
    """A quarter of the small table (whole texts) with null, empty, repeated and long rows."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:60]
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau ".split()
    long_text = "\n".join(" ".join(f"{w}{i}" for w in base) for i in range(400))
    rows += [(None, "no id at all, but words"), (9001, None), (9002, ""), (9003, "!!! ..."), (9004, rows[3][1]),
             (9004, rows[3][1]), (9005, long_text), (9006, long_text + "\nand one more"), (9007, "same\n" * 12), (9008, "é ü  ß\t中文\n")]
    return rows


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", "y", "z", 7) for i, t in docs], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1: decontamination ---------------------------------------------------------------------

def hits_by_force(text, windows):
    w = words(text)
    hit, found = [False] * len(w), set()
    for n in {len(k) for k in windows}:
        for i in range(len(w) - n + 1):
            names = windows.get(tuple(w[i:i + n]))
            if names:
                found |= names
                hit[i:i + n] = [True] * n
    return len(w), sum(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [16 << 20, 500])
def test_decontam_equals_brute_force(spark, docs, frame, block_bytes):
    items = [(1, " ".join(words(docs[5][1])[4:30])), (2, "words"), (3, None), (None, "no id"), (4, "..."),
             (5, "beta3 gamma3 DELTA3"), (6, "beta3 gamma3 delta3"), (2, "words")]
    table = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        if i is not None:
            for k in range(max(1, len(w) - 12) if w else 0):
                windows[tuple(w[k:k + 13])].add(str(i))
    got = decontam.annotate(frame, table, block_bytes=block_bytes).collect()
    want = sorted((repr(i), *hits_by_force(t, windows)) for i, t in docs)
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == want
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_hit for r in got)
    assert sum(r.n_hit for r in got) > 30


def test_decontam_empty(spark, frame, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.annotate(empty, items).collect() == []
    assert {r.n_hit for r in decontam.annotate(frame, items).collect()} == {0}


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(1)
    seq = rng.integers(1, 4, 300)
    index = decontam.FMIndex(seq)
    windows = np.array([[1, 2], [3, 3], [2, 1], [9, 1]])
    low, high = index.search(windows)
    for w, a, b in zip(windows, low, high):
        places = [i for i in range(299) if (seq[i:i + 2] == w).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == places


# --- 2: pieces ------------------------------------------------------------------------------

def best_paths(unit, lex, n):
    cuts = [i for i in range(len(unit) + 1) if i == len(unit) or (unit[i] & 0xC0) != 0x80]
    paths = {0: [(0.0, ())]}
    for e, stop in enumerate(cuts[1:], 1):
        found = []
        for s, start in enumerate(cuts[:e]):
            sub = unit[start:stop]
            if sub in lex.ids:
                step = lex.scores[lex.ids[sub]], (lex.ids[sub],)
            elif s == e - 1:
                step = lex.lowest, tuple(int(lex.byte_id[x]) for x in sub)
            else:
                continue
            found += [(a + step[0], p + step[1]) for a, p in paths[start]]
        paths[stop] = sorted(found, key=lambda x: -x[0])[:n]
    return paths[len(unit)]


def test_pieces_n_best_equals_brute_force(docs):
    lex = pieces.Lexicon(pieces.default_model())
    units = sorted({u for _, t in docs for u in pieces.text_units((t or "").encode())})[:1500]
    for unit, got in zip(units, pieces.search_units(units, lex, 3)):
        assert [x[0] for x in got] == pytest.approx([x[0] for x in best_paths(unit, lex, 3)])
        assert len({tuple(x[1]) for x in got}) == len(got)


def test_pieces_long_unit_equals_lattice():
    lex = pieces.Lexicon(pieces.default_model())
    rng = np.random.default_rng(1)
    for _ in range(30):
        unit = ("▁" + "".join(rng.choice(["the", "ing", "é", "中文", "x", "1", "ou", "😀"], int(rng.integers(1, 40))))).encode()
        lattice = pieces.Lattice([unit], lex)
        flat, _, total, loss = lattice.best_paths()
        ids, score, lost = pieces.LongUnit(unit, lex, 32).best_path()
        assert ids == flat.tolist() and score == pytest.approx(total[0]) and (lost == loss[0] or lost == pytest.approx(loss[0]))
        short, long_ = pieces._search(lattice, 3)[0], pieces.LongUnit(unit, lex, 32).search(3)
        assert [x[0] for x in short] == pytest.approx([x[0] for x in long_]) and short[0][1] == long_[0][1]


def test_pieces_whole_text(spark, docs, frame, empty):
    got = pieces.encode_documents(frame).collect()
    assert len(got) == len(docs) and all(r.decoded for r in got)
    for r in got:
        scores = [p.score for p in r.n_best]
        assert scores == sorted(scores, reverse=True) and scores[0] == pytest.approx(r.score)
    assert pieces.encode_documents(empty).collect() == []
    # Merging units' paths gives the N best of the whole lattice.
    lex = pieces.Lexicon(pieces.default_model())
    units = pieces.text_units("the theory of things".encode())
    merged = pieces.merge_paths(pieces.search_units(units, lex, 4), 4)
    whole = best_paths(b"".join(units), lex, 4)
    top = sum(a[0][0] for a in pieces.search_units(units, lex, 4))
    assert [top - lost for lost, _ in merged] == pytest.approx([s for s, _ in whole])


# --- 3: near-duplicates ---------------------------------------------------------------------

def shingles(text):
    w = words(text)
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_minhash_groups_equal_brute_force(spark, docs, frame, empty):
    got = minhash.near_duplicates(frame).collect()
    assert len(got) == len(docs)
    bags = [(i, shingles(t)) for i, t in docs]
    root = list(range(len(bags)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(bags)):
        for b in range(a):
            x, y = bags[a][1], bags[b][1]
            if x and y and sum((x & y).values()) >= 0.8 * sum((x | y).values()):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(bags):
        groups[find(k)].append(i)
    want = sorted((str(i), str(min((x for x in g if x is not None), default=None)), len(g)) for g in groups.values() for i in g)
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == want
    assert minhash.near_duplicates(empty).collect() == []
    kept = minhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert kept.count() == len(groups)


def test_minhash_links_chains_and_spread_groups(spark):
    """Windows of one word sequence: shifted by d of n shingles, two are (n - d) / (n + d) similar."""
    rng = np.random.default_rng(17)
    rows, want, n = [], [], 180

    def add(shifts):
        stem = [f"w{x}" for x in rng.integers(0, 10 ** 9, max(shifts) + n + 4)]
        first, group = len(rows), {}
        for i, s in enumerate(shifts):
            rows.append((first + i, " ".join(stem[s:s + n + 4])))
        for _ in shifts:  # closed by passing the smallest id along all links
            for i, s in enumerate(shifts):
                group[i] = min(group.get(j, j) for j, t in enumerate(shifts) if n - abs(s - t) >= 0.8 * (n + abs(s - t)))
        want.extend((first + i, first + group[i]) for i in range(len(shifts)))

    for _ in range(10):
        add([0, 16, 32, 48, 64])
    for _ in range(4):
        add([int(x) for x in rng.choice(np.arange(0, 140, 4), 16, replace=False)])
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = minhash.near_duplicates(frame).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == want


def test_minhash_keeps_pairs_at_the_threshold_with_a_low_estimate(spark):
    """Stems of these seeds give two texts of exactly 0.8 that agree in 174 to 181 of 250 coordinates."""
    rows = []
    for seed in (232, 391, 544, 717, 1890):
        stem = [f"w{x}" for x in np.random.default_rng(seed).integers(0, 10 ** 9, 204)]
        rows += [(2 * seed, " ".join(stem[:184])), (2 * seed + 1, " ".join(stem[20:]))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(i, i - i % 2) for i, _ in rows]


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    shared, one, two = (rng.integers(0, 2 ** 63, n).astype(np.uint64) for n in (300, 100, 100))
    cells = np.concatenate([shared, one, shared, two])
    doc = np.repeat([0, 1], 400)
    s = minhash.signatures(doc, cells, 2, 2000)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.05
    assert (minhash.signatures(np.zeros(1, int), shared[:1], 1, 125) != np.uint64(2 ** 64 - 1)).all()


# --- 4: repeated strings --------------------------------------------------------------------

def repeats_by_force(texts, width):
    count = Counter(t[p:p + width] for t in texts for p in range(len(t) - width + 1))
    for t in texts:
        edge = np.zeros(len(t) + 1, int)
        for p in range(len(t) - width + 1):
            if count[t[p:p + width]] > 1:
                edge[p] += 1
                edge[p + width] -= 1
        inside = np.cumsum(edge)[:-1] > 0
        kept = np.frombuffer(t, np.uint8)[~inside].tobytes()
        yield len(t), int(inside.sum()), int((np.diff(np.r_[0, inside, 0]) == 1).sum()), hashlib.sha256(kept).hexdigest()


def test_repeated_strings_equal_brute_force(spark, docs, empty):
    rng = np.random.default_rng(5)
    noise = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    passage, other = noise(900), noise(450)
    rows = docs[:40] + [(1, noise(200) + passage + noise(300)), (2, passage[100:700] + noise(50)), (3, noise(9) + other[:400]),
                        (4, other[:399]), (5, other), (6, "a" * 1500), (7, noise(300) + passage[450:] + other[30:] + noise(7)),
                        (None, passage), (8, None), (9, ""), (10, "ab" * 700 + "c")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long").repartition(4)
    got = suffix_dedup.remove_repeats(frame).collect()
    want = [(repr(i), *x) for (i, _), x in zip(rows, repeats_by_force([(t or "").encode() for _, t in rows], 400))]
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert suffix_dedup.remove_repeats(empty).collect() == []


# --- 6: language model ----------------------------------------------------------------------

@pytest.mark.parametrize("levels", [1, 2, 4])
def test_context_walk_in_blocks_equals_a_plain_one(monkeypatch, levels):
    monkeypatch.setattr(context_tree, "BLOCK", 7)
    rng, tree = np.random.default_rng(3), context_tree.Tree()
    tree.grow(np.zeros(5, np.int64), np.arange(5))   # not every byte is a context
    for _ in range(levels - 1):
        last = np.flatnonzero(tree.depth == tree.levels)
        tree.grow(*np.array([(n, b) for n in last for b in range(6) if rng.random() < 0.4], np.int64).T)
    whole = rng.integers(0, 7, 500).astype(np.uint8)
    at = np.flatnonzero(rng.random(len(whole)) < 0.9)
    at = at[at >= levels]
    want, full = [], []
    for i in at:
        node, d = 0, 0
        while d < levels and tree.next[node, whole[i - d - 1]]:
            node, d = int(tree.next[node, whole[i - d - 1]]), d + 1
        want.append(node)
        full.append(node if d == levels else 0)
    assert tree.deepest(whole, at).tolist() == want
    assert tree.deepest(whole, at, True).tolist() == full


def test_context_tree_base_and_probabilities(spark, docs, frame, empty):
    got = context_tree.score_documents(frame).collect()
    space = re.compile(r"[^\x20\x09-\x0D]+")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in docs if not held(i) for w in space.findall(lower(t)) + [None])
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in docs:
        w = space.findall(lower(t)) + [None]
        want.append((repr(i), held(i), len(w), sum(count[x] > 0 for x in w), n,
                     round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)))
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)
    assert context_tree.score_documents(empty).collect() == []


def test_context_tree_is_a_distribution_and_matches_recursion(spark):
    parent, depth = np.array([0, 0, 0, 1]), np.array([0, 1, 1, 2])
    zeros, ones = np.array([3.0, 0.0, 5.0, 9.0]), np.array([1.0, 2.0, 0.0, 4.0])

    def kt(a, b):
        return math.exp(math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1)) / math.pi

    def weighted(node, extra=None):
        below = [k for k in range(1, 4) if parent[k] == node]
        z = {k: zeros[k] for k in range(4)}
        o = {k: ones[k] for k in range(4)}
        if extra is not None:
            (z if extra[1] == 0 else o)[extra[0]] += 1

        def total(x, c):
            return c[x] + sum(total(k, c) for k in range(1, 4) if parent[k] == x)
        own = kt(total(node, z), total(node, o))
        if not below:
            return own
        return 0.5 * own + 0.5 * kt(z[node], o[node]) * math.prod(weighted(k, extra) for k in below)
    p = context_tree.weigh(parent, depth, zeros, ones)
    for node in range(4):
        assert p[node] == pytest.approx(weighted(0, (node, 1)) / weighted(0), rel=1e-6)
    model = context_tree.train(spark.createDataFrame([(1, "abracadabra " * 30)], "doc_id long, text string"))
    assert np.allclose((10.0 ** (model.steps / -model.STEPS)).sum(axis=1), 1, atol=2e-3) and model.tree.levels > 2


def mixture_by_force(training, texts, deepest):
    """log10 probabilities of texts by the mixture of all contexts that training texts hold."""
    def places(t):
        b = [255] * deepest + list(lower(t).encode()) + [255]
        return [(b[i], tuple(b[i - d] for d in range(1, deepest + 1))) for i in range(deepest, len(b))]

    def bits(byte):
        return [((256 | byte) >> (8 - k), byte >> (7 - k) & 1) for k in range(8)]
    count, longer = defaultdict(lambda: [0, 0]), defaultdict(set)
    for t in training:
        for byte, before in places(t):
            for q, bit in bits(byte):
                for d in range(deepest + 1):
                    count[before[:d], q][bit] += 1
                    if d:
                        longer[before[:d - 1], q].add(before[:d])
    kt = lambda z, o: math.lgamma(z + .5) + math.lgamma(o + .5) - math.lgamma(z + o + 1) - math.log(math.pi)
    kept = {}

    def weighted(ctx, q):
        if (ctx, q) not in kept:
            own = kt(*count[ctx, q])
            if len(ctx) == deepest:
                kept[ctx, q] = own, 1.0
            else:
                below = sum(weighted(c, q)[0] for c in longer[ctx, q])
                w = np.logaddexp(own, below) - math.log(2)
                kept[ctx, q] = w, math.exp(own - math.log(2) - w)
        return kept[ctx, q]

    def score(byte, before):
        total = 0.0
        for q, bit in bits(byte):
            mixed, left, p = 0.0, 1.0, 0.5
            for d in range(deepest + 1):
                if (before[:d], q) not in count:
                    break
                z, o = count[before[:d], q]
                own, stay = (o + .5) / (z + o + 1), weighted(before[:d], q)[1]
                p = mixed + left * own
                mixed, left = mixed + left * stay * own, left * (1 - stay)
            total += math.log10(p if bit else 1 - p)
        return total
    return [sum(score(*x) for x in places(t)) for t in texts]


@pytest.mark.parametrize("few", [True, False])
def test_context_tree_scores_equal_the_mixture_of_all_contexts(spark, docs, monkeypatch, few):
    rows = [(i, (t or "")[:300]) for i, t in docs[:25] + docs[-10:]] if few else docs[:2] + [(None, "ab" * 40), (5, None)]
    monkeypatch.setattr(context_tree, "CHUNK", 500)   # texts are taken in several parts
    learns = [t or "" for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    got = context_tree.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = mixture_by_force(learns, [t or "" for _, t in rows], context_tree.DEPTH)
    want = sorted((repr(i), x) for (i, _), x in zip(rows, want))
    assert len(got) == len(rows) and any(r.held_out for r in got)
    for r, (i, x) in zip(sorted(got, key=lambda r: (repr(r.doc_id), r.score)), want):
        # Each byte is rounded to 1/2000.
        assert repr(r.doc_id) == i and r.score == pytest.approx(x, abs=0.00025 * (r.score / -r.bits_per_byte * math.log2(10) + 1))


def test_context_tree_keeps_every_context(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(97, 123, 30_000))) for _ in range(4)]
    model = context_tree.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2))
    padded = ["\xff" * 6 + t + "\xff" for t in texts]
    held = Counter(t[i:i + 7] for t in padded for i in range(len(t) - 6))
    assert len(held) > 65_536
    kept = {}
    for r in model.counts.collect():
        some, times = context_tree._summed(r.some), context_tree._unplanes(r.times, np.int64)
        kept.update(((bytes(int(x).to_bytes(8, "big")[5::-1] + int(x).to_bytes(8, "big")[7:]).decode("latin1"), int(n))
                     for x, n in zip(some, times)))
    assert kept == held


def test_a_gathered_context_model_scores_as_the_shards_do(spark):
    learns, asked = "the cat sat on the mat. " * 3, b"the bat sat on a mat"
    model = context_tree.train(spark.createDataFrame([(1, learns)], "doc_id long, text string"))
    data, offsets = np.frombuffer(asked, np.uint8), np.array([0, len(asked)])
    plain = model.log10(*context_tree.whole_bytes(data, offsets, context_tree.DEPTH)).sum()
    assert plain == pytest.approx(mixture_by_force([learns], [asked.decode()], context_tree.DEPTH)[0], abs=0.01)


# --- 7: toxicity ----------------------------------------------------------------------------

def test_crf_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    emit, trans, start = rng.normal(size=(1, 5, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    marginal, pair, log_z = crf.forward_backward(emit, np.ones((1, 5), bool), trans, start)
    total, ones, pairs = 0.0, np.zeros(5), np.zeros((2, 2))
    for code in range(32):
        y = [code >> t & 1 for t in range(5)]
        w = math.exp(start[y[0]] + sum(emit[0, t, y[t]] for t in range(5)) + sum(trans[y[t], y[t + 1]] for t in range(4)))
        total += w
        ones += w * np.array(y)
        for t in range(4):
            pairs[y[t], y[t + 1]] += w
    assert log_z[0] == pytest.approx(math.log(total))
    assert marginal[0] == pytest.approx(ones / total)
    assert pair == pytest.approx(pairs / total)


def test_crf_learns_and_handles_edges(spark, empty):
    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(240):
        text = list(rng.choice(plain, 40))
        if i % 4 == 0:
            text[5] = "zorgling" + str(rng.choice(["", "s", "er", "ich"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    frame = spark.createDataFrame(rows + [(None, "zorgling you"), (900, None), (901, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (5000, 1), (7, None)], "doc_id long, toxic int")
    got = crf.annotate(frame, crf.train(frame, marks)).collect()
    by = {r.doc_id: r for r in got}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(by[i].score >= 0.5) == (i % 4 == 0) for i in held]) > 0.95
    assert by[900].score == by[901].score < 0.5 and by[901].spans == []
    spot = by[0].spans[0]
    assert rows[0][1][spot.start:spot.stop].startswith("zorgling")
    assert by[None].score >= 0.5
    one_class = crf.train(frame, marks.filter("toxic = 0"))
    assert {r.score for r in crf.annotate(frame, one_class).collect()} == {0.0}
    nothing = crf.train(empty, marks.filter("toxic > 5"))
    assert crf.annotate(empty, nothing).collect() == []


def test_crf_sample_is_bounded_in_bytes_and_null_ids_are_not_held_out(spark, tmp, monkeypatch):
    rows = [(i, ("bad word here " if i % 2 else "good plain text ") * 50) for i in range(40)] + [(None, "bad word here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    taken = []
    fit = crf.fit
    monkeypatch.setattr(crf, "fit", lambda texts, *a: taken.append(len(texts)) or fit(texts, *a))
    crf.train(docs, labels, sample_bytes=3 * len(rows[0][1]))
    crf.train(docs, labels)
    assert taken[0] <= 8 and taken[1] > 25
    docs.write.parquet(f"{tmp}/documents.parquet")
    labels.write.parquet(f"{tmp}/labels.parquet")
    got = {r.doc_id: r.held_out for r in crf.query(spark, tmp).collect()}
    assert got[None] is False and got[3] == (zlib.crc32(b"3") % 5 == 0)


def test_crf_capped_sample_keeps_class_shares(spark):
    rng = np.random.default_rng(6)
    plain = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(1600):  # one in eight is toxic, and half of those show it
        text = list(rng.choice(plain, 20))
        if i % 16 == 0:
            text[5] = "zorgling"
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 8 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    absent = [(i, 1) for i in range(5000, 8000)]
    model = crf.train(frame, spark.createDataFrame(labels + absent, "doc_id long, toxic int"), sample=80)
    by = {r.doc_id: r.score for r in crf.annotate(frame, model).collect()}
    assert abs(np.mean(list(by.values())) - 1 / 8) < 0.04
    assert by[16] > 0.8 and by[1] < 0.12


def test_crf_trains_on_the_last_lines_of_the_sample():
    rng = np.random.default_rng(8)
    plain = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(300)]
    line = lambda *extra: " ".join([*rng.choice(plain, 5), *extra])
    texts = ["\n".join(line("zorgling") for _ in range(25)) for _ in range(340)]
    texts += ["\n".join([line("mogwump"), line()]) for _ in range(200)] + ["\n".join(line() for _ in range(5)) for _ in range(1000)]
    model = crf.fit([t.encode() for t in texts], np.array([1] * 540 + [0] * 1000))
    assert model.weights[b"mogwump "] > 0
    top, _, _, _ = model.score([b"abc def ghi mogwump", b"abc def ghi zorgling", b"abc def ghi"])
    assert top[0] > 0.5 and top[1] > 0.5 and top[2] < 0.1


# --- 8: html --------------------------------------------------------------------------------

@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("plain &amp; simple", "plain & simple"),
    ("<nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>One, two,  three &lt;four&gt;.<p>Five<br>six</article><footer>foot</footer>",
     "Title One, two, three <four>. Five six"),
    ("<body><div class='sidebar'>Side text, side text</div><div id=content><p>Body, with <b>bold</b>text, and more of it, here.</p>"
     "<div class=ad>Buy</div><form>Mail<input></form><p>End.</p></div><div class='comments'><p>First, I say, no, yes, maybe!</p></div></body>",
     "Body, with boldtext, and more of it, here. End."),
    ("<article><div class='post-header'><h1>Head</h1></div><section><p>Long, long, long, and a longer part of it, on and on.</p>"
     "<p>More, of, it.</p></section><section><p>Short.</p></section><div class='post-footer'>Tags</div></article>",
     "Head Long, long, long, and a longer part of it, on and on. More, of, it. Short."),
    ("<main><script>var a='</p>';</script><style>p{}</style><p>Kept, &eacute;&#233;&#xe9;</p><aside>no</aside></main>", "Kept, ééé"),
])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


LONG = "One sentence, with commas, and enough words to count as text of an article. " * 3


@pytest.mark.parametrize("mark", ["class='content has-sidebar'", "class='post no-comments'", "class='article-body with-share'",
                                  "id='legal-article'", "class='has-sidebar'"])
def test_main_text_survives_an_unlikely_class(mark):
    page = f"<body><div class='sidebar'><p>Links here</p></div><div {mark}><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert html_text.main_text(page) == " ".join((LONG * 2).split())


COMMENTS = "".join(f"<p>Comment {i}: I, for one, do, or do not, agree with all of that, and I say so at length, here.</p>" for i in range(10))
SHORT = "A short post, with a comma, and not much more to say about it, really."


@pytest.mark.parametrize("page", [
    f"<body><div class='post'><p>{SHORT}</p></div><div class='comments'>{COMMENTS}</div></body>",
    f"<body><article><p>{SHORT}</p><section class='comments'>{COMMENTS}</section></article></body>",
    f"<body><article><p>{SHORT}</p></article><article class='comment'>{COMMENTS}</article></body>",
    f"<body><div class='post comments-open'><p>{SHORT}</p></div><ol class='comment-list'><li>{COMMENTS}</li></ol></body>",
    f"<body><div class='content'><p>{SHORT}</p></div><div class='promo content-block'><p>{LONG * 3}</p></div></body>",
    f"<body><div class='content'><p>{SHORT}</p><div class='newsletter article-inline'><p>{LONG}</p></div></div></body>",
    f"<body><main><p>{SHORT}</p><div class='post-ad'>{LONG}</div><div id='cookie-notice'><p>{LONG}</p></div></main></body>"])
def test_main_text_never_takes_back_comments_and_adverts(page):
    assert html_text.main_text(page) == SHORT


def test_main_text_keeps_several_articles():
    page = (f"<body><article><p>{SHORT}</p></article><article><h2>Second</h2><p>{LONG * 2}</p></article>"
            f"<article class='teaser'><a href='x'>Another article, elsewhere</a></article></body>")
    assert html_text.main_text(page) == " ".join(f"{SHORT} Second {LONG * 2}".split())


def test_main_text_edges(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    page = f"<article><p>{SHORT}</p></article>"
    rows = [(None, None, page, "x", "y"), (1, "u", None, "x", "y"), (1, "u", "", "x", "y"), (2, "u", page, "x", "y"), (2, "u", page, "x", "y")]
    got = html_text.extract_pages(spark.createDataFrame(rows, schema)).collect()
    assert sorted((repr(r.page_id), r.text) for r in got) == [("1", ""), ("1", ""), ("2", SHORT), ("2", SHORT), ("None", SHORT)]
    assert html_text.extract_pages(spark.createDataFrame([], schema)).collect() == []


def test_main_text_keeps_blocks_between_siblings():
    page = (f"<body><div><div>{f'<p>{LONG}</p>' * 8}</div><h2>Next part</h2><ul><li>one</li><li>two</li></ul>"
            f"<blockquote>short</blockquote><div><a href='x'>all links</a></div><p>{LONG}</p></div></body>")
    assert html_text.main_text(page) == " ".join((LONG * 8 + "Next part one two short " + LONG).split())


def test_html_pages_equal_article(spark, sf):
    import html
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    by_id = {r.page_id: r.html for r in pages.collect()}
    got = html_text.query(spark, sf).collect()
    assert len(got) == len(by_id)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", by_id[r.page_id], re.S)[1]
        blocks = re.sub(r"</?(?:p|h1)[^>]*>", "\0", inner).replace("<br>", " ").split("\0")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)


# --- 9: token files -------------------------------------------------------------------------

def test_token_files_equal_tokenizer(spark, docs, frame, empty, tmp):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(orc_tokens.default_tokenizer())
    orc_tokens.write_tokens(frame, f"{tmp}/t", partition_bytes=1 << 14)
    got = orc_tokens.with_starts(orc_tokens.read_tokens(spark, f"{tmp}/t")).collect()
    ids = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in docs]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((repr(i), len(x), crc(x)) for i, x in ids)
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id is not None for r in order] == sorted(r.doc_id is not None for r in order)
    assert [r.doc_id for r in order if r.doc_id is not None] == sorted(r.doc_id for r in order if r.doc_id is not None)
    assert [r.start for r in order] == np.cumsum([0] + [r.n_tokens for r in order])[:-1].tolist()
    one = orc_tokens.read_tokens(spark, f"{tmp}/t").filter("doc_id = 9005").collect()
    assert len(one) == 1 and one[0].ids[-1] == 2
    orc_tokens.write_tokens(empty, f"{tmp}/e")
    assert orc_tokens.with_starts(orc_tokens.read_tokens(spark, f"{tmp}/e")).collect() == []


def test_word_cache_keeps_odd_words():
    import random
    import pyarrow as pa
    encoder = orc_tokens.Encoder(orc_tokens.default_tokenizer(), cache=4)
    assert encoder.by_word
    texts = ["a b ́c", "İstanbul ΣΑΣ", "x<|endoftext|>y don't I'll", "\x1cfoo\x1dbar\x85z", "ÀÉ été, NO?!", "1234 ٣٤ ﬁ", "", None, " ",
             "ß ẞ ÿ Ÿ × ÷ a×b ªº µ", "a.b c., ..d e.f. !", "été ÉTÉ é́", " x　y z w v u t", "日本 語。", "É́"]
    rng = random.Random(1)
    texts += ["".join(rng.choice("aZé.,'ÉÞß×1 \n  ́中") for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    for some in ([t] for t in texts[:15]):
        assert encoder.encode(pa.array(some, pa.string()))[0].tolist() == encoder.tokenizer.encode(some[0] or "", add_special_tokens=False).ids
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_token_files_of_another_tokenizer(spark, docs, frame):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = orc_tokens.tokenize(frame, tokenizer=path).collect()
    assert sorted((repr(r.doc_id), r.ids) for r in got) == sorted(
        (repr(i), library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in docs)


def test_starts_are_places_in_the_files(spark, tmp):
    rows = [(5, f"{'word ' * k}text {k}") for k in range(1, 40)] + [(None, f"no id {k}, {'x ' * k}") for k in range(60)]
    rows += [(10**15, "one far id"), (6, ""), (6, None), (7, "same"), (7, "same"), (7, "same")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    orc_tokens.write_tokens(frame, f"{tmp}/t", partition_bytes=64)
    tokens = orc_tokens.read_tokens(spark, f"{tmp}/t")
    files = tokens.select("doc_id", F.size("ids").cast("long").alias("n"), F.col("_metadata.file_name").alias("f")).collect()
    assert len({r.f for r in files}) > 5  # rows without an id are in several files
    want, start = [], 0
    for f in sorted({r.f for r in files}):
        for r in (x for x in files if x.f == f):  # a file's rows come in its order
            want.append((r.doc_id, start, r.n))
            start += r.n
    got = orc_tokens.with_starts(tokens).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens) for r in got), key=lambda x: x[1:]) == sorted(want, key=lambda x: x[1:])
    ids = [i for i, _, _ in want]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and len(got) == len(rows)


# --- 10: lines ------------------------------------------------------------------------------

def test_line_dedup_equals_brute_force(spark, docs, frame, empty):
    got = line_dedup.dedup_lines(frame).collect()
    seen, want, done = {}, [], {}
    order = sorted(set(docs), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    for i, t in order:
        lines = [] if t is None else t.split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            win = tuple(lines[k:k + 3])
            if seen.setdefault(win, (i, t, k)) != (i, t, k):
                gone |= {k, k + 1, k + 2}
        done[i, t] = (len(lines), len(gone), sum(k - 1 not in gone for k in gone),
                      None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    want = [(repr(i), *done[i, t]) for i, t in docs]
    key = lambda x: (x[0], str(x[4]))
    assert sorted(((repr(r.doc_id), r.n_lines, r.n_removed, r.n_spans, r.kept_text) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.n_removed for r in got) > 0
    assert line_dedup.dedup_lines(empty).collect() == []


def test_line_dedup_plan_is_native(frame):
    plan = line_dedup.dedup_lines(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_crf_fit_gives_its_memory_back(spark, monkeypatch):
    def held():
        with open("/proc/self/status") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("VmRSS")) >> 10

    kept = []

    def fit(texts, labels, weight):
        small = [bytes(700) for _ in range(200_000)]  # 140 MB of the C library's own pieces
        kept.append(bytes(700))  # above them: without it they would go back by themselves
        del small
        return "a model"

    monkeypatch.setattr(crf, "fit", fit)
    docs = spark.createDataFrame([(i, "some text") for i in range(20)], "doc_id long, text string")
    before = held()
    assert crf.train(docs, docs.selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS toxic")) == "a model"
    assert held() - before < 60
