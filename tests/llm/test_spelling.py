"""Spelling variants against brute force."""
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tarmac.llm.queries")

from tarmac.llm import spelling  # noqa: E402

SCHEMA = "doc_id long, text string, word string, n string, form int"


def vocabulary_by_force(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def edits(word, letters):
    out = {word[:i] + word[i + 1:] for i in range(len(word))}
    for c in letters:
        out |= {word[:i] + c + word[i:] for i in range(len(word) + 1)}
        out |= {word[:i] + c + word[i + 1:] for i in range(len(word))}
    return out - {word}


def variants_by_force(vocab):
    letters = sorted(set("".join(vocab)))
    found = {}
    for w, n in vocab.items():
        near = [x for x in edits(w, letters) if x in vocab]
        best = min(near, key=lambda x: (-vocab[x], x), default=None)
        found[w] = (best if best and vocab[best] >= 5 * n else None, n, len(near))
    rows = set()
    for w, (form, n, n_near) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        rows.add((w, form, root, n, n_near, vocab[form] if form else None))
    return rows


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    vocab = vocabulary_by_force(rows)
    got = {tuple(r) for r in spelling.query(spark, sf).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == variants_by_force(vocab) and sum(r[1] is not None for r in got) > 0


@pytest.mark.parametrize("block_words, groups", [(2048, 1), (7, 1), (50, 3), (2048, 5)])
def test_blocks_and_cells_lose_no_pair(spark, block_words, groups):
    rng = np.random.default_rng(groups)
    base = ["".join(rng.choice(list("abcdeé"), rng.integers(6, 9))) for _ in range(120)]
    vocab = {}
    for w in base:
        vocab[w] = int(rng.integers(100, 3000))
        for x in rng.choice(sorted(edits(w, "abÿ")), 6):
            if len(x) >= 6:
                vocab[str(x)] = int(rng.integers(5, 60))
    vocab |= {"q" * 3000: 500, "q" * 2999 + "r": 9, "q" * 2999: 5, "aaaaaa": 7, "aaaaab": 7, "aaaaaaa": 7}
    frame = spark.createDataFrame(list(vocab.items()), "word string, n long").repartition(3)
    got = [tuple(r) for r in spelling.variants(frame, block_words=block_words, groups=groups).collect()]
    assert len(got) == len(vocab) and set(got) == variants_by_force(vocab)


def test_edges(spark):
    text = "Méthode École×x " * 3 + "ABCDEFG abcdefg, abcdefg;abcdefg\tabcdefg abcdefh"
    rows = [(None, text), (1, None), (2, ""), (3, text), (3, text), (3, "short"), (4, "abcdefh " * 6 + "abcdegh " * 40)]
    frame = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in rows], SCHEMA)
    words = spelling.vocabulary(frame)
    vocab = vocabulary_by_force(rows)
    assert {r.word: r.n for r in words.collect()} == vocab
    assert {tuple(r) for r in spelling.variants(words).collect()} == variants_by_force(vocab)
    nothing = spelling.vocabulary(frame.limit(0))
    assert nothing.count() == 0 and spelling.variants(nothing).collect() == []


def test_forms_chain_to_the_last(spark):
    vocab = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125}
    frame = spark.createDataFrame(list(vocab.items()), "word string, n long")
    assert {r.word: r.root for r in spelling.variants(frame).collect()} == dict.fromkeys(vocab, "aabbbb")


def test_one_edit_at_every_place():
    a = spelling.letter_numbers(["abcabc"] * 5)
    longer = spelling.letter_numbers(["xabcabc", "abcabcx", "abcxabc", "abccabx", "aabcabc"])
    assert spelling.one_edit(a, longer).tolist() == [True, True, True, False, True]
    equal = spelling.letter_numbers(["xbcabc", "abcabx", "abcabc", "xbcabx", "bacabc"])
    assert spelling.one_edit(a, equal).tolist() == [True, True, False, False, False]
