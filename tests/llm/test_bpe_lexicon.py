"""Lexicon encoding against the tokenizers library, and decoding."""
import hashlib
import json
import random
import re

import numpy as np
import pytest

pytest.importorskip("tarmac.llm.queries")

from tarmac.llm import bpe_lexicon as B  # noqa: E402

ODD = ["", " ", "  ", "\n", " \n x", "a  b", "a \n b", "tab\t\tx ", "it's we're I'll they've I'd I'm don't", "'s 's's ''s !'s '", "x'",
       "a'r a're a'rex 'l 'll 'lll’s", "<|endoftext|>", "a<|endoftext|>b <|endoftext|> <|endoftext|>", " <|endoftext|>\n", "<|endoftext",
       "|>x", "naïve café Ünï ß", "中文字符没有空格" * 300, "数123四５６", " x  y　", "é ̀x", "🙂🙂 🙂", "\x00\x01\x1c\x85z",
       "Ġ Ċ ĉ", "x" * 5000, " " * 700 + "end", "\n" * 300, "1234567890" * 40, "½ ² Ⅳ", "ՙՠࢵx\U0001f600\U00010400", "don'tcan'll'"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(B.default_tokenizer())


@pytest.fixture(scope="module")
def rows(spark, sf):
    rng = random.Random(3)
    letters = "ab 's'rel\n\t1½é中 .,<|> ̀🙂"
    found = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (7, None), (7, "same"), (7, "same")]
    return found + [(20_000 + i, "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))) for i in range(2000)]


def by_library(library, rows):
    out = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((repr(i), ids, library.decode(ids, skip_special_tokens=False)))
    return sorted(out)


def test_ids_and_texts_equal_the_library(spark, rows, library):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, ids int, word string").repartition(3)
    want = by_library(library, rows)
    for words in (3000, 1, 60_000):  # what the lexicon holds changes no id
        name = B.build_lexicon(frame, words=words)
        got = B.decode(B.encode(frame, name)).collect()
        assert sorted((repr(r.doc_id), r.ids, r.text) for r in got) == want
    got = B.encode(frame, name, decoded=True).collect()
    assert sorted((repr(r.doc_id), r.ids, r.text) for r in got) == want


def test_query_equals_the_library(spark, sf, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((int(i), len(ids), sha(",".join(map(str, ids))), sha(t)) for i, ids, t in by_library(library, rows))
    got = B.query(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(tuple(r) for r in got) == want


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    name = B.build_lexicon(empty)
    assert B.encode(empty, name).collect() == []
    one = spark.createDataFrame([(1, "unseen words only"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in B.decode(B.encode(one, name)).collect()} == {1: "unseen words only", 2: ""}
    ids = spark.createDataFrame([(1, [15496, 99_999_999, 995]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in B.decode(ids).collect()} == {1: "Hello world", 2: "", 3: ""}


def test_files_of_another_kind_are_refused(tmp_path):
    import public_tokenizers
    with pytest.raises(ValueError):
        B.Bpe(public_tokenizers.path("word_bpe_49k.json"))
    spec = json.load(open(B.default_tokenizer()))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "x.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        B.Bpe(str(tmp_path / "x.json"))


def test_automaton_is_minimal_and_numbers_its_words():
    rng = random.Random(5)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6))) for _ in range(300)} | {b"\x00", b"\xff\xff"})
    final, labels, targets, below, root = B.minimal_automaton(words)
    languages = {}

    def language(s):
        if s not in languages:
            languages[s] = frozenset(([b""] if final[s] else []) + [bytes([c]) + w for c, t in zip(labels[s], targets[s]) for w in language(t)])
        return languages[s]

    assert sorted(language(root)) == words
    # No two states accept the same rest: the automaton is minimal.
    assert len(set(map(language, range(len(final))))) == len(final)
    lexicon = B.Lexicon(B.Lexicon.compiled([(w, [k, k + 1]) for k, w in enumerate(words)]))
    tried = words + [b"abca" * 3, b"d", b"\xff"]
    bounds = np.cumsum([0] + [len(w) for w in tried])
    place = lexicon.places(np.frombuffer(b"".join(tried), np.uint8), bounds)
    assert place.tolist() == [words.index(w) if w in words else -1 for w in tried]


def test_merging_together_equals_merging_alone(rows):
    bpe = B.bpe_of(B.default_tokenizer())
    words = sorted({w for _, t in rows for w in re.findall(rb" ?\S+", (t or "").encode())})
    assert len(words) > 3000 and any(len(w) > 32 for w in words)
    assert [list(map(int, x)) for x in bpe.merge_together(words)] == [bpe.merge(w) for w in words]
