"""Collocations against brute force."""
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tarmac.llm.queries")

from tarmac.llm import collocations as C  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, part string"


def by_force(rows, least=10, share=50, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    counts[lang][tuple(w[i:i + n])] += 1
    out = []
    for lang, f in counts.items():
        long = [p for p in f if len(p) > 1 and f[p] >= least]
        inner = defaultdict(int)
        for p in long:
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    inner[q] = max(inner[q], f[p])
        found = []
        for p in long:
            if len(p) == 2 and 100 * inner[p] >= share * f[p]:
                continue
            s, k = min((10**6 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-s, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, le, r, total[lang], -s))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(C.query(spark, sf)) == by_force(rows)


@pytest.mark.parametrize("budget", [1 << 18, 400, 20])
def test_prefixes_over_the_budget_lose_nothing(spark, budget, monkeypatch):
    monkeypatch.setattr(C, "SLOTS", 1 << 10)
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(40)] + ["é", "中文", "\x01x"]
    weights = 1 / np.arange(1, len(vocab) + 1)
    rows = []
    for i in range(120):
        words = rng.choice(vocab, rng.integers(1, 60), p=weights / weights.sum())
        gaps = rng.choice([" ", "  ", "\t", ". ", "\n", ","], len(words), p=[.8, .05, .05, .04, .03, .03])
        rows.append((i, "".join(w.upper() + g if rng.random() < .1 else w + g for w, g in zip(words, gaps)), ["en", "de", None, "und"][i % 4]))
    rows += [(None, "very hot pair " * 400, "en"), (1, None, "en"), (2, "", None), (3, " \t.", "fr"), (4, "a b c " * 12, "fr"),
             (4, "a b c " * 12, "fr"), (5, "ÀB ÀB àB ÀB ÀB ÀB ÀB ÀB ÀB ÀB ÀB ÀB", "fr")]
    frame = spark.createDataFrame([(i, t, g, "p", 1, "x") for i, t, g in rows], SCHEMA).repartition(3)
    assert got(C.collocations(frame, budget=budget)) == by_force(rows)
    assert got(C.collocations(frame, budget=budget, least=3, share=80, top=7)) == by_force(rows, 3, 80, 7)


def test_scores_past_64_bits(spark):
    frame = spark.createDataFrame([(10**13, 10**13, 10**13 + 1), (3_000_000_019, 4_000_000_007, 5_000_000_029)], "a long, l long, r long")
    assert [r.s for r in frame.select(C.score("a", "l", "r").alias("s")).collect()] == [
        10**6 * a * a // (x * y) for a, x, y in ((10**13, 10**13, 10**13 + 1), (3_000_000_019, 4_000_000_007, 5_000_000_029))]


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
