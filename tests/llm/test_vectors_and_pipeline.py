"""Nearest neighbours against brute force; the pipeline's stages together."""
import math

import numpy as np
import pytest

pytest.importorskip("tarmac.llm.queries")

from pyspark.sql import functions as F  # noqa: E402

from tarmac.llm import hashing_index  # noqa: E402


def brute(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(np.array(v, np.float64))
    out = {}
    for q in good:
        if q % every == 0:
            x = min(good[q], key=lambda v: v.tolist())
            best = {i: max(float(x @ v / (np.linalg.norm(x) * np.linalg.norm(v))) for v in vs) for i, vs in good.items() if i != q}
            out[q] = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def test_nearest_edges_and_recall(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(600)]
    rows += [(600 + i, rows[0][1]) for i in range(7)]
    rows += [(None, rows[1][1]), (700, None), (701, [0.0] * 8), (702, [1.0, None] + [0.0] * 6), (703, [float("nan")] * 8),
             (704, [float("inf")] + [1.0] * 7), (705, [1.0, 2.0]), (0, rows[0][1]), (20, rows[21][1])]
    frame = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = {}
    for r in sorted(hashing_index.nearest(frame, F.col("vec_id") % 20 == 0).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows, 5, 20)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 5 * len(want)
    assert [i for i, _ in got[0]] == [600, 601, 602, 603, 604]
    for q in want:
        exact = dict(brute(rows, 10 ** 6, 20)[q])
        assert all(abs(exact[i] - s) < 1e-12 for i, s in got[q])


def test_nearest_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in hashing_index.nearest(few, F.col("vec_id") == 0).collect()]
    assert sorted(got) == [(0, 1, 4), (0, 2, 3)]
    assert hashing_index.nearest(few.limit(0), F.col("vec_id") == 0).collect() == []


def test_within_radius_is_complete():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (400, 4)).astype(np.uint8)
    part = hashing_index.Part(codes)
    for radius in (3, 9, 14):
        want = np.flatnonzero(hashing_index.POPCOUNT[codes ^ codes[0]].sum(axis=1) <= radius)
        assert part.within(codes[0], radius).tolist() == want.tolist()


def test_pipeline_stages(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    from tarmac.llm.inputs import table, written
    docs = table(spark, sf, "documents")
    seen = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = written(stage(spark, docs, sf), "test-pipeline")
        assert tuple(docs.columns) == pipeline.COLUMNS
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
        seen.append(docs.count())
        if name == "line_dedup":
            assert seen[-1] == seen[-2]
    assert seen[0] > seen[-1] > 0.5 * seen[0]
    last = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == seen[-1] and all(r.decoded for r in last)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)],
                                docs.schema)
    for _, stage in pipeline.STAGES[:-1]:
        odd = written(stage(spark, odd, sf), "test-pipeline")
    assert odd.count() == 3


def test_a_task_gives_its_memory_back():
    from tarmac.llm.inputs import giving_back

    def private_mb():
        with open("/proc/self/status") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("RssAnon")) >> 10

    last = []

    def run(batches):
        for batch in batches:
            held = [bytes(900) for _ in range(200_000)]
            last.append(held[-1])  # keeps the end of the heap in use
            yield batch

    before = private_mb()
    assert list(giving_back(run)([1, 2])) == [1, 2]
    assert private_mb() - before < 80


def test_padded_parts_do_not_change_marginals(monkeypatch):
    from tarmac.llm import crf
    texts = [b"foul words here\nand some more of them\n" * n + b"fine " * (40 - n) for n in range(1, 30)]
    scores = []
    for cells, known in ((crf.CELLS, crf.KNOWN), (50, 2)):
        monkeypatch.setattr(crf, "CELLS", cells)
        monkeypatch.setattr(crf, "KNOWN", known)
        tagger = crf.Tagger({b"foul ": 3.0, b"some ": 0.5}, -1.5, np.array([[0.2, -0.4], [-0.1, 0.3]]), np.array([0.1, -0.2]))
        top, total, _, found = tagger.score(texts)
        scores.append((top, total, np.concatenate(found)))
    assert all((a == b).all() for a, b in zip(*scores))
