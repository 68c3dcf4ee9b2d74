"""KS p-values against counted paths, and how far the finite-size forms are off."""
import itertools
import math
from collections import Counter
from fractions import Fraction

import pytest

from tarmac.operators import ks_pvalue as P


def counted_paths(n, m):
    """How many of all orders of n and m rows have each value of the statistic."""
    out = Counter()
    for places in itertools.combinations(range(n + m), n):
        i, best = 0, Fraction(0)
        for t in range(1, n + m + 1):
            i += t - 1 in places
            best = max(best, abs(Fraction(i, n) - Fraction(t - i, m)))
        out[best] += 1
    return out


@pytest.mark.parametrize("n, m", [(1, 1), (1, 12), (2, 3), (4, 6), (5, 5), (7, 3), (8, 6), (9, 7), (6, 12)])
def test_lattice_equals_counted_paths(n, m):
    counts = counted_paths(n, m)
    for d in counts:
        want = sum(c for x, c in counts.items() if x >= d) / sum(counts.values())
        assert P.lattice_tail(n, m, float(d)) == pytest.approx(want, abs=1e-12)
        assert P.lattice_tail(m, n, float(d)) == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("n", [12, 100, 2000])
def test_lattice_equals_the_sum_for_equal_sizes(n):
    for h in {1, 2, round(math.sqrt(n)), round(2 * math.sqrt(n)), n}:
        want = 2 * sum((-1) ** (k - 1) * Fraction(math.comb(2 * n, n - k * h), math.comb(2 * n, n)) for k in range(1, n // h + 1))
        assert P.lattice_tail(n, n, h / n) == pytest.approx(min(1.0, float(want)), rel=1e-9)


def test_small_tails_keep_their_digits():
    assert P.lattice_tail(300, 300, 1.0) == pytest.approx(2 / math.comb(600, 300), rel=1e-9)
    assert P.lattice_tail(5, 9, 0.0) == 1.0


# At these sizes the expansion is off by less than this from the exact one-sample form, and the
# effective size (used above 10,000 rows alone) by less than that from the exact two-sample form.
@pytest.mark.parametrize("n, expansion, effective", [(30, 1e-4, 0.07), (100, 1e-5, 0.045), (10_000, 1e-9, 0.0045)])
def test_errors_of_the_finite_forms(n, expansion, effective):
    for t in (0.15, 0.3, 0.5, 0.8, 1.2, 2, 3.5):
        d = math.sqrt(t / n)
        assert abs(P.pelz_good_tail(n, d) - P.durbin_tail(n, d)) < expansion
        h = round(math.sqrt(2 * t * n))
        assert abs(P.one_sample_tail(n // 2, h / n) - P.lattice_tail(n, n, h / n)) < effective


def test_one_sided_sum_meets_the_matrix():
    for n in (20, 500):
        d = math.sqrt(4.2 / n)
        assert 2 * P.one_sided_tail(n, d) == pytest.approx(P.durbin_tail(n, d), rel=1e-8)
    assert P.one_sample_tail(10, 0.04) == 1.0 and P.one_sample_tail(10, 1.0) == 0.0


def test_column_form(spark):
    frame = spark.createDataFrame([(5, 9, 0.4), (50_000, 40_000, 0.008), (0, 3, 0.5), (3, 3, None)], "n long, m long, d double")
    got = [r.p for r in frame.select(P.p_value("n", "m", "d").alias("p")).collect()]
    assert got[:2] == [P.two_sample_tail(5, 9, 0.4), P.two_sample_tail(50_000, 40_000, 0.008)] and got[2:] == [None, None]
