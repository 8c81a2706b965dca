"""Centres, scatters and verdicts of the quality rules against minimum covariance determinants in NumPy."""

import math

import numpy as np
import pytest

from quarterlight.llm import quality

D = len(quality.STATS)


def brute_mcd(z):
    """Concentration steps to the end, from the whole group and from its medians; the smaller determinant."""
    floors = np.diag(np.square(quality.FLOORS))
    most = math.ceil(len(z) * quality.COVER)
    best = None
    for centre, scatter in ((z.mean(axis=0), np.cov(z.T, bias=True).reshape(D, D)), (np.median(z, axis=0), np.zeros((D, D)))):
        for _ in range(100):
            d = np.einsum("ij,jk,ik->i", z - centre, np.linalg.inv(scatter + floors), z - centre)
            near = z[np.argsort(d, kind="stable")[:most]]
            centre, scatter = near.mean(axis=0), np.cov(near.T, bias=True).reshape(D, D) * quality.CONSISTENCY
        size = np.linalg.slogdet(scatter + floors)[1]
        if best is None or size < best[0]:
            best = size, centre, scatter
    return len(z), best[1], best[2]


def filled(own, wide):
    n, m, c = own
    w = n / (n + quality.PRIOR_DOCUMENTS)
    d = m - wide[0]
    return w * m + (1 - w) * wide[0], w * c + (1 - w) * wide[1] + w * (1 - w) * np.outer(d, d)


@pytest.mark.parametrize("small", [1, 7, 40])
def test_estimates_and_verdicts_are_those_of_numpy(spark, small):
    rng = np.random.default_rng(small)
    groups = {("en", "big"): 900, ("en", "mid"): 150, ("en", "few"): small, (None, "few"): 60, ("de", None): small}
    rows, i = [], 0
    for k, ((lang, source), n) in enumerate(groups.items()):
        mix = rng.normal(size=(D, D)) * 0.4
        for _ in range(n):
            z = rng.normal(size=D) @ mix + k * 0.1
            if rng.random() < 0.1:
                z = z + 9 * rng.choice([-1, 1], D)
            rows.append((i, lang, source, i % 97 == 0, *(int(round(x * quality.SCALE)) for x in z)))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, base_failed boolean, " + ", ".join(f"{s} long" for s in quality.STATS))
    got = {r.doc_id: r for r in quality.judge(df, *quality.fit(df)).collect()}

    fine = [r for r in rows if not r[3]]
    z = lambda chosen: np.array([r[4:] for r in chosen], float) / quality.SCALE
    every = brute_mcd(z(fine))
    top = filled(every, (every[1], np.diag(np.square(quality.PRIOR_SPREAD))))
    agreed = near = 0
    for (lang, source) in groups:
        own = [r for r in fine if r[1:3] == (lang, source)]
        wide = filled(brute_mcd(z([r for r in fine if r[1] == lang])), top)
        centre, scatter = filled(brute_mcd(z(own)), wide)
        scatter = scatter + np.diag(np.square(quality.FLOORS))
        d = np.einsum("ij,jk,ik->i", z(own) - centre, np.linalg.inv(scatter), z(own) - centre)
        for r, want in zip(own, d, strict=True):
            agreed += got[r[0]].kept == (want <= quality.CUTOFF)
            near += abs(got[r[0]].distance2 - want) <= 0.3 * want + 0.3
    # Bins hold distances to a tenth, so a few documents at the edge of the nearest three quarters differ.
    assert agreed >= 0.99 * len(fine) and near >= 0.95 * len(fine)
    assert not any(got[r[0]].kept for r in rows if r[3])
