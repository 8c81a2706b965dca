"""The scatter that texts' own lengths give: its size, that it is fixed, and that it decides, not the floors."""

import numpy as np

from quarterlight.llm import quality

DATA = "/root/testdata/sf0.01"


def test_errors_have_their_variance(spark):
    rows = [(i, 200, 1000, 0, 0, 20, 0) for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, _n_lines long, n_repeat_words long")
    out = quality.with_vector(df, quality.F.xxhash64("doc_id"))
    e = out.select(*quality.ERRORS).toPandas().to_numpy() / quality.SCALE
    want = np.sqrt([quality.LETTERS / 250, quality.CLUMP / 1000, 1 / 120, 2 * quality.CLUMP / 1000])
    assert np.allclose(e.std(axis=0), want, rtol=0.05) and np.abs(e.mean(axis=0) / want).max() < 0.05
    assert np.abs(np.corrcoef(e.T) - np.eye(4)).max() < 0.05
    assert np.allclose(np.percentile(e / want, [2.5, 97.5], axis=0), [[-1.96] * 4, [1.96] * 4], atol=0.12)
    again = quality.with_vector(df.repartition(7), quality.F.xxhash64("doc_id")).select("doc_id", *quality.ERRORS)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.select("doc_id", *quality.ERRORS).collect()))


def test_the_fitted_scatter_decides(spark):
    """With the floors alone in its place most verdicts of the outlier test would be others, and no good text goes with it."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stats = quality.cut(quality.measured(docs.select("doc_id", "text", "lang", "source"), quality.F.xxhash64("doc_id")).drop("text"))
    best, fits = quality.fit(stats)
    kept = quality.judge(stats, best, fits).select("doc_id", "base_failed", "kept").toPandas().set_index("doc_id")
    bare = best.withColumns({c: quality.F.lit(quality.FLOORS[0] if c[2:4] == c[4:6] else 0.0) for c in best.columns if c.startswith("l_")})
    other = quality.judge(stats, bare, fits).select("doc_id", "kept").toPandas().set_index("doc_id")
    judged = ~kept.base_failed
    assert (kept.kept != other.kept)[judged].mean() > 0.5
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas().set_index("doc_id")
    met = kept[judged].join(labels, how="inner")
    assert met[met.quality == 1].kept.all() and met[met.quality == 0].kept.mean() < 0.15
