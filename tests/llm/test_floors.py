import numpy as np

from quarterlight.llm import quality


def test_fragments_and_repeated_lines_go(spark):
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join("".join(rng.choice(list("aeinorst"), int(rng.integers(2, 9)))) for _ in range(n))
    rows = [(i, "\n".join(prose(int(rng.integers(5, 15))) for _ in range(12)), "en", "s") for i in range(300)]
    # Tables of words and bars, and few lines again and again, each too short to repeat a window of eight words.
    rows += [(1000 + i, " | ".join(prose(120).split()), "en", "s") for i in range(10)]
    rows += [(2000, "\n".join(x for k in range(4) for x in (prose(6), "ab cd ef", "ab cd ef", "ab cd ef")), "en", "s")]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    assert got[got.doc_id < 1000].kept.all()
    assert not got[got.doc_id >= 1000].base_failed.all() and not got[got.doc_id >= 1000].kept.any()
