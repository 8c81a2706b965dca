import random

import pytest

from quarterlight.functions import locate
from quarterlight.operators import grounding


def changed(rnd, text, share):
    out = list(text)
    for _ in range(int(share * len(text))):
        k = rnd.randrange(len(out))
        out[k : k + 1] = rnd.choice(["", "x", out[k] + "y"])
    return "".join(out)


def corpus(seed):
    rnd = random.Random(seed)
    syllables = ["an", "er", "ing", "tion", "the", "ou", "st", "re", "12", "7"]
    line = lambda n: " ".join("".join(rnd.choices(syllables, k=rnd.randint(1, 4))) for _ in range(n))
    quotes = [(i, line(rnd.choice([1, 2, 4, 9, 20, 30]))) for i in range(40)]
    pages = []
    for p in range(120):
        lines = [line(rnd.choice([1, 3, 10, 30])) for _ in range(rnd.choice([0, 1, 4]))]
        for _ in range(rnd.choice([0, 1, 2])):
            q = changed(rnd, rnd.choice(quotes)[1], rnd.choice([0, 0.03, 0.06, 0.1]))
            cut = rnd.randrange(len(q) + 1)
            lines.insert(rnd.randint(0, len(lines)), rnd.choice([q, q[:cut] + "\n" + q[cut:], line(5) + " " + q + " " + line(5), q[: int(0.9 * len(q))], q[2:], q[: len(q) // 2]]))
        pages.append((p, "\n".join(lines)))
    return quotes, pages


@pytest.mark.parametrize("seed", [1, 2])
def test_the_filter_loses_no_place(spark, seed):
    quotes, pages = corpus(seed)
    got = grounding.ground_everywhere(spark.createDataFrame(quotes, "quote_id long, quote string"), spark.createDataFrame(pages, "page_id long, text string"))
    got = sorted(map(tuple, got.collect()), key=str)
    lines = [(p, i, t) for p, text in pages for i, t in enumerate(text.split("\n"))]
    own = [(p, i, q) for p, _ in pages for i, q in quotes]
    want = grounding.ground_fuzzy(spark.createDataFrame(own, "page_id long, quote_id long, quote string"), spark.createDataFrame(lines, "page_id long, line_no int, text string"), ["page_id"])
    want = sorted(map(tuple, want.select("quote_id", "page_id", "line_no", "multiline", "score").collect()), key=str)
    assert got == want and len({g[2] is None for g in got}) == 2 and {g[3] for g in got} == {True, False} and any(g[4] < 100 for g in got)


def test_what_the_reference_scores(spark):
    quote = "hochlastzeitfenster im winter des jahres fuer die mittelspannung"
    assert [p[:2] for p in locate.places(quote, [(0, quote[:30]), (1, quote[31:])], [quote], quote)] == [(0, True)]
    assert locate.places(quote, [(0, quote[: int(0.9 * len(quote))])], [], "")[0][2] > 94
    assert locate.places("07:45-09:0", [(3, "x 07:45-09:0")], [], "") == [(3, False, 100.0)]
    assert locate.places("abcdefghijk", [(0, "abcdefghixjk")], [], "")[0][2] >= 90
    assert locate.places("hs/ms 30%", [(0, "hs/ms 20%")], [], "") == []
    three = [(0, quote[:20]), (1, quote[20:40]), (2, quote[40:])]
    assert locate.places(quote, three, [quote[:40], quote[20:]], quote) == [(None, False, 100.0)]


def test_a_changed_passage_in_another_document_is_found(spark):
    quote = "was st the thonen of in erntor er en therha onbleble athethndan and it and thhahaer inwhly"
    pages = [(1, "nothing of it\nat all"), (2, "first\nsome words " + quote.replace("therha", "tharha").replace("inwhly", "inwly") + " and on")]
    got = grounding.ground_everywhere(spark.createDataFrame([(5, quote)], "quote_id long, quote string"), spark.createDataFrame(pages, "page_id long, text string"))
    assert [(r.quote_id, r.page_id, r.line_no, r.multiline) for r in got.collect()] == [(5, 2, 1, False)]


def test_pieces_of_an_edited_quote_are_a_chain_and_scattered_ones_are_not():
    rnd = random.Random(5)
    for _ in range(200):
        q = [rnd.choice("abcdefghij") for _ in range(rnd.randrange(40, 200))]
        edits, places, at = int(0.2 * len(q) + 0.1), [], 0
        kinds = dict.fromkeys(rnd.sample(range(len(q)), rnd.randrange(edits + 1)))
        for i in range(len(q)):  # each place of kinds is a deletion, or an insertion before it
            if i in kinds and rnd.random() < 0.5:
                places.append(None)
                continue
            at += i in kinds
            places.append(at)
            at += 1
        whole = [i for i in range(0, len(q) - 3, 4) if places[i] is not None and all(places[i + k] == places[i] + k for k in range(4))]
        assert locate.chained(whole, [places[i] - i for i in whole], len(q), edits)
    offsets = list(range(0, 160, 4))
    assert locate.chained(offsets[::4], [0] * 10, 160, 32)
    assert not locate.chained(offsets[::4], [0, 28] * 5, 160, 32)
