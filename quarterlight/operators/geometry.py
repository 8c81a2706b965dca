"""Where things stand on a page: printed labels, table cells, ruling lines, and text laid out on a character grid.

A page is told by the columns `on`; its lines or glyphs come together in one array or window, so a page's work is one row's.
Boxes are structs (x0, y0, x1, y1), y growing downwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import ratio
from ..functions.text import RULE_LINE, map_level, match_key
from .grounding import box, contains_box, same_row, x_overlap

#: Season names as they head a table's columns or rows.
SEASON_NAMES = ("winter", "frühling", "fruehling", "sommer", "herbst")
#: Least score of a label, least length to be looked for inside a line, reach of a lone label and of one above, in points.
LABEL_RATIO, INSIDE, NEAR, BELOW = 92.0, 4, 20, 60
#: Least width of a ruling line, how far apart strokes of one line lie, least number of lines of a grid, height of its characters.
RULE_WIDTH, RULE_MERGE, RULE_COUNT, RULE_HEIGHT = 40.0, 2.0, 3, 4.0
#: Points a character of the grid is wide and high, and how far glyphs of a word and tops of a line may lie apart.
X_DENSITY, Y_DENSITY, X_GAP, Y_GAP = 4.0, 10.0, 3.0, 3.0


def page_lines(lines: DataFrame, on: list[str]) -> DataFrame:
    """on, and _lines: the page's lines (line_no, bbox, key, level, season) in reading order. Lines without text or box go."""
    key = match_key(F.coalesce("text", F.lit("")))
    told = lines.where(F.col("bbox").isNotNull()).select(*on, "line_no", "bbox", key.alias("key"), map_level(F.coalesce("text", F.lit(""))).alias("level"))
    one = F.struct("line_no", "bbox", "key", "level", F.col("key").isin(*SEASON_NAMES).alias("season"))
    return told.where("key <> ''").groupBy(*on).agg(F.sort_array(F.collect_list(one)).alias("_lines"))


def _around(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def label_hits(pages: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    """on, label and hits: the boxes where each label of labels (on, label) is printed on its page of page_lines().

    A line holds a label that it is like, or (from four characters on) that stands in it; two lines that follow
    each other hold one that runs over both, if all that stands inside their common box is like it. A label that is nowhere
    has no row. Labels meet the lines of their own page only, and scores are taken of pairs whose lengths allow them.
    """
    met = labels.select(*on, "label").distinct().withColumn("_key", match_key(F.col("label"))).where("_key <> ''").join(pages.hint("merge"), on)
    lone = F.transform("_lines", lambda x: F.struct(x["bbox"].alias("bbox"), x["key"].alias("key"), F.lit(False).alias("two")))
    nexts = F.arrays_zip(F.slice("_lines", 1, F.greatest(F.size("_lines") - 1, F.lit(0))).alias("a"), F.slice("_lines", 2, F.size("_lines")).alias("b"))
    boxes = F.transform(nexts, lambda p: _around(p["a"]["bbox"], p["b"]["bbox"]))
    inside = lambda b: F.array_join(F.transform(F.filter("_lines", lambda x: contains_box(b, x["bbox"])), lambda x: x["key"]), " ")
    pairs = F.transform(boxes, lambda b: F.struct(b.alias("bbox"), F.trim(inside(b)).alias("key"), F.lit(True).alias("two")))
    each = met.select(*on, "label", "_key", F.explode(F.concat(lone, pairs)).alias("_p")).select(*on, "label", "_key", "_p.*")
    n, m = F.length("_key"), F.length("key")
    within = ~F.col("two") & (n >= INSIDE) & F.contains("key", "_key")
    close = 200 * F.least(n, m) >= LABEL_RATIO * (n + m)
    alike = F.when(F.col("key") == F.col("_key"), 100.0).otherwise(ratio(F.when(close, F.col("key")), F.when(close, F.col("_key"))))
    return each.where(within | close).where(within | (alike >= LABEL_RATIO)).groupBy(*on, "label").agg(F.sort_array(F.collect_list("bbox")).alias("hits"))


def _middle(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def _row_level(cell: Column, lines: Column, hits: Column, claimed: Column) -> Column:
    """The level whose label, left of the cell and in the column of the claimed one's, is nearest by its middle; null
    if there is none, or if only the claimed one is there and not near."""
    reach = lambda b: (b["y0"] <= cell["y1"]) & (b["x1"] <= cell["x0"] + 1)
    far = lambda b: F.abs(_middle(b) - _middle(cell))
    own = F.transform(F.filter(hits, reach), lambda h: F.struct(far(h).alias("far"), claimed.alias("level")))
    other = F.filter(lines, lambda x: x["level"].isNotNull() & reach(x["bbox"]) & F.exists(hits, lambda h: x_overlap(x["bbox"], h)))
    all_ = F.concat(own, F.transform(other, lambda x: F.struct(far(x["bbox"]).alias("far"), x["level"].alias("level"))))
    best = F.array_min(all_)
    alone = F.forall(all_, lambda x: x["level"] == claimed)
    return F.when(F.size(all_) > 0, F.when(~alone | (best["far"] < NEAR), best["level"]))


def _aligned(cell: Column, lines: Column, levels: Column, seasons: Column, claimed: Column) -> Column:
    row = F.when(claimed.isNotNull(), _row_level(cell, lines, levels, claimed))
    above = F.array_max(F.transform(F.filter(levels, lambda b: b["y0"] <= cell["y0"] + 2), lambda b: b["y0"]))
    loose = F.exists(levels, lambda b: same_row(b, cell)) | F.coalesce(cell["y0"] - above < BELOW, F.lit(False))
    level_ok = F.when(row.isNotNull(), row == claimed).otherwise(loose)
    season_ok = F.exists(seasons, lambda b: same_row(b, cell) | (x_overlap(b, cell) & (b["y0"] < cell["y0"])))
    return (F.size(levels) > 0) & (F.size(seasons) > 0) & level_ok & season_ok


def _contradicted(cell: Column, lines: Column, seasons: Column, claimed: Column) -> Column:
    """Whether another season's name heads the cell's row, or else its column."""
    beside = F.filter(lines, lambda x: x["season"] & same_row(x["bbox"], cell) & (x["bbox"]["x1"] <= cell["x0"]))
    above = F.filter(lines, lambda x: x["season"] & (x["bbox"]["y0"] < cell["y0"]) & x_overlap(x["bbox"], cell))
    lowest = F.array_max(F.transform(above, lambda x: x["bbox"]["y0"]))
    nearest = F.get(F.filter(above, lambda x: x["bbox"]["y0"] == lowest), F.lit(0))["bbox"]  # the first in reading order
    here = F.exists(seasons, lambda s: (F.abs(nearest["x0"] - s["x0"]) < 2) & (F.abs(nearest["y0"] - s["y0"]) < 2))
    return F.when(F.size(beside) > 0, F.forall(beside, lambda x: x["key"] != claimed)).otherwise((F.size(above) > 0) & (F.size(seasons) > 0) & ~here)


def align_cells(claims: DataFrame, lines: DataFrame, on: list[str]) -> DataFrame:
    """on, value_id, aligned and bbox: whether a value stands in the cell of its row and column labels.

    claims: on, value_id, places (the boxes where its text is printed, best first), level_label, season_label; lines: on,
    line_no, text, bbox. aligned is true if the labels head one of the places (bbox is the first such), false if another
    season heads each of them, else null (bbox: the first place). Without a place or with a label missing it is null too. Claims of a
    page that has no lines stay, undecided. Claims are rows of their own, repeated or not.

    Pages, claims and a page's labels meet sorted by page: how many there are can't be told from their files, which a broadcast would go by.
    """
    pages = page_lines(lines, on)
    asked = claims.withColumn("_id", F.monotonically_increasing_id()).select(*on, "value_id", "places", "level_label", "season_label")
    labels = reduce(DataFrame.unionByName, [asked.select(*on, F.col(c).alias("label")).where(F.col(c).isNotNull()) for c in ("level_label", "season_label")])
    # A page's labels come in one row, so all that meets is dealt by page.
    hits = label_hits(pages, labels, on).groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("label", "hits"))).alias("_hits"))
    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    met = asked.join(pages.hint("merge"), on, "left").join(hits.hint("merge"), on, "left")
    for c in ("level", "season"):
        met = met.withColumn(f"_{c}", F.coalesce(F.col("_hits")[F.col(f"{c}_label")], none))
    met = met.withColumns({"_claimed": map_level(F.col("level_label")), "_key": match_key(F.col("season_label"))})
    lines_, levels, seasons = F.coalesce("_lines", F.filter("_lines", lambda x: F.lit(False))), F.col("_level"), F.col("_season")
    good = F.filter("places", lambda b: _aligned(b, lines_, levels, seasons, F.col("_claimed")))
    bad = F.forall("places", lambda b: _contradicted(b, lines_, seasons, F.col("_key")))
    full = (F.col("level_label") != "") & (F.col("season_label") != "") & (F.size("places") > 0) & F.col("_lines").isNotNull()
    aligned = F.when(full, F.when(F.size(good) > 0, True).when(bad, False))
    return met.select(*on, "value_id", aligned.alias("aligned"), F.when(aligned, F.get(good, F.lit(0))).otherwise(F.get("places", F.lit(0))).alias("bbox"))


def merge_rules(edges: DataFrame, on: list[str]) -> DataFrame:
    """on, rule_no, y, x0, x1: the horizontal ruling lines of edges (on, edge_no, orientation, x0, x1, top).

    Strokes of at least RULE_WIDTH are taken from the top; one that lies within RULE_MERGE of the last
    line's last stroke and touches its extent widens it, any other begins a line. Strokes without a place drop out.
    """
    wide = (F.col("orientation") == "h") & (F.col("x1") - F.col("x0") >= RULE_WIDTH) & F.col("top").isNotNull()
    place = F.struct(*[F.col(c).cast(t).alias(c) for c, t in (("top", "double"), ("edge_no", "long"), ("x0", "double"), ("x1", "double"))])
    strokes = edges.where(wide).groupBy(*on).agg(F.sort_array(F.collect_list(place)).alias("_s"))

    def rule(y, x0, x1, last):
        return F.struct(y.alias("y"), x0.alias("x0"), x1.alias("x1"), last.alias("last"))

    def fold(done, s):
        at = F.get(done, F.size(done) - 1)
        touches = (s["top"] - at["last"] <= RULE_MERGE) & (s["x0"] <= at["x1"] + 1) & (s["x1"] >= at["x0"] - 1)
        wider = rule(at["y"], F.least(at["x0"], s["x0"]), F.greatest(at["x1"], s["x1"]), s["top"])
        before = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(F.coalesce(touches, F.lit(False)), F.concat(before, F.array(wider))).otherwise(F.concat(done, F.array(rule(s["top"], s["x0"], s["x1"], s["top"]))))

    start = F.array().cast("array<struct<y:double,x0:double,x1:double,last:double>>")
    merged = strokes.select(*on, F.posexplode(F.aggregate("_s", start, fold)).alias("rule_no", "_r"))
    return merged.select(*on, "rule_no", "_r.y", "_r.x0", "_r.x1")


def rule_glyphs(rules: DataFrame, on: list[str], density: float = X_DENSITY) -> DataFrame:
    """Rows of RULE_LINE glyphs (on, text, x0, x1, top) along the lines of merge_rules(), for pages with at least RULE_COUNT of them."""
    of_page = Window.partitionBy(*on)
    grid = rules.withColumn("_n", F.count(F.lit(1)).over(of_page)).where(F.col("_n") >= RULE_COUNT)
    steps = F.greatest(F.ceil((F.col("x1") - 1 - F.col("x0")) / density), F.lit(0)).cast("int")
    each = grid.where(steps > 0).select(*on, "y", "x1", F.explode(F.transform(F.sequence(F.lit(0), steps - 1), lambda k: F.col("x0") + k * density)).alias("_x"))
    return each.select(*on, F.lit(RULE_LINE).alias("text"), F.col("_x").alias("x0"), F.least(F.col("_x") + density, F.col("x1")).alias("x1"), (F.col("y") - RULE_HEIGHT / 2).alias("top"))


def layout_text(glyphs: DataFrame, on: list[str], x_density: float = X_DENSITY, y_density: float = Y_DENSITY) -> DataFrame:
    """on and layout: the page's text on a grid of characters, so that columns stay columns.

    glyphs: on, text, x0, x1, top. Glyphs whose tops follow within Y_GAP are a line; in it those that follow within X_GAP without
    a blank are a word. A line stands on the row that its first top says, a word from the column on that its left edge says, both after what
    stands before, with a blank between words. Blank glyphs part words only; glyphs without text, x0 or top
    drop out, one without x1 has no width; equal places keep the order of x1, then text. Trailing blanks go, as does the page's common
    left margin; a page without glyphs has no row.
    """
    x1 = F.greatest(F.coalesce("x1", "x0"), F.col("x0"))
    g = glyphs.where((F.col("text") != "") & F.col("x0").isNotNull() & F.col("top").isNotNull()).select(*on, "text", *[c.cast("double").alias(n) for c, n in ((F.col("x0"), "x0"), (x1, "x1"), (F.col("top"), "top"))])
    down = Window.partitionBy(*on).orderBy("top", "x0", "x1", "text")
    new_line = F.coalesce((F.col("top") - F.lag("top").over(down) > Y_GAP).cast("int"), F.lit(0))
    g = g.withColumn("_line", F.sum(new_line).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy(*on, "_line").orderBy("x0", "x1", "text", "top")
    blank = F.trim("text") == ""
    apart = blank | F.coalesce(F.lag(blank).over(along), F.lit(True)) | (F.col("x0") - F.lag("x1").over(along) > X_GAP)
    g = g.withColumn("_word", F.sum(apart.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_blank", blank)
    # Blank glyphs count for the row a line stands on, not for its words.
    tops = g.groupBy(*on, "_line").agg(F.min("top").alias("_top"))
    in_word = F.sort_array(F.collect_list(F.struct("x0", "x1", "text")))
    words = g.where(~F.col("_blank")).groupBy(*on, "_line", "_word").agg(F.min("x0").alias("x0"), F.array_join(F.transform(in_word, lambda x: x["text"]), "").alias("text"))
    left = Window.partitionBy(*on)
    words = words.join(tops, [*on, "_line"]).withColumns({"_left": F.min("x0").over(left), "_first": F.min("_top").over(left)})
    line = F.sort_array(F.collect_list(F.struct("_word", F.round((F.col("x0") - F.col("_left")) / x_density).cast("int").alias("at"), "text")))
    rows = words.groupBy(*on, "_line", F.round((F.col("_top") - F.col("_first")) / y_density).cast("int").alias("_row")).agg(line.alias("_w"))

    def put(done, w):
        gap = F.greatest(F.least(F.length(done), F.lit(1)), w["at"] - F.length(done))
        return F.concat(done, F.repeat(F.lit(" "), gap), w["text"])

    rows = rows.withColumn("_text", F.aggregate("_w", F.lit(""), put))
    page = rows.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("_line", "_row", "_text"))).alias("_l"))

    def add(done, r):
        # done: rows used, and the text so far; a line takes a row of its own at least.
        gap = F.greatest((done["n"] > 0).cast("int"), r["_row"] - done["at"])
        return F.struct((done["n"] + 1).alias("n"), (done["at"] + gap).alias("at"), F.concat(done["text"], F.repeat(F.lit("\n"), gap), r["_text"]).alias("text"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit("").alias("text"))
    return page.select(*on, F.aggregate("_l", start, add)["text"].alias("layout"))
