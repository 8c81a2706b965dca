"""Sources and sinks: registry and labels from YAML, lock files, replayed answers, OCR pages, uploads and the mask's CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_object

REGISTRY = "id string, dso string, year int, url string, states array<string>, version_label string, notes string"
GOLDEN = "document string, labeled_by string, verified boolean, convention string, level string, season string, start_min int, end_min int"
EXTRACTION = """dso_name struct<value:string,page:int,quote:string>, validity_year struct<value:int,page:int,quote:string>,
publication_date struct<value:string,page:int,quote:string>, version_label struct<value:string,page:int,quote:string>,
correction_note struct<value:string,page:int,quote:string>,
convention struct<meter_label:string,page:int,quote:string,worked_example:struct<listed_start:string,first_timestamp:string>>,
levels_listed array<struct<label:string,page:int,quote:string>>,
windows array<struct<level_label:string,season_label:string,start:string,end:string,page:int,quote:string,quote_end:string,level_quote:string,season_quote:string>>,
empty_cells array<struct<level_label:string,season_label:string,page:int>>,
rules array<struct<kind:string,value:string,level_label:string,page:int,quote:string>>, anomalies array<string>"""
OCR = "md_results string, layout_details array<array<struct<index:int,label:string,bbox_2d:array<double>,content:string>>>, data_info struct<pages:array<struct<width:double,height:double>>>"
MAX_UPLOAD = 50_000_000


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of whole files, through Spark's reader, wherever they are."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("content"))


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """The hand-edited list of publications: one small YAML file with a list, or an object with one under entries."""
    import yaml

    said = yaml.safe_load(read_text_files(spark, path).first()["content"])
    found = said if isinstance(said, list) else next(v for v in said.values() if isinstance(v, list))
    names = [f.split()[0] for f in REGISTRY.split(", ")]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in found], REGISTRY)


def load_golden(spark: SparkSession, path: str, only_verified: bool = True) -> DataFrame:
    """A row for each labelled window of the YAML files at path; one without times for a cell labelled empty."""
    import yaml

    rows = []
    for f in read_text_files(spark, path).collect():  # hand-made labels
        doc = yaml.safe_load(f["content"])
        for cell in doc.get("cells") or []:
            for w in cell.get("windows") or [None]:
                minutes = [int(h) * 60 + int(m) for h, m in (t.strip().split(":") for t in w.split("-"))] if w else [None, None]
                rows.append((doc.get("document"), doc.get("labeled_by"), bool(doc.get("verified")), doc.get("convention"), cell.get("grid_level"), cell.get("season"), *minutes))
    out = spark.createDataFrame(rows, GOLDEN)
    return out.where("verified") if only_verified else out


def load_lock(spark: SparkSession, path: str) -> DataFrame:
    """id, sha256 and size of a lock file, a JSON object by id."""
    text = read_text_files(spark, path).select(F.from_json("content", "map<string,struct<sha256:string,size:bigint>>").alias("m"))
    return text.select(F.explode("m").alias("id", "v")).select("id", "v.sha256", "v.size")


def corpus(registry: DataFrame, lock: DataFrame, uploads: DataFrame) -> DataFrame:
    """Registered publications with their pinned hash, and uploads (id, dso, year, states, sha256)."""
    pinned = registry.join(lock.select("id", "sha256"), "id", "left").withColumn("upload", F.lit(False))
    return pinned.unionByName(uploads.withColumn("upload", F.lit(True)), allowMissingColumns=True)


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Recorded model answers (model, key, ...) with their extraction; what isn't an object has a null one."""
    raw = spark.read.json(path, multiLine=True)
    return raw.withColumn("extraction", json_object(F.col("response_text"), EXTRACTION))


def claimed_windows(extractions: DataFrame) -> DataFrame:
    return extractions.select("key", F.posexplode("extraction.windows").alias("position", "w")).select("key", "position", "w.*")


def ocr_lines(pages: DataFrame) -> DataFrame:
    """document_id, page, line_no, text and box of an OCR response; boxes that lie within 0 to 1 are scaled to the page."""
    p = pages.select("document_id", "page", "response", F.posexplode(F.flatten("response.layout_details")).alias("_n", "d"))
    width, height = (F.get(F.col("response.data_info.pages"), F.lit(0))[x] for x in ("width", "height"))
    small = F.array_max("d.bbox_2d") <= 1
    side = lambda k, full: F.get(F.col("d.bbox_2d"), F.lit(k)) * F.when(small, full).otherwise(1.0)
    p = p.withColumns({"x0": side(0, width), "y0": side(1, height), "x1": side(2, width), "y1": side(3, height)})
    return p.select("document_id", "page", "_n", F.posexplode(F.split("d.content", "\n")).alias("_k", "text"), "x0", "y0", "x1", "y1").where(F.trim("text") != "").withColumn("line_no", F.col("_n") * 1000 + F.col("_k")).drop("_n", "_k")


def tidy_layout(text: Column) -> Column:
    """Lines without trailing space and common indent, runs of blank lines as one, none outside."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.rtrim(x))
    indent = F.array_min(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.length(x) - F.length(F.ltrim(x))))
    cut = F.array_join(F.transform(lines, lambda x: F.substring(x, F.coalesce(indent, F.lit(0)) + 1, F.length(x))), "\n")
    return F.regexp_replace(F.regexp_replace(cut, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def upload_problem(content: Column, size: Column, most: int = MAX_UPLOAD) -> Column:
    """Why a file can't be an upload, null if it can: size, and the mark of a PDF in its first 1024 bytes."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    return F.when(size > most, "too large").when(~F.contains(head, F.lit("%PDF")), "no PDF")


def new_uploads(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """Uploads (sha256, year, states) that no known file equals, states in upper case, sorted, once each."""
    states = F.array_sort(F.array_distinct(F.transform("states", lambda s: F.upper(F.trim(s)))))
    fine = uploads.where(F.col("year").between(2000, 2100)).dropDuplicates(["sha256"])
    return fine.join(known.select("sha256"), "sha256", "left_anti").withColumn("states", states)


def known_by_hash(processed: DataFrame, uploads: DataFrame, lock: DataFrame) -> DataFrame:
    """sha256 and the id that has it: a processed document before an upload before a pinned publication."""
    each = [df.select("sha256", "id", F.lit(k).alias("_p")) for k, df in enumerate((processed, uploads, lock))]
    return each[0].unionByName(each[1]).unionByName(each[2]).groupBy("sha256").agg(F.min_by("id", F.struct("_p", "id")).alias("id"))


def write_mask_csv(mask: DataFrame, path: str) -> None:
    """A year's mask in order, with a header; one file a range of instants."""
    mask.orderBy("start_utc").write.csv(path, header=True)


def label_template(spark: SparkSession, levels: list[str]) -> DataFrame:
    seasons = F.array(*[F.lit(s) for s in ("winter", "spring", "summer", "autumn")])
    return spark.createDataFrame([(x,) for x in levels], "level string").select("level", F.explode(seasons).alias("season"))
