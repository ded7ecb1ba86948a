"""Files as tables: text of unknown encoding, path lists, images, layouts of folders, CSV."""

from __future__ import annotations

import codecs
import locale

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.sources.text_lists import list_lines, natural_key

# What counts as an image; folders that aren't grids.
IMAGE_SUFFIXES = ("tif", "tiff", "png", "jpg", "jpeg", "img")
NOT_GRIDS = ("province_shp", "shp", "vector", "vectors")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, stem, suffix, length, modified) of all files under a folder. Contents
    aren't read: only the columns of the file list are selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    return files.select("path", name.alias("name"), stem.alias("stem"), suffix.alias("suffix"), "length", F.col("modificationTime").alias("modified"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """The images under a folder, by path."""
    return listing(spark, folder).where(F.col("suffix").isin(*IMAGE_SUFFIXES)).orderBy("path")


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """One row: number, bytes and latest change of all files under a folder."""
    return listing(spark, folder).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.max("modified").alias("modified"))


def encodings(data: bytes) -> list[str]:
    """Encodings to try, in order, each once."""
    names = ["utf-8-sig"] if data.startswith(codecs.BOM_UTF8) else []
    names += ["utf-16"] if data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)) else []
    names += ["utf-8-sig"] + (["utf-16", "utf-16-le", "utf-16-be"] if b"\x00" in data[:256] else [])
    names += ["gb18030", "gbk", locale.getpreferredencoding(False), "mbcs", "cp1252"]
    return list({x.casefold(): x for x in reversed(names) if x}.values())[::-1]


def decoded(data: bytes) -> tuple[str | None, str | None]:
    """Text and its encoding by the first that decodes strictly without NULs; else nulls."""
    for name in encodings(data):
        try:
            text = data.decode(name)
        except (LookupError, UnicodeError):
            continue
        if "\x00" not in text:
            return text, name
    return None, None


def texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(path, text, encoding) of text files, each decoded whole by its own encoding; null
    where none fits."""

    def run(batches):
        for b in batches:
            found = [decoded(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=["path", "text", "encoding"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInArrow(run, "path string, text string, encoding string")


def plain(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:/*(?=/)", "")


def path_list(spark: SparkSession, folder: str, roots: list[str] | None = None, require: bool = True, there: DataFrame | None = None) -> DataFrame:
    """(list, line_number, raw_value, path, found) of the path lists under a folder: a relative
    path is looked for beside its list, then under the roots in turn. there: (path) of the
    files that exist; without it, those under the folder and the roots. With `require`, lines
    whose file is missing are an error that names the first twenty."""
    lists = texts(spark, folder)
    broken = [r.path for r in lists.where("text IS NULL").select("path").limit(5).collect()]
    if broken:
        raise UnicodeError(f"no encoding fits {broken[0]}")
    lines = list_lines(lists, "path", "text").select(plain(F.col("path")).alias("list"), "line_number", F.col("entry").alias("raw_value"))
    if there is None:
        there = listing(spark, folder).select("path")
        for root in roots or []:
            there = there.unionByName(listing(spark, root).select("path"))
    held = there.select(plain(F.col("path")).alias("path")).distinct().withColumn("found", F.lit(True))
    absolute = F.col("raw_value").startswith("/")
    own = F.regexp_replace("list", r"/[^/]*$", "")
    tries = F.array(own, *[F.lit(r.rstrip("/")) for r in roots or []])
    candidates = F.when(absolute, F.array("raw_value")).otherwise(F.transform(tries, lambda r: F.concat_ws("/", r, F.col("raw_value"))))
    each = lines.select("*", F.posexplode(candidates).alias("place", "path")).join(held, "path", "left")
    first = F.min(F.struct(F.col("found").isNull(), "place", "path", "found")).alias("m")
    out = each.groupBy("list", "line_number", "raw_value").agg(first).select("list", "line_number", "raw_value", "m.path", F.coalesce("m.found", F.lit(False)).alias("found"))
    if require:
        missing = out.where(~F.col("found"))
        n = missing.count()
        if n:
            shown = [f"{r.list}:{r.line_number}: {r.raw_value}" for r in missing.orderBy("list", "line_number").limit(20).collect()]
            raise FileNotFoundError(f"{n} paths don't exist:\n" + "\n".join(shown))
    return out


def grid_periods(files: DataFrame, root: str) -> DataFrame:
    """(grid, period, source) of files (path) laid out as <grid>/<period>.txt, else
    <grid>/<period>.<image>, else <grid>/<period>/.../*.<image>: the first form that a period
    has counts. Hidden grids and folders of vectors don't. A grid of one period is an error."""
    rest = F.substring(plain(F.col("path")), F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    parts = F.split(rest, "/")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    image = suffix.isin(*IMAGE_SUFFIXES)
    rows = files.select(plain(F.col("path")).alias("path"), parts.alias("parts"), suffix.alias("suffix"), image.alias("image"))
    grid, depth = F.get("parts", F.lit(0)), F.size("parts")
    stem = F.regexp_replace(F.get("parts", F.lit(1)), r"(?<=.)\.[^.]+$", "")
    form = F.when((depth == 2) & (F.col("suffix") == "txt"), 0).when((depth == 2) & F.col("image"), 1).when((depth > 2) & F.col("image"), 2)
    folder = F.concat_ws("/", F.lit(root.rstrip("/")), grid, F.get("parts", F.lit(1)))
    named = rows.withColumn("form", form).where("form IS NOT NULL AND size(parts) > 1")
    named = named.select(grid.alias("grid"), F.when(F.col("form") < 2, stem).otherwise(F.get("parts", F.lit(1))).alias("period"), "form", F.when(F.col("form") < 2, F.col("path")).otherwise(folder).alias("source"))
    good = ~F.lower("grid").isin(*NOT_GRIDS) & ~F.col("grid").rlike(r"^[._]")
    best = named.where(good).groupBy("grid", "period").agg(F.min(F.struct("form", "source")).alias("m")).select("grid", "period", "m.source")
    alone = [r.grid for r in best.groupBy("grid").count().where("count < 2").orderBy("grid").limit(10).collect()]
    if alone:
        raise ValueError(f"grids of one period: {', '.join(alone)}")
    return best


def project_truths(truths: DataFrame, periods: DataFrame) -> DataFrame:
    """Truth files (area, path) named <before>_to_<after> whose periods are neighbours in the
    area's natural order of periods (area, period): area, before, after, path."""
    by = Window.partitionBy("area").orderBy(natural_key(F.col("period")))
    pairs = periods.withColumn("after", F.lead("period").over(by)).where("after IS NOT NULL").select("area", F.col("period").alias("before"), "after")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    named = truths.select("area", "path", F.regexp_extract(stem, r"(?i)^(.+?)_to_(.+)$", 1).alias("before"), F.regexp_extract(stem, r"(?i)^(.+?)_to_(.+)$", 2).alias("after"))
    return named.join(pairs, ["area", "before", "after"], "left_semi").select("area", "before", "after", "path")


def project(files: DataFrame, root: str) -> dict[str, DataFrame]:
    """boundaries (area, path), periods (area, period, path) and truths (area, before, after,
    path) of files (path) in the layout [<area>/]01_*/x.shp, 02_*/<period>.txt, 03_*/a_to_b.shp.
    Each area must have one boundary and two periods."""
    rest = F.split(F.substring(plain(F.col("path")), F.lit(len(root.rstrip("/")) + 2), F.length("path")), "/")
    rows = files.select(plain(F.col("path")).alias("path"), rest.alias("p"))
    flat = F.size("p") == 2
    name = F.element_at("p", -1)
    rows = rows.where((F.size("p") == 2) | (F.size("p") == 3)).select(F.when(flat, root.rstrip("/").rpartition("/")[2]).otherwise(F.get("p", F.lit(0))).alias("area"), F.element_at("p", -2).alias("kind"), name.alias("name"), "path")
    of = lambda prefix, suffix, *names: rows.where((F.col("kind").startswith(prefix) | F.lower("kind").isin(*names)) & F.lower("name").endswith(suffix))
    boundaries = of("01_", ".shp", "validation", "validation_area", "验证区").select("area", "path")
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    periods = of("02_", ".txt", "images", "imagery", "影像").select("area", stem.alias("period"), "path")
    n = boundaries.groupBy("area").count().withColumnRenamed("count", "b").join(periods.groupBy("area").agg(F.count("*").alias("p"), F.count_distinct("period").alias("d")), "area", "full")
    wrong = [r.area for r in n.where("coalesce(b, 0) <> 1 OR coalesce(p, 0) < 2 OR p <> d").orderBy("area").limit(10).collect()]
    if wrong:
        raise ValueError(f"areas need one boundary and two different periods: {', '.join(wrong)}")
    truths = of("03_", ".shp", "truth", "ground_truth", "变化真值").select("area", "path")
    return {"boundaries": boundaries, "periods": periods, "truths": project_truths(truths, periods)}


def csv_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a CSV file, all text, a byte order mark passed over; no rows, of the named
    columns, where the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    rows = spark.read.csv(path, header=True, inferSchema=False)
    first = rows.columns[0] if rows.columns else ""
    return rows.withColumnRenamed(first, first.lstrip("﻿")) if first.startswith("﻿") else rows


def mask_priority(name: Column, stem: Column) -> Column:
    """How well a mask's name fits an image's: its own with _mask, its own, one that begins so
    and ends in _mask, one that begins so and holds mask; 9 otherwise."""
    begins = name.startswith(stem)
    return F.when(name == F.concat(stem, F.lit("_mask")), 0).when(name == stem, 1).when(begins & name.endswith("_mask"), 2).when(begins & name.contains("mask"), 3).otherwise(9)


def image_jobs(pictures: DataFrame, graphs: DataFrame, masks: DataFrame, prefix: int = 1) -> DataFrame:
    """(stem, image, graph, mask) of pictures, graphs and masks (stem, path): the first graph
    of an image's stem, and of the masks whose name begins with it the best fitting. Images
    that lack either are left out. Names meet by their first `prefix` characters, then by the
    whole rule, so no image is held against all masks."""
    g = graphs.groupBy("stem").agg(F.min("path").alias("graph"))
    out = pictures.select("stem", F.col("path").alias("image")).join(g, "stem")
    head = lambda c: F.substring(c, 1, prefix)
    m = masks.select(F.col("stem").alias("name"), F.col("path").alias("mask"), head("stem").alias("head"))
    fits = F.col("name").startswith(F.col("stem")) & (F.lower("name").contains("mask") | (F.col("name") == F.col("stem")))
    met = out.withColumn("head", head("stem")).join(m, "head").where(fits)
    best = F.min(F.struct(mask_priority(F.col("name"), F.col("stem")).alias("p"), "mask")).getField("mask").alias("mask")
    return met.groupBy("stem", "image", "graph").agg(best)


def image_records(spark: SparkSession, folder: str, lists: str | None = None, mode: str = "auto") -> DataFrame:
    """(path, group) of images to work on: those under a folder (no group), or those of path
    lists, grouped by the list's name. auto takes the folder's, if it has any."""
    if mode not in ("auto", "img", "txt"):
        raise ValueError("mode is auto, img or txt")
    if mode == "auto":
        mode = "img" if exists(spark, folder) and not images(spark, folder).isEmpty() else "txt"
    if mode == "img":
        found = images(spark, folder).select(plain(F.col("path")).alias("path"), F.lit(None).cast("string").alias("group"))
    else:
        if not lists:
            raise FileNotFoundError(f"no images under {folder}, and no lists")
        group = F.regexp_replace(F.element_at(F.split("list", "/"), -1), r"\.[^.]+$", "")
        found = path_list(spark, lists, require=False).select("path", group.alias("group"))
    if found.isEmpty():
        raise FileNotFoundError(f"no images for mode {mode}")
    return found


def inference_batches(spark: SparkSession, folder: str = "", lists: str = "") -> DataFrame:
    """(batch, path) of inputs: one folder's images, or one batch for each path list under a
    folder, named by its place there. Exactly one of the two must be given."""
    if bool(folder.strip()) == bool(lists.strip()):
        raise ValueError("give either a folder or a folder of lists")
    if folder.strip():
        return images(spark, folder).select(F.lit("dir").alias("batch"), plain(F.col("path")).alias("path"))
    root = F.lit(len(lists.rstrip("/")) + 2)
    name = F.regexp_replace(F.regexp_replace(F.substring("list", root, F.length("list")), r"\.[^./]+$", ""), "/", "__")
    return path_list(spark, lists, require=False).select(name.alias("batch"), "path")


def graph_of(adjacency: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, y, x) and edges of an adjacency table (y, x, near: array of (y, x)):
    places rounded half to even, unordered different edges without loops. A node is named by
    its place, so no numbering of all nodes is needed."""
    at = lambda y, x: F.struct(F.rint(y).cast("long").alias("y"), F.rint(x).cast("long").alias("x"))
    rows = adjacency.select(at(F.col("y"), F.col("x")).alias("src"), F.transform("near", lambda n: at(n["y"], n["x"])).alias("near"))
    edges = rows.select("src", F.explode("near").alias("dst")).where("src <> dst")
    edges = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    nodes = rows.select("src").unionByName(rows.select(F.explode("near").alias("src"))).distinct().select(F.col("src").alias("node"), "src.y", "src.x")
    return nodes, edges


def ordered_lines(lines: DataFrame) -> DataFrame:
    """Lines of a period in a fixed order: by their box and length to three places, then by
    their points; each with its first valid width and confidence."""
    box = [F.round(f(a, b), 3) for f in (F.least, F.greatest) for a, b in (("x1", "x2"), ("y1", "y2"))]
    return lines.orderBy(*box, F.round(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), 3), "x1", "y1", "x2", "y2")

