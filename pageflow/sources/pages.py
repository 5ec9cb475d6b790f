"""Sources: page images in path order, page records, checkpoints, font files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import PAGE, STATE
from .kept import kept


def listing(spark: SparkSession, folder: str, batch: int = 50) -> DataFrame:
    """page (file name), path, page_no and batch_no of the files of a folder, in path order; no image is decoded.

    Pages are numbered by a range exchange and the sizes of its partitions, so no single task sees them all.
    """
    files = spark.read.format("binaryFile").load(folder).select("path")
    return numbered(files, "path").withColumn("page", F.element_at(F.split("path", "/"), -1)).withColumn("batch_no", F.floor((F.col("page_no") - 1) / batch))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with page_no, 1 for the first by `order`; the order has to be of distinct values for stable numbers.

    One range exchange puts the rows in order, and what place each has in which partition is written once, so that
    counting and numbering see the same partitions. The counts, one for each partition, are broadcast.
    """
    at = F.monotonically_increasing_id()  # partition, then place in it
    placed = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    placed = placed.withColumns({"_part": F.shiftright("_at", 33), "_own": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    return placed.join(F.broadcast(starts), "_part").withColumn("page_no", F.col("_own") + F.col("_before") + 1).drop("_at", "_part", "_own", "_before")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """page, path and image (BGR) of the images of a folder; what can't be decoded has image.height -1."""
    return spark.read.format("image").load(folder).select(F.element_at(F.split("image.origin", "/"), -1).alias("page"), F.col("image.origin").alias("path"), "image")


def decode_report(decoded: DataFrame, *by: str) -> DataFrame:
    """n, failed and the first three failed names (by, page, failed boolean); each task keeps three names a group at most."""
    rows = decoded.select("*", F.struct(F.lit(0).alias("_"), *by).alias("_by"))
    counts = rows.groupBy("_by").agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"))
    place = F.row_number().over(Window.partitionBy("_by").orderBy("page"))
    first = rows.filter("failed and page is not null").select("_by", "page").distinct().withColumn("_place", place).filter("_place <= 3")
    names = first.groupBy(F.col("_by").alias("_of")).agg(F.array_sort(F.collect_list("page")).alias("names"))
    every = counts.join(names, F.col("_by").eqNullSafe(F.col("_of")), "left")
    return every.select(*(f"_by.{c}" for c in by), "n", "failed", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def page_records(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Page records of a JSON array file or of line-delimited files. Missing lists are empty.

    With `lines` all files are line-delimited, as `sinks.write_records` makes them: they are read line by line and can be
    split. Otherwise each file is one row at first, since an array may hold records over several lines.
    Where a record has no font_char_ratio at all, the older font_stroke_ratio stands for it; a null stays null.
    """
    text = spark.read.text(path, wholetext=not lines)
    whole = F.from_json("value", "array<variant>")
    each = text.select(F.explode(F.when(F.ltrim("value").startswith("["), whole).otherwise(F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), F.parse_json))).alias("v"))
    raw = F.to_json("v")
    bubbles = F.from_json(F.get_json_object(raw, "$.speech_bubbles"), "array<struct<text_element: map<string, string>>>")
    free = F.from_json(F.get_json_object(raw, "$.freeform_texts"), "array<map<string, string>>")
    page = each.select(F.from_json(raw, PAGE).alias("p"), bubbles.alias("b"), free.alias("f"))

    def evolved(text, keys):
        return text.withField("font_char_ratio", F.when(F.map_contains_key(keys, "font_char_ratio"), text["font_char_ratio"]).otherwise(text["font_stroke_ratio"]))

    some = lambda c: F.coalesce(c, F.array())
    return page.select(
        "p.source_page",
        some(F.transform("p.speech_bubbles", lambda x, i: x.withField("text_element", evolved(x["text_element"], F.get("b", i)["text_element"])))).alias("speech_bubbles"),
        some(F.transform("p.freeform_texts", lambda x, i: evolved(x, F.get("f", i)))).alias("freeform_texts"),
    )


def elements(pages: DataFrame) -> DataFrame:
    """A row for each text of a page: source_page, kind (0 bubble, 1 free), ord, bubble_box, text."""
    bubbles = pages.select("source_page", F.lit(0).alias("kind"), F.posexplode("speech_bubbles").alias("ord", "x")).select("source_page", "kind", "ord", "x.bubble_box", F.col("x.text_element").alias("text"))
    free = pages.select("source_page", F.lit(1).alias("kind"), F.posexplode("freeform_texts").alias("ord", "text")).select("source_page", "kind", "ord", F.lit(None).cast("array<int>").alias("bubble_box"), "text")
    return bubbles.unionByName(free)


def completed(spark: SparkSession, path: str) -> DataFrame:
    """The completion table, empty where there is none yet."""
    return spark.read.schema(STATE).parquet(path) if _exists(spark, path) else spark.createDataFrame([], STATE)


def stored_records(spark: SparkSession, path: str) -> DataFrame:
    """The page records that a first pass wrote; none where it hasn't run yet."""
    if _exists(spark, path):
        return page_records(spark, path, lines=True)
    return spark.createDataFrame([], PAGE)


def one_image(spark: SparkSession, folder: str, page: str) -> DataFrame:
    """The image of one page, no other file being read; no row where the folder hasn't got it."""
    path = f"{folder.rstrip('/')}/{page}"
    return images(spark, path) if _exists(spark, path) else images(spark, folder).limit(0)


def finished_images(spark: SparkSession, skipped: DataFrame, folder: str) -> DataFrame:
    """Output images of skipped pages (column page) that an earlier run drew; what can't be decoded is left out."""
    return images(spark, folder).filter("image.height > 0").join(skipped.select("page").distinct(), "page", "left_semi")


def fonts(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the font files of a folder, in order."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{ttf,otf,ttc}").load(folder).select("path").orderBy("path")
