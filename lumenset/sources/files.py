"""Files and images as tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenset.functions.images import laplacian_variance, perceptual_hash
from lumenset.operators.manifest import EXTENSIONS, base_name, is_image, parent_name, relative_source, stem, with_labels
from lumenset.operators.quality import aspect_ratio
from lumenset.operators.ranking import grouped_rank
from lumenset.sources.headers import read_header

#: Extensions in any mixture of cases.
_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in EXTENSIONS) + "}"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(``file``, ``size``) of all files below a folder, also those of no length, which Spark's readers leave out.

    The Hadoop file system lists them on the driver one by one into a local file table; use it for folders whose listing
    fits the driver (10 million files raise ValueError), and the readers below for content.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    if fs.exists(path):
        it = fs.listFiles(path, True)
        while it.hasNext():
            s = it.next()
            out.append((s.getPath().toUri().getPath(), s.getLen()))
            if len(out) > 10_000_000:
                raise ValueError("too many files for a listing on the driver")
    return spark.createDataFrame(out, "file string, size long")


def image_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``path``, ``length``, ``modificationTime``, ``content`` of files with an image extension in any case, below any of the roots."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _GLOB).load(roots)
    return raw.withColumn("path", F.regexp_replace("path", "^file:/*", "/")).where(is_image(F.col("path")))


def _header(content: Column) -> Column:
    """Format, width and height from the first bytes of PNG, JPEG, BMP, GIF-free formats; NULL where they can't be read."""
    @F.pandas_udf("format string, width int, height int")
    def read(c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_header(x) for x in c], columns=["format", "width", "height"]).astype({"width": "Int32", "height": "Int32"})

    return read(content)


def index(spark: SparkSession, roots: list[str], project_root: str, class_map: dict[str, str] | None = None) -> DataFrame:
    """The manifest of all images below the roots: sizes, format, digests, source and class. Unreadable images are left out.

    ``dataset_source`` is the root that holds the image, relative to the project. ``row_idx`` follows the order of path.
    """
    files = image_files(spark, roots)
    source = F.lit(None).cast("string")
    for r in sorted(roots, key=len):
        prefix = r.rstrip("/").removeprefix("file://") + "/"
        source = F.when(F.col("path").startswith(prefix), relative_source(F.lit(prefix.rstrip("/")), project_root)).otherwise(source)
    # Headers mostly lie in the first bytes, so only these go to Python; whole files follow where they did not hold the size.
    seen = files.withColumn("first", _header(F.substring("content", 1, 65536)))
    again = _header(F.when(F.col("first.width").isNull() & (F.col("length") > 65536), F.col("content")))
    rows = seen.withColumn("h", F.when(F.col("first.width").isNotNull(), F.col("first")).otherwise(again)).where("h.width > 0 and h.height > 0")
    rows = rows.select(
        relative_source(F.col("path"), project_root).alias("path"), source.alias("dataset_source"), F.col("h.width").alias("width"), F.col("h.height").alias("height"),
        aspect_ratio(F.col("h.width"), F.col("h.height")).alias("aspect_ratio"), F.col("h.format").alias("format"), F.col("length").alias("file_size_bytes"),
        F.md5("content").alias("md5_hash"), F.sha2("content", 256).alias("sha256"), F.lit(None).cast("double").alias("quality_score"), F.lit(None).cast("string").alias("phash"),
    )
    rows = with_labels(rows.dropDuplicates(["path"]), class_map)
    return grouped_rank(rows, [], [F.col("path")], "row_idx").withColumn("row_idx", F.col("row_idx") - 1)


def class_folders(spark: SparkSession, root: str, only_images: bool = True) -> DataFrame:
    """(``path``, ``label_name``, ``label``) of images in class folders; the label is the folder's place in name order."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    if only_images:
        found = found.where(is_image(F.col("path")))
    found = found.withColumn("label_name", parent_name(F.col("path")))
    names = grouped_rank(found.select("label_name").distinct(), [], [F.col("label_name")], "n").select("label_name", (F.col("n") - 1).cast("int").alias("label"))
    return found.join(names, "label_name").select("path", "label_name", "label")


def class_counts(files: DataFrame, labels: list[str]) -> DataFrame:
    """(``label_name``, ``n``) for each label, also those without a file."""
    every = files.sparkSession.createDataFrame([(x,) for x in labels], "label_name string")
    counts = files.groupBy("label_name").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "label_name", "left").select("label_name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """(``path``, ``height``, ``width``, ``channels``, ``data``): bytes in red, green, blue order; files that can't be decoded are left out."""
    img = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*").where("width > 0 and height > 0")

    @F.pandas_udf("array<double>")
    def ordered(data: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        for d, c in zip(data, channels):
            a = np.frombuffer(d, np.uint8).reshape(-1, max(1, int(c))).astype(float)
            out.append((a[:, [2, 1, 0, *range(3, a.shape[1])]] if a.shape[1] >= 3 else a).ravel())
        return pd.Series(out)

    return img.select(F.regexp_replace("origin", "^file:/*", "/").alias("path"), "height", "width", F.col("nChannels").alias("channels"), ordered("data", "nChannels").alias("data"))


def blur_and_hash(spark: SparkSession, path: str) -> DataFrame:
    """(``path``, ``blur_score``, ``seen_hash``) of every image that can be decoded: its bytes go to Python once and two values come back."""
    img = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*").where("width > 0 and height > 0")

    @F.pandas_udf("blur_score double, seen_hash string")
    def seen(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
        out = []
        for d, h, w, c in zip(data, height, width, channels):
            a = np.frombuffer(d, np.uint8).reshape(int(h), int(w), max(1, int(c))).astype(float)
            plane = 0.299 * a[:, :, 2] + 0.587 * a[:, :, 1] + 0.114 * a[:, :, 0] if a.shape[2] >= 3 else a[:, :, 0]  # stored blue first
            out.append((laplacian_variance(plane), perceptual_hash(plane)))
        return pd.DataFrame(out, columns=["blur_score", "seen_hash"])

    return img.select(F.regexp_replace("origin", "^file:/*", "/").alias("path"), seen("data", "height", "width", "nChannels").alias("s")).select("path", "s.*")


def readable_formats(spark: SparkSession) -> list[str]:
    """Upper-case names of the formats that ``pixels`` can decode: those the JVM's ImageIO has readers for (a stock one has none for WEBP)."""
    return sorted({str(x).upper() for x in spark._jvm.javax.imageio.ImageIO.getReaderFormatNames()})


def grey(data: Column, channels: Column) -> Column:
    """Luma plane of interleaved pixels."""
    n = (F.size(data) / channels).cast("int")
    at = lambda i, c: F.get(data, i * channels + c)
    plane = F.transform(F.sequence(F.lit(0), n - 1), lambda i: 0.299 * at(i, 0) + 0.587 * at(i, 1) + 0.114 * at(i, 2))
    return F.when(channels >= 3, plane).otherwise(data)


def unreadable(spark: SparkSession, root: str) -> DataFrame:
    """(``path``, ``reason``): images that can't be decoded or don't have three channels. Nothing is deleted."""
    img = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", _GLOB).load(root).select("image.*")
    return img.where("width <= 0 or nChannels <> 3").select(F.regexp_replace("origin", "^file:/*", "/").alias("path"), F.when(F.col("width") <= 0, "unreadable").otherwise("channels").alias("reason"))


def file_health(rows: DataFrame, files: DataFrame, key: str = "export_path") -> DataFrame:
    """(``key``, ``state``): ``missing`` or ``zero_byte`` rows against a ``listing``."""
    joined = rows.select(key).distinct().join(files.withColumnRenamed("file", key), key, "left")
    return joined.select(key, F.when(F.col("size").isNull(), "missing").when(F.col("size") == 0, "zero_byte").alias("state")).where("state is not null")


def export_states(rows: DataFrame) -> DataFrame:
    """(``export_path``, ``state``) of each row with an export path, looked up now in tasks (local or mounted paths).

    States: ok, missing, zero_byte, unreadable (it cannot be read to its end), changed (its length or, where the manifest has one,
    its SHA-256 is another).
    """

    def one(path: str, length: int | None, digest: str | None) -> str:
        import hashlib
        import os

        if not os.path.isfile(path):
            return "missing"
        try:
            if (size := os.path.getsize(path)) == 0:
                return "zero_byte"
            with open(path, "rb") as f:
                got = hashlib.file_digest(f, "sha256").hexdigest()
        except OSError:
            return "unreadable"
        return "changed" if length not in (None, size) or digest not in (None, got) else "ok"

    def run(frames):
        for pdf in frames:
            length = [None if pd.isna(x) else int(x) for x in pdf["file_size_bytes"]]
            yield pd.DataFrame({"export_path": pdf["export_path"], "state": [one(p, n, d or None) for p, n, d in zip(pdf["export_path"], length, pdf["digest"])]})

    wanted = rows.where("trim(export_path) <> ''").select("export_path", "file_size_bytes", F.lower(F.trim("sha256")).alias("digest"))
    return wanted.mapInPandas(run, "export_path string, state string")


def frame_names(videos: DataFrame, per_video: int) -> DataFrame:
    """(``video``, ``frame``, ``name``) of evenly spaced frames; ``videos`` has ``video`` and ``total``."""
    from lumenset.operators.sample import even_indices

    out = videos.select("video", F.explode(even_indices(F.col("total"), per_video)).alias("frame"))
    return out.withColumn("name", F.concat(stem(base_name(F.col("video"))), F.lit("_"), F.lpad(F.col("frame").cast("string"), 6, "0"), F.lit(".jpg")))


IMAGE_SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("plane", T.ArrayType(T.DoubleType()))])
