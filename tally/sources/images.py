"""Image-folder sources (S2-S4): manifests of files, not pixel decoding.

Decoding image codecs is out of scope; pixels enter as array columns (see
``operators.vectors``). A folder is listed with the ``binaryFile`` source, which
Spark distributes over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.operators import encode, splits


def resolve_path(root: str, rel: Column | str) -> Column:
    """Backslashes -> '/', joined under ``root``."""
    c = F.col(rel) if isinstance(rel, str) else rel
    return F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(c, r"\\", "/"))


def class_of(path: Column | str, depth_from_end: int = 2) -> Column:
    """Class name = the directory holding the file (second path element from the end)."""
    c = F.col(path) if isinstance(path, str) else path
    parts = F.split(F.regexp_replace(c, r"\\", "/"), "/")
    return F.element_at(parts, -depth_from_end)


def label_classes(manifest: DataFrame, class_col: str = "class", out: str = "label") -> DataFrame:
    """Label = index of the class name in sorted order (ImageFolder convention)."""
    return encode.label_encode(manifest.withColumn(out, F.col(class_col)), [out])


def read_image_folder(spark: SparkSession, root: str, with_content: bool = False,
                      pattern: str = "*") -> DataFrame:
    """List ``root/<class>/<file>`` recursively -> (path, class, label[, content])."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
          .option("pathGlobFilter", pattern).load(root))
    cols = [F.col("path"), class_of("path").alias("class")] + ([F.col("content")] if with_content else [])
    return label_classes(df.select(*cols))


def split_folder(files: DataFrame, root: str, class_col: str = "class", id_col: str = "id", content: str = "value",
                 test: float = 0.2, val: float = 0.1, seed: int = 42) -> None:
    """S3: split every class on its own (R2) and write the files' content below ``root/split=.../class=...``."""
    s = splits.per_class_split(files, class_col, id_col, test, val, seed)
    s.select(F.col(content).cast("string").alias("value"), "split", class_col).write.partitionBy("split", class_col).text(root)


def link_records(records: DataFrame, manifest: DataFrame, path_col: str = "path") -> tuple[DataFrame, DataFrame]:
    """Records -> files by resolved path; returns (linked rows, records whose file is missing)."""
    found = records.join(manifest.select(F.col(path_col).alias("_p")).distinct(),
                         records[path_col] == F.col("_p"), "left")
    linked = found.withColumn("found", F.col("_p").isNotNull()).drop("_p")
    missing = records.join(manifest.select(path_col).distinct(), path_col, "left_anti")
    return linked, missing
