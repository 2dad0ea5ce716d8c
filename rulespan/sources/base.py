"""What the readers share: header contracts, missing values, whole files, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SourceError(ValueError):
    """A file that doesn't have the shape its reader asserts."""


def require(df: DataFrame, path: str, *columns: str | tuple[str, ...]) -> DataFrame:
    """``df`` if its header has every column, of a tuple at least one; else an error that names what was found."""
    missing = [c for c in columns if not ({c} if isinstance(c, str) else set(c)) & set(df.columns)]
    if missing:
        raise SourceError(f"{path}: no column {missing}; the header is {df.columns}")
    return df


def known(df: DataFrame, column: str) -> Column:
    """The column trimmed, null if blank; null as well where the header doesn't have it."""
    return F.nullif(F.trim(F.col(f"`{column}`")), F.lit("")) if column in df.columns else F.lit(None).cast("string")


def tsv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A tab-separated file with a header, in which quotes are plain characters."""
    return spark.read.csv(path, sep="\t", header=True, quote="\u0000", escape="\u0000", encoding=encoding, inferSchema=False, enforceSchema=False)


def whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, page): each file's text in one row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("page"))


def checksum(spark: SparkSession, paths: list[str]) -> str:
    """One SHA-256 over all files in the given order; folders by their files' names. Bytes are
    read in pieces through the file system of each path, not gathered."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    sink = jvm.java.io.OutputStream.nullOutputStream()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(conf)
        files = [at] if store.getFileStatus(at).isFile() else sorted((s.getPath() for s in store.listStatus(at)), key=lambda p: p.getName())
        for file in files:
            if file.getName()[0] in "._":
                continue
            stream = jvm.java.security.DigestInputStream(store.open(file), digest)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, sink, 1 << 20, False)
            stream.close()
    return bytes(b & 255 for b in digest.digest()).hex()
