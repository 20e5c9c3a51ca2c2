"""Inventory of archive files: members, fingerprints and the metadata member."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions import text as tx
from boxloom.operators import jobs

MEMBER_SCHEMA = "book_id string, name string, size bigint, is_dir boolean, code string"
XML_SCHEMA = "Title array<string>, _bad string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, size, content); one row per archive."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{cbz,zip,CBZ,ZIP}").load(path)
    return files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "").alias("book_id"), F.col("length").alias("size"), "content")


def _open(content: bytes) -> zipfile.ZipFile | None:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, ValueError, OSError):
        return None


def archive_members(archives: DataFrame) -> DataFrame:
    """Members of each archive from its directory, classified; an unreadable archive is one row with a code."""
    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for book, content in zip(batch["book_id"], batch["content"]):
                archive = _open(content)
                if archive is None:
                    yield pd.DataFrame([[book, None, None, None, "not_a_zip"]], columns=["book_id", "name", "size", "is_dir", "code"])
                    continue
                infos = archive.infolist()
                yield pd.DataFrame({"book_id": book, "name": [i.filename for i in infos], "size": [i.file_size for i in infos],
                                    "is_dir": [i.is_dir() for i in infos], "code": [None] * len(infos)})
    return jobs.classify_members(archives.select("book_id", "content").mapInPandas(listing, MEMBER_SCHEMA))


def fingerprints(archives: DataFrame) -> DataFrame:
    """sha256, size and number of image pages of each archive."""
    images = archive_members(archives).where("kind = 'image'").groupBy("book_id").agg(F.count(F.lit(1)).alias("page_count"))
    hashed = archives.select("book_id", F.sha2("content", 256).alias("sha256"), "size")
    return hashed.join(images, "book_id", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0).cast("bigint")))


def metadata_members(archives: DataFrame) -> DataFrame:
    """Text of the first comicinfo.xml (in any case) of each archive: (book_id, xml)."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for book, content in zip(batch["book_id"], batch["content"]):
                archive, text = _open(content), None
                named = [] if archive is None else [
                    i for i in archive.infolist() if i.filename.replace("\\", "/").rsplit("/", 1)[-1].casefold() == "comicinfo.xml"]
                if named:
                    try:
                        text = archive.read(named[0]).decode("utf-8-sig", "replace")
                    except (zipfile.BadZipFile, OSError, ValueError, RuntimeError):
                        text = None
                yield pd.DataFrame({"book_id": [book], "xml": [text]})
    return archives.select("book_id", "content").mapInPandas(read, "book_id string, xml string")


def xml_title(xml: Column) -> Column:
    """First non-blank Title of a metadata document; empty for anything that cannot be read."""
    read = F.from_xml(F.coalesce(xml, F.lit("<x/>")), XML_SCHEMA, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "ignoreNamespace": "true"})
    titles = F.filter(F.transform(read["Title"], tx.strip), lambda t: t != "")
    return F.coalesce(F.when(read["_bad"].isNull(), F.try_element_at(titles, F.lit(1))), F.lit(""))


def metadata_titles(archives: DataFrame) -> DataFrame:
    return metadata_members(archives).select("book_id", xml_title(F.col("xml")).alias("title"))


def metadata_xml(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Metadata rows (keys.., tag, value) as one document per key, elements in tag order."""
    def escaped(value: Column) -> Column:
        out = F.coalesce(value, F.lit(""))
        for char, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            out = F.replace(out, F.lit(char), F.lit(code))
        return out

    element = F.concat(F.lit("<"), "tag", F.lit(">"), escaped(F.col("value")), F.lit("</"), "tag", F.lit(">"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tag", element.alias("e")))), lambda x: x["e"]), "")
    return elements.groupBy(*keys).agg(F.concat(F.lit("<ComicInfo>"), body, F.lit("</ComicInfo>")).alias("xml"))
