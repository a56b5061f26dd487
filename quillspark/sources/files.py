"""Readers and writers of the file formats: PDF folders, chunk files, query sets, results."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T


def list_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(document, path, length) of a folder's files, by name; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(document_name(F.col("path")).alias("document"), "path", "length")


#: Files that a listing holds in the driver, about: some KB each while they are read.
LISTED = 20_000


@dataclass
class Group:
    """Paths that are listed at once; the bytes of their files, None if unknown."""

    paths: list[str]
    bytes: int | None


def listed_groups(spark: SparkSession, folder: str) -> list[Group]:
    """Paths that together hold the files of ``folder``, in groups of ``LISTED`` files: a reader's driver lists all that it loads.

    Folders are parted at their subfolders; one without any is a group by itself, however many
    files it has. Names that Spark's readers skip are left out.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):  # a pattern, or nothing: the reader's matter
        return [Group([folder], None)]
    paths: list[tuple[str, int, int]] = []

    def add(path, named: str) -> None:
        held = store.getContentSummary(path)
        if held.getFileCount() <= LISTED or held.getDirectoryCount() <= 1:
            paths.append((named, held.getFileCount(), held.getLength()))
            return
        for x in store.listStatus(path):
            name, own = x.getPath().getName(), x.getPath()
            if name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"):
                continue
            plain = re.sub(r"([{}\[\]*?\\])", r"\\\1", own.toString())
            add(own, plain) if x.isDirectory() else paths.append((plain, 1, x.getLen()))

    add(at, folder)
    groups, held = [Group([], 0)], 0
    for path, n, size in paths:
        if groups[-1].paths and held + n > LISTED:
            groups.append(Group([], 0))
            held = 0
        groups[-1].paths.append(path)
        groups[-1].bytes += size
        held += n
    return groups if groups[0].paths else [Group([folder], None)]


def document_name(path: Column) -> Column:
    """The stripped stem of a file's path."""
    return T.strip(F.regexp_extract(F.url_decode(path), r"([^/]+?)(?:\.[^./]*)?$", 1))


def read_pages(spark: SparkSession, folder: str, decoder, pattern: str = "*.pdf") -> DataFrame:
    """(document, page, line_no, line) by a pluggable Arrow UDF: binary -> array<array<string>>, pages of lines.

    A file that the decoder can't read should give null; it then has no lines.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    pages = files.select(document_name(F.col("path")).alias("document"), F.posexplode(decoder("content")).alias("page", "lines"))
    return pages.select("document", (F.col("page") + 1).alias("page"), F.posexplode("lines").alias("line_no", "line"))


def page_preview(lines: DataFrame, pages: int = 3, chars: int = 2000) -> DataFrame:
    """The start of each document's first pages."""
    head = lines.where(F.col("page") <= pages).groupBy("document").agg(F.array_sort(F.collect_list(F.struct("page", "line_no", "line"))).alias("x"))
    return head.select("document", F.left(F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit(chars)).alias("preview"))


def write_chunks(nested: DataFrame, folder: str) -> None:
    """One folder of JSON per document."""
    nested.write.partitionBy("document").json(folder)


def read_chunks(spark: SparkSession, *paths: str, multi_line: bool = False) -> DataFrame:
    """Chunk files with the law that the metadata names; a missing path is an error."""
    return spark.read.schema(schemas.CHUNKS).option("multiLine", multi_line).json(list(paths)).withColumn("law", T.short_law_name(F.col("metadata.law_name")))


def read_law_chunks(spark: SparkSession, paths: dict[str, str], multi_line: bool = False) -> DataFrame:
    """Chunk files of several laws, each from its own path and with the law it is read for: one union."""
    every = None
    for law, path in paths.items():
        own = spark.read.schema(schemas.CHUNKS).option("multiLine", multi_line).json(path).withColumn("law", F.lit(law))
        every = own if every is None else every.unionByName(own)
    return every


def read_checked_chunks(spark: SparkSession, *paths: str) -> DataFrame:
    """``read_chunks``, but an error where an id or a text is missing or an id is repeated."""
    chunks = read_chunks(spark, *paths)
    faults = chunk_file_faults(chunks).limit(5).collect()
    if faults:
        raise ValueError(f"chunk files with faults: {[tuple(f) for f in faults]}")
    return chunks


def chunk_file_faults(chunks: DataFrame) -> DataFrame:
    """(fault, id, n): ids that are missing or repeated, texts that are missing or empty."""
    no_id = chunks.where(F.coalesce("id", F.lit("")) == "").select(F.lit("no id").alias("fault"), F.lit("").alias("id"))
    no_text = chunks.where(T.strip(F.coalesce("text", F.lit(""))) == "").select(F.lit("no text").alias("fault"), F.coalesce("id", F.lit("")).alias("id"))
    twice = chunks.where("id <> ''").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated id").alias("fault"), "id", "n")
    return no_id.unionByName(no_text).groupBy("fault", "id").agg(F.count("*").alias("n")).unionByName(twice)


def read_queries(spark: SparkSession, path: str, multi_line: bool = False, checked: bool = False) -> DataFrame:
    """A query set; with ``checked`` an error where there is no query or a required field is missing or empty."""
    rows = spark.read.schema(schemas.QUERIES).option("multiLine", multi_line).json(path)
    if checked:
        lacking = F.array_compact(F.array(*(F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", F.lit(f)) for f in QUERY_FIELDS)))
        faults = rows.select("id", lacking.alias("fields")).where(F.size("fields") > 0).limit(5).collect()
        if faults or rows.isEmpty():
            raise ValueError(f"query set with missing fields: {[(r.id, r.fields) for r in faults]}" if faults else "empty query set")
    return rows


#: What each query of a set needs.
QUERY_FIELDS = ("id", "query", "expected_law", "expected_article", "expected_chunk_id")


def write_results(results: DataFrame, summary: DataFrame, folder: str) -> None:
    results.write.json(f"{folder}/results")
    summary.write.json(f"{folder}/summary")


def read_results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{folder}/results")
