"""Readers and writers of documents and graphs in files."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.operators.graph import ordered_index
from kgloom.sources import sinks


def discover(spark: SparkSession, path: str, pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """``(doc, path, content)`` of files; contents are only read by plans that use them."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", "")
    return rows.select(stem.alias("doc"), "path", "content")


#: content -> [(page text, image bytes or None)]; readers for formats are plugged in, as no PDF library is assumed.
PageReader = Callable[[bytes], list[tuple[str, bytes | None]]]


def text_pages(content: bytes) -> list[tuple[str, bytes | None]]:
    """Pages of plain text, which form feeds part.  A PDF isn't text and is refused."""
    if content[:1024].lstrip().startswith(b"%PDF-"):
        raise ValueError("this is a PDF: pass a reader of PDF to read_pages")
    return [(p, None) for p in content.decode("utf-8", "replace").split("\f")]


def read_pages(files: DataFrame, reader: PageReader = text_pages) -> DataFrame:
    """``(doc, page, text, image)`` of ``(doc, path, content)``, pages from 1."""

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = reader(content.as_py() or b"")
                cols = [pa.array([doc] * len(got), pa.string()), pa.array(range(1, len(got) + 1), pa.int32()), pa.array([t for t, _ in got], pa.string()), pa.array([i for _, i in got], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc", "page", "text", "image"])

    return files.select("doc", "content").mapInArrow(pages, "doc string, page int, text string, image binary")


def page_texts(pages: DataFrame) -> DataFrame:
    """``(doc, texts)``: the texts of a document's pages in a list, in order; it holds one document in a row."""
    listed = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("doc").agg(F.transform(listed, lambda x: x["text"]).alias("texts"))


#: (content, dpi) -> [(PNG, width, height)]; renderers are plugged in as readers are.
PageRenderer = Callable[[bytes, int], list[tuple[bytes, int, int]]]
#: content -> the content of a file for each page.
PageSplitter = Callable[[bytes], list[bytes]]


def render_pages(files: DataFrame, renderer: PageRenderer, dpi: int = 300) -> DataFrame:
    """``(doc, page, image, width, height)`` of ``(doc, path, content)``, pages from 1; a batch for each file."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = renderer(content.as_py() or b"", dpi)
                n = len(got)
                cols = [pa.array([doc] * n, pa.string()), pa.array(range(1, n + 1), pa.int32()), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["doc", "page", "image", "width", "height"])

    return files.select("doc", "content").mapInArrow(render, "doc string, page int, image binary, width int, height int")


def page_image(docs: DataFrame, images: DataFrame, page: int) -> DataFrame:
    """``(doc, image)`` for every row of ``docs(doc)``: the page's image in base64, null for a page that isn't there."""
    one = images.where(F.col("page") == page).select("doc", F.base64("image").alias("image"))
    return docs.select("doc").join(one, "doc", "left")


def first_images(images: DataFrame, n: int = 4) -> DataFrame:
    """``(doc, images)``: the images of a document's first n pages, in order."""
    listed = F.array_sort(F.collect_list(F.struct("page", "image")))
    return images.where((F.col("page") <= n) & F.col("image").isNotNull()).groupBy("doc").agg(F.transform(listed, lambda x: x["image"]).alias("images"))


def split_files(files: DataFrame, splitter: PageSplitter, suffix: str = ".pdf") -> DataFrame:
    """``(folder, name, body)``: a file for each page, to be written by ``write_records``."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = splitter(content.as_py() or b"")
                cols = [pa.array([doc] * len(got), pa.string()), pa.array([f"page_{i}{suffix}" for i in range(1, len(got) + 1)], pa.string()), pa.array(got, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["folder", "name", "body"])

    return files.select("doc", "content").mapInArrow(split, "folder string, name string, body binary")


def dump_graphs(graphs: DataFrame, path: str, unit: str = "page") -> None:
    """The graph of each page, or of each chunk by the name ``unit``, as text below folders of documents and units."""
    rows = graphs.select("doc", F.col("page").alias(unit), F.coalesce("graph_json", F.lit('{"entities":[],"relationships":[]}')).alias("value"))
    rows.write.mode("overwrite").partitionBy("doc", unit).text(path)


def file_base(mode: str, model: str, provider: str, construction: str) -> str:
    """The start of the names of exported files; slashes and colons of a model's name become ``_``."""
    return f"{mode}_{model.replace('/', '_').replace(':', '_')}_{provider}_{construction}"


def write_json_array(rows: DataFrame, path: str, order: list[str]) -> None:
    """``rows`` in ``order`` as one JSON array in the file ``path``.  The format is one file, so one task writes it, a row at a time."""
    sinks.write_json_array(rows.orderBy(*order).select(F.to_json(F.struct(*rows.columns)).alias("body")), path)


def split_pages(docs: DataFrame, doc: str, text: str, separator: str = "\n") -> DataFrame:
    """``(doc, page, text)`` of texts, pages from 1."""
    return docs.select(F.col(doc).cast("string").alias("doc"), F.posexplode(F.split(text, separator)).alias("page", "text")).withColumn("page", F.col("page") + 1)


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """``(doc, page, graph_json)`` of JSON files, a graph each; its page_number, or 1."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("graph_json"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", "")
    return rows.select(stem.alias("doc"), F.coalesce(F.get_json_object("graph_json", "$.page_number").cast("int"), F.lit(1)).alias("page"), "graph_json")


def first_of(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """The first file by name that ends in ``suffix``, as one text row."""
    rows = spark.read.option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.orderBy("path").limit(1)


def write_text_pages(pages: DataFrame, path: str) -> None:
    """A folder for each document and page."""
    pages.select("doc", "page", "text").write.partitionBy("doc", "page").text(path)


def graph_documents(entities: DataFrame, relations: DataFrame, group: str, attributes: tuple[str, ...]) -> DataFrame:
    """``(group, value)``: the JSON of each graph, entities and relations in order, null attributes left out."""

    def listed(df: DataFrame, cols: list[str], name: str) -> DataFrame:
        body = F.to_json(F.struct(*cols), {"ignoreNullFields": "true"})
        rows = df.select(group, "ord", body.alias("body")).groupBy(group)
        return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "body"))), lambda x: x["body"]), ",").alias(name))

    both = listed(entities, ["id", "type", *attributes], "e").join(listed(relations, ["source", "target", "type"], "r"), group, "full_outer")
    text: Column = F.concat(F.lit('{"entities":['), F.coalesce("e", F.lit("")), F.lit('],"relationships":['), F.coalesce("r", F.lit("")), F.lit("]}"))
    return both.select(group, text.alias("value"))


def graph_document_parts(entities: DataFrame, relations: DataFrame, group: str, attributes: tuple[str, ...], part_rows: int = 10_000) -> DataFrame:
    """``(group, part, value)``: the JSON of ``graph_documents`` cut into parts of at most ``part_rows`` records; a group's values joined in the order of parts are its text.

    Records are numbered over all groups without one task that holds a group, and each part brings the commas and brackets between its records.
    """
    body = lambda cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "true"}).alias("body")
    ents = entities.select(group, F.lit(0).alias("side"), "ord", body(["id", "type", *attributes]))
    rels = relations.select(group, F.lit(1).alias("side"), "ord", body(["source", "target", "type"]))
    rows = ordered_index(ents.unionByName(rels), [group, "side", "ord", "body"], "n")
    ends = rows.groupBy(F.col(group).alias("_g")).agg(F.min("n").alias("first"), F.max("n").alias("last"), F.min(F.when(F.col("side") == 1, F.col("n"))).alias("turn"))
    rows = rows.join(ends, F.col(group).eqNullSafe(F.col("_g")))
    middle = F.lit('],"relationships":[')
    before = (
        F.when((F.col("n") == F.col("first")) & (F.col("side") == 0), F.lit('{"entities":['))
        .when(F.col("n") == F.col("first"), F.concat(F.lit('{"entities":['), middle))
        .when(F.col("n") == F.col("turn"), middle)
        .otherwise(F.lit(","))
    )
    after = F.when(F.col("n") == F.col("last"), F.when(F.col("turn").isNull(), F.concat(middle, F.lit("]}"))).otherwise(F.lit("]}"))).otherwise(F.lit(""))
    part = F.floor((F.col("n") - F.col("first")) / part_rows) + 1
    rows = rows.select(group, part.alias("part"), "n", F.concat(before, "body", after).alias("value"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"])
    return rows.groupBy(group, "part").agg(F.array_join(texts, "").alias("value"))


def write_document_graphs(entities: DataFrame, relations: DataFrame, path: str) -> None:
    """The graph of each document as JSON lines below a folder for it: ``entities(doc, ord, id, type, attrs_json)``, then ``relations(doc, ord, source, target, type)``.

    A line holds one entity or relation, so a document of any size is written by as many tasks as hold its rows, and none gathers it.
    """
    ends = F.to_json(F.struct("id", "type"))
    shut = F.regexp_replace("attrs_json", r"^\{\s*", "")
    body = F.concat(F.substr(ends, F.lit(1), F.length(ends) - 1), F.when(shut == "}", F.lit("")).otherwise(F.lit(",")), shut)
    lines = entities.select("doc", F.lit(0).alias("part"), "ord", F.concat(F.lit('{"entity":'), body, F.lit("}")).alias("value"))
    rels = relations.select("doc", F.lit(1).alias("part"), "ord", F.concat(F.lit('{"relationship":'), F.to_json(F.struct("source", "target", "type")), F.lit("}")).alias("value"))
    rows = lines.unionByName(rels).repartitionByRange("doc", "part", "ord").sortWithinPartitions("doc", "part", "ord")
    rows.select("doc", "value").write.mode("overwrite").partitionBy("doc").text(path)


def write_documents(rows: DataFrame, path: str, group: str) -> None:
    """One text file (or a few) below a folder for each group."""
    rows.select(group, "value").write.partitionBy(group).text(path)


def url(path: str) -> str:
    """A path as Arrow's file systems take it: a path without a scheme is a file's."""
    return path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path)


write_records = sinks.write_records
