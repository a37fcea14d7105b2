"""Chunking: pages(doc, page, text) to sections, to chunks with overlap and context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.text import paragraphs, sentences, strip, summary, words

#: Section headers of levels 1 to 3; multi-line, and only a line feed ends a line.
HEADERS = (
    r"^(\d+\.?\d*\.?\d*)\s+([A-Z][^.!?]*)",
    r"^([A-Z][A-Z\s]{3,})\s*$",
    r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s*$",
)
#: Phrases that open a new topic.
INDICATORS = (
    "furthermore", "however", "moreover", "additionally", "in addition", "on the other hand", "in contrast", "nevertheless", "consequently",
    "therefore", "thus", "accordingly", "as a result", "meanwhile", "subsequently", "finally", "in conclusion", "to summarize",
)


@dataclass(frozen=True)
class ChunkConfig:
    max_size: int = 4000
    min_size: int = 500
    overlap: int = 200
    respect_sentences: bool = True
    topic_shifts: bool = True
    headers: tuple[str, ...] = HEADERS
    indicators: tuple[str, ...] = INDICATORS
    paragraph: str = "\\n\\s*\\n"


def header_titles(text: Column, headers: tuple[str, ...] = HEADERS) -> Column:
    """All headers of a text as (level, title) by position, those of one place by level; a title is the whole match."""
    total = lambda texts: F.aggregate(texts, F.lit(0), lambda n, t: n + F.length(t))

    def placed(level: int, pattern: str) -> Column:
        whole, gaps = F.regexp_extract_all(text, F.lit(f"(?md){pattern}"), F.lit(0)), F.split(text, f"(?md){pattern}", -1)
        at = lambda i: total(F.slice(gaps, F.lit(1), i + 1)) + total(F.slice(whole, F.lit(1), i))
        return F.transform(whole, lambda t, i: F.struct(at(i).alias("at"), F.lit(level).alias("level"), strip(t).alias("title")))

    found = [placed(level, pattern) for level, pattern in enumerate(headers, 1)]
    return F.transform(F.array_sort(F.concat(*found)), lambda h: F.struct(h["level"].alias("level"), h["title"].alias("title")))


def _last_placed(text: Column, headers: tuple[str, ...]) -> Column:
    last = []
    for level, pattern in enumerate(headers, 1):
        whole, gaps = F.regexp_extract_all(text, F.lit(f"(?md){pattern}"), F.lit(0)), F.split(text, f"(?md){pattern}", -1)
        match = F.element_at(whole, -1)
        at = F.length(text) - F.length(F.element_at(gaps, -1)) - F.length(match)
        last.append(F.when(F.size(whole) > 0, F.struct(at.alias("at"), F.lit(level).alias("level"), strip(match).alias("title"))))
    return F.array_max(F.array(*last))


def _header(placed: Column) -> Column:
    return F.when(placed.isNotNull(), F.struct(placed["level"].alias("level"), placed["title"].alias("title")))


def last_header(text: Column, headers: tuple[str, ...] = HEADERS) -> Column:
    """The last of ``header_titles``, or null."""
    return _header(_last_placed(text, headers))


def sections(pages: DataFrame, config: ChunkConfig = ChunkConfig(), lossless: bool = False, header: Column | None = None) -> DataFrame:
    """``(doc, section, title, level, start_page, end_page, text)``.

    A page with a header opens a section under its last header; pages without belong to the one before.  Pages ahead of the first header
    are dropped, unless ``lossless``; a document without headers is one section, ``Document Content``.  ``header`` may give a page's
    (level, title), or null, instead of the patterns.
    """
    if header is None:
        pages, header = pages.withColumn("_placed", _last_placed(F.col("text"), config.headers)), _header(F.col("_placed"))
    order = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    rows = pages.withColumn("header", header).withColumn("section", F.sum(F.col("header").isNotNull().cast("int")).over(order))
    rows = rows.withColumn("last", F.max("section").over(Window.partitionBy("doc"))).where((F.col("section") > 0) | (F.col("last") == 0) | F.lit(lossless))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    out = rows.groupBy("doc", "section").agg(
        F.min_by("header", "page").alias("header"), F.min("page").cast("int").alias("start_page"), F.max("page").cast("int").alias("end_page"), F.array_join(texts, "\n").alias("text")
    )
    title = F.coalesce(F.col("header.title"), F.lit("Document Content"))
    return out.select("doc", "section", title.alias("title"), F.coalesce("header.level", F.lit(1)).alias("level"), "start_page", "end_page", "text")


def pack(parts: Column, limit: int, join: str) -> Column:
    """Greedy packing: parts joined until the next would make more than ``limit`` characters (the joins not counted)."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("out"), F.lit("").alias("cur"), F.lit(False).alias("any"))

    def step(s: Column, p: Column) -> Column:
        full = s["any"] & (F.length(s["cur"]) + F.length(p) > limit)
        cur = F.when(full | ~s["any"], p).otherwise(F.concat(s["cur"], F.lit(join), p))
        return F.struct(F.when(full, F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]).alias("out"), cur.alias("cur"), F.lit(True).alias("any"))

    return F.aggregate(parts, start, step, lambda s: F.when(s["any"], F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]))


def split_paragraphs(text: Column, config: ChunkConfig) -> Column:
    """Paragraphs; one of over 0.8 times the limit is packed anew from its sentences."""
    limit = int(config.max_size * 0.8)
    small = lambda p: F.when(F.length(p) > limit, pack(sentences(p), limit, " ")).otherwise(F.array(p))
    found = paragraphs(text, config.paragraph)
    return F.flatten(F.transform(found, small)) if config.respect_sentences else found


def structure_chunks(found: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """``(doc, section, piece, text, ...)``: a section that fits is one chunk, others are packed from paragraphs."""
    text = strip(F.col("text"))
    rows = found.withColumn("text", text).where(F.length("text") > 0)
    pieces = F.when(F.length("text") <= config.max_size, F.array("text")).otherwise(pack(split_paragraphs(F.col("text"), config), config.max_size, "\n"))
    return rows.select("doc", "section", "title", "start_page", "end_page", F.posexplode(pieces).alias("piece", "text"))


def topic_boundaries(text: Column, indicators: tuple[str, ...] = INDICATORS) -> Column:
    """Offsets of sentences that hold an indicator, one character counted between sentences; the first sentence never."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        hit = F.lit(False)
        for i in indicators:
            hit = hit | x["low"].contains(i)
        return F.struct((s["at"] + x["n"] + 1).alias("at"), F.when(hit & (s["at"] > 0), F.concat(s["out"], F.array(s["at"]))).otherwise(s["out"]).alias("out"))

    lowered = F.transform(sentences(text), lambda x: F.struct(F.length(x).alias("n"), F.lower(x).alias("low")))
    return F.aggregate(lowered, start, step, lambda s: s["out"])


def _between(text: Column, boundaries: Column) -> Column:
    """The pieces between boundaries."""
    ends = F.concat(boundaries, F.array(F.length(text)))
    starts = F.concat(F.array(F.lit(0)), boundaries)
    return F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: strip(F.substring(text, x["s"] + 1, x["e"] - x["s"])))


def _long_enough(text: Column, pieces: Column, least: int, keep_short: bool = False) -> Column:
    long_ = F.filter(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: (F.length(p) >= least) | F.lit(keep_short))
    tail = F.element_at(pieces, -1)
    joined = F.concat(F.slice(long_, 1, F.size(long_) - 1), F.array(F.concat(F.element_at(long_, -1), F.lit(" "), tail)))
    with_tail = F.when(F.length(tail) >= least, F.concat(long_, F.array(tail))).when(F.length(tail) == 0, long_).when(F.size(long_) > 0, joined).otherwise(F.array(text))
    return F.when((F.size(pieces) == 1) | (F.size(with_tail) == 0), F.array(text)).otherwise(with_tail)


def split_at_boundaries(text: Column, boundaries: Column, least: int, keep_short: bool = False) -> Column:
    """Pieces between boundaries of at least ``least`` characters; a short last one joins the piece before, other short ones are dropped."""
    return _long_enough(text, _between(text, boundaries), least, keep_short)


def add_context(chunks: DataFrame, overlap: int = 200) -> DataFrame:
    """``chunks(doc, ord, text, title)`` with ids, overlap from the chunk before, its summary, the position and counts."""
    order = Window.partitionBy("doc").orderBy("ord")
    rows = chunks.withColumns({"before": F.lag("text").over(order), "n": F.row_number().over(order), "all": F.count("*").over(Window.partitionBy("doc"))})
    # Sentences are found once for each text: what is used more than once is a column.
    rows = rows.withColumns({"_tail": sentences(F.expr(f"right(before, {overlap})")), "_before": sentences(F.col("before"))})
    last = F.when(F.size("_tail") < 2, F.col("_tail")).otherwise(F.slice("_tail", -2, 2))
    rows = rows.withColumn("_lead", F.when(F.col("before").isNotNull() & (F.lit(overlap) > 0), F.array_join(last, " ")))
    rows = rows.withColumn("_text", F.when(F.length("_lead") > 0, F.concat("_lead", F.lit("\n\n"), F.col("text"))).otherwise(F.col("text")))
    text = F.col("_text")
    return rows.select(
        *[c for c in chunks.columns if c not in ("text", "ord")],
        F.concat(F.lit("chunk_"), F.when(F.length(F.col("n").cast("string")) < 3, F.lpad(F.col("n").cast("string"), 3, "0")).otherwise(F.col("n").cast("string"))).alias("id"),
        text.alias("text"),
        F.coalesce(summary(F.col("_before")), F.lit("")).alias("previous_chunk_summary"),
        F.when(F.col("all") == 1, 0.0).otherwise((F.col("n") - 1) / F.col("all")).alias("document_position"),
        F.size(sentences(text)).alias("sentence_count"),
        F.size(words(text)).alias("word_count"),
    )


def chunk_documents(pages: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """The whole chunker over ``pages(doc, page, text)``."""
    pieces = structure_chunks(sections(pages, config), config)
    if config.topic_shifts:
        many = F.length("text") > config.min_size * 2
        pieces = pieces.withColumn("_cuts", F.when(many, topic_boundaries(F.col("text"), config.indicators)))
        pieces = pieces.withColumn("_between", F.when(many, _between(F.col("text"), F.col("_cuts"))))
        long_ = F.when(many, _long_enough(F.col("text"), F.col("_between"), config.min_size)).otherwise(F.array("text"))
        pieces = pieces.select("doc", "section", "title", "start_page", "end_page", "piece", F.posexplode(long_).alias("part", "text"))
    else:
        pieces = pieces.withColumn("part", F.lit(0))
    ordered = pieces.withColumn("ord", F.struct("section", "piece", "part")).withColumn("section_context", F.col("title"))
    out = add_context(ordered.select("doc", "ord", "text", "section_context", "start_page", "end_page"), config.overlap)
    return out.withColumns({"chunk_type": F.lit("text"), "related_chunks": F.array().cast("array<string>")})


def chunk_statistics(chunks: DataFrame, section: str = "section_context") -> DataFrame:
    """One row of eight figures; no row for no chunks."""
    n = F.length("text")
    row = chunks.agg(
        F.count("*").alias("total_chunks"),
        F.avg(n).alias("avg_chunk_size"),
        F.min(n).alias("min_chunk_size"),
        F.max(n).alias("max_chunk_size"),
        F.avg(F.size(words(F.col("text")))).alias("avg_word_count"),
        F.avg(F.size(sentences(F.col("text")))).alias("avg_sentence_count"),
        F.sum(n).alias("total_text_length"),
        F.countDistinct(section).alias("sections_detected"),
    )
    return row.where("total_chunks > 0")
