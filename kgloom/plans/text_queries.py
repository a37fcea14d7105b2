"""Queries over text functions, pages, chunks and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import text as T
from kgloom.operators import chunk as C
from kgloom.operators import extract as X
from kgloom.operators.ontology import parse_relations
from kgloom.plans import star
from kgloom.sources.files import split_pages
from kgloom.sources.tables import table

_PAGES = "pg AS (SELECT doc_id::VARCHAR AS doc, generate_subscripts(string_split(text, chr(10)), 1)::INT AS page, unnest(string_split(text, chr(10))) AS text FROM documents)"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SENT = f"[trim(s, {_BLANKS}) FOR s IN regexp_extract_all({{}}, '[^.!?]+[.!?]*') IF length(trim(s, {_BLANKS})) > 0]"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_pages(_docs(spark, sf_dir), "doc_id", "text")


def text_normalize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalize_text(F.col("text")).alias("normalized"))


def sentence_word_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("sentences"), F.size(T.words(F.col("text"))).cast("long").alias("words"))


def chunk_summary(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.summary(T.sentences(F.col("text"))).alias("summary"))


def document_pages(spark, sf_dir):
    return _doc_pages(spark, sf_dir)


def whole_text(spark, sf_dir):
    return _doc_pages(spark, sf_dir).groupBy("doc").agg(X.ordered_text("page", "text", "\n").alias("text"))


def one_page(spark, sf_dir):
    return _doc_pages(spark, sf_dir).where("page = 2")


def first_pages(spark, sf_dir):
    return X.first_pages_text(_doc_pages(spark, sf_dir), 4)


def toc_text(spark, sf_dir):
    """A table of contents of the tables: regions, their nations below, pages by key."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc"), F.lit(0).cast("long").alias("ord"), F.lit(1).alias("level"), F.col("r_name").alias("title"), F.lit(1).alias("page"))
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc"), (F.col("n_nationkey") + 1).cast("long").alias("ord"), F.lit(2).alias("level"), F.col("n_name").alias("title"), (F.col("n_nationkey") + 2).alias("page"))
    return X.toc_text(r.unionByName(n))


def classification_prompts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.classification_prompt(F.col("text"), ["report", "contract"])).alias("prompt_md5"))


def classify_parse(spark, sf_dir):
    """Turns of conversations taken for replies of a model."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", X.parse_category(F.col("text"), ["the", "und", "les", "ciónra"]).alias("category"))


def unfence_json(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role is not null").select("conv_id", "turn", F.concat(F.lit("```json\n"), F.to_json(F.struct("role", "turn")), F.lit("\n```")).alias("reply"))
    return c.select("conv_id", "turn", X.unfence(F.col("reply")).alias("body"), F.get_json_object(X.unfence(F.col("reply")), "$.role").alias("role"))


def _header():
    return F.when((F.length("text") > 0) & (F.length("text") < 60), F.struct(F.lit(1).alias("level"), F.trim("text").alias("title")))


def sections_gaps_islands(spark, sf_dir):
    """Sections of lines as pages: a short line is a header."""
    return C.sections(_doc_pages(spark, sf_dir), header=_header()).select("doc", F.col("section").cast("long").alias("section"), "title", "start_page", "end_page", F.md5("text").alias("text_md5"))


_CONFIG = C.ChunkConfig(max_size=1000, min_size=200, overlap=100, paragraph="\\n", indicators=("that", "with", "mit", "que"))


def paragraph_packing(spark, sf_dir):
    found = _docs(spark, sf_dir).select("doc_id", F.posexplode(C.pack(T.paragraphs(F.col("text"), "\\n"), 1000, "\n")).alias("piece", "text"))
    return found.select("doc_id", "piece", F.length("text").alias("size"), F.md5("text").alias("text_md5"))


def topic_boundaries(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(C.topic_boundaries(F.col("text"), _CONFIG.indicators).cast("array<string>"), ",").alias("boundaries"))


def chunk_documents(spark, sf_dir):
    out = C.chunk_documents(_doc_pages(spark, sf_dir), _CONFIG)
    return out.select("doc", "id", "section_context", "start_page", "end_page", F.round("document_position", 6).alias("document_position"), "sentence_count", "word_count", "chunk_type", F.md5("text").alias("text_md5"), F.md5("previous_chunk_summary").alias("summary_md5"))


def chunk_overlap(spark, sf_dir):
    """Lines as chunks, with the context of the one before."""
    lines = _doc_pages(spark, sf_dir).where("text <> ''").select("doc", F.col("page").alias("ord"), "text")
    out = C.add_context(lines, 100)
    return out.select("doc", "id", F.md5("text").alias("text_md5"), F.md5("previous_chunk_summary").alias("summary_md5"), F.round("document_position", 6).alias("document_position"))


def chunk_statistics(spark, sf_dir):
    lines = _doc_pages(spark, sf_dir).where("text <> ''").withColumn("section_context", F.col("doc"))
    s = C.chunk_statistics(lines)
    return s.select("total_chunks", F.round("avg_chunk_size", 6).alias("avg_chunk_size"), "min_chunk_size", "max_chunk_size", F.round("avg_word_count", 6).alias("avg_word_count"), F.round("avg_sentence_count", 6).alias("avg_sentence_count"), "total_text_length", "sections_detected")


def entity_primary_name(spark, sf_dir):
    e = star.entities(spark, sf_dir)
    return e.select("id", T.primary_name(F.col("type"), {f: F.col(f) for f in ("name", "locationName", "contextName", "metricName")}).alias("primary_name"))


def type_strings(spark, sf_dir):
    r = star.relations(spark, sf_dir).select("type").union(star.entities(spark, sf_dir).select("type")).distinct()
    return r.select("type", T.clean_link_type(F.col("type")).alias("link_type"), T.category_from_type(F.col("type")).alias("category"), T.unprefixed(F.col("type")).alias("unprefixed"), T.strip_prefix(F.col("type"), "kg:").alias("bare"))


def composite_ids(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.composite_id(F.col("page_id").cast("string"), F.col("url")).alias("composite_id"), T.safe_filename(F.col("url")).alias("file_name"), T.shorten(F.col("url"), 30).alias("short"), T.base64_line(F.col("url")).alias("b64"))


def similarity_bounds(spark, sf_dir):
    n = table(spark, sf_dir, "part").select("p_name").distinct()
    pairs = n.toDF("a").crossJoin(n.toDF("b")).where("a < b")  # a few dozen names
    return pairs.select("a", "b", F.round(T.length_bound(F.col("a"), F.col("b")), 6).alias("length_bound"), F.round(T.multiset_bound(F.col("a"), F.col("b")), 6).alias("multiset_bound"))


def ontology_relation_parse(spark, sf_dir):
    """The lines that declare the relations that the graph has, by the types of their ends, and what is read back from them."""
    kinds = star.entities(spark, sf_dir).select("id", "type")
    rels = star.relations(spark, sf_dir).join(kinds.toDF("source", "s"), "source").join(kinds.toDF("target", "t"), "target")
    ends = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")  # noqa: E731  a few types
    arrow = F.when(F.length("type") % 2 == 0, " -> ").otherwise(" → ")
    lines = rels.groupBy("type").agg(ends("s").alias("s"), ends("t").alias("t")).select(F.concat("type", F.lit(" ("), "s", arrow, "t", F.lit(")")).alias("line"))
    return parse_relations(lines)


QUERIES = {
    f.__name__: f
    for f in (
        text_normalize, sentence_word_counts, chunk_summary, document_pages, whole_text, one_page, first_pages, toc_text, classification_prompts, classify_parse, unfence_json,
        sections_gaps_islands, paragraph_packing, topic_boundaries, chunk_documents, chunk_overlap, chunk_statistics, entity_primary_name, type_strings, composite_ids,
        similarity_bounds, ontology_relation_parse,
    )
}

_NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}_\s.-]', ' ', 'g'), '\s+', ' ', 'g'))"
_S = _SENT.format("text")
_SUMMARY = "CASE WHEN len(s) = 0 THEN '' WHEN len(s) = 1 THEN s[1] WHEN len(s) = 2 THEN s[1] || ' ' || s[2] ELSE s[1] || ' ... ' || s[-1] END"
_CUT = "CASE WHEN length(m) > 200 THEN substr(m, 1, 197) || '...' ELSE m END"
_LINK = r"CASE WHEN contains(type, ':') THEN lower(regexp_replace(regexp_replace(split_part(type, ':', -1), '(.)([A-Z][a-z]+)', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')) ELSE 'unknown link type' END"
_HEAD = "Choose the one category that fits this document best. Categories: report, contract. Answer with the category alone.\nTaken from: text\nTEXT:"
_CATS = ["the", "und", "les", "ciónra"]

ORACLES = {
    "text_normalize": f"SELECT doc_id, {_NORM.format('text')} AS normalized FROM documents",
    "sentence_word_counts": rf"SELECT doc_id, len({_S})::BIGINT AS sentences, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))::BIGINT AS words FROM documents",
    "chunk_summary": f"WITH a AS (SELECT doc_id, {_S} AS s FROM documents), b AS (SELECT doc_id, {_SUMMARY} AS m FROM a) SELECT doc_id, {_CUT} AS summary FROM b",
    "document_pages": f"WITH {_PAGES} SELECT doc, page, text FROM pg",
    "whole_text": f"WITH {_PAGES} SELECT doc, string_agg(text, chr(10) ORDER BY page) AS text FROM pg GROUP BY doc",
    "one_page": f"WITH {_PAGES} SELECT doc, page, text FROM pg WHERE page = 2",
    "first_pages": f"WITH {_PAGES} SELECT doc, string_agg(text, chr(10) || chr(10) || '--- Page Break ---' || chr(10) || chr(10) ORDER BY page) AS text FROM pg WHERE page <= 4 AND text <> '' GROUP BY doc",
    "toc_text": "WITH e AS (SELECT r_regionkey AS doc, 0 AS ord, 1 AS level, r_name AS title, 1 AS page FROM region UNION ALL SELECT n_regionkey, n_nationkey + 1, 2, n_name, n_nationkey + 2 FROM nation) SELECT doc, string_agg(repeat('  ', level - 1) || '- ' || title || ' (Page ' || page || ')', chr(10) ORDER BY ord) AS text FROM e GROUP BY doc",
    "classification_prompts": f"SELECT doc_id, md5('{_HEAD}' || substr(coalesce(text, ''), 1, 15000)) AS prompt_md5 FROM documents",
    "classify_parse": "WITH a AS (SELECT conv_id, turn, trim(regexp_replace(trim(lower(string_split(trim(coalesce(text, '')), chr(10))[1])), '^[\"''`]+|[\"''`.]+$', '', 'g')) AS l FROM conversations) SELECT conv_id, turn, CASE "
    + " ".join(f"WHEN l = '{c}' THEN '{c}'" for c in _CATS)
    + " ".join(f" WHEN contains(l, '{c}') THEN '{c}'" for c in _CATS)
    + " ELSE 'unknown_document_type' END AS category FROM a",
    "unfence_json": "SELECT conv_id, turn, '{\"role\":\"' || role || '\",\"turn\":' || turn || '}' AS body, role FROM conversations WHERE role IS NOT NULL",
    "sections_gaps_islands": f"""WITH {_PAGES}, h AS (SELECT *, length(text) BETWEEN 1 AND 59 AS head FROM pg),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc ORDER BY page)::BIGINT AS section FROM h),
k AS (SELECT *, max(section) OVER (PARTITION BY doc) AS last FROM s)
SELECT doc, section, coalesce(min_by(CASE WHEN head THEN trim(text) END, page), 'Document Content') AS title, min(page) AS start_page, max(page) AS end_page, md5(string_agg(text, chr(10) ORDER BY page)) AS text_md5
FROM k WHERE section > 0 OR last = 0 GROUP BY doc, section""",
    "paragraph_packing": """WITH RECURSIVE p AS (SELECT doc_id, [trim(x, """ + _BLANKS + """) FOR x IN string_split(text, chr(10)) IF length(trim(x, """ + _BLANKS + """)) > 0] AS ps FROM documents),
w AS (
  SELECT doc_id, ps, 1 AS i, 0 AS piece, ps[1] AS cur, len(ps) = 1 AS done, ps[1] AS emit FROM p WHERE len(ps) > 0
  UNION ALL
  SELECT doc_id, ps, i + 1, CASE WHEN length(cur) + length(ps[i + 1]) > 1000 THEN piece + 1 ELSE piece END,
    CASE WHEN length(cur) + length(ps[i + 1]) > 1000 THEN ps[i + 1] ELSE cur || chr(10) || ps[i + 1] END, i + 1 = len(ps), NULL
  FROM w WHERE i < len(ps)),
f AS (SELECT doc_id, piece, max_by(cur, i) AS text FROM w GROUP BY doc_id, piece)
SELECT doc_id, piece, length(text)::INT AS size, md5(text) AS text_md5 FROM f""",
    "topic_boundaries": f"""WITH a AS (SELECT doc_id, {_S} AS s FROM documents),
b AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM a),
c AS (SELECT *, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM b),
d AS (SELECT doc_id, string_agg(start::VARCHAR, ',' ORDER BY i) AS boundaries FROM c WHERE i > 1 AND ({' OR '.join(f"contains(lower(x), '{w}')" for w in _CONFIG.indicators)}) GROUP BY doc_id)
SELECT documents.doc_id, coalesce(boundaries, '') AS boundaries FROM documents LEFT JOIN d USING (doc_id)""",
    "chunk_overlap": f"""WITH {_PAGES}, l AS (SELECT * FROM pg WHERE text <> ''),
o AS (SELECT *, lag(text) OVER (PARTITION BY doc ORDER BY page) AS before, row_number() OVER (PARTITION BY doc ORDER BY page) AS n, count(*) OVER (PARTITION BY doc) AS total FROM l),
t AS (SELECT *, {_SENT.format("right(before, 100)")} AS z, {_SENT.format("before")} AS s FROM o),
u AS (SELECT *, array_to_string(z[greatest(len(z) - 1, 1):], ' ') AS lead, {_SUMMARY} AS m FROM t)
SELECT doc, 'chunk_' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS id,
  md5(CASE WHEN length(lead) > 0 THEN lead || chr(10) || chr(10) || text ELSE text END) AS text_md5, md5(coalesce({_CUT}, '')) AS summary_md5,
  round(CASE WHEN total = 1 THEN 0.0::DOUBLE ELSE (n - 1) / total END, 6) AS document_position
FROM u""",
    "chunk_statistics": rf"""WITH {_PAGES}, l AS (SELECT *, {_S} AS s FROM pg WHERE text <> '')
SELECT count(*) AS total_chunks, round(avg(length(text)), 6) AS avg_chunk_size, min(length(text))::INT AS min_chunk_size, max(length(text))::INT AS max_chunk_size,
  round(avg(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))), 6) AS avg_word_count, round(avg(len(s)), 6) AS avg_sentence_count,
  sum(length(text))::BIGINT AS total_text_length, count(DISTINCT doc) AS sections_detected FROM l""",
    "entity_primary_name": f"{star.SQL} SELECT id, {_NORM.format('''CASE lower(split_part(type, ':', -1)) WHEN 'location' THEN locationName WHEN 'transactioncontext' THEN contextName WHEN 'financialmetric' THEN metricName ELSE name END''')} AS primary_name FROM ent",
    "type_strings": rf"""{star.SQL}, t AS (SELECT type FROM ent UNION SELECT type FROM rel), s AS (SELECT type, split_part(type, ':', -1) AS b FROM t)
SELECT type, {_LINK} AS link_type, CASE WHEN contains(type, ':') THEN lower(b[1] || regexp_replace(b[2:], '([A-Z])', '_\1', 'g')) ELSE 'unknown' END AS category, lower(b) AS unprefixed,
  CASE WHEN starts_with(type, 'kg:') THEN type[4:] ELSE type END AS bare FROM s""",
    "composite_ids": r"""WITH u AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '\s+', '_', 'g'), '[^\p{L}\p{N}_-]', '', 'g') AS l FROM pages)
SELECT page_id, page_id || '_' || CASE WHEN l = '' THEN 'nolabel' ELSE l END AS composite_id, regexp_replace(url, '[<>:"/\\|?*]', '_', 'g') AS file_name,
  CASE WHEN length(url) > 30 THEN substr(url, 1, 27) || '...' ELSE url END AS short, base64(encode(url)) AS b64 FROM u""",
    "similarity_bounds": """WITH n AS (SELECT DISTINCT p_name AS x FROM part), p AS (SELECT a.x AS a, b.x AS b FROM n a, n b WHERE a.x < b.x),
c AS (SELECT DISTINCT x, unnest(string_split(x, '')) AS ch FROM n), k AS (SELECT x, ch, length(x) - length(replace(x, ch, '')) AS n FROM c),
m AS (SELECT p.a, p.b, sum(least(q.n, r.n)) AS common FROM p JOIN k q ON q.x = p.a JOIN k r ON r.x = p.b AND r.ch = q.ch GROUP BY p.a, p.b)
SELECT a, b, round(2.0::DOUBLE * least(length(a), length(b)) / (length(a) + length(b)), 6) AS length_bound, round(2.0::DOUBLE * coalesce(common, 0)::DOUBLE / (length(a) + length(b)), 6) AS multiset_bound FROM p LEFT JOIN m USING (a, b)""",
    "ontology_relation_parse": f"{star.SQL}, r AS (SELECT split_part(rel.type, ':', -1) AS name, split_part(a.type, ':', -1) AS s, split_part(b.type, ':', -1) AS t FROM rel JOIN ent a ON a.id = source JOIN ent b ON b.id = target) SELECT DISTINCT name, 'domain' AS side, s AS type FROM r UNION SELECT DISTINCT name, 'range', t FROM r",
}
