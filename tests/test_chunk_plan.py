from pyspark.sql import functions as F

from kgloom.functions.text import sentences, summary, words
from kgloom.operators import chunk as C


def test_sentences_of_a_text_are_found_once(spark):
    config = C.ChunkConfig(max_size=400, min_size=40, overlap=60)
    body = "Alpha beta gamma. However, delta went on! Was it so? Therefore epsilon stayed. "
    pages = spark.createDataFrame([(f"d{d}", p, f"1.{p} Title\n" + body * (1 + (d + p) % 9) + "\n\n" + body) for d in range(3) for p in range(4)], "doc string, page int, text string")
    out = C.chunk_documents(pages, config)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 16
    rows = out.select("*", F.size(sentences(F.col("text"))).alias("s"), F.size(words(F.col("text"))).alias("w")).collect()
    assert len(rows) > 12 and all(r.s == r.sentence_count and r.w == r.word_count for r in rows)
    # Without an overlap a chunk's text is what the next one sums up.
    plain = C.chunk_documents(pages, C.ChunkConfig(max_size=400, min_size=40, overlap=0)).withColumn("own", summary(sentences(F.col("text"))))
    by_id = {(r.doc, int(r.id.split("_")[1])): r for r in plain.collect()}
    assert all(r.previous_chunk_summary == (by_id[(d, n - 1)].own if n > 1 else "") for (d, n), r in by_id.items())
