"""Adds new documents to a full-text index as their files arrive.

    python -m jobs.document_index --input /data/documents --output /data/index --checkpoint /data/index_checkpoint

A file stream over the documents' folder takes the files that its checkpoint does not know, in micro-batches
until none is left (availableNow), and ends. Each batch writes the postings of its documents and a row for
each document to partitions of its own (language and batch), so a batch that is run again after a failure
writes over itself. A document that arrives again, with another text or language, is indexed again;
its newest batch counts, and of several rows of one batch the last by language and text.

Output, under ``output``: ``postings`` (doc_id, term, tf; by batch and lang, sorted by term) and
``documents`` (doc_id, n_terms; by batch and lang). :func:`current` reads what counts now.
"""

from __future__ import annotations

import logging
import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.run import main
from tomeline.operators import fts, maintain

log = logging.getLogger("document_index")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: The partition of documents without a language.
NO_LANG = "none"
_TABLES = {"postings": "doc_id long, term string, tf long, batch long, lang string", "documents": "doc_id long, n_terms long, batch long, lang string"}


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, words, n_terms): each document's words as an array of (term, tf), and the number of all."""
    words = fts.counted(docs, {"words": fts.tokens(F.coalesce("text", F.lit("")), fold=False)})
    return words.select("doc_id", "lang", "words", F.col("words_n").alias("n_terms"))


def postings(words: DataFrame) -> DataFrame:
    """(doc_id, lang, term, tf) of counted documents."""
    return words.select("doc_id", "lang", F.explode("words").alias("w")).select("doc_id", "lang", "w.term", "w.tf")


def _write(rows: DataFrame, folder: str, n: int, *order: str) -> None:
    """Writes ``n`` rows to partitions by language, sorted, as many in a task as fit its memory whatever ``n`` is; what the folder held goes."""
    spread = rows.repartitionByRange(1 + n // fts.PART_ROWS, "lang", *order).sortWithinPartitions("lang", *order)
    spread.write.mode("overwrite").partitionBy("lang").parquet(folder)


def _pattern(path: str) -> str:
    """The path as a pattern that only it fits: file streams take a single file by patterns only."""
    top, _, last = path.rstrip("/").rpartition("/")
    return path if set("*?[{") & set(last) else f"{top}/{{{last}}}"


def update(spark: SparkSession, input: str, output: str, checkpoint: str, files: int = 64) -> dict:
    """Indexes the documents that are new in ``input``; what was read and written."""
    done = {"batches": 0, "read": 0, "documents": 0, "postings": 0}

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.filter("doc_id is not null").withColumn("lang", F.coalesce("lang", F.lit(NO_LANG)))
        docs = maintain.last_writer(rows.select("doc_id", F.struct("lang", "text").alias("row")), "doc_id", "row").select("doc_id", "row.*")
        passing = f"{output}/_counted/batch={number}"  # Spark's readers of the tables don't see it
        counted(docs).write.mode("overwrite").parquet(passing)
        words = spark.read.parquet(passing)
        n_docs, n_postings = words.agg(F.count("*"), F.coalesce(F.sum(F.size("words").cast("long")), F.lit(0))).first()
        _write(postings(words), f"{output}/postings/batch={number}", n_postings, "term", "doc_id")
        _write(words.select("doc_id", "n_terms", "lang"), f"{output}/documents/batch={number}", n_docs, "doc_id")
        words.limit(0).write.mode("overwrite").parquet(passing)  # nothing stays of it but its name
        n_read = batch.count()  # of the files' footers: no column is read
        log.info("batch %d: read %d rows, wrote %d documents and %d postings to %s", number, n_read, n_docs, n_postings, output)
        done.update(batches=done["batches"] + 1, read=done["read"] + n_read, documents=done["documents"] + n_docs, postings=done["postings"] + n_postings)

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(_pattern(input))
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new rows from %s in %d batches, wrote %d documents and %d postings", done["read"], input, done["batches"], done["documents"], done["postings"])
    return done


def _table(spark: SparkSession, output: str, name: str) -> DataFrame:
    try:
        return spark.read.schema(_TABLES[name]).parquet(f"{output}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # nothing has arrived yet
            raise
        return spark.createDataFrame([], _TABLES[name])


def current(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    """Postings and documents that count: those of each document's newest batch."""
    docs = _table(spark, output, "documents")
    newest = docs.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return tuple(_table(spark, output, name).join(newest, ["doc_id", "batch"], "left_semi") for name in ("postings", "documents"))


def terms(spark: SparkSession, output: str) -> DataFrame:
    """(lang, term, n_docs, n_hits): the index summed up by term."""
    found, _ = current(spark, output)
    return found.groupBy("lang", "term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_hits"))


if __name__ == "__main__":
    sys.exit(main(update, os.path.join(os.path.dirname(os.path.abspath(__file__)), "document_index.toml")))
