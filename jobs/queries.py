"""The jobs as queries over whole tables: each runs twice into one new folder and returns its output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import document_index, symbol_catalogue
from tomeline.fixtures import CTE
from tomeline.plans.store import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_symbol_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job1")
    for _ in range(2):
        symbol_catalogue.refresh(spark, sf_dir, folder)
    return symbol_catalogue.output(spark, folder)


def job2_document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job2")
    for _ in range(2):
        document_index.update(spark, f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint")
    found, _ = document_index.current(spark, f"{folder}/index")
    return found.select("doc_id", "lang", "term", "tf")


QUERIES = {"job1_symbol_catalogue": job1_symbol_catalogue, "job2_document_index": job2_document_index}

_SPLIT = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_N_WORDS = " + ".join(f"len({_SPLIT.format(c)})" for c in ("name", "qualified_name", "docstring"))

ORACLES = {
    "job1_symbol_catalogue": CTE
    + "select id, regexp_replace(qualified_name, '[.][^.]*$', '') as source_key, name, qualified_name, symbol_type, signature, "
    + f"translate(regexp_replace(qualified_name, '[.][^.]*$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as parent_key, {_N_WORDS} as n_words from symbols",
    "job2_document_index": "select doc_id, coalesce(lang, 'none') as lang, term, count(*) as tf from "
    + f"(select doc_id, lang, unnest({_SPLIT.format('text')}) as term from documents) w group by doc_id, lang, term",
}
