"""The corpus pipeline: documents through five operators, one after another.

Each stage reads what the one before has written, as Parquet, in the folder that all executors share.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeline.llm.decontaminate import contamination
from tomeline.llm.ids import numbered_ids
from tomeline.llm.mixing import mix
from tomeline.llm.near_dups import near_duplicates
from tomeline.llm.scratch import Scratch
from tomeline.llm.secrets import secrets
from tomeline.llm.toxicity import toxicity

MASK = "[SECRET]"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text the classifier calls toxic.

    Rows are judged one by one: those with equal texts go or stay together, whatever their doc_id, a
    null included. A null or empty text has no votes and is judged by the classifier's intercept, so
    it stays unless most labelled documents are toxic. Texts are read whole.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rest = [c for c in docs.columns if c != "doc_id"]
    clean = toxicity(docs, labels, keep=rest).filter("predicted = 0")
    return clean.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"kept.`{c}`") for c in docs.columns])


#: Keys of rows that no doc_id of their own names begin here.
_MADE = 1 << 62


def _free(docs: DataFrame, name: str) -> str:
    """The name, lengthened until no column of ``docs`` bears it."""
    while name in docs.columns:
        name += "_"
    return name


def _keyed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """``docs`` with a key for each different row, and the key's name: its doc_id or, without one or with one that repeats, a hash of the whole row from _MADE on.

    A hash, unlike a number, is the same whenever the rows are read; equal rows share it. Ids that are
    no whole numbers count by their place among all.
    """
    key, often, number = _free(docs, "row_key"), _free(docs, "id_repeats"), _free(docs, "id_number")
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null")
    repeated = scratch.table("repeated", repeated.select(F.col("doc_id"), F.lit(True).alias(often)))
    made = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).bitwiseAND(_MADE - 1).bitwiseOR(_MADE)
    numbered, _ = numbered_ids(docs.withColumn(number, F.col("doc_id")), scratch, number)
    keyed = numbered.join(repeated, "doc_id", "left").withColumn(key, F.when(F.col("doc_id").isNull() | F.col(often).isNotNull(), made).otherwise(F.col(number)))
    return keyed.select(*[F.col(f"`{c}`") for c in docs.columns], key), key


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by 80 % of five-word shingles, the one with the smallest doc_id.

    Rows without doc_id and rows that share one are judged by their text like all others, and come
    after those with a doc_id of their own: none goes because its id repeats. Of equal rows with words
    one stays. Rows without words, null and empty texts, all stay. Texts are read whole.
    """
    scratch = Scratch(spark, "pipeline-near-dups")
    keyed, key = _keyed(docs, scratch)
    gone = near_duplicates(keyed, k=5, percent=80, id_col=key).filter("not kept").select(F.col("doc_id").alias(key)).distinct()
    kept = keyed.join(scratch.table("gone", gone), key, "left_anti").select(*keyed.columns)
    several = (F.col(key) >= _MADE) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    once = kept.filter(several).dropDuplicates([key])
    return kept.filter(~F.coalesce(several, F.lit(False))).unionByName(once).drop(key)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover half of a benchmark item or more, whether or not they have a doc_id.

    Rows that share a doc_id are judged each by its own text, equal rows alike. Null and empty texts
    stay. Items under three tokens condemn no document, as any text may hold a lone name or number.
    Texts are read whole.
    """
    scratch = Scratch(spark, "pipeline-leaks")
    keyed, key = _keyed(docs, scratch)
    leaks = contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key, least_tokens=3).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(scratch.table("leaks", leaks), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mask in the place of each secret; n_chars follows.

    No row goes. Rows are judged one by one, whatever their doc_id; a null text stays null (its n_chars
    too) and an empty one empty. Texts are read whole.
    """
    found = secrets(docs, mask=MASK, keep=[c for c in docs.columns if c not in ("doc_id", "text")])
    own = {"doc_id": F.col("doc_id"), "text": F.col("masked").alias("text"), "n_chars": F.length("masked").cast("long").alias("n_chars")}
    return found.select(*[own.get(c, F.col(f"kept.`{c}`")) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as the mix takes it: doc_id, source, size, copy (from 1) and the other columns of ``docs``.

    Rows that repeat a doc_id and a source come equally often; those without doc_id go by their text.
    Null and empty texts have size 0 and come as often as their source's rate says. A null source is
    one of its own. Columns of ``docs`` that are called size or copy stay, and the stage's own become
    size_ and copy_. Texts are read whole.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "source")]
    taken = mix(docs, keep=rest).filter("copies > 0")
    size, copy = F.col("size").alias(_free(docs, "size")), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(_free(docs, "copy"))
    return taken.select("doc_id", "source", size, copy, *[F.col(f"kept.`{c}`") for c in rest])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dups", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: Scores, similarities and tilings are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.table(name, stage(spark, docs, sf_dir))
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
