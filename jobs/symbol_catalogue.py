"""Keeps a searchable symbol catalogue up to date with its tables.

    python -m jobs.symbol_catalogue --input /data/tables --output /data/catalogue

Users of a symbol index want to search what the tables hold now without indexing all of it again. The job
projects the tables onto symbols, sums up each source (the namespace that a symbol lies in) in one
aggregate, compares this with what it noted last time, and hands the sources that differ to
:class:`tomeline.plans.segments.Segments`, which writes them, with their part of the full-text index, to
partitions of a new run. A run over unchanged tables writes nothing; one that was killed is made up for by
the next.

Output, under ``output``, each partitioned by run: ``rows`` sorted by name, ``tree`` sorted by parent,
``postings``, ``lengths``, ``totals``, ``shadowed``, and ``state`` with a row for each source. Read it with
``Segments(spark, output).symbols()``, ``.tree()`` and ``.index()``.
"""

from __future__ import annotations

import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.run import main
from tomeline.fixtures import raw_symbols
from tomeline.functions.columns import parent
from tomeline.operators import maintain
from tomeline.plans.segments import MOST_RUNS, Segments

log = logging.getLogger("symbol_catalogue")


def symbols_of_tables(spark: SparkSession, tables: str) -> DataFrame:
    """Symbols of the tables with the source each belongs to: the namespace above it, or its own name at the top."""
    return raw_symbols(spark, tables).withColumn("source_key", parent("qualified_name"))


def marks(rows: DataFrame) -> DataFrame:
    """(source_key, source_path, mark, first_id) of each source; marks differ if any row of the source does, whatever the order of rows."""
    digest = F.xxhash64(*[c for c in rows.columns if c != "source_key"])
    mark = F.concat_ws(":", F.count("*"), F.hex(F.bit_xor(digest)), F.hex(F.sum(digest.bitwiseAND(0xFFFFFFFF))))
    return rows.groupBy("source_key").agg(F.first("source_key").alias("source_path"), mark.alias("mark"), F.min("id").alias("first_id"))


def refresh(spark: SparkSession, input: str, output: str, most_runs: int = MOST_RUNS) -> dict:
    """Brings the catalogue in ``output`` up to date with the tables in ``input``; what was read and written."""
    rows = symbols_of_tables(spark, input)
    now = marks(rows)
    segments = Segments(spark, output, stemmed=False)
    before = segments.run()
    known = segments.state(before).select(F.col("source_key").alias("name"), F.col("mark").alias("mtime")) if before else spark.createDataFrame([], "name string, mtime string")
    # The library compares sources by what stands for their time of change.
    plan = maintain.changes(now.select(F.col("source_key").alias("name"), F.col("mark").alias("mtime")), known)
    counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
    n_rows = now.agg(F.sum(F.split_part("mark", F.lit(":"), F.lit(1)).cast("long"))).first()[0] or 0
    log.info("read %d symbols of %d sources from %s: %s", n_rows, sum(counts.values()) - counts.get("removed", 0), input, counts)
    done = {"read": n_rows, "run": before, "written": 0, **{a: counts.get(a, 0) for a in ("new", "changed", "removed", "unchanged")}}
    if not (done["new"] or done["changed"] or done["removed"]):
        log.info("nothing to write: %s is up to date with run %d", output, before)
        return done
    differ = plan.filter(F.col("action").isin("new", "changed")).select(F.col("name").alias("source_key"))
    gone = plan.filter("action = 'removed'").select(F.col("name").alias("source_key"))
    done["run"] = segments.refresh(rows.join(differ, "source_key", "left_semi"), now.join(differ, "source_key", "left_semi"), gone)
    done["written"] = segments.state(done["run"]).filter(F.col("at") == done["run"]).agg(F.coalesce(F.sum("n_symbols"), F.lit(0))).first()[0]
    log.info("wrote %d symbols of %d sources as run %d to %s", done["written"], done["new"] + done["changed"], done["run"], output)
    merged = segments.merge(most_runs)
    if merged != done["run"]:
        log.info("merged small runs into run %d", merged)
    return done


def output(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue as it stands: each symbol with its source, its parent and the words that the index has of it."""
    segments = Segments(spark, folder, stemmed=False)
    run = segments.run()
    rows = segments.symbols(run).join(segments.index(run).lengths, "id")
    return rows.select("id", "source_key", "name", "qualified_name", "symbol_type", "signature", "parent_key", F.col("dl").alias("n_words"))


if __name__ == "__main__":
    sys.exit(main(refresh, os.path.join(os.path.dirname(os.path.abspath(__file__)), "symbol_catalogue.toml")))
