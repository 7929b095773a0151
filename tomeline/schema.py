"""Types of the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import types as T

SYMBOLS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("qualified_name", T.StringType(), False),
        T.StructField("symbol_type", T.StringType(), False),
        T.StructField("signature", T.StringType()),
        T.StructField("docstring", T.StringType()),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("line_no", T.IntegerType(), False),
        T.StructField("bases", T.ArrayType(T.StringType(), False), False),
        T.StructField("return_annotation", T.StringType()),
        T.StructField("source_key", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
    ]
)

PACKAGES = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("source_path", T.StringType(), False),
        T.StructField("mtime", T.DoubleType(), False),
        T.StructField("symbol_count", T.LongType(), False),
    ]
)

REEXPORTS = T.StructType(
    [
        T.StructField("init_module", T.StringType(), False),
        T.StructField("ord", T.IntegerType(), False),
        T.StructField("local_name", T.StringType(), False),
        T.StructField("source_module", T.StringType(), False),
        T.StructField("source_name", T.StringType(), False),
        T.StructField("is_module", T.BooleanType(), False),
    ]
)

# What a search result's order makes of a symbol's type.
TYPE_RANK = {"module": 0, "class": 1, "function": 2, "async_function": 2, "method": 3, "async_method": 3}
OTHER_RANK = 4

#: Rows that a ranked stage fetches before it sorts by type and name.
FETCH_CAP = 200
#: Least similarity of a fuzzy match, in percent.
FUZZY_CUTOFF = 60
#: Prefix of names and paths of project directories among the packages.
PROJECT_PREFIX = "project:"
