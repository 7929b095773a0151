"""Fill-in-the-middle: texts cut at two unit bounds and put together in another order.

An Arrow-batched pandas UDF. ``finditer`` of the regex library gathers the end offsets of a text's
units in a compact array, so no unit becomes an object; two lookups in it give the slices. The choices
of a document are digits of a SHA-256 digest over a seed and its id, so reruns and retried tasks agree.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A unit is a line with its end.
LINES = r"[^\n]*\n|[^\n]+"
#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
_SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def restored(output: str, form: str, marks: Sequence[str] = MARKS) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    p, s, m = marks
    first, second = (p, s) if form == "psm" else (s, p)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(m)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def transformed(text: str, key: str, unit: regex.Pattern, rate: int, spm_rate: int, marks: Sequence[str] = MARKS) -> tuple:
    """(units, form, characters of the prefix, of the middle, output) of one text."""
    ends = array("q", (x.end() for x in unit.finditer(text)))
    n = len(ends)
    digest = hashlib.sha256(key.encode("utf-8", "surrogatepass")).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(x in text for x in marks) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[low - 1] if low else 0), (ends[high - 1] if high else 0)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    form, output = ("spm", f"{s}{suffix}{p}{prefix}{m}{middle}") if h4 % 100 < spm_rate else ("psm", f"{p}{prefix}{s}{suffix}{m}{middle}")
    return n, form, a, b - a, output


def fill_in_middle(
    docs: DataFrame, unit: str = LINES, seed: str = "7", rate: int = 100, spm_rate: int = 50, marks: Sequence[str] = MARKS, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """Per row of ``docs``: doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if plain), output, and the SHA-256 digests of the output and of the text rebuilt from it; then the columns of ``keep`` as a struct.

    ``unit`` is a pattern of the regex library whose matches, from left to right, cover the text; text
    after the last match belongs to the suffix. Of 100 documents, about ``rate`` are cut, and about
    ``spm_rate`` of these put the suffix first. A null or empty text is plain with the output "", and so
    is, unchanged, a text that holds a mark. A null id counts as an empty one; rows that share an id and
    a text come out alike, each as a row of its own. Other columns are ignored. Texts are read whole;
    one text and its output are in memory at a time besides the rest of their batch.
    """
    compiled = regex.compile(unit)

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows = []
            for i, text in zip(ids, texts, strict=True):
                text = text if isinstance(text, str) else ""
                n, form, a, b, output = transformed(text, f"{seed}:{i if isinstance(i, str) else ''}", compiled, rate, spm_rate, marks)
                rows.append((n, form, a, b, output, _sha256(output), _sha256(restored(output, form, marks))))
            names = [x.split()[0] for x in _SCHEMA.split(", ")]
            yield pd.DataFrame(rows, columns=names).astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    udf = F.pandas_udf(cut, _SCHEMA)
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []
    out = docs.select(F.col(id_col).alias("doc_id"), udf(F.col(id_col).cast("string"), F.col(text_col)).alias("cut"), *kept)
    return out.select("doc_id", "cut.*", *(["kept"] if keep else []))
