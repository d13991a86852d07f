"""Small expressions that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are maximal runs of characters outside this class.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def keep_rows(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """Rows of docs whose id is (left_semi) or is not (left_anti) in the first column
    of keys; a null id equals a null id. Columns of docs stay as they are."""
    inner = keys.select(F.col(keys.columns[0]).alias("__ff_key"))
    return docs.join(inner, docs[id_col].eqNullSafe(inner["__ff_key"]), how)
