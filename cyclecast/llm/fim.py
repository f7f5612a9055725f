"""Fill-in-the-middle: texts cut at two token boundaries and laid out anew, by DuckDB on Arrow batches.

Each batch that Spark hands to a task is registered as a table, one SQL statement makes its new columns,
and they go back as Arrow beside the batch's own. No row is touched in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclecast.llm.common import fresh

#: What a text is cut into: runs of ASCII letters, and each other code point by itself.
TOKENS = "[A-Za-z]+|[^A-Za-z]"
#: Marks before the prefix, the suffix and the middle. Texts that hold one stay as they are.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_NEW = "n long, form string, prefix_chars long, middle_chars long, output string"


def _hashed(at: int) -> str:
    return f"CAST('0x' || h[{8 * at + 1}:{8 * at + 8}] AS BIGINT)"


def transform_sql(seed: int, plain_percent: int, spm_percent: int) -> str:
    """The statement of ``transform`` over ``batch(id, text)``."""
    return f"""
WITH cut AS (
  SELECT coalesce(text, '') AS text, sha256('{seed}:' || coalesce(CAST(id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '{TOKENS}') AS t FROM batch),
chosen AS (
  SELECT text, t, CAST(len(t) AS BIGINT) AS n, {_hashed(0)} % (len(t) + 1) AS one, {_hashed(1)} % (len(t) + 1) AS two,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {_hashed(2)} % 100 >= {100 - plain_percent} THEN 'plain'
      WHEN {_hashed(3)} % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT text, n, form, array_to_string(list_slice(t, 1, least(one, two)), '') AS prefix,
    array_to_string(list_slice(t, least(one, two) + 1, greatest(one, two)), '') AS middle,
    array_to_string(list_slice(t, greatest(one, two) + 1, n), '') AS suffix
  FROM chosen)
SELECT n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
    ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output
FROM parts"""


#: The statement of ``restore`` over ``batch(output, form)``: each mark is there once, and none overlaps another.
RESTORE_SQL = f"""
SELECT CASE form
  WHEN 'psm' THEN substr(split_part(output, '{SUFFIX}', 1), {len(PREFIX) + 1}) || split_part(output, '{MIDDLE}', 2) || split_part(split_part(output, '{SUFFIX}', 2), '{MIDDLE}', 1)
  WHEN 'spm' THEN split_part(split_part(output, '{PREFIX}', 2), '{MIDDLE}', 1) || split_part(output, '{MIDDLE}', 2) || substr(split_part(output, '{PREFIX}', 1), {len(SUFFIX) + 1})
  ELSE output END AS restored
FROM batch"""


def _with_sql(df: DataFrame, read: dict[str, str], statement: str, new: str) -> DataFrame:
    """``df`` with the columns ``new`` (names that ``df`` has get an underscore) of ``statement``, which reads
    the columns ``read`` (column: name there) of each batch as the table ``batch``."""
    at = {df.columns.index(column): name for column, name in read.items()}
    added = [(fresh(df, x.split()[0]), x.split()[1]) for x in new.split(", ")]
    types = [pa.int64() if kind == "long" else pa.string() for _, kind in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one thread, for tasks share the machine, and no files beside Spark's
        connection = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        for batch in batches:
            if batch.num_rows:
                connection.register("batch", pa.table([batch.column(i) for i in at], list(at.values())))
                made = connection.sql(statement).to_arrow_table().combine_chunks()
                connection.unregister("batch")
                columns = [c.chunk(0).cast(t) for c, t in zip(made.columns, types)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(name for name, _ in added)])
        connection.close()

    schema = df.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in added)).schema
    return df.mapInArrow(run, schema)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output (names it has get an underscore).

    Text is cut into ``TOKENS``; two places among them, drawn from the SHA-256 of ``seed:id``, bound the
    middle. psm is ``<P>prefix<S>suffix<M>middle``, spm ``<S>suffix<P>prefix<M>middle``; plain, the text as
    it is, are ``plain_percent`` of all, empty texts, and texts that hold a mark. Null texts count as
    empty, null ids as an empty id; rows that repeat give the same row; an empty table gives no row. Texts
    of any length are cut whole: a task holds one batch (``prepare`` bounds it) or one longer text.
    """
    if not (0 <= plain_percent <= 100 and 0 <= spm_percent <= 100):
        raise ValueError("percents are from 0 to 100")
    return _with_sql(docs, {id_col: "id", text_col: "text"}, transform_sql(seed, plain_percent, spm_percent), _NEW)


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """``rows`` with restored, the exact text that ``transform`` made the output from (empty for null ones)."""
    return _with_sql(rows, {output_col: "output", form_col: "form"}, RESTORE_SQL, "restored string")


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n, form, prefix_chars, middle_chars and the digests of output and restored text,
    all made in one pass over the batch."""
    statement = f"""
WITH made AS MATERIALIZED ({transform_sql(1, 10, 20)}),
restored AS ({RESTORE_SQL.replace("SELECT", "SELECT n, form, prefix_chars, middle_chars, output,", 1).replace("FROM batch", "FROM made")})
SELECT n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM restored"""
    new = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return _with_sql(docs.select("doc_id", "text"), {"doc_id": "id", "text": "text"}, statement, new).drop("text")
