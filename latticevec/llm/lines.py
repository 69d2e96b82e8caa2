"""Line dedup over overlapping three-line windows, in DataFrame functions only.

Every three consecutive lines of a document make a window. Windows are equal if
their lines are; the first occurrence, by document id and then position, stays,
and every later one covers its three lines. A document keeps the lines that no
later occurrence covers, so overlapping windows merge into whole passages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticevec.llm.common import KEY, row_key

LINES = 3
#: Where a window stands: rows with an id come first, by id.
PLACE = "struct(__lv_none, __lv_key, __lv_text_key, i)"


def _windows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(__lv_none, key, i, h, g): a row for each window that isn't blank; h and g are two 64-bit hashes of its lines."""
    lines = docs.select(F.col(doc_id).isNull().alias("__lv_none"), *row_key(doc_id, text), F.split(F.col(text), "\n", -1).alias("lines"))
    made = """transform(sequence(0, size(lines) - 3), i -> struct(i,
        xxhash64(lines[i], lines[i + 1], lines[i + 2]) AS h, xxhash64(lines[i + 2], 1, lines[i + 1], lines[i]) AS g,
        trim(BOTH ' \t\r\f\u000b' FROM lines[i]) = '' AND trim(BOTH ' \t\r\f\u000b' FROM lines[i + 1]) = '' AND trim(BOTH ' \t\r\f\u000b' FROM lines[i + 2]) = '' AS blank))"""
    rows = lines.where("size(lines) >= 3").select("__lv_none", *KEY, F.expr(f"inline({made})"))
    return rows.where("not blank").drop("blank")


def covered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, at): for each document with later occurrences, the positions of their first lines."""
    windows = _windows(docs, doc_id, text)
    first = windows.groupBy("h", "g").agg(F.min(F.expr(PLACE)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["h", "g"]).where(f"{PLACE} <> first")
    return later.groupBy(*KEY).agg(F.collect_set("i").alias("__lv_at"))


def _kept() -> Column:
    return F.expr("array_except(sequence(0, size(__lv_lines) - 1), flatten(transform(__lv_at, p -> array(p, p + 1, p + 2))))")


def _merged(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select("*", *row_key(doc_id, text)).join(covered(docs, doc_id, text), KEY, "left")
    rows = rows.withColumn("__lv_lines", F.split(F.col(text), "\n", -1))
    rows = rows.withColumn("__lv_kept", F.when(F.col("__lv_at").isNotNull(), _kept()))
    same = F.col("__lv_kept").isNull()
    rest = F.expr("array_join(transform(__lv_kept, i -> __lv_lines[i]), '\n')")
    return rows.withColumn("__lv_new", F.when(same, F.col(text)).otherwise(rest)).withColumn("__lv_removed", F.when(same, 0).otherwise(F.size("__lv_lines") - F.size("__lv_kept")))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text without later occurrences, n_lines, n_removed.

    Null text stays null with no lines; documents of fewer than three lines stay
    as they are, as do windows of ASCII white space only. Where a window overlaps
    its own first occurrence, as in a run of equal lines, what the two share goes
    too: of five equal lines one stays. A document all of whose
    lines are covered has an empty text. Rows without an id come last in the
    order, by a hash of their text. Rows equal in id and text are one document:
    all of them keep the same lines. Other columns are ignored.
    """
    rows = _merged(docs, doc_id, text)
    lines = F.coalesce(F.size("__lv_lines").cast("long"), F.lit(0))
    return rows.select(F.col(doc_id).alias("doc_id"), F.col("__lv_new").alias("text"), F.when(F.col(text).isNull(), 0).otherwise(lines).cast("long").alias("n_lines"), F.col("__lv_removed").cast("long").alias("n_removed"))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None) -> DataFrame:
    """The documents, all columns, with the text that :func:`dedup_lines` gives them; ``n_chars``, if given, is set anew where the text changed."""
    rows = _merged(docs, doc_id, text)
    length = F.when(F.col("__lv_removed") > 0, F.length("__lv_new")).otherwise(F.col(n_chars)) if n_chars in docs.columns else None
    new = {text: F.col("__lv_new"), n_chars: length if length is None else length.cast(docs.schema[n_chars].dataType)}
    return rows.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


#: DuckDB SQL for the rows of ``dedup_lines`` over a table ``documents`` with distinct ids.
ORACLE_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
p AS (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS i FROM l WHERE len(lines) >= 3),
w AS (SELECT doc_id, i, lines[i + 1] || chr(10) || lines[i + 2] || chr(10) || lines[i + 3] AS w FROM p),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM w WHERE trim(w, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
c AS (SELECT DISTINCT doc_id, i + d AS pos FROM r, (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1),
x AS (SELECT doc_id, lines, unnest(range(0, len(lines))) AS pos FROM l),
k AS (SELECT x.doc_id, x.pos, x.lines[x.pos + 1] AS line FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.pos = c.pos WHERE c.pos IS NULL),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM k GROUP BY doc_id)
SELECT l.doc_id, coalesce(t.text, '') AS text, CAST(len(l.lines) AS BIGINT) AS n_lines, CAST(len(l.lines) - coalesce(t.n, 0) AS BIGINT) AS n_removed
FROM l LEFT JOIN t ON l.doc_id = t.doc_id
"""
