"""Token counts of flat token files, by a scan for separators.

A flat token file is nothing but token ids of two bytes each, high byte first,
with an end-of-document id after each document; it has no index. A file is cut
into ranges, and a range is read a block at a time and each block searched for
separators by one vectorised comparison. The last separator of each range is
found first, by blocks from its end; a prefix scan over the ranges of a file
hands each range the last separator before it, so that documents that run over
boundaries are put together, however many they run over.

Spark's text writer makes such files on any store: the separator that it puts
after each record is the end-of-document id, as the two bytes of a character.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticevec.llm.bpe import codec
from latticevec.llm.common import checkpoint, shared_dir
from latticevec.lineage import remove
from latticevec.sources.formats import filesystem, files_of

#: The end-of-document id: above the vocabulary, and its two bytes are a character of UTF-8.
SEPARATOR = 50304
#: Tokens in front of each document that hold its id, in digits of 15 bits, which no separator can be mistaken for.
HEADER = 5
_NO_ID = 1 << 14
#: Tokens that are searched at once, and bytes of a range, which is a task's work.
BLOCK_TOKENS, RANGE_BYTES = 1 << 18, 1 << 26


def header(doc_id: int | None) -> list[int]:
    bits = 0 if doc_id is None else doc_id & ((1 << 64) - 1)
    digits = [(bits >> (15 * k)) & 0x7FFF for k in range(HEADER)]
    return [*digits[:-1], digits[-1] | (_NO_ID if doc_id is None else 0)]


def write_token_files(docs: DataFrame, path: str, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", separator: int = SEPARATOR) -> None:
    """Encode all texts into flat token files under ``path``: for each document its header, its tokens and the separator.

    Special tokens in a text are ordinary text. Null text counts as empty.
    """
    mark = separator.to_bytes(2, "big").decode("utf-8")  # raises for ids that the writer can't put
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary.value)
        for batch in batches:
            made = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = value or ""
                if tool.short_runs(value):
                    ids = tool.base.encode_to_numpy(value, allowed_special=set(), disallowed_special=())
                else:
                    ids = np.array(tool.encode(value, special=False), np.uint32)
                if len(ids) and ids.max() >= separator:
                    raise ValueError("the separator must be above all ids of the vocabulary")
                made.append(np.concatenate([np.array(header(key)), ids]).astype(">u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["tokens"])

    rows = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(scan, "tokens binary")
    rows.select(F.col("tokens").cast("string").alias("value")).write.option("lineSep", mark).text(path)


def _readable(path: str) -> bool:
    """Whether Arrow can read ranges of the files under a path."""
    try:
        files_of(path)
    except (pa.ArrowException, OSError, ValueError, NotImplementedError):
        return False
    return True


def _opened(file: str, content: bytes | None) -> pa.NativeFile:
    if content is not None:
        return pa.BufferReader(content)
    fs, at = filesystem(file)
    return fs.open_input_file(at)


def read_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, k, begin, end, whole, content): the files under ``path`` in ranges of bytes, ``whole`` the file's length.

    Files have any length where Arrow can read ranges of them; on other stores
    Spark reads whole files, of up to 2 GB, and ``content`` has their bytes.
    """
    ranged = _readable(path)
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    content = F.lit(None).cast("binary") if ranged else F.col("content")
    size = range_bytes if ranged else 1 << 31
    rows = files.select(F.col("path").alias("file"), F.col("length").alias("whole"), content.alias("content"))
    rows = rows.select("*", F.explode(F.expr(f"sequence(0L, (whole - 1) div {size}L)")).alias("k"))
    return rows.selectExpr("file", "k", f"k * {size}L AS begin", f"least(whole, (k + 1) * {size}L) AS end", "whole", "content")


def count_tokens(ranges: DataFrame, separator: int = SEPARATOR, head: int = HEADER, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: file, start (of its first token in the file), n_tokens, head (its first ``head`` tokens, fewer at a file's end).

    Two separators in a row enclose an empty document; tokens after the last
    separator are a document too. Ranges come in any order.
    """
    block = 2 * block_tokens

    def tokens(f: pa.NativeFile, a: int, b: int) -> np.ndarray:
        f.seek(a)
        return np.frombuffer(f.read(b - a), ">u2")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last separator of each range, as a token of its file."""
        for batch in batches:
            found: list[int | None] = []
            for file, begin, end, content in zip(*[batch.column(c).to_pylist() for c in ("file", "begin", "end", "content")], strict=True):
                found.append(None)
                with _opened(file, content) as f:
                    while found[-1] is None and end > begin:
                        a = max(begin, end - block)
                        at = np.flatnonzero(tokens(f, a, end) == separator)
                        found[-1], end = (a // 2 + int(at[-1]) if len(at) else None), a
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("file", "k")], pa.array(found, pa.int64())], ["file", "k", "last"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents whose separators are in a range; the last range of a file also has what follows its last separator."""
        for batch in batches:
            for file, begin, end, whole, content, before in zip(*[batch.column(c).to_pylist() for c in ("file", "begin", "end", "whole", "content", "before")], strict=True):
                with _opened(file, content) as f:
                    open_at = -1 if before is None else before  # the separator before the document that is open
                    for a in range(begin, end, block):
                        b = min(end, a + block)
                        own = tokens(f, a, min(whole, b + 2 * head))
                        at = np.flatnonzero(own[: (b - a) // 2] == separator) + a // 2
                        if b == whole and own[-1] != separator:
                            at = np.append(at, whole // 2)
                        if not len(at):
                            continue
                        start = np.append(open_at, at[:-1]) + 1
                        heads = [own[s - a // 2 : s - a // 2 + head].tolist() for s in start[1:].tolist()]
                        heads.insert(0, tokens(f, 2 * int(start[0]), min(whole, 2 * (int(start[0]) + head))).tolist())
                        open_at = int(at[-1])
                        yield pa.RecordBatch.from_arrays([pa.array([file] * len(at), pa.string()), pa.array(start), pa.array(at - start), pa.array(heads, pa.list_(pa.int32()))], ["file", "start", "n_tokens", "head"])

    # A range is work for a task, whatever its row weighs.
    parts = max(1, ranges.count())
    before = Window.partitionBy("file").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    lasts = ranges.repartition(parts, "file", "k").mapInArrow(last, "file string, k long, last long")
    carried = lasts.select("file", "k", F.max("last").over(before).alias("before"))
    return ranges.join(carried, ["file", "k"]).repartition(parts, "file", "k").mapInArrow(scan, "file string, start long, n_tokens long, head array<int>")


def count_documents(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_tokens) of every document, through flat token files in the shared folder, which are deleted when they are counted.

    Null and empty texts have no tokens; rows without an id and repeated rows
    stay; no documents give an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, vocabulary_path, doc_id, text)
    rows = count_tokens(read_ranges(spark, path), block_tokens=block_tokens)
    value = " | ".join(f"shiftleft(bigint(head[{k}]{f' & {_NO_ID - 1}' if k == HEADER - 1 else ''}), {15 * k})" for k in range(HEADER))
    out = checkpoint(rows.select(F.expr(f"if(head[{HEADER - 1}] >= {_NO_ID}, null, {value})").alias("doc_id"), (F.col("n_tokens") - HEADER).alias("n_tokens")))
    remove(spark, path)
    return out
