"""Byte-pair encoding and decoding, with tree concatenation for long unsplit text.

A vocabulary splits a text into pieces before it merges bytes, and a piece such
as a word is short. A piece without a split can be as long as the text. Such a
piece is cut into leaves, the leaves are encoded side by side, and halves are
joined pairwise up a tree: a window around the join is encoded again and grows
until its first and last tokens are those that both sides already have there.

A token sequence is the encoding of its bytes exactly if every two neighbours
are the encoding of theirs. Each side and the window are encodings, and they
overlap in a whole token, so the joined sequence is the encoding of the whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level vocabularies of this kind split a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of a leaf; pieces up to this size are encoded at once.
LEAF = 1024


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def join(left: list[int], right: list[int], encode: Callable[[bytes], list[int]], token: Callable[[int], bytes]) -> list[int]:
    """The encoding of the concatenated bytes of two encodings."""
    k = 4
    while left and right:
        a, b = left[-k:], right[:k]
        window = encode(b"".join(map(token, a + b)))
        if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
            return left[: len(left) - len(a)] + window + right[len(b) :]
        k *= 2
    return left or right


class Codec:
    """Encodes and decodes as the vocabulary file's own library does, special tokens in the text included."""

    def __init__(self, vocabulary: str, leaf: int = LEAF):
        model = json.loads(vocabulary)
        symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(symbols[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in self.special}
        for k, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if ranks[bytes(symbols[c] for c in a + b)] != 256 + k:
                raise ValueError("the ids of this vocabulary are not in the order of its merges")
        self.leaf = leaf
        self.base = tiktoken.Encoding("latticevec", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.pieces = regex.compile(PATTERN)
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.longest = leaf // 4  # characters of a run: at most a leaf of bytes
        self.spaces = re.compile(rf"\s{{{self.longest + 1}}}")
        self.pool = ThreadPoolExecutor(2)

    def piece(self, data: bytes) -> list[int]:
        return self.base._encode_single_piece(data)

    def tree(self, data: bytes) -> list[int]:
        """The encoding of one piece, however long."""
        leaves = [data[k : k + self.leaf] for k in range(0, len(data), self.leaf)]
        level = list(self.pool.map(self.piece, leaves))
        while len(level) > 1:
            halves = [level[k : k + 2] for k in range(0, len(level), 2)]
            level = list(self.pool.map(lambda p: p[0] if len(p) == 1 else join(p[0], p[1], self.piece, self.base.decode_single_token_bytes), halves))
        return level[0] if level else []

    def short_runs(self, text: str) -> bool:
        """Whether no run of white space or of other characters is long, so that the library encodes the text at once."""
        if len(text) <= self.leaf:
            return True
        words = text.split()
        if max(map(len, words), default=0) > self.longest:
            return False
        # A long run leaves one space at least for each other gap between words; only texts with so much space are searched.
        return len(text) - sum(map(len, words)) < self.longest + len(words) - 1 or not self.spaces.search(text)

    def encode(self, text: str, special: bool = True) -> list[int]:
        """The ids of a text; without ``special``, special tokens in it are ordinary text."""
        if self.short_runs(text):
            return self.base.encode(text, allowed_special="all") if special else self.base.encode_ordinary(text)
        out: list[int] = []
        for part in self.cuts.split(text) if special and self.cuts else [text]:
            if special and part in self.special:
                out.append(self.special[part])
                continue
            for m in self.pieces.finditer(part):
                data = m[0].encode()
                out += self.piece(data) if len(data) <= self.leaf else self.tree(data)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.base.decode(ids, errors="replace")


_CODECS: dict[int, Codec] = {}


def codec(vocabulary: str) -> Codec:
    """One codec per worker process and vocabulary."""
    if (key := hash(vocabulary)) not in _CODECS:
        _CODECS[key] = Codec(vocabulary)
    return _CODECS[key]


def _scan(docs: DataFrame, path: str, doc_id: str, text: str, row: Callable[[Codec, str], tuple], fields: list[pa.Field], schema: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:  # a vocabulary's size doesn't grow with the corpus
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary.value)
        for batch in batches:
            made = [row(tool, t or "") for t in batch.column(1).to_pylist()]
            columns = [pa.array([m[k] for m in made], f.type) for k, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *[f.name for f in fields]])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(scan, f"doc_id long, {schema}")


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): each whole text's token ids. Null text counts as empty and has no ids; repeated rows stay."""
    return _scan(docs, path, doc_id, text, lambda c, t: (c.encode(t),), [pa.field("ids", pa.list_(pa.int32()))], "ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids count as none."""
    return _scan(encoded, path, "doc_id", "ids", lambda c, ids: (c.decode(list(ids)),), [pa.field("text", pa.string())], "text string")


def _digest(tool: Codec, text: str) -> tuple[int, str, str]:
    ids = tool.encode(text)
    back = tool.decode(ids)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each whole text encoded and decoded again.

    Null and empty texts have no tokens and the digests of the empty string.
    Rows without an id and repeated rows stay; other columns are ignored.
    """
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    return _scan(docs, path, doc_id, text, _digest, fields, "n_tokens long, ids_sha256 string, decoded_sha256 string")
