import numpy as np
import pytest
from tokenizers import Tokenizer

from latticevec.llm import tokens
from latticevec.llm.queries import QUERIES, VOCABULARY

END = tokens.SEPARATOR


def write(tmp_path, name, ids):
    (tmp_path / name).write_bytes(np.array(ids, ">u2").tobytes())


def brute(ids, head):
    out, start = [], 0
    for k, t in enumerate([*ids, END] if ids and ids[-1] != END else ids):
        if t == END:
            out.append((start, k - start, ids[start : start + head]))
            start = k + 1
    return out


@pytest.mark.parametrize(("block", "size"), [(1, 1), (1, 3), (2, 5), (3, 7), (7, 1000), (1000, 7)])
def test_ranges_and_blocks_are_stitched(spark, tmp_path, block, size, monkeypatch):
    draw = np.random.default_rng(block)
    files = {"a": [1, 2, END, END, 3, 4, 5, 6, 7, 8, END], "b": [9], "c": [END], "d": draw.choice([END, 1, 2, 0xC4, 0x80C4, 0xC480 - 1], 200).tolist(), "e": []}
    for name, ids in files.items():
        write(tmp_path, name, ids)
    ranges = tokens.read_ranges(spark, str(tmp_path), 2 * size).repartition(5)
    assert ranges.count() > 5 or size > 3
    got = tokens.count_tokens(ranges, END, 2, block).collect()
    monkeypatch.setattr(tokens, "_readable", lambda path: False)
    assert sorted(got) == sorted(tokens.count_tokens(tokens.read_ranges(spark, str(tmp_path)), END, 2, block).collect())
    for name, ids in files.items():
        mine = sorted((r["start"], r["n_tokens"], r["head"]) for r in got if r["file"].endswith("/" + name))
        expected = brute(ids, 2)
        assert [m[:2] for m in mine] == [e[:2] for e in expected]
        for (_, n, head), (_, _, wanted) in zip(mine, expected, strict=True):
            assert head[: min(n, 2)] == wanted[: min(n, 2)]


def test_query(spark, sf_dir):
    library = Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op4_token_counts"](spark, sf_dir).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in zip(docs.doc_id, docs.text, strict=True)}


def test_files_of_any_length_are_read_by_ranges(spark, tmp_path):
    """A file with holes, of more than 2 GB: two documents in all."""
    with open(tmp_path / "a", "wb") as f:
        f.truncate(2_500_000_000)
        f.seek(2_400_000_000)
        f.write(END.to_bytes(2, "big"))
    got = tokens.count_tokens(tokens.read_ranges(spark, str(tmp_path), 1 << 28)).collect()
    assert sorted((r["start"], r["n_tokens"]) for r in got) == [(0, 1_200_000_000), (1_200_000_001, 49_999_999)]


def test_token_files_are_deleted(spark, docs_of):
    from pathlib import Path

    folder = Path(tokens.shared_dir(spark).removeprefix("file:"))
    assert tokens.count_documents(docs_of(["a b c"]), VOCABULARY).collect()[0]["n_tokens"] == 3
    assert not list(folder.glob("tokens-*"))


def test_odd_rows(odd_docs, no_docs, docs_of):
    got = tokens.count_documents(odd_docs, VOCABULARY, block_tokens=1000)
    assert got.count() == odd_docs.count()
    assert sorted(r["n_tokens"] for r in got.where("doc_id is null").collect())[0] == 0
    assert tokens.count_documents(no_docs, VOCABULARY).count() == 0
    ids = [0, -1, 1 << 62, -(1 << 63), (1 << 63) - 1, 0xC480, 50304 * 50304]
    assert {r["doc_id"] for r in tokens.count_documents(docs_of([(i, "x<|endoftext|>") for i in ids]), VOCABULARY).collect()} == set(ids)


def test_long_runs_of_white_space(docs_of):
    library = Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    texts = ["a" + " " * 2_000_000 + "b", "\n" * 2_000_000, "<|endoftext|>" + "x" * 5000, "a b"]
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_documents(docs_of(texts), VOCABULARY).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_separators_that_cannot_be_written_are_refused(docs_of, tmp_path):
    with pytest.raises(UnicodeDecodeError):
        tokens.write_token_files(docs_of(["a"]), str(tmp_path / "x"), VOCABULARY, separator=50257)
