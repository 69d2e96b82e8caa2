import hashlib

from tokenizers import Tokenizer

import corpus_pipeline
from latticevec.llm import quality
from latticevec.llm.queries import VOCABULARY

from .test_decontam import brute as leaks_of
from .test_lines import brute as lines_of
from .test_simhash import components, slow_fingerprint


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas().text.tolist()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
    model, now = quality.fit(docs, labels), docs
    for name, stage in stages.items():
        before = now.toPandas()
        now = stage(spark, now, sf_dir).cache()
        after = now.toPandas()
        ids = set(after.doc_id)
        if name != "BPE encoding and decoding":
            assert now.columns == docs.columns and now.dtypes == docs.dtypes
        if name == "quality classifier":
            assert ids == {i for i, t, n in zip(before.doc_id, before.text, before.n_chars, strict=True) if model.score(t.encode(), n) >= quality.THRESHOLD}
            known = labels.toPandas().set_index("doc_id").quality
            kept = [known[i] for i in ids if i in known.index]
            assert sum(kept) / len(kept) > 0.98 and len(ids & set(known.index[known == 1])) > 0.95 * (known == 1).sum()
        elif name == "line dedup":
            assert dict(zip(after.doc_id, after.text, strict=True)) == lines_of(list(zip(before.doc_id, before.text, strict=True)))
            assert (after.n_chars == after.text.str.len()).all()
        elif name == "SimHash near-dedup":
            parts = components([slow_fingerprint(t) for t in before.text], before.doc_id.tolist())
            assert ids == set(parts) and len(after) == len(ids)
        elif name == "benchmark decontamination":
            exact = {i for i, t in zip(before.doc_id, before.text, strict=True) if any(x in t for x in items)}
            gone = set(before.doc_id) - ids
            assert exact <= gone
            leaking = {before.doc_id[d] for d, _ in leaks_of(before.text.tolist()[:10], items)}
            assert gone & set(before.doc_id[:10]) == leaking
        else:
            assert ids == set(before.doc_id) and set(after.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
            library, rows = Tokenizer.from_file(VOCABULARY), after.set_index("doc_id")
            for i, t in zip(before.doc_id, before.text, strict=True):
                tokens, digest = library.encode(t, add_special_tokens=False).ids, lambda s: hashlib.sha256(s.encode()).hexdigest()
                assert tuple(rows.loc[i]) == (len(tokens), digest(",".join(map(str, tokens))), digest(library.decode(tokens, skip_special_tokens=False)))


def test_run_is_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, docs.collect()))


def test_odd_rows_pass_through_all_stages(spark, odd_docs, sf_dir):
    columns = odd_docs.select("doc_id", "text", "root", "score", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        columns = stage(spark, columns, sf_dir)
        assert columns.count() >= 0, name
