import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticevec.llm import quality, toxicity
from latticevec.llm.queries import QUERIES


def accuracy(got, labels, column):
    m = got.merge(labels, on="doc_id")
    held = m[m.held_out]
    return (held.predicted == held[column]).mean(), len(held)


@pytest.mark.parametrize(("query", "column", "parts", "out", "threshold", "least"), [("op10_quality", "quality", 5, 0, 0.3, 0.95), ("op7_toxicity", "toxic", 3, 1, 0.7, 0.93)])
def test_held_out_rows(spark, query, column, parts, out, threshold, least):
    sf_dir = "/root/testdata/sf0.01"
    got = QUERIES[query](spark, sf_dir).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % parts == out for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= threshold)).all()
    right, n = accuracy(got, spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas(), column)
    assert n > 50 and right >= least


def test_sum_of_squares_identity():
    draw = np.random.default_rng(0)
    size = (1 << quality.WORD_BITS) + quality.STATISTICS * (1 + quality.BINS)
    model = quality.Model(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS), np.zeros((quality.STATISTICS, quality.BINS - 1)), 0.3, draw.normal(size=size), draw.normal(size=(size, 4)))
    index, x = draw.choice(size, 20, replace=False), draw.normal(size=20)
    pairs = sum(model.v[index[i]] @ model.v[index[j]] * x[i] * x[j] for i in range(20) for j in range(i))
    assert model.margin(index, x) == pytest.approx(0.3 + model.w[index] @ x + pairs)


def test_gradients_lower_the_loss():
    rows = [quality.features(t, None) for t in (b"good words here " * 20, b"$$$ ### junk " * 20) * 30]
    label = np.array([1.0, 0.0] * 30)
    model = quality.train(rows, label)
    score = [1 / (1 + np.exp(-model.margin(*model.vector(*r)))) for r in rows]
    assert np.abs(np.array(score) - label).max() < 0.2


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows_and_no_labels(spark, module, odd_docs, no_docs):
    none = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    model = module.fit(odd_docs, none)
    out = module.score(odd_docs, model)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == odd_docs.count()
    assert out.where("score is null or predicted is null or held_out is null").count() == 0
    assert module.score(no_docs, module.fit(no_docs, none)).count() == 0


@pytest.mark.parametrize(("module", "column", "parts", "out"), [(quality, "quality", 5, 0), (toxicity, "toxic", 3, 1)])
def test_labels_of_the_held_out_fold_change_nothing(spark, docs_of, module, column, parts, out):
    docs = docs_of([f"text number {i} " + ("!!! grubbish $$$ " if i % 2 else "fine words ") * 30 for i in range(60)])
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % parts == out]
    label = lambda flip: spark.createDataFrame([(i, i % 2 if i not in held or not flip else 1 - i % 2) for i in range(60)], f"doc_id long, {column} int")
    a, b = (module.score(docs, module.fit(docs, label(flip))).toPandas() for flip in (False, True))
    assert a.equals(b) and a.score.nunique() > 1


def test_quality_scores_equal_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in QUERIES["op10_quality"](spark, sf_dir).collect()}
    for r in docs.orderBy(F.length("text")).limit(60).collect():
        index, x = model.vector(*quality.features(r["text"].encode(), r["n_chars"]))
        products = (model.v[index] * x[:, None]).astype(float)
        pairs = np.triu(products @ products.T, 1).sum()
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-(model.bias + float(model.w[index] @ x) + pairs))), abs=1e-5)


def slow_inputs(text, lexicon):
    """What the regression sees, by edit distances to all terms and a look at every window."""
    found, hits, spoken, stems = list(toxicity._WORD.finditer(text.lower())), [], 0.0, []
    for k, m in enumerate(found):
        w = m[0]
        term = max((x * (1.0 if w == t else 0.8) for t, x in lexicon.terms.items() if w == t or (w not in lexicon.ordinary and abs(len(w) - len(t)) <= 2 and distance(w, t) <= toxicity.Automaton.edits(t))), default=0.0)
        stem = max((x for s, x in lexicon.stems.items() if w.startswith(s) and len(w) > len(s)), default=0.0)
        said = (term or stem) and toxicity.quoted(text.lower(), *m.span())
        if term:
            spoken += term if said else 0.0
            hits.append((k, term * (0.25 if said else 1.0)))
        if stem:
            spoken += stem if said else 0.0
            stems.append(stem * (0.25 if said else 1.0))
    best = max((sum(x for i, x in hits if k - toxicity.WINDOW < i <= k) for k, _ in hits), default=0.0)
    n, total = len(found), sum(x for _, x in hits)
    k = max(1, n)
    return [1.0, np.log1p(total), np.log1p(200 * total / k), best, np.log1p(spoken), np.log1p(len(stems)), np.log1p(200 * len(stems) / k), np.log1p(100 * sum(stems) / k), np.log1p(n) / 5]


def test_toxicity_scores_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in QUERIES["op7_toxicity"](spark, sf_dir).collect()}
    for r in docs.orderBy(F.length("text")).limit(60).collect():
        margin = float(np.array(slow_inputs(r["text"], model.lexicon)) @ model.beta)
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-9)


def test_apostrophes_are_no_quotation_marks():
    words = toxicity.Words(toxicity.Lexicon({"idiot": 2.0}, {"grubb": 1.0}))
    assert toxicity.inputs("i don\u2019t care, you idiot, and you\u2019re done", words)[4] == 0
    assert toxicity.inputs("he said \u2018idiot\u2019 twice", words)[4] > 0
    plain, quoted = (toxicity.inputs(t, words) for t in ("such grubbish words", "such \u201cgrubbish\u201d words"))
    assert plain[4] == 0 < quoted[4] and plain[7] > quoted[7] > 0


def test_rows_that_share_a_labelled_id_count_once(spark, docs_of):
    from latticevec.llm.common import labelled_sample

    docs = docs_of([(1, f"text {i % 3}") for i in range(500)] + [(2, None), (3, "x")])
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, None)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", F.lit(True), 10).collect()
    assert sorted((r["doc_id"], r["label"]) for r in rows) == [(1, 1), (2, 0)]


def test_keep_good_keeps_all_columns(spark, docs_of):
    docs = docs_of([("$$$ ### " if i % 2 else "some fine words ") * 30 for i in range(80)])
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)], "doc_id long, quality int")
    kept = quality.keep_good(docs, quality.fit(docs, labels))
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.collect()} == set(range(0, 80, 2))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    import random

    terms = {"idiot": 1.0, "moron": 2.0, "pathetic": 3.0, "despicable": 4.0, "scum": 5.0, "idiotic": 6.0}
    automaton = toxicity.Automaton(toxicity.Lexicon(terms, {"réeu": 1.5}))
    draw, words = random.Random(5), set(terms) | {"", "x", "réeux", "réeu", "réeuxment"}
    for t in terms:
        for _ in range(60):
            w = list(t)
            for _ in range(draw.randrange(1, 4)):
                p = draw.randrange(len(w) + 1)
                w[p : p + draw.randrange(2)] = draw.choice(["", "a", "o", "i"])
            words.add("".join(w))
    for w in words:
        expected = max((x * (1.0 if w == t else 0.8) for t, x in terms.items() if distance(w, t) <= toxicity.Automaton.edits(t)), default=0.0)
        got, stem = automaton.match(w)
        assert got == pytest.approx(expected), w
        assert stem == (1.5 if w.startswith("réeu") and len(w) > 4 else 0.0)


def test_quotation_and_misspelling():
    model = toxicity.Model(toxicity.Lexicon({w: 2.0 for w in toxicity.TERMS}), np.zeros(toxicity.INPUTS))
    words = toxicity.Words(model.lexicon)
    clean = "the weather was fine and we walked along the river for hours "
    plain = toxicity.inputs(clean + "you stupid idiot", words)
    spelled = toxicity.inputs(clean + "you stupud idoit idiiot", words)
    quoted = toxicity.inputs(clean + "he read the words “stupid idiot” aloud", words)
    said = toxicity.inputs(clean + "she said stupid", words)
    none = toxicity.inputs(clean, words)
    assert plain[1] > quoted[1] > none[1] == 0 and spelled[1] > quoted[1] and quoted[4] > 0 and said[4] > 0
    long = toxicity.inputs((clean * 30_000) + "you stupid idiot", words)
    assert long[3] == pytest.approx(4.0)
