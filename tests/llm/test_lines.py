import pytest

from latticevec.llm import lines
from latticevec.llm.queries import ORACLE_SQL, QUERIES


def brute(pairs):
    """Texts by id, for distinct ids."""
    first, out = {}, {}
    for doc_id, text in sorted((p for p in pairs if p[1] is not None), key=lambda p: p[0]):
        parts = text.split("\n")
        gone = set()
        for i in range(len(parts) - 2):
            window = tuple(parts[i : i + 3])
            if "".join(window).strip(" \t\r\f\v") and first.setdefault(window, (doc_id, i)) != (doc_id, i):
                gone |= {i, i + 1, i + 2}
        out[doc_id] = "\n".join(p for k, p in enumerate(parts) if k not in gone)
    return out


CASES = {
    "overlapping": [(1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\nd\ny"), (3, "b\nc\nd")],
    "within a document": [(1, "a\na\na\na\na"), (2, "q\na\nb\nc\na\nb\nc\nq")],
    "two lines are no window": [(1, "a\nb"), (2, "a\nb"), (3, "a"), (4, "")],
    "blank": [(1, "\n\n\n\n"), (2, "\n\n\n"), (3, "a\n\n\nb"), (4, "a\n\n\nc")],
    "white space": [(1, "\t\n \v\n\r\f"), (2, "\t\n \v\n\r\f"), (3, "\u00a0\n\n"), (4, "\u00a0\n\n")],
    "all gone": [(5, "a\nb\nc"), (4, "a\nb\nc"), (9, "a\nb\nc\n")],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_cases(docs_of, name):
    out = lines.dedup_lines(docs_of(CASES[name])).collect()
    assert {r["doc_id"]: r["text"] for r in out} == brute(CASES[name])
    for r in out:
        assert r["n_lines"] - r["n_removed"] == (0 if r["n_lines"] == r["n_removed"] else r["text"].count("\n") + 1)


def test_query_equals_sql(spark, duck, sf_dir, same):
    same(QUERIES["op9_line_dedup"](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL["op9_line_dedup"]).df())


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op9_line_dedup"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_equal_rows_keep_the_same_lines(docs_of):
    out = lines.dedup_lines(docs_of([(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "z\na\nb\nc"), (None, "a\nb\nc"), (None, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out)[:2] == [(0, ""), (0, "")]
    kept = sorted(r["text"] for r in out if r["doc_id"] == 1)
    assert kept in (["a\nb\nc", "a\nb\nc", "z"], ["", "", "z\na\nb\nc"])


def test_odd_rows(odd_docs, no_docs):
    out = lines.drop_repeated_lines(odd_docs, n_chars="n_chars")
    assert out.columns == odd_docs.columns and out.dtypes == odd_docs.dtypes and out.count() == odd_docs.count()
    assert lines.dedup_lines(odd_docs).where("doc_id = 1").first()["text"] is None
    assert lines.dedup_lines(no_docs).count() == 0


def test_length_is_set_anew_where_the_text_changed(docs_of):
    out = {r["doc_id"]: r["n_chars"] for r in lines.drop_repeated_lines(docs_of([(1, "a\nb\nc"), (2, "a\nb\nc\nd")]), n_chars="n_chars").collect()}
    assert out == {1: 5, 2: 1}
