"""Every query of the engine's own operators against its SQL."""

import pytest
from compare import difference, oracle

from scriptorium.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("key", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, con, key):
    rows = catalogue.queries()[key](spark, sf_dir).toPandas()
    assert difference(rows, con.execute(catalogue.oracle_sql()[key]).df()) == ""


def test_many_queries_are_not_broadcast(spark, sf_dir, monkeypatch):
    from scriptorium.operators import vectors as V
    from scriptorium.session import table

    few = V.nearest(table(spark, sf_dir, "embeddings"))
    monkeypatch.setattr(V, "BROADCAST_QUERIES", 0)
    many = V.nearest(table(spark, sf_dir, "embeddings"))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan
    assert sorted(many.collect()) == sorted(few.collect())


def test_merkle_root(spark):
    import hashlib

    from scriptorium.sources.extract import merkle_root

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = [h(f"{i}:text {i}") for i in range(5)]
    while len(level) > 1:
        level = [h(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string")
    assert merkle_root(docs).first()["root"] == level[0]


def test_corpus_of_files(spark, tmp_path):
    from scriptorium.sources.extract import read_corpus

    (tmp_path / "anna").mkdir()
    (tmp_path / "anna" / "a.txt").write_bytes(b"\xef\xbb\xbfone\r\n\r\n\r\n\r\ntwo ")
    (tmp_path / "anna" / "b.txt").write_bytes("drei".encode("utf-16"))
    rows = {r["path"][-5:]: (r["author"], r["text"]) for r in read_corpus(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": ("anna", "one\n\ntwo"), "b.txt": ("anna", "drei")}


def test_markdown(spark):
    from pyspark.sql import functions as F

    from scriptorium.sources.extract import markdown_text

    text = "# Head\n\n**bold** and [link](http://x) `code`\n```py\nhidden\n```\n- item"
    got = spark.createDataFrame([(text,)], "t string").select(markdown_text(F.col("t"))).first()[0]
    assert "hidden" not in got and "**" not in got and "bold and link code" in got and "# " not in got


def test_library_without_llm():
    import pathlib
    import re

    import scriptorium

    root = pathlib.Path(scriptorium.__file__).parent
    others = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert others and not any(re.search(r"scriptorium\.llm|corpus_pipeline", p.read_text()) for p in others)


@pytest.mark.parametrize("key", ["det_28", "sco_11_summary", "cmp_01"])
def test_halves_are_rounded_as_in_sql(spark, key):
    sf_dir = "/root/testdata/sf0.01"  # its documents hold values halfway between two decimals
    got, want = catalogue.queries()[key](spark, sf_dir).toPandas(), oracle(sf_dir).execute(catalogue.oracle_sql()[key]).df()
    got, want = (x[sorted(want.columns)].sort_values("doc_id").reset_index(drop=True) for x in (got, want))
    differ = {c: int(((got[c] != want[c]) & ~(got[c].isna() & want[c].isna())).sum()) for c in want.columns}
    assert len(got) == len(want) and not any(differ.values()), differ
