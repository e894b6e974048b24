"""The kernels over texts, against the expressions that they stand for."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import kernels as K
from scriptorium.functions import text as T
from scriptorium.plans import catalogue

TEXTS = [
    "It's the 3.5 cats' U.S.A. day_1, e.g. l'été of 1,000’5 – naïve: a·b 1·2 x.1 1.x __ _a_ a'_b.",
    "Café 2́nd Ⅷ² пример, ИВАН’ов. Ünïcode text here! 日本語 テスト。 ok?",
    'He said: "Stop." Then (why?) no. Yes!" \'Well.\' A.B. c?!  tail of it\n\nNext one.\n\n\n  \n\n end',
    "", " \t\n", "one", "...!?", "x\x01y. z\x02 w \x0b v",
]


def test_kernels_cut_as_the_expressions_do(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    t = F.col("text")
    rows = frame.select("text", T.tokens(t).alias("k"), T.sentences(t).alias("a"), T.sentences_b(t).alias("b"), T.paragraphs(t).alias("p")).collect()
    for r in rows:
        s = r["text"]
        assert K.tokens(s) == r["k"]
        if "\x0b" not in s:  # white space for the expressions, not for the checking SQL
            assert (K.sentences(s), K.sentences(s, K.SENTENCES_B), K.paragraphs(s)) == (r["a"], r["b"], r["p"])


def test_lower_case_and_white_space_are_the_sql_ones(spark):
    from compare import oracle

    con = oracle("/root/testdata/sf0.001")
    for s in [*TEXTS, "ΟΔΟΣ İstanbul ΣΑΣ", "a b c\x0bd e"]:
        low, words = con.execute(r"SELECT lower($1), list_filter(regexp_split_to_array($1, '\s+'), lambda w: w <> '')", [s]).fetchall()[0]
        assert K.lower(s) == low and K.splitter(s)(s) == words


@pytest.mark.parametrize("key", ["ngr_01", "ngr_01_c3", "det_06", "par_01", "sco_01", "sco_10", "sco_11", "sco_11_summary", "sco_12", "sco_13", "bas_01", "acs_01", "ano_01", "agg_05", "exp_01", "ida_01", "seg_01", "dlt_01", "rnk_01"])
def test_texts_are_read_in_kernels(spark, sf_dir, key):
    plan = catalogue.queries()[key](spark, sf_dir)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan or "scriptorium/" in plan  # the kernel, or the table that it wrote
    assert r"\p{M}" not in plan


def test_the_detector_adjusts_as_the_countermeasures_report(spark, sf_dir):
    from scriptorium.operators import countermeasures as M
    from scriptorium.operators import measures

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    texts |= {10**6 + i: t for i, t in enumerate(TEXTS)}
    body = "We walked along the river and talked about a apple from Berlin. " * 60
    texts[10**7] = "\n\n".join(["The parties hereby agree, pursuant to the law. " * 12, body, "[1] A. Book\n[2] B. Book\n[3] C. Book", "Best regards,\nAnn"])
    frame = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").cache()
    want = {r["doc_id"]: r["scorable"] if r["detected"] and len(r["scorable"].split()) >= 500 else texts[r["doc_id"]] for r in M.stripped(frame).collect()}
    assert {i: measures.chosen(t, 500) for i, t in texts.items()} == want and want[10**7] == body.strip()
    for place, name in enumerate(("nnes", "editing", "humanizer")):
        want = {r["doc_id"]: float(r[1]) for r in M.report(frame, name).select("doc_id", f"{name}_adjustment").collect()}
        assert {i: measures.adjustments(t)[place] for i, t in texts.items()} == want
