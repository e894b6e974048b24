"""Definitions that the tables do not reach, on literal inputs against plain Python."""

import io
import statistics
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import countermeasures as M
from scriptorium.operators import fused as U
from scriptorium.operators import identity as I
from scriptorium.operators import register as R
from scriptorium.plans import format_queries as Q
from scriptorium.sources import formats as X


@pytest.mark.parametrize("key,name,content,text", Q.SAMPLES)
def test_formats(key, name, content, text):
    assert X.read_document(name, content) == text


def test_archives_are_checked():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<w:document>" + "x" * 2_000_000 + "</w:document>")
    assert X.read_document("a.docx", out.getvalue()) is None  # unpacks to more than a hundred times its size
    nested = '<!DOCTYPE a [<!ENTITY a "x"><!ENTITY b "&a;&a;">]><a>&b;</a>'
    assert X.xml_bomb(nested) and X.xml_bomb("&" * 10_001) and not X.xml_bomb("<a>&amp;</a>")
    assert X.read_document("a.docx", Q.archive(**{"word/document.xml": nested})) is None


def test_parts_of_speech():
    verbs = set(U.verb_forms())
    assert {"stopped", "carries", "carried", "goes", "gone", "watches", "shown", "dies", "died", "used", "creates", "passes", "plays"} <= verbs
    assert not {"left", "stoped", "playies"} & verbs


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_paragraph_features(spark):
    paras = ["The cat sat on the mat and looked at us all day.", "The cat then walked home in the cold rain without any coat on it.", "Nothing else happened.", "At last a cat sat down again on that old mat near us."]
    row = U.features(docs(spark, ["\n\n".join(paras), "\n".join(paras), ""])).orderBy("doc_id").collect()
    sizes = [len(p.split()) for p in paras]
    assert row[0]["paragraph_cv"] == pytest.approx(statistics.stdev(sizes) / statistics.mean(sizes))
    levels = [0.6 * statistics.mean(len(w) for w in p.split()) + 4 * sum(len(w) > 8 for w in p.split()) / len(p.split()) for p in paras if len(p.split()) >= 10]
    assert row[0]["register_consistency"] == pytest.approx(statistics.variance(levels))
    assert row[0]["paragraph_overlap"] > 0 and row[1]["paragraph_cv"] is None and all(row[2][n] is None for n in U.NAMES)


def test_template_paragraphs(spark):
    body = "We walked along the river and talked about the summer. " * 8
    text = "\n\n".join(["The parties hereby agree, pursuant to the law.", body.strip(), "Abstract: short", "[1] A. Book\n[2] B. Book\n[3] C. Book", "Best regards,\nAnn"])
    row = M.stripped(docs(spark, [text])).first()
    assert row["types"] == "academic,citation,email,legal" and row["scorable"] == body.strip() and row["detected"]
    plain = M.stripped(docs(spark, [body])).first()
    assert not plain["detected"] and plain["template_fraction"] == 0


def test_second_language_indicators(spark):
    text = "I do not know a apple from Berlin garden. " * 20
    row = M.report(docs(spark, [text]), "nnes").first()
    assert row["determiners"] == 1.0 and row["nnes"] and -0.25 <= row["nnes_adjustment"] <= -0.12


def test_register_rules(spark):
    casual = "I can't wait! We don't know, do you? My dog isn't here. I love it. We're happy. " * 6
    law = "The obligations described above were considered by the committee, and the conclusions which had been presented were subsequently adopted notwithstanding the considerable reservations that were expressed throughout the consultation process. " * 4
    rows = {r["doc_id"]: r["category"] for r in R.registers(docs(spark, [casual, law])).collect()}
    assert rows == {0: "casual", 1: "academic"}


def test_acs_weights(spark):
    frame = spark.createDataFrame([(80.0, 60.0, 70.0), (80.0, None, 70.0), (None, 60.0, 70.0), (None, None, 70.0)], "f double, s double, t double")
    got = [(round(r["a"], 6), r["m"]) for r in frame.select(F.expr(R.acs("f", "s", "t")).cast("double").alias("a"), F.expr(R.margin("f", "s", "t")).cast("double").alias("m")).collect()]
    assert got == [(71.0, 7.0), (75.5, 14.0), (65.0, 15.0), (70.0, 22.0)]


def test_change_points():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 1, (12, 3)), rng.normal(9, 1, (10, 3))])
    found = I.change_points(v)
    assert [f[0] for f in found if f[2]] and 12 in [f[0] for f in found]
    for cut, score in [I.best_split(v)]:
        def by_hand(k):
            a, b = v[:k], v[k:]
            return float(np.sqrt((((a.mean(0) - b.mean(0)) / np.maximum(a.std(0), 1e-10)) ** 2).mean()))
        scores = {k: by_hand(k) for k in range(2, len(v) - 1)}
        assert score == pytest.approx(max(scores.values())) and scores[cut] == pytest.approx(score)
    assert I.change_points(np.ones((8, 3))) == [] and I.change_points(v[:1]) == []


def test_word_edges_are_those_of_the_checking_sql(spark):
    from compare import oracle

    from scriptorium.operators import research
    from scriptorium.plans.catalogue import oracle_sql

    texts = ["é the a cat", "naïve the ancafé the a", "a the cat in the morning", "été is going from la the theé"]
    con = oracle("/root/testdata/sf0.001")
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT unnest(range(4)) AS doc_id, unnest($1) AS text".replace("$1", "[" + ", ".join(f"'{t}'" for t in texts) + "]"))
    want = sorted(con.execute(oracle_sql()["res_07"]).df()[["doc_id", "traces"]].itertuples(index=False, name=None))
    assert sorted((r["doc_id"], r["traces"]) for r in research.report(docs(spark, texts), "first_language").collect()) == want


def test_snapshots_add_in_the_order_of_events(spark):
    from scriptorium.operators.capture import snapshot_diff

    values = [0.1, 0.7, 0.2, 1e16, 3.0, -1e16, 0.3, 0.4, 0.6] * 3
    when = ["2024-01-02 00:00:00", "2024-01-20 00:00:00"]
    rows = [(100 * u + i, when[u % 2 if u else i % 2], u, v) for u in range(3) for i, v in enumerate(values)]
    events = spark.createDataFrame(rows[::-1], "event_id long, ts string, user_id long, value double").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "value")

    def total(some):
        out = 0.0
        for x in some:
            out += x
        return int(out // 1)

    want = {0: (total(values[::2]), total(values[1::2])), 1: (None, total(values)), 2: (total(values), None)}
    for parts in (1, 7):
        assert {r["user_id"]: (r["old"], r["new"]) for r in snapshot_diff(events.repartition(parts, "event_id")).collect()} == want
