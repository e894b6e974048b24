"""Registered corpus, score, metric, event, vector and source queries with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import lexicons as L
from scriptorium.operators import capture as C
from scriptorium.operators import corpus as K
from scriptorium.operators import evaluation as E
from scriptorium.operators import scoring as S
from scriptorium.operators import vectors as V
from scriptorium.plans.text_queries import QUERIES as TEXT
from scriptorium.plans.text_queries import CNT, TOK, TOKS, WS, Query, docs, on, quoted
from scriptorium.session import table
from scriptorium.sources import extract as X

events = lambda f: on("events", f)
vectors = lambda f: on("embeddings", f)


def scored(f) -> Query:
    return lambda spark, sf_dir: f(E.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


# -- shared SQL ------------------------------------------------------------------------------------------------
NW = f"len({WS})"
PRED = "p AS (SELECT doc_id, lang AS grp, CAST(quality AS INT) AS y, round(least(n_chars / 5000.0, 1.0), 2) AS score, CAST(round(least(n_chars / 5000.0, 1.0), 2) >= 0.5 AS INT) AS pred FROM documents JOIN labels USING (doc_id))"
ROC = f"{PRED}, s AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM p GROUP BY 1), roc AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) / sum(pos) OVER () AS tpr, sum(neg) OVER (ORDER BY score DESC) / sum(neg) OVER () AS fpr FROM s), step AS (SELECT *, coalesce(lag(tpr) OVER (ORDER BY score DESC), 0) AS t0, coalesce(lag(fpr) OVER (ORDER BY score DESC), 0) AS f0 FROM roc)"
HASH = "CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 8) AS BIGINT)"
MS = "(epoch_us(CAST(ts AS TIMESTAMP)) // 1000)"
ROLL = f"roll AS (SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'click') AS keystrokes, count(*) FILTER (event_type = 'purchase') AS pastes, count(*) FILTER (event_type = 'signup') AS saves, count(*) FILTER (event_type = 'error') AS undos, count(*) FILTER (event_type = 'view') AS focus, CAST(coalesce(sum(floor(value)) FILTER (event_type = 'click'), 0) AS BIGINT) AS typed, CAST(coalesce(sum(floor(value)) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS pasted, max({MS}) - min({MS}) AS duration_ms FROM events GROUP BY 1), rolled AS (SELECT *, round(CASE WHEN typed + pasted = 0 THEN 0.0 ELSE pasted / (typed + pasted) END, 6) AS paste_ratio FROM roll)"
QUAL = f"qual AS (SELECT doc_id, text, source, CAST({NW} AS BIGINT) AS words, round(CASE WHEN {NW} = 0 THEN 0.0 ELSE 0.5 * least({NW} / 2000.0, 1.0) + 0.2 * CASE WHEN len(list_distinct(string_split(text, ''))) / greatest(length(text), 1) < 0.01 THEN 0.1 ELSE 1.0 END + 0.3 * least(length(regexp_replace(text, '[^.!?]', '', 'g')) / 3.0, 1.0) END, 6) AS quality FROM documents)"
PAIRS = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), pairs AS (SELECT a.vec_id AS query_id, a.label AS query_label, a.v AS q, b.vec_id, b.label, b.v FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)"
EUCLID = "round(sqrt(list_sum(list_transform(list_zip(q, v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6)"
KNN = f"{PAIRS}, d AS (SELECT query_id, query_label, vec_id, label, {EUCLID} AS d FROM pairs), knn AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INT) AS rank FROM d QUALIFY rank <= 5)"


def html_sql() -> str:
    x = "html"
    for name in X.SKIPPED:
        x = rf"regexp_replace({x}, '(?is)<{name}[^>]*>.*?</{name}\s*>', ' ', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
    for entity, value in X.ENTITIES.items():
        x = f"replace({x}, '{entity}', {quoted([value])})"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


ORDERED = "(PARTITION BY user_id ORDER BY ts, event_id)"
QUERIES: dict[str, tuple[Query, str | None]] = {
    # filters, corpus
    "flt_01": (docs(lambda d: d.select("doc_id", F.when(K.n_words(F.col("text")) >= 500, "ok").otherwise("insufficient").alias("status"))), f"SELECT doc_id, CASE WHEN {NW} >= 500 THEN 'ok' ELSE 'insufficient' END AS status FROM documents"),
    "flt_03": (docs(K.quality_filter), f"WITH {QUAL}, f AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)) SELECT doc_id, words, quality FROM qual JOIN f USING (doc_id) WHERE words >= 100 AND quality >= 0.5"),
    "flt_04": (docs(lambda d: d.where(K.n_words(F.col("text")) >= 100).select("doc_id")), f"SELECT doc_id FROM documents WHERE {NW} >= 100"),
    "flt_05": (docs(lambda d: d.where(K.n_words(F.col("text")) < 50).select("doc_id")), f"SELECT doc_id FROM documents WHERE {NW} < 50"),
    "flt_07": (docs(lambda d: S.D.content_rows(d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))), f"WITH {TOK} SELECT doc_id, count(*) AS n FROM tok WHERE strlen(token) > 2 AND token NOT IN ({quoted(L.FUNCTION_WORDS)}) GROUP BY 1"),
    "flt_08": (events(lambda d: d.groupBy("user_id").agg(F.count_if(F.col("event_type").isin("click", "purchase")).alias("additions"), F.count_if(F.col("event_type") == "error").alias("removals"), F.count_if(F.col("event_type") == "purchase").alias("external"))), "SELECT user_id, count(*) FILTER (event_type IN ('click', 'purchase')) AS additions, count(*) FILTER (event_type = 'error') AS removals, count(*) FILTER (event_type = 'purchase') AS external FROM events GROUP BY 1"),
    "agg_25": (docs(K.quality), f"WITH {QUAL} SELECT doc_id, words, quality FROM qual"),
    "set_05": (docs(K.first_copies), "SELECT min(doc_id) AS doc_id, sha256(text) AS sha256, count(*) AS copies FROM documents GROUP BY 2"),
    "agg_14": (docs(K.summary), f"SELECT source AS author, count(*) AS documents, CAST(sum({NW}) AS BIGINT) AS words, round(avg({NW}), 6) AS avg_words, CAST(min({NW}) AS BIGINT) AS min_words, CAST(max({NW}) AS BIGINT) AS max_words FROM documents GROUP BY 1"),
    "win_08": (docs(K.folds), "SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 5 AS fold FROM documents"),
    "win_09": (docs(K.stratified_split), f"WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {HASH}, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, source, CASE WHEN r <= floor(n * 0.70 + 0.5) THEN 'train' WHEN r <= floor(n * 0.70 + 0.5) + floor(n * 0.15 + 0.5) THEN 'val' ELSE 'test' END AS split FROM r"),
    "msc_04": (docs(K.split_statistics), f"WITH r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY {HASH}, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents), s AS (SELECT source, CASE WHEN r <= floor(n * 0.70 + 0.5) THEN 'train' WHEN r <= floor(n * 0.70 + 0.5) + floor(n * 0.15 + 0.5) THEN 'val' ELSE 'test' END AS split FROM r) SELECT source, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM s GROUP BY 1"),
    "win_10": (docs(K.bucket_split), f"WITH b AS (SELECT doc_id, {HASH} % 100 AS bucket FROM documents) SELECT doc_id, bucket, CASE WHEN bucket < 80 THEN 'train' WHEN bucket < 90 THEN 'val' ELSE 'test' END AS split FROM b"),
    "set_03": (docs(K.vocabulary_growth), f"WITH t AS (SELECT source, doc_id, unnest(list_distinct({TOKS})) AS token FROM documents), f AS (SELECT source, token, min(doc_id) AS doc_id FROM t GROUP BY ALL), a AS (SELECT source, doc_id, count(*) AS added FROM f GROUP BY ALL) SELECT source, doc_id, added, CAST(sum(added) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS vocabulary FROM a"),
    "set_04": (lambda spark, sf: table(spark, sf, "documents").select(F.lit("documents").alias("origin"), "text").unionByName(table(spark, sf, "conversations").select(F.lit("conversations").alias("origin"), "text")).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")), "SELECT origin, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM (SELECT 'documents' AS origin, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY 1"),
    "msc_16": (docs(K.distribution), "SELECT lang, source, count(*) AS n, min(n_chars) AS lo, max(n_chars) AS hi, round(avg(n_chars), 6) AS mean FROM documents GROUP BY ALL"),
    # scores
    "cnf_01": (docs(lambda d: d.select("doc_id", S.length_factor(K.n_words(F.col("text"))).alias("factor"))), f"SELECT doc_id, CASE WHEN {NW} < 100 THEN 0.4 WHEN {NW} < 300 THEN 0.6 WHEN {NW} < 500 THEN 0.75 WHEN {NW} < 1000 THEN 0.9 WHEN {NW} < 2000 THEN 0.95 ELSE 1.0 END AS factor FROM documents"),
    # metrics
    "agg_15": (scored(E.confusion), f"WITH {PRED} SELECT y AS actual, pred AS predicted, count(*) AS n FROM p GROUP BY ALL"),
    "agg_16": (scored(E.binary_metrics), f"WITH {PRED}, c AS (SELECT count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 0 AND pred = 0) AS tn FROM p) SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((fp / (fp + tn) + fn / (fn + tp)) / 2, 6) AS eer FROM c"),
    "agg_17": (scored(E.auc), f"WITH {ROC} SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auc, round(coalesce(max(tpr) FILTER (fpr <= 0.02), 0.0), 6) AS tpr_at_fpr FROM step"),
    "agg_18": (scored(E.right_riemann_auc), f"WITH {ROC} SELECT round(sum((fpr - f0) * tpr), 6) AS auroc FROM step"),
    "msc_12": (scored(E.equal_error), f"WITH {ROC} SELECT score AS threshold, round((fpr + 1 - tpr) / 2, 6) AS eer FROM roc ORDER BY round(abs(fpr - (1 - tpr)), 9), score DESC LIMIT 1"),
    "agg_19": (scored(E.calibration), f"WITH {PRED}, a AS (SELECT sum(n * gap) AS s FROM (SELECT count(*) AS n, abs(avg(score) - avg(y)) AS gap FROM p WHERE ceil(score * 10) > 0 GROUP BY ceil(score * 10))), b AS (SELECT sum(n * gap) AS s FROM (SELECT count(*) AS n, abs(avg(score) - avg(y)) AS gap FROM p GROUP BY least(floor(score * 10), 9))) SELECT round((SELECT s FROM a) / count(*), 6) AS ece_closed, round((SELECT s FROM b) / count(*), 6) AS ece_floor, round(avg(pow(score - y, 2)), 6) AS brier FROM p"),
    "agg_21": (scored(lambda p: E.threshold_at(p)), f"WITH {ROC} SELECT min(score) AS threshold, round(max(fpr), 6) AS fpr FROM roc WHERE fpr <= 0.1"),
    "agg_22": (scored(E.bias), f"WITH {PRED}, g AS (SELECT grp, count(*) AS n, avg(score) AS m, stddev_samp(score) AS s FROM p GROUP BY 1), h AS (SELECT *, m - 1.96 * s / sqrt(n) AS lo, m + 1.96 * s / sqrt(n) AS hi FROM g) SELECT grp, n, round(m, 6) AS mean, round(s, 6) AS sd, round(lo, 6) AS lo, round(hi, 6) AS hi, coalesce(lag(hi) OVER (ORDER BY grp) >= lo AND lag(lo) OVER (ORDER BY grp) <= hi, false) AS overlaps_previous, round(max(m) OVER () - min(m) OVER (), 6) AS disparity FROM h"),
    # events
    "str_01": (events(C.session_rollup), f"WITH {ROLL} SELECT * FROM rolled"),
    "str_02": (events(C.timing), f"WITH g AS (SELECT user_id, {MS} - lag({MS}) OVER {ORDERED} AS gap FROM events WHERE event_type = 'click'), k AS (SELECT user_id, count(*) AS gaps, avg(gap) AS m, list_sort(list(gap)) AS l, stddev_pop(gap) AS s FROM g WHERE gap > 0 AND gap < 86400000 GROUP BY 1 HAVING count(*) >= 5) SELECT user_id, gaps, round(m, 6) AS mean_ms, l[gaps // 2 + 1] AS median_ms, round(s, 6) AS sd_ms, round(s / m, 6) AS cv FROM k"),
    "str_04": (events(C.flags), f"WITH {ROLL} SELECT user_id, flag FROM (SELECT user_id, unnest(list_filter([CASE WHEN paste_ratio > 0.5 THEN 'high_paste_ratio' END, CASE WHEN paste_ratio > 0.8 THEN 'very_high_paste_ratio' END, CASE WHEN typed * 60000.0 / greatest(duration_ms, 1) > 800 THEN 'fast_typing' END, CASE WHEN undos = 0 THEN 'no_revision' END, CASE WHEN saves = 0 THEN 'no_saves' END], lambda x: x IS NOT NULL)) AS flag FROM rolled)"),
    "str_05": (events(C.snapshot_diff), "WITH o AS (SELECT user_id, CAST(floor(sum(value)) AS BIGINT) AS old FROM events WHERE CAST(ts AS TIMESTAMP) < TIMESTAMP '2024-01-16' GROUP BY 1), n AS (SELECT user_id, CAST(floor(sum(value)) AS BIGINT) AS new FROM events WHERE CAST(ts AS TIMESTAMP) >= TIMESTAMP '2024-01-16' GROUP BY 1) SELECT user_id, old, new, CASE WHEN old IS NULL THEN CASE WHEN new > 5000 THEN 'paste' ELSE 'new' END WHEN new IS NULL THEN 'deleted' WHEN new - old > 2000 THEN 'paste' WHEN new > old THEN 'grown' WHEN new < old THEN 'delete' ELSE 'same' END AS change FROM o FULL JOIN n USING (user_id)"),
    "str_06": (events(C.confidence), f"WITH {ROLL} SELECT user_id, round(least(CASE WHEN events >= 50 THEN 0.4 ELSE 0.2 END + CASE WHEN duration_ms >= 3600000 THEN 0.3 ELSE 0.1 END + CASE WHEN undos > 0 THEN 0.2 ELSE 0.0 END + CASE WHEN saves > 0 THEN 0.1 ELSE 0.0 END, 1.0), 6) AS confidence FROM rolled"),
    "str_08": (events(C.classify_edits), "SELECT user_id, CASE WHEN floor(value) > 200 THEN 'paste' WHEN floor(value) > 1 THEN 'batch' ELSE 'keystroke' END AS edit, count(*) AS n FROM events GROUP BY ALL"),
    "win_03": (events(C.top_events), "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INT) AS rank, event_id, value FROM events QUALIFY rank <= 3"),
    "win_04": (events(C.keystroke_gaps), f"SELECT user_id, event_id, coalesce({MS} - lag({MS}) OVER {ORDERED}, -1) AS gap_ms FROM events WHERE event_type = 'click'"),
    "win_05": (events(C.runs), f"WITH c AS (SELECT *, coalesce(CAST(event_type <> lag(event_type) OVER {ORDERED} AS INT), 1) AS ch FROM events), b AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS block FROM c) SELECT user_id, CAST(block AS BIGINT) AS block, event_type, count(*) AS n FROM b GROUP BY ALL"),
    "win_06": (events(C.bursts), f"WITH c AS (SELECT *, coalesce(CAST({MS} - lag({MS}) OVER {ORDERED} > 7200000 AS INT), 1) AS late FROM events), b AS (SELECT *, sum(late) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM c) SELECT user_id, CAST(burst AS BIGINT) AS burst, count(*) AS n, min(ts) AS began, max(ts) AS ended FROM b GROUP BY ALL"),
    "win_hourly": (events(C.hourly), "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL"),
    "agg_08": (events(C.correlations), "WITH r AS (SELECT user_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS x, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS k FROM events) SELECT user_id, round(coalesce(corr(x, value), 0), 6) AS pearson, round(1 - 6 * sum(pow(x - k, 2)) / (count(*) * (count(*) * count(*) - 1)), 6) AS spearman, round(regr_slope(value, x), 6) AS slope FROM r GROUP BY 1 HAVING count(*) >= 3"),
    "agg_12": (events(C.dominant), "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type, n FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1"),
    "agg_23": (events(C.metering), "SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS used, count(*) > 60 AS over, round(least(100.0 * count(*) / 60, 100.0), 6) AS pct FROM events GROUP BY ALL"),
    # vectors
    "dst_01": (vectors(V.distances), f"WITH {PAIRS} SELECT query_id, vec_id, round(list_cosine_similarity(q, v), 6) AS cosine, round(list_sum(list_transform(list_zip(q, v), lambda z: abs(z[1] - z[2]))), 6) AS manhattan, {EUCLID} AS euclidean FROM pairs"),
    "dst_03": (vectors(V.divergences), f"WITH {PAIRS}, d AS (SELECT query_id, vec_id, list_transform(q, lambda x: abs(x) / list_sum(list_transform(q, lambda y: abs(y)))) AS p, list_transform(v, lambda x: abs(x) / list_sum(list_transform(v, lambda y: abs(y)))) AS w FROM pairs) SELECT query_id, vec_id, round(0.5 * list_sum(list_transform(list_zip(p, w), lambda z: CASE WHEN z[1] > 1e-10 THEN z[1] * ln(z[1] / ((z[1] + z[2]) / 2)) ELSE 0.0 END)) + 0.5 * list_sum(list_transform(list_zip(w, p), lambda z: CASE WHEN z[1] > 1e-10 THEN z[1] * ln(z[1] / ((z[1] + z[2]) / 2)) ELSE 0.0 END)), 6) AS jsd, round(list_sum(list_transform(list_zip(p, w), lambda z: CASE WHEN z[1] + z[2] < 1e-10 THEN 0.0 ELSE (z[1] - z[2]) * (z[1] - z[2]) / (z[1] + z[2]) END)), 6) AS chi2 FROM d"),
    "joi_04": (vectors(lambda d: V.nearest(d).select("query_id", "rank", "vec_id", "label", "d")), f"WITH {KNN} SELECT query_id, rank, vec_id, label, d FROM knn"),
    "ml_03": (vectors(V.knn_labels), f"WITH {KNN}, v AS (SELECT query_id, query_label, label, round(sum(1.0 / (d + 1e-10)), 5) AS w FROM knn GROUP BY ALL) SELECT query_id, query_label AS actual, label AS predicted FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY w DESC, label) = 1"),
    "agg_06": (vectors(V.component_stats), "WITH e AS (SELECT unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x, unnest(range(0, len(embedding))) AS component FROM embeddings) SELECT CAST(component AS INT) AS component, round(avg(x), 6) AS mean, round(greatest(stddev_pop(x), 1e-10), 6) AS sd FROM e GROUP BY 1"),
    "res_03": (vectors(V.centroids), "WITH e AS (SELECT label, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x, unnest(range(0, len(embedding))) AS component FROM embeddings) SELECT label, CAST(component AS INT) AS component, round(avg(x), 6) AS mean FROM e GROUP BY ALL"),
    # sources, checks, digests
    "src_06": (on("pages", X.page_texts), f"SELECT page_id, {html_sql()} AS text FROM pages"),
    "src_15": (on("conversations", X.chat_texts), "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS turns FROM conversations GROUP BY 1"),
    "src_17": (docs(lambda d: d.select("doc_id", F.md5(X.normalised(F.col("text")).cast("binary")).alias("digest"))), r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents"),
    "val_03": (on("pages", lambda d: d.select("page_id", X.xml_bomb(F.col("html")).alias("bomb"))), "SELECT page_id, len(regexp_extract_all(html, '<!ENTITY')) > 10 OR len(regexp_extract_all(html, '&')) > 10000 AS bomb FROM pages"),
    "val_04": (on("pages", lambda d: d.select("page_id", X.safe_name(F.col("url")).alias("name"))), r"SELECT page_id, regexp_replace(replace(url, '..', '_'), '[/\\:\x00]', '_', 'g') AS name FROM pages"),
    "for_02": (docs(X.digests), "SELECT doc_id, strlen(text) AS size, sha256(text) AS sha256, sha256('secret' || text) AS signature, substr(sha256(text), 1, 16) AS fingerprint FROM documents"),
    "for_05": (docs(X.tampering), "WITH n AS (SELECT doc_id, length(text) - length(regexp_replace(text, '[​‌‍﻿­]', '', 'g')) AS n FROM documents) SELECT doc_id, n AS zero_width, n > 3 AS suspicious, CASE WHEN n > 3 THEN 0.3 ELSE 0.0 END AS risk FROM n"),
    "cry_01": (docs(X.merkle_root), "WITH RECURSIVE leaves AS (SELECT count(*) AS n, list(sha256(CAST(doc_id AS VARCHAR) || ':' || text) ORDER BY doc_id) AS h FROM documents), tree AS (SELECT n, h FROM leaves UNION ALL SELECT n, list_transform(range(0, (len(h) + 1) // 2), lambda i: CASE WHEN 2 * i + 2 <= len(h) THEN sha256(h[2 * i + 1] || h[2 * i + 2]) ELSE h[2 * i + 1] END) FROM tree WHERE len(h) > 1) SELECT n AS leaves, h[1] AS root FROM tree WHERE len(h) = 1"),
}
