"""Registered authorship queries with the SQL that checks each."""

from __future__ import annotations

from scriptorium.functions import lexicons as L
from scriptorium.functions.dialect import DUCK
from scriptorium.operators import countermeasures as M
from scriptorium.operators import identity as I
from scriptorium.operators import register as R
from scriptorium.operators import vectors as V
from scriptorium.plans.text_queries import TOK, Query, docs, on, quoted

WORDS = M.ws(DUCK, "text")
VECTORS = f"{TOK}, words(feature) AS (VALUES {', '.join(f'({quoted([w])})' for w in L.FUNCTION_WORDS)}), sizes AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1), c AS (SELECT doc_id, token AS feature, count(*) AS c FROM tok GROUP BY ALL), f AS (SELECT d.doc_id, d.source AS author, w.feature, coalesce(c.c, 0) / n AS value FROM documents d JOIN sizes USING (doc_id) CROSS JOIN words w LEFT JOIN c ON c.doc_id = d.doc_id AND c.feature = w.feature), st AS (SELECT feature, avg(value) AS m, greatest(stddev_pop(value), 1e-10) AS s FROM f GROUP BY 1), z AS (SELECT doc_id, author, feature, (value - m) / s AS z FROM f JOIN st USING (feature)), prof AS (SELECT author AS candidate, feature, avg(z) AS p FROM z GROUP BY ALL)"
COSINE = "CASE WHEN sqrt(sum(z * z)) * sqrt(sum(p * p)) < 1e-12 THEN 0.0 ELSE greatest(least(sum(z * p) / (sqrt(sum(z * z)) * sqrt(sum(p * p))), 1.0), -1.0) END"
DELTA = f"{VECTORS}, delta AS (SELECT doc_id, author, candidate, round(avg(abs(z - p)), 6) AS delta, round(1 - {COSINE}, 6) AS cosine_delta, round(sqrt(sum((z - p) * (z - p))) / sqrt(count(*)), 6) AS euclidean_delta FROM z JOIN prof USING (feature) GROUP BY ALL)"
SOURCE = "(SELECT doc_id, source, coalesce(text, '') AS text FROM documents)"
FEATURES = f"(SELECT doc_id, source AS author, len({WORDS}) AS words, {', '.join(f'f_{c} AS {c}' for c in I.COMPARED)} FROM {M.sql(I.compared_layers(DUCK), SOURCE)})"
PROFILES = f"(SELECT author AS who, count(*) AS documents, {', '.join(f'round(avg({c}), 6) AS e_{c}' for c in I.COMPARED)} FROM {FEATURES} GROUP BY 1)"
COMPARED = f"(SELECT doc_id, author, words, {', '.join(f'{c} AS a_{c}, e_{c}, round({I.distance(c, "e_" + c)}, 6) AS d_{c}' for c in I.COMPARED)} FROM {FEATURES} f JOIN {PROFILES} p ON f.author IS NOT DISTINCT FROM p.who)"
BY_LENGTH = "CASE WHEN words < 100 THEN 0.4 WHEN words < 300 THEN 0.6 WHEN words < 500 THEN 0.75 WHEN words < 1000 THEN 0.9 WHEN words < 2000 THEN 0.95 ELSE 1.0 END"
ENTRIES = "[" + ", ".join(f"{{'d': d_{c}, 'i': {i}, 'x': '{c}:' || CASE WHEN abs(a_{c} - e_{c}) < 0.01 THEN 'match' WHEN a_{c} > e_{c} THEN 'above' ELSE 'below' END}}" for i, c in enumerate(I.COMPARED)) + "]"
EXPLAIN = f"WITH e AS (SELECT doc_id, unnest({ENTRIES}, recursive := true) FROM {COMPARED}), s AS (SELECT doc_id, x, i, d, row_number() OVER (PARTITION BY doc_id, d < 0.15 ORDER BY i) AS near, row_number() OVER (PARTITION BY doc_id, d > 0.3 ORDER BY d DESC, i) AS far FROM e) SELECT doc_id, coalesce(string_agg(x, ',' ORDER BY i) FILTER (d < 0.15 AND near <= 5), '') AS supporting, coalesce(string_agg(x, ',' ORDER BY d DESC, i) FILTER (d > 0.3 AND far <= 5), '') AS diverging, round(count(*) FILTER (d < 0.20) / {len(I.COMPARED)}.0, 6) AS agreement FROM s GROUP BY 1"
PAIRS = f"WITH m AS (SELECT author, doc_id % 2 AS half, [{', '.join(f'round(avg({c}), 6)' for c in I.COMPARED)}] AS v FROM {FEATURES} WHERE author IS NOT NULL GROUP BY ALL) SELECT a.author AS left_author, CAST(a.half AS BIGINT) AS left_half, b.author AS right_author, CAST(b.half AS BIGINT) AS right_half, a.author = b.author AS genuine, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / {len(I.COMPARED)}), 4) AS rms FROM m a JOIN m b ON a.author < b.author OR (a.author = b.author AND a.half < b.half)"
WINDOWS = f"(SELECT doc_id, win, win * {I.STEP} AS start_word, least(win * {I.STEP} + {I.WINDOW}, len(w)) AS end_word, array_to_string(w[win * {I.STEP} + 1 : win * {I.STEP} + {I.WINDOW}], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, greatest((len(w) - {I.WINDOW}) // {I.STEP}, 0) + 1)) AS win FROM (SELECT doc_id, {M.ws(DUCK, 'text')} AS w FROM {SOURCE}) WHERE len(w) > 0))"
MEASURED = f"(SELECT doc_id, win, start_word, end_word, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in I.WINDOW_FEATURES)} FROM {M.sql(R.feature_layers(DUCK), WINDOWS)})"
STANDARD = f"(SELECT doc_id, win, start_word, end_word, {', '.join(f'({c} - avg({c}) OVER (PARTITION BY doc_id)) / greatest(stddev_pop({c}) OVER (PARTITION BY doc_id), 1e-10) AS z_{c}' for c in I.WINDOW_FEATURES)} FROM {MEASURED})"
SCORED = f"(SELECT *, round(sqrt(({' + '.join(f'z_{c} * z_{c}' for c in I.WINDOW_FEATURES)}) / {len(I.WINDOW_FEATURES)}.0), 4) AS score FROM {STANDARD})"
DEVIATIONS = "[" + ", ".join(f"{{'d': -round(abs(z_{c}), 4), 'name': '{c}'}}" for c in I.WINDOW_FEATURES) + "]"
ANOMALIES = f"SELECT doc_id, win, start_word, end_word, score, score > {I.THRESHOLD} AS anomalous, array_to_string(list_transform(list_sort(list_filter({DEVIATIONS}, lambda e: e.d < -{I.THRESHOLD}))[1:{I.DEVIATIONS}], lambda e: e.name), ',') AS deviations FROM {SCORED}"
OWN = f"SELECT doc_id, source AS author, ttr, avg_word_length FROM {M.sql(R.feature_layers(DUCK), SOURCE)}"

QUERIES: dict[str, tuple[Query, str | None]] = {
    "dlt_01": (docs(I.deltas), f"WITH {DELTA} SELECT * FROM delta"),
    "rnk_01": (docs(I.ranked), f"WITH {DELTA}, r AS (SELECT *, CAST(row_number() OVER o AS INT) AS rank, round(lead(cosine_delta) OVER o - cosine_delta, 6) AS margin, max(cosine_delta) OVER (PARTITION BY doc_id) AS top FROM delta WINDOW o AS (PARTITION BY doc_id ORDER BY cosine_delta, candidate)) SELECT doc_id, rank, candidate, cosine_delta, margin, round(CASE WHEN top = 0 THEN 0.0 ELSE cosine_delta / top END, 6) AS relative, coalesce(margin > 0.15, false) AS definitive FROM r"),
    "cnf_02": (docs(I.delta_confidences), f"WITH {DELTA}, w AS (SELECT doc_id, len({WORDS}) AS words FROM documents), k AS (SELECT doc_id, round({I.delta_confidence('cosine_delta', 'words', len(L.FUNCTION_WORDS))}, 6) AS confidence FROM delta JOIN w USING (doc_id) WHERE author IS NOT DISTINCT FROM candidate) SELECT doc_id, confidence, {I.confidence_level('confidence')} AS level FROM k"),
    "agg_05": (docs(I.author_profiles), f"SELECT who AS author, documents, {', '.join(f'e_{c} AS {c}' for c in I.COMPARED)} FROM {PROFILES}"),
    "cmp_01": (docs(I.compare), f"WITH c AS (SELECT doc_id, author, words, round({I.MEAN_DISTANCE}, 6) AS distance FROM {COMPARED}), k AS (SELECT *, round(least(greatest(1 - distance, 0.0), 1.0) * {BY_LENGTH}, 6) AS confidence FROM c) SELECT doc_id, author, distance, confidence, {I.confidence_level('confidence')} AS level FROM k"),
    "exp_01": (docs(I.explain), EXPLAIN),
    "joi_05": (docs(I.author_pairs), PAIRS),
    "ida_01": (docs(I.window_anomalies), ANOMALIES),
    "ida_02": (docs(I.profile_anomalies), f"WITH r AS ({OWN}), m AS (SELECT author AS who, avg(ttr) AS t, avg(avg_word_length) AS l FROM r GROUP BY 1) SELECT doc_id, abs(ttr - t) > 0.15 AS ttr_anomaly, abs(avg_word_length - l) > 1.0 AS length_anomaly FROM r JOIN m ON r.author IS NOT DISTINCT FROM m.who"),
    "chg_01": (docs(lambda d: I.segments(d).drop("v")), None),
    "seg_01": (docs(I.attributed_segments), None),
    "dst_03_kl": (on("embeddings", V.kullback), "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS v FROM embeddings), n AS (SELECT vec_id, list_transform(v, lambda x: x / list_sum(v)) AS v FROM e) SELECT a.vec_id AS query_id, b.vec_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: CASE WHEN z[1] <= 1e-10 THEN 0.0 WHEN z[2] <= 1e-10 THEN CAST('inf' AS DOUBLE) ELSE z[1] * ln(z[1] / z[2]) END)), 6) AS kl FROM n a, n b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id"),
}
