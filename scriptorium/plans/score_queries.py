"""Registered tagger, fused features, countermeasures, registers, baselines and the full detector, with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import lexicons as L
from scriptorium.functions.dialect import DUCK, quoted
from scriptorium.operators import countermeasures as M
from scriptorium.operators import fused as U
from scriptorium.operators import identity as I
from scriptorium.operators import register as R
from scriptorium.operators import scoring as S
from scriptorium.operators.profiles import half_away
from scriptorium.plans import identity_queries as N
from scriptorium.plans.text_queries import QUERIES as TEXT
from scriptorium.plans.text_queries import SENTB, TOK, TOKS, Query, docs, occ, sents
from scriptorium.session import fresh_path, table

SOURCE = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"
SB = sents('")')
PARAS = r"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
TAGGED = f"{TOK}, tag AS (SELECT doc_id, pos, {U.tag_sql(DUCK, 'token')} AS t FROM tok)"


def text_sql(key: str) -> str:
    """A registered query's SQL, with blank lines between paragraphs."""
    return TEXT[key][1].replace("chr(10)", "chr(10) || chr(10)")


OPENINGS = rf"WITH {SENTB} SELECT doc_id, count(DISTINCT regexp_replace(lower(regexp_split_to_array(sentence, '\s+')[1]), '[^\p{{L}}]', '', 'g')) / count(*) AS x FROM sent GROUP BY 1"
ADVERBS = rf"WITH {SENTB} SELECT doc_id, avg(CAST(regexp_replace(lower(regexp_split_to_array(sentence, '\s+')[1]), '[^\p{{L}}]', '', 'g') LIKE '%ly' AND strlen(regexp_replace(lower(regexp_split_to_array(sentence, '\s+')[1]), '[^\p{{L}}]', '', 'g')) > 3 AS DOUBLE)) AS x FROM sent GROUP BY 1"
MARKERS = f"WITH {SENTB}, s AS (SELECT doc_id, lower(sentence) AS s FROM sent) SELECT doc_id, avg(CAST({' OR '.join(f'starts_with(s, {quoted([m])}) OR contains(s, {quoted([chr(44) + chr(32) + m])})' for m in L.ENUMERATIONS)} AS DOUBLE)) AS x FROM s GROUP BY 1"
TRANSITIONS = f"SELECT doc_id, ({' + '.join(occ('lower(text)', p) for p in L.TRANSITIONS)}) * 1000.0 / greatest(len({TOKS}), 1) AS x FROM documents"
POS = f"WITH {TAGGED}, w AS (SELECT doc_id, t, lead(t) OVER o AS u, lead(t, 2) OVER o AS v FROM tag WINDOW o AS (PARTITION BY doc_id ORDER BY pos)), tri AS (SELECT doc_id, t, u, v, count(*) AS n FROM w WHERE v IS NOT NULL GROUP BY ALL), bi AS (SELECT doc_id, t, u, count(*) AS n FROM w WHERE u IS NOT NULL GROUP BY ALL), p3 AS (SELECT doc_id, n, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM tri), p2 AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM bi), e3 AS (SELECT doc_id, -sum(p * log2(p)) AS e, count(*) AS k, sum(n) AS total FROM p3 GROUP BY 1), e2 AS (SELECT doc_id, -sum(p * log2(p)) AS e FROM p2 GROUP BY 1)"
POS_SQL = f"{POS} SELECT doc_id, round(e3.e, 6) AS trigram_entropy, k AS unique_trigrams, CAST(total AS BIGINT) AS total, round(e2.e, 6) AS bigram_entropy FROM e3 JOIN e2 USING (doc_id) WHERE total >= 18"
OVERLAP = f"WITH p AS (SELECT doc_id, list_transform({PARAS}, lambda p: list_distinct(list_filter({DUCK.tokens('p')}, lambda w: strlen(w) > 2 AND w NOT IN ({quoted(L.PARAGRAPH_STOP_WORDS)})))) AS s FROM documents), e AS (SELECT doc_id, s[i] AS a, s[i + 1] AS b FROM (SELECT doc_id, s, unnest(range(1, len(s))) AS i FROM p)) SELECT doc_id, avg(len(list_intersect(a, b)) / len(list_distinct(a || b))) AS x FROM e WHERE len(a) > 0 AND len(b) > 0 GROUP BY 1"

#: Each feature: its SQL, the column there, when the text is long enough for it, and its value where that SQL has none.
FEATURE_SQL = {
    "burstiness": (text_sql("det_01"), "burstiness", "big >= 200", "0.0"), "zipf_deviation": (text_sql("det_02"), "deviation", "true", "NULL"), "hedge_ratio": (text_sql("det_03"), "ratio", "true", "NULL"),
    "autocorrelation": (text_sql("det_04"), "lag1", "true", "NULL"), "pos_entropy": (POS_SQL, "trigram_entropy", "n >= 20", "NULL"), "diversity_length": (text_sql("det_06"), "correlation", "n >= 400", "0.0"),
    "repetition_delta": (text_sql("det_07"), "delta", "n >= 400", "0.0"), "passive_clustering": (text_sql("det_08"), "clustering", "sb >= 20", "NULL"), "transition_density": (TRANSITIONS, "x", "n >= 200", "NULL"),
    "paragraph_cv": (text_sql("det_10"), "cv", "paras >= 4", "NULL"), "opening_diversity": (OPENINGS, "x", "sb >= 10", "NULL"), "nested_clauses": (text_sql("det_12"), "nested", "sb >= 10", "NULL"),
    "comma_splices": (text_sql("det_13"), "ratio", "sb >= 10", "NULL"), "sophistication_slope": (text_sql("det_14"), "slope", "n >= 200", "NULL"), "register_consistency": (text_sql("det_19"), "consistency", "paras >= 3", "0.0"),
    "initial_adverbs": (ADVERBS, "x", "sb >= 10", "NULL"), "modal_density": (text_sql("det_17"), "density", "n >= 200", "NULL"), "punctuation_entropy": (text_sql("det_23"), "entropy", "n >= 200", "0.0"),
    "enumeration": (MARKERS, "x", "sb >= 10", "NULL"), "paragraph_overlap": (OVERLAP, "x", "paras >= 3", "0.0"),
}


def fused_sql() -> str:
    """doc_id and all features of the relation ``documents``."""
    base = f"g AS (SELECT doc_id, len({TOKS}) AS n, len(list_filter({TOKS}, lambda t: strlen(t) > 1)) AS big, len({SB}) AS sb, len({PARAS}) AS paras FROM documents)"
    values = ", ".join(f"round(CASE WHEN {gate} THEN coalesce(f_{name}.{column}, {default}) END, 6) AS {name}" for name, (_, column, gate, default) in FEATURE_SQL.items())
    joins = " ".join(f"LEFT JOIN ({sql}) f_{name} ON f_{name}.doc_id = g.doc_id" for name, (sql, *_) in FEATURE_SQL.items())
    return f"WITH {base} SELECT g.doc_id, {values} FROM g {joins}"


LONG = f"(SELECT * FROM documents WHERE {R.white_space_words(DUCK)} >= {S.MIN_WORDS})"
FEATS = f"(WITH documents AS {LONG} SELECT * FROM ({fused_sql()}))"
SCORED = f"(SELECT *, {S.score_sql()} AS raw, {S.used_sql()} AS used FROM {FEATS})"
TIER = lambda x, part: "CASE " + " ".join(f"WHEN {x} < {b} THEN '{names[part]}'" for b, *names in S.TIERS[:-1]) + f" ELSE '{S.TIERS[-1][part + 1]}' END"

# -- windows as documents of their own: their words, without punctuation
CASED = DUCK.cased_tokens("text")
STEP, SIZE = S.HEAT_STEP, S.HEAT_SIZE
WINDOWS = f"(SELECT doc_id * 100000 + i AS doc_id, array_to_string(w[i * {STEP} + 1 : i * {STEP} + {SIZE}], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, (len(w) - {SIZE}) // {STEP} + 1)) AS i FROM (SELECT doc_id, {CASED} AS w FROM documents WHERE {R.white_space_words(DUCK)} >= {S.MIN_WORDS}) WHERE len(w) >= {SIZE}))"
HEAT = f"(WITH documents AS {WINDOWS} SELECT doc_id // 100000 AS doc_id, doc_id % 100000 AS win, {S.score_sql()} AS raw, {S.used_sql()} AS used FROM ({fused_sql()}))"
REGISTER = M.sql(R.all_layers(DUCK), SOURCE)


def register_sql(what: str) -> str:
    return f"SELECT doc_id, {', '.join(f'{e} AS {k}' for k, e in R.COLUMNS[what].items())} FROM {REGISTER}"


def measure_sql(name: str) -> str:
    make, columns = M.REPORTS[name]
    return f"SELECT doc_id, {', '.join(f'{e} AS {k}' for k, e in columns.items())} FROM {M.sql(make(DUCK), SOURCE)}"


SCORABLE_WORDS = R.white_space_words(DUCK).replace("text", "scorable")
CHOSEN = f"(SELECT doc_id, text AS original, CASE WHEN detected AND {SCORABLE_WORDS} >= {S.MIN_WORDS} THEN scorable ELSE text END AS text FROM {M.sql(M.template(DUCK), f"(SELECT doc_id, coalesce(text, '') AS text FROM {LONG})")})"
ORIGINAL = f"(SELECT doc_id, original AS text FROM {CHOSEN})"
ADJUST = lambda name, column: f"(SELECT doc_id, {column} FROM {M.sql(M.REPORTS[name][0](DUCK), ORIGINAL)})"
DETECT = f"""
WITH scored AS (WITH documents AS (SELECT doc_id, text FROM {CHOSEN}) SELECT doc_id, {S.score_sql()} AS raw, {S.used_sql()} AS used FROM ({fused_sql()})),
reg AS (WITH documents AS (SELECT doc_id, text FROM {CHOSEN}) SELECT doc_id, label, register_adjustment FROM {REGISTER}),
j AS (SELECT s.doc_id, used, raw, label, CAST(nnes_adjustment + editing_adjustment + humanizer_adjustment AS DOUBLE) AS measures, CAST(register_adjustment AS DOUBLE) AS register_adjustment
  FROM scored s JOIN reg USING (doc_id) JOIN {ADJUST('nnes', 'nnes_adjustment')} USING (doc_id) JOIN {ADJUST('editing', 'editing_adjustment')} USING (doc_id) JOIN {ADJUST('humanizer', 'humanizer_adjustment')} USING (doc_id)),
f AS (SELECT *, round(least(greatest(least(greatest(raw + register_adjustment, 0.0), 1.0) + measures, 0.0), 1.0), 5) AS score FROM j)
SELECT doc_id, CAST(used AS BIGINT) AS used, round(raw, 5) AS raw, label, round(measures, 5) AS measures, score, round(least(used / 7.0, 1.0), 5) AS confidence,
CASE WHEN used < 5 AND score > 0.15 AND score < 0.85 THEN 'INCONCLUSIVE' ELSE {TIER('score', 0)} END AS tier FROM f
"""

MATCH = f"(SELECT doc_id, author, round(least(greatest(1 - distance, 0.0), 1.0) * {N.BY_LENGTH}, 6) AS confidence FROM (SELECT doc_id, author, words, round({I.MEAN_DISTANCE}, 6) AS distance FROM {N.COMPARED}))"
MULTIMODE = f"SELECT doc_id, author, {S.mode_sql(1)} AS mode, {S.COMPOSITE} AS composite, {S.READING} AS reading, {TIER(S.COMPOSITE, 0)} AS tier FROM (SELECT doc_id, score FROM ({DETECT})) JOIN {MATCH} USING (doc_id) JOIN (SELECT source AS who, count(*) AS samples FROM documents GROUP BY 1) ON author IS NOT DISTINCT FROM who"


def csv_round_trip(spark, sf_dir):
    path = fresh_path(spark, "feature-csv")
    S.feature_csv(table(spark, sf_dir, "documents"), path)
    kinds = ", ".join(f"{n} double" for n in U.NAMES)
    return spark.read.schema(f"label string, source long, word_count long, {kinds}").option("header", "true").csv(path)


QUERIES: dict[str, tuple[Query, str | None]] = {
    "tok_12": (docs(U.tagged), f"WITH {TAGGED} SELECT doc_id, list_value({quoted(list(U.TAGS))})[t + 1] AS tag, count(*) AS n FROM tag GROUP BY ALL"),
    "det_05": (docs(U.pos_entropy), POS_SQL),
    "det_16": (docs(U.determiner_distance), f"WITH {TOK}, n AS (SELECT doc_id FROM tok GROUP BY 1 HAVING count(*) >= 100), a AS (SELECT * FROM tok WHERE token IN ({quoted(L.DETERMINERS)})), b AS (SELECT * FROM tok WHERE strlen(token) > 2 AND NOT (token LIKE '%ly' OR token LIKE '%ful' OR token LIKE '%ous' OR token LIKE '%ive') AND token NOT IN ({quoted(L.DETERMINERS)})), d AS (SELECT a.doc_id, a.pos, min(b.pos - a.pos) AS d FROM a JOIN b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 7 GROUP BY ALL) SELECT n.doc_id, count(d) AS pairs, round(coalesce(avg(d), 0.0), 6) AS distance FROM n LEFT JOIN d USING (doc_id) GROUP BY 1"),
    "det_27": (docs(U.function_word_clusters), f"WITH {TOK}, k AS (SELECT doc_id, count(*) // 200 AS k FROM tok GROUP BY 1 HAVING count(*) >= 600), f AS (SELECT doc_id, pos // 200 AS w, token, count(*) / 200 AS p FROM tok JOIN k USING (doc_id) WHERE pos // 200 < k AND token IN ({quoted(L.CLUSTER_WORDS)}) GROUP BY ALL), grid AS (SELECT doc_id, k, unnest(range(0, k)) AS w FROM k), r AS (SELECT g.doc_id, g.k, g.w, coalesce(sum(p), 0) AS r FROM grid g LEFT JOIN f ON f.doc_id = g.doc_id AND f.w = g.w GROUP BY ALL), c AS (SELECT doc_id, any_value(k) AS k, CASE WHEN avg(r) > 1e-15 THEN stddev_samp(r) / avg(r) ELSE 0.0 END AS cv FROM r GROUP BY 1), pairs AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.w + 1, b.w) AS w, coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q FROM f a FULL JOIN f b ON a.doc_id = b.doc_id AND a.w + 1 = b.w AND a.token = b.token), j AS (SELECT doc_id, sum((CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2) AS j FROM pairs JOIN k USING (doc_id) WHERE w BETWEEN 1 AND k - 1 GROUP BY 1) SELECT c.doc_id, CAST(k AS INT) AS windows, round(cv, 6) AS ratio_cv, round(coalesce(j, 0) / (k - 1), 6) AS divergence FROM c LEFT JOIN j USING (doc_id)"),
    "det_28": (docs(lambda d: S.features(d).select("doc_id", *[half_away(F.col(n), 5).alias(n) for n in U.NAMES])), f"SELECT doc_id, {', '.join(f'round({n}, 5) AS {n}' for n in U.NAMES)} FROM {FEATS}"),
    "par_01": (docs(lambda d: U.features(d).select("doc_id", *[F.col(n).isNotNull().alias(n) for n in U.NAMES])), f"SELECT doc_id, {', '.join(f'{n} IS NOT NULL AS {n}' for n in U.NAMES)} FROM ({fused_sql()})"),
    "sco_01": (docs(lambda d: S.feature_scores(d).select("doc_id", "feature", F.round("score", 4).alias("score"))), "WITH f AS " + FEATS + " SELECT doc_id, feature, round(score, 4) AS score FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS feature, {S.one_score(n)} AS score FROM f WHERE {n} IS NOT NULL" for n in U.NAMES) + ")"),
    "sco_02": (docs(S.composite), f"SELECT doc_id, CAST(used AS BIGINT) AS features, round(raw, 4) AS score, {TIER('round(raw, 4)', 0)} AS tier, {TIER('round(raw, 4)', 1)} AS action FROM {SCORED}"),
    "sco_05": (docs(lambda d: M.report(d, "nnes")), measure_sql("nnes")),
    "sco_06": (docs(lambda d: M.report(d, "template")), measure_sql("template")),
    "sco_07": (docs(lambda d: M.report(d, "editing")), measure_sql("editing")),
    "sco_08": (docs(lambda d: M.report(d, "humanizer")), measure_sql("humanizer")),
    "sco_10": (docs(S.detect), DETECT),
    "sco_11": (docs(S.heatmap), f"SELECT doc_id, win, win * {STEP} AS word_start, win * {STEP} + {SIZE} AS word_end, CAST(used AS BIGINT) AS features, round(raw, 4) AS score FROM {HEAT}"),
    "sco_11_summary": (docs(S.heat_summary), f"SELECT doc_id, count(*) AS windows, min(score) AS lo, max(score) AS hi, round(avg(score), 4) AS mean FROM (SELECT doc_id, round(raw, 4) AS score FROM {HEAT}) GROUP BY 1"),
    "sco_13": (docs(S.explanation), "WITH f AS " + FEATS + ", s AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS feature, {S.one_score(n)} AS score FROM f WHERE {n} IS NOT NULL" for n in U.NAMES) + ") SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, feature) AS INT) AS rank, feature, round(score, 6) AS score FROM s QUALIFY rank <= 3"),
    "reg_01": (docs(R.register_features), register_sql("features")),
    "reg_02": (docs(lambda d: R.registers(d, "register")), register_sql("register")),
    "bas_01": (docs(lambda d: R.registers(d, "baselines")), register_sql("baselines")),
    "acs_01": (docs(lambda d: R.registers(d, "acs")), register_sql("acs")),
    "cnt_01": (docs(lambda d: R.registers(d, "narrative")), register_sql("narrative")),
    "snk_01": (docs(lambda d: R.registers(d, "reports")), register_sql("reports")),
    "snk_02": (csv_round_trip, f"SELECT source AS label, f.doc_id AS source, len({M.ws(DUCK, 'text')}) AS word_count, {', '.join(f'coalesce({n}, 0.0) AS {n}' for n in U.NAMES)} FROM {FEATS} f JOIN documents d ON d.doc_id = f.doc_id"),
    "sco_12": (docs(S.multimode), MULTIMODE),
    "ano_01": (docs(lambda d: R.registers(d, "anomalies")), register_sql("anomalies")),
}
