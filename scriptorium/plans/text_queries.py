"""Registered text queries (tokenisers, profiles, detection features) with the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import lexicons as L
from scriptorium.functions import text as T
from scriptorium.operators import detection as D
from scriptorium.operators import profiles as P
from scriptorium.session import table

Query = Callable[[SparkSession, str], DataFrame]


def on(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


def docs(f: Callable[[DataFrame], DataFrame]) -> Query:
    return on("documents", f)


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


W = T.WORD.replace("'", "''")
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
TOKS = rf"list_filter(regexp_extract_all(lower(text), '{W}'), lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]'))"


def sents(follow: str = "\"'')") -> str:
    parts = rf"list_transform(string_split(regexp_replace(text, '([.!?])([\s{follow}]|$)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: {TRIM.format('s')})"
    return rf"list_filter({parts}, lambda s: s <> '' and (regexp_matches(s, '[.!?]$') or regexp_matches(s, '\s')))"


WS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
LOWER_WS = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')"
TOK = f"tok AS (SELECT doc_id, unnest({TOKS}) AS token, unnest(range(0, len({TOKS}))) AS pos FROM documents)"
CNT = f"{TOK}, cnt AS (SELECT doc_id, token, count(*) AS n FROM tok GROUP BY ALL)"
SENT = rf"sent AS (SELECT doc_id, idx, sentence, len(regexp_split_to_array(sentence, '\s+')) AS n_ws FROM (SELECT doc_id, unnest({sents()}) AS sentence, unnest(range(0, len({sents()}))) AS idx FROM documents))"
SENTB = rf"sent AS (SELECT doc_id, idx, sentence, len(regexp_split_to_array(sentence, '\s+')) AS n_ws FROM (SELECT doc_id, unnest({sents(chr(34) + ')')}) AS sentence, unnest(range(0, len({sents(chr(34) + ')')}))) AS idx FROM documents))"
SYL = "CASE WHEN strlen({0}) <= 3 THEN 1 ELSE greatest(len(regexp_extract_all({0}, '[aeiouy]+')) - CASE WHEN {0} LIKE '%e' AND len(regexp_extract_all({0}, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END, 1) END"


def occ(text: str, phrase: str) -> str:
    q = quoted([phrase])
    return f"CAST((length({text}) - length(replace({text}, {q}, ''))) / {len(phrase)} AS BIGINT)"


def chars_joined(x) -> F.Column:
    return F.md5(F.array_join(x, "|").cast("binary"))


def list_query(column) -> Query:
    return docs(lambda d: d.select("doc_id", column(F.col("text")).alias("x")).select("doc_id", F.size("x").cast("long").alias("n"), chars_joined(F.col("x")).alias("digest")))


def list_sql(expr: str) -> str:
    return f"SELECT doc_id, CAST(len(x) AS BIGINT) AS n, md5(array_to_string(x, '|')) AS digest FROM (SELECT doc_id, {expr} AS x FROM documents)"


QUERIES: dict[str, tuple[Query, str | None]] = {
    "tok_01": (list_query(T.tokens), list_sql(TOKS)),
    "tok_02": (list_query(T.ws_words), list_sql(WS)),
    "tok_03": (list_query(T.sentences), list_sql(sents())),
    "tok_04": (list_query(T.sentences_b), list_sql(sents('")'))),
    "tok_05": (list_query(T.sentences_c), list_sql(rf"list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda s: {TRIM.format('s')}), lambda s: s <> '' and len(regexp_split_to_array(s, '\s+')) >= 3)")),
    "tok_06": (docs(lambda d: d.select("doc_id", T.sentence_marks(F.col("text")).cast("long").alias("n"))), "SELECT doc_id, CAST(greatest(length(regexp_replace(text, '[^.!?]', '', 'g')), 1) AS BIGINT) AS n FROM documents"),
    "tok_07": (list_query(T.sentences_e), list_sql(r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))")),
    "tok_08": (list_query(lambda t: T.paragraphs(t, "\n")), list_sql(rf"list_filter(list_transform(string_split(text, chr(10)), lambda s: {TRIM.format('s')}), lambda s: s <> '')")),
    "tok_09": (list_query(lambda t: T.char_ngrams(t, 3)), list_sql("list_transform(range(1, length(text) - 1), lambda i: substring(text, i, 3))")),
    "tok_10": (list_query(lambda t: T.bigram_array(T.ws_words(F.lower(t)))), f"WITH w AS (SELECT doc_id, {LOWER_WS} AS w FROM documents) SELECT doc_id, CAST(len(x) AS BIGINT) AS n, md5(array_to_string(x, '|')) AS digest FROM (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS x FROM w)"),
    "tok_11": (docs(lambda d: d.select("doc_id", F.size(T.shingles(F.col("text"))).cast("long").alias("n"))), f"WITH w AS (SELECT doc_id, {LOWER_WS} AS w FROM documents) SELECT doc_id, CAST(len(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS BIGINT) AS n FROM w WHERE len(w) > 0"),
    "tok_13": (docs(lambda d: T.token_counts(d).select("token", T.syllables(F.col("token")).cast("long").alias("syllables")).distinct()), f"WITH {TOK} SELECT DISTINCT token, CAST({SYL.format('token')} AS BIGINT) AS syllables FROM tok"),
    "tok_14": (docs(lambda d: D.fixed_windows(d, 100)), f"WITH {TOK}, n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1) SELECT doc_id, CAST(pos // 100 AS BIGINT) AS win, count(DISTINCT token) AS distinct_tokens FROM tok JOIN n USING (doc_id) WHERE pos // 100 < n // 100 GROUP BY ALL"),
    "tok_15": (docs(lambda d: D.sliding_windows(d, 300, 75).groupBy("doc_id").agg(F.count(F.lit(1)).alias("windows"), F.max("end_word").alias("last"))), f"WITH n AS (SELECT doc_id, len({TOKS}) AS n FROM documents) SELECT doc_id, CAST((n - 300) // 75 + 1 AS BIGINT) AS windows, CAST(((n - 300) // 75) * 75 + 300 AS BIGINT) AS last FROM n WHERE n >= 300"),
    "tok_16": (docs(D.synonym_variation), f"WITH {TOK}, c AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS rn FROM tok WHERE strlen(token) > 2 AND token NOT IN ({quoted(L.FUNCTION_WORDS)})), w AS (SELECT doc_id, rn // 50 AS win, count(DISTINCT token) / count(*) AS r FROM c GROUP BY ALL) SELECT doc_id, round(avg(r), 6) AS variation FROM w GROUP BY 1"),
    "lex_01": (docs(P.lexical), f"WITH {CNT}, a AS (SELECT doc_id, sum(n) AS total, count(*) AS d, count(*) FILTER (n = 1) AS hapax, count(*) FILTER (n = 2) AS dis, sum(n * strlen(token)) AS bytes, sum(n * n) AS sq FROM cnt GROUP BY 1) SELECT doc_id, CAST(total AS BIGINT) AS total, d AS \"distinct\", hapax, dis, round(d / total, 6) AS ttr, round(hapax / total, 6) AS hapax_ratio, round(CASE WHEN dis = 0 THEN 0.0 ELSE hapax / dis END, 6) AS hapax_dis_ratio, round(bytes / total, 6) AS avg_word_length, round(greatest(1e4 * (sq - total) / (CAST(total AS DOUBLE) * total), 0.0), 6) AS yule_k, round(CASE WHEN hapax = d THEN 0.0 ELSE 100 * ln(total) / (1 - hapax / d) END, 6) AS honore_r, round(pow(total, pow(d, -0.172)), 6) AS brunet_w FROM a"),
    "lex_03": (docs(P.word_lengths), f"WITH {CNT} SELECT doc_id, strlen(token) AS bytes, CAST(sum(n) AS BIGINT) AS n FROM cnt GROUP BY ALL"),
    "lex_04": (docs(P.mattr), f"WITH {TOK}, n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1), p AS (SELECT doc_id, pos, coalesce(lag(pos) OVER (PARTITION BY doc_id, token ORDER BY pos), -1) AS prev FROM tok) SELECT doc_id, round(CASE WHEN any_value(n) < 500 THEN count(*) FILTER (prev = -1) / any_value(n) ELSE sum(greatest(0, least(pos, n - 500) - greatest(prev + 1, pos - 499, 0) + 1)) / (500.0 * (any_value(n) - 499)) END, 6) AS mattr FROM p JOIN n USING (doc_id) GROUP BY 1"),
    "lex_08": (docs(T.token_counts), f"WITH {CNT} SELECT doc_id, token, n FROM cnt"),
    "syn_01": (docs(P.sentence_profile), f"WITH {SENT} SELECT doc_id, count(*) AS sentences, round(avg(n_ws), 6) AS avg_words, round(avg(strlen(sentence)), 6) AS avg_bytes, round(coalesce(var_samp(n_ws), 0), 6) AS var_words, count(*) FILTER (sentence LIKE '%?') AS questions, count(*) FILTER (sentence LIKE '%!') AS exclamations, count(*) FILTER (sentence NOT LIKE '%?' AND sentence NOT LIKE '%!') AS statements, round(count(*) FILTER (sentence LIKE '%?') / count(*), 6) AS question_ratio FROM sent GROUP BY 1"),
    "syn_02": (docs(P.sentence_lengths), f"WITH {SENT} SELECT doc_id, n_ws AS words, count(*) AS n FROM sent GROUP BY ALL"),
    "syn_04": (docs(P.sentence_openings), rf"WITH {SENT}, o AS (SELECT doc_id, regexp_replace(lower(regexp_split_to_array(sentence, '\s+')[1]), '[^\p{{L}}]', '', 'g') AS opening FROM sent) SELECT doc_id, opening, count(*) AS n FROM o WHERE opening <> '' GROUP BY ALL"),
    "syn_05": (docs(P.passive), rf"WITH {SENT}, h AS (SELECT doc_id, regexp_matches(' ' || lower(regexp_replace(regexp_replace(sentence, '[^\p{{L}}\s]', '', 'g'), '\s+', ' ', 'g')) || ' ', ' (?:{'|'.join(L.BE_FORMS)}) [^ ]*(?:ed|en|wn|nt) ') AS hit FROM sent) SELECT doc_id, count(*) FILTER (hit) AS passive, round(avg(CAST(hit AS DOUBLE)), 6) AS passive_ratio FROM h GROUP BY 1"),
    "sem_01": (docs(P.paragraph_profile), rf"WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda s: {TRIM.format('s')}), lambda s: s <> '')) AS p FROM documents) SELECT doc_id, count(*) AS paragraphs, round(avg(strlen(p)), 6) AS avg_bytes, round(coalesce(var_samp(strlen(p)), 0), 6) AS var_bytes, round(avg(CAST(strlen(p) < 50 AS DOUBLE)), 6) AS short_ratio FROM p GROUP BY 1"),
    "sem_02": (docs(P.discourse), f"WITH t AS (SELECT doc_id, {TOKS} AS x FROM documents), j AS (SELECT doc_id, len(x) AS n, len(list_filter(x, lambda w: w IN ({quoted(L.DISCOURSE_SINGLE)}))) AS s, array_to_string(x, ' ') AS j FROM t), m AS (SELECT doc_id, n, s, {' + '.join(occ('j', p) for p in L.DISCOURSE_MULTI)} AS m FROM j) SELECT doc_id, s AS single, m AS multi, round(CASE WHEN n = 0 THEN 0.0 ELSE (s + m) * 1000.0 / n END, 6) AS per_1000 FROM m"),
    "sem_03": (docs(P.readability), f"WITH {CNT}, y AS (SELECT doc_id, n, strlen(token) AS b, {SYL.format('token')} AS syl FROM cnt), a AS (SELECT doc_id, sum(n) AS w, sum(n * syl) AS y, coalesce(sum(n) FILTER (syl >= 3), 0) AS h, sum(n * b) AS c FROM y GROUP BY 1), s AS (SELECT doc_id, greatest(length(regexp_replace(text, '[^.!?]', '', 'g')), 1) AS s FROM documents) SELECT doc_id, round(0.39 * (w / s) + 11.8 * (y / w) - 15.59, 6) AS flesch_kincaid, round(0.4 * (w / s + 100.0 * h / w), 6) AS gunning_fog, round(5.88 * (c / w) - 29.6 * (s / w) - 15.8, 6) AS coleman_liau, round(4.71 * (c / w) + 0.5 * (w / s) - 21.43, 6) AS ari, round(y / w, 6) AS avg_syllables FROM a JOIN s USING (doc_id)"),
    "sty_01": (docs(P.punctuation), f"WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS mark FROM documents) SELECT doc_id, mark, count(*) AS n FROM c WHERE mark IN ({quoted(L.PUNCTUATION)}) GROUP BY ALL"),
    "sty_02": (docs(P.mark_rates), "WITH e AS (SELECT *, " + " + ".join(occ("text", p) for p in ("—", "---", " -- ")) + " AS em FROM documents WHERE strlen(text) > 0) SELECT doc_id, " + ", ".join(f"round({occ('text', m)} / strlen(text), 6) AS {n}" for m, n in (("!", "exclamation_rate"), ("?", "question_rate"), (",", "comma_rate"), (";", "semicolon_rate"), (":", "colon_rate"))) + f", em AS em_dashes, {occ('text', '–')} AS en_dashes, greatest({occ('text', '-')} - 3 * em, 0) AS hyphens, {occ('text', '…')} + {occ('text', '...')} AS ellipses, {occ('text', '(')} AS brackets, {occ('text', chr(34))} AS quotes FROM e"),
    "sty_04": (docs(P.style_words), f"WITH {CNT}, a AS (SELECT doc_id, sum(n) AS w, coalesce(sum(n) FILTER (token = 'cannot' OR (contains(token, '''') AND strlen(token) > 2)), 0) AS c, coalesce(sum(n) FILTER (token IN ({quoted(L.HEDGES)})), 0) AS h, coalesce(sum(n) FILTER (token IN ({quoted(L.INTENSIFIERS)})), 0) AS i FROM cnt GROUP BY 1) SELECT doc_id, CAST(c AS BIGINT) AS contractions, CAST(h AS BIGINT) AS hedges, CAST(i AS BIGINT) AS intensifiers, round(h / w, 6) AS hedge_ratio, round(i / w, 6) AS intensifier_ratio FROM a"),
    "fnw_01": (docs(P.function_word_rates), f"WITH {CNT}, s AS (SELECT doc_id, sum(n) AS w FROM cnt GROUP BY 1) SELECT doc_id, token, round(1000.0 * n / w, 6) AS per_1000 FROM cnt JOIN s USING (doc_id) WHERE token IN ({quoted(L.FUNCTION_WORDS)})"),
    "fnw_02": (docs(P.function_word_summary), f"WITH {CNT}, a AS (SELECT doc_id, sum(n) AS w, coalesce(sum(n) FILTER (token IN ({quoted(L.FUNCTION_WORDS)})), 0) AS f, count(*) FILTER (token IN ({quoted(L.FUNCTION_WORDS)})) AS k FROM cnt GROUP BY 1) SELECT doc_id, round(f / w, 6) AS ratio, round(CASE WHEN f = 0 THEN 0.0 ELSE k / f END, 6) AS diversity FROM a"),
    "ngr_01": (docs(P.top_ngrams), f"WITH g AS (SELECT doc_id, {LOWER_WS} AS w FROM documents), e AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM g), c AS (SELECT doc_id, gram, count(*) AS n FROM e GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS rank FROM c) SELECT doc_id, gram, CAST(rank AS INTEGER) AS rank, round(n / total, 6) AS freq FROM r WHERE rank <= 500"),
    "ngr_01_c3": (docs(lambda d: P.top_ngrams(d, "c3")), "WITH e AS (SELECT doc_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substring(lower(text), i, 3))) AS gram FROM documents), c AS (SELECT doc_id, gram, count(*) AS n FROM e GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS rank FROM c) SELECT doc_id, gram, CAST(rank AS INTEGER) AS rank, round(n / total, 6) AS freq FROM r WHERE rank <= 500"),
    # detection features
    "det_01": (docs(D.burstiness), f"WITH {TOK}, big AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS p FROM tok WHERE strlen(token) > 1), k AS (SELECT doc_id, count(*) // 100 AS wins FROM big GROUP BY 1 HAVING count(*) >= 200), tr AS (SELECT doc_id, token FROM big WHERE token NOT IN ({quoted(L.FUNCTION_WORDS)}) GROUP BY ALL HAVING count(*) >= 3), x AS (SELECT b.doc_id, b.token, p // 100 AS win, count(*) FILTER (p // 100 < wins) AS c, any_value(wins) AS wins FROM big b JOIN tr USING (doc_id, token) JOIN k ON b.doc_id = k.doc_id GROUP BY ALL), s AS (SELECT doc_id, token, sum(c) AS s, sum(c * c) AS q, any_value(wins) AS w FROM x GROUP BY ALL), z AS (SELECT doc_id, s / w AS mu, (q - CAST(s AS DOUBLE) * s / w) / (w - 1) AS v FROM s) SELECT doc_id, round(avg(CASE WHEN v + mu = 0 THEN 0.0 ELSE (v - mu) / (v + mu) END), 6) AS burstiness, count(*) AS tracked FROM z GROUP BY 1"),
    "det_02": (docs(D.zipf), rf"WITH {CNT}, r AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS rank FROM cnt WHERE regexp_matches(token, '\p{{L}}')) SELECT doc_id, round(regr_slope(ln(n), ln(rank)), 6) AS slope, round(abs(regr_slope(ln(n), ln(rank)) + 1), 6) AS deviation, round(regr_r2(ln(n), ln(rank)), 6) AS r2 FROM r GROUP BY 1 HAVING count(*) >= 50"),
    "det_03": (docs(D.hedge_ratio), f"WITH {CNT}, a AS (SELECT doc_id, coalesce(sum(n) FILTER (token IN ({quoted(L.HEDGES)})), 0) AS h, coalesce(sum(n) FILTER (token IN ({quoted(L.INTENSIFIERS)})), 0) AS i FROM cnt GROUP BY 1) SELECT doc_id, round(CASE WHEN i = 0 AND h = 0 THEN NULL WHEN i = 0 THEN 2.0 * h ELSE h / i END, 6) AS ratio FROM a"),
    "det_04": (docs(D.autocorrelation), f"WITH {SENT}, m AS (SELECT *, avg(n_ws) OVER w AS mu, count(*) OVER w AS k FROM sent WINDOW w AS (PARTITION BY doc_id)), l AS (SELECT doc_id, k, n_ws - mu AS d, lead(n_ws - mu, 1) OVER o AS d1, lead(n_ws - mu, 2) OVER o AS d2 FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY idx)) SELECT doc_id, round(CASE WHEN sum(d * d) < 1e-9 THEN 0.0 ELSE sum(d * d1) / sum(d * d) END, 6) AS lag1, round(CASE WHEN sum(d * d) < 1e-9 OR any_value(k) < 6 THEN 0.0 ELSE sum(d * d2) / sum(d * d) END, 6) AS lag2 FROM l WHERE k >= 5 GROUP BY 1"),
    "det_07": (docs(D.repetition_delta), f"WITH {TOK}, c AS (SELECT doc_id, token, row_number() OVER o - 1 AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM tok WHERE strlen(token) > 2 AND token NOT IN ({quoted(L.FUNCTION_WORDS)}) WINDOW o AS (PARTITION BY doc_id ORDER BY pos)), h AS (SELECT doc_id, rn < n // 2 AS first, 1 - count(DISTINCT token) / count(*) AS reuse FROM c WHERE n >= 2 GROUP BY ALL) SELECT doc_id, round(abs(max(reuse) FILTER (first) - max(reuse) FILTER (NOT first)), 6) AS delta FROM h GROUP BY 1"),
    "det_09": (docs(D.transition_density), f"SELECT doc_id, round(({' + '.join(occ('lower(text)', p) for p in L.TRANSITIONS)}) * 1000.0 / greatest(len({WS}), 1), 6) AS per_1000 FROM documents"),
    "det_10": (docs(D.paragraph_variation), rf"WITH p AS (SELECT doc_id, len(regexp_split_to_array(p, '\s+')) AS n FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda s: {TRIM.format('s')}), lambda s: s <> '')) AS p FROM documents)) SELECT doc_id, round(stddev_samp(n) / avg(n), 6) AS cv FROM p GROUP BY 1 HAVING count(*) >= 4"),
    "det_11": (docs(D.opening_diversity), rf"WITH {SENTB} SELECT doc_id, round(count(DISTINCT lower(regexp_split_to_array(sentence, '\s+')[1])) / count(*), 6) AS diversity FROM sent GROUP BY 1 HAVING count(*) >= 5"),
    "det_12": (docs(D.nested_clauses), f"WITH {SENTB} SELECT doc_id, round(avg(CAST({occ('sentence', ',')} >= 2 AS DOUBLE)), 6) AS nested FROM sent GROUP BY 1 HAVING count(*) >= 5"),
    "det_14": (docs(D.sophistication_slope), f"WITH {TOK}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) // 4 AS q FROM tok) SELECT doc_id, round((avg(strlen(token)) FILTER (pos >= 3 * q AND pos < 4 * q) - avg(strlen(token)) FILTER (pos < q)) / 3, 6) AS slope FROM n WHERE q >= 20 GROUP BY 1"),
    "det_17": (docs(D.modals), f"WITH {CNT}, a AS (SELECT doc_id, sum(n) AS w, coalesce(sum(n) FILTER (token IN ({quoted(L.MODALS)})), 0) AS m, count(*) FILTER (token IN ({quoted(L.MODALS)})) AS k FROM cnt GROUP BY 1) SELECT doc_id, round(1000.0 * m / w, 6) AS density, round(CASE WHEN m = 0 THEN 0.0 ELSE k / m END, 6) AS diversity FROM a"),
    "det_19": (docs(D.register_consistency), rf"WITH p AS (SELECT doc_id, unnest(range(0, len(x))) AS i, unnest(x) AS p FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: s <> '') AS x FROM documents)), w AS (SELECT doc_id, i, regexp_split_to_array({TRIM.format('p')}, '\s+') AS w FROM p), e AS (SELECT doc_id, i, strlen(unnest(w)) AS b, len(w) AS n FROM w), f AS (SELECT doc_id, i, 0.6 * avg(b) + 4 * avg(CAST(b > 8 AS DOUBLE)) AS f FROM e WHERE n >= 10 GROUP BY ALL) SELECT doc_id, round(CASE WHEN count(*) < 3 THEN 0.0 ELSE var_samp(f) END, 6) AS consistency FROM f GROUP BY 1"),
    "det_20": (docs(D.connective_redundancy), rf"WITH {SENT}, s AS (SELECT doc_id, idx, regexp_replace(lower(regexp_split_to_array(sentence, '\s+')[1]), '[^\p{{L}}]', '', 'g') IN ({quoted(L.CONNECTIVES)}) AS c FROM sent), l AS (SELECT doc_id, c, lead(c) OVER (PARTITION BY doc_id ORDER BY idx) AS d FROM s) SELECT doc_id, count(*) FILTER (c AND d) AS redundant FROM l GROUP BY 1"),
    "det_21": (docs(D.initial_adverbs), rf"WITH {SENT}, s AS (SELECT doc_id, regexp_replace(lower(regexp_split_to_array(sentence, '\s+')[1]), '[^\p{{L}}]', '', 'g') AS w FROM sent) SELECT doc_id, round(avg(CAST(w LIKE '%ly' AND strlen(w) > 3 AS DOUBLE)), 6) AS ratio FROM s GROUP BY 1"),
    "det_23": (docs(D.punctuation_entropy), f"WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS mark FROM documents), n AS (SELECT doc_id, mark, count(*) AS n FROM c WHERE mark IN ({quoted(L.PUNCTUATION_DIVERSITY)}) GROUP BY ALL), p AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM n) SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1"),
    "det_24": (docs(D.quote_integration), f"WITH q AS (SELECT doc_id, lower(text) AS t, ({occ('text', chr(34))} + {occ('text', '“')} + {occ('text', '”')}) // 2 AS q FROM documents) SELECT doc_id, round(CASE WHEN q = 0 THEN NULL ELSE least(({' + '.join(occ('t', p) for p in L.QUOTE_SIGNALS)}) / q, 1.0) END, 6) AS integration FROM q"),
    "det_25": (docs(D.enumeration), f"WITH {SENT}, s AS (SELECT doc_id, lower(sentence) AS s FROM sent) SELECT doc_id, round(avg(CAST({' OR '.join(f'starts_with(s, {quoted([m])}) OR contains(s, {quoted([chr(44) + chr(32) + m])})' for m in L.ENUMERATIONS)} AS DOUBLE)), 6) AS ratio FROM s GROUP BY 1"),
    "det_26": (docs(D.paragraph_overlap), rf"WITH p AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(p), '[^\p{{L}}]+'), lambda w: strlen(w) > 2 AND w NOT IN ({quoted(L.FUNCTION_WORDS)}))) AS s, i FROM (SELECT doc_id, unnest(x) AS p, unnest(range(0, len(x))) AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: s <> '') AS x FROM documents))), l AS (SELECT doc_id, s, lead(s) OVER (PARTITION BY doc_id ORDER BY i) AS t FROM p) SELECT doc_id, round(avg(CASE WHEN len(s) + len(t) = 0 THEN 0.0 ELSE len(list_intersect(s, t)) / (len(s) + len(t) - len(list_intersect(s, t))) END), 6) AS jaccard FROM l WHERE t IS NOT NULL GROUP BY 1"),
    "res_01": (docs(D.conditional_entropy), f"WITH {TOK}, b AS (SELECT doc_id, token AS a, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM tok), n AS (SELECT doc_id, a, b, count(*) AS n FROM b WHERE b IS NOT NULL GROUP BY ALL), p AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p, n / sum(n) OVER (PARTITION BY doc_id, a) AS c FROM n) SELECT doc_id, round(-sum(p * log2(c)), 6) AS entropy FROM p GROUP BY 1"),
    "det_06": (docs(D.diversity_length), f"WITH {TOK}, l AS (SELECT doc_id, len({TOKS}) AS n, list_transform({sents()}, lambda s: len(regexp_split_to_array(s, '\\s+'))) AS lens FROM documents), b AS (SELECT *, n // 200 AS k FROM l WHERE n >= 400), t AS (SELECT doc_id, pos // 200 AS win, count(DISTINCT token) / 200 AS ttr FROM tok JOIN b USING (doc_id) WHERE pos // 200 < k GROUP BY ALL), r AS (SELECT b.doc_id, k >= 3 AND len(lens) >= k AS enough, ttr, lens, CAST(floor(win * 200 / n * len(lens)) AS INT) AS a, least(CAST(floor((win + 1) * 200 / n * len(lens)) AS INT), len(lens)) AS e FROM b JOIN t USING (doc_id)), m AS (SELECT doc_id, enough, ttr, CASE WHEN e > a THEN list_avg(lens[a + 1:e]) ELSE 0.0 END AS m FROM r) SELECT doc_id, round(CASE WHEN any_value(enough) AND stddev_pop(ttr) * stddev_pop(m) >= 1e-12 THEN covar_pop(ttr, m) / (stddev_pop(ttr) * stddev_pop(m)) ELSE 0.0 END, 4) AS correlation FROM m GROUP BY 1"),
    "det_08": (docs(D.passive_clustering), rf"WITH {SENTB}, k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c FROM sent), h AS (SELECT doc_id, idx // (c // 4) AS run, avg(CAST(regexp_matches(' ' || lower(regexp_replace(regexp_replace(sentence, '[^\p{{L}}\s]', '', 'g'), '\s+', ' ', 'g')) || ' ', ' (?:was|were|is|are|been|being) [^ ]*(?:ed|en) ') AS DOUBLE)) AS r FROM k WHERE c >= 20 GROUP BY ALL) SELECT doc_id, round(var_samp(r), 6) AS clustering FROM h GROUP BY 1"),
    "det_13": (docs(D.comma_splices), rf"WITH h AS (SELECT doc_id, len({sents(chr(34) + ')')}) AS s, len(list_filter(list_transform(string_split(text, ','), lambda p: list_filter(regexp_split_to_array(p, '\s+'), lambda w: w <> '')), lambda w: len(w) >= 3 AND regexp_replace(lower(w[1]), '[^\p{{L}}]', '', 'g') IN ({quoted(D.SPLICE_OPENERS)}))) AS h FROM documents) SELECT doc_id, round(greatest(h - 1, 0) / s, 6) AS ratio FROM h WHERE s >= 10"),
    "det_22": (docs(D.pronoun_shifts), rf"WITH {SENT}, f AS (SELECT doc_id, idx, regexp_replace(lower(regexp_split_to_array(sentence, '\s+')[1]), '[^\p{{L}}]', '', 'g') AS w FROM sent), p AS (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY idx) AS b FROM f WHERE w IN ({quoted(D.PRONOUNS)})) SELECT doc_id, round(avg(CAST(w <> b AS DOUBLE)), 6) AS shifts FROM p WHERE b IS NOT NULL GROUP BY 1"),
}
