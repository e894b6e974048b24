"""Register of a document: its features, the rules that choose it, the baselines of its category, and the scores made from both.

All within the row. The features are measured by a kernel, and stated in SQL for the database that checks them; the rest is stated once for both.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import kernels as K
from scriptorium.functions import lexicons as L
from scriptorium.functions.dialect import SPARK, Dialect
from scriptorium.operators import measures
from scriptorium.operators.countermeasures import Layers, applied, ws

FIRST_PERSON = L.FIRST_PERSON
FEATURES = ("formality", "avg_words", "passive", "technical", "first_person", "question_ratio", "contraction_ratio", "discourse_ratio", "grade", "hedge_ratio", "avg_word_length")

#: Each register's rules, as feature, comparison and points; all that hold are added.
RULES: dict[str, list[tuple[str, float]]] = {
    "academic": [("avg_words > 18.0", 2), ("avg_words > 24.0", 2), ("passive > 0.10", 3), ("passive > 0.20", 3), ("passive > 0.35", 2), ("first_person < 15.0", 1), ("grade > 12.0", 2), ("grade > 16.0", 1.5), ("formality > 0.50", 1.5), ("discourse_ratio > 0.006", 2), ("discourse_ratio > 0.012", 1.5), ("avg_word_length > 5.0", 0.5)],
    "literary": [("avg_words > 12.0 AND avg_words < 22.0", 1.5), ("passive < 0.08", 1.5), ("first_person > 15.0", 2), ("first_person > 30.0", 1), ("contraction_ratio > 0.005", 1.5), ("grade > 6.0 AND grade < 13.0", 1.5), ("technical < 0.3", 1), ("discourse_ratio < 0.01", 1)],
    "technical": [("technical > 0.4", 3), ("technical > 0.6", 1.5), ("avg_words < 22.0", 2), ("avg_words < 18.0", 1), ("first_person < 10.0", 1.5), ("contraction_ratio < 0.003", 1.5), ("grade > 8.0 AND grade < 16.0", 1.5), ("hedge_ratio < 0.005", 1), ("avg_word_length > 5.2", 2), ("avg_word_length > 5.5", 1), ("discourse_ratio < 0.006", 2), ("passive > 0.20", -3)],
    "journalistic": [("avg_words > 15.0 AND avg_words < 25.0", 2), ("passive < 0.10", 1), ("first_person < 10.0", 1.5), ("contraction_ratio < 0.008", 1), ("grade > 7.0 AND grade < 13.0", 2), ("formality > 0.4 AND formality < 0.7", 1.5)],
    "professional": [("formality > 0.5", 1.5), ("avg_words > 15.0 AND avg_words < 25.0", 1.5), ("passive > 0.05 AND passive < 0.15", 1.5), ("first_person < 20.0 AND first_person > 5.0", 1), ("contraction_ratio < 0.005", 1), ("grade > 10.0 AND grade < 15.0", 1.5)],
    "casual": [("avg_words < 18.0", 1.5), ("first_person > 20.0", 2), ("first_person > 35.0", 1), ("contraction_ratio > 0.01", 2), ("contraction_ratio > 0.02", 1), ("formality < 0.4", 2), ("grade < 10.0", 1.5), ("question_ratio > 0.05", 1)],
    "educational": [("avg_words > 15.0 AND avg_words < 22.0", 1.5), ("question_ratio > 0.03", 1.5), ("formality > 0.4 AND formality < 0.7", 1.5), ("passive < 0.10", 1), ("grade > 8.0 AND grade < 14.0", 1.5), ("discourse_ratio > 0.01", 1)],
}
#: Labels, and what a register adds to a score.
LABELS = {"literary": "Literary / Fiction", "technical": "Technical / Documentation", "journalistic": "Journalistic / News", "professional": "Professional / Report", "casual": "Casual / Blog Post", "educational": "Educational / Textbook"}
ADJUSTMENTS = {"literary": 0.05, "technical": -0.10, "journalistic": -0.05, "professional": -0.08, "casual": 0.0, "educational": -0.10}
#: Mean and deviation of each metric in each category; "" stands for all other categories.
METRICS = ("avg_words", "passive", "contraction_ratio", "ttr", "avg_word_length", "grade", "discourse_ratio", "hedge_ratio", "paragraph_cv")
BASELINES = {
    "academic": [(24.0, 5.0), (0.15, 0.06), (0.001, 0.002), (0.55, 0.10), (5.2, 0.5), (14.0, 3.0), (0.015, 0.008), (0.012, 0.006), (0.5, 0.2)],
    "literary": [(16.0, 5.0), (0.06, 0.04), (0.015, 0.010), (0.60, 0.12), (4.5, 0.5), (8.0, 3.0), (0.008, 0.005), (0.008, 0.005), (0.7, 0.25)],
    "technical": [(18.0, 4.0), (0.10, 0.05), (0.002, 0.003), (0.50, 0.10), (5.5, 0.5), (12.0, 3.0), (0.008, 0.005), (0.004, 0.003), (0.6, 0.25)],
    "casual": [(13.0, 4.0), (0.04, 0.03), (0.025, 0.012), (0.55, 0.12), (4.2, 0.4), (7.0, 2.5), (0.010, 0.006), (0.010, 0.006), (0.8, 0.3)],
    "": [(18.0, 5.0), (0.08, 0.05), (0.008, 0.006), (0.55, 0.10), (4.8, 0.5), (10.0, 3.0), (0.010, 0.006), (0.008, 0.005), (0.6, 0.25)],
}


def feature_layers(d: Dialect) -> Layers:
    """REG-01: the eleven features, and what else the baselines need."""
    listed = lambda words: f"{d.size(d.filter('toks', 't_', f't_ IN ({d.words(words)})'))} * 1e0 / n"
    syllable = d.replace("t_", "[^aeiouy]+", " ")
    groups = d.size(d.filter(d.split(syllable, " "), "g_", "g_ <> ''"))
    count = f"CASE WHEN {d.bytes('t_')} <= 3 THEN 1 ELSE greatest({groups} - CASE WHEN t_ LIKE '%e' AND {groups} > 1 THEN 1 ELSE 0 END, 1) END"
    joined = "(' ' || " + f"lower({d.replace(d.replace('s_', r'[^\p{L}\s]'), r'\s+', ' ')})" + " || ' ')"
    passive = d.matches(joined, rf" (?:{'|'.join(L.BE_FORMS)}) [^ ]*(?:ed|en|wn|nt) ")
    multi = " + ".join(f"CAST((length(joined) - length(replace(joined, {d.text(p)}, ''))) / {len(p)} AS BIGINT)" for p in L.DISCOURSE_MULTI)
    paras = d.filter(d.map(d.split("text", "\n\n"), "p_", d.replace("p_", r"^\s+|\s+$")), "p_", "p_ <> ''")
    double = lambda x: f"CAST({x} AS DOUBLE)"
    return [
        {"toks": d.tokens("text"), "sents": d.sentences("text"), "paras": d.map(paras, "p_", double(d.bytes("p_")))},
        {"n": f"greatest({d.size('toks')}, 1)", "m": f"greatest({d.size('sents')}, 1)", "joined": d.join("toks", " "), "stops": f"greatest(length({d.replace('text', '[^.!?]')}), 1)"},
        {
            "avg_words": f"{d.total(d.map('sents', 's_', double(d.size(d.split('s_', r'\s+')))))} / m",
            "passive": f"{d.size(d.filter('sents', 's_', passive))} * 1e0 / m",
            "question_ratio": f"{d.size(d.filter('sents', 's_', f's_ LIKE {d.text('%?')}'))} * 1e0 / m",
            "contraction_ratio": f"{d.size(d.filter('toks', 't_', f't_ = {d.text('cannot')} OR (contains(t_, {d.text(chr(39))}) AND {d.bytes('t_')} > 2)'))} * 1e0 / n",
            "first_person": f"{d.size(d.filter('toks', 't_', f't_ IN ({d.words(L.FIRST_PERSON)})'))} * 1e3 / n",
            "hedge_ratio": listed(L.HEDGES),
            "discourse_ratio": f"({d.size(d.filter('toks', 't_', f't_ IN ({d.words(L.DISCOURSE_SINGLE)})'))} + {multi}) * 1e0 / n",
            "avg_word_length": f"{d.total(d.map('toks', 't_', double(d.bytes('t_'))))} / n",
            "grade": f"0.39 * (n * 1e0 / stops) + 11.8 * ({d.total(d.map('toks', 't_', double(count)))} / n) - 15.59",
            "ttr": f"{d.size(d.distinct('toks'))} * 1e0 / n",
            "paragraph_cv": f"CASE WHEN {d.size('paras')} > 1 AND {d.mean('paras')} > 0 THEN sqrt({d.sample_variance('paras')}) / {d.mean('paras')} ELSE 0.0 END",
        },
        {
            "formality": "least(avg_words / 30.0, 1.0) * 0.25 + passive * 0.25 + least(greatest(1.0 - contraction_ratio * 100.0, 0.0), 1.0) * 0.25 + (1.0 - least(first_person / 50.0, 1.0)) * 0.25",
            "technical": "least(greatest((avg_word_length - 4.0) / 3.0, 0.0), 1.0)",
        },
    ]


def rule_layers(d: Dialect) -> Layers:
    """REG-02: points of the seven registers; the first with most wins, with its subtype, category and confidence."""
    points = {f"p_{r}": f"CAST({' + '.join(f'CASE WHEN {test} THEN {float(p)} ELSE 0.0 END' for test, p in rules)} AS DOUBLE)" for r, rules in RULES.items()}
    names = list(points)
    best = f"greatest({', '.join(names)})"
    category = "CASE " + " ".join(f"WHEN {p} = best THEN '{p[2:]}'" for p in names) + " END"
    subtype = "CASE WHEN grade > 14.0 AND passive > 0.15 THEN 'Academic / Legal' WHEN technical > 0.5 AND first_person < 10.0 THEN 'Academic / Scientific' WHEN discourse_ratio > 0.015 AND hedge_ratio > 0.01 THEN 'Academic / Humanities' ELSE 'Academic / General' END"
    label = f"CASE {' '.join(f"WHEN category = '{r}' THEN '{x}'" for r, x in LABELS.items())} ELSE {subtype} END"
    second = "greatest(" + ", ".join(f"CASE WHEN category = '{p[2:]}' THEN -1e9 ELSE {p} END" for p in names) + ")"
    adjustment = f"CASE {' '.join(f"WHEN category = '{r}' THEN {x}" for r, x in ADJUSTMENTS.items())} WHEN label = 'Academic / Legal' THEN -0.20 ELSE -0.15 END"
    return [
        points,
        {"best": best, "points": " + ".join(names)},
        {"category": category},
        {"label": label, "second": second},
        {"confidence": "CASE WHEN points > 0 THEN greatest(least((best - second) / points + 0.5, 0.95), 0.3) ELSE 0.3 END", "register_adjustment": adjustment},
    ]


def baseline_layers(d: Dialect) -> Layers:
    """BAS-01: z-score of each metric against the category's baseline, and how many are expected, atypical or anomalous."""
    out: dict[str, str] = {}
    for i, metric in enumerate(METRICS):
        known = " ".join(f"WHEN category = '{c}' THEN ({metric} - {b[i][0]}) / {b[i][1]}" for c, b in BASELINES.items() if c)
        out[f"z_{metric}"] = f"CASE {known} ELSE ({metric} - {BASELINES[''][i][0]}) / {BASELINES[''][i][1]} END"
    count = lambda test: " + ".join(f"CASE WHEN {test.format(f'abs({z})')} THEN 1 ELSE 0 END" for z in out)
    return [out, {"expected": count("{0} <= 1.0"), "atypical": count("{0} > 1.0 AND {0} <= 2.0"), "anomalous": count("{0} > 2.0"), "extreme": count("{0} > 3.0")}]


def confidence_layers(d: Dialect) -> Layers:
    """ACS-01 from text alone: share of expected metrics less that of anomalous ones, with the margin that this evidence leaves."""
    n = f"{len(METRICS)}e0"
    return [
        {"acs": f"least(greatest(40.0 + expected / {n} * 50.0 - anomalous / {n} * 30.0, 0.0), 100.0)", "margin": "22.0"},
        {"acs_low": "greatest(acs - margin, 0.0)", "acs_high": "least(acs + margin, 100.0)"},
        {"reading": "CASE WHEN round(acs, 6) >= 75 THEN 'strong' WHEN round(acs, 6) >= 50 THEN 'moderate' WHEN round(acs, 6) >= 25 THEN 'limited' ELSE 'weak' END"},
    ]


def acs(forensics: str, stylometric: str, text: str) -> str:
    """ACS-01 in general: SQL of the score from its three components, of which the first two may be null."""
    weights = {(True, True): (0.40, 0.30, 0.30), (True, False): (0.55, 0.0, 0.45), (False, True): (0.0, 0.50, 0.50), (False, False): (0.0, 0.0, 1.0)}
    cases = []
    for (f, s), (a, b, c) in weights.items():
        test = f"{forensics} IS {'NOT ' if f else ''}NULL AND {stylometric} IS {'NOT ' if s else ''}NULL"
        cases.append(f"WHEN {test} THEN least(greatest(coalesce({forensics}, 0) * {a} + coalesce({stylometric}, 0) * {b} + {text} * {c}, 0.0), 100.0)")
    return f"CASE {' '.join(cases)} END"


def margin(forensics: str, stylometric: str, baselines: str) -> str:
    parts = " ".join(f"- CASE WHEN {x} IS NOT NULL THEN {w} ELSE 0.0 END" for x, w in ((forensics, 8.0), (stylometric, 7.0), (baselines, 3.0)))
    return f"greatest(25.0 {parts}, 5.0)"


def further_layers(d: Dialect) -> Layers:
    """All that is made of the features."""
    return [*rule_layers(d), *baseline_layers(d), *confidence_layers(d)]


def all_layers(d: Dialect) -> Layers:
    return [*feature_layers(d), *further_layers(d)]


#: What a kernel measures for the register, and for a comparison beyond; formality and technical level are made of these.
FIELDS = {n: pa.int64() if n == "n" else pa.float64() for n in measures.REGISTER}
COMPARED_FIELDS = FIELDS | {n: pa.int64() if n == "words" else pa.float64() for n in measures.COMPARED}


def measured(docs: DataFrame, *keys: str) -> DataFrame:
    """REG-01: ``keys`` and the features of each text."""
    return applied(K.mapped(docs, list(keys), lambda text: [measures.register(text)], FIELDS), feature_layers(SPARK)[3:])


#: Columns of each query, as name and expression.
COLUMNS = {
    "features": {f: f"round({f}, 5)" for f in FEATURES},
    "register": {"label": "label", "category": "category", "confidence": "round(confidence, 5)", "register_adjustment": "CAST(register_adjustment AS DOUBLE)", **{f"p_{r}": f"CAST(p_{r} AS DOUBLE)" for r in RULES}},
    "baselines": {"category": "category", **{f"z_{m}": f"round(z_{m}, 5)" for m in METRICS}, **{c: f"CAST({c} AS BIGINT)" for c in ("expected", "atypical", "anomalous")}},
    "acs": {"acs": "round(CAST(acs AS DOUBLE), 5)", "margin": "CAST(margin AS DOUBLE)", "acs_low": "round(CAST(acs_low AS DOUBLE), 5)", "acs_high": "round(CAST(acs_high AS DOUBLE), 5)", "reading": "reading"},
    "anomalies": {"high": "CAST(0 AS BIGINT)", "medium": "CAST(CASE WHEN anomalous >= 3 THEN 1 ELSE 0 END AS BIGINT)", "low": "CAST(extreme AS BIGINT)", "flags": "concat_ws(',', CASE WHEN anomalous >= 3 THEN 'medium:register' END, " + ", ".join(f"CASE WHEN abs(z_{m}) > 3.0 THEN 'low:{m}' END" for m in METRICS) + ")"},
}


_WHOLE = lambda x: f"CAST(round({x}) AS INT)"
_FLAGS = "(extreme + CASE WHEN anomalous >= 3 THEN 1 ELSE 0 END)"
#: CNT-01: what an evaluator reads first; without files there is no evidence of the process.
SUMMARY = f"concat(CASE WHEN {_FLAGS} = 0 THEN 'This analysis found no specific anomalies in the document.' ELSE concat('This analysis identified ', {_FLAGS}, CASE WHEN {_FLAGS} = 1 THEN ' anomaly' ELSE ' anomalies' END, ' warranting further review.') END, ' Process evidence quality is insufficient. Authorship confidence score: ', {_WHOLE('acs')}, '/100 (±', {_WHOLE('margin')}, ').', CASE WHEN {_FLAGS} = 0 THEN '' ELSE ' See anomaly details below.' END)"
ADVICE = "CASE WHEN acs >= 75 AND anomalous < 3 THEN 'No further action is suggested.' WHEN acs >= 50 THEN 'Talk the text over with its author.' WHEN acs >= 25 THEN 'Ask for drafts and notes.' ELSE 'Ask for drafts, notes and a second reading.' END"
_ENTRIES = [("register", "label"), ("expected", "expected"), ("atypical", "atypical"), ("anomalous", "anomalous"), ("score", _WHOLE("acs")), ("margin", _WHOLE("margin")), ("reading", "reading")]
COLUMNS["narrative"] = {"summary": SUMMARY, "advice": ADVICE}
#: SNK-01: a document's report as text, JSON and HTML.
COLUMNS["reports"] = {
    "as_text": "concat(" + ", chr(10), ".join(f"'{k}: ', {e}" for k, e in _ENTRIES) + ")",
    "as_json": "concat('{', " + ", ', ', ".join(f"""'"{k}": ', """ + (f"""'"', {e}, '"'""" if k in ("register", "reading") else e) for k, e in _ENTRIES) + ", '}')",
    "as_html": "concat('<dl>', " + ", ".join(f"'<dt>{k}</dt><dd>', replace(replace(concat('', {e}), '&', '&amp;'), '<', '&lt;'), '</dd>'" for k, e in _ENTRIES) + ", '</dl>')",
}


def registers(docs: DataFrame, what: str = "register") -> DataFrame:
    rows = applied(measured(docs, "doc_id"), further_layers(SPARK))
    return rows.select("doc_id", *[F.expr(e).alias(k) for k, e in COLUMNS[what].items()])


def register_features(docs: DataFrame) -> DataFrame:
    """REG-01."""
    return registers(docs, "features")


def white_space_words(d: Dialect) -> str:
    return d.size(ws(d, "text"))
