"""Tone, argument, cognition, construction, first-language and rewriting measurements; within the row, for both SQL dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.dialect import SPARK, Dialect
from scriptorium.operators.countermeasures import Layers, applied, having, ws

# Markers, patterns and word lists of the measurements.
FORMAL = ["furthermore", "moreover", "nevertheless", "notwithstanding", "hereby", "thereof", "pursuant", "accordingly", "henceforth", "aforementioned", "hereinafter", "whereas"]
INFORMAL = ["gonna", "wanna", "kinda", "gotta", "y'all", "ain't", "yeah", "nah", "lol", "omg", "tbh", "imo", "btw", "super", "totally", "literally", "basically"]
URGENT = ["immediately", "urgent", "critical", "asap", "now", "deadline", "hurry", "emergency", "time-sensitive", "must", "imperative", "right away", "without delay", "at once"]
ENTHUSIASM = ["amazing", "incredible", "fantastic", "wonderful", "excellent", "brilliant", "outstanding", "remarkable", "extraordinary", "love", "thrilled", "excited", "delighted", "passionate"]
CRITICAL = ["however", "problematic", "flawed", "inadequate", "insufficient", "fails to", "overlooks", "ignores", "questionable", "concerning", "disappointing", "misguided", "fundamentally"]
EMPATHY = ["i understand", "i can see", "that must be", "it's natural to", "you might feel", "it's okay to", "i appreciate", "that sounds", "i hear you", "i recognize"]
CONTRADICTION = ["oh sure", "right", "yeah right", "of course", "obviously", "brilliant", "genius", "wonderful", "great job", "shocking"]
EXCITED_MARKS = [r"\.{3,}", r"\?!+", r"!{2,}", '"[^"]{3,20}"']
PRAISE = ["great", "wonderful", "amazing", "brilliant", "fantastic", "excellent"]
NEGATION = ["not", "never", "no", "don't", "doesn't", "isn't"]
TENTATIVE = ["might", "could", "perhaps", "maybe", "possibly"]
ASSERTIVE = ["must", "clearly", "obviously", "certainly"]
CLAIMS = ["i argue", "i believe", "i contend", "we propose", "this suggests", "it is clear", "evidently", "the point is", "my position is", "we maintain", "i assert", "the thesis is", "our claim is"]
EVIDENCE = ["for example", "for instance", "evidence shows", "research indicates", "studies suggest", "data shows", "according to", "as demonstrated", "the findings", "statistics show", "experiments reveal", "as shown by", "this is supported by", "consistent with"]
CONCLUSIONS = ["therefore", "thus", "hence", "consequently", "as a result", "in conclusion", "it follows that", "we can conclude", "this means", "this implies", "the upshot is", "taken together"]
DOUBT = ["might", "could", "may", "perhaps", "possibly", "probably", "somewhat", "relatively", "arguably", "seemingly", "apparently", "it seems", "it appears", "to some extent", "in some cases", "tends to", "is likely", "suggests that"]
CERTAINTY = ["certainly", "definitely", "absolutely", "clearly", "obviously", "undoubtedly", "unquestionably", "without doubt", "inevitably", "always", "never", "every", "none", "must", "proven"]
ETHOS = ["as an expert", "in my experience", "studies show", "research proves", "authorities agree", "experts say", "it is well established", "the consensus is", "peer-reviewed", "according to"]
PATHOS = ["imagine", "feel", "suffering", "tragic", "beautiful", "horrifying", "inspiring", "heartbreaking", "devastating", "exciting", "alarming", "frightening", "moving", "touching", "powerful"]
LOGOS = ["because", "since", "if...then", "given that", "follows from", "logically", "ratio", "percentage", "statistic", "correlation", "data", "evidence", "proof", "demonstrates"]
FALLACIES = {
    "ad_hominem": [r"they\s+(?:are|were)\s+(?:just|merely|only)", r"what\s+(?:do|would)\s+they\s+know"], "straw_man": [r"(?:they|he|she)\s+(?:thinks?|believes?|wants?)\s+(?:that\s+)?(?:all|every|nothing)"],
    "false_dichotomy": [r"either\s+.+\s+or\s+.+\s+(?:nothing|no\s+other)", r"you(?:'re|\s+are)\s+either\s+with\s+us\s+or"], "appeal_to_authority": [r"(?:everyone|all\s+experts?)\s+(?:knows?|agrees?)"],
    "slippery_slope": [r"if\s+(?:we|they)\s+.+\s+(?:next|soon|eventually)\s+.+\s+will"], "bandwagon": [r"(?:everyone|most\s+people|the\s+majority)\s+(?:thinks?|believes?|agrees?)"],
}
CONCRETE, ABSTRACT = ["the", "this", "that", "here", "there", "now", "today"], ["concept", "theory", "principle", "notion", "idea", "essence"]
TENSES = {"past": ["was", "were", "had", "did", "went", "said"], "present": ["is", "are", "has", "does", "go", "say"], "future": ["will", "shall", "going to", "plan", "expect"]}
LINKS = ["however", "moreover", "furthermore", "additionally", "nevertheless", "therefore", "consequently", "meanwhile", "similarly", "in contrast"]
COMMON = ["the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "to", "for", "of", "and", "or", "but", "not", "with", "this", "that"]
#: One pattern of the first language needs a look-behind of any width, which neither engine has; it is left out.
FIRST_LANGUAGE = {
    "mandarin": [r"\b(?:a|an|the)\s+(?:a|an|the)\b", r"\balready\s+\w+ed\b"], "spanish": [r"\b\w+\s+(?:big|small|red|blue|old|new)\b", r"\bis\s+being\s+\w+\b", r"\bnot\s+\w+\s+no\b"],
    "arabic": [r"\band\s+\w+\s+and\s+\w+\s+and\b", r"\bwhich\s+\w+\s+it\b", r"\bthat\s+\w+\s+they\b"], "japanese": [r"^(?:as\s+for|regarding|about)\s+\w+,"],
    "french": [r"\b(?:actually|eventually|sympathetic|resume)\b"], "hindi": [r"\bis\s+\w+ing\s+(?:since|from)\b", r"\b(?:in|on|at)\s+(?:the\s+)?(?:morning|evening|night)\b"],
}
HUMANIZED = [r"\b(?:make|do)\s+(?:a\s+)?(?:big|large|huge)\s+(?:impact|difference|effort)\b", r"\b(?:sort\s+of|kind\s+of|in\s+a\s+way|to\s+some\s+extent)\b", r"\b(?:honestly|frankly|basically|essentially|actually|literally)\b"]
TRANSLATED = [r"\b(?:it\s+is\s+that|there\s+is\s+a\s+fact)\b", r"\bthe\s+\w+\s+of\s+the\s+\w+\s+of\b"]


def found(d: Dialect, text: str, pattern: str) -> str:
    """How often a pattern matches."""
    return f"size(regexp_extract_all({text}, {d.pattern(pattern)}, 0))" if d.name == "spark" else f"len(regexp_extract_all({text}, {d.text(pattern)}))"


def of(d: Dialect, words: str, listed: list[str]) -> str:
    return d.size(d.filter(words, "w_", f"w_ IN ({d.words(listed)})"))


def capped(x: str, at: float) -> str:
    return f"least({x} / {at}e0, 1e0)"


def tone(d: Dialect) -> Layers:
    """RES-02: formality, urgency, sarcasm and the five strongest tones of a text."""
    fragments = d.split("text", "[.!?]+")
    lens = d.map(fragments, "f_", f"CAST({d.size(ws(d, 'f_'))} AS DOUBLE)")
    inverted = d.size(d.filter(d.split("text", r"[.!?]\s+"), "s_", f"{having('lower(s_)', PRAISE, d)} > 0 AND {having('lower(s_)', NEGATION, d)} > 0"))
    marks = " + ".join(f"CASE WHEN {d.matches('text', p)} THEN 0.5e0 ELSE 0e0 END" for p in EXCITED_MARKS)
    upper = d.size(d.filter("ws", "w_", f"upper(w_) = w_ AND lower(w_) <> w_ AND length(w_) > 2"))
    return [
        {"low": "lower(text)", "ws": ws(d, "text"), "lens": lens},
        {"lws": d.map("ws", "w_", "lower(w_)"), "n": f"greatest({d.size('ws')}, 1)", "mean_len": d.mean("lens"), "formal": having("low", FORMAL, d), "informal": having("low", INFORMAL, d), "contractions": found(d, "low", r"\b\w+'(?:t|s|re|ve|ll|d|m)\b")},
        {
            "formality": "least(greatest(0.40e0 * (formal + 1e0) / (formal + informal + 2e0) + 0.25e0 * least(coalesce(mean_len, 0e0) / 25e0, 1e0) + 0.20e0 * (1e0 - least(contractions * 10e0 / n, 1e0)) + 0.15e0 * CASE WHEN contains(text, '!') THEN 0.5e0 ELSE 1e0 END, 0e0), 1e0)",
            "urgency": f"least({having('low', URGENT, d)} * 0.15e0 + (length(text) - length(replace(text, '!', ''))) * 0.05e0 + {upper} * 0.03e0, 1e0)",
            "sarcasm": f"least(({having('low', CONTRADICTION, d)} + {marks} + {inverted} * 0.3e0) / {max(0.3 * (len(CONTRADICTION) + len(EXCITED_MARKS)), 1):.6f}e0, 1e0)",
            "enthusiastic": capped(having("low", ENTHUSIASM, d), 5), "critical": capped(having("low", CRITICAL, d), 5), "empathetic": capped(having("low", EMPATHY, d), 3),
            "hedged": of(d, "lws", TENTATIVE), "certain": of(d, "lws", ASSERTIVE),
        },
        {"assertive": f"CASE WHEN certain > hedged THEN {capped('certain', 5)} ELSE 0e0 END", "tentative": f"CASE WHEN hedged > certain THEN {capped('hedged', 5)} ELSE 0e0 END"},
        {"main_tone": "CASE WHEN greatest(enthusiastic, critical, empathetic, assertive, tentative, CASE WHEN formality > 0.7 THEN formality WHEN formality < 0.3 THEN 1 - formality ELSE 0e0 END) <= 0 THEN 'neutral' "
         + " ".join(f"WHEN {t} >= greatest(enthusiastic, critical, empathetic, assertive, tentative, CASE WHEN formality > 0.7 THEN formality WHEN formality < 0.3 THEN 1 - formality ELSE 0e0 END) THEN '{t}'" for t in ("enthusiastic", "critical", "empathetic", "assertive", "tentative"))
         + " WHEN formality > 0.7 THEN 'formal' ELSE 'informal' END"},
    ]


def argument(d: Dialect) -> Layers:
    """RES-05: argument structure, persuasion, cognition, fallacies and the spread of certainty over sentences."""
    where = lambda marks: d.filter(d.upto(d.size("ss")), "i_", f"{having(d.at('ss', 'i_'), marks, d)} > 0")
    mean = lambda a: d.mean(d.map(a, "i_", "CAST(i_ AS DOUBLE)"))
    sure = f"{having('s_', CERTAINTY, d)} * 1e0 / greatest({having('s_', CERTAINTY, d)} + {having('s_', DOUBT, d)}, 1)"
    fallacies = "concat_ws(',', " + ", ".join(f"CASE WHEN {' OR '.join(d.matches('low', p) for p in patterns)} THEN '{name}' END" for name, patterns in FALLACIES.items()) + ")"
    most = lambda names: "CASE " + " ".join(f"WHEN {n} >= greatest({', '.join(names)}) THEN '{n}'" for n in names) + " END"
    return [
        {"low": "lower(text)", "lws": d.map(ws(d, "text"), "w_", "lower(w_)"), "ss": d.split(d.replace("lower(text)", r"([.!?])\s+", "$1\x01" if d.name == "spark" else r"\1" + "\x01"), "\x01")},
        {"claim_at": where(CLAIMS), "evidence_at": where(EVIDENCE), "conclusion_at": where(CONCLUSIONS), "ethos": having("low", ETHOS, d), "pathos": having("low", PATHOS, d), "logos": having("low", LOGOS, d), "doubts": having("low", DOUBT, d), "certainties": having("low", CERTAINTY, d), "concrete": of(d, "lws", CONCRETE), "abstract": of(d, "lws", ABSTRACT), **{t: of(d, "lws", w) for t, w in TENSES.items()}, "profile": d.map("ss", "s_", sure), "fallacies": fallacies},
        {
            "claims": d.size("claim_at"), "evidence": d.size("evidence_at"), "conclusions": d.size("conclusion_at"),
            "pattern": f"CASE WHEN {d.size('claim_at')} > 0 AND {d.size('conclusion_at')} > 0 THEN CASE WHEN {mean('claim_at')} < {mean('conclusion_at')} THEN 'deductive' ELSE 'inductive' END WHEN {d.size('evidence_at')} > 0 AND {d.size('claim_at')} = 0 THEN 'abductive' ELSE 'none' END",
            "strategy": most(("ethos", "pathos", "logos")), "certainty": "certainties * 1e0 / greatest(doubts + certainties, 1)", "abstraction": "abstract * 1e0 / greatest(concrete + abstract, 1)", "orientation": most(("past", "present", "future")),
            "certainty_spread": f"CASE WHEN {d.size('profile')} > 1 THEN sqrt({d.sample_variance('profile')}) ELSE 0.0 END",
        },
    ]


def construction(d: Dialect) -> Layers:
    """RES-06: style jumps and breaks of topic between neighbouring paragraphs."""
    paras = d.filter(d.map(d.split("text", "\n\n"), "p_", d.replace("p_", r"^\s+|\s+$")), "p_", "p_ <> ''")
    words = d.map("ps", "p_", d.map(ws(d, "p_"), "w_", "lower(w_)"))
    full = d.map("ps", "p_", f"greatest({d.size(d.filter(d.split('p_', '[.]'), 's_', d.matches('s_', r'\S')))}, 1)")
    a, b = d.at("pw", "i_"), d.at("pw", "i_ + 1")
    length = lambda i: f"({d.size(d.at('pw', i))} * 1e0 / {d.at('stops', i)})"
    rich = lambda x: f"({d.size(d.distinct(x))} * 1e0 / nullif({d.size(x)}, 0))"
    jump = f"(abs({length('i_')} - {length('i_ + 1')}) / greatest({length('i_')}, {length('i_ + 1')}, 1e0) + abs({rich(a)} - {rich(b)})) / 2"
    content = lambda x: d.filter(d.distinct(x), "w_", f"w_ NOT IN ({d.words(COMMON)})")
    both = f"array_intersect({content(a)}, {content(b)})" if d.name == "spark" else f"list_intersect({content(a)}, {content(b)})"
    union = f"array_union({content(a)}, {content(b)})" if d.name == "spark" else f"list_distinct(list_concat({content(a)}, {content(b)}))"
    return [
        {"ps": paras},
        {"np": d.size("ps"), "pw": words, "stops": full},
        {"jumps": d.filter(d.map(d.filter(d.upto("np - 1"), "i_", f"{d.size(a)} >= 10 AND {d.size(b)} >= 10"), "i_", jump), "x_", "x_ > 0.2"), "breaks": d.filter(d.upto("np - 1"), "i_", f"{d.at(b, '1')} NOT IN ({d.words(LINKS)}) AND {d.size(both)} * 1e0 / greatest({d.size(union)}, 1) < 0.05")},
        {"several": f"CASE WHEN {d.size('jumps')} = 0 THEN 0e0 ELSE least({d.mean('jumps')} * 2, 1e0) END"},
        {"editing": f"CASE WHEN np < 2 THEN 'linear' WHEN several > 0.6 THEN 'assembled' WHEN {d.size('breaks')} > 2 THEN 'non-linear' ELSE 'linear' END"},
    ]


def first_language(d: Dialect) -> Layers:
    """RES-07: traces of a first language; the first with most, if over two."""
    counts = {f"l_{k}": " + ".join(found(d, "low", p) for p in patterns) for k, patterns in FIRST_LANGUAGE.items()}
    best = f"greatest({', '.join(counts)})"
    return [
        {"low": "lower(text)"},
        counts,
        {"best": best, "traces": " + ".join(counts)},
        {"first_language": "CASE WHEN best > 2 THEN CASE " + " ".join(f"WHEN {c} = best THEN '{c[2:]}'" for c in counts) + " END END", "share": "CASE WHEN best > 2 THEN best * 1e0 / traces ELSE 0e0 END", "probability": "CASE WHEN best > 2 THEN least(best / 10e0, 1e0) ELSE 0e0 END"},
    ]


def rewriting(d: Dialect) -> Layers:
    """RES-08: traces of humanizers, of translation there and back, and of paraphrase (bigrams that hardly repeat)."""
    pair = f"concat({d.at('lws', 'i_')}, ' ', {d.at('lws', 'i_ + 1')})"
    names = ("humanized", "paraphrased", "back_translation")
    top = f"greatest({', '.join(names)})"
    return [
        {"low": "lower(text)", "lws": d.map(ws(d, "text"), "w_", "lower(w_)")},
        {"n": d.size("lws"), "pairs": d.map(d.upto(f"{d.size('lws')} - 1"), "i_", pair)},
        {"humanized": f"least(({' + '.join(found(d, 'low', p) for p in HUMANIZED)}) / 10e0, 1e0)", "back_translation": f"least(({' + '.join(found(d, 'low', p) for p in TRANSLATED)}) / 5e0, 1e0)", "paraphrased": f"CASE WHEN n < 20 THEN 0e0 ELSE greatest(({d.size(d.distinct('pairs'))} * 1e0 / greatest({d.size('pairs')}, 1) - 0.85e0) * 5e0, 0e0) END"},
        {"manipulation": f"CASE WHEN {top} <= 0.3 THEN 'none' " + " ".join(f"WHEN {n} >= {top} THEN '{n}'" for n in names) + " END"},
    ]


def _r(*names: str) -> dict[str, str]:
    return {n: f"round(CAST({n} AS DOUBLE), 5)" for n in names}


def _n(d: Dialect, **names: str) -> dict[str, str]:
    return {k: f"CAST({v} AS BIGINT)" for k, v in names.items()}


REPORTS = {
    "tone": (tone, lambda d: {**_r("formality", "urgency", "sarcasm", "enthusiastic", "critical", "empathetic", "assertive", "tentative"), "main_tone": "main_tone"}),
    "argument": (argument, lambda d: {**_n(d, claims="claims", evidence="evidence", conclusions="conclusions"), **_r("certainty", "abstraction", "certainty_spread"), "pattern": "pattern", "strategy": "strategy", "orientation": "orientation", "fallacies": "fallacies"}),
    "construction": (construction, lambda d: {**_n(d, paragraphs="np", jumps=d.size("jumps"), breaks=d.size("breaks")), **_r("several"), "editing": "editing"}),
    "first_language": (first_language, lambda d: {"first_language": "first_language", **_r("share", "probability"), **_n(d, traces="traces")}),
    "rewriting": (rewriting, lambda d: {**_r("humanized", "back_translation", "paraphrased"), "manipulation": "manipulation"}),
}


def report(docs: DataFrame, name: str) -> DataFrame:
    make, columns = REPORTS[name]
    rows = applied(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), make(SPARK))
    return rows.select("doc_id", *[F.expr(e).alias(k) for k, e in columns(SPARK).items()])
