"""What may mislead the score of a text: non-native writing, boilerplate, editing tools, humanizers; and the detector that allows for them.

Each is a few layers of expressions within the row, stated once for both SQL dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import lexicons as L
from scriptorium.functions.dialect import SPARK, Dialect

Layers = list[dict[str, str]]
LETTERS = r"[^\p{L}]"


def ws(d: Dialect, text: str) -> str:
    return d.filter(d.split(text, r"\s+"), "w_", "w_ <> ''")


def clean(d: Dialect, word: str) -> str:
    return d.replace(f"lower({word})", LETTERS)


def having(text: str, phrases: list[str], d: Dialect) -> str:
    """How many of the phrases a text holds."""
    return "(" + " + ".join(f"CASE WHEN contains({text}, {d.text(p)}) THEN 1 ELSE 0 END" for p in phrases) + ")"


def cv(d: Dialect, lengths: str) -> str:
    return f"CASE WHEN {d.mean(lengths)} > 0 THEN sqrt({d.variance(lengths)}) / {d.mean(lengths)} ELSE 0.0 END"


def lengths(d: Dialect, sentences: str) -> str:
    return d.map(sentences, "s_", f"CAST({d.size('s_')} AS DOUBLE)")


def step(x: str, *bounds: tuple[str, float], other: float = 0.0) -> str:
    return "CASE " + " ".join(f"WHEN {x} {b} THEN {v}" for b, v in bounds) + f" ELSE {other} END"


def base(d: Dialect) -> Layers:
    """Words, and the sentences between full stops, as arrays of words."""
    fragments = d.map(d.split("text", "[.!?]"), "f_", ws(d, "f_"))
    return [
        {"low": "lower(text)", "ws": ws(d, "text"), "toks": d.tokens("text"), "fr": fragments},
        {"n": d.size("ws"), "nt": d.size("toks"), "cl": d.map("ws", "x_", clean(d, "x_")), **{f"s{k}": d.filter("fr", "s_", f"{d.size('s_')} >= {k}") for k in (1, 3, 5)}},
    ]


def nnes(d: Dialect) -> Layers:
    """SCO-05: five indicators of writing in a second language, their mean, and the adjustment."""
    here, after, raw = d.at("cl", "i_"), d.at("cl", "i_ + 1"), d.at("ws", "i_ + 1")
    some = lambda test: d.size(d.filter(d.upto("n - 1"), "i_", test))
    bare = f"{here} IN ({d.words(L.SHORT_PREPOSITIONS)}) AND {after} NOT IN ({d.words(L.ARTICLES)}) AND {d.bytes(after)} > 4 AND {d.matches(raw, r'^\p{Lu}')}"
    vowel = d.matches(after, "^[aeiou]")
    wrong_a = f"{here} = 'a' AND {vowel} AND {d.bytes(after)} > 1"
    wrong_an = f"{here} = 'an' AND NOT {vowel} AND {d.bytes(after)} > 1 AND NOT {d.matches(after, '^h')}"
    first = d.map("s3", "s_", clean(d, d.at("s_", "1")))
    contracted = " + ".join(f"CAST((length(text) - length(replace(text, {d.text(c)}, ''))) / {len(c)} AS BIGINT)" for c in L.CONTRACTED)
    of = lambda words: f"{d.size(d.filter('toks', 't_', f't_ IN ({d.words(words)})'))} * 1e0 / nullif(nt, 0)"
    return [
        *base(d),
        {"wrong": f"CASE WHEN n >= 50 THEN {some(bare)} + 2 * {some(wrong_a)} + 2 * {some(wrong_an)} END", "op": first, "personal": of(L.PERSONAL), "preps": of(L.PREPOSITIONS), "expanded": having("low", L.EXPANDABLE, d), "contracted": contracted, "idioms": f"{having('low', L.IDIOMS, d)} / nullif(n / 500.0, 0)"},
        {
            "determiners": "CASE WHEN n >= 50 THEN least(wrong * 1e0 / n * 100.0 * 5.0, 1.0) ELSE 0.0 END",
            "openings": f"CASE WHEN {d.size('op')} < 8 THEN 0.0 ELSE ({step(f'{d.size(d.distinct('op'))} * 1e0 / nullif({d.size('op')}, 0)', ('< 0.30', 0.7), ('< 0.45', 0.3))} + {step(f'{d.size(d.filter('op', 'o_', f"o_ IN ({d.words(L.SIMPLE_OPENERS)})"))} * 1e0 / nullif({d.size('op')}, 0)', ('> 0.70', 0.6), ('> 0.55', 0.3))}) / 2 END",
            "contractions": f"CASE WHEN personal < 0.03 OR expanded + contracted = 0 THEN 0.0 ELSE {step('expanded * 1e0 / (expanded + contracted)', ('> 0.70', 0.6), ('> 0.50', 0.3))} END",
            "prepositions": "CASE WHEN preps < 0.07 OR preps > 0.20 THEN least(abs(preps - 0.125) * 8.0, 0.6) ELSE 0.0 END",
            "idiom": f"CASE WHEN n < 200 THEN 0.0 ELSE {step('idioms', ('< 0.5', 0.5), ('< 1.0', 0.2))} END",
        },
        {"mean": "CASE WHEN nt < 100 THEN 0.0 ELSE (determiners + openings + contractions + prepositions + idiom) / 5.0 END"},
        {"nnes": "mean > 0.30", "nnes_confidence": "round(least(mean, 1.0), 6)", "nnes_adjustment": "CASE WHEN mean > 0.30 THEN round(-least(greatest(0.12 + (least(mean, 1.0) - 0.30) * (0.25 - 0.12) / 0.70, 0.12), 0.25), 6) ELSE 0.0 END"},
    ]


def editing(d: Dialect) -> Layers:
    """SCO-07: five indicators of an editing tool."""
    raw5 = d.filter(d.split("text", "[.!?]"), "f_", f"{d.size(ws(d, 'f_'))} >= 5")
    head = d.at(ws(d, "f_"), "1")
    intro = d.filter("raw5", "f_", f"{clean(d, head)} IN ({d.words(L.INTRODUCTIONS)})")
    comma = f"({head} LIKE '%,' OR {d.at(ws(d, 'f_'), '2')} LIKE ',%' OR (contains(f_, ',') AND {d.bytes(f"substring(f_, 1, instr(f_, ',') - 1)")} < 20))"
    joined = "(' ' || " + d.join(d.map("s_", "w_", clean(d, "w_")), " ") + " || ' ')"
    passive = d.matches(joined, rf" (?:{'|'.join(L.PASSIVE_FORMS)}) [^ ]*(?:ed|en) ")
    paras = d.filter(d.map(d.split("text", "\n\n"), "p_", "lower(p_)"), "p_", f"{d.size(ws(d, 'p_'))} >= 10")
    starts = d.matches("p_", rf"^\s*(?:{'|'.join(L.PARAGRAPH_TRANSITIONS)})")
    return [
        *base(d),
        {"raw5": raw5, "paras": paras},
        {"intro": intro},
        {
            "commas": f"CASE WHEN {d.size('raw5')} >= 10 AND {d.size('intro')} >= 3 AND {d.size(d.filter('intro', 'f_', comma))} = {d.size('intro')} THEN 0.5 ELSE 0.0 END",
            "fragments": f"CASE WHEN {d.size('s1')} > 20 AND {d.size(d.filter('s1', 's_', f'{d.size('s_')} <= 3'))} * 1e0 / {d.size('s1')} < 0.02 THEN 0.4 ELSE 0.0 END",
            "transitions": f"CASE WHEN {d.size('paras')} < 4 THEN 0.0 ELSE {step(f'{d.size(d.filter('paras', 'p_', starts))} * 1e0 / {d.size('paras')}', ('> 0.60', 0.5), ('> 0.40', 0.2))} END",
            "passives": f"CASE WHEN {d.size('s5')} > 20 AND {d.size(d.filter('s5', 's_', passive))} * 1e0 / {d.size('s5')} < 0.02 THEN 0.4 ELSE 0.0 END",
            "lens": lengths(d, "s3"),
        },
        {"uniform": f"CASE WHEN {d.size('lens')} < 10 THEN 0.0 ELSE {step('(' + cv(d, 'lens') + ')', ('< 0.25', 0.5), ('< 0.30', 0.2))} END"},
        {"mean": "CASE WHEN nt < 200 THEN 0.0 ELSE (commas + fragments + transitions + passives + uniform) / 5.0 END"},
        {"edited": "mean > 0.30", "editing_confidence": "round(least(mean, 1.0), 6)", "editing_adjustment": "CASE WHEN mean > 0.30 THEN -0.15 ELSE 0.0 END"},
    ]


def humanizer(d: Dialect) -> Layers:
    """SCO-08: six weighted indicators of machine paraphrase, and the likely tool."""
    words = d.filter("cl", "w_", "w_ <> ''")
    paras = d.filter(d.map(d.split("text", "\n\n"), "p_", ws(d, "p_")), "p_", f"{d.size('p_')} >= 20")
    pairs = "(' ' || " + d.join("cw", " ") + " || ' ')"
    first = d.map("s3", "s_", d.at("s_", "1"))
    commas = d.map(d.filter(d.split("text", "[.!?]"), "f_", d.matches("f_", r"\S")), "f_", "CAST(length(f_) - length(replace(f_, ',', '')) AS DOUBLE)")
    found = " + ".join(f"CASE WHEN contains(pairs, {d.text(f' {c} ')}) THEN 1 ELSE 0 END" for c in L.COLLOCATIONS)
    return [
        *base(d),
        {"cw": words, "wl": d.map(paras, "p_", d.mean(d.map("p_", "w_", f"CAST({d.bytes('w_')} AS DOUBLE)"))), "lens": lengths(d, "s3"), "first": first, "commas": commas},
        {"pairs": pairs, "nc": d.size("cw"), "share": f"{d.size(d.filter('cw', 'w_', f'w_ IN ({d.words(L.HUMANIZER_WORDS)})'))} * 1e0 / nullif({d.size('cw')}, 0)", "spread": cv(d, "lens"), "level": cv(d, "wl"), "comma_cv": cv(d, "commas"), "variety": f"{d.size(d.distinct('first'))} * 1e0 / nullif({d.size('first')}, 0)"},
        {
            "synonyms": f"CASE WHEN n < 50 THEN 0.0 ELSE least({d.size(d.filter('cl', 'w_', f'w_ IN ({d.words(L.UNCOMMON)})'))} * 1e0 / n * 100.0 / 4.0, 1.0) END",
            "structure": f"CASE WHEN {d.size('s3')} < 5 THEN 0.0 ELSE ({step('spread', ('< 0.20', 0.8), ('< 0.30', 0.4), other=0.1)} + {step('variety', ('< 0.30', 0.7), ('< 0.50', 0.3), other=0.1)}) / 2 END",
            "readability": f"CASE WHEN {d.size('wl')} < 3 OR level <= 0.15 THEN 0.0 ELSE least(level * 3.0, 1.0) END",
            "function_words": "CASE WHEN nc < 100 THEN 0.0 WHEN share < 0.35 THEN least((0.35 - share) * 5.0, 1.0) WHEN share > 0.60 THEN least((share - 0.60) * 5.0, 1.0) ELSE 0.0 END",
            "collocations": f"CASE WHEN nc > 500 AND {found} = 0 THEN 0.3 ELSE 0.0 END",
            "punctuation": f"CASE WHEN {d.size('commas')} > 8 AND comma_cv < 0.3 THEN 0.5 ELSE 0.0 END",
        },
        {"overall": f"CASE WHEN {d.bytes('text')} < 200 THEN 0.0 ELSE synonyms * 0.20 + structure * 0.15 + readability * 0.15 + function_words * 0.20 + collocations * 0.15 + punctuation * 0.15 END"},
        {"humanized": "overall > 0.45", "humanizer_confidence": "round(least(overall, 1.0), 6)", "humanizer_adjustment": "CASE WHEN overall > 0.45 THEN 0.15 ELSE 0.0 END", "tool": "CASE WHEN overall > 0.45 THEN CASE WHEN synonyms > 0.7 AND structure < 0.3 THEN 'QuillBot' WHEN synonyms > 0.5 AND structure > 0.5 THEN 'Undetectable.ai' ELSE 'generic' END END"},
    ]


def template(d: Dialect) -> Layers:
    """SCO-06: which paragraphs are boilerplate, their share of the bytes, and the text without them."""
    trim = lambda x: d.replace(x, r"^\s+|\s+$")
    lines = d.split("p_", r"\r?\n")
    cited = d.size(d.filter(lines, "l_", f"{trim('l_')} LIKE '[%' OR ({d.bytes(trim('l_'))} > 2 AND {d.matches(trim('l_'), '^[0-9]')} AND contains(l_, '.'))"))
    legal, academic, corporate = (having("lower(p_)", x, d) for x in (L.LEGAL_PHRASES, L.ACADEMIC_PHRASES, L.CORPORATE_PHRASES))
    signature = f"{d.size(lines)} <= 8 AND {d.size(ws(d, 'p_'))} <= 50 AND ({having('lower(p_)', L.SIGNATURES, d)} > 0 OR p_ LIKE '--%' OR {d.matches('p_', '^___')})"
    kind = (
        f"CASE WHEN {legal} >= 2 THEN 'legal' WHEN {academic} >= 1 AND {d.bytes('p_')} < 200 THEN 'academic' WHEN {corporate} >= 1 THEN 'corporate' "
        f"WHEN {d.bytes('p_')} < 300 AND (contains(lower(p_), 'disclaimer') OR contains(lower(p_), 'notice:')) THEN 'disclaimer' "
        f"WHEN {cited} * 1e0 / {d.size(lines)} > 0.5 AND {d.size(lines)} >= 3 THEN 'citation' WHEN last_ AND {signature} THEN 'email' ELSE '' END"
    )
    kinds = lambda last: d.map("ps", "p_", kind.replace("last_", last))
    bytes_of = lambda a: d.total(d.map(a, "p_", f"CAST({d.bytes('p_')} AS DOUBLE)"))
    keep = lambda test: d.map(d.filter(d.upto("np"), "i_", test), "i_", d.at("ps", "i_"))
    k = f"(CASE WHEN i_ > np - 3 THEN {d.at('signed', 'i_')} ELSE {d.at('plain', 'i_')} END)"
    return [
        {"ps": d.filter(d.map(d.split("text", "\n\n"), "p_", trim("p_")), "p_", "p_ <> ''")},
        {"np": d.size("ps"), "signed": kinds("true"), "plain": kinds("false")},
        {"boiler": keep(f"{k} <> ''"), "rest": keep(f"{k} = ''"), "kinds": d.distinct(d.filter(d.map(d.upto("np"), "i_", k), "k_", "k_ <> ''"))},
        {"fraction": f"CASE WHEN np = 0 THEN 0.0 ELSE {bytes_of('boiler')} / {bytes_of('ps')} END", "types": d.join("sort_array(kinds)" if d.name == "spark" else "list_sort(kinds)", ","), "scorable": f"CASE WHEN np = 0 THEN text ELSE {d.join('rest', '\n\n')} END"},
        {"detected": "fraction > 0.10", "template_fraction": "round(fraction, 6)"},
    ]


def applied(docs: DataFrame, layers: Layers) -> DataFrame:
    rows = docs
    for layer in layers:
        rows = rows.select("*", *[F.expr(e).alias(k) for k, e in layer.items()])
    return rows


def sql(layers: Layers, source: str) -> str:
    """The layers as nested queries over a relation with doc_id and text."""
    for layer in layers:
        source = f"(SELECT *, {', '.join(f'{e} AS {k}' for k, e in layer.items())} FROM {source})"
    return source


def _rounded(*names: str) -> dict[str, str]:
    return {n: f"round(CAST({n} AS DOUBLE), 6)" for n in names}


#: Layers of each countermeasure, and the columns that it reports.
REPORTS = {
    "nnes": (nnes, {**_rounded("determiners", "openings", "contractions", "prepositions", "idiom", "nnes_confidence", "nnes_adjustment"), "nnes": "nnes"}),
    "editing": (editing, {**_rounded("commas", "fragments", "transitions", "passives", "uniform", "editing_confidence", "editing_adjustment"), "edited": "edited"}),
    "humanizer": (humanizer, {**_rounded("synonyms", "structure", "readability", "function_words", "collocations", "punctuation", "humanizer_confidence", "humanizer_adjustment"), "humanized": "humanized", "tool": "tool"}),
    "template": (template, {"detected": "detected", **_rounded("template_fraction"), "types": "types", "scorable_md5": "md5(scorable)"}),
}


def report(docs: DataFrame, name: str) -> DataFrame:
    """SCO-05, 07, 08, 06: a countermeasure's indicators, verdict and adjustment."""
    make, columns = REPORTS[name]
    rows = applied(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), make(SPARK))
    return rows.select("doc_id", *[F.expr(e).alias(k) for k, e in columns.items()])


def stripped(docs: DataFrame) -> DataFrame:
    """SCO-06: doc_id, detected, template_fraction, types and the scorable text."""
    rows = applied(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), template(SPARK))
    return rows.select("doc_id", "detected", "template_fraction", "types", "scorable")
