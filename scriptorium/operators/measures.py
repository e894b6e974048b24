"""Measurements of one text, in plain Python over its words, sentences and paragraphs; operators map them over Arrow batches."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from itertools import accumulate

import numpy as np

from scriptorium.functions import kernels as K
from scriptorium.functions import lexicons as L

TAGS = ("DET", "PRON", "PREP", "CONJ", "MODAL", "AUX", "PART", "ADV", "ADJ", "VERB", "NOUN", "NUM")
FUNCTION, HEDGES, INTENSIFIERS, MODALS, SPLICES, STOP, DISCOURSE, PERSON = map(frozenset, (L.FUNCTION_WORDS, L.HEDGES, L.INTENSIFIERS, L.MODALS, L.SPLICE_OPENERS, L.PARAGRAPH_STOP_WORDS, L.DISCOURSE_SINGLE, L.FIRST_PERSON))
_PASSIVE_B = ("was", "were", "is", "are", "been", "being"), re.compile(r" (?:was|were|is|are|been|being) [^ ]*(?:ed|en) ")
_PASSIVE_A = L.BE_FORMS, re.compile(rf" (?:{'|'.join(L.BE_FORMS)}) [^ ]*(?:ed|en|wn|nt) ")
_ENUMERATED = tuple(L.ENUMERATIONS), re.compile(", (?:" + "|".join(map(re.escape, L.ENUMERATIONS)) + ")")
_VOWELS = re.compile("[aeiouy]+")


def verb_forms() -> list[str]:
    """The tagger's verbs: bases with their regular forms, and irregular pasts."""

    def third(v: str) -> str:
        if v.endswith("y") and v[-2] not in "aeiou":
            return v[:-1] + "ies"
        return v + ("es" if v.endswith(("ch", "ss", "sh", "go", "do")) else "s")

    def past(v: str) -> str:
        if v.endswith("y") and v[-2] not in "aeiou":
            return v[:-1] + "ied"
        return {"stop": "stopped"}.get(v, v + ("d" if v.endswith("e") else "ed"))

    out = [f for v in L.POS_REGULAR_VERBS for f in (v, past(v), third(v))]
    for forms in L.POS_IRREGULAR_VERBS.split(","):
        base, *rest = forms.split()
        out += [base, *rest, third(base)]
    return out + L.POS_OTHER_VERB_FORMS


_TAGGED: dict[str, int] = {}
for _i, _words in enumerate((L.POS_DETERMINERS, L.POS_PRONOUNS, L.POS_PREPOSITIONS, L.POS_CONJUNCTIONS, L.MODALS, L.POS_AUXILIARIES, L.POS_PARTICLES, L.POS_ADVERBS, L.POS_ADJECTIVES, verb_forms(), L.POS_NOUNS)):
    for _w in _words:
        _TAGGED.setdefault(_w, _i)
_SUFFIXES = [(tuple(endings), longer, TAGS.index(tag)) for tag, endings, longer in L.POS_SUFFIXES]


@lru_cache(1 << 16)
def tag(w: str) -> int:
    """TOK-12: number in TAGS."""
    if (known := _TAGGED.get(w)) is not None:
        return known
    if not w.strip("0123456789.,"):
        return TAGS.index("NUM")
    return next((t for endings, longer, t in _SUFFIXES if w.endswith(endings) and (not longer or K.size(w) > longer)), TAGS.index("NOUN"))


@lru_cache(1 << 16)
def syllables(w: str) -> int:
    """TOK-13."""
    if K.size(w) <= 3:
        return 1
    groups = len(_VOWELS.findall(w))
    return max(groups - (w.endswith("e") and groups > 1), 1)


def passives(parts: list[str], forms: list[str], pattern: re.Pattern[str]) -> list[bool]:
    """Which sentences hold a form of be before a participle."""
    forms = [f" {x} " for x in forms]
    return [any(x in s for x in forms) and pattern.search(s) is not None for s in K.plain(parts)]


def entropy(counts: list[int]) -> float:
    """Of counts, in bits."""
    n = sum(counts)
    return -K.total([c / n * math.log2(c / n) for c in counts])


def of(counts: Counter[str], listed: frozenset[str]) -> int:
    """How many words are listed."""
    return sum(map(counts.__getitem__, counts.keys() & listed))


@lru_cache(1)
def _logs() -> tuple[list[float], list[float], list[float]]:
    """ln 1, ln 2, ..., and the sums of the first k of them and of their squares."""
    logs = [math.log(k) for k in range(1, 1 << 16)]
    return logs, [0.0, *accumulate(logs)], [0.0, *accumulate(x * x for x in logs)]


def zipf(freqs: list[int]) -> float | None:
    v = len(freqs)
    logs, sums, squares = _logs()
    if v > len(logs):
        logs = [math.log(k) for k in range(1, v + 1)]
        sx, sxx = K.total(logs), K.total([x * x for x in logs])
    else:
        sx, sxx = sums[v], squares[v]
    ly = [math.log(c) for c in freqs]
    sy, sxy = K.total(ly), K.total([x * y for x, y in zip(logs, ly)])
    below = v * sxx - sx * sx
    return None if below == 0 else abs((v * sxy - sx * sy) / below + 1)


def burstiness(big: list[str]) -> float:
    """Mean over repeated words of their counts' spread over windows of 100 words."""
    wins = len(big) // 100
    counts = Counter(big)
    tracked = sorted(w for w, c in counts.items() if c >= 3 and w not in FUNCTION)
    if not tracked:
        return 0.0
    chosen = set(tracked)
    per = Counter((w, i // 100) for i, w in enumerate(big[: wins * 100]) if w in chosen)
    sums: dict[str, list[int]] = {w: [0, 0] for w in tracked}
    for (w, _), c in per.items():
        s = sums[w]
        s[0] += c
        s[1] += c * c
    values = []
    for w in tracked:
        s, q = sums[w]
        mu, v = s / wins, (q - float(s) * s / wins) / (wins - 1)
        values.append(0.0 if v + mu == 0 else (v - mu) / (v + mu))
    return K.total(values) / len(values)


def half_away(x: float, digits: int) -> float:
    """Rounded as the checking SQL rounds."""
    y = x * 10.0**digits
    whole = math.trunc(y)
    return (whole + math.copysign(abs(y - whole) >= 0.5, y)) / 10.0**digits


def diversity_length(toks: list[str], lens: list[int]) -> float:
    """DET-06: correlation over windows of 200 tokens of the type-token ratio and the mean length of the sentences in proportion."""
    n, size, k = len(toks), len(lens), len(toks) // 200
    if k < 3 or size < k:
        return 0.0
    ttrs = [len(set(toks[w * 200 : w * 200 + 200])) / 200 for w in range(k)]
    edges = [math.floor(w * 200 / n * size) for w in range(k + 1)]
    means = []
    for a, b in zip(edges, edges[1:]):
        some = lens[a : min(b, size)]
        means.append(sum(some) / len(some) if some else 0.0)
    mx, my = K.total(ttrs) / k, K.total(means) / k
    co = K.total([(p - mx) * (q - my) for p, q in zip(ttrs, means)]) / k
    sd = math.sqrt(K.total([(p - mx) * (p - mx) for p in ttrs]) / k) * math.sqrt(K.total([(q - my) * (q - my) for q in means]) / k)
    return half_away(0.0 if sd < 1e-12 else co / sd, 4)


def diversity_of(text: str) -> list[tuple]:
    """DET-06, 400 words at least."""
    toks = K.tokens(text)
    if len(toks) < 400:
        return []
    split = K.splitter(text)
    return [(diversity_length(toks, [len(split(s)) for s in K.sentences(text)]),)]


FEATURES = (
    "burstiness", "zipf_deviation", "hedge_ratio", "autocorrelation", "pos_entropy", "diversity_length", "repetition_delta", "passive_clustering", "transition_density", "paragraph_cv",
    "opening_diversity", "nested_clauses", "comma_splices", "sophistication_slope", "register_consistency", "initial_adverbs", "modal_density", "punctuation_entropy", "enumeration", "paragraph_overlap",
)


def features(text: str, delimiter: str = "\n\n") -> tuple[float | None, ...]:
    """DET-28: FEATURES of a text, none where it is too short for one."""
    f: dict[str, float | None] = dict.fromkeys(FEATURES)
    low, split = K.lower(text), K.splitter(text)
    toks = K.cased_tokens(low)
    n, counts = len(toks), Counter(toks)
    of_word = {w: K.size(w) for w in counts}
    sizes = list(map(len, toks)) if low.isascii() else [of_word[w] for w in toks]
    big = [w for w, s in zip(toks, sizes) if s > 1]
    if len(big) >= 200:
        f["burstiness"] = burstiness(big)
    freqs = sorted((c for w, c in counts.items() if K.has_letter(w)), reverse=True)
    if len(freqs) >= 50:
        f["zipf_deviation"] = zipf(freqs)
    hedges, strong = of(counts, HEDGES), of(counts, INTENSIFIERS)
    f["hedge_ratio"] = hedges / strong if strong else 2.0 * hedges if hedges else None
    lens = [len(split(s)) for s in K.sentences(text)]
    if (m := len(lens)) >= 5:
        mean = K.total(lens) / m
        dev = [x - mean for x in lens]
        spread = K.total([x * x for x in dev])
        f["autocorrelation"] = 0.0 if spread < 1e-9 else K.total([x * y for x, y in zip(dev, dev[1:])]) / spread
    if n >= 20:
        t = list(map(tag, toks))
        tri = Counter([144 * a + 12 * b + c for a, b, c in zip(t, t[1:], t[2:])])
        f["pos_entropy"] = entropy([tri[k] for k in sorted(tri)])
    if n >= 400:
        f["diversity_length"] = diversity_length(toks, lens)
        content = [w for w, s in zip(toks, sizes) if s > 2 and w not in FUNCTION]
        a, b = content[: len(content) // 2], content[len(content) // 2 :]
        f["repetition_delta"] = 0.0 if len(content) < 20 else abs((1 - len(set(a)) / len(a)) - (1 - len(set(b)) / len(b)))
    if n >= 200:
        q = n // 4
        f["transition_density"] = sum(low.count(p) for p in L.TRANSITIONS) * 1000.0 / n
        f["sophistication_slope"] = (float(sum(sizes[3 * q : 4 * q])) - sum(sizes[:q])) / q / 3
        f["modal_density"] = 1000.0 * of(counts, MODALS) / n
        marks = [c for c in map(text.count, L.PUNCTUATION_DIVERSITY) if c]
        f["punctuation_entropy"] = entropy(marks) if marks else 0.0
    sb = K.sentences(text, K.SENTENCES_B)
    if (m := len(sb)) >= 10:
        opens = [K.letters(K.lower(split(s)[0])) for s in sb]
        lows = [K.lower(s) for s in sb]
        f["opening_diversity"] = len(set(opens)) / m
        f["nested_clauses"] = sum(s.count(",") >= 2 for s in sb) / m
        first = [w for w in (split(p) for p in text.split(",")) if len(w) >= 3]
        f["comma_splices"] = max(sum(K.letters(K.lower(w[0])) in SPLICES for w in first) - 1, 0) / m
        f["initial_adverbs"] = sum(w.endswith("ly") and K.size(w) > 3 for w in opens) / m
        f["enumeration"] = sum(s.startswith(_ENUMERATED[0]) or _ENUMERATED[1].search(s) is not None for s in lows) / m
    if m >= 20:
        hits, quarter = list(map(float, passives(sb, *_PASSIVE_B))), m // 4
        f["passive_clustering"] = K.sample_variance([K.total(hits[i : i + quarter]) / len(hits[i : i + quarter]) for i in range(0, m, quarter)])
    paras = K.paragraphs(text, delimiter)
    if len(paras) >= 3:
        words = [list(map(K.size, split(p))) for p in paras]
        levels = [0.6 * sum(b) / len(b) + 4.0 * sum(x > 8 for x in b) / len(b) for b in words if len(b) >= 10]
        f["register_consistency"] = 0.0 if len(levels) < 3 else K.sample_variance(levels)
        sets = [{w for w in K.tokens(p) if w not in STOP and K.size(w) > 2} for p in paras]
        overlaps = [len(a & b) / len(a | b) for a, b in zip(sets, sets[1:]) if a and b]
        f["paragraph_overlap"] = K.total(overlaps) / len(overlaps) if overlaps else 0.0
        if len(paras) >= 4:
            each = [float(len(b)) for b in words]
            f["paragraph_cv"] = math.sqrt(K.sample_variance(each)) / (K.total(each) / len(each))
    return tuple(f.values())


#: What the register reads of a text, and what a comparison with a profile reads beyond.
REGISTER = ("n", "avg_words", "passive", "question_ratio", "contraction_ratio", "first_person", "hedge_ratio", "discourse_ratio", "avg_word_length", "grade", "ttr", "paragraph_cv")
COMPARED = ("yule_k", "hapax_ratio", "sentence_variance", "comma_rate", "semicolon_rate", "exclamation_rate", "question_rate", "intensifier_ratio", "function_word_ratio", "words")


def register(text: str, compared: bool = False) -> tuple[float, ...]:
    """REG-01: REGISTER of a text, and COMPARED if asked."""
    split = K.splitter(text)
    toks, sents = K.tokens(text), K.sentences(text)
    counts = Counter(toks)
    n, m, stops = max(len(toks), 1), max(len(sents), 1), max(text.count(".") + text.count("!") + text.count("?"), 1)
    joined = " ".join(toks)
    size = {w: K.size(w) for w in counts}
    lens = [len(split(s)) for s in sents]
    paras = [float(K.size(p)) for p in K.paragraphs(text)]
    level = K.total(paras) / len(paras) if paras else 0.0
    bytes_, beats = sum(c * size[w] for w, c in counts.items()), sum(c * syllables(w) for w, c in counts.items())
    out = (
        n,
        float(sum(lens)) / m,
        sum(passives(sents, *_PASSIVE_A)) / m,
        sum(s.endswith("?") for s in sents) / m,
        sum(c for w, c in counts.items() if w == "cannot" or ("'" in w and size[w] > 2)) / n,
        of(counts, PERSON) * 1e3 / n,
        of(counts, HEDGES) / n,
        (of(counts, DISCOURSE) + sum(joined.count(p) for p in L.DISCOURSE_MULTI)) / n,
        float(bytes_) / n,
        0.39 * (n / stops) + 11.8 * (float(beats) / n) - 15.59,
        len(counts) / n,
        math.sqrt(K.sample_variance(paras)) / level if len(paras) > 1 and level > 0 else 0.0,
    )
    if not compared:
        return out
    rate = lambda mark: text.count(mark) / max(K.size(text), 1)
    return out + (
        max(1e4 * (float(sum(c * c for c in counts.values())) - n) / (n * 1.0 * n), 0.0),
        sum(c == 1 for c in counts.values()) / n,
        K.sample_variance([float(x) for x in lens]) if len(lens) > 1 else 0.0,
        rate(","), rate(";"), rate("!"), rate("?"),
        of(counts, INTENSIFIERS) / n,
        of(counts, FUNCTION) / n,
        len(split(text)),
    )


def chosen(text: str, least: int) -> str:
    """SCO-06: the text without its boilerplate paragraphs, if these are over a tenth of it and ``least`` words remain."""
    ps = K.paragraphs(text)
    rest, boiler = [], 0
    for i, p in enumerate(ps):
        if _boilerplate(p, i >= len(ps) - 3):
            boiler += K.size(p)
        else:
            rest.append(p)
    if not boiler or not float(boiler) / sum(map(K.size, ps)) > 0.10:
        return text
    scorable = "\n\n".join(rest)
    return scorable if len(K.splitter(scorable)(scorable)) >= least else text


def _having(low: str, phrases: list[str]) -> int:
    return sum(p in low for p in phrases)


def _boilerplate(p: str, last: bool) -> bool:
    low, size = K.lower(p), K.size(p)
    if _having(low, L.LEGAL_PHRASES) >= 2 or (size < 200 and _having(low, L.ACADEMIC_PHRASES)) or _having(low, L.CORPORATE_PHRASES) or (size < 300 and ("disclaimer" in low or "notice:" in low)):
        return True
    lines = _LINES.split(p)
    if len(lines) >= 3:
        trimmed = [line.strip(K.SPACE) for line in lines]
        if sum(t.startswith("[") or (K.size(t) > 2 and t[0] in "0123456789" and "." in line) for t, line in zip(trimmed, lines)) / len(lines) > 0.5:
            return True
    return last and len(lines) <= 8 and (p.startswith(("--", "___")) or _having(low, L.SIGNATURES) > 0) and len(K.splitter(p)(p)) <= 50


_LINES, _STOPS = re.compile(r"\r?\n"), re.compile("[.!?]")
SHORT_PREPOSITIONS, ARTICLES, SIMPLE, PERSONAL, PREPOSITIONS, INTRODUCTIONS, UNCOMMON, HUMANIZER = map(frozenset, (L.SHORT_PREPOSITIONS, L.ARTICLES, L.SIMPLE_OPENERS, L.PERSONAL, L.PREPOSITIONS, L.INTRODUCTIONS, L.UNCOMMON, L.HUMANIZER_WORDS))
_PASSIVE_C = L.PASSIVE_FORMS, re.compile(rf" (?:{'|'.join(L.PASSIVE_FORMS)}) [^ ]*(?:ed|en) ")
_TRANSITION = re.compile(rf"[{K.SPACE}]*(?:{'|'.join(L.PARAGRAPH_TRANSITIONS)})")
_UPPER = re.compile(f"[{K.UPPER}]")


def _cv(values: list[float]) -> float:
    n = len(values)
    mean = K.total(values) / n if n else 0.0
    return math.sqrt(K.total([(x - mean) * (x - mean) for x in values]) / n) / mean if mean > 0 else 0.0


def _under(x: float, *bounds: tuple[float, int], other: int = 0) -> int:
    """Tenths of the first bound that x is under."""
    return next((v for b, v in bounds if x < b), other)


def _over(x: float, *bounds: tuple[float, int]) -> int:
    return next((v for b, v in bounds if x > b), 0)


def adjustments(text: str) -> tuple[float, float, float]:
    """SCO-05, 07, 08: what second-language writing, editing tools and humanizers adjust a score by. Sums of tenths are whole numbers."""
    split, low = K.splitter(text), K.lower(text)
    ws, counts = split(text), Counter(K.cased_tokens(low))
    n, nt = len(ws), counts.total()
    raw = _STOPS.split(text)
    fr = [split(f) for f in raw]
    cleaned = {w: K.letters(K.lower(w)) for w in {*ws, *(w for f in fr for w in f)}}
    cl = [cleaned[w] for w in ws]
    s1, s3, s5 = ([f for f in fr if len(f) >= k] for k in (1, 3, 5))
    lens = [float(len(f)) for f in s3]
    return _nnes(text, low, ws, cl, counts, [cleaned[f[0]] for f in s3]), _editing(text, split, raw, fr, cleaned, s1, s5, lens, nt), _humanizer(text, split, raw, cl, [f[0] for f in s3], lens, n)


def _nnes(text: str, low: str, ws: list[str], cl: list[str], counts: Counter[str], op: list[str]) -> float:
    n, nt = len(ws), counts.total()
    if nt < 100:
        return 0.0
    determiners = openings = contractions = prepositions = idiom = 0.0
    if n >= 50:
        wrong = 0
        for here, after, word in zip(cl, cl[1:], ws[1:]):
            if here == "a":
                wrong += 2 * (after[:1] in _VOWEL and K.size(after) > 1)
            elif here == "an":
                wrong += 2 * (after[:1] not in _VOWEL and after[:1] != "h" and K.size(after) > 1)
            if here in SHORT_PREPOSITIONS and _UPPER.match(word) and after not in ARTICLES and K.size(after) > 4:
                wrong += 1
        determiners = min(wrong * 1.0 / n * 100.0 * 5.0, 1.0)
    if len(op) >= 8:
        openings = (_under(len(set(op)) / len(op), (0.30, 7), (0.45, 3)) + _over(sum(w in SIMPLE for w in op) / len(op), (0.70, 6), (0.55, 3))) / 20
    expanded, contracted = _having(low, L.EXPANDABLE), sum(map(text.count, L.CONTRACTED))
    if of(counts, PERSONAL) / nt >= 0.03 and expanded + contracted:
        contractions = _over(expanded / (expanded + contracted), (0.70, 6), (0.50, 3)) / 10
    preps = of(counts, PREPOSITIONS) / nt
    if preps < 0.07 or preps > 0.20:
        prepositions = min(abs(preps - 0.125) * 8.0, 0.6)
    if n >= 200:
        idiom = _under(_having(low, L.IDIOMS) / (n / 500.0), (0.5, 5), (1.0, 2)) / 10
    mean = (determiners + openings + contractions + prepositions + idiom) / 5.0
    return half_away(-min(max(0.12 + (min(mean, 1.0) - 0.30) * 0.13 / 0.70, 0.12), 0.25), 6) if mean > 0.30 else 0.0


_VOWEL = frozenset("aeiou")


def _editing(text: str, split, raw: list[str], fr: list[list[str]], cleaned: dict[str, str], s1: list[list[str]], s5: list[list[str]], lens: list[float], nt: int) -> float:
    if nt < 200:
        return 0.0
    tenths = 0
    raw5 = [(f, w) for f, w in zip(raw, fr) if len(w) >= 5]
    intro = [(f, w) for f, w in raw5 if cleaned[w[0]] in INTRODUCTIONS]
    if len(raw5) >= 10 and len(intro) >= 3 and all(w[0].endswith(",") or w[1].startswith(",") or ("," in f and K.size(f[: f.index(",")]) < 20) for f, w in intro):
        tenths += 5
    if len(s1) > 20 and sum(len(f) <= 3 for f in s1) / len(s1) < 0.02:
        tenths += 4
    paras = [K.lower(p) for p in text.split("\n\n") if len(split(p)) >= 10]
    if len(paras) >= 4:
        tenths += _over(sum(_TRANSITION.match(p) is not None for p in paras) / len(paras), (0.60, 5), (0.40, 2))
    if len(s5) > 20:
        forms = [f" {x} " for x in _PASSIVE_C[0]]
        joined = [f" {' '.join([cleaned[w] for w in f])} " for f in s5]
        if sum(any(x in s for x in forms) and _PASSIVE_C[1].search(s) is not None for s in joined) / len(s5) < 0.02:
            tenths += 4
    if len(lens) >= 10:
        tenths += _under(_cv(lens), (0.25, 5), (0.30, 2))
    return -0.15 if tenths > 15 else 0.0


def _humanizer(text: str, split, raw: list[str], cl: list[str], first: list[str], lens: list[float], n: int) -> float:
    if K.size(text) < 200:
        return 0.0
    cw = [w for w in cl if w]
    nc = len(cw)
    overall = 0.20 * (min(sum(w in UNCOMMON for w in cl) * 1.0 / n * 100.0 / 4.0, 1.0) if n >= 50 else 0.0)
    if len(lens) >= 5:
        overall += round((_under(_cv(lens), (0.20, 8), (0.30, 4), other=1) + _under(len(set(first)) / len(first), (0.30, 7), (0.50, 3), other=1)) / 20 * 0.15, 6)
    wl = [K.total(map(K.size, p)) / len(p) for p in map(split, text.split("\n\n")) if len(p) >= 20]
    if len(wl) >= 3 and (level := _cv(wl)) > 0.15:
        overall += min(level * 3.0, 1.0) * 0.15
    if nc >= 100:
        share = sum(w in HUMANIZER for w in cw) / nc
        overall += (min((0.35 - share) * 5.0, 1.0) if share < 0.35 else min((share - 0.60) * 5.0, 1.0) if share > 0.60 else 0.0) * 0.20
    if nc > 500:
        pairs = f" {' '.join(cw)} "
        overall += 0.0 if any(f" {c} " in pairs for c in L.COLLOCATIONS) else 0.045
    commas = [float(f.count(",")) for f in raw if f.strip(K.SPACE)]
    if len(commas) > 8 and _cv(commas) < 0.3:
        overall += 0.075
    return 0.15 if overall > 0.45 else 0.0


def windows(words: list[str], size: int, step: int) -> list[tuple[int, str]]:
    """(number, text) of every window of joined words; one for a shorter text."""
    return [(i, " ".join(words[i * step : i * step + size])) for i in range(max((len(words) - size) // step, 0) + 1)] if words else []


_INDEX = {w: i for i, w in enumerate(L.FUNCTION_WORDS)}


def function_words(text: str) -> list[tuple[list[float]]]:
    """Relative frequency of every function word; none for a text without words."""
    toks = K.tokens(text)
    if not toks:
        return []
    v = np.zeros(len(L.FUNCTION_WORDS))
    for w, c in Counter(toks).items():
        if (i := _INDEX.get(w)) is not None:
            v[i] = c
    return [((v / len(toks)).tolist(),)]


def top_ngrams(text: str, kind: str, keep: int) -> list[tuple[str, int, float]]:
    """NGR-01: (gram, rank, share) of the most frequent n-grams; ties by gram."""
    low = K.lower(text)
    if kind == "wb":
        words = K.splitter(low)(low)
        counts = Counter(map(" ".join, zip(words, words[1:])))
    else:
        n = int(kind[1:])
        counts = Counter(map("".join, zip(*(low[i:] for i in range(n)))))
    every = counts.total()
    share = {c: half_away(c / every, 6) for c in set(counts.values())}
    if len(counts) > keep:
        least = sorted(counts.values())[-keep]
        counts = {gram: c for gram, c in counts.items() if c >= least}
    best = sorted(counts.items())
    best.sort(key=lambda e: -e[1])
    return [(gram, i + 1, share[c]) for i, (gram, c) in enumerate(best[:keep])]
