"""Personal data by patterns and a skip-chain conditional random field.

The base patterns find e-mail addresses, IP addresses, card and phone numbers, each with its check. The field then labels
every token with a digit or an @ by kind. Neighbouring tokens share a chain potential; tokens that are equal or similar (the same digits, or
the same letters and digits) share a skip potential, however far apart they stand in the document. Loopy message passing gives the tokens'
marginals, so a number that is written out in full once is also known where its plus sign or its
separators are missing. A number may run over several tokens; it is similar to a base span that ends in the same ``SUFFIX`` digits or more.
A token becomes a further span if its marginal reaches ``CONFIDENT`` and a similar token of the document lies in a base span, or if its
marginal reaches ``CONFIDENT_ALONE``, whatever the rest of the document holds; base spans always stay.

The potentials are trained piece by piece on a bounded sample of documents (``SAMPLE_DOCUMENTS`` of at most
``SAMPLE_BYTES`` each), labelled by the base patterns. Similar tokens are linked to one of them, the first in a base span if there is
one, so a document's graph is linear in its length and no mention is far from its support. Messages pass until each document's have settled. Null text counts as empty.
Repeated rows get equal answers, an empty table none. Long texts and long tokens are taken whole, in linear time. Columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.words import batches, tidy

KINDS = ("email", "ip", "card", "phone")
CONFIDENT, CONFIDENT_ALONE = 0.9, 0.98
#: Last digits by which two numbers are similar, and the log odds that these do not agree by chance.
SUFFIX = 7
SAME_NUMBER = SUFFIX * float(np.log(10))
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 800, 20_000
DIMENSIONS = 1 << 14
#: Messages have settled once none moves by more; a document whose messages never do is given up after so many rounds and so many more a node.
SETTLED = 1e-3
ROUNDS, ROUNDS_A_NODE = 200, 2

#: Fixed values of the contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

INTERESTING = re.compile(r"[0-9@]")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9.]*)?")
ADDRESS = re.compile(r"[A-Za-z0-9._%+@-]+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
NUMERIC = re.compile(r"[(+]*[0-9][0-9().+-]*[,;:.!?)]*\Z")
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(values)) % 10 == 0


def _emails(run: str, offset: int) -> Iterator[Span]:
    """Addresses in a run of address characters."""
    free, at = 0, run.find("@")  # where the next address may start
    while at >= 0:
        domain = DOMAIN.match(run, at + 1)
        if domain and LOCAL.fullmatch(run, free, at):
            yield 0, offset + free, offset + domain.end()
            free = domain.end()
            at = run.find("@", free)
        else:
            free = at + 1
            at = run.find("@", free)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the base patterns' matches that pass their checks, by kind, then place.

    An e-mail address starts where its run of local characters does, and an IP address with a group of digits, so both are found by
    cutting runs at their @ and dots: the same matches as the patterns', in time linear in the text.
    """
    out: list[Span] = []
    if not INTERESTING.search(text):
        return out
    if "@" in text:
        for run in ADDRESS.finditer(text):
            out += _emails(run.group(), run.start())
    for run in DOTTED.finditer(text):
        groups, at, i = run.group().split("."), run.start(), 0
        while i + 3 < len(groups):
            four = groups[i : i + 4]
            if all(four):
                size = sum(map(len, four)) + 3
                parts = [p.lstrip("0") for p in four]
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                    out.append((1, at, at + size))
                i, at = i + 4, at + size + 1
            else:
                i, at = i + 1, at + len(groups[i]) + 1
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


@dataclass
class Tokens:
    """The nodes of one document: places, feature ids, chain and skip links, kinds by base patterns (0: none), keys of
    similarity, and links between tokens of one number."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    kinds: list[int]
    keys: list[list[str]]
    number: list[tuple[int, int]]


def _shape(token: str) -> str:
    return re.sub(r"(.)\1+", r"\1*", re.sub(r"[0-9]", "d", re.sub(r"[^\W\d_]", "x", token[:60])))


def similar_key(token: str) -> str | None:
    """Tokens with the same key are similar: four digits or more, or an address."""
    digits = re.sub("[^0-9]", "", token)
    if "@" in token:
        return re.sub(r"[^a-z0-9@]", "", token.lower())
    return digits if len(digits) >= 4 else None


def tokens_of(text: str, base: list[Span]) -> Tokens:
    found = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    out = Tokens([], [], [], [], [], [], [])
    last = -2
    runs: list[tuple[int, list[int]]] = []  # (base span or -1, nodes) of adjacent numeric tokens
    ordered, at = sorted((s, e, k) for k, s, e in base), 0
    for i, (s, e) in enumerate(found):
        token = text[s:e]
        if not INTERESTING.search(token):
            continue
        node = len(out.spans)
        near = [text[slice(*found[j])] if 0 <= j < len(found) else "" for j in (i - 1, i + 1)]
        digits = sum(map(str.isdigit, token))
        names = [f"s{_shape(token)}", f"n{min(digits, 20)}", f"l{_shape(near[0])}", f"r{_shape(near[1])}", f"w{near[0].lower()[:20]}", f"a{'@' in token}", f"d{min(token.count('.'), 4)}"]
        out.features.append([xxhash.xxh32_intdigest(x) % DIMENSIONS for x in names])
        while at < len(ordered) and ordered[at][1] <= s:
            at += 1
        inside = next((j for j, (a, b, _) in enumerate(ordered[at : at + 4], at) if a < e and b > s), -1)
        out.kinds.append(ordered[inside][2] + 1 if inside >= 0 else 0)
        if NUMERIC.match(token):
            if last == i - 1 and runs and runs[-1][0] == inside and runs[-1][1][-1] == node - 1:
                runs[-1][1].append(node)
            else:
                runs.append((inside, [node]))
        out.spans.append((s, e))
        if last == i - 1:
            out.chain.append((node - 1, node))
        last = i
        key = similar_key(token)
        out.keys.append([] if key is None else [f"t{key}"])
    _number_keys(out, text, runs)
    _link(out)
    return out


def _number_keys(tokens: Tokens, text: str, runs: list[tuple[int, list[int]]]) -> None:
    """Give the tokens of numbers that share their last digits a common key."""
    digits = [re.sub("[^0-9]", "", text[s:e]) for s, e in tokens.spans]
    anchors: dict[str, str] = {}
    for inside, nodes in runs:
        number = "".join(digits[i] for i in nodes)
        if inside >= 0 and len(number) >= SUFFIX:
            key = number[-SUFFIX:]
            anchors[key] = max(anchors.get(key, ""), number, key=len)
            for i in nodes:
                tokens.keys[i].append(f"s{key}")
    for inside, nodes in runs:
        if inside >= 0:
            continue
        # a number may end at any token of the run
        tail, supported = "", False
        for at, node in enumerate(nodes):
            tail = (tail + digits[node])[-20:]
            key = tail[-SUFFIX:]
            if len(key) < SUFFIX or key not in anchors:
                continue
            supported, known = True, anchors[key]
            common = next((n for n, (a, b) in enumerate(zip(reversed(tail), reversed(known))) if a != b), min(len(tail), len(known)))
            while at >= 0 and common > 0:
                if f"s{key}" not in tokens.keys[nodes[at]]:
                    tokens.keys[nodes[at]].append(f"s{key}")
                common -= len(digits[nodes[at]])
                at -= 1
                if at >= 0 and len(digits[nodes[at]]) > common:
                    break
        number = "".join(digits[i] for i in nodes)
        if not supported and len(number) >= SUFFIX:
            key = f"r{number}"
            for i in nodes:
                tokens.keys[i].append(key)


def _link(tokens: Tokens) -> None:
    """Link the tokens of each key to the first of them in a base span, or else to the first of all."""
    groups: dict[str, list[int]] = {}
    for node, keys in enumerate(tokens.keys):
        for key in keys:
            groups.setdefault(key, []).append(node)
    for key, nodes in groups.items():
        hub = next((i for i in nodes if tokens.kinds[i]), nodes[0])
        links = tokens.number if key[0] == "s" else tokens.skip
        links += [(hub, i) for i in nodes if i != hub]


@dataclass
class Field:
    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _association(pairs: list[tuple[int, int]], labels: int) -> np.ndarray:
    """Log association of the two labels of a link, smoothed; equal labels are favoured a priori."""
    counts = np.full((labels, labels), 0.5) + 2.0 * np.eye(labels)
    for a, b in pairs:
        counts[a, b] += 1
    joint = counts / counts.sum()
    return np.clip(np.log(joint / np.outer(joint.sum(1), joint.sum(0))), -4, 4)


def train(texts: list[str], epochs: int = 30, seed: int = 3) -> Field:
    """Piecewise training: softmax node potentials by Adam, then link potentials from the links' labels."""
    labels = len(KINDS) + 1
    docs = [tokens_of(t, base_spans(t)) for t in texts]
    features = [f for d in docs for f in d.features]
    kinds = np.array([k for d in docs for k in d.kinds], np.int64)
    weights = np.zeros((DIMENSIONS, labels))
    if len(kinds):
        x, rng = np.array(features, np.int64), np.random.default_rng(seed)
        mean, square = np.zeros_like(weights), np.zeros_like(weights)
        for tick in range(1, epochs + 1):
            used = rng.random(x.shape) > 0.2  # dropout: no single feature may carry a label alone
            score = (weights[x] * used[:, :, None]).sum(1)
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(kinds)), kinds] -= 1
            g = np.zeros_like(weights)
            np.add.at(g, x.ravel(), (p[:, None, :] * used[:, :, None]).reshape(-1, labels) / len(kinds))
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            weights -= 0.1 * (mean / (1 - 0.9**tick)) / (np.sqrt(square / (1 - 0.99**tick)) + 1e-6)
    chain = _association([(d.kinds[a], d.kinds[b]) for d in docs for a, b in d.chain], labels)
    skip = _association([(d.kinds[a], d.kinds[b]) for d in docs for a, b in d.skip], labels)
    return Field(weights, chain, skip)


def marginals(field: Field, docs: list[Tokens]) -> np.ndarray:
    """Loopy sum-product over all nodes of a batch of documents at once; base labels are observed."""
    labels = field.weights.shape[1]
    sizes = np.array([len(d.spans) for d in docs], np.int64)
    start = np.cumsum(sizes) - sizes
    x = np.array([f for d in docs for f in d.features], np.int64)
    kinds = np.array([k for d in docs for k in d.kinds], np.int64)
    score = field.weights[x].sum(1)
    score = np.where((kinds > 0)[:, None], np.where(np.arange(labels)[None] == kinds[:, None], 0.0, -12.0), score - score.max(1, keepdims=True))
    node = np.exp(np.maximum(score, -12.0))
    links = [(start[i] + a, start[i] + b, 0) for i, d in enumerate(docs) for a, b in d.chain] + [(start[i] + a, start[i] + b, 1) for i, d in enumerate(docs) for a, b in d.skip]
    links += [(start[i] + a, start[i] + b, 2) for i, d in enumerate(docs) for a, b in d.number]
    belief = node / node.sum(1, keepdims=True)
    if not links:
        return belief
    ends = np.array(links, np.int64)
    source = np.r_[ends[:, 0], ends[:, 1]]
    target = np.r_[ends[:, 1], ends[:, 0]]
    both = np.exp(np.stack([field.chain, field.skip, SAME_NUMBER * np.eye(labels)]))
    potential = np.concatenate([both[ends[:, 2]], both[ends[:, 2]].transpose(0, 2, 1)])
    reverse = np.r_[np.arange(len(ends)) + len(ends), np.arange(len(ends))]
    message = np.full((len(source), labels), 1.0 / labels)
    owner = np.repeat(np.arange(len(docs)), sizes)[source]
    left = ROUNDS + ROUNDS_A_NODE * sizes
    base = np.log(node)
    live = np.arange(len(source))
    while len(live):
        total = base.copy()
        np.add.at(total, target, np.log(message))
        out = total[source[live]] - np.log(message[reverse[live]])
        out = np.exp(out - out.max(1, keepdims=True))
        fresh = np.einsum("el,elm->em", out, potential[live])
        fresh /= fresh.sum(1, keepdims=True)
        moved = np.zeros(len(docs))
        np.maximum.at(moved, owner[live], np.abs(fresh - message[live]).max(1))
        message[live] = 0.5 * message[live] + 0.5 * fresh
        left -= 1
        live = live[((moved > SETTLED) & (left > 0))[owner[live]]]
    total = np.log(node)
    np.add.at(total, target, np.log(message))
    belief = np.exp(total - total.max(1, keepdims=True))
    return belief / belief.sum(1, keepdims=True)


def further_spans(tokens: Tokens, belief: np.ndarray) -> list[Span]:
    """Tokens outside base spans: confident ones that are similar to a token inside one, and very confident ones."""
    known = {(key, k) for keys, k in zip(tokens.keys, tokens.kinds, strict=True) if k for key in keys}
    out = []
    for i, (s, e) in enumerate(tokens.spans):
        k = int(belief[i].argmax())
        if tokens.kinds[i] == 0 and k and (belief[i, k] >= CONFIDENT_ALONE or belief[i, k] >= CONFIDENT and any((key, k) in known for key in tokens.keys[i])):
            out.append((k - 1, s, e))
    return out


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def fit(docs: DataFrame) -> Field:
    """Train on a bounded sample, by a hash of ``doc_id``, of documents with digits or @."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]") & (F.octet_length("text") <= SAMPLE_BYTES))
    n = rows.count()
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62))
    near = rows.where(h < int((1 << 62) * min(1.0, 1.2 * SAMPLE_DOCUMENTS / max(n, 1)))).orderBy(h, "doc_id").limit(SAMPLE_DOCUMENTS)
    return train([r["text"] for r in near.collect()])


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, and all spans."""
    field = field or fit(docs)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_further"]

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches(it, 4 << 20):
            texts = [t or "" for t in rows.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            some = [i for i, t in enumerate(texts) if INTERESTING.search(t)]
            tokens = [tokens_of(texts[i], base[i]) for i in some]
            belief = marginals(field, tokens) if any(t.spans for t in tokens) else np.empty((0, len(KINDS) + 1))
            more: dict[int, list[Span]] = {}
            at = 0
            for i, t in zip(some, tokens, strict=True):
                more[i] = further_spans(t, belief[at : at + len(t.spans)])
                at += len(t.spans)
            columns = [rows.column("doc_id").combine_chunks()]
            columns += [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            columns.append(pa.array([hashlib.sha256(spelled(b).encode()).hexdigest() for b in base], pa.string()))
            columns.append(pa.array([spelled(b + more.get(i, [])) for i, b in enumerate(base)], pa.string()))
            columns.append(pa.array([len(more.get(i, ())) for i in range(len(base))], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_further long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(apply), schema)
