"""Language ID by a linear-chain conditional random field over words.

Each word of a text is labelled with a language. A word's emission scores come from hashed features: the word itself,
its affixes, its character n-grams and its place in the languages' lexicons of frequent words. A learned transition
matrix ties neighbours, and forward-backward gives every word's posterior, so
code-switched text gets its languages word by word. A document's language is the one with most posterior mass.

Training words come from a bounded, documented sample of labelled rows (``Sample``, of the ``MAX_LANGUAGES`` most frequent labels); sequences that join
pieces of documents in different languages teach the transitions. Prediction runs over whole texts.

Null or letterless text gets ``und`` with score 0, as does everything when no row is labelled. Ties go to the
language that sorts first. Repeated rows get equal answers, an empty table none; a long text is taken whole, in memory linear in its
length. Columns other than those named are not read, so further ones may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.words import batches, tidy

UNDETERMINED = "und"
#: A word: a run of word characters but digits and underscores.
LETTERS = re.compile(r"[^\W\d_]+")
#: Hashed feature space.
DIMENSIONS = 1 << 16
#: Words in a step of the two-level forward-backward.
STRIDE = 32
CACHE_WORDS = 120_000
#: Languages that a model can tell apart: the most frequent ones of the labelled rows.
MAX_LANGUAGES = 200


@dataclass(frozen=True)
class Sample:
    """Bound of the training sample: documents in all, per language, and bytes of a document."""

    documents: int = 1600
    per_language: int = 300
    document_bytes: int = 20_000
    seed: int = 5


class GramIds(dict):
    """Short feature -> its hash, remembered up to a bound: words are many, their n-grams few."""

    LIMIT = 200_000

    def __missing__(self, gram: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[gram] = xxhash.xxh32_intdigest(gram) & (DIMENSIONS - 1)
        return value


GRAMS = GramIds()


def feature_ids(word: str) -> list[int]:
    """Hashed features of one lower-cased word: identity, affixes and inner n-grams."""
    marked = f"^{word[:40]}$"
    n = len(marked)
    names = ["p" + word[:1], "p" + word[:2], "p" + word[:3], "s" + word[-1:], "s" + word[-2:], "s" + word[-3:]]
    names += [marked[i : i + 2] for i in range(n - 1)]
    names += [marked[i : i + 3] for i in range(n - 2)]
    return [xxhash.xxh32_intdigest("w" + word) & (DIMENSIONS - 1), *map(GRAMS.__getitem__, names)]


@dataclass
class Model:
    """languages, feature weights (DIMENSIONS x L), transition scores (L x L), lexicon weights and lexicons."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon_weight: np.ndarray
    lexicons: dict[str, int]

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each distinct word for each language."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        ids = [feature_ids(w) for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))
        if len(words):
            out += np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None]
            member = np.fromiter((self.lexicons.get(w, 0) for w in words), np.int64, len(words))
            out += ((member[:, None] >> np.arange(len(self.languages))) & 1) * self.lexicon_weight
        return out


def _posteriors(psi: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Exact posteriors of all words of a batch of documents.

    psi: emission potentials of the documents' words one after another; step: transition potentials.
    Documents are cut into strides. Every stride's transfer matrix is built at once, messages pass from stride to
    stride, and then run inside all strides at once; so even one very long document is vectorised.
    """
    labels = psi.shape[1]
    per = -(-lengths // STRIDE)
    doc_of = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(doc_of)) - np.repeat(np.cumsum(per) - per, per)
    first_word = np.repeat(np.cumsum(lengths) - lengths, per) + nth * STRIDE
    size = np.minimum(STRIDE, np.repeat(lengths, per) - nth * STRIDE)
    order = np.argsort(-size, kind="stable")  # full strides first: step t works on a leading slice
    first, size = first_word[order], size[order]
    live = [int(np.searchsorted(-size, -t, "left")) for t in range(STRIDE)]
    count = len(order)

    transfer = np.repeat(np.eye(labels, dtype=psi.dtype)[None], count, 0)
    for t in range(STRIDE):
        k = live[t]
        if not k:
            break
        moved = (transfer[:k].reshape(-1, labels) @ step).reshape(k, labels, labels) * psi[first[:k] + t][:, None, :]
        transfer[:k] = moved / moved.sum((1, 2), keepdims=True)

    slot = np.empty(count, np.int64)
    slot[order] = np.arange(count)
    start = np.full((count, labels), 1.0 / labels, psi.dtype)
    finish = np.ones((count, labels), psi.dtype)
    begin = np.cumsum(per) - per
    by_size = np.argsort(-per, kind="stable")
    ranked = per[by_size]
    for j in range(1, int(ranked[0]) if len(ranked) else 0):
        docs = by_size[: int(np.searchsorted(-ranked, -j, "left"))]
        here, back = slot[begin[docs] + j], slot[begin[docs] + j - 1]
        message = np.einsum("ki,kij->kj", start[back], transfer[back])
        start[here] = message / message.sum(1, keepdims=True)
        end = begin[docs] + per[docs] - 1 - j
        here, ahead = slot[end], slot[end + 1]
        message = np.einsum("kij,kj->ki", transfer[ahead], finish[ahead])
        finish[here] = message / message.sum(1, keepdims=True)

    out = np.empty_like(psi)
    forward = start
    for t in range(STRIDE):
        k = live[t]
        if not k:
            break
        message = (forward[:k] @ step) * psi[first[:k] + t]
        forward[:k] = message / message.sum(1, keepdims=True)
        out[first[:k] + t] = forward[:k]
    backward = finish
    for t in range(STRIDE - 1, -1, -1):
        k = live[t]
        if not k:
            continue
        at = first[:k] + t
        both = out[at] * backward[:k]
        out[at] = both / both.sum(1, keepdims=True)
        message = (psi[at] * backward[:k]) @ step.T
        backward[:k] = message / message.sum(1, keepdims=True)
    return out


def train(rows: list[tuple[str, str]], epochs: int = 4, batch: int = 192, seed: int = 5) -> Model:
    """Fit the field to (text, language) rows by Adam on the exact likelihood of short sequences."""
    languages = sorted({lang for _, lang in rows})
    labels, rng = len(languages), np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    pieces: list[tuple[np.ndarray, int]] = []
    counts = [dict[str, int]() for _ in languages]
    for text, lang in rows:
        words = LETTERS.findall(text.lower())
        label = languages.index(lang)
        for w in words:
            counts[label][w] = counts[label].get(w, 0) + 1
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64)
        pieces += [(ids[i : i + 12], label) for i in range(0, len(ids), 12)]
    lexicons: dict[str, int] = {}
    for label, count in enumerate(counts):
        for w in sorted(count, key=lambda w: (-count[w], w))[:150]:
            lexicons[w] = lexicons.get(w, 0) | 1 << label
    words = list(vocabulary)
    ids = [feature_ids(w) for w in words]
    sizes = np.array([len(x) for x in ids], np.int64)
    flat, offsets = np.array([i for x in ids for i in x], np.int64), np.cumsum(sizes) - sizes
    member = ((np.array([lexicons.get(w, 0) for w in words], np.int64)[:, None] >> np.arange(labels)) & 1).astype(np.float64)
    theta = [np.zeros((DIMENSIONS, labels)), np.eye(labels), np.zeros(labels)]
    mean, square, tick = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta], 0
    for _ in range(epochs if labels > 1 else 0):
        shuffled = rng.permutation(len(pieces))
        for at in range(0, len(shuffled) - 1, 2 * batch):
            chosen = [pieces[i] for i in shuffled[at : at + 2 * batch]]
            # two random pieces make a sequence: often a switch of language, as in code-switched text
            pairs = [(*chosen[i], *chosen[i + 1]) for i in range(0, len(chosen) - 1, 2)]
            seq = np.concatenate([x for a, _, b, _ in pairs for x in (a, b)])
            gold = np.concatenate([np.full(len(x), y) for a, la, b, lb in pairs for x, y in ((a, la), (b, lb))])
            lengths = np.array([len(a) + len(b) for a, _, b, _ in pairs], np.int64)
            types, inverse = np.unique(seq, return_inverse=True)
            spans = np.concatenate([np.arange(offsets[w], offsets[w] + sizes[w]) for w in types])
            rows_of = np.repeat(np.arange(len(types)), sizes[types])
            scale = 1 / np.sqrt(sizes[types])
            score = np.add.reduceat(theta[0][flat[spans]], np.cumsum(sizes[types]) - sizes[types], axis=0) * scale[:, None] + member[types] * theta[2]
            psi = np.exp(score - score.max(1, keepdims=True))[inverse]
            step = np.exp(theta[1] - theta[1].max())
            post = _posteriors(psi, lengths, step)
            error = post.copy()
            error[np.arange(len(seq)), gold] -= 1
            per_type = np.stack([np.bincount(inverse, error[:, y], len(types)) for y in range(labels)], 1)
            grad_w = np.zeros_like(theta[0])
            np.add.at(grad_w, flat[spans], (per_type * scale[:, None])[rows_of])
            grad_l = (per_type * member[types]).sum(0)
            inner = np.ones(len(seq), bool)
            inner[np.cumsum(lengths) - 1] = False
            left = np.flatnonzero(inner)
            joint = post[left][:, :, None] * step[None] * (post[left + 1] / np.maximum(post[left] @ step, 1e-12))[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            grad_t = joint.sum(0)
            np.subtract.at(grad_t, (gold[left], gold[left + 1]), 1)
            tick += 1
            for x, g, m, s, rate in zip(theta, (grad_w / len(pairs), grad_t / len(pairs), grad_l / len(pairs)), mean, square, (0.15, 0.05, 0.05), strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                x -= rate * (m / (1 - 0.9**tick)) / (np.sqrt(s / (1 - 0.99**tick)) + 1e-8)
    return Model(languages, theta[0].astype(np.float32), theta[1].astype(np.float32), theta[2].astype(np.float32), lexicons)


class Labeller:
    """Applies a model to texts; remembers words up to a bound."""

    def __init__(self, model: Model):
        self.model, self.index, self.again = model, {}, set()
        self.psi = np.empty((0, len(model.languages)), np.float32)
        self.step = np.exp(model.transitions - model.transitions.max())

    def _learn(self, seen: set[str]) -> None:
        fresh = [w for w in seen if w not in self.index]
        hits = seen.difference(fresh)
        self.again |= hits
        if len(self.index) + len(fresh) > CACHE_WORDS:  # keep what was met again since the last time, or at least what is needed now
            kept = self.again if len(self.again) + len(fresh) <= CACHE_WORDS else hits
            rows = np.fromiter(map(self.index.__getitem__, kept), np.int64, len(kept))
            self.index, self.psi, self.again = dict(zip(kept, range(len(kept)), strict=True)), self.psi[rows], set()
        score = np.concatenate([self.model.emissions(fresh[i : i + 20_000]) for i in range(0, max(1, len(fresh)), 20_000)])
        psi = np.maximum(np.exp(score - score.max(1, keepdims=True)) if len(fresh) else score, 1e-6)
        self.index.update(zip(fresh, range(len(self.psi), len(self.psi) + len(fresh)), strict=True))
        self.psi = np.concatenate([self.psi, psi])

    def words(self, text: str) -> list[str]:
        found = LETTERS.findall(text.lower())
        return found if "".join(found).isalpha() else [w for w in found if w.isalpha() or any(map(str.isalpha, w))]

    def posteriors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of all words of the texts, one after another, and the texts' word counts."""
        split = [self.words(t) for t in texts]
        self._learn(set(chain.from_iterable(split)))
        lengths = np.array([len(w) for w in split], np.int64)
        rows = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
        some = lengths[lengths > 0]
        return (_posteriors(self.psi[rows], some, self.step) if len(some) else np.empty((0, self.psi.shape[1]), np.float32)), lengths

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        post, lengths = self.posteriors(texts)
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        some = np.flatnonzero(lengths)
        if len(some):
            mass = np.add.reduceat(post.astype(np.float64), np.cumsum(lengths[some]) - lengths[some], axis=0) / lengths[some][:, None]
            best = mass.argmax(1)
            for i, b, s in zip(some.tolist(), best.tolist(), mass[np.arange(len(some)), best].tolist(), strict=True):
                langs[i], scores[i] = self.model.languages[b], min(1.0, max(0.0, s))
        return langs, scores

    def label_words(self, text: str) -> list[tuple[str, str, float]]:
        """(word, language, posterior) of each word: the view of code-switched text."""
        post, _ = self.posteriors([text])
        best = post.argmax(1)
        return [(w, self.model.languages[b], float(post[i, b])) for i, (w, b) in enumerate(zip(self.words(text), best, strict=True))]


def sample_rows(docs: DataFrame, bound: Sample) -> list[tuple[str, str]]:
    """The bounded training sample, by a hash of ``doc_id``; at least one row of each language."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()}
    quota = max(1, min(bound.per_language, bound.documents // max(1, len(counts))))
    share = {lang: min(1.0, 2 * quota / n) for lang, n in counts.items()}
    if not share:
        return []
    wanted = F.element_at(F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))]), F.col("lang"))
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(bound.seed)), F.lit(1 << 52)) / float(1 << 52)
    near = labelled.withColumn("__h", hashed).where(F.col("__h") < wanted).withColumn("__long", F.octet_length("text") > bound.document_bytes)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("__long", "__h", "doc_id"))
    kept = near.withColumn("__n", nth).where((F.col("__n") <= quota) & (~F.col("__long") | (F.col("__n") == 1)))
    return [(r["text"], r["lang"]) for r in kept.select("text", "lang", "__h", "doc_id").orderBy("__h", "doc_id").collect()]


def fit(docs: DataFrame, bound: Sample = Sample()) -> Model:  # noqa: B008
    """Train on the documents' non-null ``lang``."""
    rows = sample_rows(docs.select("doc_id", "text", "lang"), bound)
    return train(rows, seed=bound.seed)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns and two more, language and score, of every document; only ``text`` enters the prediction."""
    source = docs.select(*keep, *([] if "text" in keep else ["text"]))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema.fields] + [f"`{names[0]}` string", f"`{names[1]}` double"])
    if not model.languages:
        return source.select(*keep, F.lit(UNDETERMINED).alias(names[0]), F.lit(0.0).alias(names[1]))

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for rows in batches(it, 2 << 20):
            langs, scores = labeller.predict([t or "" for t in rows.column("text").to_pylist()])
            out = rows.select(list(keep)).append_column(names[0], pa.array(langs)).append_column(names[1], pa.array(scores))
            yield from out.to_batches()

    return source.mapInArrow(tidy(apply), schema)
