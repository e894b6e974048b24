"""License scans by exact set-similarity join of text blocks with license templates.

A document is cut into blocks of ``BLOCK`` words that overlap by half. A block meets a template if it holds at least the
template's share (containment) of its distinct words. Words are ordered by how many documents of the whole corpus hold them, rarest
first, and three filters find all such pairs without comparing the rest: a block that reaches containment t of a template of n words
holds one of its n - ceil(t n) + 1 rarest words (prefix); it has at least ceil(t n) distinct words (length); and after a match at place
i of the order, the words still to come must suffice (position). Survivors are counted exactly.

Templates are the passages of whole license texts (``license_texts``), cut at paragraphs into half a block at most, so that some block holds
all of each copied passage, and short statements. A block that shares a template's words must also hold them close together, within ``SPREAD`` times
the template's length, with a share of ``PAIRS`` of its neighbouring words side by side; a statement's names and numbers must all be there, each name's words in a row. Where licenses share a passage nearly word for
word, the closer one counts in a block and those that overlap it. There are no texts of the Creative Commons licenses, only statements.

The phrases of ``PHRASES`` are templates that must be whole (containment 1) and stand consecutively; their places are read off
the blocks that hold all their words. Null text counts as empty. Repeated rows get equal answers. Templates are parameters and small; they
travel with the tasks.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.words import batches, raw_texts

#: Words of a block; blocks start every half block.
BLOCK = 128
CONTAINMENT = 0.8
#: Fixed values of the contract: base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: License statements and their labels (public license texts, shortened to their characteristic sentences).
TEMPLATES = {
    "Released under the MIT License.": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "Licensed under the Apache License, Version 2.0": "apache-2",
    "you may not use this file except in compliance with the License. You may obtain a copy of the License at": "apache-2",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2",
    "Licensed under the Mozilla Public License, Version 2.0": "mpl-2",
    "This work is licensed under the GNU General Public License, version 2.": "gpl-2",
    "All rights reserved.": "all-rights-reserved",
}
#: Whole license texts, by label: ``license_texts/<label>.txt``.
TEXTS = ("apache-2", "bsd", "gpl-2", "gpl-3", "mit", "mpl-2")
#: Words of a passage, distinct words that make one worth matching, and the room its words may take in a block.
PASSAGE, DISTINCT, SPREAD = BLOCK // 2, 12, 1.3
#: Neighbouring words of a template that must be neighbours in the block; a fifth of the words changed leaves about 0.64.
PAIRS = 0.5
#: Names that tell statements apart; so do numbers.
NAMES = ("mit license", "apache license", "by nc", "attribution noncommercial", "attribution sharealike", "gnu general public license", "mozilla public license")
#: Words are lower-case ASCII letters, digits and everything beyond ASCII; the rest separates.
SEPARATE = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def license_words(raw: bytes) -> list[bytes]:
    return raw.translate(SEPARATE).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    #: Distinct words, rarest first; so many must be in a block; a block must hold one of so many first ones.
    order: tuple[bytes, ...]
    needed: int
    prefix: int
    consecutive: bool
    #: Names and numbers that a match must hold, each in a row.
    names: tuple[tuple[bytes, ...], ...] = ()


def passages(text: str) -> list[str]:
    """A license text's paragraphs, cut into equal parts of ``PASSAGE`` words at most; headings and the like are left out."""
    out = []
    for paragraph in re.split(r"\n\s*\n", text):
        words = license_words(paragraph.encode())
        parts = -(-len(words) // PASSAGE)
        cuts = [len(words) * k // parts for k in range(parts + 1)] if parts else []
        out += [b" ".join(words[a:b]).decode() for a, b in zip(cuts, cuts[1:]) if len(set(words[a:b])) >= DISTINCT]
    return out


def all_templates() -> list[tuple[str, str]]:
    """(text, label) of the phrases, the statements and the passages of license texts."""
    texts = [(x, label) for label in TEXTS for x in passages(pkgutil.get_data(__package__, f"license_texts/{label}.txt").decode())]
    return [*PHRASES.items(), *TEMPLATES.items(), *dict.fromkeys(texts)]


def _names(words: tuple[bytes, ...]) -> tuple[tuple[bytes, ...], ...]:
    names = [tuple(license_words(n.encode())) for n in NAMES]
    return tuple([n for n in names if places(list(words), n, 0, len(words))] + [(w,) for w in dict.fromkeys(words) if w.isdigit()])


def build_templates(frequency: dict[bytes, int], containment: float) -> list[Template]:
    out = []
    for text, label in all_templates():
        words = tuple(license_words(text.encode()))
        order = tuple(sorted(set(words), key=lambda w: (frequency.get(w, 0), w)))
        whole = text in PHRASES
        needed = len(order) if whole else math.ceil(containment * len(order))
        out.append(Template(label, words, order, needed, len(order) - needed + 1, whole, _names(words) if text in TEMPLATES else ()))
    return out


def word_frequencies(docs: DataFrame) -> dict[bytes, int]:
    """Documents of the whole corpus that hold each word of the templates."""
    wanted = {w for text, _ in all_templates() for w in license_words(text.encode())}

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for rows in batches(it, 4 << 20):
            for raw in raw_texts(rows.column("text").combine_chunks()):
                total.update(wanted.intersection(license_words(raw)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in counts.collect()}  # one row for each word of the templates at most


def places(words: list[bytes], phrase: tuple[bytes, ...], lo: int, hi: int) -> list[int]:
    """Starts of the consecutive phrase within words[lo:hi]."""
    found, at = [], lo
    while True:
        try:
            at = words.index(phrase[0], at, hi)
        except ValueError:
            return found
        if tuple(words[at : at + len(phrase)]) == phrase and at + len(phrase) <= hi:
            found.append(at)
        at += 1


def join_blocks(words: list[bytes], index: dict[bytes, list[tuple[int, int]]], templates: list[Template], block: int = BLOCK) -> Iterator[tuple[int, int, int, float]]:
    """(template, block start, block end, containment) of every pair that reaches its template's threshold."""
    if not words or index.keys().isdisjoint(words):
        return
    step = block // 2
    for lo in range(0, max(1, len(words) - step), step):
        hi = min(len(words), lo + block)
        held = set(words[lo:hi])
        first: dict[int, int] = {}
        for w in held & index.keys():
            for t, place in index[w]:
                first[t] = min(place, first.get(t, place))
        for t, place in first.items():
            template = templates[t]
            n = len(template.order)
            if len(held) < template.needed or n - place < template.needed:  # length, position
                continue
            common = sum(w in held for w in template.order)
            if common >= template.needed:
                yield t, lo, hi, common / n


def closest(words: list[bytes], lo: int, hi: int, template: Template) -> float:
    """The largest share of the template's distinct words in a stretch of words[lo:hi] of ``SPREAD`` times its length that holds its names."""
    pairs = set(zip(template.words, template.words[1:]))
    if len(pairs.intersection(zip(words[lo : hi - 1], words[lo + 1 : hi]))) < PAIRS * len(pairs):
        return 0.0
    wanted = set(template.order)
    at = [i for i in range(lo, hi) if words[i] in wanted]
    room = int(SPREAD * len(template.words)) + 1
    held: Counter[bytes] = Counter()
    best, left = 0, 0
    for right, i in enumerate(at):
        held[words[i]] += 1
        while at[left] <= i - room:
            held[words[at[left]]] -= 1
            if not held[words[at[left]]]:
                del held[words[at[left]]]
            left += 1
        if len(held) > best and all(places(words, n, at[left], i + 1) for n in template.names):
            best = len(held)
    return best / len(template.order)


def twins(templates: list[Template], containment: float = CONTAINMENT) -> dict[int, set[int]]:
    """Passages of different licenses that nearly contain one another."""
    sets = [set(t.order) for t in templates]
    long = [i for i, t in enumerate(templates) if len(t.order) >= DISTINCT]
    out: dict[int, set[int]] = {}
    for i in long:
        for j in long:
            if templates[i].label != templates[j].label and len(sets[i] & sets[j]) >= containment * min(len(sets[i]), len(sets[j])):
                out.setdefault(i, set()).add(j)
    return out


def scan_licenses(docs: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """Per document: words, base places, labels, and the matched blocks as (label, start, end, containment)."""
    templates = build_templates(word_frequencies(docs), containment)
    index: dict[bytes, list[tuple[int, int]]] = {}
    for t, template in enumerate(templates):
        for place, w in enumerate(template.order[: template.prefix]):
            index.setdefault(w, []).append((t, place))
    near = twins(templates)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
    block_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches(it, 4 << 20):
            out = []
            for raw in raw_texts(rows.column("text").combine_chunks()):
                words = license_words(raw)
                starts, base, labels, blocks, score = set(), set(), set(), [], 0.0
                hits: dict[int, set[int]] = {}
                joined = []
                for t, lo, hi, share in join_blocks(words, index, templates):
                    if not templates[t].consecutive:
                        share = closest(words, lo, hi, templates[t])
                        if share * len(templates[t].order) < templates[t].needed - 1e-9:
                            continue
                    joined.append((t, lo, hi, share))
                shares = {(t, lo): share for t, lo, _, share in joined}
                for t, lo, hi, share in joined:
                    template = templates[t]
                    if any(shares.get((other, lo + by), 0) > share for other in near.get(t, ()) for by in (-BLOCK // 2, 0, BLOCK // 2)):
                        continue
                    if template.consecutive:
                        found = places(words, template.words, lo, hi)
                        hits.setdefault(t, set()).update(found)
                        if not found:
                            continue
                        base.add(template.label)
                    labels.add(template.label)
                    blocks.append({"label": template.label, "start": lo, "end": hi, "containment": share})
                    score = max(score, share)
                starts = sorted(x for s in hits.values() for x in s)
                out.append((len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(base)), ",".join(sorted(labels)), score, blocks))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), block_type]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,start:bigint,end:bigint,containment:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, schema)
