"""The ten operators on small inputs against plain brute force, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, key string, copies int, score double"


def words(rng, n, pool=None):
    pool = pool or [f"{a}{b}{c}" for a in "bdk" for b in "aeiou" for c in ("n", "st", "rm", "l")]
    return " ".join(rng.choice(pool) for _ in range(n))


def corpus():
    rng = random.Random(3)
    texts = [words(rng, rng.randint(30, 120)) for _ in range(24)]
    passage = words(rng, 55)
    texts += [texts[0], texts[0], texts[1] + " tail", passage + " " + texts[2], texts[3] + "\n" + passage, passage]
    near = texts[4].split()
    for k in range(6):
        copy = list(near)
        copy[k * 3] = "other"
        texts.append(" ".join(copy))
    texts += ["", None, "  \n\t ", "1234 5678 !!", "one", "two words", "x" * 5000, words(rng, 3000), "Über Straße naïve 中文 test", "a b\x1cc\x85d e"]
    rows = [(i * 7 % 101, t, ["en", "de", None][i % 3], ["s0", "s1", None, "s0"][i % 4], len(t or ""), i, "s", "k", 1, 0.5) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[30]]  # repeated rows
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_token_files(spark, docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from scriptorium.llm.tokens import token_ids

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    got = [tuple(r) for r in token_ids(docs, path, shard_bytes=4000).orderBy("start").collect()]
    want, start = [], 0
    for d, t in sorted([(r[0], r[1] or "") for r in rows]):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert Counter(got) == Counter(want)
    assert token_ids(empty, path).count() == 0


def test_wavelet_matrix():
    from scriptorium.llm.tokens import WaveletMatrix

    rng = np.random.default_rng(1)
    for n, symbols in ((0, 1), (1, 1), (700, 1), (5000, 300), (1300, 70_000)):
        ids = rng.integers(0, symbols, n).astype(np.uint32)
        m = WaveletMatrix.from_bytes(WaveletMatrix.build(ids).to_bytes())
        assert np.array_equal(m.decode(), ids)
        for i in range(0, n, 97):
            assert m.access(i) == ids[i]
            assert m.rank(int(ids[i]), i) == int((ids[:i] == ids[i]).sum())
        if n:
            c = int(ids[0])
            assert m.locate(c) == np.flatnonzero(ids == c).tolist() and m.count(c) == int((ids == c).sum()) and m.count(10**6) == 0


def test_encoder_equals_library():
    import public_tokenizers
    import pyarrow as pa
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from scriptorium.llm.tokens import encode_texts, encoder

    cache = encoder(public_tokenizers.path("byte_bpe_50k.json"))

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from(list("aB é中1.!?'\n\t\r s<|>_-̈")), max_size=30), min_size=1, max_size=4))
    def check(texts):
        got = encode_texts(pa.array(texts), cache)
        assert [x.tolist() for x in got] == [cache.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    check()


def test_added_tokens_in_texts():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from scriptorium.llm.tokens import encode_texts, encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    fresh = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "plain text", None, "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext", ""]
    want = [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encode_texts(pa.array(texts), encoder(path))] == want
    assert [x.tolist() for x in encode_texts(pa.array(texts[:1]), encoder(path))] == want[:1] and 50256 in want[0]


def test_weighted_mix(spark, docs, rows, empty):
    from scriptorium.llm.mixing import mix, schedule

    got = schedule(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(tokens(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, live = {}, 1.5 * sum(sizes.values()), set(order)
    while live:  # share by weight; sources above twice their size stop there
        total = sum(weight[s] for s in live)
        full = {s for s in live if left * weight[s] / total > 2 * sizes[s]}
        for s in full or live:
            target[s] = 2.0 * sizes[s] if full else left * weight[s] / total
        left -= sum(target[s] for s in full)
        live = live - full if full else set()
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in order)
    assert sorted(map(str, got)) == sorted(map(str, schedule(docs).collect()))
    plan = schedule(docs)
    cut = min((r["virtual_finish"], r["copies"]) for r in got if r["copies"] < 2)  # serving in order of virtual time stops somewhere
    assert all(r["copies"] == 2 for r in got if r["size"] and r["virtual_finish"] + r["source_size"] / {s: float(w) for s, w in weight.items()}[r["source"]] < cut[0])
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in plan.collect():
        want[(r["doc_id"], r["source"], r["size"])] += r["copies"]
    have = Counter((r["doc_id"], r["source"], len(tokens(r["text"]))) for r in mixed.collect())
    assert have == +want
    assert schedule(empty).count() == 0 and mix(empty).count() == 0


def test_mix_of_repeated_rows(spark):
    from scriptorium.llm.mixing import mix, schedule

    rows = [(7, "a b c", "d", None)] * 600 + [(7, "a b c", "d", 1)] + [(i, words(random.Random(i), 40), "e", None) for i in range(100)] + [(None, "x y", None, 2)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    planned = {r["source"]: r["t"] for r in schedule(docs).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    mixed = Counter()
    for r in mix(docs).collect():
        mixed[r["source"]] += len(r["text"].split())
    assert dict(mixed) == {k: v for k, v in planned.items() if v}


def test_hilbert_shards(docs, rows, empty):
    from scriptorium.llm.hilbert import hilbert_shards

    got = hilbert_shards(docs, shards=7).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert set(by) == set(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert hilbert_shards(empty).count() == 0


def test_hilbert_curve_is_connected():
    from scriptorium.llm.hilbert import hilbert_tables

    digits, following = hilbert_tables(3)
    seen = {}
    for c in np.ndindex(8, 8, 8):
        state = index = 0
        for bit in (2, 1, 0):
            at = state * 8 + sum((c[k] >> bit & 1) << k for k in range(3))
            index, state = index * 8 + digits[at], following[at]
        seen[index] = c
    assert len(seen) == 512 and all(sum(abs(a - b) for a, b in zip(seen[i], seen[i + 1], strict=True)) == 1 for i in range(511))


def test_near_duplicates(docs, rows, empty):
    from scriptorium.llm.neardup import near_duplicates

    def shingles(t):
        w = tokens("".join(c.lower() if c.isascii() else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), r["doc_id"] == find(r["doc_id"]))
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    from scriptorium.llm.neardup import near_duplicates

    t, x, u, v = ("%s one two three four five six seven eight" % w for w in "txuv")
    rows = [(1, t), (1, t), (2, x), (3, x), (3, u), (None, u), (None, v), (None, v), (None, t), (5, ""), (None, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, 1), (1, 1), (2, 2), (3, 2), (3, 3), (None, 3), (None, None), (None, None), (None, 1), (5, 5), (None, None)]
    assert sorted(repr((r["doc_id"], r["component_id"], r["kept"])) for r in got) == sorted(repr((a, b, a == b)) for a, b in want)
    assert len({r["group_id"] for r in got if r["component_id"] is None} - {None}) == 1  # v's; the empty text has no group


def test_near_duplicates_in_a_crowd(spark, monkeypatch):
    from scriptorium.llm import neardup

    monkeypatch.setattr(neardup, "WIDE_BUCKET", 3)
    monkeypatch.setattr(neardup, "CELL", 4)
    rng = random.Random(8)
    base = words(rng, 90).split()
    rows = []
    for i in range(60):  # some link only through others
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(40)}"
        rows.append((i, " ".join(copy)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a + 1, len(rows)):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: find(i) for i in sets}


def test_sketch_agreement():
    from scriptorium.llm.neardup import sketch
    from scriptorium.llm.words import mixed

    rng = np.random.default_rng(2)
    for n, share in ((40, 0.5), (400, 0.75), (1, 1.0)):
        x = mixed(np.unique(rng.integers(0, 1 << 62, 2 * n).astype(np.uint64)))
        common = round(n * 2 * share / (1 + share))
        a, b = x[:n], np.concatenate([x[:common], x[n : 2 * n - common]])
        s, t = sketch(a), sketch(b)
        assert (s != np.iinfo(np.uint64).max).all()
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s == t).mean() - truth) < 0.15


def test_components(spark):
    from scriptorium.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 120)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 120)}}


def test_substring_dedup(docs, rows, empty):
    from scriptorium.llm.substrings import remove_repeats

    seen, want = {}, {}
    for d, t in sorted({(r[0], r[1] or "") for r in rows}):
        w = tokens(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (d, k)) != (d, k):
                gone[k : k + 20] = [True] * 20
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    got = remove_repeats(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) == want[r["doc_id"]]
    assert any(w[1] for w in want.values()) and remove_repeats(empty).count() == 0


def test_license_scan(spark, docs, rows, empty):
    from scriptorium.llm.licenses import scan_licenses

    texts = ["Released under the MIT License. x under the mit license", "cc BY nc", "Apache License, Version 2.0!", "This work is licensed under the GNU General Public License, version 3.", "under the mit", None, "K under the mit license", " ".join(["w"] * 200) + " under the mit license " + " ".join(["w"] * 100)]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["base_labels"]) == (2, 1, 6, "mit")
    assert [got[i]["base_labels"] for i in range(1, 7)] == ["cc-by-nc", "apache-2", "", "", "", "mit"]
    assert got[3]["labels"] == "gpl-3" and got[5]["n_words"] == 0 and got[7]["first_word"] == 200 and got[7]["n_base"] == 1
    assert scan_licenses(docs).count() == len(rows) and scan_licenses(empty).count() == 0


def test_license_bodies_and_statements(spark):
    from scriptorium.llm.licenses import scan_licenses

    bodies = {
        "mit": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "apache-2": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "gpl-3": "No covered work shall be deemed part of an effective technological measure under any applicable law fulfilling obligations under article 11 of the WIPO copyright treaty adopted on 20 December 1996, or similar laws prohibiting or restricting circumvention of such measures.",
    }
    rng = random.Random(2)
    texts = [(label, f"{words(rng, 150)} {body} {words(rng, 90)}") for label, body in bodies.items()]
    texts += [("", "Released under the GPL License."), ("mpl-2", "Licensed under the Mozilla Public License, Version 2.0"), ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License")]
    texts += [("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"), ("gpl-2", "This work is licensed under the GNU General Public License, version 2."), ("mit", "Released under the MIT License.")]
    texts += [("", "Released in may, this museum " + words(rng, 90) + " under the roof a License MIT")]
    got = {r["doc_id"]: r["labels"] for r in scan_licenses(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [label for label, _ in texts]


def test_set_similarity_filters_lose_nothing():
    from scriptorium.llm.licenses import build_templates, join_blocks

    rng = random.Random(4)
    templates = build_templates({}, 0.8)
    index = {}
    for t, template in enumerate(templates):
        for place, w in enumerate(template.order[: template.prefix]):
            index.setdefault(w, []).append((t, place))
    pool = [w for t in templates for w in t.words] + [b"x", b"y"]
    for _ in range(300):
        text = [rng.choice(pool) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            at, chosen = rng.randrange(len(text) + 1), rng.choice(templates)
            text[at:at] = [w for w in chosen.words if rng.random() < 0.9]
        got = {(t, lo) for t, lo, _, _ in join_blocks(text, index, templates, 32)}
        want = set()
        for lo in range(0, max(1, len(text) - 16), 16):
            for t, template in enumerate(templates):
                if text and sum(w in text[lo : lo + 32] for w in template.order) >= template.needed:
                    want.add((t, lo))
        assert got == want


def test_personal_data(spark, docs, rows, empty):
    from scriptorium.llm import pii

    texts = [
        "mail a.b@c.example.com or x@y, ip 10.0.0.255 and 300.1.1.1, card 4111 1111 1111 1111 and 4111111111111112",
        "call +1 (344) 555-6408 now. Later 344 5556408 or (344) 555-6408 again",
        "1.2.3.4.5 and a@b.c@d.e +123", None, "", "9" * 3000 + ".1.1.1", "é +44 20 7946 0958 é",
    ]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        found = [("email", m) for m in pii.EMAIL.finditer(t)]
        found += [("ip", m) for m in pii.IP.finditer(t) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m.group().split("."))]
        found += [("card", m) for m in pii.CARD.finditer(t) if 13 <= len(re.sub(r"\D", "", m.group())) <= 19 and pii.luhn(re.sub(r"\D", "", m.group()))]
        found += [("phone", m) for m in pii.PHONE.finditer(t) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]
        spelled = ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found)
        assert got[i]["base_sha256"] == hashlib.sha256(spelled.encode()).hexdigest()
        assert set(filter(None, spelled.split(","))) <= set(got[i]["spans"].split(","))
    assert got[0]["n_email"] == 1 and got[0]["n_ip"] == 1 and got[0]["n_card"] == 1 and got[1]["n_phone"] == 1
    assert pii.find_personal_data(docs).count() == len(rows) and pii.find_personal_data(empty).count() == 0


def test_skip_links_make_labels_consistent():
    from scriptorium.llm import pii

    rng = random.Random(1)
    number = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    field = pii.train([f"word {number()} word {rng.randint(1, 99)} text a{k}@mail.example.com" for k in range(150)])
    text = "first +1 (344) 555-6408 then 555-6408 once more and 777-1234 alone"
    base = pii.base_spans(text)
    nodes = pii.tokens_of(text, base)
    spans = pii.further_spans(nodes, pii.marginals(field, [nodes]))
    assert [(text[s:e], pii.KINDS[k]) for k, s, e in spans] == [("555-6408", "phone")]


def test_support_reaches_all_mentions():
    from scriptorium.llm import pii

    # a field to which the mentions themselves say nothing
    labels = len(pii.KINDS) + 1
    field = pii.Field(np.zeros((pii.DIMENSIONS, labels)), np.zeros((labels, labels)), 4 * np.eye(labels))
    for text in ("first +1 (344) 555-6408" + " then 555-6408 there" * 50, "then 555-6408 there " * 50 + "last +1 (344) 555-6408"):
        nodes = pii.tokens_of(text, pii.base_spans(text))
        spans = pii.further_spans(nodes, pii.marginals(field, [nodes]))
        assert [(text[s:e], pii.KINDS[k]) for k, s, e in spans] == [("555-6408", "phone")] * 50


def test_numbers_without_an_equal_token():
    from scriptorium.llm import pii

    rng = random.Random(1)
    number = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    field = pii.train([f"word {number()} word {rng.randint(1, 99)} text a{k}@mail.example.com" for k in range(150)])
    cases = {
        "call (344) 555-6408 now": ["(344)", "555-6408"],  # no base span
        "first +13445556408 later 3445556408 end": ["3445556408"],
        "first +1 344 555 6408 then 344 555 6408 end": ["344", "555", "6408"],
        "from 344 555 6408 12 to +1 (344) 555-6408 end": ["344", "555", "6408"],
        "in 1999 there were 120 of 3400 and 12-34": [],
    }
    for text, want in cases.items():
        nodes = pii.tokens_of(text, pii.base_spans(text))
        spans = pii.further_spans(nodes, pii.marginals(field, [nodes]))
        assert [(text[s:e], pii.KINDS[k]) for k, s, e in spans] == [(x, "phone") for x in want], text


def test_no_base_span_is_needed(spark):
    from scriptorium.llm import pii

    field = pii.train([f"word +1 ({200 + k}) 555-{1000 + 7 * k} word {k % 90} text a{k}@mail.example.com" for k in range(150)])
    got = pii.find_personal_data(spark.createDataFrame([(1, "call (344) 555-6408 now")], "doc_id long, text string"), field).first()
    assert (got["n_phone"], got["n_further"], got["spans"]) == (0, 2, "phone:5:10,phone:11:19")


def test_language_id(spark, docs, rows, empty):
    from scriptorium.llm.langid import Labeller, fit, identify, train

    rng = random.Random(5)
    pools = {"aa": ["the", "and", "thing", "with", "other"], "bb": ["der", "und", "ist", "einung", "keit"], "cc": ["le", "de", "eau", "tion", "que"]}
    table = [(i, words(rng, rng.randint(3, 60), pools[lang]), lang) for i in range(240) for lang in [list(pools)[i % 3]]]
    model = fit(spark.createDataFrame([r for r in table if r[0] % 4 != 2], "doc_id long, text string, lang string"))
    held = [r for r in table if r[0] % 4 == 2]
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(held, "doc_id long, text string, lang string"), model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in held) / len(held) > 0.97
    mixed = Labeller(model).label_words("the and thing with other der und ist einung keit")
    assert [x[1] for x in mixed] == ["aa"] * 5 + ["bb"] * 5
    odd = identify(docs, model).collect()
    assert len(odd) == len(rows) and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["lang_pred"] for r in identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 !")], "doc_id long, text string"), model).collect()} == {"und"}
    assert identify(empty, model).count() == 0
    assert identify(docs, train([])).first()["lang_pred"] == "und" and fit(empty).languages == []


def test_forward_backward_is_exact():
    from scriptorium.llm.langid import _posteriors

    rng = np.random.default_rng(0)
    lengths = np.array([1, 5, 33, 100, 64])
    psi, step = rng.random((int(lengths.sum()), 3)) + 0.1, rng.random((3, 3)) + 0.1
    got, at = _posteriors(psi, lengths, step), 0
    for n in lengths:
        p = psi[at : at + n]
        f, b = np.zeros((n, 3)), np.ones((n, 3))
        message = np.full(3, 1 / 3)
        for t in range(n):
            message = (message @ step) * p[t]
            message /= message.sum()
            f[t] = message
        for t in range(n - 2, -1, -1):
            b[t] = step @ (p[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        want = f * b
        assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
        at += n


def test_decontamination(spark, docs, rows, empty):
    from scriptorium.llm.decontaminate import contaminated, decontaminated

    rng = random.Random(6)
    items = [words(rng, n) for n in (15, 30, 59)] + ["A train leaves the old station of the city at 40 km per hour and arrives after 3 hours at 120 km"]
    bench = spark.createDataFrame([*enumerate(items), (9, "too short"), (10, None)], "item_id long, text string")
    asked = items[3].replace("40", "55").replace("120", "165").replace("3 hours", "9 hours")
    wrong = items[3].replace("40", "40").replace("120", "40").replace(" 3 ", " 40 ")
    texts = [f"{words(rng, 40)} {items[0]} {words(rng, 9)}", f"{words(rng, 3)}\n{items[1]}", items[2], asked, words(rng, 200), None, "", " ".join(items[2].split()[:9])]
    frame = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in contaminated(frame, bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 3)}
    assert got[3, 3]["refilled"] and not got[0, 0]["refilled"] and got[0, 0]["start_word"] == 40
    assert sorted(r["doc_id"] for r in decontaminated(frame, bench).collect()) == [4, 5, 6, 7]
    assert decontaminated(docs, bench).columns == docs.columns and decontaminated(docs, bench.limit(0)).count() == len(rows)
    assert contaminated(empty, bench).count() == 0 and wrong


def test_decontamination_of_edited_copies(spark):
    from scriptorium.llm.decontaminate import contaminated

    rng = random.Random(8)
    items = [words(rng, n) for n in (24, 48, 40)] + ["3 5 8 13 21 34 55 89 144 233 377 610 987 1597", "what is the capital of france", words(rng, 9)]
    edited = [x.split() for x in items]
    edited[0][12] = "other"
    edited[1][11::12] = ["other"] * 4
    edited[2][20:20] = ["two", "more"]
    edited[2][10:10] = ["more"]
    texts = [f"{words(rng, 30)} {' '.join(x)} {words(rng, 30)}" for x in edited]
    texts += ["what is the capital of spain and " + words(rng, 20), " ".join(items[2].split()[:9]) + " " + words(rng, 60), words(rng, 300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = contaminated(frame, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["run_words"] for r in found} == {(0, 0): 23, (1, 1): 44, (2, 2): 40, (3, 3): 14, (4, 4): 6, (5, 5): 9}
    assert {r["start_word"] for r in found} == {30}


def test_nearest_neighbours(spark):
    from scriptorium.llm.neighbours import nearest

    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 16))
    v[50:80] = v[50]  # a class of copies
    v[90] = 0
    rows = [(i, [float(x) for x in v[i]], i) for i in range(400)] + [(900, None, 1), (950, [float("nan")] * 16, 1), (1000, [1.0] * 3, 1), (399, [float(x) for x in v[399]], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    got = nearest(frame, every=25).collect()
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    hits = total = 0
    for q in range(0, 400, 25):
        mine = sorted([r for r in got if r["query_id"] == q], key=lambda r: r["rank"])
        sims = u @ u[q]
        best = [i for i in sorted(range(400), key=lambda i: (-round(sims[i], 12), i)) if i not in (q, 90)][:5]
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        hits += len({r["vec_id"] for r in mine} & set(best))
        total += 5
        if q == 50:
            assert [r["vec_id"] for r in mine] == [51, 52, 53, 54, 55]
    assert hits / total >= 0.9
    assert nearest(frame.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"]) for r in nearest(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert not nearest(few.where("vec_id = 0")).collect()


def test_nearest_neighbours_recall_with_a_small_beam(spark):
    """The beam holds a twentieth of the nodes, so the graph must lead the search."""
    from scriptorium.llm.neighbours import nearest

    rng = np.random.default_rng(6)
    v = rng.normal(size=(40, 24)).repeat(50, 0) + 0.8 * rng.normal(size=(2000, 24))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got: dict[int, set[int]] = {}
    for r in nearest(frame, beam=100).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 2000, 50):
        order = np.argsort(-(u @ u[q]), kind="stable")
        hits += len(got[q] & set([i for i in order.tolist() if i != q][:5]))
    assert hits >= 0.9 * 200


def test_parse_is_greedy():
    """Factors of whole random texts: real, maximal in their source, and with straddling windows all repeats covered."""
    from scriptorium.llm.substrings import WINDOW, parse

    rng = random.Random(5)
    for _ in range(40):
        shared = [rng.choice("abcdefgh") for _ in range(150)]
        texts = []
        for _ in range(4):
            a, b = sorted(rng.sample(range(150), 2))
            texts.append([rng.choice("abc") for _ in range(rng.randint(0, 30))] + shared[a:b] + shared[a // 2 : b] + [rng.choice("xyz") for _ in range(9)])
        first: dict[tuple, tuple[int, int]] = {}
        for d, w in enumerate(texts):
            found, covered = [], [False] * len(w)
            for i in range(len(w) - WINDOW + 1):
                source = first.setdefault(tuple(w[i : i + WINDOW]), (d, i))
                if source != (d, i):
                    found.append((i, 1, *source))
                    covered[i : i + WINDOW] = [True] * WINDOW
            rng.shuffle(found)
            factors, got = parse(len(w), *(np.array([f[k] for f in found], np.int64) for k in range(4)))
            assert got.tolist() == covered
            end = 0
            for at, n, source, begin in factors:
                assert n >= WINDOW and at >= end and texts[source][begin : begin + n] == w[at : at + n] and (source, begin) < (d, at)
                end = at + n


def test_base_spans_of_long_tokens():
    import time

    from scriptorium.llm.pii import EMAIL, IP, base_spans

    rng = random.Random(1)
    for k in range(4000):
        text = "".join(rng.choice("a1 .@-_%+5" if k % 2 else "12..@a") for _ in range(rng.randint(0, 40)))
        want = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)] + [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
        assert [s for s in base_spans(text) if s[0] < 2] == want
    began = time.time()
    for text in ("1" * 10**6 + "...", "a" * 10**6 + "@", "1." * 500_000, "a@" * 500_000, "+1" + "(" * 10**6, "." * 10**6 + "1"):
        base_spans(text)
    assert time.time() - began < 30


def test_decontamination_of_renamed_questions_and_number_tables(spark):
    from scriptorium.llm.decontaminate import contaminated, decontaminated

    asked = "Natalia has 48 boxes of red apples at her shop. Natalia sells 12 boxes to the first man who walks in. Natalia then gives 6 boxes to an old friend. Natalia wants to know how many boxes are left over."
    again = asked.replace("Natalia", "Roberta").replace("48", "96").replace("12", "24").replace("6 boxes to an", "9 boxes to an")
    mixed = again.replace("Roberta then", "Susanne then").replace("24", "96")  # values that do not go with their like
    table = " ".join(str(i * i % 997) for i in range(60))
    other = " ".join(str(i * 7 % 100) for i in range(2000))
    plain = "Some quite different words stand here before the thing. "
    rows = [(1, plain + again), (None, asked), (3, plain * 5), (3, asked), (4, other), (5, plain + table), (6, mixed), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, asked), (2, table)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in contaminated(docs, bench).collect()}
    assert {k for k in got if k[0] != 6} == {(1, 1), (None, 1), (3, 1), (5, 2)}
    assert got[1, 1]["refilled"] and not got[None, 1]["refilled"]
    assert (6, 1) not in got or got[6, 1]["run_words"] < got[1, 1]["run_words"]
    kept = sorted((r["doc_id"], r["text"] or "") for r in decontaminated(docs, bench).collect() if r["doc_id"] != 6)
    assert kept == sorted([(3, plain * 5), (4, other), (7, ""), (8, "")])


def test_near_duplicate_stage_tells_rows_apart(spark):
    import corpus_pipeline

    t, x, u = ("%s one two three four five six seven eight" % w for w in "txu")
    rows = [(1, t, "a"), (1, t, "a"), (2, x, "a"), (3, x, "b"), (3, u, "b"), (None, u, None), (None, t, None), (5, "", "a"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.near_duplicate_removal(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(repr, [(1, t), (2, x), (3, u), (5, ""), (None, None)]))
    assert corpus_pipeline.near_duplicate_removal(spark, docs.limit(0), "").count() == 0


def test_nearest_neighbours_of_each_length(spark):
    from scriptorium.llm.neighbours import nearest

    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0]), (50, [1.0, 0.0, 0.0]), (51, [1.0, 0.1, 0.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 1), (0, 2, 2), (50, 1, 51)]


def test_registered_queries():
    from scriptorium.llm import entries

    assert {int(re.match(r"op(\d+)_", k)[1]) for k in entries.queries()} == set(range(1, 11))


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline
    from scriptorium.llm.decontaminate import contaminated
    from scriptorium.llm.neardup import near_duplicates
    from scriptorium.session import table

    start = table(spark, sf_dir, "documents")
    kept, seen = start, []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, kept, sf_dir)
        if name == "token_output":
            assert made.count() == kept.count()
            break
        assert made.columns == start.columns
        from scriptorium.session import materialize

        after = materialize(made, name)
        seen.append((kept.count(), after.count()))
        if name == "near_duplicate_removal":
            assert near_duplicates(after).where("not kept").count() == 0
        if name == "benchmark_decontamination":
            assert contaminated(after, table(spark, sf_dir, "benchmark")).count() == 0
        if name == "source_mixing":
            assert after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
        kept = after
    assert seen[0][1] >= 0.95 * seen[0][0] and seen[1][1] < seen[1][0] and seen[2][1] < seen[2][0]


def test_words_are_remembered_across_a_full_cache(monkeypatch):
    from scriptorium.llm import langid

    rows = [("the cat and the dog of the house " * 4, "en"), ("der Hund und die Katze in dem Haus " * 4, "de")]
    model = langid.train(rows * 3, epochs=2)
    texts = [f"the cat and wort{i}en house{i} {chr(97 + i)}x der hund" for i in range(20)]
    want = [langid.Labeller(model).predict([t]) for t in texts]
    hashed = []
    monkeypatch.setattr(langid, "CACHE_WORDS", 14)
    monkeypatch.setattr(langid, "feature_ids", lambda w, f=langid.feature_ids: hashed.append(w) or f(w))
    labeller = langid.Labeller(model)
    assert [labeller.predict([t]) for t in texts] == want
    assert hashed.count("the") == 1 and len(labeller.index) <= 14


def test_short_features_are_hashed_once(monkeypatch):
    from scriptorium.llm import langid

    langid.GRAMS.clear()
    want, calls = langid.feature_ids("wörter"), []
    real = langid.xxhash.xxh32_intdigest
    monkeypatch.setattr(langid.xxhash, "xxh32_intdigest", lambda x: calls.append(x) or real(x))
    assert langid.feature_ids("wörter") == want and calls == ["wwörter"]
    names = ["wwörter", *(f"p{'wörter'[:k]}" for k in (1, 2, 3)), *(f"s{'wörter'[-k:]}" for k in (1, 2, 3)), *("^wörter$"[i : i + k] for k in (2, 3) for i in range(9 - k))]
    assert want == [real(x) & (langid.DIMENSIONS - 1) for x in names]


def test_bytes_that_reach_the_encoder_are_bounded(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    from scriptorium.llm import tokens

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    docs = spark.range(0, 300, 1, 1).selectExpr("id as doc_id", "repeat('lorem ipsum ', 8000) as text")

    def sizes(it, *_):
        for batch in it:
            yield pa.RecordBatch.from_pydict({"part": [0], "seg": [0], "n_ids": [batch.nbytes], "doc_ids": [[]], "lengths": [[]], "payload": [b""]}, schema=pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("payload", pa.binary())]))

    monkeypatch.setattr(tokens, "_write_segments", sizes)
    tokens.write_token_files(docs, str(tmp_path / "sizes"), "unused", 2, 1)
    got = [r["n_ids"] for r in spark.read.parquet(str(tmp_path / "sizes")).collect()]
    assert sum(got) > 28_000_000 and max(got) < 12 << 20 and spark.conf.get(key, None) == before


def test_rounds_of_the_descent_and_search_collect_the_drivers_garbage(spark, sf_dir, monkeypatch):
    from scriptorium.llm import neighbours as N
    from scriptorium.session import discard, table

    done = []
    monkeypatch.setattr(N, "discard", lambda df: done.append("discard") or discard(df))
    monkeypatch.setattr(N, "reclaim_driver", lambda session: done.append("reclaim"), raising=False)
    rows = N.nearest(table(spark, sf_dir, "embeddings").limit(60), every=20).collect()
    assert rows and len(done) >= 4 and done == ["discard", "reclaim"] * (len(done) // 2)


def test_executors_collect_garbage_before_the_token_stage(spark, monkeypatch):
    import corpus_pipeline as P
    from scriptorium.session import reclaim_executors

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory
    collections = lambda: sum(b.getCollectionCount() for b in beans.getGarbageCollectorMXBeans())
    before = collections()
    reclaim_executors(spark)  # in a local session the driver is the executor
    assert collections() > before
    done = []
    monkeypatch.setattr(P, "reclaim_executors", lambda session: done.append("reclaim"), raising=False)
    monkeypatch.setattr(P, "token_ids", lambda *_, **__: done.append("tokens"))
    P.token_output(spark, None, "")
    assert done == ["reclaim", "tokens"]
