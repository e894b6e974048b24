"""Token-ID output: one wavelet matrix per shard.

The documents are range-partitioned by ``doc_id``; every partition becomes one shard file. A shard
holds segments, each a self-contained compressed blob: the wavelet matrix of the segment's token ids
(bit-planes from the high bit down, zeros stably before ones, with rank samples), which supports
access, rank, select, counting and occurrence lookup without decoding the rest. The shard files
are Parquet containers, so they can be written to and read from any store Spark knows.

Null text counts as empty; an empty text has only its end id. Null ``doc_id`` sorts first. Repeated
``doc_id`` rows are separate documents, ordered by text. Columns other than ``doc_id`` and ``text``
are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.words import batches, tidy
from scriptorium.session import fresh_path

#: Token ids a segment may hold before it is closed (a longer document is a segment of its own).
SEGMENT_IDS = 1 << 20
#: Text bytes a shard file should cover.
SHARD_BYTES = 48 << 20
#: Text bytes that a worker encodes at once, and that reach it at once; about 30 times as much memory is needed meanwhile.
BATCH_BYTES, ARROW_BYTES = 3 << 20, 8 << 20
#: Bits between two rank samples.
SAMPLE = 512
MAGIC = b"WVM1"


class WaveletMatrix:
    """Succinct sequence of small integers with access, rank, select, count and locate."""

    def __init__(self, alphabet: np.ndarray, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.alphabet, self.n, self.planes, self.zeros = alphabet, n, planes, zeros
        self._samples: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        alphabet, codes = _dense(ids)
        levels = max(1, int(len(alphabet) - 1).bit_length())
        planes, zeros = [], []
        for level in range(levels - 1, -1, -1):
            bits = (codes >> level) & 1
            planes.append(_packed(bits))
            ones = bits.view(np.bool_) if bits.dtype == np.uint8 else bits.astype(np.bool_)
            low = codes.take(np.flatnonzero(~ones))  # positions cost a fraction of what a random mask does
            zeros.append(len(low))
            codes = np.concatenate([low, codes.take(np.flatnonzero(ones))])
        return cls(alphabet, len(ids), planes, zeros)

    # -- succinct queries ------------------------------------------------------------------
    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane, from the nearest sample."""
        if self._samples is None:
            self._samples = [_sampled(p) for p in self.planes]
        at = i // SAMPLE
        count = int(self._samples[level][at])
        words = self.planes[level][at * (SAMPLE // 64) : -(-i // 64)]
        if len(words):
            count += int(np.bitwise_count(words).sum())
            if i % 64:
                count -= int(np.bitwise_count(words[-1] >> np.uint64(i % 64)))
        return count

    def access(self, i: int) -> int:
        """The i-th id."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[i >> 6] >> np.uint64(i & 63)) & 1
            code = code << 1 | bit
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
        return int(self.alphabet[code])

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        at = int(np.searchsorted(self.alphabet, token))
        if at == len(self.alphabet) or self.alphabet[at] != token:
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            one = at >> (len(self.planes) - 1 - level) & 1
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if one else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token among the first i ids."""
        lo, hi = self._range(token, 0, i)
        return hi - lo

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0)."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i, at = lo + k, int(np.searchsorted(self.alphabet, token))
        for level in range(len(self.planes) - 1, -1, -1):
            one = at >> (len(self.planes) - 1 - level) & 1
            want = i - self.zeros[level] if one else i
            lo_, hi_ = 0, self.n  # smallest prefix that holds want + 1 such bits
            while lo_ < hi_:
                mid = (lo_ + hi_) // 2
                ones = self._rank1(level, mid + 1)
                if (ones if one else mid + 1 - ones) > want:
                    hi_ = mid
                else:
                    lo_ = mid + 1
            i = lo_
        return i

    def locate(self, token: int) -> list[int]:
        """Every position of token, ascending."""
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids: the planes are undone from the lowest level up."""
        levels = len(self.planes)
        codes = np.zeros(self.n, np.uint16 if levels <= 16 else np.uint32)
        for level in range(levels - 1, -1, -1):
            ones = _unpacked(self.planes[level], self.n)
            above = np.empty_like(codes)
            above[np.flatnonzero(~ones)] = codes[: self.zeros[level]]
            above[np.flatnonzero(ones)] = codes[self.zeros[level] :] | codes.dtype.type(1 << (levels - 1 - level))
            codes = above
        return self.alphabet[codes]

    # -- file format -------------------------------------------------------------------------
    def to_bytes(self) -> bytes:
        body = [self.alphabet.astype("<u4").tobytes(), np.asarray(self.zeros, "<u8").tobytes()]
        body += [p.astype("<u8").tobytes() for p in self.planes]
        head = struct.pack("<4sQII", MAGIC, self.n, len(self.alphabet), len(self.planes))
        return head + zstandard.ZstdCompressor(level=1).compress(b"".join(body))

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        magic, n, symbols, levels = struct.unpack_from("<4sQII", blob)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        body = zstandard.ZstdDecompressor().decompress(blob[struct.calcsize("<4sQII") :])
        alphabet = np.frombuffer(body, "<u4", symbols)
        zeros = [int(z) for z in np.frombuffer(body, "<u8", levels, 4 * symbols)]
        per, at = -(-n // 64), 4 * symbols + 8 * levels
        planes = [np.frombuffer(body, "<u8", per, at + 8 * per * k) for k in range(levels)]
        return cls(alphabet, n, planes, zeros)


def _dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ids, and each id's index among them, without sorting the sequence."""
    seen = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.bool_)
    seen[ids] = True
    alphabet = np.flatnonzero(seen).astype(np.uint32)
    index = np.zeros(len(seen), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    index[alphabet] = np.arange(len(alphabet), dtype=index.dtype)
    return alphabet, index[ids]


def _packed(bits: np.ndarray) -> np.ndarray:
    raw = np.packbits(bits.astype(np.uint8), bitorder="little")
    return np.pad(raw, (0, -len(raw) % 8)).view("<u8")


def _unpacked(plane: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(plane.view(np.uint8), count=n, bitorder="little").view(np.bool_)


def _sampled(plane: np.ndarray) -> np.ndarray:
    ones = np.bitwise_count(plane).astype(np.int64)
    blocks = np.add.reduceat(ones, np.arange(0, len(ones), SAMPLE // 64)) if len(ones) else ones
    return np.concatenate([[0], np.cumsum(blocks)])


#: Letters that may be cut from what follows: pre-tokens of a byte-level BPE never run from a letter into a non-letter.
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A text may be cut at a space before a visible character.
CUT = re.compile(r" (?=[!-~À-ÿ])")
#: Chunks that fall into words, stops and line breaks; all others are encoded as they are.
PLAIN = re.compile(rf" ?[{LETTER}]+[.,;:!?]*(?:\n[{LETTER}]+[.,;:!?]*)*\Z")
STOPS = frozenset(".,;:!?")
PIECE = re.compile(rf" ?[{LETTER}]+|[.,;:!?]+|\n")
#: Marks a chunk that no space precedes: a text's first one, and stops after a word.
HEAD = "\x00"


class ChunkIds:
    """Chunks of text and their ids, remembered up to a bound, in Arrow and NumPy alone.

    A space before a visible character always opens a new pre-token of a byte-level BPE, so a text's ids are the
    concatenation of its chunks' ids; a key is a chunk without that space. Words and stops of plain chunks are pre-tokens of
    their own, which go straight to the tokenizer's model. Texts that hold the string of an added token never come here.
    When the bound is reached, the chunks that were met only once since the last time are forgotten.
    """

    LIMIT = 600_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # executors run one task a core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the library finds in a text before it is cut into pre-tokens: a text that may hold one is encoded whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        # the byte alphabet, as the library itself spells each byte of a one-character text
        spelled = {}
        for c in map(chr, range(0x800)):
            word = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0]
            spelled.update(zip(c.encode(), word, strict=True))
        self.spelling = {byte: ord(letter) for byte, letter in spelled.items()}
        self.space = spelled[32]
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids, self.sizes, self.met = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def word(self, key: str) -> list[int]:
        """Ids of one pre-token."""
        if key.isascii() and key[0] != HEAD:  # the letters of a word spell themselves
            return [t.id for t in self.model.tokenize(self.space + key)]
        text = key[1:] if key[0] == HEAD else " " + key
        return [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.spelling))]

    def spell(self, keys: list[str]) -> list[list[int]]:
        """Ids of each chunk, from the library."""
        parts: dict[str, list[int]] = {}

        def part(key: str) -> list[int]:
            found = parts.get(key)
            if found is None:
                found = parts[key] = self.word(key)
            return found

        out: list[list[int]] = []
        odd: list[tuple[int, str]] = []
        for key in keys:
            if key.isalpha():
                out.append(part(key))
            elif key[-1:] in STOPS and key[:-1].isalpha():
                out.append(part(key[:-1]) + part(HEAD + key[-1]))
            else:
                text = key[1:] if key[:1] == HEAD else " " + key
                if PLAIN.match(text):
                    out.append([i for x in PIECE.findall(text) for i in part(x[1:] if x[0] == " " else HEAD + x)])
                else:
                    odd.append((len(out), text))
                    out.append([])
        for at in range(0, len(odd), 4096):
            some = odd[at : at + 4096]
            for (n, _), e in zip(some, self.tokenizer.encode_batch_fast([t for _, t in some], add_special_tokens=False), strict=True):
                out[n] = e.ids
        return out

    def learn(self, keys: pa.Array) -> None:
        """Append the ids of chunks that are not known yet."""
        found = self.spell(keys.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum()))])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.met = np.concatenate([self.met, np.zeros(len(sizes), np.int64)])
        self.known = pa.concat_arrays([self.known, keys.cast(pa.large_string())])

    def trim(self) -> None:
        """Above the bound, keep what was met again and again."""
        if len(self.known) <= self.LIMIT:
            return
        keep = self.met > 1
        if 2 * int(keep.sum()) > self.LIMIT:
            self.forget()
            return
        self.ids = self.ids[np.repeat(keep, self.sizes)]
        self.known = self.known.filter(pa.array(keep))
        self.sizes, self.met = self.sizes[keep], np.zeros(int(keep.sum()), np.int64)


_TOKENIZERS: dict[str, ChunkIds] = {}


def encoder(path: str) -> ChunkIds:
    """The worker's encoder for a vocabulary file, loaded once."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkIds(path)
    return _TOKENIZERS[path]


def encode_texts(texts: pa.Array, cache: ChunkIds) -> list[np.ndarray]:
    """Ids of each whole text (null: none). Chunks are split and looked up by Arrow; Python sees only those not met before."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
    rows = np.arange(len(texts))
    special = np.zeros(len(texts), bool)
    for content in (*cache.added, HEAD):
        special |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
    for row in rows[special].tolist():
        out[row] = np.array(cache.tokenizer.encode(texts[row].as_py(), add_special_tokens=False).ids, np.uint32)
    todo = [(rows[~special], pc.split_pattern(texts.filter(pa.array(~special)), " "))]
    while todo:
        rows, split = todo.pop()
        if not len(rows):
            continue
        starts = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        flat = split.flatten()
        first = np.zeros(len(flat), bool)
        first[starts] = True
        heads = pc.binary_join_element_wise(pa.scalar(HEAD, pa.large_string()), flat.take(pa.array(starts)), pa.scalar("", pa.large_string()))
        flat = pc.replace_with_mask(flat, pa.array(first), heads)
        coded = pc.index_in(flat, value_set=cache.known)
        codes = coded.fill_null(-1).to_numpy().astype(np.int64)
        unknown = np.flatnonzero(codes < 0)
        if len(unknown):
            fresh = flat.take(pa.array(unknown)).dictionary_encode()
            # a chunk that no visible character begins was cut where a text can't be: its text is cut again, with more care
            cut = ~pc.match_substring_regex(fresh.dictionary, "^[!-~À-ÿ\x00]").to_numpy(zero_copy_only=False)
            if cut.any():
                wrong = unknown[cut[fresh.indices.to_numpy()]]
                again = np.unique(np.searchsorted(starts, wrong, "right") - 1)
                fine = np.setdiff1d(np.arange(len(rows)), again)
                careful = pa.array([CUT.split(t) for t in texts.take(pa.array(rows[again])).to_pylist()], pa.large_list(pa.large_string()))
                todo += [(rows[again], careful), (rows[fine], split.take(pa.array(fine)))]
                continue
            codes[unknown] = len(cache.known) + fresh.indices.to_numpy()
            cache.learn(fresh.dictionary)
        cache.met += np.bincount(codes, minlength=len(cache.met))
        n = cache.sizes[codes]
        ends = np.cumsum(n)
        at = (np.cumsum(cache.sizes) - cache.sizes)[codes]
        found = cache.ids[np.repeat(at - (ends - n), n) + np.arange(int(ends[-1]))]
        edges = np.r_[(ends - n)[starts], len(found)]
        for row, a, b in zip(rows.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            out[row] = found[a:b]
        cache.trim()
    return out


FILE_SCHEMA = "part int, seg int, n_ids long, doc_ids array<long>, lengths array<int>, payload binary"


def _write_segments(source: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    cache = encoder(path)
    end = np.array([end_id], "<u4")
    docs: list[int | None] = []
    held: list[np.ndarray] = []
    total, seg, part = 0, 0, 0

    def segment() -> pa.RecordBatch:
        ids = np.concatenate(held)
        row = {"part": [part], "seg": [seg], "n_ids": [len(ids)], "doc_ids": [docs], "lengths": [[len(x) for x in held]], "payload": [WaveletMatrix.build(ids).to_bytes()]}
        kinds = {"part": pa.int32(), "seg": pa.int32(), "n_ids": pa.int64(), "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int32()), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(row[k], t) for k, t in kinds.items()], list(kinds))

    for rows in batches(source, BATCH_BYTES):
        for doc, one, part in zip(rows.column("doc_id").to_pylist(), encode_texts(rows.column("text").combine_chunks(), cache), rows.column("part").to_pylist(), strict=True):  # noqa: B020
            docs.append(doc)
            held.append(np.concatenate([one, end]))
            total += len(one) + 1
            if total >= SEGMENT_IDS:
                yield segment()
                docs, held, total, seg = [], [], 0, seg + 1
    if docs:
        yield segment()


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Bound the bytes that reach a worker at once, whatever the rows' lengths; Spark bounds their number alone so low."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, shards: int) -> None:
    """Encode every whole text and write the shard files, in ascending ``doc_id`` order."""
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = ranged.repartitionByRange(shards, F.col("doc_id").asc()).sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    files = ranged.mapInArrow(tidy(lambda it: _write_segments(it, tokenizer_path, end_id)), FILE_SCHEMA)
    with arrow_batches(docs.sparkSession, ARROW_BYTES):
        files.write.option("compression", "none").parquet(path)


def _read_segments(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "seg", "idx", "doc_id", "before", "n_tokens", "ids_crc32"]
    for batch in source:
        for row in batch.to_pylist():
            ids = WaveletMatrix.from_bytes(row["payload"]).decode().astype("<u4", copy=False)
            raw, n = memoryview(ids).cast("B"), len(row["lengths"])
            ends = np.cumsum(row["lengths"])
            starts = ends - row["lengths"]
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array([row["seg"]] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64())], names)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: its start among all ids, its token count and the CRC of its ids.

    Offsets are summed in two levels, shard then segment, from the small columns alone.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = files.select("part", "seg", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    parts = parts.select("part", (F.sum("part_ids").over(Window.orderBy("part")) - F.col("part_ids")).alias("part_start"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seg")) - F.col("n_ids")
    offsets = sizes.withColumn("seg_start", inside).join(parts, "part").select("part", "seg", (F.col("part_start") + F.col("seg_start")).alias("offset"))
    decoded = files.select("part", "seg", "doc_ids", "lengths", "payload").mapInArrow(tidy(_read_segments), "part int, seg int, idx int, doc_id long, before long, n_tokens long, ids_crc32 long")
    return decoded.join(offsets, ["part", "seg"]).select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the documents' ids as wavelet-matrix shards, read the files back and report per document."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    write_token_files(docs, path, tokenizer_path, end_id, max(1, -(-int(total) // shard_bytes)))
    return read_token_files(spark, path)
