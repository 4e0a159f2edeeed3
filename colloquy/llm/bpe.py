"""Byte-pair encoding and decoding with a given public vocabulary (operator 2).

Method: a contiguous rank array. A word's parts and the ranks of its adjacent pairs stand in two short
lists; the smallest rank is found by a scan, its boundary deleted, and the two neighbouring ranks
refreshed. A scan per merge is quadratic, so words of more than ``LONG_WORD`` symbols take the same merges
from a heap over a linked list.

The vocabulary file is a parameter; it is read on the driver and broadcast, its size fixed by the file.
"""

from __future__ import annotations

import functools
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, free_names

LONG_WORD = 96
#: Words whose encoding a Python worker remembers in each of two generations.
REMEMBERED = 90_000
_NEVER = 1 << 60
#: Characters with Unicode's White_Space property (fixed values).
_WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_WHITE_SPLIT = regex.compile(f"[{_WHITE}]+")
#: Characters that str.split() takes for white space and Unicode does not.
_SEPARATORS = regex.compile("[\x1c-\x1f]")


@functools.cache
def character_tables() -> tuple[dict[str, str], dict[int, str]]:
    """(insides of the classes of letters and of numbers, lower cases that differ from Python's), as the library has them.

    The library, ``regex`` and Python each follow a Unicode version of their own, so the library is asked about every
    code point. Where it is not installed, the other two's tables serve.
    """
    try:
        from tokenizers import Regex, normalizers, pre_tokenizers
    except ImportError:
        return {kind: rf"\p{{{kind}}}" for kind in "LN"}, {}
    # Block by block: asked for all code points at once, the library takes hundreds of MB of the driver.
    blocks = [[chr(c) for c in range(k, k + 4096) if not 0xD800 <= c < 0xE000] for k in range(0, 0x110000, 4096)]
    blocks, classes = [b for b in blocks if b], {}
    for kind in "LN":
        split, runs = pre_tokenizers.Split(Regex(rf"\p{{{kind}}}+"), "removed", invert=True), []
        for block in blocks:
            for run, _ in split.pre_tokenize_str("".join(block)):
                if runs and ord(run[0]) == ord(runs[-1][1]) + 1:
                    runs[-1][1] = run[-1]
                else:
                    runs.append([run[0], run[-1]])
        classes[kind] = "".join(f"{regex.escape(first)}-{regex.escape(last)}" for first, last in runs)
    low, differ = normalizers.Lowercase(), {}
    for block in blocks:
        if low.normalize_str("".join(block)) != "".join(block).replace("Σ", "σ").lower():
            differ |= {ord(c): x for c in block if (x := low.normalize_str(c)) != c.replace("Σ", "σ").lower()}
    return classes, differ


def with_characters(spec: str) -> str:
    """A vocabulary file's text with the character tables in it, so that workers need not ask the library."""
    classes, lower = character_tables()
    return json.dumps(json.loads(spec) | {"characters": [classes, lower]})


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a lower-casing byte-level vocabulary with an end-of-word mark."""

    def __init__(self, spec: str):
        loaded = json.loads(spec)
        model = loaded["model"]
        vocab, self.mark = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in loaded["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        spelled = loaded["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", _WHITE)
        classes, lower = loaded.get("characters") or character_tables()
        self.lower = {int(c): x for c, x in lower.items()}
        for kind, inside in classes.items():
            # Inside of a set the ranges alone stand for the class.
            spelled = regex.sub(r"\[[^\]]*\]", lambda m: m[0].replace(rf"\p{{{kind}}}", inside), spelled).replace(rf"\p{{{kind}}}", f"[{inside}]")
        self.pattern = regex.compile(spelled)
        self.lowered = regex.compile(f"[{''.join(map(chr, self.lower))}]") if self.lower else None
        #: Rank of a pair of ids, and the id that each rank's merge gives.
        self.ranks = {vocab[a] << 20 | vocab[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.merged = [vocab[a + b] for a, b in model["merges"]]
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + self.mark] for s in symbols]
        #: Encodings met lately and before that; pieces in use move back to the young ones.
        self.young: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}

    def word(self, word: str) -> list[int]:
        raw = word.encode()
        parts = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        return self._merge_long(parts) if len(parts) > LONG_WORD else self._merge_short(parts)

    def _merge_short(self, parts: list[int]) -> list[int]:
        rank_of, merged = self.ranks.get, self.merged
        ranks = [rank_of(a << 20 | b, _NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NEVER:
                break
            i = ranks.index(least)
            parts[i] = new = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 20 | new, _NEVER)
            if i < len(ranks):
                ranks[i] = rank_of(new << 20 | parts[i + 1], _NEVER)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, rank_of = len(parts), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank_of(parts[i] << 20 | parts[i + 1], _NEVER)) < _NEVER]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue  # one side was merged meanwhile
            parts[i], parts[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (r := rank_of(parts[left] << 20 | parts[right], _NEVER)) < _NEVER:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def _chunk(self, chunk: str) -> bytes:
        """A chunk between white space that is not in the young memory."""
        found = self.aged.get(chunk)
        if found is None:
            head = chunk[:-1]
            if head.isalpha() and not chunk.isalpha() and chunk[-1].isascii():
                pieces = [head, chunk[-1]]  # a word and one mark: most such words were met before
            elif chunk.isalpha():
                return self._remember(chunk, self.word(chunk))
            else:
                pieces = self.pattern.findall(chunk)
            return b"".join([self.young.get(p) or self.aged.get(p) or self._remember(p, self.word(p)) for p in pieces])
        return self._keep(chunk, found)

    def _remember(self, piece: str, ids: list[int]) -> bytes:
        return self._keep(piece, pack(ids))

    def _keep(self, piece: str, found: bytes) -> bytes:
        if len(self.young) >= REMEMBERED:
            self.aged, self.young = self.young, {}
        self.young[piece] = found
        return found

    def _plain(self, text: str) -> list[bytes]:
        text = unicodedata.normalize("NFC", text)
        if self.lowered and not text.isascii() and self.lowered.search(text):
            text = text.translate(self.lower)
        text = text.replace("Σ", "σ").lower()  # each capital on its own: no final sigma
        pieces = _WHITE_SPLIT.split(text) if _SEPARATORS.search(text) else text.split()
        new = self._chunk
        return [self.young.get(p) or new(p) for p in pieces if p]

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit integers, their decoding) of a whole text."""
        text = text or ""
        if self.split_special is None or not any(s in text for s in self.special):
            found = self._plain(text)
        else:
            found = []
            for part in self.split_special.split(text):
                found += [pack([self.special[part]])] if part in self.special else self._plain(part)
        ids = b"".join(found)
        return ids, self.decode(np.frombuffer(ids, "<u4").tolist())

    def decode(self, ids) -> str:
        """Tokens of the ids, special ones included, separated by spaces: the vocabulary names no other decoder."""
        return " ".join([t for t in map(self.tokens.get, ids) if t is not None])


_LOADED: dict[int, WordBpe] = {}


def loaded(spec: str) -> WordBpe:
    """The worker's encoder for a vocabulary; it and its memory serve later tasks too."""
    key = hash(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(spec)
    return _LOADED[key]


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def bpe_encode(df: DataFrame, vocab_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns plus n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded (the ids' decoding).

    Null and empty texts have no ids and decode to the empty string. Texts are never cut. Row by row: no shuffle, repeated
    rows are coded alike, an empty table gives an empty one. Where the caller has a column of one of those three names,
    the new one has an underscore after it. ``decoded`` is what ``bpe_decode`` makes of the ids.
    """
    keep = df.columns if keep is None else keep
    inner, out = [f"_k{i}" for i in range(len(keep))], ("n_tokens long", "ids binary", "decoded string")
    source = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, inner)], F.col(f"`{text}`").alias("_text"))
    spec = df.sparkSession.sparkContext.broadcast(with_characters(open(vocab_path, encoding="utf-8").read()))
    types = dict(source.dtypes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch in batches:
            kept = [batch.column(i) for i in range(len(inner))]
            texts = batch.column(len(inner))
            at = 0
            while at < len(texts):
                ids, decoded, size, start = [], [], 0, at
                while at < len(texts) and size < 8 << 20:
                    a, b = bpe.encode(texts[at].as_py())
                    ids.append(a)
                    decoded.append(b)
                    size += len(a) + len(b)
                    at += 1
                yield pa.RecordBatch.from_arrays(
                    [*(k.slice(start, at - start) for k in kept), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                    names=[*inner, "n_tokens", "ids", "decoded"],
                )

    done = source.mapInArrow(encode, ", ".join([*(f"{k} {types[k]}" for k in inner), *out]))
    new = zip(("n_tokens", "ids", "decoded"), free_names(keep, "n_tokens", "ids", "decoded"))
    return done.select(*[F.col(k).alias(c) for c, k in zip(keep, inner)], *[F.col(c).alias(to) for c, to in new])


def bpe_decode(df: DataFrame, vocab_path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` plus the decoding of its packed ids; null ids decode to the empty string."""
    spec = df.sparkSession.sparkContext.broadcast(with_characters(open(vocab_path, encoding="utf-8").read()))

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = loaded(spec.value)
        for packed in batches:
            yield packed.map(lambda b: bpe.decode(v for (v,) in struct.iter_unpack("<I", b or b"")))

    return df.withColumn(to, decode(F.col(ids)))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of ids and decodings of all documents: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = bpe_encode(documents(spark, sf_dir), default_vocabulary(), keep=["doc_id"])
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
