"""Byte-level BPE encoding and decoding.

A text is cut at added tokens, then into short words by the tokenizer's pattern, and every word is
merged on a contiguous rank array: part boundaries and the rank of each part joined with its right
neighbour. The minimum is found by scanning, its right boundary deleted, and the ranks of the two
neighbours refreshed. Words longer than ``SCAN_BYTES`` (pasted data, rows of dashes) go through a heap
over linked parts instead, which gives the same tokens in n log n.

Spark deals the texts out; a task holds one Arrow batch of texts, the vocabulary (50,000 entries) and a
caches of encodings of at most ``CACHE_WORDS`` entries a generation. No shuffle, nothing on the driver.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wristwave.llm.common import ship

SCAN_BYTES = 256
CACHE_WORDS = 300_000
CACHE_CHARS = 48

# The published pattern of the vocabulary, with white space spelled out.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, by letter."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Cache(dict):
    """Encodings by word, made when first asked for. A full one becomes the older generation, which is looked up once more."""

    def __init__(self, make, size: int = CACHE_WORDS):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class ByteBpe:
    """A vocabulary file: ids by bytes, merge ranks by pair of ids, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.single = [ids[bytes([b])] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks, self.made = {}, []
        for rank, (x, y) in enumerate(pairs):
            self.ranks[ids[raw(x)] << 32 | ids[raw(y)]] = rank
            self.made.append(ids[raw(x) + raw(y)])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: b for b, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.pieces = regex.compile(PATTERN).findall
        self.uneven = re.compile(r"\s\s|^\s|\s$").search
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = Cache(self.word)
        self.spaced = Cache(lambda chunk: tuple(chain.from_iterable(map(self.words.__getitem__, self.pieces(" " + chunk)))))

    def word(self, word: str) -> tuple[int, ...]:
        data = word.encode()
        return tuple(self.scan(data) if len(data) <= SCAN_BYTES else self.heap(data))

    def scan(self, data: bytes) -> list[int]:
        get, none, single = self.ranks.get, len(self.made), self.single
        parts = [single[b] for b in data]
        rank = [get(x << 32 | y, none) for x, y in zip(parts, parts[1:], strict=False)]
        while rank:
            low = min(rank)
            if low == none:
                break
            i = rank.index(low)
            parts[i] = self.made[low]
            del parts[i + 1], rank[i]
            if i:
                rank[i - 1] = get(parts[i - 1] << 32 | parts[i], none)
            if i < len(rank):
                rank[i] = get(parts[i] << 32 | parts[i + 1], none)
        return parts

    def heap(self, data: bytes) -> list[int]:
        n, get = len(data), self.ranks.get
        part = [self.single[b] for b in data]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        queue = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := get(part[i] << 32 | part[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i, x, y = heapq.heappop(queue)
            j = after[i]
            if j < 0 or part[i] != x or part[j] != y:  # out of date
                continue
            part[i], part[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := get(part[left] << 32 | part[right])) is not None:
                    heapq.heappush(queue, (r, left, part[left], part[right]))
        return [p for p in part if p >= 0]

    def plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens.

        Where single spaces stand between other characters, a word begins at each of them, so such texts are
        cut at spaces and a chunk's ids are looked up at once; other texts go through the pattern.
        """
        if self.uneven(text):
            return list(chain.from_iterable(map(self.words.__getitem__, self.pieces(text))))
        chunks = text.split(" ")
        first = map(self.words.__getitem__, self.pieces(chunks[0]))
        return list(chain(chain.from_iterable(first), chain.from_iterable(map(self.spaced.__getitem__, chunks[1:]))))

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not any(t in text for t in self.added):
            return self.plain(text)
        out: list[int] = []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                out.append(self.added[part])
            else:
                out += self.plain(part)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")


@cache
def tokenizer(path: str) -> ByteBpe:
    """One per worker process; it reads the file from the worker's own installation."""
    return ByteBpe(path)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, text: str = "text", name: str = "byte_bpe_50k.json", ids: str = "ids") -> DataFrame:
    """Every column of the table and the token ids of ``text`` (null: no ids).

    Empty text gives an empty array. Rows are handled one by one, so repeated rows, ties and null keys
    pass through. A column called ``ids`` is replaced.
    """
    ship(docs.sparkSession)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = tokenizer(vocabulary(name))
        for batch in texts:
            yield pd.Series([bpe.encode(t or "") for t in batch], dtype=object)

    return docs.withColumn(ids, F.pandas_udf(run, "array<int>")(F.col(text)))


def decode(docs: DataFrame, ids: str = "ids", name: str = "byte_bpe_50k.json", text: str = "decoded") -> DataFrame:
    """Every column of the table and the text of the token ids (null ids: empty text)."""
    ship(docs.sparkSession)

    def run(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = tokenizer(vocabulary(name))
        for batch in arrays:
            yield pd.Series(["" if x is None else bpe.decode(x.tolist() if hasattr(x, "tolist") else x) for x in batch], dtype=object)

    return docs.withColumn(text, F.pandas_udf(run, "string")(F.col(ids)))


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k.json") -> DataFrame:
    """Key, token count and the digests of ids and decoded text, in one pass over each batch.

    The ids of one text at a time are held. Null text counts as empty; null and repeated keys stay as they are.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(vocabulary(name))
        numbers = {i: str(i) for i in bpe.bytes}
        for batch in batches:
            rows = []
            for t in batch["text"]:
                ids = bpe.encode(t or "")
                rows.append((
                    len(ids),
                    hashlib.sha256(",".join(map(numbers.__getitem__, ids)).encode()).hexdigest(),
                    hashlib.sha256(bpe.decode(ids).encode()).hexdigest(),
                ))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "key", batch["key"])
            yield out

    narrow = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    done = narrow.mapInPandas(run, "key string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return done.select(F.col("key").cast(docs.schema[key].dataType).alias(key), "n_tokens", "ids_sha256", "decoded_sha256")
