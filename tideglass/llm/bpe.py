"""Encoding of texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: how the public vocabulary cuts a text into words before merging.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words remembered per task; beyond it the memory starts anew, so long tasks stay small.
REMEMBERED = 400_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files of this kind."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merges:
    """A vocabulary's merges as arrays: ids of the left and right part and of the merged token, by rank."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], dtype=np.int32)
        self.right = np.array([ids[b] for _, b in pairs], dtype=np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        letters = byte_letters()
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for letter, b in letters.items():
            self.byte_ids[b] = ids[letter]


class PairIndexEncoder:
    """Encodes many words at once over an index of pair occurrences.

    All words lie one after the other as linked symbols. The index maps each mergeable pair, by its
    rank, to all its positions. The active ranks are applied in ascending order: a rank's
    positions are merged from left to right, and each merge puts the pairs it forms with its
    neighbours into the lists of their ranks. A merged token only takes part in merges of higher
    rank, so when a rank is applied its list is complete, for every word at once, and the result is
    that of merging each word by itself. A position whose symbols have changed since is skipped.
    """

    def __init__(self, merges: Merges):
        self.left, self.right, self.merged = merges.left.tolist(), merges.right.tolist(), merges.merged.tolist()
        self.rank = {(a << 20) | b: r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        self.byte_ids = merges.byte_ids.tolist()
        self.words: dict[str, list[int]] = {}
        self.cut = regex.compile(WORDS).findall

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode("utf-8") for w in words]
        symbol = [self.byte_ids[b] for w in raw for b in w]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ends, at = [], 0
        for w in raw:
            before[at] = -1
            at += len(w)
            ends.append(at)
            after[at - 1] = -1
        rank, places = self.rank, {}
        for i in range(n):
            j = after[i]
            if j >= 0:
                r = rank.get((symbol[i] << 20) | symbol[j])
                if r is not None:
                    places.setdefault(r, []).append(i)
        active = list(places)
        heapify(active)
        while active:
            r = heappop(active)
            a, b, new = self.left[r], self.right[r], self.merged[r]
            for i in sorted(places.pop(r)):
                j = after[i]
                if symbol[i] != a or j < 0 or symbol[j] != b:
                    continue
                k, h = after[j], before[i]
                symbol[i], symbol[j], after[i] = new, -1, k
                if k >= 0:
                    before[k] = i
                    q = rank.get((new << 20) | symbol[k])
                    if q is not None:
                        if q not in places:
                            places[q] = []
                            heappush(active, q)
                        places[q].append(i)
                if h >= 0:
                    q = rank.get((symbol[h] << 20) | new)
                    if q is not None:
                        if q not in places:
                            places[q] = []
                            heappush(active, q)
                        places[q].append(h)
        out, at = [], 0
        for end in ends:
            out.append([s for s in symbol[at:end] if s >= 0])
            at = end
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the offsets of each text; null and empty texts have none."""
        cut = [self.cut(t) if t else [] for t in texts]
        known = self.words
        if len(known) > REMEMBERED:
            known.clear()
        fresh = list({w for words in cut for w in words if w not in known})
        known.update(zip(fresh, self.encode_words(fresh), strict=True))
        flat: list[int] = []
        offsets = np.zeros(len(texts) + 1, dtype=np.int32)
        for k, words in enumerate(cut):
            for w in words:
                flat += known[w]
            offsets[k + 1] = len(flat)
        return np.array(flat, dtype=np.int32), offsets


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most_bytes`` of text, at least one row each."""
    size = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
    lo = 0
    while lo < batch.num_rows:
        base = size[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(size, base + most_bytes, side="right")), lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def encoded(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` of each row's text, without special tokens; their strings are ordinary text.

    Whole texts of any length; null and empty texts give an empty list. Rows are independent: no
    exchange, and a task holds a few MB of text at a time. The merges (a fixed 0.6 MB) are read
    where the query is planned and travel with the task. Repeated keys give repeated rows.
    """
    merges = Merges(vocabulary)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PairIndexEncoder(merges)
        for whole in batches:
            for batch in pieces(whole, "text"):
                ids, offsets = encoder.encode(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(kernel, f"`{key}` {kind}, ids array<int>")
