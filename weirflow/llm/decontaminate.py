"""Benchmark decontamination by spaced seeds.

Fixed masks hash some word positions of a window and ignore the others, so a hit survives substitutions
at the ignored places. Hashes of the benchmark's windows meet those of every document; each hit fixes how
document and item lie on each other, and the longest stretch there with enough equal words is verified.
The benchmark goes out in blocks of bounded size, each against all documents in one narrow pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .texts import FOLD, raw_texts, slices, small_batches

#: Seeds of which 6 words count. Every stretch of 13 words or more with 0.8 equal has one of them all equal.
#: They were found by cover of all 519 patterns of which no shorter part is such a stretch; these have 13,
#: 15, 20 or 25 words, as a stretch of 26 or more can be cut into two of which one has 0.8 equal.
MASKS = ("1101111", "11101000011", "1111011")
#: Words that count in a short item's seed, at least, if the item has as many that must be equal.
SHORT_WEIGHT = 4
#: Text bytes of a benchmark block; a block is what the driver and each task hold at once.
BLOCK_BYTES = 8 << 20
_BITS = 22
_WORDS = bytes(FOLD[b] if chr(b).isalnum() or b > 0x7F else 0x20 for b in range(256))
#: Fixed odd multipliers, one for each place of a window.
_TIMES = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(256)], np.uint64)


@dataclass(frozen=True)
class Overlap:
    """Least words of an overlap (or the whole item if shorter), least equal share, least words of an item.

    The seeds find all overlaps for `words` from 13 to 256 and `same` of 0.8 or more."""

    words: int = 13
    same: float = 0.8
    item: int = 5


def word_ids(raw: bytes) -> np.ndarray:
    """CRC-32 of each word: letters, digits and non-ASCII characters, A-Z lowered."""
    return np.fromiter(map(zlib.crc32, raw.translate(_WORDS).split()), np.uint64)


def window_hashes(ids: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of the mask's places for every window of the mask's length."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt * 0x632BE59BD9B4E019 & (1 << 64) - 1, np.uint64)
    with np.errstate(over="ignore"):
        for k, on in enumerate(mask):
            if on == "1":
                out += ids[k : k + n] * _TIMES[k]
        out ^= out >> np.uint64(29)
        return out * np.uint64(0xBF58476D1CE4E5B9)


def short_masks(n: int, same: float) -> list[str]:
    """Masks of n words of which one is all equal whenever the share `same` of n words is.

    The places are cut into groups, and each mask leaves out as many groups as words may differ."""
    may = int(n * (1 - same) + 1e-9)
    for groups in range(may + 1, n + 1):
        parts = np.array_split(np.arange(n), groups)
        if groups == n or n - sum(sorted(map(len, parts))[groups - may :]) >= SHORT_WEIGHT:
            break
    return ["".join("0" if any(k in parts[g] for g in out) else "1" for k in range(n)) for out in combinations(range(groups), may)]


class Index:
    """Seed hashes of a block of items, with a bitmap before the sorted table."""

    def __init__(self, items: list[tuple[int, bytes]], overlap: Overlap):
        self.overlap, self.keys, self.items = overlap, [], []
        seeds: list[tuple[np.ndarray, int]] = []
        #: an item under `words` words must be there as a whole and has masks of its own length
        self.masks = [(m, s) for s, m in enumerate(MASKS)]
        short: dict[int, list[tuple[str, int]]] = {}
        for key, raw in items:
            ids = word_ids(raw)
            if len(ids) < overlap.item:
                continue
            t = len(self.items)
            self.keys.append(key)
            self.items.append(ids)
            masks, n = self.masks[: len(MASKS)], len(ids)
            if n < overlap.words:
                if n not in short:
                    short[n] = [(m, len(self.masks) + s) for s, m in enumerate(short_masks(n, overlap.same))]
                    self.masks += short[n]
                masks = short[n]
            seeds += [(window_hashes(ids, m, salt), t) for m, salt in masks]
        flat = np.concatenate([h for h, _ in seeds]) if seeds else np.zeros(0, np.uint64)
        item = np.concatenate([np.full(len(h), t) for h, t in seeds]) if seeds else np.zeros(0, np.int64)
        at = np.concatenate([np.arange(len(h)) for h, _ in seeds]) if seeds else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.item, self.at = flat[order], item[order], at[order]
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[self.hashes >> np.uint64(64 - _BITS)] = True

    def hits(self, ids: np.ndarray) -> set[tuple[int, int]]:
        """(item, document place of the item's first word) of each meeting."""
        found = set()
        for mask, salt in self.masks:
            h = window_hashes(ids, mask, salt)
            places = np.flatnonzero(self.bitmap[h >> np.uint64(64 - _BITS)])
            if len(places):
                low, high = np.searchsorted(self.hashes, h[places], "left"), np.searchsorted(self.hashes, h[places], "right")
                for p, a, b in zip(places[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                    found.update((int(self.item[k]), p - int(self.at[k])) for k in range(a, b))
        return found

    def verify(self, ids: np.ndarray, t: int, lag: int) -> tuple[int, int, int, int] | None:
        """Longest stretch with the least equal share: document start, item start, words, equal words."""
        item = self.items[t]
        first, last = max(0, -lag), min(len(item), len(ids) - lag)
        same = ids[first + lag : last + lag] == item[first:last]
        gain = np.where(same, 1 - self.overlap.same, -self.overlap.same)
        sums = np.concatenate([[0.0], np.cumsum(gain)])
        low = np.minimum.accumulate(sums)
        begin = np.searchsorted(-low, -(sums + 1e-9), "left")
        end = int(np.argmax(np.arange(len(sums)) - begin))
        a = int(begin[end])
        if end - a < min(self.overlap.words, len(item)):
            return None
        return first + lag + a, first + a, end - a, int(same[a:end].sum())

    def overlaps(self, raw: bytes) -> Iterator[tuple[int, int, int, int, int]]:
        """Best verified overlap of each item: item key, document start, item start, words, equal words."""
        best: dict[int, tuple[int, int, int, int]] = {}
        ids = word_ids(raw)
        for t, lag in sorted(self.hits(ids)):
            got = self.verify(ids, t, lag)
            if got and (t not in best or got[2:] > best[t][2:]):
                best[t] = got
        for t, got in best.items():
            yield self.keys[t], *got


def blocks(benchmark: DataFrame, overlap: Overlap) -> Iterator[Index]:
    """Indexes over parts of (item_id, text) of about BLOCK_BYTES each, dealt by a hash of the item."""
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield Index([(r.item_id, r.text.encode()) for r in block], overlap)


def contaminated(docs: DataFrame, benchmark: DataFrame, overlap: Overlap = Overlap()) -> DataFrame:
    """Overlaps of every row of (doc_id, text) with every item of (item_id, text); others are ignored.

    Returns doc_id, item_id, doc_start, item_start, n_words, n_same (places and words, from 0): the longest
    overlap of each document row and item that has at least `overlap.words` words (the whole item if it has
    fewer) of which `overlap.same` are equal. Items under `overlap.item` words say nothing and are not
    searched for. Null and empty texts overlap nothing; repeated rows are each reported; an empty
    benchmark gives no rows. Narrow: only the benchmark moves, block by block."""
    spark, out = small_batches(docs).sparkSession, None
    schema = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_same long"
    for index in blocks(benchmark, overlap):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                for part in slices(batch):
                    ids = part.column("doc_id").to_pylist()
                    rows = [(i, *o) for i, raw in zip(ids, raw_texts(part), strict=True) for o in shared.value.overlaps(raw)]
                    columns = list(zip(*rows, strict=True)) or [[]] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in schema.split(", ")])

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, overlap: Overlap = Overlap()) -> DataFrame:
    """The rows of `docs`, all columns, that overlap no item. Narrow."""
    small_batches(docs)
    for index in blocks(benchmark, overlap):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                for part in slices(batch):
                    yield part.filter(pa.array([next(shared.value.overlaps(raw), None) is None for raw in raw_texts(part)]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
