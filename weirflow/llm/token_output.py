"""Token-ID output: documents as Parquet list columns of token ids, and selective reads of them.

Files hold documents in ascending doc_id order. Row groups and pages are kept small enough that page
indexes let a reader skip to single documents; ids are dictionary- or delta-encoded.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import shared_path
from .texts import raw_texts, slices, small_batches

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
#: Words after which a worker's cache begins anew.
CACHE_WORDS = 1 << 19


#: Latin and Cyrillic letters beyond ASCII that normal form C keeps and whose lower case is one of them.
_MORE = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u0400-\u0481\u048a-\u052f"
_PLAIN = re.compile(f"[!-~{_MORE}]+").fullmatch
_LETTERS, _NUMBERS = r"\p{L}", r"\p{N}"
#: Byte-level characters: bytes that show stand for themselves, the others for 256 and what follows, in order.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - _SHOWN))}


def word_pattern(tokenizer: dict) -> tuple[re.Pattern, bool] | None:
    """How a tokenizer's file parts a word of ASCII and `_MORE`, and whether it lowers it first; None where words
    can't be encoded apart.

    They can if all the normalizer does is NFC, white space to one space and lower case, if the
    pre-tokenizer keeps matches of a pattern that excludes white space, byte by byte, and if special tokens
    are plain strings without white space."""
    normalizer, pre = tokenizer.get("normalizer") or {}, tokenizer.get("pre_tokenizer") or {}
    steps = normalizer.get("normalizers", [normalizer] if normalizer else [])
    for step in steps:
        space = step["type"] == "Replace" and step["pattern"] == {"Regex": r"\s+"} and step["content"] == " "
        if not space and step["type"] not in ("NFC", "Lowercase"):
            return None
    parts = pre.get("pretokenizers", [])
    if [x["type"] for x in parts] != ["Split", "ByteLevel"] or tokenizer["model"]["type"] != "BPE" or tokenizer["model"].get("dropout"):
        return None
    split, level = parts
    if split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or level["use_regex"]:
        return None
    for added in tokenizer["added_tokens"]:
        if added["single_word"] or added["lstrip"] or added["rstrip"] or added["normalized"] or added["content"].split() != [added["content"]]:
            return None
    source = split["pattern"].get("Regex", "").replace(_LETTERS, f"A-Za-z{_MORE}").replace(_NUMBERS, "0-9")
    branches = source.split("|")
    known = f"[A-Za-z{_MORE}]+", "[0-9]", "[0-9]+", f"[^\\sA-Za-z{_MORE}0-9]+"
    if not all(x in known or re.fullmatch("'[a-z]+", x) for x in branches):
        return None
    return re.compile(source), any(step["type"] == "Lowercase" for step in steps)


class _Pieces(dict):
    """Ids of the pieces that a pre-tokenizer leaves, made as they are met."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self[piece] = tuple([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_BYTES))])
        return ids


def gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of `flat` that begin and have the sizes given, one after another."""
    first = np.repeat(begin - (np.cumsum(size) - size), size)
    return flat[first + np.arange(len(first))]


class WordCache:
    """Token ids of texts, by word where the tokenizer never joins across ASCII white space.

    Encoding a text word by word then gives the ids of the whole text. Each distinct word is encoded once,
    a plain word through the distinct pieces that the pre-tokenizer leaves of it, and ids are gathered by
    array indexing. With any other tokenizer whole texts are encoded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.by_word = word_pattern(described)
        special = [re.escape(x["content"]) for x in described["added_tokens"]]
        self.special = re.compile("|".join(special) or "(?!)").search
        self.pieces = _Pieces(self.encoder.model)
        self.index: defaultdict[bytes, int] = defaultdict()
        self.flat, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.clear()

    def clear(self) -> None:
        """Begin anew with the words met more than once since the last time."""
        kept = [w for w, often in zip(self.index, self.met > 1, strict=True) if often] if self.index else []
        if len(kept) > CACHE_WORDS // 2:
            kept = []
        at = np.array([self.index[w] for w in kept], np.int64)
        # a word that is not there yet gets the next number
        self.index = defaultdict(count(len(kept)).__next__, zip(kept, range(len(kept)), strict=True))
        self.size = self.size[at]
        self.flat = gathered(self.flat, self.begin[at], self.size)
        self.begin = np.cumsum(self.size) - self.size
        self.met = np.zeros(len(kept), np.int64)
        self.pieces.clear()

    def learn(self, new: list[bytes]) -> None:
        """Encode the words that were last numbered."""
        (pattern, lower), slow, flat, ends = self.by_word, [], [], []
        split, pieces, special = pattern.findall, self.pieces, self.special
        for n, w in enumerate(map(bytes.decode, new)):
            if _PLAIN(w) and not special(w):
                for piece in split(w.lower() if lower else w):
                    flat += pieces[piece]
            else:
                slow.append(n)
            ends.append(len(flat))
        size = np.diff(np.array([0, *ends], np.int64))
        begin = np.array(ends, np.int64) - size
        if slow:
            got = [e.ids for e in self.encoder.encode_batch_fast([new[n].decode() for n in slow], add_special_tokens=False)]
            size[slow] = np.fromiter(map(len, got), np.int64)
            begin[slow] = len(flat) + np.cumsum(size[slow]) - size[slow]
            flat += chain.from_iterable(got)
        self.begin = np.concatenate([self.begin, len(self.flat) + begin])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.array(flat, np.int32)])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, `end` after each, and the number of ids of each."""
        if self.by_word is None:
            got = [[*e.ids, end] for e in self.encoder.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(got), np.int32), np.array([len(g) for g in got], np.int64)
        split = [t.split() for t in texts]
        if len(self.index) > CACHE_WORDS:
            self.clear()
        before = len(self.index)
        words = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64)
        if len(self.index) > before:
            self.learn(list(islice(reversed(self.index), len(self.index) - before))[::-1])
        self.met += np.bincount(words, minlength=len(self.met))
        sizes = self.size[words]
        last = np.cumsum(np.array([len(s) for s in split], np.int64))
        per_text = np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(sizes)])[last]]))
        ids = gathered(self.flat, self.begin[words], sizes)
        return np.insert(ids, np.cumsum(per_text), end).astype(np.int32), per_text + 1


@lru_cache(maxsize=2)
def _cache(path: str) -> WordCache:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordCache(path)


def _encode(path: str, end: int):
    def run(batches):
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch):
                ids, sizes = _cache(path).encode(raw_texts(piece), end)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": piece.column("doc_id"),
                        "part": pa.array(np.full(len(sizes), part, np.int32)),
                        "part_start": pa.array(start + offsets[:-1]),
                        "n_tokens": pa.array(sizes),
                        "ids": pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids)),
                    }
                )
                start += int(offsets[-1])

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 2, encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000) -> None:
    """Encode every whole text of (doc_id, text) and write ascending doc_id over ascending part files.

    `tokenizer` is a file of the tokenizers library; `end` closes each document. `encoding` is dictionary,
    or delta for DELTA_BINARY_PACKED ids. Null and empty texts have the end id alone; a null doc_id comes
    first; rows with one doc_id are ordered by text. Each file row has its place among its file's ids."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    rows = small_batches(docs).select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    kind = {"parquet.enable.dictionary": "true"} if encoding == "dictionary" else {"parquet.enable.dictionary": "false", "parquet.writer.version": "v2"}
    sizes = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows, "compression": "zstd"}
    rows.mapInArrow(_encode(tokenizer, end), SCHEMA).write.options(**kind, **sizes).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows. Selecting columns reads those alone, and a filter on doc_id or part_start is
    pushed to row groups and pages."""
    return spark.read.schema(SCHEMA).parquet(path)


def starts(tokens: DataFrame) -> DataFrame:
    """(part, before): ids in all files before a part, from the metadata columns alone.

    The window goes over one row for each file."""
    sums = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))


def _digest(batches):
    for batch in batches:
        ids = batch.column("ids")
        offsets, flat = ids.offsets.to_pylist(), ids.values.to_numpy().astype("<u4").tobytes()
        sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:], strict=False)]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "part": batch.column("part"), "part_start": batch.column("part_start"), "n_tokens": pa.array([b - a for a, b in zip(offsets, offsets[1:], strict=False)], pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files' ids."""
    tokens = read(spark, path)
    rows = small_batches(tokens).mapInArrow(_digest, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return rows.join(starts(tokens), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Write all documents to a new folder in the shared one, and return what its files hold."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write(docs, path, tokenizer, end)
    return digests(spark, path)
