"""Huffman codes of symbols: the tree is built from counts of a stated alphabet, coding is a join."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F

#: Symbols whose tree the driver builds.
MAX_SYMBOLS = 1 << 16


def codes(counts: dict[str, int], degree: int = 2) -> dict[str, str]:
    """Code of each symbol in digits 0 to degree - 1, shorter for frequent ones."""
    if not 2 <= degree <= 10:
        raise ValueError("degree is 2 to 10")
    if len(counts) > MAX_SYMBOLS:
        raise ValueError(f"more than {MAX_SYMBOLS} symbols")
    heap = [(n, s, [s]) for s, n in sorted(counts.items())]
    out = {s: "" for s in counts}
    if len(heap) == 1:
        return dict.fromkeys(counts, "0")
    # the first merge may take fewer, so that all later ones are full
    first = (len(heap) - 2) % (degree - 1) + 2
    heapq.heapify(heap)
    while len(heap) > 1:
        taken = [heapq.heappop(heap) for _ in range(min(first, len(heap)))]
        for digit, (_, _, symbols) in enumerate(taken):
            for s in symbols:
                out[s] = str(digit) + out[s]
        heapq.heappush(heap, (sum(t[0] for t in taken), min(t[1] for t in taken), [s for t in taken for s in t[2]]))
        first = degree
    return out


def code_table(df: DataFrame, symbol: str, degree: int = 2) -> DataFrame:
    """(symbol, n, code) of the symbols that occur; null is none."""
    counts = df.where(F.col(symbol).isNotNull()).groupBy(symbol).agg(F.count("*").alias("n")).limit(MAX_SYMBOLS + 1).collect()
    found = codes({r[symbol]: r.n for r in counts}, degree) if counts else {}
    return df.sparkSession.createDataFrame([(r[symbol], r.n, found[r[symbol]]) for r in counts], f"{symbol} string, n long, code string")


def encode(df: DataFrame, symbol: str, by: str, order: str, table: DataFrame) -> DataFrame:
    """(by, bits): each series of symbols as one code string."""
    met = df.join(F.broadcast(table.select(symbol, "code")), symbol)
    listed = met.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, "code"))).alias("_s"))
    return listed.select(by, F.array_join("_s.code", "").alias("bits"))


def decode(bits: str, table: dict[str, str]) -> list[str]:
    """Symbols of one code string."""
    back, out, at = {c: s for s, c in table.items()}, [], ""
    for digit in bits:
        at += digit
        if at in back:
            out.append(back[at])
            at = ""
    if at:
        raise ValueError("the string ends within a code")
    return out
