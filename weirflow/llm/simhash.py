"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two values within two bits share a variant within one bit, so every distinct value emits itself and its
one-bit neighbours, and values that meet on a variant are close. `near_duplicates` links 64-bit
fingerprints within two bits. `similar_texts` uses bands of 32 bits to find candidates for a Jaccard
similarity of shingles and verifies these. Distinct fingerprints or texts stand for all their documents
throughout.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import connected_components, drop_table, materialize, unused
from .texts import FOLD, map_texts, raw_texts

#: Shingles and texts whose bits are counted at once.
_CHUNK, _TEXTS = 1 << 16, 512
#: Bands whose variants, 33 of each value, are shuffled at once; those of the others are not on disk then.
_AT_ONCE = 6
#: The eight bits of each byte, lowest first.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def _mix(h: np.ndarray, n: int) -> np.ndarray:
    """The n-th further hash of a hash."""
    if not n:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes the 64 bits that are set in over half of it; 0 for an empty run.

    Each text's bytes are counted by place and value; a product with the bits of a byte adds them up."""
    text = np.repeat(np.arange(len(counts)) * 2048, counts)
    cells = hashes.view(np.uint8).reshape(-1, 8) + (text[:, None] + np.arange(0, 2048, 256))
    seen = np.bincount(cells.ravel(), minlength=2048 * len(counts)).reshape(-1, 256)
    bits = (seen @ _BYTE_BITS).reshape(len(counts), 64)
    return np.packbits(2 * bits > counts[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def majorities(found: Sequence[np.ndarray], mixes: Sequence[int]) -> np.ndarray:
    """Fingerprints (text, mix) of texts' shingle hashes, one for each further hash of these."""
    sigs, begin, size = [np.zeros((0, len(mixes)), np.uint64)], 0, 0
    for n, f in enumerate(found, 1):
        size += len(f)
        if size >= _CHUNK or n - begin >= _TEXTS or n == len(found):
            hashes, counts = np.concatenate(found[begin:n]), np.array([len(p) for p in found[begin:n]])
            sigs.append(np.stack([_majority(_mix(hashes, j), counts) for j in mixes], axis=1))
            begin, size = n, 0
    return np.concatenate(sigs)


def shingle_hashes(raw: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle of a text with A-Z lowered, repeats included."""
    words = raw.translate(FOLD).split()
    grams = zip(*(words[i:] for i in range(k)), strict=False) if len(words) > k else [words] if words else []
    return np.array(list(map(partial(xxhash.xxh64_intdigest, seed=42), map(b" ".join, grams))), np.uint64)


def text_hashes(batch: pa.RecordBatch) -> pa.Array:
    """Spark's xxhash64 of the texts."""
    whole = [42 if t is None else xxhash.xxh64_intdigest(t, seed=42) for t in batch.column("text").cast(pa.binary()).to_pylist()]
    return pa.array(np.array(whole, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fingerprint): 64 bits over the k-word shingles of every whole text."""

    def kernel(batch: pa.RecordBatch) -> dict:
        sigs = majorities([shingle_hashes(t, k) for t in raw_texts(batch)], [0])
        return {"doc_id": batch.column("doc_id"), "fingerprint": pa.array(sigs[:, 0].view(np.int64))}

    return map_texts(docs, ("doc_id", "text"), kernel, "doc_id long, fingerprint long")


def near_values(values: DataFrame) -> DataFrame:
    """Pairs (lo, hi) that link all 64-bit values of (value) within two differing bits.

    What meets on a variant is kept as a mask of flipped bits, so a group needs a few bytes whatever its
    size, and each variant links what meets there to the smallest of it. Any two that meet are within two
    bits, so no pair within a group needs to be listed to keep all links; at most 65 values meet."""
    spark = values.sparkSession
    n = max(spark.sparkContext.defaultParallelism, -(-values.count() // 60_000))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    flip = F.when(F.col("i") < 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, i)"))
    emitted = values.select("value").repartition(n, "value").select("value", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("i"))
    met = (
        emitted.select(F.col("value").bitwiseXOR(flip).alias("variant"), flip.alias("flip"), (F.col("i") < 0).alias("own"))
        .repartition(n, "variant")
        .groupBy("variant")
        .agg(F.bit_or("flip").alias("mask"), F.max("own").alias("own"))
        .where(F.bit_count("mask") + F.col("own").cast("int") > 1)
    )
    at = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("mask").bitwiseAND(bit(i)) != 0)
    members = F.transform(at, lambda i: F.col("variant").bitwiseXOR(bit(i)))
    members = F.when(F.col("own"), F.concat(members, F.array("variant"))).otherwise(members)
    return met.select(F.array_min(members).alias("lo"), F.explode(members).alias("hi")).where("lo != hi").distinct()


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def components(prints: DataFrame) -> DataFrame:
    """Each row of a table (doc_id, fingerprint), and its component_id.

    Fingerprints within two differing bits are linked; component_id is the smallest doc_id that a row with a
    fingerprint reached has. Rows of one doc_id with several fingerprints are not linked by that. A
    fingerprint that only rows of a null doc_id have gets a null component and links nothing."""
    values = materialize(prints.where("doc_id is not null").groupBy(F.col("fingerprint").alias("value")).agg(F.min("doc_id").alias("first")), "prints")
    roots = connected_components(near_values(values).select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    rooted = values.join(roots, values["value"] == roots["node"], "left").select("value", "first", F.coalesce("root", "value").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    owner = rooted.join(least, "root").select(F.col("value").alias("fingerprint"), "component_id")
    return prints.join(owner, "fingerprint", "left").select("doc_id", "fingerprint", "component_id")


def near_duplicates(docs: DataFrame, k: int = 3) -> DataFrame:
    """Near-duplicate components of every row of (doc_id, text); other columns are ignored.

    Returns doc_id, fingerprint and component_id. Null and empty texts have fingerprint zero and link like any
    other; texts of fewer than k words have their whole sequence as shingle. Repeated rows each get their
    row. All links within two bits are found. An empty table gives an empty result."""
    return components(materialize(fingerprints(docs, k), "fingerprints"))


def shingle_set(raw: bytes, k: int) -> np.ndarray:
    """64-bit hashes of a text's distinct k-word shingles with A-Z lowered, sorted; fewer words are one shingle."""
    ids = np.fromiter(map(zlib.crc32, raw.translate(FOLD).split()), np.uint64)
    if not len(ids):
        return ids
    k = min(k, len(ids))
    out = np.full(len(ids) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for n in range(k):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + ids[n : len(ids) - k + 1 + n]
    return np.unique(_mix(out, 1))


@dataclass(frozen=True)
class Near:
    """k: words of a shingle; bands of 32 bits; similarity: least Jaccard similarity of linked texts' shingles.

    At a similarity of exactly 0.8 a bit differs with probability 0.15, a band comes within two bits with
    0.12 and one of 24 does with 0.95. Two texts without relation come within two bits in a band with 1.2e-7, so
    chance meetings number less than texts up to some ten million of these."""

    k: int = 5
    bands: int = 24
    similarity: float = 0.8
    hubs: int = 8

    @property
    def most_bits(self) -> int:
        """Differing bits beyond which a pair isn't compared: six standard deviations above the mean."""
        n = 32 * self.bands
        p = math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi
        return int(n * p + 6 * math.sqrt(n * p * (1 - p)))


def _bands_kernel(near: Near):
    def run(batch: pa.RecordBatch) -> dict:
        sigs = majorities([shingle_set(t, near.k) for t in raw_texts(batch)], range(2, near.bands // 2 + 2))
        flat = np.stack([sigs & np.uint64(0xFFFFFFFF), sigs >> np.uint64(32)], axis=2).reshape(-1).view(np.int64)
        ends = np.arange(len(sigs) + 1, dtype=np.int32) * near.bands
        return {"doc_id": batch.column("doc_id"), "node": text_hashes(batch), "sig": pa.ListArray.from_arrays(ends, pa.array(flat))}

    return run


def _sets_kernel(k: int):
    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t, k) for t in raw_texts(batch)]
        ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        return {"node": batch.column("node"), "shingles": pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))}

    return run


def _meet(batches):
    """Sorted keys (band, variant, popularity, flip) to (band, value, hub, popularity): each value that meets
    others on a variant, and the most popular one there. A variant's keys may part over batches."""
    held = np.zeros(0, np.int64)

    def rows(keys: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.append(True, keys[1:] >> 12 != keys[:-1] >> 12)) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(keys)))
        run = np.repeat(size > 1, size)
        last = np.repeat(first + size - 1, size)
        at = np.flatnonzero(run & (np.arange(len(keys)) != last))
        flip = keys & 63
        value = (keys >> 12 & 0xFFFFFFFF) ^ np.where(flip < 32, 1 << (flip & 31), 0)
        columns = [keys[at] >> 44, value[at], value[last[at]], keys[last[at]] >> 6 & 63]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["band", "value", "hub", "pop"])

    for batch in batches:
        keys = np.concatenate([held, batch.column("key").to_numpy()])
        cut = int(np.searchsorted(keys >> 12, keys[-1] >> 12)) if len(keys) else 0
        held = keys[cut:]
        yield rows(keys[:cut])
    yield rows(held)


def parents(values: DataFrame) -> DataFrame:
    """(band, value, parent) over rows (band, value, n): for each value the most popular ones it meets.

    Every value emits itself and its one-bit variants, and what meets on a variant is within two bits. There each
    value is paired with the one that most texts have; of the partners a value so gets, those within two bits of the
    foremost are left out, as they have it for a partner themselves. So around a value that very many
    near copies come close to there is one row for each value, elsewhere every two that meet have one."""
    spark = values.sparkSession
    n = max(spark.sparkContext.defaultParallelism, -(-values.count() // 60_000))
    pop = F.least(F.floor(F.log2("n")), F.lit(63)).cast("long")
    flip = F.col("flip")
    variant = F.col("value").bitwiseXOR(F.when(flip < 32, F.expr("shiftleft(1L, flip)")).otherwise(F.lit(0).cast("long")))
    key = F.shiftleft("band", 44).bitwiseOR(F.shiftleft(variant, 12)).bitwiseOR(F.shiftleft("pop", 6)).bitwiseOR(flip.cast("long"))
    wide = values.select("band", "value", pop.alias("pop")).repartition(n, "band", "value")
    keys = wide.select("band", "value", "pop", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("flip")).select(key.alias("key"))
    met = keys.repartition(n, F.shiftright("key", 12)).sortWithinPartitions("key").mapInArrow(_meet, "band long, value long, hub long, pop long")
    tops = met.groupBy("band", "value").agg(F.max(F.struct("pop", "hub"))["hub"].alias("top"), F.collect_set("hub").alias("hubs"))
    apart = F.filter("hubs", lambda h: (h == F.col("top")) | (F.bit_count(h.bitwiseXOR(F.col("top"))) > 2))
    return tops.select("band", "value", F.explode(apart).alias("parent"))


class _Verifier:
    """Pairs of texts to links: first by their signatures, then by the Jaccard similarity of their shingles."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, near: Near):
        self.docs, self.nodes, self.near = docs, nodes, near

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """Links (a, b) among the rows (a, b)."""
        pairs = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for end in ("a", "b"):
            pairs = pairs.join(self.nodes.select(F.col("node").alias(end), F.col("sig").alias(f"sig_{end}"), F.col("first").alias(f"first_{end}")), end)
        pairs = pairs.where(distance(F.col("sig_a"), F.col("sig_b")) <= self.near.most_bits)
        pairs = materialize(pairs.select("a", "b", "first_a", "first_b"), "nearpairs")
        out = self.similar(pairs)
        drop_table(pairs)
        return out

    def similar(self, pairs: DataFrame) -> DataFrame:
        """Links (a, b) among the rows (a, b, first_a, first_b), which is a table, by their shingles alone."""
        near = self.near
        asked = pairs.select(F.explode(F.array(*(F.struct(F.col(f"first_{e}").alias("doc_id"), F.col(e).alias("node")) for e in "ab"))).alias("x")).select("x.*").distinct()
        texts = self.docs.select("doc_id", F.xxhash64("text").alias("node"), "text").join(asked, ["doc_id", "node"], "left_semi")
        sets = materialize(map_texts(texts, ("node", "text"), _sets_kernel(near.k), "node long, shingles array<long>").dropDuplicates(["node"]), "nearsets")
        for end in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("shingles").alias(f"set_{end}")), end)
        both = F.size(F.array_intersect("set_a", "set_b"))
        union = F.size("set_a") + F.size("set_b") - F.col("both")
        out = materialize(pairs.select("a", "b", "set_a", "set_b", both.alias("both")).where(F.col("both") >= near.similarity * union - 1e-9).select("a", "b"), "similar")
        drop_table(sets)
        return out


def apart(own: DataFrame, close: DataFrame) -> DataFrame:
    """Pairs (a, b, pop) of each text with the foremost of its value, and of that one with those of the parents.

    Rows (band, value, node, root, pop, fore) of `own` have the texts' groups, and pairs within a group are left out
    before they are listed, so a large group that is found already gives none."""
    top = own.where("fore").select("band", "value", F.col("node").alias("b"), F.col("root").alias("root_b"), "pop")
    mine = own.where("not fore").select("band", "value", F.col("node").alias("a"), "root").join(top, ["band", "value"])
    over = top.select("band", F.col("value").alias("parent"), "b", "root_b", "pop")
    theirs = close.join(top.select("band", "value", F.col("b").alias("a"), F.col("root_b").alias("root")), ["band", "value"]).join(over, ["band", "parent"])
    return mine.select("a", "b", "pop", "root", "root_b").unionByName(theirs.select("a", "b", "pop", "root", "root_b")).where("root != root_b").select("a", "b", "pop")


def merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Labels (node, root) of all texts after the links (a, b) of a table joined some. Only groups that grow are gone
    through. The table goes."""
    links = found
    for end in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end)
    links = links.where("root_a != root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    links = materialize(links.distinct(), "links")
    drop_table(found)
    if not links.isEmpty():
        roots = connected_components(links).select(F.col("node").alias("root"), F.col("root").alias("to"))
        labels = materialize(labels.join(roots, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        drop_table(roots)
    drop_table(links)
    return labels


def similar_texts(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """Near-duplicate groups of every row of (doc_id, text); other columns are ignored.

    Returns doc_id, node (Spark's xxhash64 of the text, by which texts are told apart) and component_id, the
    smallest doc_id of the group. Texts are linked whose shingles have a Jaccard similarity of
    `near.similarity` or more, among those that come within two bits in one of the bands; groups are what
    links connect. In a band, the texts of a value are compared with the most popular one of them (whose values are
    shared most in all bands), and that one with those of the values within two bits. Where a band's meeting
    leaves several groups, one text of each is compared with those of `near.hubs` others, and with four times as
    many from round to round until all met: a text that is far from the most popular one still meets the others.
    Texts without a word are alike. Rows of a null doc_id have a null component, others of the same
    text don't see them. Repeated rows each get their row; an empty table gives an empty result."""
    sigs = materialize(map_texts(docs, ("doc_id", "text"), _bands_kernel(near), "doc_id long, node long, sig array<long>"), "bands")
    nodes = materialize(sigs.where("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.first("sig").alias("sig")), "nodes")
    ids = materialize(sigs.select("doc_id", "node"), "textids")
    drop_table(sigs)
    verify = _Verifier(docs, nodes, near)

    spread = nodes.select("node", F.posexplode("sig").alias("band", "value")).withColumn("band", F.col("band").cast("long"))
    values = materialize(spread.groupBy("band", "value").agg(F.count("*").alias("n"), F.min("node").alias("node")), "values")
    single = values.where("n = 1")
    members = materialize(spread.join(values.where("n > 1").select("band", "value", "n"), ["band", "value"]), "members")
    popular = members.groupBy("node").agg(F.sum(F.col("n") - 1).alias("pop"))
    tops = members.join(popular, "node").groupBy("band", "value").agg(F.max(F.struct("pop", "node")).alias("top"))
    tops = materialize(tops.select("band", "value", "top.node", "top.pop"), "hubs")
    groups = [values.where(F.col("band").between(b, b + _AT_ONCE - 1)) for b in range(0, near.bands, _AT_ONCE)]
    close = reduce(DataFrame.unionByName, [materialize(parents(g), "parents") for g in groups])
    either = close.select("band", "value").unionByName(close.select("band", F.col("parent").alias("value"))).distinct()
    alone = single.join(either, ["band", "value"], "left_semi").select("band", "value", "node", F.lit(0).cast("long").alias("pop"), F.lit(True).alias("fore"))
    fore = (F.col("node") == F.col("hub")).alias("fore")
    shared = members.join(tops.withColumnRenamed("node", "hub"), ["band", "value"]).select("band", "value", "node", "pop", fore)
    own = materialize(shared.unionByName(alone), "own")
    for done in (values, members, tops):
        drop_table(done)
    # the most popular partner of each text first: in a large group this leaves few pairs that are apart
    best = apart(own.withColumn("root", F.col("node")), close).groupBy("a").agg(F.max(F.struct("pop", "b"))["b"].alias("b"))
    best = materialize(best, "pairs")
    labels = [merged(nodes.select("node", F.col("node").alias("root")), verify(best))]
    rest = materialize(apart(own.join(labels[0], "node"), close).select("a", "b").distinct(), "pairs")
    labels.append(merged(labels[-1], verify(rest)))
    tried = best.unionByName(rest)
    tried = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))

    # what met in a band but lies in several groups yet: a meeting is a value with those it is the parent of
    hubs, met, agains, before = near.hubs, None, [], None
    while True:
        rep = F.min(F.struct(F.xxhash64("node", "band"), "node", "sig", "first")).alias("rep")
        one = ("band", "value", "root", "rep.node", "rep.sig", "rep.first")
        seen = own.join(labels[-1].join(nodes, "node"), "node").groupBy("band", "value", "root").agg(rep).select(*one)
        reps = close.join(seen, ["band", "value"]).select("band", F.col("parent").alias("value"), "root", "node", "sig", "first").unionByName(seen)
        reps = reps if met is None else reps.join(met, ["band", "value"], "left_semi")
        every = materialize(reps.groupBy("band", "value", "root").agg(rep).select(*one), "reps")
        reps = materialize(every.join(every.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1"), ["band", "value"]), "openreps")
        for done in (every, before):
            if done is not None:
                drop_table(done)
        before = reps
        draw = F.pmod(F.xxhash64("node", "value", F.lit(hubs)), F.lit(1 << 20)) * F.col("n")
        few = reps.where((F.col("n") <= hubs) | (draw < hubs << 20)).select("band", "value", F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("first").alias("first_b"))
        x = reps.select("band", "value", F.col("node").alias("a"), F.col("sig").alias("sig_a"), F.col("first").alias("first_a")).alias("x")
        meet = (F.col("x.band") == few["band"]) & (F.col("x.value") == few["value"]) & (F.col("a") != F.col("b"))
        again = x.join(few, meet & (distance(F.col("sig_a"), F.col("sig_b")) <= near.most_bits))
        turn = lambda e, o: F.when(F.col("a") < F.col("b"), F.struct(*e)).otherwise(F.struct(*o))
        ends, turned = ("a", "b", "first_a", "first_b"), (F.col("b").alias("a"), F.col("a").alias("b"), F.col("first_b").alias("first_a"), F.col("first_a").alias("first_b"))
        again = again.select(turn(ends, turned).alias("x")).select("x.*").distinct()
        again = materialize(again.join(tried, ["a", "b"], "left_anti"), "again")
        agains.append(again)
        if not again.isEmpty():
            labels.append(merged(labels[-1], verify.similar(again)))
        met = reps.where(F.col("n") > hubs).select("band", "value").distinct()
        if met.isEmpty():
            break
        tried, hubs = tried.unionByName(again.select("a", "b")), 4 * hubs
    rooted = nodes.join(labels[-1], "node").select("node", "first", "root")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    owner = materialize(rooted.join(least, "root").select("node", "component_id"), "textcomponents")
    # the first labels may be the nodes' own, which go here as well
    for done in (nodes, own, close, best, rest, before, *agains, *labels):
        drop_table(done)
    out = ids.where("doc_id is not null").join(owner, "node")
    return out.select("doc_id", "node", "component_id").unionByName(ids.where("doc_id is null").select("doc_id", "node", F.lit(None).cast("long").alias("component_id")))


def firsts(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """The rows of `docs`, all columns, of one document of each group of `similar_texts`: the smallest doc_id's.

    A document is a doc_id with a text; rows that repeat both stay together, and of two texts of one doc_id in a
    group one stays. Rows of a null doc_id stay. Column names are free."""
    found = similar_texts(docs, near)
    stay = found.where("component_id is not null").groupBy("component_id").agg(F.min(F.struct("doc_id", "node")).alias("s"))
    mark, hashed, ident = (unused(docs, n) for n in ("stays", "hash", "id"))
    stay = stay.select(F.col("s.doc_id").alias(ident), F.col("s.node").alias(hashed))
    known = docs.where("doc_id is not null").withColumn(mark, F.xxhash64("text"))
    known = known.join(stay, (F.col("doc_id") == F.col(ident)) & (F.col(mark) == F.col(hashed)), "left_semi").drop(mark)
    return known.unionByName(docs.where("doc_id is null"))
