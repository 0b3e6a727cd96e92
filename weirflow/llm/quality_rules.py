"""Quality rules: text statistics in an Arrow pass, and a decision list learned by sequential covering.

Rules are grown and pruned one after another: a rule is a conjunction of thresholds that covers rejected
documents; what it covers leaves the training rows and the next rule is grown on the rest. The list is
emitted as ordered Spark conditional expressions, so applying it stays in generated code.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import materialize
from .texts import map_texts, raw_texts, slices, small_batches

#: Labelled rows the list is learned from, at most; the lowest hashes of doc_id are taken.
MAX_LABELLED = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_marks", "n_lines", "longest_word")
#: Statistics the rules may test, as expressions of the counts ({p}: what stands before their names).
FEATURES = {
    "n_words": "double({p}n_words)",
    "mean_word": "{p}word_chars / greatest({p}n_words, 1)",
    "symbol_rate": "{p}n_symbols / greatest({p}n_words, 1)",
    "dup_line_share": "{p}n_dup_lines / greatest({p}n_lines, 1)",
    "repeat_share": "{p}n_repeat_words / greatest({p}n_words, 1)",
    "distinct_share": "{p}n_distinct / greatest({p}n_words, 1)",
    "upper_share": "{p}n_upper / greatest({p}word_chars, 1)",
    "mark_rate": "{p}n_marks / greatest({p}n_words, 1)",
    "line_words": "{p}n_words / greatest({p}n_lines, 1)",
    "longest_word": "double({p}longest_word)",
}
_SPACE, _SYMBOLS, _CAPITALS, _MARKS = b" \t\n\r\x0b\x0c", b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?"


def _repeated(ids: np.ndarray, kinds: int) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(ids) < 4 or kinds == len(ids):
        return 0
    pairs = ids[:-1] * kinds + ids[1:]
    if kinds >= 1 << 21:
        _, pairs = np.unique(pairs, return_inverse=True)
        kinds = max(kinds, int(pairs.max()) + 1)
    order = np.argsort(triples := pairs[:-1] * kinds + ids[2:], kind="stable")
    same = triples[order][1:] == triples[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(triples), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def longest_word(words: Iterable[bytes]) -> int:
    """Most code points of a word. None has more than bytes, so the search ends at the first that has no more bytes."""
    best = 0
    for w in sorted(words, key=len, reverse=True):
        if len(w) <= best:
            break
        best = max(best, len(w.decode()))
    return best


def text_counts(raw: bytes) -> tuple[int, ...]:
    """The values of COUNTS for a whole text."""
    words, ids = raw.split(), {}
    order = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    bare = raw.translate(None, _SPACE)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    less = lambda drop: len(bare) - len(bare.translate(None, drop))
    return (len(words), len(bare.decode()), less(_SYMBOLS), len(lines) - len(set(lines)), _repeated(order, len(ids)), len(ids), less(_CAPITALS), less(_MARKS), len(lines), longest_word(ids))


def _kernel(batch: pa.RecordBatch) -> dict:
    table = np.array([text_counts(t) for t in raw_texts(batch)], np.int64).reshape(-1, len(COUNTS))
    return {"doc_id": batch.column("doc_id")} | {c: pa.array(table[:, k]) for k, c in enumerate(COUNTS)}


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of COUNTS for every whole text; a null text has zeros. Narrow, no shuffle."""
    return map_texts(docs, ("doc_id", "text"), _kernel, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def features(prefix: str = "") -> dict[str, Column]:
    return {n: F.expr(e.format(p=prefix)) for n, e in FEATURES.items()}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


Rule = tuple[Test, ...]


def _cover(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for t in rule:
        v = x[:, names.index(t.feature)]
        hit &= v > t.threshold if t.above else v <= t.threshold
    return hit


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], cuts: list[np.ndarray], most: int) -> Rule:
    """Add the test of the highest information gain until no accepted row is covered."""
    rule: list[Test] = []
    inside = np.ones(len(y), bool)
    while len(rule) < most and (inside & ~y).any():
        p, n = (inside & y).sum(), (inside & ~y).sum()
        best, gain = None, 1e-9
        for k, name in enumerate(names):
            over = x[inside, k, None] > cuts[k]
            bad = over[y[inside]].sum(0), over[~y[inside]].sum(0)
            for above, (pp, nn) in ((True, bad), (False, (p - bad[0], n - bad[1]))):
                g = pp * (np.log2((pp + 1e-3) / (pp + nn + 2e-3)) - np.log2(p / (p + n)))
                if len(g) and g.max() > gain:
                    gain, best = g.max(), Test(name, above, float(cuts[k][g.argmax()]))
        if best is None:
            break
        rule.append(best)
        inside &= _cover((best,), x, names)
    return tuple(rule)


def learn(x: np.ndarray, rejected: np.ndarray, names: list[str], max_rules: int = 12, max_tests: int = 4, precision: float = 0.99, seed: int = 7) -> list[Rule]:
    """Ordered conjunctions that reject. A third of the rows is kept for pruning: a rule loses its last
    tests as long as that helps (p - n) / (p + n) there, and the list ends when a rule's precision on all
    rows that remain is below `precision` or it covers under 5 of them."""
    y = rejected.astype(bool)
    prune = np.random.default_rng(seed).random(len(y)) < 1 / 3
    left, rules = np.ones(len(y), bool), []
    if not len(y) or y.all() or not y.any():
        return rules
    cuts = []
    for k in range(x.shape[1]):
        v = np.unique(np.quantile(x[:, k], np.linspace(0, 1, 65)[1:-1]))
        cuts.append(np.unique(np.concatenate([v, np.quantile(x[y, k], np.linspace(0, 1, 33)[1:-1])])))
    while len(rules) < max_rules and (left & y & ~prune).any():
        grow = left & ~prune
        rule = _grow(x[grow], y[grow], names, cuts, max_tests)
        px, py = x[left & prune], y[left & prune]

        def worth(r: Rule, px: np.ndarray = px, py: np.ndarray = py) -> float:
            hit = _cover(r, px, names)
            p, n = (hit & py).sum(), (hit & ~py).sum()
            return (p - n) / (p + n) if p + n else -1.0

        if rule:
            rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        hit = left & _cover(rule, x, names)
        if not rule or hit.sum() < 5 or y[hit].mean() < precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def expression(rules: list[Rule]) -> Column:
    """True where the list keeps a row: the first rule that holds rejects, no rule keeps."""
    out = None
    for rule in rules:
        holds = rule[0].holds()
        for t in rule[1:]:
            holds = holds & t.holds()
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def labelled(stats: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and rejection (quality 0) of at most `most` labelled rows, the lowest hashes of doc_id.

    A document with several labels is rejected if one of them says so; null labels are left out."""
    said = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stats.join(said, "doc_id").select(F.xxhash64("doc_id").alias("_h"), "doc_id", *(f.alias(f"f_{n}") for n, f in features().items()), (F.col("quality") == 0).alias("_y"))
    got = rows.orderBy("_h", "doc_id").limit(most).toArrow()
    x = np.array([got.column(f"f_{n}").to_numpy() for n in FEATURES], float).T.reshape(-1, len(FEATURES))
    return x, got.column("_y").to_numpy(zero_copy_only=False).astype(bool)


def base_failed(prefix: str = "") -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * n)


def _named(rules: list[Rule]) -> Column:
    """The list over feature columns that stand as _f_<name>."""
    return expression([tuple(Test("_f_" + t.feature, t.above, t.threshold) for t in r) for r in rules])


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdict for every row of (doc_id, text); other columns are ignored.

    Returns doc_id, the counts, base_failed and kept. `kept` is false where the base rules fail, else what
    the list learned from (doc_id, quality) in `labels` says. Null and empty texts have zero counts and
    fail the base rules. With no labels of both kinds only the base rules judge. Repeated rows are judged
    each. The counts are a table in the shared folder, so texts are read once."""
    stats = materialize(statistics(docs), "quality")
    rules = learn(*labelled(stats, labels), list(FEATURES))
    rows = stats.select("doc_id", *COUNTS, base_failed().alias("base_failed"), *(f.alias(f"_f_{n}") for n, f in features().items()))
    rows = rows.withColumn("kept", ~F.col("base_failed") & _named(rules))
    return rows.select("doc_id", *COUNTS, "base_failed", "kept")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that `judge` keeps.

    Counts are made twice, for learning and beside each row, so that no text is shuffled. Columns of
    `docs` may have any names but ones that begin with _q_ or _f_."""
    rules = learn(*labelled(materialize(statistics(docs), "quality"), labels), list(FEATURES))
    schema = docs.schema
    for c in COUNTS:
        schema = T.StructType([*schema.fields, T.StructField(f"_q_{c}", T.LongType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                counts = [a for k, a in _kernel(part).items() if k != "doc_id"]
                yield pa.RecordBatch.from_arrays([*part.columns, *counts], [f.name for f in schema.fields])

    rows = small_batches(docs).mapInArrow(run, schema)
    rows = rows.select("*", *(f.alias(f"_f_{n}") for n, f in features("_q_").items())).where(~base_failed("_q_") & _named(rules))
    return rows.select(*docs.columns)
