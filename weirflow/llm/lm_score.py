"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

Counts of every training token come from the whole corpus. The most frequent words are classes of their
own, all others share one; how often each class follows each context word is counted over all training text,
in a table that grows with it. The target representation predicted from a context word is bilinear in it and in
the next word. The classes' vectors, and those of contexts that are classes, are trained on the class bigrams;
given these, the objective parts into one small problem for each further context, fitted in numpy by Spark's
tasks, many at once. The noise expectation is summed over all classes instead of sampled, so training is
deterministic. Batched matrix products give each context's normaliser. A token outside the classes has its
class's probability times an add-one share by its own count.

Frequent tokens meet their counts through a broadcast head of bounded size; the rest are joined by token,
and as they are outside the head none of them is a hot key.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize
from .texts import FOLD, raw_texts, slices, small_batches

#: The end token; no word can be white space.
END = b"\n"
#: Tokens of the broadcast head, and classes of the model, at most.
HEAD = 1 << 17
CLASSES = 512
#: Distinct tokens that a task counts before it passes its counts on.
FLUSH = 1 << 18
#: Tokens whose pairs with their contexts a task counts before it passes them on.
PAIRS = 1 << 21


@dataclass(frozen=True)
class Shape:
    classes: int = CLASSES
    width: int = 24
    noise: int = 10
    rounds: int = 150
    rate: float = 0.05
    seed: int = 7
    #: Least occurrences of a word that has a context vector of its own; its pull, in occurrences, to the vector
    #: that all other words share; and the steps by which it is fitted.
    floor: int = 20
    pull: float = 20.0
    steps: int = 40


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """crc32 of doc_id as text, mod `folds`, is `fold`; a null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def tokens(raw: bytes) -> list[bytes]:
    """Words of a text with A-Z lowered, then the end token."""
    return [*raw.translate(FOLD).split(), END]


def token_counts(train: DataFrame) -> DataFrame:
    """(token, c) over all whole training texts, added up within tasks before the shuffle."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for raw in raw_texts(batch):
                seen.update(tokens(raw))
                if len(seen) >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "c"])
                    seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "c"])

    rows = train.select("text").mapInArrow(run, "token binary, c long")
    return materialize(rows.groupBy("token").agg(F.sum("c").alias("c")), "tokencounts")


def context_counts(train: DataFrame, head, contexts: int, classes: int) -> DataFrame:
    """(context, cls, n): how often each class follows each context over all training text, summed within tasks
    before the shuffle. Words from `contexts` on in the head's order, and all outside it, are the context `contexts`."""

    def run(batches):
        index, codes, size = head.value[0], [], 0

        def counted():
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            columns = [pa.array(code // classes), pa.array((code % classes).astype(np.int32)), pa.array(n)]
            return pa.RecordBatch.from_arrays(columns, ["context", "cls", "n"])

        for batch in batches:
            for raw in raw_texts(batch):
                ids = np.fromiter((index.get(t, contexts) for t in tokens(raw)), np.int64)
                codes.append(np.minimum(np.concatenate([[0], ids[:-1]]), contexts) * classes + np.minimum(ids, classes - 1))
                size += len(ids)
                if size >= PAIRS:
                    yield counted()
                    codes, size = [], 0
        if codes:
            yield counted()

    rows = train.select("text").mapInArrow(run, "context long, cls int, n long")
    return materialize(rows.groupBy("context", "cls").agg(F.sum("n").alias("n")), "contextcounts")


def class_bigrams(pairs: DataFrame, classes: int) -> np.ndarray:
    """Matrix of how often each class follows each; classes * classes numbers at most reach the driver."""
    both = pairs.groupBy(F.least("context", F.lit(classes - 1)).alias("context"), "cls").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((classes, classes))
    table[both.column("context").to_numpy(), both.column("cls").to_numpy()] = both.column("n").to_numpy()
    return table


def normaliser(predicted: np.ndarray, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the sum over all classes of exp(score), for each predicted representation."""
    score = predicted @ q.T + b
    most = score.max(1)
    return most + np.log(np.exp(score - most[:, None]).sum(1))


def train_nce(bigrams: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A log-bilinear model fitted to class bigrams: representations that the contexts predict, vectors and
    biases of the classes, and their noise distribution.

    Score of next w after c: r_c C q_w + b_w. The objective tells pairs of the corpus from `noise` times
    as many with w drawn from the unigram distribution; it is ascended with Adam on all pairs at once."""
    m, d = len(bigrams), shape.width
    rng = np.random.default_rng(shape.seed)
    unigram = (bigrams.sum(0) + 1) / (bigrams.sum() + m)
    data = bigrams / max(1.0, bigrams.sum())
    noise = shape.noise * data.sum(1, keepdims=True) * unigram
    params = {"r": rng.normal(0, 0.1, (m, d)), "c": np.eye(d), "q": rng.normal(0, 0.1, (m, d)), "b": np.log(unigram)}
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    offset = np.log(shape.noise * unigram)
    for step in range(1, shape.rounds + 1):
        predicted = params["r"] @ params["c"]
        logit = predicted @ params["q"].T + params["b"] - offset
        real = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        slope = data * (1 - real) - noise * real
        back = slope @ params["q"]
        grads = {"r": back @ params["c"].T, "c": params["r"].T @ back, "q": slope.T @ predicted, "b": slope.sum(0)}
        for k, g in grads.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            params[k] += shape.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-12)
    return params["r"] @ params["c"], params["q"], params["b"], unigram


def fit_contexts(counts: np.ndarray, start: np.ndarray, q: np.ndarray, b: np.ndarray, unigram: np.ndarray, shape: Shape) -> np.ndarray:
    """Representations that contexts predict, from rows of how often each class follows one.

    The objective is `train_nce`'s with the classes' vectors held, less a pull to `start` that weighs less
    the more often a context occurs."""
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    data, noise, offset = counts / total, shape.noise * unigram, b - np.log(shape.noise * unigram)
    x = np.repeat(start[None, :], len(counts), 0)
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, shape.steps + 1):
        real = 1 / (1 + np.exp(-np.clip(x @ q.T + offset, -40, 40)))
        grad = (data - real * (data + noise)) @ q - shape.pull / total * (x - start)
        first += 0.1 * (grad - first)
        second += 0.05 * (grad * grad - second)
        x += 2 * shape.rate * (1 - step / (shape.steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.95**step)) + 1e-8)
    return x


def _context_kernel(start: np.ndarray, q: np.ndarray, b: np.ndarray, unigram: np.ndarray, shape: Shape):
    """Rows of (context, follow) to their vectors, a thousand contexts at once."""
    small = [x.astype(np.float32) for x in (start, q, b, unigram)]

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                follow = part.column("follow")
                pair = follow.flatten()
                row = np.repeat(np.arange(part.num_rows), follow.value_lengths().to_numpy())
                counts = np.zeros((part.num_rows, len(b)), np.float32)
                counts[row, pair.field("cls").to_numpy()] = pair.field("n").to_numpy()
                x = fit_contexts(counts, *small, shape)
                vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column("context"), vectors], ["context", "vector"])

    return run


def context_vectors(pairs: DataFrame, classes: int, contexts: int, head: int, shape: Shape) -> tuple[np.ndarray, ...]:
    """(representations, normalisers, class vectors, biases) of the model, the first two for each of `head` words
    and a last one for all others; words from `contexts` on have the last one too.

    A context's row holds one count for each class at most. What reaches the driver is bounded by the head."""
    predicted, q, b, unigram = train_nce(class_bigrams(pairs, classes), shape)
    x = np.repeat(predicted[-1:].astype(np.float32), head + 1, 0)
    x[: classes - 1] = predicted[:-1]
    if contexts > classes - 1:
        own = pairs.where((F.col("context") >= classes - 1) & (F.col("context") < contexts))
        own = own.groupBy("context").agg(F.collect_list(F.struct("cls", "n")).alias("follow"))
        got = small_batches(own).mapInArrow(_context_kernel(predicted[-1], q, b, unigram, shape), "context long, vector array<float>").toArrow()
        if got.num_rows:
            x[got.column("context").to_numpy()] = np.concatenate([c.flatten().to_numpy() for c in got.column("vector").chunks]).reshape(-1, shape.width)
    logz = np.concatenate([normaliser(x[k : k + 4096], q, b) for k in range(0, len(x), 4096)])
    return x, logz, q.astype(np.float32), b


def log_probability(context: np.ndarray, group: np.ndarray, model: tuple[np.ndarray, ...]) -> float:
    """Sum of log10 probabilities of classes after contexts, by parts that bound the memory of a long text."""
    x, logz, q, b = model
    total = float((b[group] - logz[context]).sum())
    for k in range(0, len(group), 1 << 14):
        total += float(np.einsum("ij,ij->i", x[context[k : k + (1 << 14)]], q[group[k : k + (1 << 14)]]).sum(dtype=np.float64))
    return total / np.log(10)


def _scores(head, parts, classes: int):
    def run(batches):
        index, counts, trained = *head.value, parts.value
        logs = np.log10(np.append(counts, 0) + 1.0)
        known = np.append(counts > 0, False)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                rows, tails = [], []
                for raw in raw_texts(part):
                    own = tokens(raw)
                    ids = np.fromiter((index.get(t, -1) for t in own), np.int64)
                    group = np.where((ids >= 0) & (ids < classes - 1), ids, classes - 1)
                    rare = group == classes - 1
                    model = log_probability(np.concatenate([[0], ids[:-1]]), group, trained)
                    rows.append((number, len(own), int(known[ids].sum()), float(logs[ids].sum()), float(logs[ids][rare].sum()), int(rare.sum()), model))
                    tails.append(Counter(t for t, i in zip(own, ids.tolist(), strict=True) if i < 0) if (ids < 0).any() else {})
                    number += 1
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
                ends = np.cumsum([0, *map(len, tails)], dtype=np.int32)
                rest = pa.StructArray.from_arrays([pa.array([t for x in tails for t in x], pa.binary()), pa.array([n for x in tails for n in x.values()], pa.int64())], ["token", "n"])
                names = ["row", "n_tokens", "n_known", "logs", "rare_logs", "n_rare", "model"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.ListArray.from_arrays(ends, rest)], ["doc_id", *names, "tail"])

    return run


def score(docs: DataFrame, head_size: int = HEAD, shape: Shape = Shape(), folds: int = 7, fold: int = 2) -> DataFrame:
    """Scores of every whole text of (doc_id, text); other columns are ignored.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram, log10) and
    score (the model, log10). Null and empty texts are the end token alone. With no training rows both
    models are uniform over what they know: base scores are 0. Repeated rows each get their row."""
    spark = small_batches(docs).sparkSession
    train = docs.where(~held_out(F.col("doc_id"), folds, fold))
    counts = token_counts(train)
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.where(F.col("token") != F.lit(END)).orderBy(F.desc("c"), "token").limit(head_size).toArrow()
    end = counts.where(F.col("token") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    names, own = [END, *top.column("token").to_pylist()], np.array([end, *top.column("c").to_pylist()], np.int64)
    classes = min(shape.classes, len(names) + 1)
    head = spark.sparkContext.broadcast(({t: i for i, t in enumerate(names)}, own))
    contexts = max(classes - 1, 1 + int((own[1:] >= shape.floor).sum()))
    pairs = context_counts(train, head, contexts, classes)
    model_parts = spark.sparkContext.broadcast(context_vectors(pairs, classes, contexts, len(names), shape))
    rare_total = total - int(own[: classes - 1].sum())
    rare_kinds = max(0, kinds - (classes - 1 if end else classes - 2))
    fields = "doc_id long, row long, n_tokens long, n_known long, logs double, rare_logs double, n_rare long, model double, tail array<struct<token:binary,n:bigint>>"
    rows = materialize(docs.select("doc_id", "text").mapInArrow(_scores(head, model_parts, classes), fields), "lmrows")
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", F.col("t.token").alias("token"), F.col("t.n").alias("n"))
    met = tail.join(counts, "token", "left")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("tail_logs"))
    out = rows.drop("tail").join(sums, "row", "left").fillna(0, ["more", "tail_logs"])
    base = F.col("logs") + F.col("tail_logs") - F.col("n_tokens") * F.lit(float(np.log10(total + kinds + 1)))
    model = F.col("model") + F.col("rare_logs") + F.col("tail_logs") - F.col("n_rare") * F.lit(float(np.log10(rare_total + rare_kinds + 1)))
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "n_tokens", (F.col("n_known") + F.col("more")).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), model.alias("score"))
