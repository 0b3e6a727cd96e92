"""URL filters: host and path rules, then a character language-model ratio. DataFrame functions only.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, share one set of contexts.
A context of up to `order` symbols is kept when both classes together saw it often enough, so the
longest kept context differs from place to place. Probabilities are Witten-Bell mixtures with the next
shorter context, down to a uniform distribution over the alphabet; each kept context has a row for every
symbol, so both models are normalised. A URL's score is the log-likelihood difference (accepted minus
rejected) divided by its symbols; the threshold is calibrated on accepted URLs held out of training.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, fold, materialize

#: Fixed symbols of the models: letters, one symbol for all digits, URL marks, any other, end.
ALPHABET = LOWER + "0./-_?=&#:%~+" + "*" + "$"
#: Host fragments that mark a URL as rejected for training.
REJECT_TERMS = ("adult", "bets", "casino", "escort", "loan", "pills", "poker", "porn", "viagra", "xxx")
MAX_RULES = 1000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first `://`, A-Z lowered) and path; both empty for null or no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    return fold(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does.

    `rules` holds (verdict, rule), a rule being host and path prefix, at most `MAX_RULES` of them. It
    fits its host and all subdomains. Of two rules of one length the earlier wins."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rule = verdict = None
    for said, text in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def symbols(url: Column) -> Column:
    """The model's view of a URL: no scheme, A-Z lowered, digits as 0, rare characters as *."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(url)
    shown = F.regexp_replace(F.regexp_replace(fold(rest), "[0-9]", "0"), r"[^a-z0./\-_?=&#:%~+]", "*")
    return F.coalesce(shown, F.lit(""))


def _grams(text: Column, order: int) -> Column:
    """All grams of 1 to order + 1 symbols that end at each symbol of the text or at its end mark."""
    chars = F.split(F.concat(F.lit("^" * order), text, F.lit("$")), "")
    ends = F.sequence(F.lit(order + 1), F.length(text) + order + 1)
    return F.flatten(F.transform(ends, lambda p: F.array(*(F.array_join(F.slice(chars, p - k, F.lit(k + 1)), "") for k in range(order + 1)))))


def fit(urls: DataFrame, order: int = 4, min_count: int = 20, max_contexts: int = 2000) -> DataFrame:
    """Models from all rows of (url_symbols, accepted boolean).

    Returns (gram, delta): by how much the log ratio of the gram's last symbol changes when the gram's
    first symbol joins the context. A place's log ratio is the sum over its grams that have a row. Kept
    contexts of an order number at most `max_contexts`, as each holds that share of all places; hence the
    rows are at most (1 + order * max_contexts) * len(ALPHABET) for any corpus, small enough to broadcast."""
    one = lambda c: F.sum(c.cast("long"))
    counts = materialize(
        urls.select("accepted", F.explode(_grams(F.col("url_symbols"), order)).alias("gram")).groupBy("gram").agg(one(F.col("accepted")).alias("a"), one(~F.col("accepted")).alias("r")),
        "grams",
    )
    places = counts.where(F.length("gram") == 1).agg(F.coalesce(F.sum(F.col("a") + F.col("r")), F.lit(0))).first()[0]
    least = max(min_count, -(-places // max_contexts))
    context = F.expr("left(gram, length(gram) - 1)").alias("context")
    kept = (
        counts.groupBy(context)
        .agg(F.sum("a").alias("na"), F.sum("r").alias("nr"), one(F.col("a") > 0).alias("ta"), one(F.col("r") > 0).alias("tr"))
        .where((F.col("na") + F.col("nr") >= least) | (F.col("context") == ""))
    )
    dense = kept.withColumn("symbol", F.explode(F.array(*map(F.lit, ALPHABET)))).withColumn("gram", F.concat("context", "symbol"))
    dense = materialize(dense.join(counts, "gram", "left").fillna(0, ["a", "r"]), "dense")

    def mixed(c: str, lower: Column) -> Column:
        n, t = F.col("n" + c), F.col("t" + c)
        return F.when(n + t > 0, (F.col(c) + t * lower) / (n + t)).otherwise(lower)

    flat = F.lit(1.0 / len(ALPHABET))
    level = dense.where(F.col("context") == "").select("gram", mixed("a", flat).alias("pa"), mixed("r", flat).alias("pr"))
    level = level.select("gram", "pa", "pr", F.log(F.col("pa") / F.col("pr")).alias("delta"))
    levels = level
    for k in range(1, order + 1):
        below = level.select(F.col("gram").alias("shorter"), F.col("pa").alias("la"), F.col("pr").alias("lr"))
        at = dense.where(F.length("context") == k).withColumn("shorter", F.expr("substring(gram, 2)")).join(below, "shorter")
        level = at.select("gram", mixed("a", F.col("la")).alias("pa"), mixed("r", F.col("lr")).alias("pr"), "la", "lr")
        level = level.select("gram", "pa", "pr", F.log(F.col("pa") / F.col("pr") * F.col("lr") / F.col("la")).alias("delta"))
        levels = levels.unionByName(level)
    return materialize(levels.select("gram", "delta"), "urlmodel")


def score(rows: DataFrame, model: DataFrame, order: int = 4) -> DataFrame:
    """Add `score`, the length-normalised log ratio of `url_symbols`, to each row.

    Rows are kept apart by a row number, so repeated rows stay. Sums start before the shuffle: one row
    for each input row crosses it."""
    keys = rows.columns
    spread = rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", *keys, F.explode(_grams(F.col("url_symbols"), order)).alias("gram"))
    found = spread.join(F.broadcast(model), "gram", "left")
    sums = found.groupBy("_row", *keys).agg(F.coalesce(F.sum("delta"), F.lit(0.0)).alias("_sum"))
    return sums.select(*keys, F.round(F.col("_sum") / (F.length("url_symbols") + 1), 9).alias("score"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = (), reject_terms: Sequence[str] = REJECT_TERMS, order: int = 4, lost: float = 0.01) -> DataFrame:
    """Verdict on every row of (page_id, url); other columns are ignored.

    Returns page_id, host, path, rule, verdict, score. A rule's verdict stands; other URLs are allowed
    when their score reaches the threshold. Training labels: a host with one of `reject_terms` is
    rejected, any other accepted; a fifth of the URLs (by hash of the URL) is held out, and the threshold
    lies midway between the `lost` quantile of its accepted scores and the 1 - `lost` quantile of its
    rejected ones, or where they overlap at the former. A null or empty URL has score 0 and is blocked.
    Repeated rows each keep their row. With no held-out URL of a kind the model blocks none."""
    url = F.col("url")
    host, path = host_path(url)
    rule, said = match_rule(F.col("host"), F.col("path"), rules)
    bad = F.lit(False)
    for term in reject_terms:
        bad = bad | F.col("host").contains(term)
    rows = (
        pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), symbols(url).alias("url_symbols"))
        .withColumn("rule", rule)
        .withColumn("rule_verdict", said)
        .withColumn("accepted", ~bad)
        .withColumn("held_out", F.pmod(F.xxhash64("url_symbols"), F.lit(5)) == 0)
    )
    model = fit(rows.where(~F.col("held_out") & (F.col("url_symbols") != "")), order)
    scored = materialize(score(rows, model, order), "urlscores")
    held = scored.where(F.col("held_out") & (F.col("url_symbols") != "")).groupBy("accepted").agg(F.percentile_approx("score", [lost, 1 - lost], 10000).alias("q"))
    low, high = (next((r.q[n] for r in held.collect() if r.accepted is side), None) for n, side in ((0, True), (1, False)))
    cut = float("-inf") if low is None or high is None else (low + high) / 2 if high < low else low
    own = F.when((F.col("url_symbols") == "") | (F.col("score") < cut), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "score")
