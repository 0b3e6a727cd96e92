"""License scans: Aho-Corasick over identifier tags and notice phrases, expressions by shunting-yard."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .texts import FOLD, map_texts, raw_texts

#: Notice phrases whose places make up the base result.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases, in words.
MORE_PHRASES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons": "cc",
    "under cc by": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "under cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}
#: Tags that a licence expression follows on the same line.
TAGS = ("spdx-license-identifier:", "license-expression:")
#: How freely texts under a label may be used again.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "zlib": 1.0,
    "cc-by": 0.9, "mpl": 0.6, "epl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.6, "cc": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nc": 0.2, "proprietary": 0.0,
}
UNKNOWN = 0.1
OPERATORS = {"or": 1, "and": 2, "with": 3}

# bytes outside words become spaces, letters are lowered
_WORDS = bytes(FOLD[b] if chr(b).isalnum() or b > 0x7F else 0x20 for b in range(256))


def _automaton(keys) -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for key, value in keys:
        auto.add_word(key, (key, value))
    auto.make_automaton()
    return auto


def label_of(name: str) -> str:
    """Family label of a licence identifier such as `GPL-3.0-only`."""
    name = name.lower()
    for label in sorted(FREEDOM, key=len, reverse=True):
        if name == label or name.startswith(label + "-"):
            return label
    return name


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: operators and, or, with (with binds most, or least); None for a malformed one."""
    out, stack, operand = [], [], False
    for token in tokens:
        low = token.lower()
        if low in OPERATORS:
            if not operand:
                return None
            while stack and stack[-1] != "(" and OPERATORS[stack[-1]] >= OPERATORS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        elif token == "(":
            if operand:
                return None
            stack.append(token)
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack or not operand:
                return None
            stack.pop()
        else:
            if operand:
                return None
            out.append(token)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """Labels of an expression and its freedom: `or` takes the freer side, `and` the stricter one,
    `with` adds a tenth to its licence. None when it is malformed."""
    order = postfix(re.findall(r"[A-Za-z0-9.+:-]+|[()]", expression))
    if order is None:
        return None
    stack: list[tuple[set[str], float]] = []
    for token in order:
        if token in OPERATORS:
            (right, b), (left, a) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left, min(1.0, a + 0.1)))
            else:
                stack.append((left | right, max(a, b) if token == "or" else min(a, b)))
        else:
            label = label_of(token)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN)))
    return stack[0]


def _expression(line: str) -> str:
    """The longest licence expression at the start of a line: operands and operators in turn."""
    at = kept = depth = 0
    operand = False
    while token := re.compile(r"[ \t]*([()]|[A-Za-z0-9.+:-]+)").match(line, at):
        word = token[1].lower()
        if word == "(" if operand else word == ")" or word in OPERATORS:
            break
        if operand and word != ")" and word not in OPERATORS:
            break
        depth += (word == "(") - (word == ")")
        if depth < 0:
            break
        at, operand = token.end(), word == ")" or word != "(" and word not in OPERATORS
        if operand and not depth:
            kept = at
    return line[:kept]


def _tagged(text: str, tags: ahocorasick.Automaton) -> list[tuple[set[str], float]]:
    found = []
    for end, _ in tags.iter(text):
        stop = text.find("\n", end)
        if value := evaluate(_expression(text[end + 1 : stop if stop >= 0 else len(text)])):
            found.append(value)
    return found


def _kernel():
    phrases = _automaton((f" {p} ", label) for p, label in (BASE_PHRASES | MORE_PHRASES).items())
    tags = _automaton((t, t) for t in TAGS)

    def run(batch: pa.RecordBatch) -> dict:
        rows = {k: [] for k in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        rows["doc_id"] = batch.column("doc_id")
        for raw in raw_texts(batch):
            words = raw.translate(_WORDS).split(b" ")
            words = [w for w in words if w]
            line = f" {b' '.join(words).decode()} "
            at, seen, starts, base, labels, score = 0, 0, [], set(), set(), []
            hits = sorted((end - len(key) + 1, -end, key, label) for end, (key, label) in phrases.iter(line))
            reach = 0
            for begin, end, key, label in hits:
                seen += line.count(" ", at, begin)  # spaces before the phrase's own are words before it
                at = begin
                labels.add(label)
                if -end > reach:  # else a longer phrase holds this one and says what it means
                    score.append(FREEDOM[label])
                    reach = -end
                if key.strip() in BASE_PHRASES:
                    starts.append(seen)
                    base.add(label)
            folded = raw.translate(FOLD)
            if b"license-" in folded:
                for own, freedom in _tagged(folded.decode(), tags):
                    labels |= own
                    score.append(freedom)
            for k, v in zip(list(rows)[1:], (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(score, default=0.0)), strict=True):
                rows[k].append(v)
        kinds = {"first_word": pa.int64(), "last_word": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "score": pa.float64()}
        return {k: v if k == "doc_id" else pa.array(v, kinds.get(k, pa.string())) for k, v in rows.items()}

    return run


def scan(docs: DataFrame) -> DataFrame:
    """Licences named in every whole text of (doc_id, text); other columns are ignored.

    Returns doc_id, n_words, n_base, first_word, last_word (word places of the base phrases, null where
    there is none), base_labels, labels, score. `score` is the freedom of the strictest licence found: a
    phrase counts by its label unless a longer one holds it, a tagged expression by its value; 0 where none is found. A null or empty
    text has no words. A malformed expression is passed over. Every row, repeated or not, gets its own
    result; the pass is narrow, with no shuffle, and a text's words are all that it holds."""
    return map_texts(docs, ("doc_id", "text"), _kernel(), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
