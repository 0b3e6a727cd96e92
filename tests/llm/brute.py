"""Plain single-process versions of the operators, for comparison."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def url(u, rules):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOW)
    fit = []
    for verdict, rule in rules:
        name, _, prefix = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix):
            fit.append((len(rule), rule, verdict))
    best = max(fit, default=(0, None, None))
    return host, path, best[1], best[2]


def secrets(text):
    text, found = text or "", []
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    for rank, pattern, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        found += [(m.start(), rank, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    found.sort()
    said = ",".join(f"{('assign', 'access', 'hex')[r]}:{s}:{e}" for s, r, e in found)
    counts = Counter(r for _, r, _ in found)
    return counts[0], counts[1], counts[2], hashlib.sha256(said.encode()).hexdigest(), said


def licences(text):
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    starts, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        at = [i for i in range(len(own)) if own[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(own), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def counts(text):
    text = text or ""
    own = words(text)
    triples = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    often = Counter(triples)
    inside = {i + k for i, t in enumerate(triples) if often[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def fingerprint(text, k=3):
    own = words((text or "").translate(LOW))
    grams = [own[i : i + k] for i in range(len(own) - k + 1)] or ([own] if own else [])
    h = [xxhash.xxh64_intdigest(" ".join(g).encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(ids, prints, most=2):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def mix_targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2.0):
    """sizes by source; iterated clamping."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > epochs * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def trie(rows):
    """Nodes of the trie of rebuilt conversations from (conv_id, turn, role, text)."""
    raw = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            raw.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    raw = {c: [(r, t) for *_, r, t in sorted(own)] for c, own in raw.items()}
    whole = {}
    for c, own in raw.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(raw.get(base, [])[:h] + own[h:])
    at = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            at.setdefault(turns[:d], []).append(c)
    found = {}
    for p in sorted(at, key=len, reverse=True):
        below = [q for q in found if len(q) == len(p) + 1 and q[:-1] == p]
        saved = (len(at[p]) - 1) * len(p[-1][1]) if p else 0
        ends = ",".join(str(c) for c in sorted(at[p]) if whole[c] == p)
        found[p] = (min(at[p]), len(p), min(at[p[:-1]]) if p else None, len(at[p]), len(below), max(1, sum(found[q][5] for q in below)), saved + sum(found[q][6] for q in below), hashlib.sha256(ends.encode()).hexdigest())
    return list(found.values())


def importance(docs, target, n=1, buckets=10000, least=20, percent=10, seed=2024):
    """Rows (doc_id, n_features, weight, score, rank) from (doc_id, text) and target texts."""
    import math

    def found(text):
        words = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").translate(LOW))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(words) - k + 1)]

    s, t, rows = Counter(), Counter(), []
    for _, text in docs:
        s.update(found(text)[1])
    for text in target:
        t.update(found(text)[1])
    big, small = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big + buckets) / ((s[b] + 1) * (small + buckets))))
    for i, text in docs:
        words, own = found(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, own))
        rows.append((words >= least, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), i, weight, len(own)))
    rows.sort(key=lambda r: (not r[0], -r[1], r[2] is not None, r[2] or 0, r[3]))
    drawn = sum(r[0] for r in rows) * percent // 100
    return [(i, k, weight, score, at if can and at <= drawn else None) for at, (can, score, i, weight, k) in enumerate(rows, 1)]
