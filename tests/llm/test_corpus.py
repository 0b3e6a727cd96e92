"""Scores, passages, benchmark overlaps and the pipeline against plain versions and planted rows."""

import math
import random
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import common, decontaminate, lm_score, quality_rules, simhash, substring_dedup

from . import brute

SF = "/root/testdata/sf0.001"


def prose(rng, n, kinds=4000):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_base_scores(spark, docs):
    odd = [(5001, None), (5002, ""), (None, "alpha beta alpha"), (5003, "A a\x0bA a"), (5003, "zzz " * 500)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = lm_score.score(rows, head_size=50, shape=lm_score.Shape(classes=32)).collect()
    src = [(r.doc_id, [*brute.words((r.text or "").translate(brute.LOW)), None]) for r in rows.collect()]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(t for i, own in src if not out(i) for t in own)
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((str(i), out(i), len(own), sum(counts[t] > 0 for t in own), total, round(sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in own), 5)) for i, own in src)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_score.score(docs.limit(0)).count() == 0


def test_model_learns_order(spark):
    """Held-out text whose words follow from one another scores far better than the unigram."""
    rng = random.Random(1)
    cycle = [f"w{i}" for i in range(40)]
    texts = [" ".join(cycle[(s + k) % 40] for k in range(60)) for s in (rng.randrange(40) for _ in range(300))]
    got = lm_score.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shape=lm_score.Shape(classes=64, rounds=400)).where("held_out").collect()
    assert len(got) > 20 and sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_nce_is_normalised_and_near_the_counts():
    counts = np.random.default_rng(2).integers(1, 50, (12, 12)).astype(float)
    x, q, b, _ = lm_score.train_nce(counts, lm_score.Shape(classes=12, width=12, rounds=1500))
    joint = np.exp(x @ q.T + b - lm_score.normaliser(x, q, b)[:, None])
    assert np.allclose(joint.sum(1), 1)
    assert np.abs(joint - counts / counts.sum(1, keepdims=True)).max() < 0.05


def test_context_vectors_grow_with_the_corpus(spark):
    """Words beyond the classes have contexts of their own; log-probabilities sum to one for each, and a text's score
    is the sum of what the plain formula gives."""
    rng, shape = random.Random(5), lm_score.Shape(classes=12, width=8, floor=30, pull=5.0, steps=200)
    after = {f"c{i}": f"n{i % 8}" for i in range(80)}
    texts = [" ".join(w for c in rng.choices(sorted(after), k=60) for w in (c, after[c])) for _ in range(120)]
    trained = []
    for n in (20, 120):
        docs = spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string")
        counts = {bytes(r.token): r.c for r in lm_score.token_counts(docs).collect()}
        names = [lm_score.END, *sorted(set(counts) - {lm_score.END}, key=lambda t: (-counts[t], t))]
        contexts = max(11, 1 + sum(counts[t] >= shape.floor for t in names[1:]))
        head = spark.sparkContext.broadcast(({t: i for i, t in enumerate(names)}, None))
        pairs = lm_score.context_counts(docs, head, contexts, 12)
        want = Counter()
        for t in texts[:n]:
            ids = [names.index(w) for w in lm_score.tokens(t.encode())]
            want.update((min(a, contexts), min(b, 11)) for a, b in zip([0, *ids], ids))
        assert {(r.context, r.cls): r.n for r in pairs.collect()} == want
        trained.append((pairs.count(), contexts, lm_score.context_vectors(pairs, 12, contexts, len(names), shape)))
    assert trained[1][0] > trained[0][0] and trained[1][1] > trained[0][1]
    x, logz, q, b = trained[1][2]
    logp = x @ q.T + b - logz[:, None]
    assert np.allclose(np.exp(logp).sum(1), 1, atol=1e-4)
    own = [i for i, t in enumerate(names) if t[:1] == b"c" and i >= 11]
    follows = [names.index(after[names[i].decode()].encode()) for i in own]
    # twice as likely as after the representation that words without their own share, at least
    assert len(own) > 60 and np.mean(np.exp(logp[own, follows])) > 2 * np.mean(np.exp(logp[-1, follows]))
    context, group = np.array([0, own[0], own[1], len(names)]), np.array([3, 4, 11, 0])
    assert math.isclose(lm_score.log_probability(context, group, (x, logz, q, b)), logp[context, group].sum() / math.log(10), rel_tol=1e-4)


def passages(rng):
    """Documents with a shared passage in some, each in words of its own otherwise."""
    shared, rows = prose(rng, 60, 10**9), []
    for i in range(60):
        own = prose(rng, 150, 10**9)
        if i % 3 == 0:
            put = list(shared)
            if i % 2:
                put[30] = "changed"
            own[70:70] = put
        rows.append((i, " ".join(own)))
    return shared, rows


def test_shared_passages(spark):
    rng = random.Random(4)
    _, rows = passages(rng)
    near = rows[1][1].split()
    near[10] = near[90] = "edited"
    rows += [(100, " ".join(near)), (101, rows[2][1]), (102, None), (103, ""), (None, rows[4][1]), (104, "short text"), (105, "short text"), (106, "a b " * 4000), (107, "a b " * 4100)]
    rows += [(110 + k, " ".join([*prose(rng, 60, 10**9), *["so"] * n, *prose(rng, 60, 10**9)])) for k, n in enumerate((20, 90, 70, 50))]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, owner int").repartition(5)
    got = substring_dedup.shared_passages(table).collect()
    by = {r.doc_id: r for r in got}
    assert {i for i in by if i < 100} == {i for i in range(3, 60, 3)}
    for i in range(3, 60, 3):
        r = by[i]
        assert r.source_doc_id == 0 and abs(r.start_word - 70) <= 1 and abs(r.end_word - 130) <= 1 and r.n_same >= 59
    assert by[100].source_doc_id == 1 and by[100].end_word - by[100].start_word == 150
    assert (by[101].source_doc_id, by[101].end_word) == (2, 150)
    assert by[107].source_doc_id == 106 and by[107].end_word - by[107].start_word == 8000
    assert {i: (by[i].source_doc_id, by[i].end_word - by[i].start_word) for i in (112, 113)} == {112: (111, 70), 113: (111, 50)} and 111 not in by
    assert not {102, 103, 104, 105, None} & set(by)
    assert substring_dedup.shared_passages(table.limit(0)).count() == 0


def test_passages_whose_pieces_are_quoted_before(spark):
    """Short quotes in earlier documents own every seed of a passage; its two holders still meet."""
    rng, rows, want = random.Random(12), [], set()
    for n in range(30):
        words, shared = 40 + n, prose(rng, 40 + n, 10**9)
        for k, start in enumerate(range(0, words, 10)):
            rows.append((1000 * n + k, " ".join([*prose(rng, 50, 10**9), *shared[start : start + 20], *prose(rng, 50, 10**9)])))
        for k in (500, 501):
            rows.append((1000 * n + k, " ".join([*prose(rng, 60 + k, 10**9), *shared, *prose(rng, 60, 10**9)])))
        want.add((1000 * n + 501, 1000 * n + 500, 561, 561 + words, 560, 560 + words, words))
    got = substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_no_equal_forty_words_and_pieces_quoted_before(spark):
    """Every holder of a seed meets, not its first one alone: the pieces of at most 20 words that eight earlier documents
    quote hold all seeds, and no 40 words in a row are equal. 20 documents quoting each piece make its seeds frequent."""
    for quotes, edits in ((1, (16, 32, 48, 64)), (20, (33, 66))):
        rng, rows, want = random.Random(15), [], set()
        for n in range(8):
            shared = prose(rng, 80, 10**9)
            copy = [f"edit{n}" if k in edits else w for k, w in enumerate(shared)]
            for k in range(quotes * 8):
                rows.append((1000 * n + k, " ".join([*prose(rng, 9, 10**9), *shared[k % 8 * 10 :][:20], *prose(rng, 9, 10**9)])))
            for k, put in ((500, shared), (501, copy)):
                rows.append((1000 * n + k, " ".join([*prose(rng, 60, 10**9), *put, *prose(rng, 60, 10**9)])))
            want.add((1000 * n + 501, 1000 * n + 500, 60, 140, 60, 140, 80 - len(edits)))
        got = substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
        assert {tuple(r) for r in got} == want


def test_passages_that_stand_twice(spark):
    """Both copies in a document are found, though no 40 words in a row are equal."""
    rng = random.Random(14)
    shared = prose(rng, 62, 10**9)
    copies = [list(shared), list(shared)]
    for n, copy in enumerate(copies):
        for k in (20, 41):
            copy[k] = f"edit{n}"
    rows = [(1, [*prose(rng, 90, 10**9), *shared, *prose(rng, 90, 10**9)]), (2, [*prose(rng, 80, 10**9), *copies[0], *prose(rng, 80, 10**9), *copies[1]])]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = sorted(tuple(r) for r in substring_dedup.shared_passages(table).collect())
    assert got == [(2, 1, 80, 142, 90, 152, 60), (2, 1, 222, 284, 90, 152, 60)]


def test_passages_with_substitutions(spark):
    """Of passages with single words changed at random, 0.8 equal or more, nine in ten or more are found."""
    rng, rows, kinds = random.Random(31), [], {}
    for n in range(400):
        words, rate = ((40, 0.1), (40, 0.15), (50, 0.19), (60, 0.1))[n % 4]
        shared = prose(rng, words, 10**9)
        copy = [f"c{rng.randrange(10**9)}" if rng.random() < rate and 0 < k < words - 1 else w for k, w in enumerate(shared)]
        if sum(x == y for x, y in zip(shared, copy, strict=True)) >= 0.8 * words:
            kinds.setdefault((words, rate), []).append(2 * n + 1)
        for k, put in enumerate((shared, copy)):
            rows.append((2 * n + k, " ".join([*prose(rng, 70, 10**9), *put, *prose(rng, 70, 10**9)])))
    for n in range(900, 920, 2):  # every fifth word: no five equal words in a row
        fifth = prose(rng, 60, 10**9)
        rows += [(n, " ".join(fifth)), (n + 1, " ".join("other" if k % 5 == 2 else w for k, w in enumerate(fifth)))]
    got = {r.doc_id: r.source_doc_id for r in substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert all(got[i] == i - 1 for i in got) and sum(i >= 900 for i in got) >= 5
    recall = {k: sum(i in got for i in ids) / len(ids) for k, ids in kinds.items()}
    assert min(recall.values()) >= 0.9, recall


def test_two_texts_of_one_id(spark):
    rng = random.Random(33)
    a, b = prose(rng, 80, 10**9), prose(rng, 30, 10**9)
    rows = [(7, [*b, *a, *b]), (7, prose(rng, 60, 10**9)), (3, [*prose(rng, 50, 10**9), *a]), (9, [*a, *prose(rng, 20, 10**9)]), (9, [*a, *prose(rng, 20, 10**9)])]
    got = sorted(tuple(r)[:4] for r in substring_dedup.shared_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect())
    assert got == [(7, 3, 30, 110), (9, 3, 0, 80), (9, 3, 0, 80)]


def test_chaining_takes_the_best_order():
    """Against trying every ordered subset."""
    p, rng = substring_dedup.Passage(), random.Random(9)
    for _ in range(200):
        pieces = sorted((rng.randrange(60), rng.randrange(60), rng.randrange(5, 12)) for _ in range(7))

        def worth(c):
            out = c[0][2]
            for (a, b, n), (x, y, m) in zip(c, c[1:], strict=False):
                if a + n > x or b + n > y:
                    return -1
                out += m - p.gap_cost * (x - a - n + y - b - n)
            return out

        subsets = [[q for k, q in enumerate(pieces) if s >> k & 1] for s in range(1, 1 << len(pieces))]
        assert worth(next(iter(substring_dedup.chains(pieces, p)))) == pytest.approx(max(map(worth, subsets)))


def test_overlaps(spark, docs):
    rng = random.Random(6)
    items = [(i, " ".join(prose(rng, n, 10**9))) for i, n in enumerate((30, 45, 14, 8, 3, 60))] + [(9, None), (10, "")]
    rows = [(i, " ".join(prose(rng, 200, 10**9))) for i in range(40)]
    put = lambda i, own: rows.__setitem__(i, (i, f"{rows[i][1][:300]} {own} {rows[i][1][300:]}"))
    put(0, items[0][1])
    put(1, items[1][1].upper().replace(" ", ",\n"))
    changed = items[5][1].split()
    for k in range(4, 60, 8):
        changed[k] = "other"
    put(2, " ".join(changed))
    put(3, items[3][1])
    put(4, items[4][1])
    put(5, " ".join(items[1][1].split()[10:24]))
    put(6, " ".join(items[1][1].split()[10:16]))
    put(7, items[2][1])
    rows += [(40, None), (41, ""), (None, items[0][1]), (0, rows[0][1])]
    table, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in decontaminate.contaminated(table, bench).collect())
    assert got == sorted([("0", 0), ("0", 0), ("1", 1), ("2", 5), ("3", 3), ("5", 1), ("7", 2), ("None", 0)])
    assert decontaminate.clean(table, bench).count() == len(rows) - len(got)
    assert decontaminate.contaminated(table, bench.limit(0)).count() == 0 and decontaminate.clean(table.limit(0), bench).count() == 0


def test_overlaps_find_every_pattern():
    """All substitutions that leave 0.8 of an item's words, or of a stretch of 13 to 16 words, and some of longer ones."""
    rng = random.Random(13)
    item, around = prose(rng, 60, 10**9), prose(rng, 20, 10**9)
    for n in range(5, 41):
        may = n // 5
        some = (sorted(rng.sample(range(n), may)) for _ in range(300))
        patterns = list(combinations(range(n), may)) if n <= 16 else [*some, range(3, n, 4)[:may], range(4, n, 5)[:may]]
        for words, first in ((n, 0), (60, 11)) if n >= 13 else ((n, 0),):
            index = decontaminate.Index([(7, " ".join(item[:words]).encode())], decontaminate.Overlap())
            for pattern in patterns:
                text = item[first : first + n]
                for k in pattern:
                    text[k] = "other"
                got = list(index.overlaps(" ".join([*around, *text, *around]).encode()))
                assert got == [(7, 20, first, n, n - may)] or words > n and len(got) == 1 and got[0][3] >= n, (n, pattern)


def test_overlaps_find_every_copy(spark, docs):
    """Every benchmark item that stands in a document word for word, by plain search."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    items = [(r.item_id, " ".join(brute.words(r.text))) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in " ".join(brute.words(r.text))}
    assert want and want <= got


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_of_similarity(spark):
    """Pairs from 0.70 to 0.95, each with words of its own: none below 0.8 is joined, nearly all others are."""
    rng, rows, want = random.Random(8), [], {}
    for i in range(240):
        own = prose(rng, 300, 10**9)
        near = list(own)
        for k in rng.sample(range(300), 3 + i % 9):
            near[k] = f"edit{k}"
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(near))]
        want[2 * i] = jaccard(own, near)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    joined = {r.component_id for r in simhash.similar_texts(table).where("doc_id != component_id").collect()}
    assert all(want[i] >= 0.8 for i in joined)
    edge, easy = ({i for i, s in want.items() if low <= s < high} for low, high in ((0.8, 0.85), (0.85, 1)))
    assert len(edge) > 40 and len(joined & edge) >= 0.9 * len(edge) and len(joined & easy) >= 0.98 * len(easy)


def test_groups_with_a_far_foremost_text(spark):
    """Copies of one base, each with edits of its own, are unlike one another; so are templates that
    hold two unlike halves. Groups are those of plain links, but for bands that miss."""
    rng, rows = random.Random(21), []
    for g in range(6):
        base = prose(rng, 200, 10**9)
        for n in range(30):
            text = list(base)
            for k in rng.sample(range(200), 1 + n % 5):
                text[k] = f"e{rng.randrange(10**9)}"
            rows.append((len(rows), text))
    for g in range(10):
        template, rest = prose(rng, 170, 10**9), [prose(rng, 30, 10**9) for _ in range(4)]
        rows += [(len(rows) + n, [*template, *r, "x" if n % 2 else "y"]) for n, r in enumerate(r for r in rest for _ in range(2))]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in rows:
        for j, y in rows[:i]:
            if jaccard(x, y) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(6)
    for near in (simhash.Near(), simhash.Near(hubs=2)):
        got = {r.doc_id: r.component_id for r in simhash.similar_texts(table, near).collect()}
        same = sum(got[i] == find(i) for i, _ in rows)
        assert same >= 0.97 * len(rows), same


def test_one_of_each_group_stays(spark):
    rng = random.Random(5)
    a, b = prose(rng, 80, 10**9), prose(rng, 90, 10**9)
    near = [*a[:40], "new", *a[41:]]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (2, " ".join(near)), (9, " ".join(b).upper()), (9, None), (10, ""), (11, " \n"), (None, " ".join(a)), (None, None), (12, "one two"), (12, "one two"), (13, "word " * 4000), (14, "word " * 5000)]
    table = spark.createDataFrame([(*r, n, n, n, n) for n, r in enumerate(rows)], "doc_id long, text string, _id int, _hash int, node int, sig int")
    got = sorted(tuple(r)[2] for r in simhash.firsts(table).collect())
    assert got == [1, 2, 4, 7, 8, 9, 10, 11]
    assert simhash.firsts(table).columns == table.columns and simhash.firsts(table.limit(0)).count() == 0


def test_tables_go_and_bands_are_met_in_groups(spark, monkeypatch):
    """Of a run's tables only those stay that its result reads; however many bands are met at once, groups are the same."""
    folder = Path(common.shared_dir(spark).removeprefix("file://").removeprefix("file:"))
    rng, rows = random.Random(31), []
    for g in range(40):
        text = prose(rng, 120, 10**9)
        for n in range(4):
            rows.append((len(rows), " ".join([*text[: 20 * n], f"e{g}", *text[20 * n + 1 :]])))
    table, before = spark.createDataFrame(rows, "doc_id long, text string"), set(folder.iterdir())
    got = simhash.similar_texts(table)
    left = {p.name.split("-")[1] for p in set(folder.iterdir()) - before if p.name.startswith("weirflow-")}
    assert left == {"textids", "textcomponents"}
    assert len({r.component_id for r in got.collect()}) == 40
    monkeypatch.setattr(simhash, "_AT_ONCE", 24)
    assert sorted(got.collect()) == sorted(simhash.similar_texts(table).collect())


def test_kept_rows(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = {r.doc_id for r in quality_rules.judge(docs, labels).where("kept").collect()}
    clash = docs.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(1))
    got = quality_rules.kept(clash, labels)
    assert got.columns == clash.columns and {r.doc_id for r in got.collect()} == want


def test_pipeline_follows_its_stages(spark):
    import corpus_pipeline as c

    docs = c.table(spark, SF, "documents").select(*c.COLUMNS)
    for _, stage in c.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == list(c.COLUMNS)
        docs = c.materialize(after, "test")
    want = []
    for r in docs.collect():
        want.append((r.doc_id, len(brute.words(r.text))))
    got = c.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in want)
    assert max(r.start + r.n_tokens for r in got) == sum(r.n_tokens for r in got)


def test_tables_of_passages_go(spark):
    """Tables of pairs and rows of seeds are gone when passages are given."""
    folder = Path(common.shared_dir(spark).removeprefix("file://").removeprefix("file:"))
    rng, before = random.Random(12), set(folder.iterdir())
    passage = prose(rng, 60, 10**9)
    rows = [(i, " ".join([*prose(rng, 30, 10**9), *passage, *prose(rng, 30, 10**9)])) for i in range(20)]
    got = substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    left = {p.name.split("-")[1] for p in set(folder.iterdir()) - before if p.name.startswith("weirflow-")}
    assert not left & {"rowsofseeds", "pairsofrows", "seedpairs", "runs", "runowners", "shared", "spans", "morematches", "chains"}
    assert {r.doc_id for r in got.where("source_doc_id = 0").collect()} == set(range(1, 20))
