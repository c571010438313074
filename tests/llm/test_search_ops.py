"""Neighbours, decontamination and near-duplicates against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontamination, minhash, neighbours
from gridloom.llm.common import plain_words
from gridloom.llm.components import components

# neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, leaf string")


def run_search(spark, rows, **options):
    return neighbours.nearest(vectors(spark, rows), F.col("id") % 20 == 0, **options)


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[300:800] = x[300]  # a third of all rows are copies
    rows = [(i, v.tolist(), "clash", "clash") for i, v in enumerate(x)]
    rows += [(2000, None, "", ""), (2020, [0.0] * 16, "", ""), (2040, [float("nan")] * 16, "", ""), (2060, [None] * 16, "", ""), (2080, [1.0], "", ""), (None, [1.0] * 16, "", "")]
    rows += rows[:3]
    got = run_search(spark, rows, cell_rows=100, leaf_rows=16, block=60, max_sample=700).toPandas()
    y = x.astype(np.float64)
    hits = total = 0
    for q in range(0, 1500, 20):
        mine = got[got.query_id == q].sort_values("rank")
        scores = np.array([sum(a * b for a, b in zip(y[q], y[j], strict=True)) for j in mine.vec_id])
        assert mine["rank"].tolist() == list(range(1, 21)) and q not in set(mine.vec_id)
        assert np.allclose(scores, mine.score, rtol=0, atol=1e-12)
        assert list(zip(-mine.score, mine.vec_id, strict=True)) == sorted(zip(-mine.score, mine.vec_id, strict=True))
        s = y @ y[q]
        s[q] = -np.inf
        best = np.partition(s, -20)[-20]
        hits += (mine.score >= best - 1e-9).sum()
        total += 20
    assert hits / total >= 0.9
    copies = got[got.query_id == 300]
    assert copies.vec_id.tolist() == list(range(301, 321)) or set(copies.score) != {copies.score.max()}
    assert not set(got.query_id) & {2000, 2020, 2040, 2060, 2080}


def test_neighbours_few_and_none(spark):
    got = run_search(spark, [(0, [1.0, 0.0], "", ""), (1, [0.5, 1.0], "", ""), (2, [1.0, 0.0], "", "")]).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]
    assert run_search(spark, []).count() == 0


# decontamination


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string")


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string")


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_leaks_are_found(spark):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, rng.randrange(12, 60))), "clash") for i in range(50)] + [(90, None, ""), (91, "", ""), (92, "short one", ""), (0, "again " + " ".join(words(rng, 20)), "")]
    rows = []
    for d in range(120):
        t = words(rng, rng.randrange(0, 900))
        if d % 4 == 0:
            at = rng.randrange(len(t) + 1)
            t[at:at] = items[d % 50][1].upper().split()
        rows.append((d, " ".join(t)))
    rows += [(200, None), (201, ""), (202, "short one"), (203, " ".join(items[5][1].split()[: len(items[5][1].split()) // 2])), (0, rows[0][1])]
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs_of(spark, rows), bench(spark, items), block_bytes=4000).collect()}
    want = {(d, d % 50) for d in range(0, 120, 4)} | {(202, 92)}
    assert got == want
    kept = decontamination.drop_contaminated(docs_of(spark, rows), bench(spark, items))
    assert kept.columns == ["doc_id", "text", "score"] and {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontamination.find_leaks(docs_of(spark, []), bench(spark, items)).count() == 0
    assert decontamination.find_leaks(docs_of(spark, rows), bench(spark, [])).count() == 0


def near_verbatim(item, passage):
    """Whether the words stand in the passage with one replaced, left out or put in: every such text is tried."""
    n = len(item)
    for at in range(len(passage)):
        for size in (n - 1, n, n + 1):
            there = passage[at : at + size]
            if len(there) != size:
                continue
            if size == n and sum(a != b for a, b in zip(item, there, strict=True)) <= 1:
                return True
            short, long = (there, item) if size < n else (item, there)
            if size != n and any(long[:i] + long[i + 1 :] == short for i in range(len(long))):
                return True
    return False


def leaks_brute(rows, items, threshold, two_columns):
    """BM25 over word pairs, every passage against every item, and the overlaps, in plain Python."""
    pairs = lambda w: list(zip(w, w[1:], strict=False)) if len(w) > 1 else [tuple(w)]
    runs = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
    tidy = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    known = []
    for key, q, a in items:
        w = tidy(q)
        one = not two_columns or a is None
        cut = len(w) - max(1, len(w) // 4) if len(w) > 1 else len(w)
        question, answer = (w[:cut], w[cut:]) if one else (w, tidy(a))
        if question + answer:
            known.append((key, question, answer, one))
    terms = [pairs(q + a) for _, q, a, _ in known]
    df = Counter(t for x in terms for t in set(x))
    average = max(1.0, sum(map(len, terms)) / max(1, len(terms)))
    step = max([len(q + a) for _, q, a, _ in known], default=1)
    out = []
    for (key, question, answer, one), x in zip(known, terms, strict=True):
        tf = Counter(x)
        impact = {t: math.log1p((len(known) - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(x) / average)) for t, c in tf.items()}
        whole = sum(impact.values())
        for doc, text in rows:
            words, best = tidy(text), None
            for s in range(0, max(1, len(words) - step), step):
                passage = words[s : s + 2 * step]
                if not passage:
                    continue
                score = sum(impact.get(t, 0) for t in set(pairs(passage))) / whole
                share = lambda w, k: 1.0 if k == 0 else len(runs(w, k) & runs(passage, k)) / len(runs(w, k))  # noqa: B023, E731
                q, a = share(question, min(5, len(question))), share(answer, min(5, len(answer)))
                held = min(q, a) >= 0.8
                if one and not held:
                    item = question + answer
                    edited = q >= 1 - 5 / max(5, len(set(runs(question, min(5, len(question)))))) - 1e-12 and a >= 1 - 5 / max(5, len(runs(answer, min(5, len(answer))))) - 1e-12
                    held = edited and share(item, min(5, len(item))) >= 0.8 or len(item) >= 5 and near_verbatim(item, passage)
                if score >= threshold - 1e-9 and held and (best is None or score > best[0] + 1e-12):
                    best = (score, q, a, s)
            if best:
                out.append((doc, key, *best))
    return out


@pytest.mark.parametrize("two_columns", [False, True])
def test_leaks_against_brute_force_for_any_block_size(spark, two_columns):
    rng = random.Random(8)
    shared = words(rng, 12, 50)
    items = []
    for i in range(60):
        w = (shared if i % 2 else []) + words(rng, rng.randrange(2, 30), 200)
        items.append((i, " ".join(w), " ".join(words(rng, 1 + i % 9, 200)) if i % 7 else None))
    items += [(100, "", "only an answer here"), (101, None, "and one more answer"), (102, "word", None), (103, " .,", "  "), (5, items[5][1], items[5][2])]
    rows = []
    for d in range(50):
        key, q, a = items[d]
        w = q.split() + (a or "").split() * two_columns
        if d % 3 == 1:
            w[rng.randrange(len(w))] = "edit"
        if d % 3 == 2:
            w = w[: -max(1, len(w) // 5)]
        rows.append((d, " ".join(words(rng, rng.randrange(80), 200) + w + words(rng, rng.randrange(80), 200))))
    rows += [(60, " ".join(shared)), (61, None), (62, ""), (63, "word"), (64, "Only an ANSWER, here!"), (65, " ".join(words(rng, 1500, 300) + items[7][1].split() + (items[7][2] or "").split() + words(rng, 900, 300)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string, answer string")
    columns = {"question_col": "text", "answer_col": "answer"} if two_columns else {}
    want = sorted(leaks_brute(rows, items, 0.5, two_columns))
    found = {}
    for size in (2000, 8_000_000):
        got = decontamination.find_leaks(docs, table.repartition(3), block_bytes=size, **columns).collect()
        found[size] = sorted(tuple(r) for r in got)
        kept = decontamination.drop_contaminated(docs, table, block_bytes=size, **columns)
        assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in rows} - {w[0] for w in want}) and kept.columns == docs.columns
    assert found[2000] == found[8_000_000]
    assert len(want) > 20 and [w[:2] for w in want] == [f[:2] for f in found[2000]]
    for w, f in zip(want, found[2000], strict=True):
        assert all(abs(x - y) < 1e-9 for x, y in zip(w[2:], f[2:], strict=True)), (w, f)


@pytest.mark.parametrize("seed", range(12))
def test_block_max_wand_finds_all_above_threshold(seed):
    rng = random.Random(seed)
    hashes = [plain_words(" ".join(words(rng, rng.randrange(3, 40), 60)))[2] for _ in range(120)]
    index = decontamination.Index(list(range(120)), hashes, [h[:0] for h in hashes], 0.1 + 0.05 * (seed % 6))
    for _ in range(20):
        terms = np.array(sorted(rng.sample(range(len(index.terms)), min(len(index.terms), rng.randrange(1, 60)))))
        score = np.zeros(120)
        for t in terms:
            a, b = index.first[t], index.first[t + 1]
            score[index.items[a:b]] += index.impacts[a:b]
        want = {i for i in range(120) if score[i] >= index.threshold}
        found = dict(index.search(terms))
        assert set(found) == want and all(abs(found[i] - score[i]) < 1e-9 for i in want)


@pytest.mark.parametrize("n", [12, 20, 24, 28, 29, 36])
def test_leaks_with_one_edit_at_every_place(n):
    rng = random.Random(n)
    items = [words(rng, n) for _ in range(30)]
    parts = [decontamination.split_item(" ".join(w)) for w in items]
    index = decontamination._index([(i, q, a, True) for i, (q, a) in enumerate(parts)], 0.5)
    for at in range(n):
        item = at % 30
        w = items[item]
        for edited in (w[:at] + ["edit"] + w[at + 1 :], w[:at] + ["edit"] + w[at:], w[:at] + w[at + 1 :]):
            text = " ".join(words(rng, rng.randrange(90)) + edited + words(rng, rng.randrange(90)))
            assert [x[0] for x in index.leaks(text)] == [item], (at, edited)
        question = w[: len(parts[item][0])]
        assert index.leaks(" ".join(words(rng, 30) + question + words(rng, 30))) == []
    apart = decontamination.Index([0], [parts[0][0]], [parts[0][1]], 0.5)  # two columns: each part by itself
    assert apart.leaks(" ".join(items[0])) and not apart.leaks(" ".join(items[0][:-3] + ["edit"] + items[0][-2:]))


# near-duplicates


def sets_brute(rows):
    out = {}
    for d, t in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).replace("\t", " ").replace("\n", " ").split(" ") if x]
        out[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def groups_brute(rows, threshold):
    s = sets_brute(rows)
    ids = sorted(s)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= threshold * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s[d]), find(d)) for d in ids}


@pytest.mark.parametrize("threshold", [80, 85])
def test_near_duplicates_against_brute_force(spark, threshold):
    rng = random.Random(threshold)
    base = words(rng, 120)
    rows, n = [], 0
    for k in range(90):  # one large family with edits, whose members do not all link to the smallest
        t = list(base)
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = f"edit{k}"
        rows.append((n := n + 1, " ".join(t)))
    chain = words(rng, 100)
    for k in range(12):  # a chain: only neighbours link
        chain = chain[3:] + words(rng, 3)
        rows.append((n := n + 1, " ".join(chain)))
    passage = words(rng, 40)
    rows += [(n := n + 1, " ".join(passage + words(rng, rng.randrange(3, 60)))) for _ in range(90)]
    rows += [(n := n + 1, "The Same  text\n Here") for _ in range(40)] + [(n := n + 1, x) for x in (None, "", " \t\n", "one", "ONE", "a b", "A\tB", "x " * 20000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs_of(spark, rows), threshold).collect()}
    assert got == groups_brute(rows, threshold)


def test_near_duplicates_odd_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, "a b c d e f"), (2, None)]
    got = sorted(minhash.near_duplicates(docs_of(spark, rows)).collect(), key=str)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(5, 5, True), (9, 5, False), (2, 2, True), (None, None, False)} and len(got) == 5
    kept = minhash.drop_near_duplicates(docs_of(spark, rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "5", "None"] and kept.columns == ["doc_id", "text", "score"]
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("large", [2, 10**6])
def test_near_duplicates_alike_by_either_way(spark, monkeypatch, large):
    monkeypatch.setattr(minhash, "LARGE_BUCKET", large)
    monkeypatch.setattr(minhash, "COMMON", 4)
    test_near_duplicates_against_brute_force(spark, 85)


def test_near_duplicates_checkpoint_few_wide_tables(spark, monkeypatch):
    """Signatures and sets are checkpointed once each at most (a file of a checkpoint costs a process), and what is kept instead is let go."""
    wide, before = [], spark.sparkContext._jsc.getPersistentRDDs().size()
    real = minhash.durable
    monkeypatch.setattr(minhash, "durable", lambda df: wide.extend({"sig", "set", "key"} & set(df.columns)) or real(df))
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:59], str(i % 3)])) for i in range(12)] + [(50, "quite another text of seven words")]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == {i: 0 for i in range(12)} | {50: 50}
    assert wide.count("sig") == 1 and "set" not in wide
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_near_duplicates_keep_different_texts_of_an_id(spark):
    rng = random.Random(12)
    a, b, c = (words(rng, 40) for _ in range(3))
    edit = lambda w, x: " ".join([*w[:-1], x])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (5, " ".join(a)), (7, edit(a, "q")), (3, edit(b, "r")), (9, " ".join(c)), (9, edit(c, "s")), (1, None), (1, ""), (1, " ")]
    for _ in range(1):
        got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs_of(spark, rows).repartition(4)).collect())
        assert got == Counter({(5, 5, True): 2, (5, 3, False): 1, (7, 5, False): 1, (3, 3, True): 1, (9, 9, True): 2, (1, 1, True): 3})
        kept = Counter((r.doc_id, r.text) for r in minhash.drop_near_duplicates(docs_of(spark, rows).repartition(4)).collect())
        nine = [k for k in kept if k[0] == 9]
        assert len(nine) == 1 and nine[0] in rows
        # null and empty texts count as equal
        assert kept[1, None] + kept[1, ""] == 1 and kept[1, " "] == 1
        assert {k: n for k, n in kept.items() if k[0] not in (1, 9)} == {(5, rows[0][1]): 1, (3, rows[4][1]): 1}


def test_band_counts():
    assert minhash.bands_for(80) == 31 and minhash.bands_for(85) == 22
    for t in range(minhash.LEAST_THRESHOLD, 100):
        assert (1 - (t / 100) ** minhash.ROWS) ** minhash.bands_for(t) <= 1e-7
    with pytest.raises(ValueError):
        minhash.bands_for(20)


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(500, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: root[x] for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_run_no_round_on_stars(spark, monkeypatch):
    """Edges that are stars already are written once; repeated and reversed ones are still one row a node."""
    real, written = components.__globals__["durable"], []
    monkeypatch.setattr("gridloom.llm.components.durable", lambda df: written.append(1) or real(df))
    for edges, rounds in (([(100, 100 + i) for i in range(1, 80)], 0), ([(1, 2), (2, 1), (1, 2), (3, 1)], 1)):
        written.clear()
        got = [tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()]
        assert sorted(got) == [(x, min(e[0] for e in edges)) for x in sorted({x for e in edges for x in e})]
        assert len(written) == 1 + rounds


def test_near_duplicates_run_few_tasks(spark):
    """Each task of a stage costs the driver memory and the disk shuffle files, however few rows there are."""
    sc, group = spark.sparkContext, "near-duplicates-tasks"
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:59], str(i % 3)])) for i in range(12)] + [(50, "quite another text of seven words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sc.setJobGroup(group, group)
    try:
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 85).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: 0 for i in range(12)} | {50: 50}
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(tracker.getStageInfo(s).numCompletedTasks for s in stages)
    assert tasks <= 300
