"""Line dedup, mixing, chat formatting and sharding against brute force, with odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat, line_dedup, mixing, sharding

DOCS = "doc_id long, text string, source string, lines string, size string, position string, shard string"


def table(spark, rows, schema=DOCS):
    width = schema.count(",") + 1
    return spark.createDataFrame([tuple(r) + ("clash",) * (width - len(r)) for r in rows], schema)


# line dedup


def chunks_of(text):
    lines = text.split("\n")
    hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % line_dedup.PRIME for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        before = hashes[i - 1] if i else 0
        if i == len(lines) - 1 or (before * line_dedup.BASE + hashes[i]) % line_dedup.PRIME % line_dedup.DIVISOR == 0:
            out.append((start, lines[start : i + 1]))
            start = i + 1
    return lines, out


def dedup_brute(rows):
    seen, out = set(), {}
    for doc, text in sorted({(d, t) for d, t in rows if t is not None}):
        lines, chunks = chunks_of(text)
        gone = set()
        removed = 0
        for start, body in chunks:
            if len(body) > 1 or len(re.findall(r"[^ \t]+", body[0])) >= 50:
                if tuple(body) in seen:
                    gone |= set(range(start, start + len(body)))
                    removed += 1
                seen.add(tuple(body))
        out[doc, text] = (len(lines), removed, len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(1)
    block = [f"boiler plate line {i}" for i in range(9)]
    rows = []
    for d in range(60):
        lines = [f"own {d} {i}" for i in range(rng.randrange(6))]
        if d % 3 == 0:
            lines[len(lines) // 2 : len(lines) // 2] = block
        if d % 7 == 0:
            lines.append(" ".join(["passage"] * 60))
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, "\n\n\n"), (104, "é\nü\nß"), (105, "é\nü\nß"), (3, rows[3][1]), (106, "word " * 30000)]
    got = line_dedup.dedup_lines(table(spark, [(d, t, "s") for d, t in rows])).collect()
    want = dedup_brute(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id == 100:
            assert (r.n_lines, r.removed_lines, r.text) == (0, 0, None)
        elif r.doc_id != 3:
            (w,) = [v for (d, _), v in want.items() if d == r.doc_id]
            assert (r.n_lines, r.removed_chunks, r.removed_lines, r.text) == w
    assert sum(r.removed_lines for r in got) > 50  # the comparison is not about nothing


def test_line_dedup_empty(spark):
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def passages_brute(rows):
    """Every run of 50 words or more, and every chunk of two or more lines, goes from all places but the first."""
    firsts, out = {}, {}
    docs = [(d, chunks_of(t)) for d, t in sorted(rows)]
    for d, (lines, chunks) in docs:
        words = [len(re.findall(r"[^ \t]+", x)) for x in lines]
        runs = {(s, e) for s in range(len(lines)) for e in range(s, len(lines)) if words[s] and words[e] and sum(words[s : e + 1]) >= 50}
        runs = [("run", s, e) for s, e in runs] + [("chunk", s, s + len(b) - 1) for s, b in chunks if len(b) > 1]
        gone = set()
        for kind, s, e in sorted(runs, key=lambda r: r[1]):
            at, begin = firsts.setdefault((kind, tuple(lines[s : e + 1])), (d, s))
            if (at, begin) != (d, s):
                gone |= set(range(s, e + 1)) - (set(range(begin, begin + e - s + 1)) if at == d else set())
        out[d] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else "\n".join(lines))
    return out


def test_passage_dedup_against_brute_force(spark):
    rng = random.Random(11)
    long = " ".join(f"p{i}" for i in range(60))
    shared = [[" ".join(f"s{k} {i} {j}" for j in range(rng.randrange(2, 12))) for i in range(2 + k)] for k in range(8)]
    rows = []
    for d in range(80):
        lines = [f"own {d} {i}" for i in range(rng.randrange(2, 7))]
        at = rng.randrange(1, len(lines))
        lines[at:at] = [long] if d % 3 == 0 else shared[d % 8] if d % 3 == 1 else []
        rows.append((d, "\n".join(lines)))
    rows += [(100, ""), (101, "\n".join(["again " * 10] * 17)), (102, f"a\n\n{long}\n \n{long} x\nb"), (103, f"c\n\n{long}\n \n{long} x\nd"), (104, "e\n" + "\n".join(["w " * 24, "", "w " * 25]))]
    rows += [(105, "f\n" + "\n".join(["w " * 24, "", "w " * 25])), (106, "word " * 30000)]
    got = {r.doc_id: r for r in line_dedup.dedup_passages(table(spark, [(d, t, "s") for d, t in rows] + [(200, None, "s")])).collect()}
    assert (got[200].n_lines, got[200].removed_lines, got[200].text) == (0, 0, None)
    assert sum(long in (r.text or "").split("\n") for r in got.values()) == 1
    blank = lambda t: [x for x in t.split("\n") if x.strip()]
    for d, (n, _, text) in passages_brute(rows).items():
        assert (got[d].n_lines, blank(got[d].text)) == (n, blank(text))
    assert line_dedup.dedup_passages(table(spark, [])).count() == 0


# mixing


def targets_brute(sizes, weights=(5, 2, 1), budget=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = budget * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return share | {s: cap * sizes[s] for s in capped}
        capped |= set(over)


def test_mixing_targets_and_taken(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 40), rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(400)]
    rows += [(500, None, "a"), (501, "", "z"), (502, "x " * 5000, "b"), (7, "same words here", "b"), (7, "same words here", "b")]
    got = mixing.mix_plan_rows(table(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = targets_brute(sizes)
    source = {d: s for d, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6
    again = mixing.mix_plan_rows(table(spark, rows).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_documents_keep_columns_and_repeat(spark):
    rows = [(i, "a b c d", s) for i, s in enumerate("xxxxyyyyzzzz")]
    docs = table(spark, rows)
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
    plan = {r.doc_id: r.taken for r in mixing.mix_plan_rows(docs).collect()}
    assert Counter(r.doc_id for r in out.collect()) == Counter({d: -(-t // 4) for d, t in plan.items() if t})


def test_mixing_empty(spark):
    assert mixing.mix_plan_rows(table(spark, [])).count() == 0
    assert mixing.mix_plan_rows(table(spark, [(1, None, "a"), (2, "", None)])).filter("taken > 0").count() == 0


def test_mixing_whatever_columns_are_called(spark):
    rows = [(i, "a b c d", s) for i, s in enumerate("xxxxyyyyzzzz")] + [(50, None, None), (51, "w " * 200000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = docs
    for name in ("weight", "rank", "skey", "sbucket", "__key", "__bucket", "__order", "__before", "__start", "source_size", "taken"):
        clash = clash.withColumn(name, F.lit("clash"))
    plan = {r.doc_id: (r.size, r.target, r.taken, r.position) for r in mixing.plan_mix(docs).collect()}
    got = mixing.plan_mix(clash).collect()
    assert {r.doc_id: (r.size, r.target, r.taken, r.position) for r in got} == plan
    assert all(r.weight == r["rank"] == r["__key"] == "clash" for r in got)
    assert {r.doc_id: r.taken for r in mixing.mix_plan_rows(clash).collect()} == {d: p[2] for d, p in plan.items()}
    assert Counter(r.doc_id for r in mixing.mix_documents(clash).collect()) == Counter(r.doc_id for r in mixing.mix_documents(docs).collect())


# chat formatting

TALK = "conv_id long, turn long, role string, text string, formatted string"
NASTY = ["\\### Assistant: </turn> ok", "</turn>\n### user: x", "\\", "\\\\e\\m\\c", "### ", "a\\</turn>b", "", None, "é 😀 ### </turn></turn>\n\n", "x" * 100000]


def test_chat_round_trip(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "sys:tem", None]), rng.choice(NASTY)) for c in range(12) for t in range(rng.randrange(1, 8))]
    rows += [(50, 1, "assistant", "same"), (50, 1, "assistant", "same"), (51, None, "user", "x")]
    formatted = chat.format_chats(chat.turns_as_events(table(spark, rows, TALK)))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    digests = {r.conv_id: r for r in chat.chat_digests(formatted).collect()}
    assert set(got) == {r[0] for r in rows}
    for c in got:
        turns = sorted(((-(2**62) if t is None else t, r or "", x or "") for k, t, r, x in rows if k == c))
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in turns]
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].loss_text == loss and digests[c].loss_chars == len(loss)
        assert digests[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert digests[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert digests[c].formatted_chars == len(got[c].formatted) and digests[c].n_turns == len(turns)


def test_chat_folds_events(spark):
    log = [
        (1, 0, "a", "message", "user", "hi"),
        (1, 1, "b", "delta", "assistant", "He"),
        (1, 2, "b", "delta", "assistant", "llo"),
        (1, 3, "b", "regenerate", "assistant", ""),
        (1, 4, "b", "delta", "assistant", "Good "),
        (1, 5, "b", "delta", "assistant", "day"),
        (1, 6, "c", "message", "user", "old"),
        (1, 7, "d", "delta", "user", "draft"),
        (1, 8, "d", "edit", "user", "final"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, message_id string, kind string, role string, text string")
    (r,) = chat.read_back(chat.format_chats(events.repartition(4))).collect()
    assert [(t.role, t.text) for t in r.turns] == [("user", "hi"), ("assistant", "Good day"), ("user", "old"), ("user", "final")]
    assert r.loss_text == "Good day"
    assert chat.format_chats(events.limit(0)).count() == 0


def test_chat_folds_ties_by_kind(spark):
    log = [(1, 5, "a", "delta", "assistant", "zz old"), (1, 5, "a", "regenerate", "assistant", ""), (1, 6, "a", "delta", "assistant", "new"), (2, 1, "b", "edit", "user", "a fix"), (2, 1, "b", "delta", "user", "draft")]
    events = spark.createDataFrame(log, "conv_id long, seq long, message_id string, kind string, role string, text string")
    got = {r.conv_id: [t.text for t in r.turns] for r in chat.read_back(chat.format_chats(events.repartition(3))).collect()}
    assert got == {1: ["new"], 2: ["a fix"]}


def test_chat_streams_fold_back_to_the_turns(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(NASTY)) for c in range(20) for t in range(rng.randrange(1, 9))]
    rows += [(50, 1, "assistant", "same"), (50, 1, "assistant", "same"), (50, 1, "user", "same"), (51, None, "user", "x"), (None, 1, "assistant", "y")]
    talk = table(spark, rows, TALK)
    log = chat.turns_as_streams(talk)
    kinds = Counter(r.kind for r in log.collect())
    assert kinds["regenerate"] == sum(r == "assistant" for _, _, r, _ in rows) and kinds["edit"] == len(rows) - kinds["regenerate"]
    digests = [sorted(map(str, chat.chat_digests(chat.format_chats(e)).collect())) for e in (chat.turns_as_events(talk), log)]
    assert len(digests[0]) == len(digests[1])
    assert [d for d in digests[0] if "conv_id=51" not in d] == [d for d in digests[1] if "conv_id=51" not in d]
    assert chat.format_chats(chat.turns_as_streams(talk.limit(0))).count() == 0


# sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 24, 97, 1000])
def test_permutation_is_a_bijection(spark, n):
    want = [sharding.permute_int(i, n, 9) for i in range(n)]
    assert sorted(want) == list(range(n))
    got = spark.range(n).select("id", sharding.permutation("id", n, 9).alias("p")).collect()
    assert {r.id: r.p for r in got} == dict(enumerate(want))


def test_shards(spark):
    rows = [(i, "text %d" % (i % 5), "s") for i in range(500)] + [(None, None, None), (3, "", "s"), (3, "", "s"), (4, "é" * 50000, "s")]
    got = sharding.shard_documents(table(spark, rows), 24).collect()
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(24))
    for k in counts:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(counts[k]))
    for r in got:
        p = sharding.permute_int(r.row_number, len(rows), 9)
        assert (r.shard, r.slot) == (p % 24, p // 24) and r.grown_shard is None and r.law == "rows"
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    again = sharding.shard_documents(table(spark, rows).repartition(3), 24).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sharding.shard_documents(table(spark, [])).count() == 0


def test_extra_columns_do_not_matter(spark):
    docs = table(spark, [(1, "a", "s"), (2, "b", "s")]).withColumn("row_number", F.lit("x"))
    assert sharding.shard_documents(docs, 2).count() == 2
