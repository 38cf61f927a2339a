"""Repair, prefix trie and toxicity against brute force, and on awkward rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnspark.llm import repair, toxicity, trie

SF = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def ordered(rows):
    return sorted(rows, key=str)


def given(spark, sf=SF):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]


# --- op11 ------------------------------------------------------------------------------------------------------------------


def brute_audit(rows):
    """(cost, letters) by the definition, with pairs in place of integers; up to three inserts anywhere."""

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "")] if i == len(rows) and state in (0, 3) else []
        after = 3 if state == 2 else 2
        if inserts < 3:
            cost, letters = best(i, after, inserts + 1)
            found.append((cost + 2, "I" + letters))
        if i < len(rows):
            initial, fault = rows[i]
            late = fault == "truncated"
            cost, letters = best(i + 1, state, 0)
            found.append((cost + 3, "D" + letters))
            if fault in (None, "truncated"):
                cost, letters = best(i + 1, after, 0)
                found.append((cost + 2 + late, "R" + letters))
                if (state, initial) in STEP:
                    cost, letters = best(i + 1, STEP[state, initial], 0)
                    found.append((cost + late, "K" + letters))
        return min(found) if found else (10**9, "")

    return best(0, 0, 0)


def brute_summary(conv, rows):
    """The row of one conversation (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        tail = text.rstrip(repair.SPACES)
        faults.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    initials = [r[:1] if r[:1] in ("s", "u", "a") else "" for _, r, _ in rows]
    cost, letters = brute_audit(tuple(zip(initials, faults, strict=True)))
    lines, left, state = [], list(rows), 0
    for letter in letters:
        new, after = ("assistant", 3) if state == 2 else ("user", 2)
        if letter == "I":
            lines.append(f"{new}:")
            state = after
            continue
        _, role, text = left.pop(0)
        if letter == "R":
            lines.append(f"{new}:{text}")
            state = after
        elif letter == "K":
            lines.append(f"{role}:{text}")
            state = STEP[state, role[0]]
    return (conv, gaps, *(faults.count(f) for f in repair.FAULTS), illegal, cost, letters, H("\n".join(lines)))


def brute_repair(rows):
    convs = {c: [] for c, *_ in rows}
    space = lambda v: " " if v is None else v
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
        convs[conv] += [(turn is not None, turn or 0, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return ordered(brute_summary(c, [(t if known else None, r, x) for known, t, r, x in sorted(v)]) for c, v in convs.items())


def test_audits_equal_brute_force():
    rng = random.Random(11)
    pick = lambda: (rng.choice(["s", "u", "a", ""]), rng.choice([None, None, None, "blank", "duplicate", "truncated"]))
    for n in [*range(7)] * 60 + [63, 64, 65, 150] * 3:
        rows = [pick() for _ in range(n)]
        assert repair.audit(iter(rows)) == brute_audit(tuple(rows))


def test_long_conversations_take_linear_time():
    rng = random.Random(12)
    cost, letters = repair.audit((rng.choice(["u", "a"]), None) for _ in range(50_000))
    assert len(letters) >= 50_000 and cost > 0


def test_op11_brute_force(spark):
    assert ordered(map(tuple, repair.op11_repair(spark, SF).collect())) == brute_repair(given(spark))


def odd_conversations(spark):
    """Nulls everywhere, ties, repeated rows, roles of all kinds, long texts and a long conversation."""
    rng = random.Random(13)
    roles, texts = [None, "", " ", "system", "user", "assistant", "tool", "User"], [None, "", " \t", "hello", "hello.", "no end, \n", "ok!  ", "é" * 9000 + "?", "colon: a\nb."]
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 7]), rng.choice(roles), rng.choice(texts)) for c in [None, -7, 0, 1, 5, 101, 205, 300] for _ in range(rng.randrange(1, 9))]
    rows += rows[:6] + [(400, i, "user" if i % 3 else "assistant", f"line {i % 50}.") for i in range(150)]
    return rows


def test_op11_awkward(spark, tmp_path):
    rows = odd_conversations(spark)
    df = spark.createDataFrame(rows, ROWS).withColumn("fault", F.lit("clash")).withColumn("step", F.lit(1))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert ordered(map(tuple, repair.op11_repair(spark, str(tmp_path)).collect())) == brute_repair(rows)
    df.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert repair.op11_repair(spark, f"{tmp_path}/none").collect() == []


def test_repaired_conversations_alternate(spark):
    edits = repair.repair(spark.createDataFrame(odd_conversations(spark), ROWS)).where("role is not null").collect()
    convs = defaultdict(list)
    for r in sorted(edits, key=lambda r: r.step):
        convs[r.conv_id].append(r.role)
    for roles in convs.values():
        turns = roles[1:] if roles[0][0] == "s" else roles
        assert len(turns) % 2 == 0 and all(r[0] == "ua"[i % 2] for i, r in enumerate(turns))


# --- op12 ------------------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = (defaultdict(int) for _ in range(3))
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p: H(",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p)))
    return ordered((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


def test_op12_brute_force(spark):
    assert ordered(map(tuple, trie.op12_trie(spark, SF).collect())) == brute_trie(given(spark))


@pytest.mark.parametrize("shard", [1, 7, 60])
def test_op12_crowns_of_any_depth(spark, shard):
    rng = random.Random(14)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc"])) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(c, t, "user", f"copy {t}") for c in (200, 300, 400) for t in range(40)]
    steps = trie.rebuilt_steps(spark.createDataFrame(rows, ROWS))
    assert ordered(map(tuple, trie.prefix_trie(steps, shard).collect())) == brute_trie(rows)


def test_op12_awkward(spark, tmp_path):
    rows = odd_conversations(spark)
    df = spark.createDataFrame(rows, ROWS).withColumn("depth", F.lit(1)).withColumn("hi", F.lit("clash"))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert ordered(map(tuple, trie.op12_trie(spark, str(tmp_path)).collect())) == brute_trie(rows)
    df.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert trie.op12_trie(spark, f"{tmp_path}/none").collect() == []


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(15)
    hi, lo = rng.integers(-(2**63), 2**63 - 1, 5000), rng.integers(-(2**63), 2**63 - 1, 5000)
    hi[1000:2000] = hi[:1000]  # half of a digest may repeat
    slots = trie.Slots(hi, lo)
    assert sorted(slots.at) == list(range(5000)) and (slots.of(hi, lo) == slots.at).all()
    assert (slots.of(hi, lo + 1) == -1).all()


# --- op13 ------------------------------------------------------------------------------------------------------------------


def labelled_texts(spark, n=600):
    """Texts whose label needs a pair: an insult with a group is toxic, either alone is not; a third of all rows are one text."""
    rng = random.Random(16)
    filler = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(filler) for _ in range(rng.randrange(5, 60))]
        kind = rng.randrange(4)
        words += ["insult"] * (kind in (1, 3)) + ["people"] * (kind in (2, 3))
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(kind == 3)))
    rows += [(n + i, "one common text of no harm", 0) for i in range(n // 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_op13_learns_pairs(spark):
    rows = labelled_texts(spark)
    machine = toxicity.train(rows.where(~toxicity.held_out()), rows.select("doc_id", "toxic"))
    kept = rows.where(toxicity.held_out()).collect()
    right = [(machine.score(r.text) >= 0.5) == bool(r.toxic) for r in kept]
    assert sum(right) / len(right) > 0.98
    alone = [machine.score(t) for t in ("insult", "people", "insult words", "")]
    assert machine.score("insult people") > 0.5 > max(alone)


def test_op13_logit_is_the_sum_over_pairs():
    rng = np.random.default_rng(17)
    m = toxicity.Machine(np.arange(6), rng.normal(size=6), rng.normal(size=(6, 3)), -0.5)
    at = np.array([0, 2, 3, 5])
    pairs = sum(m.factors[i] @ m.factors[j] for i in at for j in at if i < j)
    assert math.isclose(m.logit(at), -0.5 + m.weights[at].sum() + pairs)


def test_op13_gradients_lower_the_loss():
    rng = np.random.default_rng(18)
    rows = [np.flatnonzero(rng.random(8) < 0.4) for _ in range(200)]
    labels = np.array([float(0 in r and 1 in r) for r in rows])
    loss = lambda m: np.mean([np.log1p(np.exp(-(2 * y - 1) * m.logit(r))) for r, y in zip(rows, labels, strict=True)])
    losses = [loss(toxicity.fit(np.arange(8), rows, labels, epochs=e)) for e in (1, 30, 300)]
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.1


def test_op13_counts_brute_force(spark):
    rows = [(r.text, r.toxic) for r in labelled_texts(spark, 80).collect()]
    want = defaultdict(lambda: [0, 0])
    for text, toxic in rows:
        for t in toxicity.terms(text):
            want[int(t)][1 - toxic] += 1
    got = toxicity.term_counts(spark.createDataFrame(rows, "text string, toxic int")).collect()
    assert {r.term: [r.toxic, r.clean] for r in got} == dict(want)


def test_op13_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in toxicity.op13_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = [(got[d].predicted, t) for d, t in labels.items() if got[d].held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 for d, r in got.items())
    assert sum(p == t for p, t in kept) / len(kept) > 0.95 and sum(p > t for p, t in kept) <= 1


def test_op13_awkward(spark, tmp_path):
    texts = [(1, None), (2, ""), (None, "insult people"), (3, "word " * 50_000), (4, "12 !"), (4, "insult"), (4, "insult")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("score", F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (2, None), (None, 1), (4, 1), (4, 0), (9, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op13_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    machine = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    scores = {(r.score, r.predicted, r.score_in) for r in toxicity.scored(docs, machine).collect()}
    assert len(scores) == 1 and next(iter(scores))[1:] == (0, "clash") and next(iter(scores))[0] < 1e-9
    assert toxicity.scored(docs.limit(0), machine).collect() == []


def test_sql_equals_brute_force(spark):
    """The SQL of both operators, on the given rows and on odd ones."""
    import duckdb

    from cairnspark.llm.conversation_sql import OP11_SQL, OP12_SQL

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    for rows in (given(spark), odd_conversations(spark)):
        con.execute("DELETE FROM conversations")
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        assert ordered(con.execute(OP11_SQL).fetchall()) == brute_repair(rows)
        assert ordered(con.execute(OP12_SQL).fetchall()) == brute_trie(rows)
