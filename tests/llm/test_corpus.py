"""The corpus operators against brute force, and on awkward rows."""

import collections
import hashlib
import json
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairnspark.llm import ann, bwt, chat, decontaminate, jaccard, kernels, language, lines, pii, queries, rlz, sentencepiece_codec, shared, simhash

SF = "/root/testdata/sf0.001"
H = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def awkward(spark):
    """Nulls, empty and odd texts, ties, repeated rows, and a column whose name clashes with the operators'."""
    long_ = " ".join(f"w{i % 997}x{i % 89}" for i in range(3000))
    rows = [
        (1, None, "en", "s1", 0), (2, "", "en", "s1", 0), (3, "   \t\n", None, None, 0), (4, long_, "en", "s2", 1), (5, long_, "en", "s3", 1),
        (5, long_, "en", "s3", 1), (6, "é" * 500, "fr", "s4", 1), (7, "é" * 501, "fr", "s4", 1), (8, "one two", "en", "s1", 1), (9, "12345 !!", "en", "s1", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int").withColumn("fp", F.lit("clash")).withColumn("gram", F.lit(1))


def empty(spark):
    return awkward(spark).limit(0)


# --- op1 -----------------------------------------------------------------------------------------------------------------


def brute_words(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = collections.Counter(tuple(w[j : j + window]) for _, w in words for j in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), H(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return sorted(out, key=lambda r: (r[0] is None, r))


def test_op1_brute_force(spark, texts):
    got = sorted(tuple(r) for r in queries.queries()["op1_rlz"](spark, SF).collect())
    assert got == brute_words(texts.items(), 35)


def test_op1_small_windows_and_divided_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(rng.choice(list("abc"), 60))) for i in range(60)]
    monkeypatch.setattr(rlz, "BLOCK", 4)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r)[:4] for r in rlz.remove_duplicates(df, 6, 3).collect())
    assert got == brute_words(docs, 6)


def test_op1_awkward(spark):
    got = {r.doc_id: (r.n_words, r.n_removed) for r in rlz.remove_duplicates(awkward(spark)).collect()}
    assert got[1] == got[2] == got[3] == (0, 0) and got[4] == got[5] == (3000, 3000) and got[8] == (2, 0)
    assert rlz.remove_duplicates(empty(spark)).count() == 0


# --- op10 ----------------------------------------------------------------------------------------------------------------


def brute_bytes(rows, window):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(t[j : j + window] for _, t in raw for j in range(len(t) - window + 1))
    out = []
    for i, t in raw:
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - window + 1):
            if seen[t[j : j + window]] > 1:
                gone[j : j + window] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(gone) else 0))
        out.append((i, len(t), int(gone.sum()), runs, H(np.frombuffer(t, np.uint8)[~gone].tobytes())))
    return sorted(out, key=lambda r: (r[0] is None, r))


def test_op10_brute_force(spark, texts):
    got = sorted(tuple(r) for r in queries.queries()["op10_bwt"](spark, SF).collect())
    assert got == brute_bytes(texts.items(), 400)


def test_op10_small_windows_and_divided_groups(spark):
    rng = np.random.default_rng(2)
    docs = [(i, "".join(rng.choice(list("ab"), 80))) for i in range(50)] + [(99, "ab" * 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r)[:5] for r in bwt.remove_duplicates(df, 12, 4).collect()) == brute_bytes(docs, 12)
    assert sorted(tuple(r)[:5] for r in bwt.remove_duplicates(df, 12, 4, group=3, strides=(4, 1)).collect()) == brute_bytes(docs, 12)


def test_ids_that_clash(spark):
    """Rows of one doc_id with different texts, null ids, and rows repeated in full are rows of their own."""
    rng = np.random.default_rng(8)
    one, two = (" ".join("".join(rng.choice(list("abcdef"), 5)) for _ in range(300)) for _ in range(2))
    rows = [(1, one), (1, two + " x"), (1, "short"), (None, one[:900]), (None, two[400:1500]), (2, two[:700]), (2, two[:700]), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("gram", F.lit(1))
    known = lambda rows: sorted(rows, key=str)
    assert known(tuple(r)[:4] for r in rlz.remove_duplicates(df).collect()) == known(brute_words(rows, 35))
    assert known(tuple(r)[:5] for r in bwt.remove_duplicates(df).collect()) == known(brute_bytes(rows, 400))


def test_op10_awkward(spark):
    rows = awkward(spark)
    got = sorted(tuple(r)[:5] for r in bwt.remove_duplicates(rows).collect())
    assert got == brute_bytes([(r.doc_id, r.text) for r in rows.collect()], 400)
    assert bwt.remove_duplicates(empty(spark)).count() == 0


# --- op2 -----------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[j : j + k]), seed=42) for j in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, near):
    ids, root = sorted(fps), {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if j < i and (fps[i] ^ fps[j]).bit_count() <= near:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op2_brute_force(spark, texts):
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.op2_simhash(spark, SF).collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    comps = brute_components(fps, 4)
    assert got == {i: (fps[i], comps[i]) for i in texts}


@pytest.mark.parametrize("cell", [4096, 8])
def test_links_lose_nothing_in_dense_groups(spark, cell):
    """Clustered fingerprints with heavy values; any number of parts; salted cells."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 6, dtype=np.uint64)
    fps = {}
    for i in range(300):
        x = int(base[i % 6])
        for b in rng.choice(12 if i % 2 else 64, rng.integers(0, 9), replace=False):
            x ^= 1 << int(b)
        fps[i] = x
    one = {}
    for i, x in fps.items():
        one.setdefault(x, i)
    rows = spark.createDataFrame([(i, bytearray(x.to_bytes(8, "little")), 9) for x, i in one.items()], "node long, fp binary, size long")
    want = brute_components({i: x for x, i in one.items()}, 4)
    for parts in (2, 4, 5):
        links = simhash.links(rows, 5, 4, 4, n_parts=parts, cell=cell)
        comp = {r.node: r.component for r in shared.connected_components(links).collect()}
        assert {i: comp.get(i, i) for i in want} == want
        assert links.count() < 5 * len(one) * parts


def test_op2_awkward(spark):
    got = {r.doc_id: r for r in simhash.near_duplicates(awkward(spark)).collect()}
    assert got[1].fp == bytes(8) and got[2].component_id == got[3].component_id == got[1].component_id == 1
    assert got[5].component_id == 4
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = {r.doc_id for r in simhash.keep_one_per_group(awkward(spark)).collect()}
    assert {1, 2, 3, 4, 8, 9} <= kept and 5 not in kept


def test_near_copies_go_and_clean_stay(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base = [[word() for _ in range(400)] for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base[:15]):
        x = list(w)
        x[200] = "changed"
        rows.append((100 + i, " ".join(x)))
    kept = {r.doc_id for r in simhash.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(30))


def brute_sets(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()


def test_near_copies_at_the_limit(spark):
    """Pairs of 0.80 (just), 0.85 and 0.78: all of the former two are found, none of the last."""
    rng = np.random.default_rng(11)
    rows = []

    def add(i, n, changed):
        base = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n + 4)]
        rows.append((i, " ".join(base)))
        # The last words differ, so `changed` shingles of each set do.
        rows.append((i + 1, " ".join(base[: n + 4 - changed] + [f"new{i}x{j}" for j in range(changed)])))

    for p in range(60):  # of n shingles a set, `changed` differ: J = (n - changed) / (n + changed)
        add(1000 + 2 * p, 360, 40)  # 0.80 exactly
        add(2000 + 2 * p, 370, 30)  # 0.85
        add(3000 + 2 * p, 356, 44)  # 0.78
    sets = {i: brute_sets(t) for i, t in rows}
    far = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in (1000, 2000, 3000)]
    assert far[0] == 0.8 and far[1] == 0.85 and 0.775 < far[2] < 0.785
    kept = {r.doc_id for r in simhash.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i, _ in rows if i % 2 == 0 or i >= 3000}


@pytest.mark.parametrize("cell", [4096, 4])
def test_near_copies_brute_force(spark, monkeypatch, cell):
    """Chains, hubs and neighbours just below the limit, with large cells dealt over blocks."""
    monkeypatch.setattr(jaccard, "CELL", cell)
    monkeypatch.setattr(jaccard, "SMALL", cell // 2)
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    docs = []
    for _ in range(6):
        hub = [word() for _ in range(int(rng.integers(40, 90)))]
        docs.append(hub)
        for _ in range(14):
            w = list(docs[-1] if rng.random() < 0.3 else hub)
            for at in rng.integers(0, len(w), rng.integers(0, 3)):
                w[at] = word()
            docs.append(w)
    docs += [["one"], ["ONE"], ["one", "two"], []]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    sets, root = {i: brute_sets(t) for i, t in rows}, {i: i for i, _ in rows}
    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if r == old else r for k, r in root.items()}
    kept = {r.doc_id for r in simhash.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i, r in root.items() if i == r} and 10 < len(kept) < 80


def test_near_dedup_drops_no_pair_by_fingerprints(spark):
    """Pairs of the similarity are linked whatever their fingerprints; counts never rule one out."""
    rng = np.random.default_rng(14)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows = []
    for i, n in enumerate([9, 9, 9, 60, 400, 3000, 40_000]):
        w = [word() for _ in range(n)]
        rows += [(i, " ".join(w)), (100 + i, " ".join([*w, word()]))]  # 5 of 6 shingles, and more
    raw = [t.encode() for _, t in rows]
    h, size, _ = jaccard.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 5)
    x, grams = jaccard.counts(h, size), np.split(h, np.cumsum(size)[:-1])
    for i in range(len(rows)):
        for j in range(i):
            both = len(np.intersect1d(grams[i], grams[j]))
            least = np.minimum(x[i], x[j]).astype(int)
            assert both <= least.sum() or (least == 255).all()
            if both / (size[i] + size[j] - both) >= 0.8:
                assert jaccard._possible(x, size, np.array([i]), np.array([j]), 0.8).all() and jaccard._possible(x, size, i, np.array([j]), 0.8).all()
    assert not jaccard._possible(x, size, np.array([6]), np.array([8]), 0.8).any()
    # A search that finds nothing and fingerprints that tell nothing: prefixes and counts find every pair.
    nothing = lambda fps: spark.createDataFrame([], "a long, b long")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.row for r in jaccard.near_copies(docs, nothing).where("not stays").collect()}
    want = docs.where("doc_id >= 100").select(F.xxhash64("doc_id", "text")).collect()
    assert got == {r[0] for r in want}


def test_near_dedup_finds_short_copies_with_far_fingerprints(spark):
    """Texts that share four of five shingles, chosen for fingerprints further apart than far_bits()."""
    rng = np.random.default_rng(16)
    letters = rng.choice(list(b"abcdefghij"), (20_000, 9, 6))
    texts = [" ".join(bytes(w).decode() for w in t) for t in letters.astype(np.uint8)]
    rows = [t for whole in texts for t in (whole, whole.rpartition(" ")[0])]
    raw = [t.encode() for t in rows]
    h, size, _ = jaccard.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 5)
    x = jaccard.sketches(h, size)
    far = np.flatnonzero(np.bitwise_count(x[::2] ^ x[1::2]).sum(1) > jaccard.far_bits(0.8))
    assert len(far)
    docs = [(k, rows[2 * i]) for k, i in enumerate(far)] + [(1000 + k, rows[2 * i + 1]) for k, i in enumerate(far)]
    kept = {r.doc_id for r in simhash.keep_one_per_group(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == set(range(len(far)))


def test_near_dedup_searches_fingerprints_by_the_pigeonhole(spark, monkeypatch):
    """Without prefixes, every copy goes whose fingerprint is within the radius; what is left is left to prefixes."""
    asked = []

    def none(docs, *_):
        asked.append(docs)
        return spark.createDataFrame([], "gram long, node long, size int")

    rng = np.random.default_rng(13)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows = []
    for i in range(40):
        w = [word() for _ in range(400)]
        rows.append((i, " ".join(w)))
        for at in rng.integers(0, 400, 1 + i // 3 if i > 10 else 1):
            w[at] = word()
        rows.append((100 + i, " ".join(w)))
    raw = [t.encode() for _, t in rows]
    h, size, _ = jaccard.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 5)
    x = jaccard.sketches(h, size)
    apart = np.bitwise_count(x[::2] ^ x[1::2]).sum(1)
    sets = [brute_sets(t) for _, t in rows]
    same = [len(a & b) / len(a | b) >= 0.8 for a, b in zip(sets[::2], sets[1::2], strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = set(range(40)) | {100 + i for i in range(40) if not same[i]}
    assert want == {r.doc_id for r in simhash.keep_one_per_group(docs).collect()}
    monkeypatch.setattr(jaccard, "_prefixes", none)
    kept = {r.doc_id for r in simhash.keep_one_per_group(docs).collect()}
    within = {100 + i for i in range(40) if same[i] and apart[i] < 16}
    assert asked and want <= kept and len(within) > 3 and not within & kept


# --- op3 -----------------------------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute_pii(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


ODD = [
    "a@b.c_x@d.e a@b.c-x@d.e @x.y z@", "1.2.3.4.5 256.1.1.1 0000255.01.2.3 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567. +12 +123456789012345678",
    "😀 mail x.y%z+1@é.com q@w-e.io 4111111111111111", "a" * 3000, "1" * 3000, "+" * 50, None, "",
]


def test_op3_patterns(spark, texts):
    rows = list(enumerate(ODD)) + [(1000 + i, t) for i, t in texts.items()]
    df = pii.report(pii.base_findings(spark.createDataFrame(rows, "doc_id long, text string")))
    for r in df.collect():
        want = brute_pii(dict(rows)[r.doc_id])
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == H(base.encode()), (r, want)
        assert r.spans.startswith(base)


def brute_terms(rows):
    """Spans of disclosing terms per text, by the formula over distinct texts."""
    texts = sorted({t for _, t in rows if t})

    def names(kind, value):
        value, digits = value.lower(), re.sub("[^0-9]", "", value)
        group = {"email": value.split("@")[-1], "ip": ".".join(value.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}[kind]
        return {f"value:{kind}:{value}", f"class:{kind}:{group}", f"kind:{kind}:"}

    held, own, every = {}, {}, {}
    for t in texts:
        base, rest = brute_pii(t), t
        for _, a, b in base:
            rest = rest.replace(t[a:b], " ")
        held[t] = set().union(*[names(k, t[a:b]) for k, a, b in base]) if base else set()
        own[t] = set(re.findall(r"[^\W\d_]{4,}", rest.lower()))
        every[t] = set(re.findall(r"[^\W\d_]{4,}", t.lower()))
    n = len(texts)
    n_e = collections.Counter(e for t in texts for e in held[t])
    n_t = collections.Counter(w for t in texts for w in every[t])
    both = collections.Counter((e, w) for t in texts for e in held[t] if n_e[e] >= pii.SUPPORT for w in own[t])
    bad = {k for k, c in both.items() if c >= pii.SUPPORT and math.log((c - 1) * n / (n_t[k[1]] * n_e[k[0]])) / -math.log(n_e[k[0]] / n) >= pii.THRESHOLD}
    out = {}
    for t in texts:
        base = brute_pii(t)
        terms = {w for e in held[t] for w in own[t] if (e, w) in bad}
        spots = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t) if m[0].lower() in terms]
        out[t] = [(a, b) for a, b in spots if not any(x < b and y > a for _, x, y in base)]
    return out


def test_op3_terms_brute_force(spark):
    """Term spans against the formula, on a given table, where the method finds some."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want = brute_terms(rows)
    assert sum(map(len, want.values())) > 0
    for r in pii.with_terms(pii.base_findings(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        assert [(s.start, s.end) for s in r.terms] == (want[r.text] if r.text else [])


def test_op3_terms_disclose(spark):
    rows = [(i, f"note {i} writes Quixotine to jo@ex.org about thing{i}") for i in range(5)] + [(100 + i, f"plain note number {i} writes about thing{i}") for i in range(400)]
    rows += [(1000 + i, f"see {i} ÉCLAIRE 10.20.{i}.1 and more words here, éclaire") for i in range(9)] + [(0, "no data under a repeated id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("terms", F.lit("clash"))
    out = {(r.doc_id, r.text): r for r in pii.sanitise(df).collect()}
    assert out[rows[0]].clean == "note 0 writes  to [email] about thing0" and out[rows[0]].terms_in == "clash"
    assert out[rows[5]].clean == rows[5][1] and out[rows[-1]].clean == rows[-1][1]
    assert "[about ip]" in out[rows[406]].clean and "CLAIRE" not in out[rows[406]].clean and len(out[rows[406]].terms) >= 2


def test_op3_awkward(spark):
    assert pii.report(pii.base_findings(awkward(spark))).count() == 10
    assert pii.report(pii.base_findings(empty(spark))).count() == 0


# --- op4 -----------------------------------------------------------------------------------------------------------------


def brute_tiles(text, item, least):
    ft, fi = [True] * len(text), [True] * len(item)
    while True:
        best = (0, 0, 0)
        for t in range(len(text)):
            for i in range(len(item)):
                n = 0
                while t + n < len(text) and i + n < len(item) and ft[t + n] and fi[i + n] and text[t + n] == item[i + n]:
                    n += 1
                best = max(best, (n, -t, -i))
        if best[0] < least:
            return fi.count(False)
        for j in range(best[0]):
            ft[j - best[1]] = fi[j - best[2]] = False


def test_op4_tiles():
    rng = np.random.default_rng(4)
    for _ in range(60):
        t, i = rng.integers(0, 4, 40).astype(np.uint64), rng.integers(0, 4, 15).astype(np.uint64)
        got, want = decontaminate.tile(t, i, 3), brute_tiles(t.tolist(), i.tolist(), 3)
        assert abs(got - want) <= 3  # equal longest matches may be marked in another order


def test_op4_reordered_passages(spark):
    item = " ".join(f"alpha{i}" for i in range(40))
    parts = item.split()
    swapped = " ".join(parts[20:] + ["filler"] * 5 + parts[:20])
    docs = spark.createDataFrame([(1, f"x {item.upper()} y"), (2, swapped), (3, " ".join(parts[:10])), (4, "nothing here"), (5, None), (6, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {(1, 7): 1.0, (2, 7): 1.0}
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0 == decontaminate.contamination(docs, bench.limit(0)).count()


@pytest.mark.parametrize("bits", [26, 8])
def test_op4_brute_force(spark, texts, monkeypatch, bits):
    """The query's pairs against tiling every pair, with a bitmap that tells seeds apart and one that hardly does."""
    monkeypatch.setattr(decontaminate, "BITMAP", bits)

    def toks(t):
        return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    items = {r.item_id: toks(r.text) for r in shared.table(spark, SF, "benchmark").collect()}
    want = {}
    for d, t in texts.items():
        doc = toks(t)
        have = {tuple(doc[i : i + 5]) for i in range(len(doc) - 4)}
        for i, item in items.items():
            # What no tile of five can reach needs no tiling.
            if len(item) >= 5 and 5 * sum(tuple(item[j : j + 5]) in have for j in range(len(item) - 4)) >= len(item) / 2:
                code = {w: n for n, w in enumerate(dict.fromkeys(doc + item))}
                covered = brute_tiles([code[w] for w in doc], [code[w] for w in item], 5)
                if covered >= len(item) / 2:
                    want[d, i] = (len(item), covered)
    got = {(r.doc_id, r.item_id): (r.n_tokens, r.covered) for r in decontaminate.op4_tiling(spark, SF).collect()}
    assert got == want and want


def test_op4_common_phrases_and_rows_of_one_id(spark):
    common = "as an answer please choose the right one of these"
    docs = [(i, f"{common} no. {i}") for i in range(30)] + [(1, " ".join(f"w{j}x3" for j in range(12)))]
    items = [(i, f"{common} " + " ".join(f"w{j}x{i}" for j in range(12))) for i in range(20)] + [(3, "w0x3 w1x3 w2x3 w3x3 w4x3 w5x3"), (None, common)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("seeds", F.lit(1))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1))
    got = {(r.doc_id, r.item_id, r.n_tokens): r.covered for r in decontaminate.contamination(df, bench).collect()}
    assert got == {(1, 3, 22): 12, (1, 3, 6): 6}


# --- op5 -----------------------------------------------------------------------------------------------------------------


def brute_kneser_ney(counts, langs):
    """log p(character | context) by the textbook recursion, over dicts: a function of (lang, gram of any length)."""
    alphabet = max(2, len({g[-1] for _, g in counts}) + 1)
    level = {4: dict(counts)}
    for n in (3, 2, 1):
        level[n] = collections.Counter((x, g[1:]) for x, g in level[n + 1])

    def cut(x, n):
        c = collections.Counter(v for (y, _), v in level[n].items() if y == x)
        return c[1] / (c[1] + 2 * c[2]) if c[1] and c[2] else language.DISCOUNT

    d = {(x, n): cut(x, n) for x in langs for n in level}

    def p(x, g):
        if not g:
            return 1.0 / alphabet
        n, followers = len(g), [v for (y, k), v in level[len(g)].items() if y == x and k[:-1] == g[:-1]]
        if not followers:
            return p(x, g[1:])
        return max(level[n].get((x, g), 0) - d[x, n], 0) / sum(followers) + d[x, n] * len(followers) / sum(followers) * p(x, g[1:])

    return p


WORDS = {"x": (["abba", "abc", "cab", "bab", "abacus"], [3, 1, 2, 1, 1]), "y": (["abba", "zoo", "oz", "zab"], [1, 5, 2, 1])}


def gram_counts(spark):
    rows = [(x, g, n) for x, (w, k) in WORDS.items() for g, n in language.gram_table(w, np.array(k)).items()]
    return {(x, g): n for x, g, n in rows}, language.fit_counts(spark.createDataFrame(rows, "lang string, gram string, n long"))


def test_op5_probabilities_brute_force(spark):
    """Every scored word equals the textbook recursion, and the characters' probabilities sum to one in any context."""
    counts, m = gram_counts(spark)
    p = brute_kneser_ney(counts, ["x", "y"])
    for w in ["abba", "abz", "q", "zzzz", "oab", "bac"]:
        padded = language.PAD * 3 + w + language.PAD
        score, size = m.score([w])
        for j, x in enumerate(m.langs):
            want = sum(math.log(p(x, padded[i - 3 : i + 1])) for i in range(3, len(padded)))
            assert abs(score[0, j] - want) < 1e-4 and size[0] == len(w) + 1
    for x in "xy":
        for context in ("aba", "zzz", "\x01\x01a", "qab"):
            total = sum(p(x, context + c) for c in "abcsuzo\x01")
            assert abs(total + p(x, context + "?") - 1) < 1e-9  # one place of the alphabet is for the unseen


def test_op5_large_models_score_by_joins(spark, monkeypatch):
    """The way for models that cannot be sent gives the same cross-entropies."""
    rows = spark.createDataFrame([(1, "Abba zoo, cab!"), (2, "½ 7"), (3, None), (4, "zab zab oz qq"), (4, "abc")], "doc_id long, text string")
    _, m = gram_counts(spark)
    sent = {(r.doc_id, r.text): r for r in language.entropies(rows, ["doc_id", "text"], m).collect()}
    monkeypatch.setattr(language, "MODEL_BYTES", 0)
    _, large = gram_counts(spark)
    assert large.rows is not None and not large.grams
    joined = {(r.doc_id, r.text): r for r in language.entropies(rows, ["doc_id", "text"], large).collect()}
    assert sent.keys() == joined.keys()
    for k in sent:
        assert sent[k].chars == joined[k].chars and np.allclose(sent[k].h if sent[k].chars else [0, 0], joined[k].h)


def test_op5_letters():
    assert language.letters("½²①") == "" and language.letters("a½b") == "a b" and language.letters("हिन्दी") == "हिन्दी"


def test_op5_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = language.op5_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_op5_awkward(spark):
    model = language.train(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"))
    got = {r.doc_id: r for r in language.predict(awkward(spark), model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].accepted for i in (1, 2, 3, 9))
    assert got[8].lang_pred != "und"
    assert language.predict(empty(spark), model).count() == 0
    none = language.train(empty(spark))
    assert {r.lang_pred for r in language.predict(awkward(spark), none).collect()} == {"und"}


# --- op6 -----------------------------------------------------------------------------------------------------------------


def test_op6_spread(spark):
    line = "this line stands on many sites"
    rows = [(i, f"{line}\nown text number {i} of this site\n {line} ", f"s{i}") for i in range(12)] + [(50 + i, f"another line, on few sites\nx{i}", f"s{i % 3}") for i in range(30)]
    rows += [(90, None, "s1"), (91, "", None), (92, line, None)]
    out = {r.doc_id: r for r in lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=10).collect()}
    assert out[0].text == "own text number 0 of this site" and (out[0].n_lines, out[0].n_removed) == (3, 2)
    assert out[50].n_removed == 0 and out[90].text is None and out[91].text == "" and out[92].text == ""
    assert lines.drop_boilerplate(empty(spark)).count() == 0


def test_op6_rows_of_one_id_and_clashing_columns(spark):
    rows = [(i, "short", f"s{i}", 7) for i in range(12)] + [(1, "precious first line", "s1", 7), (1, "precious first line", "s1", 7), (5, "short\nown", None, 7)]
    out = lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string, n_removed int")).collect()
    assert sorted((r.doc_id, r.text, r.n_removed, r.n_removed_in) for r in out) == sorted(
        [(i, "", 1, 7) for i in range(12)] + [(1, "precious first line", 0, 7)] * 2 + [(5, "own", 1, 7)]
    )


@pytest.mark.parametrize("least", [3, 10, 20])
def test_op6_near_threshold_is_exact(spark, least):
    rows = [(i * 100 + j, f"line with number {i} in it, longer than twenty", f"s{j}") for i in range(1, 26) for j in range(i)]
    got = {r.line for r in lines.boilerplate(lines.line_hashes(spark.createDataFrame(rows, "doc_id long, text string, source string"), "source"), least).collect()}
    assert len(got) == 26 - least


# --- op7 -----------------------------------------------------------------------------------------------------------------


def test_op7_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).astype("f4")
    x[100:160] = x[100]  # equal vectors tie
    rows = [(i, x[i].tolist()) for i in range(3000)] + [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [None] * 16)]
    v = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = collections.defaultdict(list)
    for r in ann.nearest(v, v.where(F.col("vec_id") % 20 == 0)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    d = x.astype(float)
    s, hit = d @ d.T, 0
    for q in range(0, 3000, 20):
        order = sorted((-round(s[q, i], 9), i) for i in range(3000) if i != q)[:20]
        hit += len({i for _, i in order} & {i for i, _ in got[q]})
        assert [x for x, _ in got[q]] == [i for _, i in sorted((-round(c, 9), i) for i, c in got[q])]
    assert hit / (150 * 20) >= 0.9 and not {9000, 9020, 9040, 9060} & set(got)


def test_op7_overflow_is_no_loss(spark):
    rows = [(i, [1e200 * (-1) ** i, float(i)]) for i in range(4)] + [(20, [1e200, 1.0]), (40, [-1e200, 2.0])]
    v = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = collections.Counter(r.query_id for r in ann.nearest(v, v.where("vec_id % 20 = 0")).collect())
    assert got == {0: 5, 20: 5, 40: 5}


def test_op7_small_and_empty(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    v = ann.usable(rows)
    got = [tuple(r) for r in ann.nearest(v, v.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 0.5), (0, 2, 20, 0.0), (20, 1, 3, 0.5), (20, 2, 0, 0.0)]
    assert ann.nearest(v.limit(0), v.limit(0)).count() == 0


# --- op8 -----------------------------------------------------------------------------------------------------------------


def test_op8_brute_force(spark):
    convs = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs[r.conv_id].append((r.role, r.text or ""))
    convs[-7] = [(x, "\\### Assistant: </turn> ok") for x in ("user", "assistant")]
    for r in chat.op8_chat(spark, SF).collect():
        turns = convs.pop(r.conv_id)
        loss = "".join(t for x, t in turns if x == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), H("".join(f"{x}\n{t}\n" for x, t in turns).encode()))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), H(loss.encode()))
    assert not convs


@pytest.mark.parametrize("text", ["", "\\", "\n</turn>\n<turn user>\n", "a\\\n", "### x", "<|im_end|>", "\\</turn>", "😀\n\n"])
def test_op8_round_trip(text):
    out = chat.format_turn("user>\n", text)[0] + chat.format_turn("assistant", text)[0]
    assert chat.parse(out) == [("user>\n", text), ("assistant", text)]


def test_op8_layouts(spark):
    records = [
        {"prompt": "p", "completion": "c"}, {"instruction": "i", "input": "x", "output": "o"}, {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, {"what": 1},
        {"id": "x", "messages": [{"role": "user", "content": "a", "extra": 1}]}, {"messages": []}, {"meta": {"a": [1]}, "prompt": "p", "completion": "c", "system": "s"},
    ]
    rows = [(i, json.dumps(x)) for i, x in enumerate(records)] + [(9, None), (10, "not json"), (11, "[]")]
    df = spark.createDataFrame(rows, "id long, record string").withColumn("layout", F.lit("clash"))
    got = {r.id: r for r in chat.format_records(df).collect()}
    assert [got[i].layout for i in (5, 6, 7)] == ["messages", "messages", "system_prompt"] and got[6].formatted == "" and got[5].layout_in == "clash"
    assert chat.parse(got[5].formatted) == [("user", "a")] and chat.parse(got[7].formatted)[0] == ("system", "s")
    assert [got[i].layout for i in range(5)] == ["prompt", "instruction", "messages", "conversations", None]
    assert chat.parse(got[1].formatted) == [("user", "i\n\nx"), ("assistant", "o")]
    assert chat.parse(got[3].formatted) == [("user", "h"), ("assistant", "g")]
    assert all(got[i].formatted is None for i in (4, 9, 10, 11))
    a, b = got[0].mask[0]
    assert got[0].formatted[a:b] == "c"


# --- op9 -----------------------------------------------------------------------------------------------------------------


def test_op9_equals_library_and_spans_cover(spark):
    import sentencepiece

    path = queries.piece_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["", " ", "a  b", " lead", "é😀\u200b", "\n\ttab", "x" * 300, "▁ mark", None]
    rows = list(enumerate(odd)) + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    got = {r.doc_id: r for r in sentencepiece_codec.encode(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    for i, t in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        r, raw = got[i], (t or "").encode()
        assert r.ids == ids
        assert all(a <= b for a, b in zip(r.begins, r.ends, strict=True)) and r.ends[-1] == len(raw)
        inner = [(a, b) for x, a, b in zip(r.ids, r.begins, r.ends, strict=True) if x > 2]
        assert b"".join(raw[a:b] for a, b in inner) == raw
    d = {r.doc_id: r for r in sentencepiece_codec.digests(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    for i, t in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert d[i].ids_sha256 == H(np.array(ids, "<u4").tobytes()) and d[i].decoded_sha256 == H(sp.decode(ids).encode())


def test_op9_character_map():
    """A tiny double array: 'a' -> 'b', 'aa' -> 'c'."""
    units = [0] * 1024
    put = lambda at, label, offset, leaf: units.__setitem__(at, (offset << 10) | (int(leaf) << 8) | label)
    root, first, second = 256, 512, 128
    units[0] = root << 10
    a = 0 ^ root
    put(a ^ 97, 97, first, True)
    n1 = (a ^ 97) ^ first
    units[n1] = 0
    put(n1 ^ 97, 97, second, True)
    n2 = (n1 ^ 97) ^ second
    units[n2] = 2
    blob = (len(units) * 4).to_bytes(4, "little") + b"".join(u.to_bytes(4, "little") for u in units) + b"b\0c\0"
    m = sentencepiece_codec.CharacterMap(blob)
    assert m.longest(b"ab", 0) == (1, b"b") and m.longest(b"aab", 0) == (2, b"c") and m.longest(b"xa", 0) is None


def with_character_map(path, **spec):
    """The given model with the library's own NMT-NFKC character map in place of its normaliser."""
    import sentencepiece

    norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", **spec)
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    out = b""
    for raw, wanted in ((open(path, "rb").read(), lambda f: f != 3), (norm.serialized_model_proto(), lambda f: f == 3)):
        for f, v in sentencepiece_codec._fields(raw):
            if wanted(f):
                out += varint(f << 3 | (0 if isinstance(v, int) else 2)) + (varint(v) if isinstance(v, int) else varint(len(v)) + v)
    return out


@pytest.mark.parametrize("squeeze", [True, False])
def test_op9_normaliser_equals_library(squeeze):
    """Longest-prefix normalisation through a real character map, with white space squeezed or not."""
    model = with_character_map(queries.piece_model(), add_dummy_prefix=True, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    c = sentencepiece_codec.Codec(model)
    assert c.map.units
    rng = np.random.default_rng(6)
    pool = list("ab \t\n\u00a0\u3000ｱﾞＡ①ﬁé½\u200b😀한") + ["e\u0301", "  ", "ㄱ"]
    texts = ["", " ", "a  b", "  lead", "trail  ", "ﬁ ½  x"] + ["".join(rng.choice(pool, rng.integers(1, 30))) for _ in range(300)]
    for t in texts:
        out, at = c.normalise(t.encode())
        assert out.decode() == c.sp.normalize(t), repr(t)
        assert len(at) == len(out) + 1 and (np.diff(at) >= 0).all() and at[-1] == len(t.encode())
        ids = np.array(c.sp.encode(t), np.int64)
        begin, end = c.project(t, ids)
        assert (begin[1:] >= begin[:-1]).all() and (not len(ids) or end[-1] == len(t.encode()))


# --- shared --------------------------------------------------------------------------------------------------------------


def test_components_of_a_long_chain(spark):
    n = 200
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000)], "a long, b long")
    got = {r.node: r.component for r in shared.connected_components(e).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000}


def test_anchor_windows_are_all_owned():
    codes = np.random.default_rng(0).integers(0, 5, 500).astype(np.uint64) + np.uint64(1)
    row = np.repeat([0, 1, 2], [200, 10, 290])
    r, first, last, anchor, _, _ = kernels.anchors(codes, row, 20, 4)
    owned = {(int(a), i) for a, f, z in zip(r, first, last, strict=True) for i in range(f, z + 1)}
    assert owned == {(int(row[i]), i) for i in range(481) if row[i] == row[i + 19]}


def strange(spark):
    """A very long text and its copy, a null id, rows of one id, and columns named like the operators' own."""
    long_ = " ".join(f"word{i % 9973}x{i % 997}" for i in range(40_000))
    rows = [(1, long_), (2, long_), (3, "short text here"), (3, "another text under the same id"), (None, "no id at all"), (4, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for name in ("row", "gram", "whole", "node", "fp", "size", "seeds", "tokens", "h", "chars", "base", "terms", "line", "pos", "ids", "stays", "held", "own", "__text", "n_lines", "part", "salt"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_strange_rows_in_every_operator(spark):
    df = strange(spark)
    by_text = lambda got, f: sorted(((r.doc_id is None, r.doc_id or 0, f(r)) for r in got), key=str)
    one = by_text(rlz.remove_duplicates(df).collect(), lambda r: (r.n_words, r.n_removed))
    assert one == sorted([(False, 1, (40_000, 40_000)), (False, 2, (40_000, 40_000)), (False, 3, (3, 0)), (False, 3, (6, 0)), (True, 0, (4, 0)), (False, 4, (0, 0)), (False, 4, (0, 0))], key=str)
    ten = by_text(bwt.remove_duplicates(df).collect(), lambda r: r.n_removed == r.n_bytes)
    assert [x[2] for x in ten if x[1] in (1, 2)] == [True, True] and [x[2] for x in ten if x[1] == 3] == [False, False]
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect() if r.doc_id in (1, 2)} == {1: 1, 2: 1}
    assert pii.report(pii.base_findings(df)).count() == 7 and pii.sanitise(df).where("base_in = 'clash'").count() == 7
    bench = spark.createDataFrame([(9, "another text under the same id"), (8, "word5x5 word6x6 word7x7 word8x8 word9x9")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contamination(df, bench).collect()} == {(1, 8), (2, 8), (3, 9)}
    assert sorted(str(r.text)[:7] for r in decontaminate.clean_rows(df, bench).collect()) == ["", "None", "no id a", "short t"]
    assert lines.drop_boilerplate(df, min_sites=1).where("n_lines_in = 'clash'").count() == 7
    model = language.train(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"))
    assert language.predict(df, model).count() == 7 and set(language.accepted_rows(df, model).columns) == set(df.columns)
    path = queries.piece_model()
    assert min(r.n_tokens for r in sentencepiece_codec.digests(df, path).collect()) == 2
    kept = simhash.keep_one_per_group(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "3", "4", "4", "None"]


def test_pipeline_brute_force(spark):
    """Every stage's decisions, each on its own input, against plain versions of them."""
    import corpus_pipeline as p
    import sentencepiece

    docs = shared.table(spark, SF, "documents")
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "tokenise"]
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    told = rows(language.predict(docs, language.train(docs.where(language.fold() != 2))))
    one_df = shared.written(p.language_id(spark, docs, SF), "one")
    one = rows(one_df)
    assert one_df.columns == docs.columns and set(one) == {i for i, r in told.items() if r.accepted} and len(one) > 0.95 * docs.count()
    assert all(i in one for i, r in rows(docs).items() if r.text and len(r.text) > 200 and r.lang == told[i].lang_pred)

    sites = collections.defaultdict(set)
    for r in one.values():
        for line in (r.text or "").split("\n"):
            sites[line.strip(" ")].add(r.source)
    bad = {x for x, s in sites.items() if x and len(s - {None}) >= 10}
    two_df = shared.written(p.line_dedup(spark, one_df, SF), "two")
    two = rows(two_df)
    assert two.keys() == one.keys() and bad
    for i, r in one.items():
        assert two[i].text == "\n".join(x for x in r.text.split("\n") if x.strip(" ") not in bad) and (two[i].text == r.text or two[i].n_chars == len(two[i].text))

    sets, root = {i: brute_sets(r.text) for i, r in two.items()}, {i: i for i in two}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and root[i] != root[j] and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if r == old else r for k, r in root.items()}
    three_df = shared.written(p.near_dedup(spark, two_df, SF), "three")
    three = rows(three_df)
    assert set(three) == {i for i, r in root.items() if i == r} and len(three) < len(two)

    toks = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [toks(r.text) for r in shared.table(spark, SF, "benchmark").collect()]
    dirty = set()
    for i, r in three.items():
        doc = toks(r.text)
        have = {tuple(doc[k : k + 5]) for k in range(len(doc) - 4)}
        for item in items:
            if len(item) >= 5 and 5 * sum(tuple(item[k : k + 5]) in have for k in range(len(item) - 4)) >= len(item) / 2:
                code = {w: n for n, w in enumerate(dict.fromkeys(doc + item))}
                if brute_tiles([code[w] for w in doc], [code[w] for w in item], 5) >= len(item) / 2:
                    dirty.add(i)
    four_df = shared.written(p.decontamination(spark, three_df, SF), "four")
    assert set(rows(four_df)) == set(three) - dirty and dirty

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    out = rows(p.run(spark, SF))
    assert set(out) == set(rows(four_df))
    for i, r in rows(four_df).items():
        ids = sp.encode(r.text or "", add_bos=True, add_eos=True)
        assert out[i].n_tokens == len(ids) and out[i].ids_sha256 == H(np.array(ids, "<u4").tobytes())


# --- content that fools fingerprints modulo a power of two ----------------------------------------------------------------


def thue_morse(bits, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(1 << bits))


def test_structured_content_is_told_apart(spark):
    """Thue-Morse words and their complements: equal in length, letters and most sums, and different everywhere."""
    x, y = thue_morse(8, "x", "z"), thue_morse(8, "z", "x")
    middle = "the anchor lies in this middle.."
    docs = spark.createDataFrame([(1, x + middle + y), (2, y + middle + x)], "doc_id long, text string")
    assert [r.n_removed for r in bwt.remove_duplicates(docs, 400).collect()] == [0, 0]
    long_x, long_y = thue_morse(9, "x", "z"), thue_morse(9, "z", "x")
    words = [f"w{i}" for i in range(41)]
    texts = [" ".join([*words[:20], odd, *words[21:]]) for odd in (long_x, long_y)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in rlz.remove_duplicates(docs, 35).collect()) == [(0, 41, 0), (1, 41, 0)]
    items = spark.createDataFrame([(7, f"one two three four {long_x}")], "item_id long, text string")
    hold = spark.createDataFrame([(1, f"one two three four {long_y}"), (2, f"one two three four {long_x}")], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.clean_rows(hold, items).collect()] == [1]
    for other in (simhash, jaccard, language):
        assert other
    hashes = [int(kernels.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in (long_x, long_y)]
    assert hashes[0] != hashes[1]


def test_fingerprints_equal_exact_polynomials():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 2**64, 300, dtype=np.uint64)
    sums = kernels.prefix_sums(codes)
    at = rng.integers(0, 250, 200)
    end = at + rng.integers(1, 50, 200)
    got = kernels.spans(sums, at, end)

    def exact(part, base):
        return sum(int(c) % kernels.PRIME * pow(base, i, kernels.PRIME) for i, c in enumerate(part)) % kernels.PRIME

    low = np.array([exact(codes[a:e] & np.uint64(kernels.PRIME), kernels._BASES[0]) for a, e in zip(at, end)], np.uint64)
    high = np.array([exact(codes[a:e] >> np.uint64(33), kernels._BASES[1]) for a, e in zip(at, end)], np.uint64)
    n = (end - at).astype(np.uint64)
    assert (got == kernels.mix((low | high << np.uint64(32)) + n * np.uint64(0xD6E8FEB86659FD93))).all()


def test_periodic_grams():
    rng = np.random.default_rng(1)
    for k in (3, 8, 16, 32):
        c = rng.integers(0, 3, 3000).astype(np.uint64)
        c[500:560], c[900:940] = np.tile([5, 6, 7], 20), 9
        want = [any((c[i : i + k - p] == c[i + p : i + k]).all() for p in range(1, k // 2 + 1)) for i in range(len(c) - k + 1)]
        assert (kernels.periodic(c, k) == np.array(want)).all() and (k > 8 or any(want))


def test_long_texts_of_findings_and_lines(spark):
    """Tens of thousands of findings or boilerplate lines in one text cost linear time."""
    import time

    begun = time.time()
    mails = " ".join(f"user{i}@mail{i}.example.com" for i in range(50_000))
    docs = spark.createDataFrame([(1, mails), (2, "x")], "doc_id long, text string")
    assert [r.n_email for r in pii.report(pii.base_findings(docs)).orderBy("doc_id").collect()] == [50_000, 0]
    text = "\n".join(["common", "own line"] * 80_000)
    docs = spark.createDataFrame([*((i, "common", f"s{i}") for i in range(12)), (99, text, "s1")], "doc_id long, text string, source string")
    assert {r.doc_id: r.n_removed for r in lines.drop_boilerplate(docs).collect()}[99] == 80_000
    assert time.time() - begun < 120


def test_op7_repeated_queries(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    v = spark.createDataFrame([*rows, rows[20], rows[20], (40, rng.normal(size=8).tolist())], "vec_id long, embedding array<double>")
    u = ann.usable(v)
    got = ann.nearest(u, u.where("vec_id in (20, 40)")).collect()
    of20 = [(r["rank"], r.vec_id) for r in got if r.query_id == 20]
    assert sorted(k for k, _ in of20) == list(range(1, 21)) and 20 not in {i for _, i in of20}
    assert sorted(r["rank"] for r in got if r.query_id == 40) == sorted([*range(1, 21)] * 2)  # two vectors of one id


def test_op8_parts_and_precedence():
    part = lambda t: [{"type": "text", "text": t}]
    mixed = {"messages": [{"role": "user", "content": part("hi")}, {"role": "assistant", "content": "plain"}]}
    assert chat.canonical_turns(mixed) == ("messages", [("user", "hi"), ("assistant", "plain")])
    both = mixed | {"prompt": "p", "completion": "c", "system": "s"}
    assert chat.canonical_turns(both)[0] == "messages"
    image = {"messages": [{"role": "user", "content": [{"type": "image", "url": "x"}]}, {"role": "assistant", "content": "plain"}]}
    assert chat.canonical_turns(image) == (None, None)
    assert chat.canonical_turns({"prompt": "p", "response": "r"}) == ("response", [("user", "p"), ("assistant", "r")])
    assert chat.canonical_turns({"question": "q", "answer": "a", "id": 1})[1] == [("user", "q"), ("assistant", "a")]
    assert chat.canonical_turns({"prompt": "p", "chosen": "c", "rejected": "r"}) == ("preference", [("user", "p"), ("assistant", "c")])
