"""The training-data operators against brute force, and their defined cases."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash
from pyspark import cloudpickle
from pyspark.sql import functions as F

from larkspool.llm import decontam, fingerprint, langid, lm, packing, sharding, simhash, suffixdedup, textops, toxicity
from larkspool.llm.textops import exclusive_prefix

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 9))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus(spark, extra=()):
    """Prose, copies, near copies, a shared passage, and the odd cases; two rows
    have one id, and the columns clash with names that the operators use."""
    passage = prose(70, 99)
    texts = [prose(120, i) for i in range(12)]
    texts += [texts[0], texts[1], texts[2].replace(texts[2].split()[5], "zz", 1)]
    texts += [f"{prose(30, 50 + i)} {passage} {prose(20, 80 + i)}" for i in range(4)]
    texts += ["", None, "   \n", "x", "ünïcödé   ŞĞ 日本語 text", "a" * 900, "é" * 300, *extra]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s"), (None, "no id here", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = {c: F.lit(1) for c in ("key", "block", "score", "fp", "shard", "n", "rank", "bucket", "kept")}
    return df.withColumns(clash), rows


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


def empty(df):
    return df.where("1 = 0")


def test_prefix_sums(spark):
    df = spark.createDataFrame([(i % 9, i) for i in range(60)], "k long, v long")
    got = {r.k: r.o for r in exclusive_prefix(df, "k", "v", "o", group=4).collect()}
    assert got == {k: sum(i for i in range(60) if i % 9 < k) for k in range(9)}


@pytest.mark.parametrize("order", [2, 3])
def test_lm(spark, order):
    df, rows = corpus(spark)
    df = df.withColumn("tr", F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 7 != 2)
    mu = (3.0, 2.0)
    got = lm.score(df, F.col("tr"), order=order, mu=mu, block_bytes=3000, bucket_bytes=4000).collect()
    trained = [zlib.crc32(str(r[0]).encode()) % 7 != 2 if r[0] is not None else True for r in rows]
    toks = [[*words_of(r[1]), "</s>"] for r in rows]
    count = collections.Counter()
    for t, ok in zip(toks, trained, strict=True):
        padded = ["<s>"] * (order - 1) + t
        for i in range(order - 1, len(padded)):
            for k in range(1, order + 1):
                count[tuple(padded[i - k + 1 : i + 1])] += ok
    uni = {k: v for k, v in count.items() if len(k) == 1 and v}
    n, v = sum(uni.values()), len(uni)
    n1, n2 = (sum(x == k for x in uni.values()) for k in (1, 2))
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def context(h):
        return sum(trained) if set(h) == {"<s>"} else count[h]

    want = []
    for r, t in zip(rows, toks, strict=True):
        padded, s = ["<s>"] * (order - 1) + t, 0.0
        for i in range(order - 1, len(padded)):
            p = (count[(padded[i],)] - d if count[(padded[i],)] else d * v) / n
            for k in range(2, order + 1):
                g = tuple(padded[i - k + 1 : i + 1])
                p = (count[g] + mu[k - 2] * p) / (context(g[:-1]) + mu[k - 2])
            s += math.log10(p)
        base = sum(math.log10((count[(w,)] + 1) / (n + v + 1)) for w in t)
        want.append((r[0], len(t), sum(count[(w,)] > 0 for w in t), n, round(base, 6), round(s, 6)))
    have = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert lm.score(empty(df), F.col("tr")).count() == 0


def test_lm_packing_of_hashes():
    for keys in (np.sort(np.random.default_rng(0).integers(0, 2**64, 2000, np.uint64)), np.array([1, 2**63], np.uint64), np.zeros(0, np.uint64), np.array([5], np.uint64)):
        assert (lm.unpacked(lm.packed(keys)) == keys).all()


def test_lm_automaton_sorts_nothing_again(monkeypatch):
    """With the ranks that the caller has, the same automaton is made without another sort;
    n-grams that don't occur in training rows get no arc."""
    r = np.random.default_rng(2)
    words = np.append(r.integers(10, 40, 800).astype(np.uint64), lm.END)
    first = np.array([0, 801])
    found = lm.grams(words, first, 3)
    kinds = [np.unique(g, return_inverse=True, return_counts=True) for g in found]
    totals = [(n * (u % np.uint64(3 + k) > 0))[inv] for k, (u, inv, n) in enumerate(kinds)]
    want = lm.Automaton(found, totals, first, 1, (800, 31, 2, 3), (4.0, 2.0))
    for name in ("unique", "sort", "argsort", "searchsorted"):
        monkeypatch.setattr(np, name, None)
    got = lm.Automaton(found, totals, first, 1, (800, 31, 2, 3), (4.0, 2.0), [(len(u), inv) for u, inv, _ in kinds])
    assert all((getattr(got, c) == getattr(want, c)).all() for c in ("hash", "back", "fail", "weight", "goal"))
    assert len(got.arcs.keys) == sum(len(set(g[t > 0].tolist())) for g, t in zip(found, totals, strict=True))


def test_lm_automaton():
    """States, arcs and failure arcs of a hand-made text; long texts are walked in stretches."""
    words = np.array([5, 6, 5, 6, 7, int(lm.END)], np.uint64)
    first = np.array([0, 6])
    found = lm.grams(words, first, 2)
    totals = [np.array([(g == x).sum() for x in g]) for g in found]
    a = lm.Automaton(found, totals, first, 1, (6, 4, 2, 2), (1.0,))
    five, six = (int(np.flatnonzero(a.hash == np.uint64(x))[0]) for x in (5, 6))
    assert a.fail[five] == a.fail[six] == 0 and np.isclose(a.back[five], np.log10(1 / 3))
    state, weight = a.step(np.array([five, six, 0]), np.array([6, 6, 9], np.uint64))
    d = 2 / 6
    p6 = (2 - d) / 6
    assert state.tolist() == [six, six, 0]
    assert np.allclose(weight, [np.log10((2 + p6) / 3), np.log10(1 / 3) + np.log10(p6), np.log10(d * 4 / 6)])
    r = np.random.default_rng(1)
    words = r.integers(10, 60, 3000).astype(np.uint64)
    words[-1] = lm.END
    first = np.array([0, 1, 1000, 3000])
    words[[0, 999]] = lm.END
    found = lm.grams(words, first, 3)
    totals = []
    for g in found:
        u, inv, n = np.unique(g, return_inverse=True, return_counts=True)
        totals.append(n[inv] * (u[inv] % np.uint64(3) > 0) if g is found[2] else n[inv])
    a = lm.Automaton(found, totals, first, 3, (3000, 51, 0, 0), (4.0, 2.0))
    for i, total in enumerate(a.walk(words, first)):
        s, t = np.array([a.start]), 0.0
        for w in words[first[i] : first[i + 1]]:
            s, x = a.step(s, np.array([w]))
            t += float(x[0])
        assert np.isclose(t, total)


def naive_simhash(t):
    w = words_of(t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(fps, ids, radius):
    u = sorted(set(fps))
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(u):
        for b in u[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    least = {}
    for f, i in zip(fps, ids, strict=True):
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return [least.get(find(f)) for f in fps]


@pytest.mark.parametrize("bucket_rows", [20000, 3])
def test_simhash(spark, bucket_rows):
    df, rows = corpus(spark)
    got = simhash.near_duplicates(df, bucket_rows=bucket_rows).collect()
    fps = [naive_simhash(r[1]) for r in rows]
    want = zip((r[0] for r in rows), (f"{f:016x}" for f in fps), naive_components(fps, [r[0] for r in rows], 4), strict=True)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(empty(df)).count() == 0


@pytest.mark.parametrize("bucket_rows", [20000, 5])
def test_links_lose_nothing(spark, bucket_rows):
    r = random.Random(1)
    centre = r.getrandbits(64)
    fps = {r.getrandbits(64) for _ in range(40)}
    for _ in range(60):  # a dense ball and a chain
        fps.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))))
    x = r.getrandbits(64)
    for _ in range(10):
        x ^= sum(1 << b for b in r.sample(range(64), 4))
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, 4, bucket_rows)).collect()}
    have = [roots.get(simhash.signed(f), simhash.signed(f)) for f in fps]
    want = naive_components(fps, list(range(len(fps))), 4)
    assert len(set(zip(have, want, strict=True))) == len(set(have)) == len(set(want))


def test_covering():
    r = random.Random(2)
    ms = simhash.masks(4, 1000)
    assert len(ms) == 31
    for _ in range(2000):
        d = sum(1 << b for b in r.sample(range(64), 4))
        assert any(not d & m for m in ms)


def naive_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram", "hot"), [(200, 24, 20000), (40, 12, 0), (9, 4, 1), (8, 3, 20000)])
def test_suffix_dedup(spark, length, gram, hot):
    df, rows = corpus(spark, extra=["abcabcabc" * 30, prose(40, 99)])
    got = suffixdedup.remove_repeats(df, length=length, gram=gram, hot_segments=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    want = [(r[0], *x) for r, x in zip(rows, naive_repeats([r[1] for r in rows], length), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_suffix_dedup_keeps_columns(spark):
    df, rows = corpus(spark)
    out = suffixdedup.without_repeats(df.withColumn("n_chars", F.length("text")))
    assert out.columns == [*df.columns, "n_chars"] and out.count() == len(rows)
    assert out.where("n_chars <> length(text) or (text is null) <> (n_chars is null)").count() == 0
    assert suffixdedup.remove_repeats(empty(df)).count() == 0


def test_refine_is_a_suffix_array_to_depth():
    r = np.random.default_rng(3)
    for length in (3, 8, 13, 64):
        text = r.integers(97, 99, 400).astype(np.uint8)
        starts = np.arange(0, 400 - length, 1)
        data = text.tobytes()
        seen = collections.Counter(data[i : i + length] for i in starts)
        assert (suffixdedup.refine(text, starts, length) == [seen[data[i : i + length]] > 1 for i in starts]).all()


def test_suffix_dedup_in_little_memory():
    """Peaks of a scan and of a bucket's sort, which two workers of an executor reach at once."""
    text = np.random.default_rng(4).integers(97, 123, 3 << 20).astype(np.uint8)
    text[2_000_000:2_001_000] = text[:1000]
    tracemalloc.start()
    found = [x for part in suffixdedup.all_segments(text, np.array([0, len(text)]), 200, 24) for x in zip(part[1].tolist(), part[2].tolist(), strict=True)]
    scan = tracemalloc.get_traced_memory()[1]
    assert 2 < sum(c > 1 for c in collections.Counter(found).values())
    del found
    tracemalloc.reset_peak()
    flags = suffixdedup.refine(text[: 1 << 20], np.arange((1 << 20) - 200), 200)
    sort = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not flags.any()
    assert scan < 130 << 20 and sort < 60 << 20, (scan >> 20, sort >> 20)


def test_lean_workers():
    """Caches of other operators go before the first batch; results stay."""
    held = dict(textops.CACHES)
    textops.powers(10)
    textops.code_point_keys()
    assert list(textops.lean(lambda batches: (2 * x for x in batches), "powers")(iter([1, 2]))) == [2, 4]
    assert held["powers"] and not held["code points"]
    plan = cloudpickle.dumps([textops.lean(lambda batches: batches), textops.lean_groups(lambda table: table)])
    assert len(plan) < 10_000  # the driver's caches stay out of what goes to the workers


def check_packing(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing(spark):
    from tokenizers import Tokenizer

    df, rows = corpus(spark, extra=["it's 12's  \n\n x<|endoftext|>y", "a b  c", "“q”,’s"])
    tok = Tokenizer.from_file(packing.default_path())
    got = packing.best_fit_packing(df, capacity=64, with_ids=True).collect()
    n = check_packing(got, 64)
    total = sum(r.length for r in got)
    assert n <= math.ceil(total / 64) + 2
    want = collections.Counter()
    for r in rows:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        for p, (s, k) in enumerate(packing.cut(len(ids), 64)):
            want[r[0], p, s, k, zlib.crc32(ids[s : s + k].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    assert packing.best_fit_packing(empty(df)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_all_and_beat_bounds(seed):
    r = random.Random(seed)
    lengths = [r.choice([r.randint(1, 100), r.randint(1, 20), 50, 100]) for _ in range(3000)]
    plan = packing.exact_complement_plan(collections.Counter(lengths), 100)
    used = collections.Counter()
    for combo, times in plan:
        assert sum(combo) <= 100
        for x in combo:
            used[x] += times
    assert used == collections.Counter(lengths)
    assert sum(t for _, t in plan) <= len(packing.best_fit_decreasing(np.array(lengths), 100))
    for members in (2, 3, 4):  # exact complements of one, two and three lengths are consumed
        assert any(len(combo) == members and sum(combo) == 100 for combo, _ in plan)


def test_sum_index():
    left = np.zeros(31, np.int64)
    left[[2, 3, 5, 7, 11, 20]] = 1, 2, 1, 1, 3, 1
    index = packing.SumIndex(left, 30)
    have = np.flatnonzero(left).tolist()
    for total in range(1, 30):
        assert {tuple(x) for x in index.pairs(total).tolist()} == {(a, b) for a in have for b in have if a >= b and a + b == total}
        assert {tuple(x) for x in index.triples(total).tolist()} == {(a, b, c) for a in have for b in have for c in have if a >= b >= c and a + b + c == total}
    left[5] = 0
    assert not any(5 in x for x in index.triples(15).tolist())


def test_plan_spares_what_the_rest_needs():
    """Greedy triples would cost sequences here; they are given back, and the plan isn't best fit alone."""
    r = random.Random(12)
    lengths = [r.randint(1, 400) for _ in range(400)] + [r.randint(300, 700) for _ in range(200)]
    plan = packing.exact_complement_plan(collections.Counter(lengths), 1024)
    h = packing.Histogram(collections.Counter(lengths), 1024)
    alone = packing._best_fit(h.left, 1024)
    assert sum(t for _, t in plan) <= sum(t for _, t in alone)
    exact = [sum(t for c, t in p if sum(c) == 1024 and len(c) > 2) for p in (plan, alone)]
    assert exact[0] > exact[1]


def test_segment_tree_is_best_fit():
    r = random.Random(8)
    lengths = np.array([r.randint(1, 64) for _ in range(400)])
    room, want = [], []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [x for x in room if x >= lengths[i]]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - lengths[i])
        else:
            room.append(64 - lengths[i])
    want = sorted(room)
    assert sorted(64 - lengths[m].sum() for m in packing.best_fit_decreasing(lengths, 64)) == want


def test_binary_rows_round_trip(spark):
    df, rows = corpus(spark)
    one = packing.pieces(df, capacity=64, with_ids=True).collect()
    want = collections.Counter((r.doc_id, r.piece, r.ids) for r in one)
    got = collections.Counter()
    for r in packing.packed_sequences(df, capacity=64, block_bytes=1500).collect():
        ids, pos = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == 64 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == 2).all()
        for d, p, s, e in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            got[d, p, ids[s:e].tobytes()] += 1
            assert pos[s:e].tolist() == list(range(e - s))
    assert got == want
    rows = {tuple(map(str, r)) for r in packing.packed_sequences(df, capacity=64, block_bytes=1500).collect()}
    assert rows == {tuple(map(str, r)) for r in packing.packed_sequences(df.repartition(7), capacity=64, block_bytes=1500).collect()}
    assert packing.packed_sequences(empty(df)).count() == 0


def test_matrices_round_trip(spark, tmp_path):
    df, rows = corpus(spark)
    packing.write_matrices(df, f"{tmp_path}/m", capacity=64, rows=5)
    want = collections.Counter(r.ids for r in packing.pieces(df, capacity=64, with_ids=True).collect())
    got = collections.Counter()
    for m in spark.read.parquet(f"{tmp_path}/m").collect():
        ids, pos = (np.frombuffer(x, "<u4").reshape(m.n_sequences, m.capacity) for x in (m.input_ids, m.position_ids))
        cu, first = np.frombuffer(m.cu_seqlens, "<i4"), np.frombuffer(m.rows, "<i8")
        assert m.n_sequences <= 5 and len(first) == m.n_sequences + 1
        for i in range(m.n_sequences):
            own = cu[first[i] : first[i + 1]]
            for a, b in zip(own, own[1:], strict=False):
                got[ids[i, a:b].tobytes()] += 1
                assert (pos[i, a:b] == np.arange(b - a)).all()
    assert got == want


def test_fingerprints(spark):
    df, rows = corpus(spark)
    got = fingerprint.against_next(df, samples=256).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in order]
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == len(rows)
    same = {}

    def jaccard(a, b):
        x, y = collections.Counter(words_of(a)), collections.Counter(words_of(b))
        top = sum(max(x[k], y[k]) for k in x | y)
        return sum(min(x[k], y[k]) for k in x | y) / top if top else 1.0

    for i, r in enumerate(order):
        nxt = texts[(i + 1) % len(texts)]
        cut = len(texts[i]) // 4
        new = texts[i][: len(texts[i]) - cut] + nxt[:cut]
        hit = [x for x in by[r[0]] if x.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()]
        assert hit and hit[0].n_chars == len(texts[i])
        assert abs(hit[0].near_edited - jaccard(texts[i], new)) < 0.15 and abs(hit[0].near_next - jaccard(texts[i], nxt)) < 0.15
        assert same.setdefault(texts[i], hit[0].fingerprint) == hit[0].fingerprint
    assert fingerprint.against_next(empty(df)).count() == 0


def test_toxicity(spark):
    bad = ["awful", "gruesome"]
    rows = [(i, f"{prose(40, i)} {bad[i % 2] if i % 4 == 0 else ''} {prose(40, 1000 + i)}") for i in range(240)] + [(None, "x"), (500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit(0))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)] + [(0, 0), (None, 1), (7, None), (999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(240) if i % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == (i % 4 == 0) for i in held]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(rows)
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert none.score(["a", None])[0] < 0.01
    assert toxicity.score(empty(docs), none).count() == 0


def test_toxicity_sends_only_telling_grams(spark, monkeypatch):
    """The driver gets of each sampled row the n-grams with a ratio, and no others."""
    rows = [(i, f"{prose(40, i)} {'gruesome' if i % 4 == 0 else ''} {prose(40, 1000 + i)}") for i in range(160)] + [(0, prose(30, 2000)), (500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)] + [(500, 1)], "doc_id long, toxic int")
    sent = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda sample, *more: sent.extend(sample) or fit(sample, *more))
    model = toxicity.train(docs, labels, per_class=30)
    first = [[r.doc_id for r in labels.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(30).collect()] for x in (0, 1)]
    whole = [[min((f.astype(np.int32).tobytes() for f in toxicity.features([t for j, t in rows if j == i]))) for i in sorted(ids)] for ids in first]
    whole = [[set(np.frombuffer(f, np.int32).tolist()) for f in sample] for sample in whole]
    count = [collections.Counter(g for f in sample for g in f) for sample in whole]
    term = lambda x: x * math.log(x) if x else 0
    table = lambda a, b: sum(map(term, (a, b, 30 - a, 30 - b))) - term(a + b) - term(60 - a - b) - 2 * term(30) + term(60)
    telling = {g for g in {*count[0], *count[1]} if 2 * table(count[1][g], count[0][g]) >= toxicity.EVIDENCE}
    assert telling and [set(f.tolist()) for f in sent] == [f & telling for sample in whole for f in sample]
    assert 10 * sum(map(len, sent)) < sum(len(f) for sample in whole for f in sample)
    assert set(np.flatnonzero(model.squares).tolist()) == telling
    total = [sum(c.values()) + (1 << toxicity.BITS) for c in count]
    for g in telling:
        ratio = math.log((count[1][g] + 1) / total[1]) - math.log((count[0][g] + 1) / total[0])
        assert math.isclose(model.squares[g], ratio**2, rel_tol=1e-9)


def test_language(spark):
    sets = {"aa": "abcde", "bb": "vwxyz", "cc": "aeiou"}
    r = random.Random(4)
    rows = [(i, " ".join("".join(r.choice(sets[x]) for _ in range(5)) for _ in range(20)), x) for i, x in enumerate([*sets] * 40)]
    rows += [(900, None, "aa"), (901, "123 !", "bb"), (902, "", None), (None, "abcd dcba", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = langid.train(docs.where("doc_id % 4 <> 2 or doc_id is null"), per_lang=30)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert np.mean([got[i].lang_pred == x for i, _, x in rows[:120] if i % 4 == 2]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[None].lang_pred in sets
    assert not model.predict(["qqqq kkkk jjjj"])[0][2]
    assert langid.train(empty(docs)).predict(["abc"])[0][0] == "und"


def test_kneser_ney_sums_to_one():
    texts = [langid.prepared(prose(60, i)) for i in range(5)]
    m = langid.Model({"x": texts}, order=3)
    letters = sorted(set("".join(texts)))
    for context in (" a", "bc", "hh", "a"):
        p = []
        for c in letters:
            h = m.entropy([context + c])[0, 0] * (len(context) + 1) - m.entropy([context])[0, 0] * len(context)
            p.append(math.exp(-h))
        assert abs(sum(p) - 1) < 0.05  # the rest is the unknown character's


def placed(df, **options):
    cols = ["doc_id", "text", "shard", "slot"]
    return collections.Counter(map(tuple, sharding.shuffle_shards(df, shards=5, bucket_bytes=4000, **options).select(cols).collect()))


def test_sharding(spark):
    df, rows = corpus(spark)
    out = sharding.shuffle_shards(df, shards=5, bucket_bytes=4000)
    got = out.collect()
    assert set(out.columns) == set(df.columns) | {"slot"}
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter((r[0], r[1]) for r in rows)
    assert sharding.shuffle_shards(empty(df)).count() == 0


def test_sharding_is_repeatable(spark):
    """Equal results for any partitioning of input and shuffles."""
    rows = [(i, prose(30, i)) for i in range(150)] + [(7, "again")] * 60 + [(None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("m", F.create_map(F.lit("b"), F.col("doc_id"), F.lit("a"), F.lit(1)))
    want = placed(df, alike=20)
    assert sum(want.values()) == len(rows) and set(sharding.shuffle_shards(df).columns) == {"doc_id", "text", "m", "shard", "slot"}
    assert len({s for d, _, s, _ in want if d == 7}) == 5
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for n, adaptive in ((4, "false"), (9, "true"), (211, "false")):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            assert placed(df.repartition(n), alike=20) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_sharding_writes_slots_in_order(spark, tmp_path):
    import pathlib

    import pyarrow.parquet as pq

    df = spark.createDataFrame([(i, prose(20, i)) for i in range(200)], "doc_id long, text string")
    sharding.write_shards(df, f"{tmp_path}/out", shards=3)
    held = 0
    for shard in range(3):
        files = sorted(pathlib.Path(f"{tmp_path}/out/shard={shard}").glob("*.parquet"))
        slots = [s for f in files for s in pq.ParquetFile(f).read().column("slot").to_pylist()]
        assert slots == list(range(len(slots)))
        held += len(slots)
    assert held == 200


def test_decontamination(spark):
    items = [(1, "How many apples did Maria buy for 12 dollars if she paid 12 dollars twice?"), (2, "short item"), (3, None), (4, ""), (5, "12 Maria 13"), (1, "How many apples did Maria buy for 12 dollars if she paid 12 dollars twice?")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("found", F.lit(1))
    texts = {
        10: "Filler words here. How many apples did Omar buy for 7 euros if she paid 7 euros twice? More.",
        11: "How many apples did Omar buy for 7 euros if she paid 9 euros twice?",
        12: prose(50, 1), 13: None, 14: "", 15: "xx. short item. yy", 16: "7 Omar 8", 17: "how many apples did",
    }
    docs = spark.createDataFrame([*texts.items(), (10, texts[10]), (None, texts[10])], "doc_id long, text string").withColumn("item_id", F.lit("x"))
    got = decontam.contaminated(docs, bench).collect()
    assert collections.Counter((r.doc_id, r.item_id) for r in got) == collections.Counter({(10, 1): 4, (None, 1): 2, (15, 2): 1})
    assert collections.Counter((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench, block_windows=3).collect()) == collections.Counter((r.doc_id, r.item_id) for r in got)
    left = decontam.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {11, 12, 13, 14, 16, 17}
    other = docs.unionByName(spark.createDataFrame([(None, "an unlike text"), (10, "another text")], "doc_id long, text string").withColumn("item_id", F.lit("x")))
    assert {(r.doc_id, r.text) for r in decontam.drop_contaminated(other, bench).where("doc_id is null or doc_id = 10").collect()} == {(None, "an unlike text"), (10, "another text")}
    assert decontam.contaminated(docs, empty(bench)).count() == 0 and decontam.contaminated(empty(docs), bench).count() == 0


def test_decontamination_over_a_gap(spark):
    w = prose(59, 4100).split()
    bench = spark.createDataFrame([(1, " ".join(w)), (2, f"we met Paris {prose(6, 4101)} Paris {prose(6, 4102)}")], "item_id long, text string")
    texts = {1: [*w[:30], "zzz", *w[30:]], 2: [*w[:20], *w[21:]], 3: [*w[30:], *w[:30]]}
    docs = [(i, f"{prose(20, 4200 + i)} {' '.join(t)} {prose(20, 4300 + i)}") for i, t in texts.items()]
    docs += [(4, f"we met New York {prose(6, 4101)} New York {prose(6, 4102)}"), (5, f"we met New York {prose(6, 4101)} San Juan {prose(6, 4102)}")]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 1), (4, 2)} and len(got) == 3


def test_decontamination_first_names(spark):
    item = "Tom has 3 red apples. Tom sells 2 big baskets. How many does Tom keep?"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = [(1, item.replace("Tom", "Ann")), (2, item.upper()), (3, item.lower()), (4, "Ann has 3 red apples. Bob sells 2 big baskets. How many does Eve keep?")]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {r.doc_id for r in got} == {1, 2, 3} and len(got) == 3


def test_token_binary_returns_the_matrices(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(400, 4400 + i)) for i in range(20)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op3_token_binary(spark, str(tmp_path)).collect()
    for r in got:
        assert len(r.input_ids) == len(r.position_ids) == 4 * packing.CAPACITY
        assert (zlib.crc32(r.input_ids), zlib.crc32(r.position_ids)) == (r.ids_crc32, r.positions_crc32)
    packing.write_sequences(docs, f"{tmp_path}/out")
    assert sorted(bytes(r.input_ids) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(bytes(r.input_ids) for r in got)
