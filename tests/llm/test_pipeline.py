"""The pipeline against the brute-force versions of its stages."""

import zlib

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

import corpus_pipeline
from larkspool.llm import nearcopies, packing, toxicity
import test_llm_ops as B


def test_pipeline(spark, tmp_path):
    item = B.prose(20, 777)
    passage = B.prose(80, 778)
    texts = [f"{B.prose(60, i)}{' awful gruesome' if i % 4 == 0 else ''} {B.prose(60, 500 + i)}" for i in range(80)]
    texts += [texts[1], texts[2], f"{B.prose(30, 901)} {item} {B.prose(30, 902)}", f"{B.prose(30, 903)} {passage}", f"{passage} {B.prose(30, 904)}", None, "", "a b"]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "en", "source": "s", "n_chars": [len(t or "") for t in texts]})
    docs.to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"doc_id": range(60), "quality": 1, "toxic": [int(i % 4 == 0) for i in range(60)]}).to_parquet(tmp_path / "labels.parquet")
    pd.DataFrame({"item_id": [1], "text": [item]}).to_parquet(tmp_path / "benchmark.parquet")
    table = lambda n: spark.read.parquet(f"{tmp_path}/{n}.parquet")

    model = toxicity.train(table("documents"), table("labels"))
    left = [(i, t) for (i, t), s in zip(enumerate(texts), model.score(texts), strict=True) if s < toxicity.THRESHOLD]
    assert all(i % 4 for i, _ in left if i < 80)
    ids = [i for i, _ in left]
    comps = B.naive_components([B.naive_simhash(t) for _, t in left], ids, 4)
    left = [(i, t) for (i, t), c in zip(left, comps, strict=True) if i == c]
    assert not {80, 81} & {i for i, _ in left}
    kept = []
    seen = {}
    data = [(t or "").encode() for _, t in left]
    for x in data:
        for i in range(len(x) - 199):
            seen[x[i : i + 200]] = seen.get(x[i : i + 200], 0) + 1
    for (i, _), x in zip(left, data, strict=True):
        gone = bytearray(len(x))
        for k in range(len(x) - 199):
            if seen[x[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept.append((i, bytes(c for c, g in zip(x, gone, strict=True) if not g).decode("utf-8", "ignore")))
    assert any(len(t) < len(texts[i] or "") for i, t in kept)
    kept = [(i, t) for i, t in kept if item not in t]
    tok = Tokenizer.from_file(packing.default_path())
    want = set()
    for i, t in kept:
        own = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want |= {(i, p, zlib.crc32(own[s : s + n].tobytes())) for p, (s, n) in enumerate(packing.cut(len(own), 1024))}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in got} == want and len(got) == len(want)
    B.check_packing(got, 1024)


def test_stages_keep_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (docs, docs.where("1 = 0")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == docs.columns and out.count() == frame.count()


def edited(text, gaps, seed):
    """The text with a word replaced after each of the gaps."""
    w, at = text.split(), seed % 7
    for k, gap in enumerate(gaps):
        at += gap
        w[at] = f"q{seed}x{k}"
    return " ".join(w)


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (B.words_of(a), B.words_of(b)))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_stage_finds_edited_copies(spark, tmp_path):
    base = [B.prose(150, 3000 + i) for i in range(12)]
    texts = base + [edited(t, gaps, i) for i, t in enumerate(base) for gaps in ([70], [30, 40], [40, 40, 40])]
    texts += [edited(base[0], [60], 100 + i) for i in range(50)]  # more than a bucket
    texts += ["", None, "a b", "A  b", "a b c"]
    near = [[jaccard(a, b) >= 0.8 for b in texts] for a in texts]
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[j] for j in range(len(texts)) if near[i][j]) for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert got == set(root) and len(got) < len(texts) - 70
    small = nearcopies.one_of_each(docs, dense=0, part_rows=20)  # hubs, roots and parts
    assert {r.doc_id for r in small.collect()} == got
    # the copies are further apart than op2's radius
    assert sum((B.naive_simhash(texts[12 + k]) ^ B.naive_simhash(base[k // 3])).bit_count() > 4 for k in range(36)) > 5


def test_sketches_and_forests():
    rng = np.random.default_rng(5)
    for shared, own in ((8, 1), (40, 5), (400, 50)):  # similarities of 0.8
        common, a, b = (rng.integers(0, 2**63, (300, n)).astype(np.uint64) for n in (shared, own, own))
        offs = np.arange(301) * (shared + own)
        x, y = (nearcopies.minima(np.hstack([common, c]).ravel(), offs) for c in (a, b))
        agree = (x == y).sum(axis=1)
        assert abs(agree.mean() - 205) < 3 and agree.min() >= nearcopies.AGREE
    assert nearcopies.minima(np.array([7], np.uint64), np.array([0, 0, 1, 1]))[[0, 2]].sum() == 0
    a, b = rng.integers(0, 60, (2, 80))
    some = nearcopies._forest(a, b, 60)

    def parts(pairs):
        root = list(range(60))
        for i, j in pairs:
            root = [root[i] if r == root[j] else r for r in root]
        return root

    whole, spanned = parts(zip(a, b)), parts(zip(a[some], b[some]))
    assert len(some) == 60 - len(set(whole))
    assert {(i, j) for i in range(60) for j in range(60) if whole[i] == whole[j]} == {(i, j) for i in range(60) for j in range(60) if spanned[i] == spanned[j]}


def test_stage_keeps_other_texts_of_an_id(spark, tmp_path):
    a, b, c = (B.prose(40, 4000 + i) for i in range(3))
    docs = spark.createDataFrame([(None, a), (None, b), (7, c), (7, a), (7, c), (8, c)], "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(None, b), (7, c), (7, a)], key=repr)
