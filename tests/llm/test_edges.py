"""Words that clash under polynomial hashes, frequent anchors, odd rows, long texts and the registered queries themselves."""

import hashlib
import os
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from corpusmetrics.llm import packing, pieces, repeats, suffix_dedup, toxicity, window_dedup
from corpusmetrics.llm import text as tx
from corpusmetrics.llm.embedding_dedup import embedding_dedup
from corpusmetrics.llm.encoder import SpanEncoder
from corpusmetrics.llm.exact_dedup import exact_dedup
from corpusmetrics.llm.jaccard_join import jaccard_join
from corpusmetrics.llm.lm_score import lm_score
from corpusmetrics.llm.queries import QUERIES, crc_mod, tokenizer
from corpusmetrics.llm.shared import stored
from corpusmetrics.llm.suffix_dedup import suffix_deduped

SF = "/root/testdata/sf0.001"
PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def thue_morse(n: int, flip: bool = False) -> str:
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


@pytest.fixture(scope="module")
def clashing(spark):
    """Pairs of different words that every polynomial modulo 2**64 takes for one."""
    texts = []
    for k in (10, 11, 12):
        for flip in (False, True):
            words = [f"w{i}" for i in range(60)]
            words[30] = thue_morse(1 << k, flip)
            texts.append(" ".join(words))
    texts += [thue_morse(1024), thue_morse(1024, True), thue_morse(1024) + " x y", "words of their own"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).cache()


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def library_pieces(pairs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECES))
    out = []
    for d, t in pairs:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(sp.decode(ids).encode())))
    return sorted(out, key=str)


def library_tokens(pairs, size):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer(WORDS))
    out = []
    for d, t in pairs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        out += [(d, p, a, len(ids[a : a + size]), zlib.crc32(np.array(ids[a : a + size], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), size))]
    return sorted(out, key=str)


def test_clashing_words(clashing):
    pairs = pairs_of(clashing)
    assert rows(pieces.encode_digests(clashing, tokenizer(PIECES))) == library_pieces(pairs)
    assert rows(packing.token_pieces(clashing, tokenizer(WORDS))) == library_tokens(pairs, 4096)
    assert rows(window_dedup.window_dedup(clashing, digest=True)) == sorted(brute.window_dedup(pairs, 50), key=str)
    assert rows(jaccard_join(clashing)) == sorted(brute.jaccard_join(pairs), key=str)
    got = sorted(tuple(r) for r in lm_score(clashing, crc_mod(10) != 0).collect())
    for g, w in zip(got, brute.lm_score(pairs), strict=True):
        assert g[:5] == w[:5]
        np.testing.assert_allclose(g[5:], w[5:], rtol=1e-9)


def test_encoded_spans_are_recognised_by_their_bytes():
    """With a hash that all spans share, every span still gets its own ids."""
    enc = SpanEncoder(lambda spans: [[len(s), *s] for s in spans], lambda data, st, en: np.zeros(len(st), np.uint64))
    for text in (b"ab cd ab efg", b"cd zz ab"):
        data = np.frombuffer(text, np.uint8)
        st, en, _ = tx.word_bounds(data, np.array([0, len(data)]))
        ids, sizes = enc(data, st, en)
        assert ids.tolist() == [x for w in text.split() for x in (len(w), *w)] and sizes.tolist() == [len(w) + 1 for w in text.split()]


def test_word_hashes_differ_by_bytes_and_length():
    rng = random.Random(2)
    words = {"".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200]))) for _ in range(3000)} | {"a" * n for n in range(1, 140)}
    data = np.frombuffer(" ".join(sorted(words)).encode(), np.uint8)
    st, en, _ = tx.word_bounds(data, np.array([0, len(data)]))
    assert len(set(tx.span_hashes(data, st, en).tolist())) == len(words)
    again = np.frombuffer(("x " + " ".join(sorted(words)).upper()).encode(), np.uint8)
    st2, en2, _ = tx.word_bounds(again, np.array([0, len(again)]))
    assert tx.span_hashes(again, st2, en2, lower=True)[1:].tolist() == tx.span_hashes(data, st, en).tolist()


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 50])
def test_run_hashes_know_order_and_place(width):
    codes = tx.mix(np.random.default_rng(1).integers(0, 3, 400).astype(np.uint64))
    got = tx.run_hashes(codes, width, chunk=64)
    seen: dict = {}
    for i in range(len(codes) - width + 1):
        assert seen.setdefault(tuple(codes[i : i + width].tolist()), got[i]) == got[i]
    assert len(set(seen.values())) == len(seen) and len(tx.run_hashes(codes[: width - 1], width)) == 0


@pytest.mark.parametrize("often", [2, 6, 512])
def test_frequent_anchors_in_different_contexts(spark, monkeypatch, often):
    """One line stands in every text, its contexts differ or repeat: the same as the plain versions, however anchors are dealt."""
    monkeypatch.setattr(window_dedup, "OFTEN", often)
    monkeypatch.setattr(suffix_dedup, "OFTEN", often)
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    line, left, right = prose(14), [prose(45) for _ in range(4)], [prose(45) for _ in range(4)]
    texts = [f"{rng.choice([*left, prose(45)])} {line} {rng.choice([*right, prose(45)])}" for _ in range(60)] + [line] * 5 + [f"{line} {line} {line} {line} {line}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    pairs = list(enumerate(texts))
    assert rows(window_dedup.window_dedup(df, 50, digest=True)) == sorted(brute.window_dedup(pairs, 50), key=str)
    assert rows(suffix_dedup.suffix_dedup(df, 100)) == sorted(brute.suffix_dedup(pairs, 100), key=str)


def test_dealt_anchors_cover_the_same_windows():
    codes = tx.mix(np.random.default_rng(3).integers(0, 9, 600).astype(np.uint64))
    a = repeats.anchors(codes, np.array([0, 200, 600]), 30, 4)
    d = repeats.dealt(a, np.arange(len(a.key)) % 2 == 0, lambda at: window_dedup._folded(codes, at, 30 - repeats.STEP + 1))
    windows = lambda x: [w for f, n in zip(x.first, x.count, strict=True) for w in range(f, f + n)]
    assert windows(d) == windows(a)
    of = {w: k for k, f, n in zip(d.key.tolist(), d.first, d.count, strict=True) for w in range(f, f + n)}
    alike: dict = {}
    dealt = {w for k, (f, n) in enumerate(zip(a.first, a.count, strict=True)) if k % 2 == 0 for w in range(f, f + n)}
    for w in dealt:  # equal windows of dealt anchors meet
        assert alike.setdefault(tuple(codes[w : w + 30].tolist()), of[w]) == of[w]


LONG = "lorem ipsum dolor sit amet " * 30


def test_odd_rows_by_value(odd):
    """Null ids twice with LONG, id 5 twice with LONG and once with another text, and a null text."""
    low = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    texts = [LONG, LONG, LONG, LONG, "other " + LONG, None]
    ids = [None, None, 5, 5, 5, None]
    want = [(d, 5, 4, d == 5, low(LONG)) for d in ids[:4]] + [(5, 5, 1, True, low(texts[4])), (None, None, 1, True, low(""))]
    assert rows(exact_dedup(odd)) == sorted(want, key=str)
    pairs = list(zip(ids, texts, strict=True))
    assert rows(pieces.encode_digests(odd, tokenizer(PIECES))) == library_pieces(pairs)
    assert rows(packing.token_pieces(odd, tokenizer(WORDS), size=100)) == library_tokens(pairs, 100)
    packed = packing.best_fit_packing(odd, tokenizer(WORDS), size=100).toPandas().sort_values(["sequence_id", "offset"])
    assert (packed.groupby("sequence_id").length.cumsum() - packed.length == packed.offset).all() and len(packed) == len(library_tokens(pairs, 100))
    # bytes: LONG repeats every 27, the null rows come first and hold it, and equal ids are one document
    got = rows(suffix_dedup.suffix_dedup(odd))
    assert got == sorted([(None, 810, 783, 1, low(LONG[:27]))] * 2 + [(5, 810, 810, 1, low(""))] * 2 + [(5, 816, 811, 1, low("other")), (None, 0, 0, 0, low(""))], key=str)
    kept = sorted(r["text"] for r in suffix_deduped(odd).collect())
    assert kept == sorted([LONG[:27]] * 2 + ["", "", "other", ""])
    # all rows are linked through the null id, which is one node
    sizes = [len(brute.shingle_sets([(0, t)])[0]) for t in texts]
    assert rows(jaccard_join(odd)) == sorted(((d, n, None) for d, n in zip(ids, sizes, strict=True)), key=str)
    scored = {(r["doc_id"], r["n_tokens"]): r for r in lm_score(odd, crc_mod(10) != 0).collect()}
    learnt = zlib.crc32(b"5") % 10 != 0
    assert {k: r["held_out"] for k, r in scored.items()} == {(None, 151): True, (5, 151): not learnt, (5, 152): not learnt, (None, 1): True}
    p, *_ = brute.language_model([[*t.split(), None] for t in texts[2:5]] if learnt else [])
    for (_, n), r in scored.items():
        w = {151: LONG, 152: texts[4], 1: ""}[n].split() + [None]
        assert r["score"] == pytest.approx(sum(np.log10(p([0, *w[:i]], x)) for i, x in enumerate(w)))


def test_toxicity_of_odd_rows(spark, odd):
    lab = spark.createDataFrame([(5, 1), (5, 0), (6, 0), (None, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(odd, lab, F.lit(True)).collect()
    assert len(out) == 6 and len({r["score"] for r in out if r["doc_id"] is None}) <= 2 and all(0 <= r["score"] <= 1 for r in out)


def test_nothing_to_learn_from(docs, pairs):
    for r in lm_score(docs, F.lit(False)).collect():
        assert r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and r["score"] == 0


@pytest.fixture(scope="module")
def long_texts(spark):
    """Texts beyond a slice of work, with passages that short texts share."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(5000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    one = prose(110_000)
    texts = [prose(60), one, one[300_000:301_000], one + " tail", prose(80) + " " + one[555_555:556_555], "y" * 600_000]
    assert len(one) > tx.SLICE
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).cache()


def test_long_texts(long_texts):
    pairs = pairs_of(long_texts)
    assert rows(pieces.encode_digests(long_texts, tokenizer(PIECES))) == library_pieces(pairs)
    assert rows(packing.token_pieces(long_texts, tokenizer(WORDS))) == library_tokens(pairs, 4096)
    assert rows(window_dedup.window_dedup(long_texts, digest=True)) == sorted(brute.window_dedup(pairs, 50), key=str)
    assert rows(jaccard_join(long_texts)) == sorted(brute.jaccard_join(pairs), key=str)
    assert rows(suffix_dedup.suffix_dedup(long_texts)) == sorted(brute.suffix_dedup(pairs, 100), key=str)


def test_recall_near_the_threshold(spark):
    """Pairs of cosine 0.90 to 0.93, where hashing is least sure: at least nine tenths of the links, and none below the threshold."""
    rng = np.random.default_rng(21)
    base = rng.normal(size=(600, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=base.shape)
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cos = rng.uniform(0.885, 0.93, (600, 1))
    x = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * other])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {r["vec_id"]: r for r in embedding_dedup(df).collect()}
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    n = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (n <= link.sum(axis=1)).all() and n.sum() >= 0.9 * link.sum() and link.sum() > 600


def test_many_copies_of_one_vector(spark):
    rng = np.random.default_rng(22)
    x = rng.normal(size=(40, 16))
    near = x[0] + rng.normal(size=(1500, 16)) * 0.02
    all_ = np.concatenate([x, near, np.tile(x[1], (700, 1))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(all_)], "vec_id long, embedding array<double>")
    u = all_ / np.linalg.norm(all_, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    comp = brute.components(range(len(all_)), zip(*map(list, np.nonzero(link)), strict=True))
    got = {r["vec_id"]: r for r in embedding_dedup(df).collect()}
    assert [got[i]["component_id"] for i in range(len(all_))] == [comp[i] for i in range(len(all_))]
    assert [got[i]["n_links"] for i in range(len(all_))] == link.sum(axis=1).tolist()


needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@needs_data
def test_registered_queries_against_plain_versions(spark):
    pairs = pairs_of(spark.read.parquet(f"{SF}/documents.parquet"))
    get = lambda name, *cols: sorted((tuple(r[c] for c in cols) for r in QUERIES[name](spark, SF).collect()), key=str)
    assert get("op4_sentencepiece", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == library_pieces(pairs)
    assert get("op6_best_fit_packing", "doc_id", "piece", "start", "length", "ids_crc32") == library_tokens(pairs, 4096)
    out = QUERIES["op6_best_fit_packing"](spark, SF).toPandas().sort_values(["sequence_id", "offset"])
    assert (out.groupby("sequence_id").length.cumsum() - out.length == out.offset).all() and out.groupby("sequence_id").length.sum().max() <= 4096
    assert out.sequence_id.nunique() == -(-out.length.sum() // 4096)
    assert get("op7_window_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.window_dedup(pairs, 50), key=str)
    assert get("op9_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffix_dedup(pairs, 100), key=str)
    assert get("op10_jaccard_join", "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard_join(pairs), key=str)
    for g, w in zip(get("op2_lm_score", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"), sorted(brute.lm_score(pairs), key=str), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, _ in pairs}
    tox = QUERIES["op8_toxicity"](spark, SF).collect()
    assert {r["doc_id"]: r["held_out"] for r in tox} == held and all(r["predicted"] == (r["score"] >= 0.3) for r in tox)
    vecs = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in vecs], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    emb = {r["vec_id"]: r for r in QUERIES["op5_embedding_dedup"](spark, SF).collect()}
    assert [emb[r["vec_id"]]["n_links"] for r in vecs] == link.sum(axis=1).tolist()


def through(spark, docs, folder):
    """All stages over ``docs``, with the labels of the test data."""
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    sizes = []
    for name, stage in cp.STAGES:
        before = docs.columns
        docs = stored(stage(spark, docs, str(folder)), "t")
        sizes.append(docs.count())
        assert name == cp.STAGES[-1][0] or docs.columns == before
    return docs, sizes


@needs_data
def test_pipeline_on_odd_and_empty_tables(spark, odd, empty, docs, tmp_path):
    assert through(spark, empty, tmp_path / "a")[1] == [0] * 5
    out, sizes = through(spark, odd, tmp_path / "b")
    # toxicity keeps all of them, exact dedup one row of each text; both rows of id 5 are one node and stay, the null text links with nothing
    assert sizes[:4] == [6, 3, 3, 3] and {r["doc_id"] for r in out.collect()} == {5, None}
    out, sizes = through(spark, docs, tmp_path / "c")  # nulls, clashing extra columns
    assert sizes == sorted(sizes[:4], reverse=True) + sizes[4:] and sizes[0] > 40


@needs_data
def test_each_pipeline_stage_against_its_plain_version(spark, tmp_path):
    """Every stage on its own input, row by row; of the suffix stage a text differs only in characters that were cut in two."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES:
        out = stored(stage(spark, docs, SF), "t")
        before, after = dict(pairs_of(docs)), out
        if name == "toxicity":
            kept = {r["doc_id"] for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"), crc_mod(4) != 2).where("not flagged").collect()}
            assert dict(pairs_of(after)) == {d: before[d] for d in kept}
        elif name == "suffix_array_dedup":
            got, plain = dict(pairs_of(after)), plain_suffix_texts(list(before.items()))
            assert got == plain
        docs = out
    n = docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert n <= 4096 and rows(cp.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32")) == rows(docs.select("doc_id", "piece", "start", "length", "ids_crc32"))


def plain_suffix_texts(pairs, depth=100):
    texts = [(d, (t or "").encode()) for d, t in pairs]
    least: dict = {}
    for d, b in texts:
        for i in range(len(b) - depth + 1):
            k = b[i : i + depth]
            if k not in least or (d, i) < least[k]:
                least[k] = (d, i)
    out = {}
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if least[b[i : i + depth]] < (d, i):
                gone[i : i + depth] = b"\x01" * depth
        out[d] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")
    return out
