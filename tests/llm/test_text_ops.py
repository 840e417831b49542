"""Tokens, packing, language model, classifier, URL filter and embeddings."""

import hashlib
import zlib
from collections import Counter

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmetrics.llm import packing, pieces
from corpusmetrics.llm.embedding_dedup import embedding_dedup
from corpusmetrics.llm.lm_score import lm_score
from corpusmetrics.llm.queries import crc_mod, tokenizer
from corpusmetrics.llm.toxicity import not_toxic, toxicity
from corpusmetrics.llm.url_filter import url_filter


def test_pieces_as_the_library(docs, pairs, odd, empty):
    import sentencepiece

    model = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = {r["doc_id"]: tuple(r) for r in pieces.encode_digests(docs, model).collect()}
    for d, t in pairs:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert got[d] == (d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs, model), model).collect()}
    assert all(back[d] == (t or "").replace("▁", " ") for d, t in pairs)
    assert pieces.encode_digests(odd, model).count() == 6 and pieces.encode_digests(empty, model).count() == 0


def test_random_ids_decode_as_the_library():
    import sentencepiece

    model = tokenizer("piece_bpe_32k.model")
    sp, c = sentencepiece.SentencePieceProcessor(model_file=model), pieces.codec(tokenizer("piece_bpe_32k.model"))
    rng = np.random.default_rng(5)
    for _ in range(200):
        ids = rng.integers(0, 400, rng.integers(0, 8))
        ids = ids[(ids < 3 + 128) | (ids > 258)] if rng.random() < 0.5 else ids
        assert c.decode(ids).decode() == sp.decode(ids.tolist()), ids


def test_packing(docs, pairs, odd, empty):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    out = packing.best_fit_packing(docs, path, size=256).toPandas()
    for d, t in pairs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        own = out[out.doc_id == d].sort_values("piece")
        cut = [ids[a : a + 256] for a in range(0, len(ids), 256)]
        assert own.start.tolist() == list(range(0, len(ids), 256)) and own.length.tolist() == list(map(len, cut))
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(c, "<u4").tobytes()) for c in cut]
    out = out.sort_values(["sequence_id", "offset"])
    assert (out.groupby("sequence_id").length.cumsum() - out.length == out.offset).all()
    assert out.groupby("sequence_id").length.sum().max() <= 256
    assert packing.best_fit_packing(odd, path).count() == 6 and packing.best_fit_packing(empty, path).count() == 0


def plain_best_fit(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        room = min(fit) if fit else size
        if fit:
            rooms.remove(room)
        rooms.append(room - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_as_good_as_best_fit_over_documents(seed):
    rng = np.random.default_rng(seed)
    lengths = np.concatenate([rng.integers(1, 65, 300), np.full(200, rng.integers(1, 65))]).tolist()
    counts = Counter(lengths)
    runs = packing.best_fit_plan(dict(counts), 64)
    used, place = Counter(), {}
    for length, rank, n, each, first, at in runs:
        assert used[length] == rank
        used[length] += n
        for r in range(n):
            place.setdefault(first + r // each, []).append((at + r % each * length, length))
    assert used == counts
    for items in place.values():
        end = 0
        for at, length in sorted(items):
            assert at == end
            end += length
        assert end <= 64
    assert sorted(place) == list(range(len(place)))
    assert len(place) <= plain_best_fit(lengths, 64)


def test_language_model(docs, pairs, odd, empty):
    got = sorted(tuple(r) for r in lm_score(docs, crc_mod(10) != 0).collect())
    for g, w in zip(got, brute.lm_score(pairs), strict=True):
        assert g[:5] == w[:5]
        np.testing.assert_allclose(g[5:], w[5:], rtol=1e-9)
    out = lm_score(odd, crc_mod(10) != 0).collect()
    assert len(out) == 6 and all(r["held_out"] for r in out if r["doc_id"] is None)
    assert lm_score(empty, crc_mod(10) != 0).count() == 0


def test_model_sums_to_one(spark):
    """Over the known words, the end and one unknown word, after a seen context."""
    base = ["a b a b a c", "a b c", "b a"]
    words = ["a", "b", "c", "", "unknown"]
    train = [(2 * i, t) for i, t in enumerate(base)]
    probe = [(2 * k + 1, f"a {w}".strip()) for k, w in enumerate(words)]
    df = spark.createDataFrame(train + probe, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_score(df, F.col("doc_id") % 2 == 0).collect()}
    p, *_ = brute.language_model([[*t.split(), None] for t in base])
    known = lambda x: x if x in ("a", "b", "c", None) else "?"
    assert sum(p([0, "a"], w) for w in ("a", "b", "c", None, "?")) == pytest.approx(1)
    assert sum(p([0, "a", "b"], w) for w in ("a", "b", "c", None, "?")) == pytest.approx(1)
    for k, w in enumerate(words):
        seq = ["a", *([w] if w else []), None]
        want = sum(np.log10(p([0, *seq[:i]], known(x))) for i, x in enumerate(seq))
        assert got[2 * k + 1] == pytest.approx(want)


def test_toxicity_on_held_out_rows(spark, odd, empty):
    rng = np.random.default_rng(6)
    vocab = ["w" + str(i) for i in range(300)]
    bad = ["vile", "nasty", "rotten"]
    rows, labels = [], []
    for i in range(600):
        words = rng.choice(vocab, rng.integers(5, 80)).tolist()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.integers(0, len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "en" if i % 2 else "de"))
        labels.append((i, int(toxic) if i % 50 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([*labels, (0, 1), (None, 1)], "doc_id long, toxic int")
    out = toxicity(docs, lab, crc_mod(4) != 2).toPandas().set_index("doc_id")
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    y = np.array([i % 5 == 0 for i in held])
    p = (out.score[held] >= 0.3).to_numpy()
    assert (p == y).mean() > 0.95
    assert out.score.between(0, 1).all()
    assert not_toxic(docs, lab, crc_mod(4) != 2).columns == docs.columns
    assert toxicity(odd, lab, crc_mod(4) != 2).count() == 6 and toxicity(empty, lab, crc_mod(4) != 2).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity(docs, none, crc_mod(4) != 2).select("score").distinct().count() == 1
    assert not_toxic(odd, lab, crc_mod(4) != 2).columns == odd.columns


def test_scores_see_nothing_but_the_text(spark):
    docs = spark.createDataFrame([(i, "same text " * (i % 3 + 1), "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    s = toxicity(docs, lab, crc_mod(4) != 2).toPandas()
    assert s.groupby(s.doc_id % 3).score.nunique().tolist() == [1, 1, 1]


def test_url_rules(spark):
    urls = [
        (1, "http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "http://example.net/", "example.net", "/", "net/", "block"),
        (3, "http://example.net", "example.net", "", None, None),
        (4, "https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        (5, "https://notexample.com/de/", "notexample.com", "/de/", None, None),
        (6, "https://x.org/fr/y", "x.org", "/fr/y", "org/fr/", "allow"),
        (7, "x.org/fr/y", "", "", None, None),
        (8, None, "", "", None, None),
        (None, "s3://net/a://b", "net", "/a://b", "net/", "block"),
        (9, "://host?x/y", "host", "", None, None),
        (9, "://host?x/y", "host", "", None, None),
    ]
    pages = spark.createDataFrame([(u[0], u[1], "h") for u in urls], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = sorted((tuple(r) for r in url_filter(pages, none).collect()), key=str)
    assert got == sorted(((u[0], *u[2:5], u[5] or "allow") for u in urls), key=str)
    assert url_filter(pages.limit(0), none).count() == 0


def test_reputation_blocks_bad_hosts(spark):
    pages = spark.createDataFrame([(i, f"https://{'bad' if i % 2 else 'good'}.site{i % 2}.com/{i}") for i in range(200)] + [(900, "https://new.site1.com/")], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, None)], "page_id long, bad int")
    v = {(r["host"], r["verdict"]) for r in url_filter(pages, outcomes).collect()}
    assert ("bad.site1.com", "block") in v and ("good.site0.com", "allow") in v and len(v) == 3


def test_embeddings(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(150, 24))
    near = base[:40] + rng.normal(size=(40, 24)) * 0.1
    x = np.concatenate([base, near, base[:10], base[:5] * 3])
    rows = [(i, v.tolist(), "l") for i, v in enumerate(x)]
    odd = [(900, None, "l"), (901, [], "l"), (902, [0.0] * 24, "l"), (903, [float("nan")] * 24, "l"), (904, [float("inf")] + [0.0] * 23, "l"), (905, [None] + [1.0] * 23, "l"), (906, [1.0, 2.0], "l"), (None, [1.0, 2.0], "l")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, node string")
    got = {r["vec_id"]: tuple(r) for r in embedding_dedup(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9 - 1e-12
    np.fill_diagonal(link, False)
    comp = brute.components(range(len(x)), zip(*map(list, np.nonzero(link)), strict=True))
    found = sum(got[i][1] for i in range(len(x)))
    assert found >= 0.9 * link.sum() and found <= link.sum()
    assert sum(got[i][2] == comp[i] for i in range(len(x))) >= 0.95 * len(x)
    assert all(got[i][1:] == (0, i, True) for i in (900, 901, 902, 903, 904, 905))
    assert got[906][1] == 1 and got[906][2] is None and len(got) == len(x) + 8
    assert embedding_dedup(df.limit(0)).count() == 0


def test_repeated_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    out = embedding_dedup(df).toPandas().sort_values("vec_id")
    assert isinstance(out, pd.DataFrame) and out.n_links.tolist() == [2, 2, 2, 0] and out.component_id.tolist() == [1, 1, 1, 3]
