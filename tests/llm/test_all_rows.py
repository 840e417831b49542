"""Training-text operators over all counts and all labelled rows."""

import brute
import numpy as np
import pytest

from corpusmetrics.llm import toxicity as tox
from corpusmetrics.llm.lm_score import lm_score
from corpusmetrics.llm.queries import crc_mod, op2_lm_score, op8_toxicity


def test_the_query_keeps_ngrams_seen_once(spark, tmp_path, docs, pairs):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in op2_lm_score(spark, str(tmp_path)).collect())
    for g, w in zip(got, brute.lm_score(pairs), strict=True):
        assert g[:5] == w[:5]
        np.testing.assert_allclose(g[5:], w[5:], rtol=1e-9)


def test_texts_longer_than_a_block(docs, pairs):
    got = sorted(tuple(r) for r in lm_score(docs, crc_mod(10) != 0, block=700).collect())
    for g, w in zip(got, brute.lm_score(pairs), strict=True):
        assert g[:5] == w[:5]
        np.testing.assert_allclose(g[5:], w[5:], rtol=1e-9)


@pytest.mark.parametrize("text", ["", "  ", "a", "one two three four five six " * 9, "x" * 99 + " y " + "z" * 150 + " end", " a" * 30 + "\n"])
def test_cut_texts_are_whole(text):
    from corpusmetrics.llm.lm_score import cut_text

    words = []
    for skip, part in cut_text(np.frombuffer(text.encode(), np.uint8), 20, 2):
        own = brute.WORD.findall(part.decode())
        assert skip == min(2, len(words)) and own[:skip] == words[len(words) - skip :]
        words += own[skip:]
    assert words == brute.WORD.findall(text)


def test_held_out_texts_fare_better_than_under_bigrams(spark):
    """Log10 probability of a held-out token: the model, its bigrams alone, and the base."""
    sf = "/root/testdata/sf0.01"
    got = op2_lm_score(spark, sf).where("held_out").selectExpr("sum(score) / sum(n_tokens) AS s", "sum(base_score) / sum(n_tokens) AS b").first()
    assert got["s"] > -3.0 > -4.0 > got["b"]


def test_thresholds_come_from_all_rows_that_were_not_fitted(spark):
    """One language has nearly all rows of the sample; the other's threshold is that of its own rows, not only of sampled ones."""
    rng = np.random.default_rng(8)
    words = ["w" + str(i) for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        lang, toxic = "en" if i % 10 else "de", i % 3 == 1
        text = rng.choice(words, 20).tolist()
        # half of the clean "de" rows hold the word, so their best threshold differs
        if toxic or (lang == "de" and i % 2):
            text[3] = "vile"
        rows.append((i, " ".join(text), lang))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    learn = crc_mod(4) != 2
    out = tox.toxicity(docs, lab, learn, most=20).toPandas().set_index("doc_id")
    rows_known = tox.labelled(lab, learn)
    fitted = {r["doc_id"] for r in tox.sample_ids(rows_known, 20).where("not __held").collect()}
    known = {r["doc_id"]: r["__y"] for r in rows_known.collect() if r["doc_id"] not in fitted}
    assert 20 < len(fitted) <= 40 and len(known) > 600
    lang = {d: x for d, _, x in rows}
    y = np.array([known[d] for d in sorted(known)])
    s = out.score[sorted(known)].to_numpy()
    of = np.array([lang[d] for d in sorted(known)])

    def best(pick):
        f1 = np.array([2 * (y[pick] * (s[pick] >= t)).sum() / ((s[pick] >= t).sum() + y[pick].sum()) for t in tox.GRID])
        return np.median(tox.GRID[f1 >= f1.max() - 1e-3])

    whole = best(np.ones(len(y), bool))
    limits = {x: out.threshold[[d for d in out.index if lang[d] == x]].unique().tolist() for x in ("en", "de")}
    for x in ("en", "de"):
        n = y[of == x].sum()
        # without toxic rows a language has the threshold of all
        want = (n * best(of == x) + 50 * whole) / (n + 50) if n else whole
        assert limits[x] == [np.float64(want)] or abs(limits[x][0] - want) < 1e-9


def plain_score(model, text):
    """The score by loops over words, filters and places."""
    import re

    def buckets(word):
        b = word.encode()
        st, en = np.array([0]), np.array([len(b)])
        data = np.frombuffer(b, np.uint8)
        out = [int(tox.tx.span_hashes(data, st, en)[0]) >> 46]
        for k, n in enumerate(tox.HEADS, 1):
            head = int.from_bytes(b[:n].ljust(8, b"\0"), "little")
            out.append(int(tox.tx.mix(np.array([(head + (k << 60)) % 2**64], np.uint64))[0]) >> 46)
        return out

    words = [w for w in re.split(rb"[^0-9a-z\x80-\xff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode()) if w]
    x = [model.embed[buckets(w.decode())].sum(axis=0) for w in words] + [np.zeros(tox.DIM)] * 3
    z, k = model.out[-1], 0
    for w, filt, bias in zip(tox.WIDTHS, model.filters, model.bias, strict=True):
        runs = [np.concatenate(x[i : i + w]) @ filt + bias for i in range(len(words) + 1)]
        for top in range(tox.TOP):
            for f in range(tox.FILTERS):
                values = sorted({round(float(r[f]), 12) for r in runs}, reverse=True)
                z += model.out[k] * max(0.0, values[top] if top < len(values) else 0.0)
                k += 1
    return 1 / (1 + np.exp(-z))


def small_model():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["good", "fine", "awful", "awfully", "x"], rng.integers(1, 9))) for _ in range(80)]
    y = np.array([float("awful" in t) for t in texts])
    return tox.doubled(tox.train(texts, y, np.ones(80), epochs=2)), texts, y


def coded(texts):
    import pyarrow as pa

    return tox.tokens(*tox.tx.raw(tox.tx.column(pa.array(texts))))


def test_scores_are_those_of_a_plain_pass():
    model, texts, _ = small_model()
    texts = [*texts[:20], "", "Awful, AWFUL!", "unseen words é only", "x " * 50]
    np.testing.assert_allclose(tox.scores(model, *coded(texts)), [plain_score(model, t) for t in texts], atol=2e-8)


def test_gradients_are_those_of_the_loss():
    model, texts, y = small_model()
    ids, begin = coded(texts[:12])
    y, scale, kept = y[:12], np.linspace(0.5, 2, 12), np.ones((12, len(model.out) - 1))

    def loss():
        z = tox.features(model, ids, begin) @ model.out[:-1] + model.out[-1]
        return float((scale * (np.log1p(np.exp(z)) - y * z)).sum() / 12)

    g_filters, g_bias, g_out, (rows, g_rows) = tox.gradients(model, ids, begin, y, scale, kept)
    g_embed = np.zeros_like(model.embed)
    np.add.at(g_embed, rows, g_rows)
    word = int(ids[0, 0])
    probes = [(model.out, g_out, 0), (model.out, g_out, len(model.out) - 1), (model.bias[1], g_bias[1], 2)]
    probes += [(f.reshape(-1), g.reshape(-1), i) for f, g in zip(model.filters, g_filters, strict=True) for i in (0, 5)]
    probes += [(model.embed[word], g_embed[word], 0), (model.embed[word], g_embed[word], 3)]
    for values, grad, i in probes:
        old = values[i]
        values[i] = old + 1e-6
        up = loss()
        values[i] = old - 1e-6
        down = loss()
        values[i] = old
        assert grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_held_out_accuracy(spark):
    """op8 on its whole tables: area under the curve and recall on rows that were not learnt from."""
    sf = "/root/testdata/sf0.1"
    out = op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    rank, y = out.score.rank().to_numpy(), out.toxic.to_numpy() == 1
    area = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    hit = out.predicted.to_numpy() == 1
    assert area >= 0.97 and hit[y].mean() >= 0.9 and y[hit].mean() >= 0.9, (area, hit[y].mean(), y[hit].mean())
