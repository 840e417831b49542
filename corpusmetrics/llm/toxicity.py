"""Toxicity scores of a convolutional text classifier, trained in numpy.

The embedding of a word is the sum of hashed embeddings of the word and of its first bytes
(``HEADS``), so unseen forms of a seen stem are known too.  Filters of several widths run
over the words; their TOP largest different values over a text (max pooling, then the
maximum of what lies below) feed a logistic unit.  It learns from a sample of labelled rows of
bounded size (``most`` of each label, drawn by hash of doc_id), with weights that restore the
share of each label, so scores are probabilities.  Embeddings start from the smoothed
log-odds of their buckets; buckets that the sample never shows are zero.  One fold of the
doc_ids is never fitted: it tells after which epoch to stop.  Thresholds are calibrated by
language on the scores of all labelled rows that may be learnt from and were not fitted,
which tasks count by label and step of the grid; scores use nothing but the text.

Training runs in one task, on the bounded sample; the driver gets the weights alone.

Defined results: null and empty texts have the score of an empty text; rows with null
doc_id are scored but never learnt from; several labels of a doc_id count as the largest;
of several texts of a doc_id (repeated rows) one is learnt from, and each is scored; null
labels count as none; a score on the threshold (a tie) is flagged; very long texts are
scored whole, and learnt from by a stretch of TRAIN_CHARS characters whose place follows from the doc_id; without any label of
either kind the score is the prior rate; an empty table gives an empty result; extra columns,
whatever their names, are not read (``not_toxic`` carries them along).
"""

from __future__ import annotations

import pickle
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import stored, texts_of

#: Labelled rows learnt from, of each label at most, and the characters that a text among them is learnt from.
SAMPLE, TRAIN_CHARS = 3000, 16_384
#: A doc_id in one of so many is in the fold that is not fitted.
FOLDS = 5
BUCKET_BITS, HEADS, DIM, WIDTHS, FILTERS, TOP = 18, (4, 6), 8, (1, 2, 3), 6, 3
EPOCHS, BATCH, RATE, EMBED_RATE, DECAY, DROP = 8, 32, 0.005, 0.03, 1e-3, 0.2
SEED = 5
DEFAULT_THRESHOLD = 0.3
#: Thresholds to choose from.
GRID = np.linspace(0.1, 0.9, 81)

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
_PAD = 1 << BUCKET_BITS
_GAP = max(WIDTHS) - 1
_PARTS = 1 + len(HEADS)


class Model(NamedTuple):
    embed: np.ndarray  # buckets + 1 (zeros) x DIM
    filters: list[np.ndarray]  # for each width: width * DIM x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray  # for each width, rank of the maximum and filter; the last is the constant
    prior: float


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words (runs of letters and digits, A-Z lower-cased) of texts and of their heads, one column each, _GAP + 1 pads behind each text; where each begins."""
    spaced = tx.LOWER[np.where(_INSIDE[data], data, 32).astype(np.uint8)]
    st, en, first = tx.word_bounds(spaced, off)
    n = np.diff(first)
    begin = np.cumsum(n + _GAP + 1) - (n + _GAP + 1)
    out = np.full((int((n + _GAP + 1).sum()), _PARTS), _PAD, np.int32)
    at = tx.ragged(begin, n)
    shift = np.uint64(64 - BUCKET_BITS)
    out[at, 0] = tx.span_hashes(spaced, st, en) >> shift
    lanes = tx.lanes(spaced)
    for k, size in enumerate(HEADS, 1):
        out[at, k] = tx.mix(tx.heads(lanes, st, en, size) + np.uint64(k << 60)) >> shift
    return out, begin


def features(model: Model, ids: np.ndarray, begin: np.ndarray, where: bool = False):
    """The TOP largest different values of all filters for each text, least zero (and their places)."""
    x = model.embed[ids[:, 0]].astype(model.out.dtype, copy=False)
    for k in range(1, _PARTS):
        x += model.embed[ids[:, k]]
    n = len(ids) - _GAP
    size = np.diff(np.append(begin, n))
    row = np.repeat(np.arange(len(begin)), size)
    outs, places = [], []
    for w, filt, bias in zip(WIDTHS, model.filters, model.bias, strict=True):
        y = x[:n] @ filt[:DIM]
        for j in range(1, w):
            y += x[j : n + j] @ filt[j * DIM : (j + 1) * DIM]
        y += bias
        for g in range(1, _GAP + 1):  # runs that start there would reach into the next text
            y[begin[1:] - g] = -np.inf
        for top in range(TOP):
            best = np.maximum.reduceat(y, begin)
            outs.append(np.maximum(best, 0))
            if not where and top + 1 == TOP:
                break
            equal = y == best[row]
            if where:
                places.append(np.minimum.reduceat(np.where(equal, np.arange(n)[:, None], n), begin))
            y[equal] = -np.inf
    feats = np.concatenate(outs, axis=1)
    return (feats, places) if where else feats


def scores(model: Model, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    if not len(begin):
        return np.zeros(0)
    z = features(model, ids, begin) @ model.out[:-1] + model.out[-1]
    # rounded: the last bits of a product depend on how many rows it has
    return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9)


def doubled(model: Model) -> Model:
    """The model as it scores, in double precision; its embeddings become doubles as they are looked up."""
    return Model(model.embed, [f.astype(np.float64) for f in model.filters], [b.astype(np.float64) for b in model.bias], model.out.astype(np.float64), model.prior)


def gradients(model: Model, ids: np.ndarray, begin: np.ndarray, labels: np.ndarray, scale: np.ndarray, kept: np.ndarray):
    """Of the weighted mean log loss: gradients of filters, bias and out, and (rows, gradients) of embed.  ``kept``: factors of the features (dropout)."""
    feats, places = features(model, ids, begin, where=True)
    used = feats * kept
    z = used @ model.out[:-1] + model.out[-1]
    err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * scale / len(begin)
    down = err[:, None] * model.out[None, :-1] * kept * (feats > 0)
    g_filters, g_bias, rows, g_rows = [], [], [], []
    for w_no, (w, filt) in enumerate(zip(WIDTHS, model.filters, strict=True)):
        g, gb = np.zeros_like(filt), np.zeros(FILTERS, filt.dtype)
        for top in range(TOP):
            col = w_no * TOP + top
            d = down[:, col * FILTERS : (col + 1) * FILTERS]
            r, f = np.nonzero(d)
            v = d[r, f][:, None]
            gb += d.sum(axis=0).astype(filt.dtype)
            for j in range(w):
                token = ids[places[col][r, f] + j]
                x = sum(model.embed[token[:, k]] for k in range(_PARTS))
                np.add.at(g[j * DIM : (j + 1) * DIM].T, f, (x * v).astype(filt.dtype))
                part = filt[j * DIM : (j + 1) * DIM].T[f] * v
                for k in range(_PARTS):
                    rows.append(token[:, k])
                    g_rows.append(part)
        g_filters.append(g)
        g_bias.append(gb)
    return g_filters, g_bias, np.append(err @ used, err.sum()).astype(model.out.dtype), (np.concatenate(rows), np.concatenate(g_rows))


def log_loss(model: Model, parts: list, labels: np.ndarray, scale: np.ndarray) -> float:
    p = np.clip(np.concatenate([scores(model, *x) for x in parts]), 1e-6, 1 - 1e-6)
    return float(-(scale * np.where(labels > 0, np.log(p), np.log(1 - p))).sum() / scale.sum())


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, held: np.ndarray | None = None, epochs: int = EPOCHS) -> Model:
    """weights: how many rows each row of the sample stands for; held: rows not to fit, by whose loss the best epoch is chosen."""
    rng = np.random.default_rng(SEED)
    held = np.zeros(len(labels), bool) if held is None else held
    rate = float((weights * labels).sum() / weights.sum()) if len(labels) else 0.0
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    embed = np.zeros((_PAD + 1, DIM), np.float32)
    filters = [rng.normal(0, (1 / (w * DIM)) ** 0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out = rng.normal(0, 0.1, len(WIDTHS) * TOP * FILTERS + 1).astype(np.float32)
    out[-1] = np.log(rate / (1 - rate))
    fit = np.flatnonzero(~held)
    if not len(fit) or labels[fit].min() == labels[fit].max():
        out[:-1] = 0
        return Model(embed, filters, bias, out, rate)
    split = lambda some: [tokens(d, o) for _, _, d, o in tx.slices(tx.column(pa.array(some, pa.large_string())))]
    parts = split([texts[i] for i in fit])
    check = split([texts[i] for i in np.flatnonzero(held)])
    ids = np.concatenate([f[0] for f in parts])
    size = np.concatenate([np.diff(np.append(f[1], len(f[0]))) for f in parts])
    del parts
    begin = np.cumsum(size) - size
    y, w = labels[fit], weights[fit]
    # smoothed log-odds of each bucket, by documents that hold it
    strength = 10 * w.mean()
    for k in range(_PARTS):
        doc = np.repeat(np.arange(len(size)), size)
        pair = np.unique(doc.astype(np.int64) * (_PAD + 1) + ids[:, k])
        doc, bucket = pair // (_PAD + 1), pair % (_PAD + 1)
        bad, all_ = np.bincount(bucket, (w * y)[doc], _PAD + 1), np.bincount(bucket, w[doc], _PAD + 1)
        odds = np.log((bad + strength * rate) / (all_ - bad + strength * (1 - rate))) - np.log(rate / (1 - rate))
        seen = np.flatnonzero(all_[:_PAD])
        embed[seen] += rng.normal(0, 0.02, (len(seen), DIM)).astype(np.float32)
        embed[seen, k] += odds[seen]
    for f in filters:
        for k in range(_PARTS):
            f[k::DIM] = np.abs(f[k::DIM])  # every filter answers to suspicious words at first
    out[:-1] = np.abs(out[:-1])
    model = Model(embed, filters, bias, out, rate)
    scale = w / w.mean()
    params = [*filters, *bias, out]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    best, best_loss, step = None, np.inf, 0
    for _ in range(epochs):
        order = rng.permutation(len(begin))
        for i in range(0, len(order), BATCH):
            rows = np.sort(order[i : i + BATCH])
            part = ids[tx.ragged(begin[rows], size[rows])]
            start = np.cumsum(size[rows]) - size[rows]
            kept = (rng.random((len(rows), len(out) - 1)) >= DROP) / (1 - DROP)
            g_filters, g_bias, g_out, (touched, g_embed) = gradients(model, part, start, y[rows], scale[rows], kept)
            step += 1
            for k, (p, g) in enumerate(zip(params, [*g_filters, *g_bias, g_out], strict=True)):
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p -= RATE * (m1[k] / (1 - 0.9**step) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8) + DECAY * p)
            np.add.at(embed, touched, (-EMBED_RATE * g_embed).astype(np.float32))
            embed[np.unique(touched)] *= 1 - DECAY
            embed[_PAD] = 0
        if len(check) and best_loss > (loss := log_loss(model, check, labels[held], weights[held])):
            best_loss = loss
            best = Model(embed.copy(), [f.copy() for f in filters], [b.copy() for b in bias], out.copy(), rate)
    return best or model


def calibrate(counts: dict[str, np.ndarray]) -> dict[str, float]:
    """For each language the threshold of best F1, drawn towards that of all languages where rows are few.

    counts: of each language the rows by label (2) and by how many thresholds of GRID their score reaches (0 to len(GRID)).
    """

    def best(n: np.ndarray) -> float | None:
        if not n.sum(axis=1).all():
            return None
        clean, hit = (n[y, ::-1].cumsum()[::-1][1:] for y in (0, 1))  # rows at or above each threshold
        f1 = 2 * hit / (clean + hit + n[1].sum())
        top = GRID[f1 >= f1.max() - 1e-3]
        return float(np.median(top))

    whole = best(sum(counts.values(), np.zeros((2, len(GRID) + 1), np.int64)))
    whole = DEFAULT_THRESHOLD if whole is None else whole
    out = {"": whole}
    for lang in sorted(set(counts) - {""}):
        if (t := best(counts[lang])) is not None:
            n = float(counts[lang][1].sum())
            out[lang] = (n * t + 50 * whole) / (n + 50)
    return out


def labelled(labels: DataFrame, learn) -> DataFrame:
    """doc_id and __y of the rows that may be learnt from.  ``learn``: whether a doc_id may be."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("__y")).where("doc_id is not null and __y is not null").where(learn)
    return known.groupBy("doc_id").agg(F.max("__y").cast("int").alias("__y"))


def sample_ids(known: DataFrame, most: int) -> DataFrame:
    """doc_id, __y, __held (in the fold that is not fitted) of at most ``most`` rows of each label."""
    some = [known.where(F.col("__y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    return some[0].unionByName(some[1]).withColumn("__held", F.pmod(F.xxhash64("doc_id", F.lit(FOLDS)), F.lit(FOLDS)) == 0)


def packed(model: Model) -> bytes:
    used = np.flatnonzero(model.embed.any(axis=1))
    return pickle.dumps((used, model.embed[used], model._replace(embed=None)))


def unpacked(blob: bytes) -> tuple[np.ndarray, Model]:
    """As it scores: in double precision, with a row of embed for each bucket that it knows, and the row of every bucket (0: zeros)."""
    used, rows, model = pickle.loads(blob)
    at = np.zeros(_PAD + 1, np.int32)
    at[used] = np.arange(1, len(used) + 1)
    return at, doubled(model._replace(embed=np.concatenate([np.zeros((1, DIM), np.float32), rows])))


def text_scores(at: np.ndarray, model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    ids, begin = tokens(data, off)
    return scores(model, at[ids], begin)


def _trained(totals: dict[int, int], most: int):
    """A task that learns from all rows of the sample, and gives the model as one row."""

    def run(batches):
        rows = pd.concat([b.to_pandas() for b in batches] or [pd.DataFrame(columns=["doc_id", "text", "y", "held"])])
        rows = rows.sort_values("doc_id")
        y = rows["y"].to_numpy(np.float64)
        weight = np.array([totals[int(x)] / max(1, min(most, totals[int(x)])) for x in y])
        model = train(rows["text"].tolist(), y, weight, rows["held"].to_numpy(bool))
        yield pa.RecordBatch.from_arrays([pa.array([packed(model)], pa.binary())], names=["model"])
        del rows, model
        tx.release()

    return run


def fitted(docs: DataFrame, known: DataFrame, wanted: DataFrame, most: int) -> bytes:
    """The model, with a row of embed for each bucket that it knows."""
    totals = {r[0]: r[1] for r in known.groupBy("__y").agg(F.count("*")).collect()}
    # ``wanted`` has at most 2 * most rows
    text = F.coalesce("text", F.lit(""))
    # of a longer text any stretch may be learnt from, chosen by the id; no row is left out
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length(text) - TRAIN_CHARS + 1)).cast("int") + 1
    rows = texts_of(docs).join(F.broadcast(wanted), "doc_id").select("doc_id", F.substring(text, start, F.lit(TRAIN_CHARS)).alias("text"), F.col("__y").alias("y"), F.col("__held").alias("held"))
    # a doc_id is one row before the one task that learns: it reads 2 * most texts of TRAIN_CHARS characters at most
    rows = rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y"), F.max("held").alias("held"))
    row = rows.repartition(1).mapInArrow(_trained(totals, most), "model binary").first()
    return bytes(row["model"]) if row else packed(train([], np.zeros(0), np.zeros(0)))


def scored_rows(docs: DataFrame, labels: DataFrame, learn, most: int = SAMPLE) -> DataFrame:
    """``docs`` whole, with __score and __threshold (that of the row's language)."""
    known = stored(labelled(labels, learn), "known")
    wanted = stored(sample_ids(known, most), "sample")
    # a row for each bucket at most
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs, known, wanted, most))
    place = docs.columns.index("text")

    def scored_batches(batches, place: int):
        at, model = unpacked(sent.value)
        for batch in tx.small(batches):
            out = [text_scores(at, model, d, o) for _, _, d, o in tx.slices(tx.column(batch.column(place)), tx.SLICE // 4)]
            yield batch, np.concatenate(out) if out else np.zeros(0)

    def run(batches):
        for batch, score in scored_batches(batches, place):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    def steps(batches):
        for batch, score in scored_batches(batches, 1):
            step = np.searchsorted(GRID, score, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(step)], names=["doc_id", "lang", "step"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    # texts are scored where they are; only ids, languages and steps meet the labels
    reached = texts_of(docs, F.coalesce(lang, F.lit("")).alias("lang")).where(learn).mapInArrow(tx.task(steps), "doc_id long, lang string, step int").join(known, "doc_id")
    reached = reached.join(F.broadcast(wanted.where("not __held").select("doc_id")), "doc_id", "left_anti")
    counts: dict[str, np.ndarray] = {}
    # a row for each language, label and step
    for r in reached.groupBy("lang", "__y", "step").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["lang"], np.zeros((2, len(GRID) + 1), np.int64))[int(r["__y"] > 0), r["step"]] += r["n"]
    thresholds = calibrate(counts)

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    scored = plain.mapInArrow(tx.task(run), kinds + ", score double")
    scored = scored.toDF(*docs.columns, "__score")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    limits = F.create_map(*(F.lit(x) for kv in sorted(thresholds.items()) for x in kv))
    return scored.withColumn("__threshold", F.coalesce(F.try_element_at(limits, lang), F.lit(thresholds[""])))


def toxicity(docs: DataFrame, labels: DataFrame, learn, most: int = SAMPLE) -> DataFrame:
    """doc_id, score, threshold (of the row's language), flagged (score >= threshold)."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    scored = scored_rows(texts_of(docs, lang.alias("lang")), labels, learn, most)
    return scored.select("doc_id", F.col("__score").alias("score"), F.col("__threshold").alias("threshold"), (F.col("__score") >= F.col("__threshold")).alias("flagged"))


def not_toxic(docs: DataFrame, labels: DataFrame, learn, most: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, whole, below the threshold of their language."""
    return scored_rows(docs, labels, learn, most).where("__score < __threshold").drop("__score", "__threshold")
