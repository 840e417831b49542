"""Wording: distinct n-grams, leave-one-out BLEU, vocabularies, tf-idf, and character statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bigrams, grams
from ..functions import text as T
from ..functions.columns import safe_ratio
from ..functions.constants import BLEU_EPSILON, FACETS
from . import pairs as P
from .pairs import kinds


def facet_rows(texts: DataFrame, keep: Sequence[str], facets: Sequence[str] = FACETS) -> DataFrame:
    """One row for each facet of a text, and 'combined' for all of them."""
    cells = [F.struct(F.lit(f).alias("facet"), F.col(f).alias("text")) for f in facets]
    cells.append(F.struct(F.lit("combined").alias("facet"), F.concat_ws(" ", *facets).alias("text")))
    return texts.select(*keep, F.explode(F.array(*cells)).alias("c")).select(*keep, "c.facet", "c.text")


def small_buckets(texts: DataFrame, by: Sequence[str], least: int = 2) -> DataFrame:
    """Buckets too small for leave-one-out scores."""
    return texts.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") < max(2, least))


#: Windows that one task holds at a time, about.
_TOGETHER = 2_000_000


def _shards(texts: DataFrame, by: Sequence[str]) -> int:
    """Parts into which the windows of a bucket are dealt; the largest bucket decides."""
    sums = texts.groupBy(*by).agg(F.sum(F.octet_length("text")).alias("bytes"))
    return max(1, int((sums.agg(F.max("bytes")).first()[0] or 0) / 5 / _TOGETHER) + 1)


def _leads(*cols: np.ndarray) -> np.ndarray:
    """First rows of the runs of equal rows."""
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _dealt(texts: DataFrame, by: Sequence[str], n_max: int, shards: int, nested: str | None, index: str | None) -> DataFrame:
    """by without ``nested``, rest, shard, blob, names, totals: the distinct windows of n_max tokens of each batch by bucket (with ``index``: of each text, with their counts).

    A window stands for all grams that begin with its first token.  Rows of ``rest`` are dealt by two tokens and speak for the grams from
    the second order on, the others by one token and for the first order.  Buckets that differ in ``nested`` alone (8 values at most)
    share a window, which says in which of ``names`` it stands.  totals: the grams by name and order, once a batch.
    """
    outer = [c for c in by if c != nested]
    inner = F.col(nested).cast("string") if nested else F.lit("")
    rows = texts.select(*outer, F.lower("text").alias("__text"), inner.alias("__nested"), *([F.col(index).cast("long").alias("__index")] if index else []))
    cols = [*outer, "rest", "shard", "blob", "names", "totals"]

    def run(batches):
        for batch in batches:
            digests, code, first = grams.lexical_words(batch.column(len(outer)))
            face, names = pd.factorize(batch.column(len(outer) + 1).to_pandas(), use_na_sentinel=False)
            if len(names) > 8:
                raise ValueError(f"more than 8 values of {nested}")
            names = [None if n is np.nan else n for n in names]
            if outer:
                keys = batch.select(list(range(len(outer)))).to_pandas()
                bucket, heads = pd.factorize(pd.MultiIndex.from_frame(keys)) if len(outer) > 1 else pd.factorize(keys.iloc[:, 0], use_na_sentinel=False)
                one = [keys.iloc[int(np.argmax(bucket == g))].tolist() for g in range(len(heads))]
            else:
                bucket, one = np.zeros(batch.num_rows, np.int64), [[]]
            place = batch.column(len(outer) + 2).to_numpy() if index else None
            total = np.zeros((len(one), len(names), n_max), np.int64)
            for n in range(n_max):
                np.add.at(total, (bucket, face, n), np.maximum(np.diff(first) - n, 0))
            words, text = grams.windows(code, first, n_max)
            lead = digests[code]
            out: list[list] = [[] for _ in cols]
            for rest in (False, True):
                at = np.flatnonzero(words[1] > 0) if rest and n_max > 1 else np.arange(0 if rest else len(code))
                w = words[:, at] if rest else words[:1]
                key = grams.mixed(lead[at], digests[w[1] - 1]) if rest and len(at) else lead[at]
                shard = ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                part, own, f = bucket[text[at]] * shards + shard, text[at], face[text[at]]
                sort = [part, *grams.packed(w, len(digests))]
                if index:
                    uniq, local = np.unique(place, return_inverse=True)
                    sort.append(local[own] * 8 + f)
                order = np.lexsort(sort[::-1])
                runs = _leads(*(c[order] for c in sort))
                bits, more = np.uint8(1) << f.astype(np.uint8), []
                if index:  # windows of a text that stand equally often in several buckets go together
                    count, row = np.diff(np.append(runs, len(order))), order[runs]
                    sort = [*(c[row] for c in sort[:-1]), local[own[row]], count]
                    order = np.lexsort(sort[::-1])
                    runs = _leads(*(c[order] for c in sort))
                    w, part, bits = w[:, row], part[row], bits[row]
                    more = [(sort[-2] if len(runs) else local[:0])[order[runs]], count[order[runs]]]
                mask = np.bitwise_or.reduceat(bits[order], runs) if len(runs) else bits[:0]
                row = order[runs]
                w, part = w[:, row], part[row]
                cut = np.append(_leads(part), len(part)) if len(part) else [0]
                for x, y in zip(cut[:-1], cut[1:], strict=True):
                    g, s = divmod(int(part[x]), shards)
                    extra = [mask[x:y]]
                    if index:
                        texts_of, inv = np.unique(more[0][x:y], return_inverse=True)
                        extra += [inv, more[1][x:y]]
                    blob = grams.to_blob(w[:, x:y], digests, extra)
                    if index:
                        blob = len(texts_of).to_bytes(8, "little") + uniq[texts_of].astype("<i8").tobytes() + blob
                    for o, v in zip(out, (*one[g], rest, s, blob, names, [] if rest else total[g].ravel().tolist()), strict=True):
                        o.append(v)
                    if not rest:
                        total[g] = 0
            kind = [*(batch.schema.field(k).type for k in range(len(outer))), pa.bool_(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kind, strict=True)], names=cols)

    return rows.mapInArrow(run, kinds(rows, outer) + "rest boolean, shard int, blob binary, names array<string>, totals array<long>")


def _masks(pdf: pd.DataFrame, mask: np.ndarray, sizes: Sequence[int]) -> tuple[np.ndarray, list]:
    """The masks with the bits of names that are common to all rows, and these names."""
    names = list(dict.fromkeys(n for own in pdf["names"] for n in own))
    if len(names) > 8:
        raise ValueError("more than 8 names")
    out, at = np.zeros(len(mask), np.uint8), 0
    for own, size in zip(pdf["names"], sizes, strict=True):
        for k, n in enumerate(own):
            out[at : at + size] |= (((mask[at : at + size] >> k) & 1) << names.index(n)).astype(np.uint8)
        at += size
    return out, names


def _head(pdf: pd.DataFrame, outer: Sequence[str], out: pd.DataFrame) -> pd.DataFrame:
    for k, c in enumerate(outer):
        out.insert(k, c, [pdf[c].iloc[0]] * len(out))
    return out if len(out) else pd.DataFrame()


def _named(df: DataFrame, texts: DataFrame, nested: str | None) -> DataFrame:
    return df.withColumn(nested, F.col("__name").cast(dict(texts.dtypes)[nested])).drop("__name") if nested else df.drop("__name")


def distinct_n(texts: DataFrame, by: Sequence[str], n_max: int = 6, nested: str | None = None) -> DataFrame:
    """Share of distinct grams among all, by n; 0 where there are none.

    Windows travel once for all orders, and once for the buckets that differ in ``nested`` (a column of ``by`` of at most 8 values) alone.
    """
    by = list(by)
    outer = [c for c in by if c != nested]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rest = bool(pdf["rest"].iloc[0])
        words, most, sizes, (mask,) = grams.from_blobs(pdf["blob"])
        mask, names = _masks(pdf, mask, sizes)
        distinct = np.zeros((len(names), n_max), np.int64)
        total = np.zeros_like(distinct)
        for own, t in zip(pdf["names"], pdf["totals"], strict=True):
            if len(t):
                total[[names.index(n) for n in own]] += np.reshape(np.asarray(t, np.int64), (len(own), n_max))
        order = np.lexsort(grams.packed(words, most)[::-1])
        words, mask = words[:, order], mask[order]
        for n in range(1 if rest else 0, len(words)):
            start = _leads(*words[: n + 1])
            bits = np.bitwise_or.reduceat(mask, start)[words[n, start] > 0]
            distinct[:, n] = [int(((bits >> f) & 1).sum()) for f in range(len(names))]
        f, n = (x.ravel() for x in np.indices(distinct.shape))
        return _head(pdf, outer, pd.DataFrame({"__name": [names[k] for k in f], "n": n + 1, "distinct": distinct.ravel(), "total": total.ravel()}))

    dealt = _dealt(texts, by, n_max, _shards(texts, by), nested, None)
    parts = dealt.groupBy(*outer, "rest", "shard").applyInPandas(run, kinds(dealt, outer) + "__name string, n int, distinct long, total long")
    parts = _named(parts, texts, nested)
    have = parts.groupBy(*by, "n").agg((F.sum("distinct") / F.sum("total")).alias("distinct_n"), F.sum("total").alias("total")).where("total > 0")
    grid = texts.select(*by).distinct().withColumn("n", F.explode(F.array(*map(F.lit, range(1, n_max + 1)))))
    return grid.join(have, [*by, "n"], "left").na.fill(0, ["total"]).na.fill(0.0, ["distinct_n"])


def _hits(gram: np.ndarray, text: np.ndarray, count: np.ndarray, n_texts: int) -> np.ndarray:
    """By text, how many of its grams also stand in another text; rows ascend by gram, then text."""
    lead = _leads(gram, text)
    gram, text, count = gram[lead], text[lead], np.add.reduceat(count, lead)
    order = np.lexsort((count, gram))
    gram, text, count = gram[order], text[order], count[order]
    ends = np.append(_leads(gram)[1:], len(gram)) - 1
    size = np.diff(np.append(-1, ends))
    others = np.repeat(count[ends], size)
    others[ends] = np.where(size > 1, count[np.maximum(ends - 1, 0)], 0)
    return np.bincount(text, np.minimum(count, others), n_texts).astype(np.int64)


def clipped_hits(texts: DataFrame, by: Sequence[str], n_max: int, index: str = "row_idx", nested: str | None = None) -> DataFrame:
    """by, index, and a column for each order (named 1, 2, ...): how many grams of a text also stand in another text of its bucket, each at most as often as there.

    A gram's count in the other texts is the largest count of its bucket, or the second largest
    for the one text that alone has the largest.
    """
    by = list(by)
    outer = [c for c in by if c != nested]
    orders = [str(n) for n in range(1, n_max + 1)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rest = bool(pdf["rest"].iloc[0])
        heads = [int.from_bytes(b[:8], "little") for b in pdf["blob"]]
        places = [np.frombuffer(b, "<i8", k, 8) for b, k in zip(pdf["blob"], heads, strict=True)]
        blobs = [b[8 + 8 * k :] for b, k in zip(pdf["blob"], heads, strict=True)]
        words, most, sizes, (mask, local, count) = grams.from_blobs(blobs)
        mask, names = _masks(pdf, mask, sizes)
        ids, inv = np.unique(np.concatenate(places), return_inverse=True)
        text = inv[local + np.repeat(np.cumsum([0, *heads[:-1]]), sizes)]
        order = np.lexsort(grams.packed(words, most)[::-1])
        words, mask, text, count = words[:, order], mask[order], text[order], count[order]
        hit = np.zeros((len(names), n_max, len(ids)), np.int64)
        for n in range(1 if rest else 0, len(words)):
            gram = np.zeros(words.shape[1], np.int64)
            gram[_leads(*words[: n + 1])[1:]] = 1
            gram = np.cumsum(gram)
            by_text = np.argsort(gram * len(ids) + text, kind="stable")
            by_text = by_text[words[n, by_text] > 0]
            for f in range(len(names)):
                own = by_text[(mask[by_text] >> f) & 1 > 0]
                if len(own):
                    hit[f, n] = _hits(gram[own], text[own], count[own], len(ids))
        f, t = np.nonzero(hit.any(axis=1))
        return _head(pdf, outer, pd.DataFrame({"__name": [names[k] for k in f], index: ids[t], **{o: hit[f, n, t] for n, o in enumerate(orders)}}))

    dealt = _dealt(texts, by, n_max, _shards(texts, by), nested, index)
    parts = dealt.groupBy(*outer, "rest", "shard").applyInPandas(run, kinds(dealt, outer) + f"__name string, `{index}` long, " + ", ".join(f"`{o}` long" for o in orders))
    return _named(parts, texts, nested).groupBy(*by, index).agg(*(F.sum(o).alias(o) for o in orders))


def self_bleu(texts: DataFrame, by: Sequence[str], n_max: int = 6, index: str = "row_idx", epsilon: float = BLEU_EPSILON, nested: str | None = None) -> DataFrame:
    """Mean BLEU of each text against the others of its bucket, for every order up to n_max, without pairs of texts.

    Buckets below two texts are left out.
    """
    hits = clipped_hits(texts, by, n_max, index, nested)
    lens = texts.select(*by, F.col(index).cast("long").alias(index), F.size(T.lexical_tokens(F.col("text"))).alias("len"))
    # the closest other length: neighbours in the order of lengths, of which a bucket has few; a length that stands twice is its own
    sizes = lens.groupBy(*by, "len").agg(F.count("*").alias("same"))
    wl = Window.partitionBy(*by).orderBy("len")
    sizes = sizes.withColumn("prev", F.lag("len").over(wl)).withColumn("next", F.lead("len").over(wl)).withColumn("size", F.sum("same").over(Window.partitionBy(*by))).where("size > 1")
    close = F.when(F.col("same") > 1, F.col("len")).when(F.col("prev").isNull(), F.col("next")).when(F.col("next").isNull(), F.col("prev")).when(F.col("len") - F.col("prev") <= F.col("next") - F.col("len"), F.col("prev")).otherwise(F.col("next"))
    bp = F.when(F.col("len") > close, F.lit(1.0)).when(F.col("len") > 0, F.exp(1 - close / F.when(F.col("len") > 0, F.col("len")))).otherwise(F.lit(0.0))
    near = lens.join(sizes.select(*by, "len", bp.alias("bp")), [*by, "len"])
    p = near.join(hits, [*by, index], "left").na.fill(0, [str(n) for n in range(1, n_max + 1)])
    logs, cells = F.lit(0.0), []
    for n in range(1, n_max + 1):
        hit, total = F.col(str(n)), F.greatest(F.col("len") - n + 1, F.lit(1))
        logs = logs + F.log(F.when(hit > 0, hit.cast("double")).otherwise(F.lit(epsilon)) / total)
        none = (F.col("1") == 0) | (F.col("len") == 0)
        cells.append(F.struct(F.lit(n).alias("n"), F.when(none, F.lit(0.0)).otherwise(F.col("bp") * F.exp(logs / n)).alias("score")))
    p = p.select(*by, F.explode(F.array(*cells)).alias("s"))
    return p.groupBy(*by, "s.n").agg(F.count("*").alias("n_texts"), F.avg("s.score").alias("self_bleu"))


def lexical_aggregate(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n_buckets"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def relative_to(rows: DataFrame, by: Sequence[str], value: str, base: str = "low") -> DataFrame:
    """Ratio of a value to that of the base tier."""
    b = rows.where(F.col("effort") == base).select(*by, F.col(value).alias("base"))
    return rows.join(b, list(by)).select(*by, "effort", value, safe_ratio(F.col(value), F.col("base")).alias("relative"))


def vocabulary(texts: DataFrame, by: Sequence[str], tokens: Column) -> DataFrame:
    """by, token, tf."""
    return exploded(texts, by, tokens).groupBy(*by, "token").agg(F.count("*").alias("tf"))


def exploded(texts: DataFrame, by: Sequence[str], tokens: Column) -> DataFrame:
    """by, token; outer, as the filter that Spark sets before an explode would find all tokens a second time."""
    return texts.select(*by, F.explode_outer(tokens).alias("token")).where("token is not null")


#: Keys of a block, and distinct tokens that one task holds at a time, about.
KEYS, TOKENS = 1024, 50_000


def vocabulary_jaccard(vocab: DataFrame, by: Sequence[str], key: str, keys: DataFrame) -> DataFrame:
    """Mean Jaccard index of vocabularies over all pairs of ``keys`` (by, key) whose union isn't empty; 0 without any.

    Tokens meet as rows of 0/1 matrices of blocks of keys, so a common token costs a row and not a pair of keys.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy(key)  # a row for each key
    ids = keys.select(*by, key).distinct().withColumn("__k", F.row_number().over(w) - 1)
    v = vocab.select(*by, key, "token").distinct().join(ids, [*by, key])
    sizes = v.groupBy(*by, "__k").agg(F.count("*").alias("size"))
    salts = max(1, v.select("token").distinct().count() // TOKENS)
    per = v.groupBy(*by, "token").agg(F.sort_array(F.collect_list("__k")).alias("ks"))
    blocks = F.array_distinct(F.transform("ks", lambda k: F.floor(k / KEYS).cast("int")))
    per = per.withColumn("__bs", blocks).withColumn("__salt", F.pmod(F.xxhash64("token"), F.lit(salts)))
    per = per.withColumn("__x", F.explode("__bs")).withColumn("__y", F.explode("__bs")).where("__x <= __y")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = int(pdf["__x"].iloc[0]) * KEYS, int(pdf["__y"].iloc[0]) * KEYS
        size = pdf["ks"].map(len).to_numpy()
        flat, row = np.concatenate(pdf["ks"].to_numpy()), np.repeat(np.arange(len(pdf)), size)

        def block(first):
            m = np.zeros((len(pdf), KEYS), np.float32)
            pick = (flat >= first) & (flat < first + KEYS)
            m[row[pick], flat[pick] - first] = 1
            return m

        both = block(x).T @ block(y)
        a, b = np.nonzero(np.triu(both, 1) if x == y else both)
        out = pd.DataFrame({"a": a + x, "b": b + y, "both": both[a, b].astype(np.int64)})
        for k, c in enumerate(by):
            out.insert(k, c, [pdf[c].iloc[0]] * len(out))
        return out if len(out) else pd.DataFrame()

    both = per.groupBy(*by, "__x", "__y", "__salt").applyInPandas(run, kinds(per, by) + "a long, b long, both long").groupBy(*by, "a", "b").agg(F.sum("both").alias("both"))
    j = both.join(sizes.select(*by, F.col("__k").alias("a"), F.col("size").alias("na")), [*by, "a"]).join(sizes.select(*by, F.col("__k").alias("b"), F.col("size").alias("nb")), [*by, "b"])
    total = j.groupBy(*by).agg(F.sum(F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("total"))
    n = ids.join(sizes, [*by, "__k"], "left").groupBy(*by).agg(F.count("*").alias("k"), F.count_if(F.col("size").isNull()).alias("none"))
    pairs = F.col("k") * (F.col("k") - 1) / 2 - F.col("none") * (F.col("none") - 1) / 2
    return n.join(total, by, "left").select(*by, F.col("k").alias("n_keys"), F.when(pairs > 0, F.coalesce("total", F.lit(0.0)) / F.when(pairs > 0, pairs)).otherwise(F.lit(0.0)).alias("mean_jaccard"))


def _sizes(by: Sequence[str], key: str, keys: DataFrame) -> DataFrame:
    return keys.select(*by, key).distinct().groupBy(*by).agg(F.count("*").alias("N"))


def tf_idf(vocab: DataFrame, by: Sequence[str], key: str, keys: DataFrame) -> DataFrame:
    """tf, df, idf = ln(N / df) and tf_idf = tf / (tokens of the key) * idf, a key being a document; N: all ``keys`` (by, key), also those without tokens."""
    # windows, so that the texts are read once; a token has a row for each key, a key one for each of its words
    df, total = Window.partitionBy(*by, "token"), Window.partitionBy(*by, key)
    out = vocab.withColumn("df", F.count("*").over(df)).where(F.col(key).isNotNull()).join(_sizes(by, key, keys), list(by))
    out = out.withColumn("__total", F.sum("tf").over(total)).withColumn("idf", F.log(F.col("N") / F.col("df")))
    return out.withColumn("tf_idf", F.col("tf") / F.col("__total") * F.col("idf")).drop("__total")


def token_idf(vocab: DataFrame, by: Sequence[str], key: str, keys: DataFrame) -> DataFrame:
    """by, token, tf over all keys, df and idf = ln(N / df): a row for each token, for those who need no key."""
    tf = F.sum(F.when(F.col(key).isNotNull(), F.col("tf")))  # as in tf_idf, a null key counts in df alone
    tokens = vocab.groupBy(*by, "token").agg(F.count("*").alias("df"), tf.alias("tf"))
    return tokens.join(_sizes(by, key, keys), list(by)).withColumn("idf", F.log(F.col("N") / F.col("df")))


def idf_mean(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean idf over all tokens of a group, every use counting."""
    return scored.groupBy(*by).agg((F.sum(F.col("tf") * F.col("idf")) / F.sum("tf")).alias("mean_idf"))


def top_terms(scored: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("tf_idf", 9)), "token")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*by, "rank", "token", "tf", "tf_idf")


def universal_words(vocab: DataFrame, key: str, keys: DataFrame, share: float = 0.9) -> DataFrame:
    """Tokens of at least floor(share * N) of the N ``keys`` (also those without tokens), with their total frequency."""
    n = keys.select(key).distinct().count()
    t = vocab.groupBy("token").agg(F.countDistinct(key).alias("df"), F.sum("tf").alias("tf"))
    return t.where(F.col("df") >= int(n * share)).select("token", "df", "tf")


def universal_share(texts: DataFrame, by: Sequence[str], tokens: Column, words: DataFrame) -> DataFrame:
    """Mean share of tokens that are universal, over texts that have tokens."""
    t = exploded(texts, [*by, "row_idx"], tokens).join(words.select("token", F.lit(1.0).alias("u")), "token", "left")
    per = t.groupBy(*by, "row_idx").agg(F.avg(F.coalesce("u", F.lit(0.0))).alias("share"))
    return per.groupBy(*by).agg(F.count("*").alias("n_texts"), F.avg("share").alias("universal_share"))


def df_histogram(vocab: DataFrame, key: str) -> DataFrame:
    df = vocab.groupBy("token").agg(F.countDistinct(key).alias("df"))
    bucket = F.when(F.col("df") == 1, "1").when(F.col("df") <= 5, "2-5").when(F.col("df") <= 15, "6-15").otherwise(">=16")
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_tokens"))


def keyword_coverage(texts: DataFrame, by: Sequence[str], phrase: str, text: str = "idea") -> DataFrame:
    """Share of texts that hold the phrase, whatever the case."""
    return texts.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.contains(F.lower(text), F.lower(phrase)).cast("double")).alias("coverage"))


def prefix_share(texts: DataFrame, by: Sequence[str], text: str, length: int = 7) -> DataFrame:
    """Share of the commonest prefix."""
    p = texts.groupBy(*by, F.substring(text, 1, length).alias("p")).agg(F.count("*").alias("c"))
    return p.groupBy(*by).agg((F.max("c") / F.sum("c")).alias("modal_prefix_share"))


def string_diagnostics(texts: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """Share of distinct strings, lengths, entropy and modal prefix of short strings."""
    t = texts.withColumn("__e", T.char_entropy(F.col(text)))
    s = t.groupBy(*by).agg(F.count("*").alias("n"), (F.countDistinct(F.sha2(text, 256)) / F.count("*")).alias("unique_share"), F.avg(F.length(text)).alias("mean_length"), F.stddev_pop(F.length(text)).alias("std_length"), F.avg("__e").alias("mean_entropy"))
    return s.join(prefix_share(texts, by, text), list(by))


def bigram_distances(first: pd.DataFrame, second: pd.DataFrame) -> np.ndarray:
    sets = [list(map(list, x["s"])) for x in ((first,) if second is first else (first, second))]
    size = [np.fromiter(map(len, s), np.int64, len(s)) for s in sets]
    code, _ = pd.factorize(np.array([g for s in sets for one in s for g in one], object))
    out, at = [], 0
    for s, n in zip(sets, size, strict=True):
        m = np.zeros((len(s), code.max(initial=-1) + 1), np.float32)
        m[np.repeat(np.arange(len(s)), n), code[at : at + int(n.sum())]] = 1
        at += int(n.sum())
        out.append(m)
    both = (out[0] @ out[-1].T).astype(np.float64)
    union = size[0][:, None] + size[-1][None, :] - both
    return np.where(union > 0, 1 - both / np.maximum(union, 1), 0.0)


def string_tiles(texts: DataFrame, by: Sequence[str], text: str, index: str = "row_idx") -> DataFrame:
    return P.tiled(texts.select(*by, F.col(index).alias("i"), T.bigram_set(F.col(text)).alias("s")), by)


def string_distances(texts: DataFrame, by: Sequence[str], text: str, index: str = "row_idx") -> DataFrame:
    """Jaccard distances of character-bigram sets over all pairs i < j of a group."""
    return P.all_pairs_of(string_tiles(texts, by, text, index), by, bigram_distances)


#: Texts that travel in one row at most, and of the least tile.
SETS, SET_TILE = 2048, 16384


def packed_sets(texts: DataFrame, by: Sequence[str], text: str, most: int) -> DataFrame:
    """by, blob, __own, __tiles: the bigram sets of up to SETS texts of a tile; groups beyond ``most`` texts have several tiles, null keys are left out."""
    rows = texts.where(" AND ".join(f"`{c}` IS NOT NULL" for c in by)).select(*by, F.col(text).alias("__text"))
    large = rows.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    large = large.select(*by, P.tiles(F.col("__n"), most).alias("__tiles"))  # a row for each ``most`` texts at most
    rows = rows.join(F.broadcast(large), list(by), "left").select(*by, F.coalesce("__tiles", F.lit(1)).alias("__tiles"), "__text")

    def run(frames):
        turn: dict = {}
        for pdf in frames:
            out = []
            for key, own in pdf.groupby(list(by), sort=False):
                sets = [bigrams.codes(t) for t in own["__text"]]
                count = int(own["__tiles"].iloc[0])
                for lo in range(0, len(sets), SETS):
                    turn[key] = turn.get(key, TaskContext.get().partitionId() - 1) + 1
                    out.append((*key, bigrams.to_blob(sets[lo : lo + SETS]), turn[key] % count, count))
            yield pd.DataFrame(out, columns=[*by, "blob", "__own", "__tiles"])

    return rows.mapInPandas(run, kinds(rows, by) + "blob binary, __own long, __tiles long")


def string_distance_counts(texts: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """by, distance, n: how many pairs of texts of a group have a distance; a task sends a row for each of its distances."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (list(pdf["blob"][pdf["__side"] == side]) for side in (0, 1))
        same = pdf["__a"].iloc[0] == pdf["__b"].iloc[0]
        if not a or not (b or same):
            return pd.DataFrame()
        first = bigrams.Tile(a, True)
        both, total, n = bigrams.cells(first, first if same else bigrams.Tile(b, True))
        union = total - both
        at, inv = np.unique(np.where(union > 0, 1 - both / np.maximum(union, 1), 0.0), return_inverse=True)
        count = np.zeros(len(at), np.int64)
        np.add.at(count, inv, n)
        return _head(pdf, by, pd.DataFrame({"distance": at, "n": count}))

    tiles = P.apart(P.meeting(packed_sets(texts, by, text, SET_TILE)), [*by, "__a", "__b"])
    found = tiles.groupBy(*by, "__a", "__b").applyInPandas(run, kinds(tiles, by) + "distance double, n long")
    return found.groupBy(*by, "distance").agg(F.sum("n").alias("n"))


def string_distance_summary(texts: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """n_pairs, mean, median and deviation of these distances, without a row for each pair: they follow from how often each distance stands."""
    w = Window.partitionBy(*by).orderBy("distance")  # a row for each distance
    counts = string_distance_counts(texts, by, text).withColumn("__upto", F.sum("n").over(w)).withColumn("__size", F.sum("n").over(Window.partitionBy(*by)))
    n, above = F.sum("n"), F.col("distance") - 1
    mean = F.sum(F.col("n") * above) / n
    middle = [F.min(F.when(F.col("__upto") >= rank, F.col("distance"))) for rank in (F.floor((F.col("__size") + 1) / 2), F.floor(F.col("__size") / 2) + 1)]
    std = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("n") * above * above) / n - mean * mean))
    return counts.groupBy(*by).agg(n.alias("n_pairs"), (1 + mean).alias("mean_distance"), ((middle[0] + middle[1]) / 2).alias("median_distance"), std.alias("std_distance"))


def cell_aggregate(rows: DataFrame, by: Sequence[str], value: str, p: str) -> DataFrame:
    """Means, medians, 90th percentile, sample deviation and how many p are below 0.05, leaving out NaN."""
    v = F.when(~F.isnan(value), F.col(value))
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.9)).alias("q90"), F.stddev_samp(v).alias("std"), F.count_if((F.col(p) < 0.05) & ~F.isnan(p)).alias("n_significant"))
