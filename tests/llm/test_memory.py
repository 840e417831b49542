"""What tasks and idle workers hold."""

import weakref

import numpy as np
import public_tokenizers
import pyarrow as pa

from corpusmetrics.llm import encoder, graph, packing
from corpusmetrics.llm import text as tx
from corpusmetrics.llm import toxicity as tox
from corpusmetrics.llm.jaccard_join import jaccard_join
from corpusmetrics.llm.shared import stored


def test_links_are_written_before_they_are_joined(spark, docs, monkeypatch):
    """No task that joins links has a second Python step, so none needs a second worker."""
    plans = []

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(graph, "stored", noted)
    jaccard_join(docs).collect()
    assert any("MapInArrow" in p for p in plans)
    assert not any("FlatMapGroupsInPandas" in p for p in plans)


def test_spans_are_encoded_few_at_a_time():
    sizes = []
    enc = encoder.SpanEncoder(lambda spans: sizes.append(len(spans)) or [[len(s), *s] for s in spans])
    text = " ".join(f"w{i}" for i in range(20_000)).encode()
    data = np.frombuffer(text, np.uint8)
    st, en, _ = tx.word_bounds(data, np.array([0, len(data)]))
    ids, n = enc(data, st, en)
    assert max(sizes) <= encoder.ENCODED and sum(sizes) == len(n) == 20_000
    assert ids.tolist() == [x for a, b in zip(st.tolist(), en.tolist(), strict=True) for x in (b - a, *text[a:b])]


def test_many_spans_are_forgotten_with_the_task(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words", None]})
    for kept, known in ((600_000, True), (1, False)):
        monkeypatch.setattr(encoder, "KEPT_SPANS", kept)
        assert sum(b.num_rows for b in packing._pieces(path, 1, 4096)(iter([batch]))) == 2
        assert bool(len(packing._encoder(path).hash)) is known and bool(len(packing._encoder(path).bytes)) is known


def test_memory_is_given_back_when_the_frame_is_gone(monkeypatch):
    class Big:
        pass

    held, gone = [], []

    def run(batches):
        big = Big()
        held.append(weakref.ref(big))
        yield from batches

    monkeypatch.setattr(tx, "release", lambda: gone.append(held[0]() is None))
    assert list(tx.task(run)([1, 2])) == [1, 2]
    assert gone == [True]


def test_a_scoring_task_has_no_second_table_of_embeddings():
    """Embeddings that become doubles when looked up give the very scores of a table of doubles."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 200, 30)) + (" vile" if i % 3 == 0 else "") for i in range(120)]
    y = (np.arange(120) % 3 == 0).astype(np.float64)
    at, model = tox.unpacked(tox.packed(tox.train(texts, y, np.ones(120), epochs=1)))
    assert model.embed.dtype == np.float32 and model.out.dtype == np.float64
    col = tx.column(pa.array(texts))
    wide = model._replace(embed=model.embed.astype(np.float64))
    assert (tox.text_scores(at, model, *tx.raw(col)) == tox.text_scores(at, wide, *tx.raw(col))).all()
