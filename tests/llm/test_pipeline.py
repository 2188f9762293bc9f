import zlib

import numpy as np

import corpus_pipeline as P
from test_decontaminate import brute as contaminated
from test_mixing import count
from test_ngram_join import brute as near
from tapeworks.llm import mixing, token_store, toxicity


def test_stages(spark, sf, documents):
    """Each stage judged on its own input, by the brute-force versions of its operator."""
    docs, seen = documents, {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        seen[name] = (docs, out)
        if name != "token_output":
            assert out.columns == documents.columns
            docs = spark.createDataFrame(out.collect(), documents.schema)
    ids = lambda frame: sorted(r.doc_id for r in frame.select("doc_id").collect())
    pairs = lambda frame: [(r.doc_id, r.text) for r in frame.collect()]

    before, after = seen["toxicity"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(before, labels.where(~toxicity.held_out(labels.doc_id)))
    assert ids(after) == sorted(r.doc_id for r in toxicity.score(before, model).collect() if r.predicted == 0)
    before, after = seen["ngram_jaccard_join"]
    assert ids(after) == sorted(d for d, n, c in near(pairs(before)) if n == 0 or d == c)
    before, after = seen["decontamination"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert ids(after) == sorted(r[0] for r in contaminated(pairs(before), bench) if not r[5])
    before, after = seen["mixing"]
    rates = mixing.rates(before, mixing.WEIGHTS, mixing.OTHER, None, "source", "text", "chars")
    want = [r.doc_id for r in before.collect() for _ in range(count(r.doc_id, rates[r.source if r.source in mixing.WEIGHTS else None]))]
    assert ids(after) == sorted(want)
    before, after = seen["token_output"]
    encoder = token_store.PieceEncoder(token_store.default_tokenizer())
    got, start = [], 0
    for d, t in sorted(pairs(before)):
        x = np.array([*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        got.append((d, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert sorted(map(tuple, after.collect())) == sorted(got)
    assert sorted(map(tuple, P.run(spark, sf).collect())) == sorted(got)
