import hashlib

import duckdb
import numpy as np
import public_tokenizers
import tiktoken
from test_decontaminate import plain as plain_hits
from test_jaccard import plain as plain_classes
from test_linechunks import rolling

import corpus_pipeline
from basewright.llm import bpe, cotraining, registry

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, {x.doc_id for x in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
        now = {x.doc_id for x in docs.select("doc_id").collect()}
        assert docs.columns == columns and now <= before, name
        before = now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {x.doc_id for x in last.collect()} == before
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, last.collect()))
    assert 0.5 * 200 < len(before) < 200


def test_against_a_plain_version(spark):
    """Each stage by plain loops over lists; of the classifier only the fitted numbers are taken."""
    model = cotraining.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = duckdb.execute(f"SELECT doc_id, text, lang, source, n_chars FROM '{DATA}/documents.parquet'").fetchall()
    items = duckdb.execute(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    kept = [(d, t) for d, t, *meta in rows if model.probability(cotraining.text_view(t)[None], cotraining.meta_view(*meta)[None])[0] >= 0.5]
    lines = [(d, t) for d, _, gone, t in rolling(kept) if not gone or t.strip(" ")]
    classes = {d: c for d, c, _ in plain_classes(lines)}
    ones = [(d, t) for d, t in lines if classes[d] == d]
    hit = {d for d, _, n, *_ in plain_hits(ones, items) if n}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    want = []
    for d, t in ones:
        if d not in hit:
            ids = own.encode_ordinary(t)
            want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert len(rows) > len(kept) > len(ones) > len(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(want)


def test_each_operator_has_one_query():
    assert sorted(int(x[2:].split("_")[0]) for x in registry.QUERIES) == list(range(1, 11))
