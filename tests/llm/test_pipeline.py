"""The corpus pipeline against its stages and the brute force of their rules."""

import hashlib

import corpus_pipeline
from keystrata.llm import mixing
from tests.llm.test_lines import brute
from tests.llm.test_models import mixed
from tests.llm.test_operators import components, statistics
from tokenizers import Tokenizer

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, rows = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        rows[name] = {r.doc_id: r for r in docs.collect()}
        if k < 4:
            assert sorted(docs.columns) == sorted(corpus_pipeline.COLUMNS)
        texts = {r.doc_id: r.text for r in before.collect()}
        if name == "quality rules":
            # The forest rejects a few more; what stays is unchanged.
            measured = {i: statistics(t) for i, t in texts.items()}
            passed = {i for i, (n, *_, repeated) in measured.items() if n >= 50 and 100 * repeated <= 50 * n}
            assert set(rows[name]) <= passed and len(rows[name]) > 0.9 * len(passed) and all(r.text == texts[i] for i, r in rows[name].items())
        if name == "line dedup":
            ids = sorted(texts)
            assert {i: r.text for i, r in rows[name].items()} == dict(zip(ids, brute([texts[i] for i in ids], copies=True)))
        if name == "source mixing":
            taken = mixed([(r.doc_id, r.text, r.lang, r.source) for r in before.collect()], mixing.WEIGHTS, corpus_pipeline.MIX["share"], corpus_pipeline.MIX["max_epochs"], corpus_pipeline.MIX["seed"])
            assert set(rows[name]) == {i for i, (epochs, prefix) in taken.items() if epochs or prefix}
        if name == "minhash near-dedup":
            want = components({r.doc_id: r.text for r in before.collect()}, 5, 80)
            assert set(rows[name]) == {i for i, (_, _, kept) in want.items() if kept}
    assert set(rows["quality rules"]) == set(rows["line dedup"]) > set(rows["minhash near-dedup"]) > set(rows["source mixing"])
    lib = Tokenizer.from_str(corpus_pipeline.vocabulary("word_bpe_49k.json"))
    last = rows["bpe encoding"]
    assert set(last) == set(rows["source mixing"])
    for i, r in rows["source mixing"].items():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert last[i].ids == ids and last[i].n_tokens == len(ids)
        assert last[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    out = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id: r.ids for r in out.collect()} == {i: r.ids for i, r in last.items()}
