"""The stages on a small corpus, and every query against its SQL or its own rows."""

import public_tokenizers
import pytest
from compare import difference, oracle
from test_corpus import merge_find, plain_contamination, plain_fingerprint, plain_line_dedup, plain_shingles
from tokenizers import Tokenizer

import corpus_pipeline
from sourceloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    assert difference(spark, oracle(FOLDER), FOLDER, name) is None


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(spark.createDataFrame(stage(spark, kept[-1], FOLDER).collect(), schema=None))
    for df in kept[:-1]:
        assert sorted(df.columns) == sorted(corpus_pipeline.COLUMNS)
    text = [{r["doc_id"]: r["text"] for r in df.collect()} for df in kept[:-1]]
    assert set(text[1]) < set(text[0]) and all(text[0][i] == t for i, t in text[1].items())
    bad = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 0").collect()}
    gone = set(text[0]) - set(text[1])
    known = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert len(gone & bad) >= 0.8 * len(bad & set(text[0])) and len(gone & known - bad) <= 0.05 * len(known)
    assert text[2] == {i: t for i, (t, _) in plain_line_dedup(list(text[1].items())).items()}
    prints = {i: plain_fingerprint(t) for i, t in text[2].items()}
    sets = {i: plain_shingles(t) for i, t in text[2].items()}
    alike = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = merge_find(prints, [(a, b) for a in prints for b in prints if a < b and alike(a, b)])
    assert text[3] == {i: text[2][i] for i in prints if root[i] == i}
    contaminated = {x[0] for x in plain_contamination(list(text[3].items()), items) if x[4]}
    assert contaminated and set(text[4]) == set(text[3]) - contaminated
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r["doc_id"]: r["n_tokens"] for r in kept[5].collect()} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in text[4].items()}
