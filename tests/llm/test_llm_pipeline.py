"""The registered queries and the pipeline's stages."""

import itertools

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from check import TABLES, compare
from embertrace.llm import language, quality
from embertrace.llm.common import written
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_every_operator_is_registered():
    names = contract.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


@pytest.mark.parametrize("name", ["op1_jaccard", "op7_chat", "op10_decontamination", "op11_cover_tree", "op12_prefix_trie", "op13_resampling"])
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert compare(spark, con, SF, name, contract.queries()[name], contract.oracle_sql()[name]) == ""


CONTRACT = {
    "op2_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op4_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op5_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op6_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_lm_scores": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op9_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
}


@pytest.mark.parametrize("name", CONTRACT)
def test_query_columns_and_rows(spark, name):
    df = contract.queries()[name](spark, SF)
    want = CONTRACT[name].split(", ")
    assert [f"{n} {t}" for n, t in df.dtypes][: len(want)] == want
    ids = {r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    got = [r[0] for r in df.select("doc_id").collect()]
    assert set(got) == ids and (name == "op9_packing" or len(got) == len(ids))


def test_stages_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    after = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF), "test")
        assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
        after.append((docs, out))
        docs = out
    # 1: exactly what the model accepts
    before, kept = after[0]
    model = language.fit(before, F.lit(True))
    assert sorted(r.doc_id for r in language.predict(before, model).where("accepted").collect()) == sorted(r.doc_id for r in kept.collect())
    assert kept.count() > 0.97 * before.count()
    # 2: labelled good documents stay, bad ones go
    before, kept = after[1]
    share = lambda q: kept.join(labels.where(f"quality = {q}"), "doc_id").count() / max(1, before.join(labels.where(f"quality = {q}"), "doc_id").count())
    assert share(1) > 0.97 and share(0) < 0.1
    # 3: no linked pair is left, every class keeps its lowest id
    before, kept = after[2]
    sets = {r.doc_id: shingles(r.text) for r in before.collect()}
    stays = {r.doc_id for r in kept.collect()}
    linked = {d: d for d in sets}

    def find(x):
        while linked[x] != x:
            x = linked[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            linked[high] = low
    assert stays == {d for d in sets if find(d) == d}
    # 4: documents with a benchmark passage go
    before, kept = after[3]
    passages = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in before.collect() if not any(p in " ".join(r.text.lower().split()) for p in passages)}
    assert {r.doc_id for r in kept.collect()} == clean


def test_stages_on_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert corpus_pipeline.packed(spark, docs, SF).columns[0] == "doc_id"
