"""Every stage of the corpus pipeline against its own input, and the run as a whole."""

from collections import Counter

import pytest

import corpus_pipeline
from stocktide.llm import pii
from stocktide.llm.common import stored
from tests.llm.test_operators import AWKWARD, SCHEMA, SF, base_brute, near_brute


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], SF), name))
    return docs


def ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


def test_stages_keep_the_columns(steps):
    assert all(tuple(d.columns) == corpus_pipeline.COLUMNS for d in steps[1:5])


def test_toxic_documents_go_and_clean_ones_stay(spark, steps):
    left = set(ids(steps[1]))
    marks = spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null").collect()
    toxic, clean = ({r["doc_id"] for r in marks if r["toxic"] == k} for k in (1, 0))
    assert len(clean & left) >= 0.95 * len(clean & set(ids(steps[0])))
    assert len(toxic & left) <= 0.5 * len(toxic)


def test_one_of_each_near_group_stays(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps[1].collect()]
    assert sorted(ids(steps[2])) == sorted(i for i, _, _, kept in near_brute(rows, 5, 80) if kept)


def test_different_texts_under_one_id_all_stay(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (1, None), (2, c), (2, c + " more"), (3, a + " end"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (1, None), (2, c), (None, "no id")], key=str)


def test_personal_data_is_redacted(steps):
    before = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    model = pii.train(steps[2])
    for r in steps[3].collect():
        base, added = pii.find_spans(before[r["doc_id"]], model)
        assert r["text"] == pii.redacted(before[r["doc_id"]], base + added)
        assert r["text"] is None or not base_brute(r["text"])


def test_mix_repeats_but_never_drops(steps):
    uses = Counter(ids(steps[4]))
    assert set(uses) == set(ids(steps[3])) and max(uses.values()) <= 5


def test_packing_holds_every_use(steps):
    assert Counter(ids(steps[4])) == Counter(r["doc_id"] for r in steps[5].where("piece = 0").collect())


def test_run_gives_the_same_rows(spark, steps):
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    rows = lambda df: sorted(tuple(r) for r in df.select(*key).collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(steps[5])


def test_awkward_and_empty_tables(spark):
    for rows in (AWKWARD, []):
        docs = spark.createDataFrame([(*r, "x", "y", "z", "c") for r in rows], SCHEMA)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() >= (len(rows) > 0)
