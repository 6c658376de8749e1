"""Registered queries against their SQL, and the stages of the pipeline in order."""

import os

import pytest

from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op5_warc_dictionary", "op6_near_duplicates", "op7_mix_sources", "op8_substring_dedup", "op10_decontaminate"])
def test_query_against_sql(spark, name):
    from tessella.llm import queries  # noqa: F401
    from tessella.llm.common import QUERIES, SQL

    assert compare(spark, connect(SF), QUERIES[name], SQL[name], SF) is None


def test_stages(spark):
    import corpus_pipeline as p
    from tessella.llm import queries  # noqa: F401
    from tessella.llm.common import QUERIES, written

    names = [n for n, _ in p.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in p.STAGES:
        seen.append(written(stage(spark, seen[-1], SF), "stage"))
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(d.columns == docs.columns for d in seen[1:5])
    assert ids[0] > ids[1] and ids[1] >= ids[2] >= ids[3] == ids[4] >= ids[5]
    # near duplicates: what is left has no pair at 0.8 over five words, and what went has one among what came in
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").encode().lower().split()] for i in range(max(1, len(w) - 4)) if w}
    came = {r.doc_id: shingles(r.text) for r in seen[1].collect()}
    near = lambda x, y: x and y and 100 * len(x & y) >= 80 * len(x | y)
    left = sorted(ids[2])
    assert not any(near(came[a], came[b]) for k, a in enumerate(left) for b in left[:k])
    assert all(any(near(came[g], x) for i, x in came.items() if i < g) for g in ids[1] - ids[2])
    # decontamination: those that go hold a window
    hits = {r.doc_id: r.n_hit for r in QUERIES["op10_decontaminate"](spark, SF).collect()}
    assert {i for i in ids[2] if hits[i]} == ids[2] - ids[3]
    # personal data: only texts with entities change, and their length follows
    old = {r.doc_id: r for r in seen[3].collect()}
    for r in seen[4].collect():
        assert r.n_chars == (len(r.text) if r.text != old[r.doc_id].text else old[r.doc_id].n_chars)
    assert p.run(spark, SF).columns == seen[5].columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_every_labelled_toxic_row_goes(spark):
    import corpus_pipeline as p

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in p.drop_toxic(spark, docs, SF).select("doc_id").collect()}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert toxic and not toxic & kept and len(clean & kept) >= 0.95 * len(clean)


def test_near_copies_with_null_and_repeated_ids(spark):
    import corpus_pipeline as p
    from corpus_words import words

    base, other, third = words(1, 120), words(2, 90), words(3, 90)
    rows = [(None, base, "x"), (None, base, "x"), (3, base, "a"), (3, base + " more", "b"), (2, "", "a"), (2, "", "a"), (5, other, "a"), (5, third, "a"), (None, None, "y"), (None, words(4, 60), "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row0 string").repartition(3)
    out = p.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted((r.text or "") for r in got if r.text not in (base, base + " more")) == sorted(["", "", "", other, third, words(4, 60)])
    assert [r.doc_id for r in got if r.text in (base, base + " more")] == [3]
    assert p.drop_near_duplicates(spark, docs.limit(0), SF).count() == 0
