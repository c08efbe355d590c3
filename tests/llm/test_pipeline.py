"""Every stage against its operator's own rows, and the whole against the stages."""

from collections import defaultdict

import corpus_pipeline as cp
from sojourn.llm import crf_quality, decontam, langid, simhash
from sojourn.llm.common import table, written

from .helpers import docs_frame, odd_rows

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_their_operators_say(spark):
    assert [n for n, _ in cp.STAGES] == ["quality", "language", "near_dedup", "decontamination", "packing"]
    docs = table(spark, SF, "documents").cache()
    columns = docs.columns
    stage = dict(cp.STAGES)

    kept = {r["doc_id"] for r in stage["quality"](spark, docs, SF).collect()}
    assert kept == {r["doc_id"] for r in crf_quality.score(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}

    kept = {r["doc_id"] for r in stage["language"](spark, docs, SF).collect()}
    assert kept == {r["doc_id"] for r in langid.identify(docs).where(f"lang_pred <> 'und' and score >= {cp.MIN_LANGUAGE}").collect()}

    kept = stage["near_dedup"](spark, docs, SF)
    assert kept.columns == columns
    groups = defaultdict(list)
    for r in simhash.near_duplicates(docs).collect():
        groups[r["component_id"]].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(g) for g in groups.values())

    kept = {r["doc_id"] for r in stage["decontamination"](spark, docs, SF).collect()}
    leaks = {r["doc_id"] for r in decontam.contaminated(docs, table(spark, SF, "benchmark")).collect()}
    assert leaks and kept == {r["doc_id"] for r in docs.collect()} - leaks


def test_run_packs_what_is_left(spark):
    docs = table(spark, SF, "documents")
    for _, f in cp.STAGES[:-1]:
        docs = f(spark, docs, SF)
        assert docs.columns == table(spark, SF, "documents").columns
    rows = cp.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
    per_doc = defaultdict(int)
    for r in rows:
        per_doc[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert all(total == n for (_, n), total in per_doc.items())


def test_the_language_stage_drops_languages_that_were_not_learned(spark):
    other = {-1: "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
             -2: "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza.",
             -3: "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
             -4: "Все люди рождаются свободными и равными в своем достоинстве и правах."}
    docs = table(spark, SF, "documents")
    rows = spark.createDataFrame([(k, t, None, "s", len(t)) for k, t in other.items()], docs.schema)
    kept = {r["doc_id"] for r in cp.language_stage(spark, docs.unionAll(rows), SF).collect()}
    assert kept == {r["doc_id"] for r in cp.language_stage(spark, docs, SF).collect()}
    assert len(kept) >= docs.count() - 2


def test_odd_rows_and_clashing_columns_go_through_all_stages(spark):
    odd = docs_frame(spark, [*odd_rows(), (None, "some words of a text without an id that is a little longer")])
    docs = table(spark, SF, "documents").unionByName(odd, allowMissingColumns=True)
    clean = {r["doc_id"] for r in cp.run(spark, SF).collect()}
    for _, f in cp.STAGES[:-1]:
        before = docs.columns
        docs = written(f(spark, docs, SF), "odd")
        assert docs.columns == before
    rows = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert clean - {r["doc_id"] for r in rows} <= {i for i, _ in odd_rows()}  # a row of the same id may stand for it


def test_empty_table_goes_through_all_stages(spark):
    docs = table(spark, SF, "documents").where("false")
    for _, f in cp.STAGES:
        docs = f(spark, docs, SF)
    assert docs.collect() == []
