"""Verdicts of the quality rules by distance: between the chi-squared limit and far outliers, and in small groups."""

import random

import pytest

from fleetpulse.llm import quality

DDL = "doc_id long, text string, lang string, source string"


def document(rng, marks=0):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(120)]
    return " ".join(w + ("#" if i < marks else "") for i, w in enumerate(words))


def test_limit_is_a_chi_squared_quantile():
    assert [quality.chi2_quantile(p) for p in (0.5, 0.95, 0.999)] == pytest.approx([3.3567, 9.4877, 18.4668], abs=1e-4)
    assert quality.LIMIT == quality.chi2_quantile(0.9999)


def test_moderate_outliers_are_rejected(spark):
    rng = random.Random(4)
    rows = [(i, document(rng, 100 if i < 60 else 0), "en", "s") for i in range(600)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, DDL)).collect()}
    assert all(quality.LIMIT < got[i].distance < 90 for i in range(60))
    assert not any(got[i].kept for i in range(60)) and all(got[i].kept for i in range(60, 600))


def test_small_groups_are_judged_by_their_language_or_all(spark):
    """Sources of 6 documents in one language, and languages of 6 documents: one document of each stands out."""
    rng = random.Random(5)
    rows = []
    for k in range(20):
        for i in range(6):
            lang, source = (f"l{k}", "s") if k < 8 else ("en", f"s{k}")
            rows.append((len(rows), document(rng, 100 if i == 5 else 0), None if k == 0 else lang, source))
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, DDL)).collect()}
    assert len(got) == len(rows) and all(got[i].distance is not None for i in got)
    assert {i for i in got if not got[i].kept} == {i for i in got if i % 6 == 5}


def test_few_documents_of_one_language(spark):
    rng = random.Random(6)
    rows = [(i, document(rng, 100 if i == 7 else 0), "en", f"s{i % 3}") for i in range(8)]
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, DDL)).collect()}
    assert [i for i in got if not got[i]] == [7]


def test_kept_rows_are_whole_and_no_text_is_sorted(spark):
    """A column named like a statistic, nulls and copies stay as they are; rows are not sorted for their verdicts."""
    rng = random.Random(7)
    rows = [(i, document(rng, 100 if i % 40 == 0 else 0), None if i % 5 == 0 else "en", f"s{i % 2}", None if i % 3 else -i) for i in range(400)]
    rows += [rows[1], rows[1], rows[40], (1000, None, "en", "s1", 5), (None, rows[2][1], None, None, None)]
    docs = spark.createDataFrame(rows, DDL + ", n_words long")
    verdicts = quality.quality_rules(docs.drop("n_words").distinct()).collect()
    kept = {(r.doc_id, r.text, r.lang, r.source) for r in verdicts if r.kept}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        good = quality.keep_good(docs)
        plan = good._jdf.queryExecution().executedPlan().toString()
        got = good.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert good.columns == docs.columns and 0 < len(got) < len(rows)
    assert sorted(map(str, map(tuple, got))) == sorted(str(r) for r in rows if r[:4] in kept)
    top = [x for x in plan.splitlines() if "Join" in x][0]
    assert "ShuffledHashJoin" in top or "BroadcastHashJoin" in top
