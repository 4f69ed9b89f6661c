"""The pipeline, and the queries against their SQL."""

import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from caseframe.llm.queries import ORACLES, QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are missing")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for file in os.listdir(SF):
        connection.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    answer = connection.execute(ORACLES[name])
    frame = QUERIES[name](spark, SF).select([c[0] for c in answer.description])
    assert Counter(map(tuple, frame.collect())) == Counter(answer.fetchall())


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.keep(stage(spark, docs, SF), name)
        seen[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        assert name == "pack" or docs.columns == columns
    assert len(seen["language"]) >= 0.99 * len(texts)
    first = {}
    for key in sorted(seen["language"]):
        first.setdefault(brute.SPACES.sub(" ", texts[key]), key)
    assert sorted(seen["exact_duplicates"]) == sorted(first.values())
    groups = brute.near([(k, texts[k]) for k in seen["exact_duplicates"]], corpus_pipeline.PERCENT)
    assert sorted(seen["near_duplicates"]) == sorted(k for k, (_, c) in groups.items() if k == c)
    assert max(Counter(seen["mix"]).values()) <= 3 and set(seen["mix"]) <= set(seen["near_duplicates"])
    assert set(seen["pack"]) == set(seen["mix"])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


SCHEMA = ("doc_id long, text string, lang string, source string, n_chars int, score double, row_number string, "
          "component_id long, copies string")


def rows_for_stages(spark, rows):
    """Rows of (doc_id, text[, lang]) with columns that stages use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", 1, 0.25, "own", 7, "c") for r in rows]
    return corpus_pipeline.keep(spark.createDataFrame(full, SCHEMA), "rows")


STAGES = dict(corpus_pipeline.STAGES)
LONG = " ".join(f"w{k}" for k in range(60))
AWKWARD = [(7, "a text of its own that nothing else in here repeats"), (7, LONG), (3, LONG), (None, LONG), (None, LONG),
           (3, LONG), (None, "one more text"), (None, "one more text"), (8, LONG + " end"), (9, None), (10, ""), (11, " \t"),
           (12, "x" * 20_000), (None, None)]


def pairs(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def test_exact_stage_goes_by_row(spark):
    docs = rows_for_stages(spark, AWKWARD)
    got = STAGES["exact_duplicates"](spark, docs, SF)
    assert got.columns == docs.columns and {(r.score, r.row_number) for r in got.collect()} == {(0.25, "own")}
    assert pairs(got) == sorted([AWKWARD[0], (3, LONG), (None, "one more text"), (8, LONG + " end"), (9, None),
                                 (11, " \t"), (12, "x" * 20_000)], key=str)


def test_near_stage_goes_by_row(spark):
    docs = rows_for_stages(spark, AWKWARD)
    got = STAGES["near_duplicates"](spark, docs, SF)
    assert got.columns == docs.columns
    # Texts without words are near nothing.
    assert pairs(got) == sorted([AWKWARD[0], (3, LONG), (None, "one more text"), (9, None), (10, ""), (11, " \t"),
                                 (12, "x" * 20_000), (None, None)], key=str)


def test_mix_stage_goes_by_row(spark):
    rows = [(k % 5 if k % 3 else None, "w " * (k + 1)) for k in range(60)]
    docs = rows_for_stages(spark, rows)
    got = STAGES["mix"](spark, docs, SF)
    assert got.columns == docs.columns
    # One source takes all of its words once.
    assert pairs(got) == sorted(rows, key=str)


def test_language_stage_overwrites_nothing_and_needs_labels(spark):
    english, german = "the cat and the dog went home to eat and sleep ", "der hund und die katze gehen nach hause und schlafen "
    rows = [(k, (english if k % 2 else german) * 3, "en" if k % 2 else "de") for k in range(60)]
    docs = rows_for_stages(spark, [*rows, (100, None), (101, ""), (102, "123 456"), (7, english), (None, german)])
    got = STAGES["language"](spark, docs, SF)
    assert got.columns == docs.columns and {r.score for r in got.collect()} == {0.25}
    assert pairs(got) == sorted([r[:2] for r in rows] + [(7, english), (None, german)], key=str)
    with pytest.raises(ValueError, match="lang"):
        STAGES["language"](spark, rows_for_stages(spark, [(1, english), (2, german)]), SF)


def test_pack_stage_takes_all_rows(spark):
    got = STAGES["pack"](spark, rows_for_stages(spark, AWKWARD), SF)
    assert got.filter("piece = 0").count() == len(AWKWARD)


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_of_an_empty_table(spark, name):
    assert STAGES[name](spark, rows_for_stages(spark, []), SF).count() == 0
