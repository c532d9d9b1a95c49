"""Every stage of the pipeline on hard rows, clashing columns and empty tables; tables that go when they are done with."""

from __future__ import annotations

from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from foliolens.llm import common, components, simhash_vp
from foliolens.llm.common import table

SF = "/root/testdata/sf0.001"
EXTRA = ["_statistics", "_score", "_lang", "lang_pred", "score", "rows", "row", "id", "component_id", "fp", "i", "t", "part", "n", "ids"]
HARD = [(-1, None), (-2, ""), (-3, "the same text of a few words " * 5), (-3, "the same text of a few words " * 5), (-4, "the same text of a few words " * 5), (None, "no id at all"), (-5, "word and more words " * 15_000), (-6, "password=abcdef123456 in a text")]


def frame(spark, empty: bool):
    docs = table(spark, SF, "documents")
    hard = spark.createDataFrame([(i, t, "de", "web", len(t or "")) for i, t in HARD], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.unionByName(hard.select(*[F.col(f.name).cast(f.dataType) for f in docs.schema.fields]))
    return (docs.where("false") if empty else docs).withColumns({c: F.lit(f"mine {c}") for c in EXTRA})


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
@pytest.mark.parametrize("empty", [False, True])
def test_stages_keep_columns_and_values(spark, name, stage, empty):
    docs = frame(spark, empty)
    got = stage(spark, docs, SF)
    assert got.schema.names == docs.schema.names
    rows = got.collect()
    assert bool(rows) != empty
    assert all(r[c] == f"mine {c}" for r in rows for c in EXTRA)
    ids = [r["doc_id"] for r in rows]
    if not empty:
        assert {"language": -1 not in ids and -2 not in ids, "quality": True, "near_duplicates": -4 in ids and ids.count(-3) == 0 and None in ids, "secrets": len(ids) == docs.count()}[name]
    if name == "secrets" and not empty:
        assert next(r for r in rows if r["doc_id"] == -6)["text"] == "[SECRET] in a text"


@pytest.mark.parametrize("empty", [False, True])
def test_the_last_stage_packs_every_row(spark, empty):
    docs = frame(spark, empty)
    got = corpus_pipeline.pack(spark, docs, SF)
    assert got.where("start = 0").count() == docs.count()


def test_of_rows_that_repeat_an_id_the_smallest_stays(spark):
    rows = [(7, "zebra text of several words", "a"), (7, "another text of several words", "b"), (7, "another text of several words", "a")]
    for order in (rows, rows[::-1]):
        got = simhash_vp.one_of_each_group(spark.createDataFrame(order, "doc_id bigint, text string, x string")).collect()
        assert [tuple(r) for r in got] == [rows[2]]


def test_tables_go_when_they_are_done_with(spark):
    since, folder = common.mark(spark), Path(common.shared_dir(spark))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    found = components.connected_components(edges)
    assert found.count() == 40
    left = common._tables(spark)[since:]
    assert len(left) == 1 and all(Path(p).exists() for p in left)
    common.clear(spark, since)
    assert not any(Path(p).exists() for p in left) and folder.exists() and common.mark(spark) == since


def test_no_folder_off_a_local_master_is_an_error(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: d)})()

    monkeypatch.setattr(common, "ship", lambda spark: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_a_name_that_is_free(spark):
    assert common.free_name(spark.createDataFrame([(1, 2)], "a int, A_ int"), "a") == "a__"
