"""Each stage of the corpus pipeline on odd rows and on none."""

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
#: The columns of documents and some whose names clash with the stages' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, component_id long, words long"
ROWS = [
    (1, "one line of plain words here\nand another line of words"), (1, "one line of plain words here\nand another line of words"), (2, None), (3, ""), (4, "   \n\t "),
    (5, "x"), (6, "yés " * 30_000), (7, "ONE line, of plain words here!"), (None, "no id at all here"),
]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_takes_odd_rows_and_none(spark, name, stage):
    odd = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "z", 1, 2) for i, t in ROWS], SCHEMA)
    got = stage(spark, odd, SF)
    ids = [r["doc_id"] for r in got.collect()]
    assert set(ids) <= {i for i, _ in ROWS}
    if name != "packing":
        assert got.columns == odd.columns and len(ids) <= len(ROWS)
    if name in ("line_dedup", "packing"):
        assert set(ids) == {i for i, _ in ROWS}
    if name == "simhash_dedup":
        # Texts without words have the fingerprint zero and are one group; of repeated ids one row stays, and the row without an id.
        assert ids.count(1) == 1 and None in ids and {2, 3, 4} & set(ids) == {2} and {5, 6} <= set(ids)
    none = stage(spark, odd.limit(0), SF)
    assert none.count() == 0 and (name == "packing" or none.columns == odd.columns)
