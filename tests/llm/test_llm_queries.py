"""The corpus queries that SQL can express, against it; every one of them on odd and empty tables."""

import __spark_entry__ as entry_points
import pytest
from oracle import compare, connect, plan
from pyspark.sql import functions as F

from newsloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
    "benchmark": "item_id long, text string",
}
LONG = "word " * 30_000 + "x" * 50_000
ODD = {
    "documents": [
        (None, None, None, None, None), (1, None, "en", "a", None), (2, "", "en", None, 0), (3, "one", None, "a", 3),
        (3, "one", None, "a", 3), (4, "é   \U0001f600\x01</s>", "de", "a", 9), (5, LONG, "en", "a", len(LONG)),
        (6, LONG, "en", "b", len(LONG)), (None, "one", "en", "a", 3),
    ],
    "labels": [(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (5, None, None), (6, 1, 0), (99, 1, 1)],
    "embeddings": [
        (None, [1.0], 0), (0, [0.5, 0.25], 0), (50, None, 0), (100, [], 0), (1, [1.0, None], 0), (2, [float("nan")], 0),
        (3, [1.0, 1.0, 1.0], None), (4, [0.5, 0.25], 1), (4, [0.5, 0.25], 1), (5, [3e38, -3e38], 1),
        (6, [0.5] * 64, 0), (6, [0.5] * 64, 0), (None, [0.25] * 64, 0), (7, [3e38] * 64, 0), (8, [-0.1] * 63 + [None], 0),
    ],
    "benchmark": [(None, None), (1, ""), (2, "one word"), (2, LONG)],
    "conversations": [
        (None, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "tool", "[/ROLE]\\["),
        (2, 0, "assistant", None), (3, 0, "user", LONG), (3, 1, "assistant", "\\" * 3 + "<s>" * 500),
    ],
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    difference, _ = compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name])
    assert not difference, difference


def test_all_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry_points.queries())


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Tables of odd rows, with a further column, and tables without rows."""
    made = {}
    for kind in ("odd", "empty"):
        made[kind] = str(tmp_path_factory.mktemp(kind))
        for name, schema in TABLES.items():
            rows = spark.createDataFrame(ODD[name] if kind == "odd" else [], schema)
            if kind == "odd":
                for extra in ("score", "shard", "node", "base", "key", "_group"):
                    rows = rows.withColumn(extra, F.lit("clash"))
            rows.write.parquet(f"{made[kind]}/{name}.parquet")
    return made


@pytest.mark.parametrize("name", sorted([*QUERIES, "pipeline"]))
def test_empty_tables(spark, folders, name):
    rows = entry_points.queries()[name](spark, folders["empty"]).collect()
    assert len(rows) == (1 if name == "op4_chat_format" else 0)


@pytest.mark.parametrize("name", sorted([*QUERIES, "pipeline"]))
def test_odd_rows(spark, folders, name):
    rows = entry_points.queries()[name](spark, folders["odd"]).collect()
    if name in ("op1_sentencepiece", "op2_sharding", "op6_toxicity", "op7_quality_rules", "op9_jaccard_join", "op10_secret_scan",
                "op12_simhash_components", "op13_importance_resample"):
        assert len(rows) == len(ODD["documents"])


@pytest.mark.parametrize("name", ["op4_chat_format", "op10_secret_scan"])
def test_native_plans_have_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not any(word in text for word in ("Python", "Pandas", "Arrow"))
