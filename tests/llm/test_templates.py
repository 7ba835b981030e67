import time
import pytest
from pyspark.sql import functions as F

from llm.oracle import rows, spark_rows
from strideline.llm import catalog, templates


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    found = spark_rows(catalog.op9_lines(spark, sf))
    assert found == rows(catalog.OP9_SQL, sf)
    assert any(r[1] for r in found)


PASSAGE = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))


def test_drops_what_recurs(spark):
    data = [
        (1, f"first own line here now\n{PASSAGE}"),
        (2, f"{PASSAGE}\nsecond text has its own words"),
        (3, f"third\n{PASSAGE}\nthird"),
        (4, "user alice logged in at 12:30 from home today once again\na"),
        (5, "user bob logged in at 9:15 from home today once again\nb"),
        (6, "user carol logged in at 17:01 from home today once again\nc"),
        (7, "short line\nx"),
        (8, "short line\ny"),
        (9, "short line\nz"),
        (10, "only two texts have this line\np"),
        (11, "only two texts have this line\nq"),
        (12, "copied text counts once for its lines"),
        (13, "copied text counts once for its lines"),
        (14, "copied text counts once for its lines"),
        (15, None),
        (16, ""),
        (None, f"late\n{PASSAGE}"),
        (3, f"third\n{PASSAGE}\nthird"),
        (17, "\n".join(f"line {k} of a long text with many lines " + "w" * k for k in range(2000))),
    ]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("n_lines", F.lit("x")).withColumn("body", F.lit(0))
    out = templates.line_dedup(docs, leading=1)
    assert out.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    expected = dict(data) | {2: "second text has its own words", 3: "third\nthird", 5: "b", 6: "c", None: "late"}
    assert [x for x in found if x[0] != 17] == sorted(((k, expected[k]) for k, _ in data if k != 17), key=str)
    assert next(t for k, t in found if k == 17) == data[-1][1]
    assert templates.line_dedup(docs.limit(0)).count() == 0


def test_long_lines_recur_from_two_texts_on(spark):
    long = " ".join(f"tok{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(50))
    short = " ".join(long.split(" ")[1:])
    data = [(1, f"{long}\na"), (2, f"b\n{long}"), (3, f"{short}\nc"), (4, f"d\n{short}"), (5, "e"), (5, "e")]
    found = {r["doc_id"]: r["text"] for r in templates.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert found == dict(data) | {2: "b"}


def test_columns_with_the_operators_own_names(spark):
    names = ["_drop", "_id", "_body", "c0", "c1", "at", "body", "leaf", "size", "line", "template", "texts", "a.b"]
    data = [(k, f"own {k}\n{PASSAGE}") for k in range(4)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({n: F.lit(k) for k, n in enumerate(names)})
    out = templates.line_dedup(docs)
    assert out.columns == docs.columns
    rows_ = sorted(out.collect())
    assert [r["text"] for r in rows_] == [data[0][1], "own 1", "own 2", "own 3"] and all(list(r)[2:] == list(range(len(names))) for r in rows_)
    counted = templates.line_dedup(docs.withColumn("n_lines", F.lit("mine")), counts=True)
    assert counted.columns == [*docs.columns, "n_lines", "dropped_lines"] and {r["dropped_lines"] for r in counted.collect()} == {0, 1}


def test_time_of_a_text_with_many_lines_grows_with_their_number(spark):
    """Lines that stay are taken from one split of the text; a split for each took time with the square of their number."""
    shared = [f"this shared line number x{chr(97 + k)} recurs here" for k in range(3)]
    long = "\n".join([*shared, *(f"w{k}" for k in range(40_000))])
    docs = spark.createDataFrame([(0, "\n".join(shared)), (1, "\n".join(["a", *shared])), (2, long)], "doc_id long, text string")
    began = time.monotonic()
    rows = {r["doc_id"]: r["text"] for r in templates.line_dedup(docs).collect()}
    assert time.monotonic() - began < 60
    assert rows[0] == "\n".join(shared) and rows[1] == "a" and rows[2] == "\n".join(f"w{k}" for k in range(40_000))
