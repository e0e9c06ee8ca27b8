import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns whose names clash."""
    def build(rows, schema=SCHEMA):
        df = spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else "a", 0) for r in rows], schema)
        return (df.selectExpr("*", "'x' AS id", "1 AS n", "'y' AS size", "2 AS score", "3 AS component_id", "4 AS h", "5 AS bucket", "6 AS start",
                              "7 AS key", "8 AS words", "9 AS spans", "10 AS row", "11 AS line_no", "12 AS root", "13 AS at", "14 AS item_id"))
    return build


#: Null, empty, blank and repeated rows, ties, a null id.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, "one two three"), (5, "one two three"), (None, "a null id and its text goes on for a while here"), (6, "x " * 30_000)]
