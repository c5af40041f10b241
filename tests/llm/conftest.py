import pytest

#: Columns that the operators use themselves; tables may have them too.
CLASHING = "key string, node int, digest string, size int, tokens string, page string, findings string, score string, start int, label string, word int, __in string, __word int, __slot int, __sha string, __mark string, __hot string, c0 string, mark string, DOC_ID string, Text string"


@pytest.fixture
def table(spark):
    """A table (doc_id, text) with further columns whose names clash with inner ones."""

    def build(rows, schema="doc_id bigint, text string", extra=True):
        names = [c.split()[0] for c in CLASHING.split(", ")]
        if not extra:
            return spark.createDataFrame(rows, schema)
        return spark.createDataFrame([(*r, *([None] * len(names))) for r in rows], f"{schema}, {CLASHING}")

    return build


@pytest.fixture
def hard(table):
    """Nulls, empty, blank and long texts, repeated rows, repeated and missing ids."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    return table(
        [
            (1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (5, "one two three four five six"), (5, "another text with this id, 7"),
            (None, "no id at all here"), (None, None), (6, long), (7, long), (8, "é漢字🙂 ñ ß"), (9, "one two  three\nfour five six"),
        ]
    )


@pytest.fixture
def nothing(table):
    return table([])
