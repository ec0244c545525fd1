import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"value", "n", "share"}


def test_core_needs_no_training_part():
    import pathlib

    import millrace

    root = pathlib.Path(millrace.__file__).parent
    assert not [f for f in root.rglob("*.py") if f.parent.name != "llm" and "millrace.llm" in f.read_text()]
