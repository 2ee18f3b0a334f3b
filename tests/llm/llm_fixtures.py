"""Fixtures of the operator tests (the session comes from the parent folder)."""
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (id, text) pairs, with clashing extra columns."""
    def build(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], SCHEMA)
        if extra:  # names that operators use inside
            for name in ("id", "dk", "key", "score", "z", "block", "digest", "cls", "kind", "start", "page", "own_key",
                         "drop_key", "drop_key_", "heavy", "kept", "nth", "uid", "keep", "t", "n_words", "runs", "spans",
                         "__own", "__dk", "__digest", "__nth"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df
    return build
