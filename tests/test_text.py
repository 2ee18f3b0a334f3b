import pytest

from pyspark.sql import functions as F

from splitlift.functions.text import clean_text, fold_text, fold_text_strict, is_native, zero_pad
from splitlift.sources.fixtures import table

from conftest import SF_SMALL

EDGE = [None, "", "   ", "&amp;", "a&nbsp;b", "São  Paulo", "Straße", "--abc--", "\tTab\t x ",
        "  rio de   janeiro ", "ÉCOLE_du-Nord!", "x&y", "Ünïcödé ☃ ok", "a_b", "&lt;b&gt;"]


def _spark_values(spark, values, strict):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", clean_text("v", strict=strict).alias("c")).orderBy("i").collect()
    return [r.c for r in rows]


def test_fold_rules():
    assert fold_text(None) is None and fold_text("") is None
    assert fold_text("   ") == ""
    assert fold_text("São  Paulo") == "SAO PAULO"
    assert fold_text("Straße") == "STRAE"          # ß has no ASCII decomposition
    assert fold_text("--abc--") == "--ABC--"       # punctuation kept
    assert fold_text("&amp;") == "&"


def test_strict_rules():
    assert fold_text_strict(None) is None and fold_text_strict("") == ""
    assert fold_text_strict("Straße") == "STRASSE"
    assert fold_text_strict("--abc--") == "ABC"
    assert fold_text_strict("a_b") == "AB"
    assert fold_text_strict("\tTab\t x ") == "TAB X"


@pytest.mark.parametrize("strict", [False, True])
def test_two_paths_equal_python(spark, strict):
    py = fold_text_strict if strict else fold_text
    assert _spark_values(spark, EDGE, strict) == [py(v) for v in EDGE]


@pytest.mark.parametrize("strict", [False, True])
def test_documents_equal_python(spark, strict):
    py = fold_text_strict if strict else fold_text
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    got = docs.select("doc_id", "text", clean_text("text", strict=strict).alias("c")).collect()
    assert len(got) >= 200
    for r in got:
        assert r.c == py(r.text), r.doc_id


@pytest.mark.parametrize("strict", [False, True])
def test_accented_names_stay_in_the_jvm(spark, strict):
    names = ["São Paulo", "José &amp; Müller", "Ça-Và\tD'Été", "ÑANDÚ", "Łódź", "plain"]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    got = df.select("v", is_native(F.col("v"), strict).alias("n"), clean_text("v", strict).alias("c")).collect()
    py = fold_text_strict if strict else fold_text
    assert all(r.n for r in got) and all(r.c == py(r.v) for r in got)
    plan = df.select(clean_text("v"))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan


@pytest.mark.parametrize("strict", [False, True])
def test_every_character_equals_python(spark, strict):
    py = fold_text_strict if strict else fold_text
    values = [f"x{chr(c)}y{chr(c)}" for c in range(1, 0x600)]
    assert _spark_values(spark, values, strict) == [py(v) for v in values]


def test_zero_pad(spark):
    vals = ["12", "-12", "+", "123456789", "", None, "1234567", "abc"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = [r.p for r in df.select("i", zero_pad("v", 7).alias("p")).orderBy("i").collect()]
    assert got == [None if not v else v.zfill(7) for v in vals]
