import pytest
from hypothesis import given
from hypothesis import strategies as st

from latticework.functions import patterns as p
from latticework.functions.descriptors import SignatureError, signature_references
from latticework.functions.identity import identity_hash, identity_hash_text
from latticework.operators.rules.modules import DiagramError, parse_diagram


@pytest.mark.parametrize("glob, text, fits", [
    ("a.*", "a.b", True), ("a.*", "a.b.c", False), ("a.**", "a.b.c", True), ("a.?", "a.b", True), ("a.?", "a..", False), (r"a\*", "a*", True), (r"a\*", "ab", False), ("a.b", "aXb", False), ("**.X$*", "p.q.X$1", True),
])
def test_glob(spark, glob, text, fits):
    pattern = p.glob(glob)
    assert pattern.matches_text(text) is fits
    assert spark.createDataFrame([(text,)], "x string").select(pattern.matches(__import__("pyspark").sql.functions.col("x"))).first()[0] is fits


@pytest.mark.parametrize("bad", ["(a)", "a|b", r"(a)\1", "a*b*", "a{2000}", "[a", "a\\", "x" * 600, ""])
def test_unsafe_expressions_are_refused(bad):
    with pytest.raises(p.PatternError):
        p.regex(bad)


@given(st.text(st.characters(codec="utf-8"), max_size=40))
def test_exact_matches_itself_only(text):
    assert p.exact(text).matches_text(text)
    assert not p.exact(text).matches_text(text + "x")


def test_long_candidates_are_errors():
    with pytest.raises(p.PatternError):
        p.exact("a").matches_text("a" * 5000)


def test_identity_is_framed(spark):
    from pyspark.sql import functions as F

    assert identity_hash_text("ab", "c") != identity_hash_text("a", "bc")
    row = spark.createDataFrame([("é", "x")], "a string, b string").select(identity_hash(F.col("a"), F.col("b"))).first()
    assert row[0] == identity_hash_text("é", "x")


def test_signatures():
    assert signature_references("<T:Ljava/lang/Object;:La/B<TT;>;>(TT;[La/C<*>.D;)V^La/E;", "method") == (["a.B", "a.C$D", "a.E", "java.lang.Object"], ["T"])
    for bad in ("", "L", "La/B", "La/B<", "[" * 400 + "I", "II"):
        with pytest.raises(SignatureError):
            signature_references(bad, "field")


def test_ignore_rules_and_slices(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a/b.class", "app.x.api.v1"), ("a/keep.class", "app.x"), ("c", "other")], "e string, k string")
    found = rows.select(p.last_rule_wins(F.col("e"), p.parse_ignore("a/**\n!**/keep.*\n")), p.slice_capture("app.{slice}.api..", F.col("k"))).collect()
    assert [tuple(r) for r in found] == [(True, "x"), (False, None), (False, None)]


def test_diagram():
    parts, arrows = parse_diagram("@startuml\n[A] as a <<x..>>\n[B]\na --> [B]\n[B] <- a\n@enduml")
    assert parts == [("A", "x.."), ("B", None)] and arrows == [("A", "B")]
    for bad in ("[A]", "@startuml\n!include x\n@enduml", "@startuml\nx --> y\n@enduml"):
        with pytest.raises(DiagramError):
            parse_diagram(bad)
