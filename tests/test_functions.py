import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgloom.functions import text as T
from kgloom.operators.ontology import Ontology, parse_relation


def one(spark, col, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(col).first()[0]


@pytest.mark.parametrize(("x", "y"), [("TechCorp, Inc.", "techcorp inc."), ("  PNMT® (v2)  ", "pnmt v2"), ("€16.0m", "16.0m"), ("Société Générale & Co", "société générale co"), (None, "")])
def test_normalize(spark, x, y):
    assert one(spark, T.normalize_text(F.col("x")), x=x) == y


@pytest.mark.parametrize(("a", "b", "score"), [("Asia", "STIC", 0.5), ("acme corp", "acme corporation", 0.72), ("john smith", "john a. smith", 0.869565), ("red widget", "red widgets", 0.952381), ("tide", "diet", 0.25), ("diet", "tide", 0.5), ("", "x", 0.0)])
def test_similarity(spark, a, b, score):
    assert T.ratio(a, b) == pytest.approx(score, abs=1e-6)
    assert one(spark, T.similarity("a", "b"), a=a, b=b) == pytest.approx(score, abs=1e-6)


@given(st.text("abcde ", min_size=1, max_size=30), st.text("abcde ", min_size=1, max_size=30))
def test_bounds_hold(a, b):
    from collections import Counter

    common = sum((Counter(a) & Counter(b)).values())
    assert T.ratio(a, b) <= 2 * common / (len(a) + len(b)) + 1e-12 <= 2 * min(len(a), len(b)) / (len(a) + len(b)) + 1e-9


def test_bounds_in_spark(spark):
    df = spark.createDataFrame([("aab", "abb"), ("acme corp", "acme corporation")], "a string, b string")
    got = df.select(T.length_bound(F.col("a"), F.col("b")), T.multiset_bound(F.col("a"), F.col("b"))).collect()
    assert [tuple(round(x, 4) for x in r) for r in got] == [(1.0, 0.6667), (0.72, 0.72)]


def test_type_strings(spark):
    t = F.col("t")
    assert one(spark, T.clean_link_type(t), t="p:reportsOperationalKPI") == "reports operational kpi"
    assert one(spark, T.clean_link_type(t), t="employs") == "unknown link type"
    assert one(spark, T.category_from_type(t), t="p:ProductOrService") == "product_or_service"
    assert one(spark, T.category_from_type(t), t="p:OperationalKPI") == "operational_k_p_i"


@pytest.mark.parametrize(("i", "label", "out"), [("comp1", "Acme Corp", "comp1_Acme_Corp"), ("m1", "€10.5M / 2023", "m1_105M__2023"), ("x", "!!!", "x_nolabel")])
def test_composite_id(spark, i, label, out):
    assert one(spark, T.composite_id(F.col("i"), F.col("label")), i=i, label=label) == out


def test_base64_has_no_line_breaks(spark):
    import base64

    texts = ["", "a", "é" * 28, "x" * 57, "y" * 58, "https://example.org/" + "z" * 300]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.base64_line(F.col("t")).alias("b")).collect()
    assert {r.t: r.b for r in rows} == {t: base64.b64encode(t.encode()).decode() for t in texts}


def test_summary(spark):
    for text, out in (("", ""), ("One.", "One."), ("One. Two.", "One. Two."), ("One. Two. Three.", "One. ... Three.")):
        assert one(spark, T.summary(T.sentences(F.col("x"))), x=text) == out
    assert len(one(spark, T.summary(T.sentences(F.col("x"))), x="a" * 300 + ".")) == 200


def test_format_attribute(spark):
    assert one(spark, T.format_attribute("metricName", F.col("x")), x=" v ") == "Metric Name: v"
    assert one(spark, T.format_attribute("metricName", F.col("x")), x="  ") is None
    assert T.display_name("_source_page") == " Source Page"


def test_ontology(tmp_path):
    path = tmp_path / "o.yaml"
    path.write_text("entities:\n- p:Company:\n    description: A firm\n    attributes:\n    - name: string\n- p:Person\nrelations:\n- 'p:employs (Company|Fund -> Person)'\n- 'p:owns (Company → Company)'\n")
    o = Ontology.load(str(path))
    assert o.entity_types() == ["Company", "Person"] and o.attributes_of("p:Company") == ["name"] and o.prefix == "p:"
    assert o.constraints("p:employs") == {"domain": ["Company", "Fund"], "range": ["Person"]} and o.constraints("no") == {"domain": [], "range": []}
    assert json.loads(o.to_json())["relations"]["owns"] == {"domain": ["Company"], "range": ["Company"]}
    assert "- p:Company: A firm\n    name (string)" in o.prompt() and "string" not in o.prompt(False)
    assert parse_relation("bare") == ("bare", ([], []))
    path.write_text("entities: []\nrelationships: []\n")
    with pytest.raises(ValueError, match="not an ontology"):
        Ontology.load(str(path))


def test_alike_is_the_ratio():
    rng = random.Random(4)
    texts = ["", *("".join(rng.choice("abAB c") for _ in range(rng.randint(1, 12))) for _ in range(150))]
    for a in texts:
        for b in rng.sample(texts, 20):
            for least in (0.5, 0.75, 0.8, 1.0):
                assert T.alike(a, b, least) == (T.ratio(a, b) >= least)
