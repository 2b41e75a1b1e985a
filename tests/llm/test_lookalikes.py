import itertools

import pytest
from pyspark.sql import functions as F

from sedimenta.llm import lookalikes as A


@pytest.mark.parametrize("a,b", [("ᎪᏢᏢ", "APP"), ("hօme", "home"), ("cɑt", "cat"), ("Ⅳ ⅹ", "IV x"), ("раураl", "paypal"), ("ꓮꓐꓚ", "ABC"), ("ΑΒΕ", "ABE"), ("it’s", "itʼs"), ("ratio 3∶4", "ratio 3:4"), ("ｆｕｌｌ", "full")])
def test_the_same_to_the_eye(a, b):
    assert A.canonical(a) == A.canonical(b) and A.canonical(A.canonical(a)) == A.canonical(a)


@pytest.mark.parametrize("text", ["Москва и Тверь", "Հայաստան", "Ελλάδα", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "x² ½ ™ ①", "a-b – c"])
def test_words_of_a_script_stay(text):
    assert A.canonical(text) == text


def test_scripts_don_t_flow_into_each_other():
    letters = [A.GREEK, A.CYRILLIC, A.ARMENIAN, A.CHEROKEE, A.LISU]
    assert all(len(set(x)) == len(x) and all(len(c) == 1 for c in x) for x in letters)
    assert not any(set(x) & set(y) for x, y in itertools.combinations(letters, 2))


def test_classes_pairs_and_membership(spark):
    texts = ["paypal"] * 40 + ["раураl"] * 30 + ["paypa​l"] + ["other"] * 50 + ["", None, "ＡＢ", "AB"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("form", F.lit(1)).withColumn("key", F.lit("k"))
    got = A.lookalike_classes(df, "doc_id", "text").toPandas()
    assert len(got) == 73 and got.groupby("representative").n_rows.agg(["first", "size"]).values.tolist() == [[40, 40], [30, 30], [1, 1], [1, 1], [1, 1]]
    assert sorted(set(got.n_strings)) == [2, 3]
    classes = {(r.representative_a, r.representative_b, r.rows_a, r.rows_b) for r in A.class_pairs(A.lookalike_classes(df, "doc_id", "text")).collect()}
    assert classes == {(0, 40, 40, 30), (0, 70, 40, 1), (40, 70, 30, 1), (123, 124, 1, 1)}
    pairs = [(r.doc_id_a, r.doc_id_b) for r in A.lookalike_pairs(df, "doc_id", "text").collect()]
    want = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if texts[i] and texts[j] and texts[i] != texts[j] and A.canonical(texts[i]) == A.canonical(texts[j])]
    assert sorted(pairs) == want
    assert A.lookalike_classes(df.limit(0), "doc_id", "text").count() == A.lookalike_pairs(df.limit(0), "doc_id", "text").count() == 0
