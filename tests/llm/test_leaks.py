import os
import random

import pytest
from helpers import SF

from sedimenta.llm import leaks as K
from sedimenta.llm import tokens as T

WORDS = [f"w{i}" for i in range(60)]


def tables(spark, seed=3):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(3, 40)))) for i in range(30)] + [(40, None), (41, "")]
    docs = []
    for i in range(200):
        parts = [" ".join(rng.choices(WORDS + ["zz", "yy"], k=rng.randint(0, 30)))]
        if rng.random() < 0.5:
            w = rng.choice(items[:30])[1].split()
            a = rng.randrange(len(w))
            parts.append(" ".join(w[a : a + rng.randint(1, 30)]))
        docs.append((i, ". ".join(parts)))
    docs += [(300, None), (301, ""), (302, docs[5][1])]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def brute(docs, items, least):
    grams = {}
    for i, t in items:
        w = K.words(t or "")
        for a in range(len(w) - least + 1):
            grams.setdefault(tuple(w[a : a + least]), set()).add(i)
    return {(d, i) for d, t in docs for w in [K.words(t or "")] for a in range(len(w) - least + 1) for i in grams.get(tuple(w[a : a + least]), ())}


@pytest.mark.parametrize("words,chars,phrases", [(400_000, 32_000_000, 200_000), (50, 32_000_000, 7), (400_000, 300, 64)])
def test_any_bounds_give_all_leaks(spark, monkeypatch, words, chars, phrases):
    for name, n in (("INDEX_WORDS", words), ("INDEX_CHARS", chars), ("PHRASES", phrases)):
        monkeypatch.setattr(K, name, n)
    docs, items, d, i = tables(spark)
    want = brute(docs, items, 5)
    assert {(r.key, r.item_id) for r in K.leaked_spans(d, i, "doc_id", "text", least=5).collect()} == want and len(want) > 40


def test_a_stored_index_serves_later_items(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "INDEX_WORDS", 900)
    docs, items, d, i = tables(spark)
    index = K.ShardIndexes.build(d, "doc_id", "text", f"file://{tmp_path}/shards")
    assert spark.read.parquet(f"file://{tmp_path}/shards").count() > 3
    again = K.ShardIndexes(spark, f"file://{tmp_path}/shards")
    spans = {(r.key, r.item_id, r.first_word, r.end_word) for r in again.search(i, least=5).collect()}
    assert spans == {(r.key, r.item_id, r.first_word, r.end_word) for r in K.leaked_spans(d, i, "doc_id", "text", least=5).collect()}
    _, other, _, i2 = tables(spark, seed=9)
    assert {(r.key, r.item_id) for r in index.search(i2, least=4).collect()} == brute(docs, other, 4)
    assert index.search(i.limit(0)).count() == 0
    empty = K.ShardIndexes.build(d.limit(0), "doc_id", "text", f"file://{tmp_path}/none")
    assert empty.search(i).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_stored_index_finds_what_the_scan_finds(spark):
    assert sorted(map(tuple, K.p8_indexed(spark, SF).collect())) == sorted(map(tuple, K.p8_found(spark, SF).collect()))


def test_items_pass_through_a_file(tmp_path):
    items = K.Items.of([(7, "one two three two"), (8, "short"), (9, "two three four")], 3)
    (tmp_path / "x").write_bytes(items.save())
    back = K.Items.open(str(tmp_path / "x"))
    assert back.vocabulary == items.vocabulary and back.ids.tolist() == [7, 9] and back.symbols.tolist() == items.symbols.tolist()
    assert [(p.tolist(), i.tolist()) for p, i in back.blocks()] == [([[2, 3, 4], [3, 4, 3], [3, 4, 5]], [0, 0, 1])]


def test_at_most_so_many_words_come_to_the_driver(spark):
    df = spark.createDataFrame([(f"w{i}", 1 + 100_000 // (i + 1)) for i in range(5000)], "word string, n long")
    for most in (0, 1, 10, 100, 4000, 9000):
        got = T.frequent_words(df, most)
        assert len(got) <= most and len(set(got)) == len(got)
        assert most < 100 or len(got) >= 0.8 * min(most, 2000)
        if got:
            assert max(int(w[1:]) for w in got) < len(got) * 1.2 + 50 or most >= 4000
