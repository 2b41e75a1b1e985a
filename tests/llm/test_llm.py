import os
import random
import re
import string
import unicodedata

import numpy as np
import pandas as pd
import pytest
from helpers import SF, rows, sql_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedimenta.llm import handwritten as H
from sedimenta.llm import leaks as K
from sedimenta.llm import lookalikes as A
from sedimenta.llm import markup as M
from sedimenta.llm import markup_pages, pii_train, registry
from sedimenta.llm import neighbours as N
from sedimenta.llm import pieces as C
from sedimenta.llm import pii as P
from sedimenta.llm import tokens as T

DATA = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
VOCABULARY = pytest.mark.skipif(not os.path.isdir(T.VOCABULARIES), reason="no vocabularies")
TEXTS = [None, "", "a", "a", "x" * 200_000, "\n\n\n", "é\u0301 \u200b \ufeff", "\x00\x01", "👩\u200d💻" * 50]


@pytest.fixture
def texts(spark):
    """Nulls, empty, equal and very long texts, beside columns whose names operators use themselves."""
    rows_ = [(i, t, "k", "t", [1.0], "own", 5) for i, t in enumerate(TEXTS)] + [(99, None, None, None, None, None, None)]
    return spark.createDataFrame(rows_, "doc_id long, body string, key string, text string, vec array<float>, one string, n int")


@DATA
@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_equals_its_sql(spark, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == sql_rows(registry.oracles()[name])


@DATA
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_runs_and_gives_each_row_once(spark, name):
    df = registry.queries()[name](spark, SF).toPandas()
    if name.endswith("_found"):
        assert len(df) and not df.duplicated().any()


class TestPieces:
    @settings(max_examples=150, deadline=None)
    @given(st.text(alphabet=st.sampled_from(list("ab .\n。é👩\r")), max_size=600), st.integers(8, 90), st.integers(0, 30))
    def test_round_trip_limits_and_overlaps(self, text, limit, overlap):
        overlap = min(overlap, limit // 2)
        got = C.split(text, limit, overlap)
        raw = text.encode()
        if not raw:
            assert got == []
            return
        assert got[0][0] == 0 and got[-1][1] == len(raw)
        whole, at = b"", 0
        for a, b, piece in got:
            assert piece.encode() == raw[a:b] and 0 < b - a <= limit
            assert a <= at < b and at - a <= overlap
            whole += raw[at:b]
            at = b
        assert whole == raw

    def test_doubling_equals_walking(self):
        rng = random.Random(2)
        for _ in range(40):
            n = rng.randint(2, 300)
            nxt = np.array([rng.randint(i + 1, min(n - 1, i + 7)) if i < n - 1 else i for i in range(n)])
            walk, i = [], 0
            while i < n - 1:
                walk.append(i)
                i = nxt[i]
            assert C.starts(nxt).tolist() == walk

    def test_natural_boundaries_come_first(self):
        text = "First paragraph of words.\n\nSecond one is here.\nThird line goes on and on."
        assert [p for _, _, p in C.split(text, 40, 0)][0] == "First paragraph of words.\n\n"

    @pytest.mark.parametrize("line", [80, 250, 900])
    @pytest.mark.parametrize("letters", ["word", "größ", "漢字", "👩👩"])
    def test_overlap_has_a_lower_bound(self, line, letters):
        # a blank line behind a long line: the newline before it is no start for the next piece
        text = ((f"{letters} " * line)[:line].strip() + ".\n\n") * 60
        got = C.split(text, 4000, 200)
        shared = [b - c for (_, b, _), (c, _, _) in zip(got, got[1:], strict=False)]
        assert shared and all(100 <= n <= 200 for n in shared)
        solid = C.split("é" * 9000, 4000, 200)
        assert all(b - c in range(197, 201) for (_, b, _), (c, _, _) in zip(solid, solid[1:], strict=False))

    def test_edge_rows(self, spark, texts):
        got = C.split_oversized(texts, "doc_id", "body", 4000).groupBy("key").count().collect()
        assert {r.key: r["count"] > 40 for r in got} == {4: True}
        assert C.split_oversized(texts.limit(0), "doc_id", "body", 4000).count() == 0


@VOCABULARY
class TestTokens:
    def reference(self):
        import base64

        import tiktoken

        with open(f"{T.VOCABULARIES}/byte_bpe_50k.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return ranks, tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def test_ids_equal_the_library(self, spark, texts):
        _, encode = self.reference()
        got = {r.doc_id: r.ids for r in T.encode_column(texts, "doc_id", "body").collect()}
        assert got == {i: encode(t) if t else [] for i, t in [*enumerate(TEXTS), (99, None)]}
        assert T.encode_column(texts.limit(0), "doc_id", "body").count() == 0

    def test_merging_and_long_words(self):
        ranks, encode = self.reference()
        rng = random.Random(1)
        for _ in range(150):
            w = "".join(rng.choice("abcdeé的ñ") for _ in range(rng.randint(1, 300)))
            assert T.merge_word(w.encode(), ranks) == encode(w)
        assert T._merge_long(b"ab" * 900, ranks) == encode("ab" * 900)

    def test_transducer_is_minimal_and_complete(self, tmp_path):
        rng = random.Random(3)
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))).encode() for _ in range(400)})
        t = T.Transducer.build(words, [[i, i + 1] for i in range(len(words))])
        (tmp_path / "x").write_bytes(t.save())
        t = T.Transducer.open(str(tmp_path / "x"))
        assert t.ranks(words).tolist() == list(range(len(words)))
        assert t.ranks([b"", b"zz", b"abcabcabc", words[0] + b"z"]).tolist() == [-1] * 4
        # states stand for distinct sets of endings
        ends = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
        assert len(t.first) - 1 == len(ends)
        assert T.Transducer.build([], []).ranks([b"a"]).tolist() == [-1]


class TestLeaks:
    def brute(self, docs, items, least):
        grams = {}
        for i, t in items:
            w = K.words(t)
            for k in range(len(w) - least + 1):
                grams.setdefault(tuple(w[k : k + least]), set()).add(i)
        out = set()
        for d, t in docs:
            w = K.words(t) if t else []
            for k in range(len(w) - least + 1):
                out |= {(d, i) for i in grams.get(tuple(w[k : k + least]), ())}
        return out

    def test_index_equals_brute_force(self, spark):
        rng = random.Random(5)
        word = lambda: "".join(rng.choice("ab") for _ in range(2))
        items = [(i, " ".join(word() for _ in range(12))) for i in range(20)] + [(50, None), (51, ""), (52, "too short")]
        docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)]
        docs += [(100 + i, f"start <b>{items[i][1].upper().replace(' ', ', ')}</b> end") for i in range(5)] + [(200, None), (201, "")]
        s = lambda x: [(i, t) for i, t in x if t]
        want = self.brute(docs, s(items), 5)
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
        it = spark.createDataFrame(items, "item_id long, text string")
        got = K.leaked_spans(df, it, "doc_id", "text", least=5).collect()
        assert {(r.key, r.item_id) for r in got} == want
        text = dict(docs)
        for r in got:
            assert K.words(text[r.key][r.start_char : r.end_char]) == K.words(text[r.key])[r.first_word : r.end_word]
        assert K.leaked_spans(df.limit(0), it, "doc_id", "text").count() == 0
        assert K.leaked_spans(df, it.limit(0), "doc_id", "text").count() == 0

    def test_fm_index_counts_and_places(self):
        rng = np.random.default_rng(1)
        text = np.append(rng.integers(1, 5, 700), 0)
        ix = K.FMIndex(text, 5)
        pats = rng.integers(1, 5, (60, 3))
        lo, hi = ix.search(pats)
        for p, a, b in zip(pats, lo, hi, strict=True):
            want = [i for i in range(698) if (text[i : i + 3] == p).all()]
            assert sorted(ix.locate(np.arange(a, b)).tolist()) == want

    def test_spelling_does_not_matter(self):
        a = K.words("One two (three) four_five Straße résumé")
        assert a == K.words("ＯＮＥ t\u200bwo\n**three** <i>four</i> five STRASSE re\u0301sume\u0301") == ["one", "two", "three", "four", "five", "strasse", "résumé"]
        assert K.words("[see this](https://x.example/a) [[Page|here]] {{t|now}} \\textbf{bold}") == ["see", "this", "here", "now", "bold"]


class TestLookalikes:
    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.sampled_from(list("abcеаοé\u0301\u0308\u200b\u00a0\u3000Ａﬁ²½µЖяΩ\u1100\u1161\r\n\t‑-👩💻\u200d")), max_size=30))
    def test_splicing_equals_normalising_the_whole(self, text):
        whole = unicodedata.normalize("NFC", "".join(f if (f := A._form(c)) is not None else c for c in text))
        assert A._splice(text) == whole
        assert A.canonical(A.canonical(text)) == A.canonical(text)

    def test_what_is_equal_and_what_is_not(self):
        same = [("Ａｂ c", "Ab c"), ("ﬁle", "file"), ("e\u0301", "é"), ("Ρlеаѕе", "Please"), ("a\u200bb\u00adc\ufeff", "abc"), ("a\u00a0b\u2009c", "a b c"), ("a\r\nb", "a\nb"), ("re‑use", "re-use"), ("Кот", "Koт"), ("µ", "μ")]
        other = [("x²", "x2"), ("É", "E"), ("a", "A"), ("½", "1/2"), ("don’t", "don't"), ("сор1", "сор2"), ("™", "TM"), ("👩\u200d💻", "👩💻")]
        for a, b in same:
            assert A.canonical(a) == A.canonical(b), (a, b)
        for a, b in other:
            assert A.canonical(a) != A.canonical(b), (a, b)
        assert A.canonical("Россия и сервер") == "Россия и сервер"

    def test_pairs(self, spark):
        rows_ = [(1, "abc"), (2, "a\u200bbc"), (3, "abc"), (4, "xyz"), (5, "xyz"), (6, None), (7, ""), (8, "\u200b"), (9, "x²"), (10, "x2"), (11, "ａbc")]
        df = spark.createDataFrame(rows_, "doc_id long, text string").withColumn("one", F.lit("x")).withColumn("key", F.lit(1))
        got = {tuple(r) for r in A.lookalike_pairs(df, "doc_id", "text").collect()}
        assert got == {(1, 2), (2, 3), (2, 11), (1, 11), (3, 11)}
        assert A.lookalike_pairs(df.limit(0), "doc_id", "text").count() == 0

    def test_edge_rows(self, spark, texts):
        got = {r.key: r.canonical for r in A.canonical_column(texts, "doc_id", "body").collect()}
        assert got[0] is None and got[1] == "" and got[4] == TEXTS[4] and got[99] is None


class TestNeighbours:
    def vectors(self, spark, n=900, dim=8, seed=1):
        rng = np.random.default_rng(seed)
        x = rng.standard_normal((n, dim)).astype(np.float32)
        for i in range(0, n - 3, 9):  # near copies, scaled copies, equal rows
            x[i + 1] = x[i] + 0.05 * rng.standard_normal(dim)
            x[i + 2] = x[i] * 3
        if n > 160:
            x[100:160] = x[100]  # a large class of equal vectors
        rows_ = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * dim), (5002, [1.0]), (5003, [float("nan")] * dim)]
        return x, spark.createDataFrame(rows_, f"id long, embedding array<float>").withColumn("key", F.lit(1)).withColumn("leaf", F.lit(2))

    @pytest.mark.parametrize("block", [64, 4096])
    def test_mutual_pairs_equal_brute_force(self, spark, monkeypatch, block):
        monkeypatch.setattr(N, "BLOCK_ROWS", block)
        monkeypatch.setattr(N, "LEAF_ROWS", 60)
        x, df = self.vectors(spark)
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
        s = np.round(u @ u.T, 6)
        np.fill_diagonal(s, -2)
        top = {i: [j for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= 0.95] for i in range(len(x))}
        want = {(i, j) for i in top for j in top[i] if i < j and i in top[j]}
        found = N.search(df, "id", "embedding", 5, 8, least=0.95, recall=0.999)
        pairs = {(r.q, r.x) for r in found.collect()}
        got = {(a, b) for a, b in pairs if a < b and (b, a) in pairs}
        assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)

    def test_recall_of_queries(self, spark, monkeypatch):
        monkeypatch.setattr(N, "LEAF_ROWS", 60)
        x, df = self.vectors(spark, 1500, seed=2)
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
        got = N.search(df, "id", "embedding", 5, 8, queries=df.where("id % 50 = 0")).toPandas()
        hit = total = 0
        for q in range(0, 1500, 50):
            s = np.round(u @ u[q], 6)
            s[q] = -2
            kth = np.sort(s)[-5]
            mine = got[got.q == q]
            assert len(mine) == 5 and mine["rank"].tolist() == [1, 2, 3, 4, 5] or set(mine["rank"]) == {1, 2, 3, 4, 5}
            hit += int((mine.cosine >= kth - 1e-6).sum())
            total += 5
        assert hit / total >= 0.9

    def test_empty_and_tiny_tables(self, spark):
        _, df = self.vectors(spark, 10)
        assert N.search(df.limit(0), "id", "embedding", 5, 8).count() == 0
        assert N.search(df.where("id = 1"), "id", "embedding", 5, 8).count() == 0
        assert N.search(df.where("id < 3"), "id", "embedding", 5, 8).count() == 6

    def test_bins_come_best_first(self):
        rng = np.random.default_rng(3)
        x = N._unit(rng.standard_normal((500, 6)).astype(np.float32))
        tree = N.build_tree(x, 30)
        b = N.best_bins(tree, x[:20], tree.leaves)
        assert all(sorted(r.tolist()) == list(range(tree.leaves)) for r in b)


class TestMarkup:
    def test_held_out_pages(self):
        model, rng = M.trained(), random.Random(4242)
        pages = [markup_pages.page(rng) for _ in range(400)]
        assert sum(M.kinds(t, model) == sorted({k for *_, k in s}) for _, t, s in pages) >= 0.97 * len(pages)

    @pytest.mark.parametrize(
        "text,kinds,clean",
        [
            ("plain a < b, 2 * 3 * 4 and x_y_z", [], "plain a < b, 2 * 3 * 4 and x_y_z"),
            ("# Head\n\nsome **bold** and [a link](https://x.example/p).", ["markdown"], "§ Head\n\nsome bold and a link."),
            ("Head\n====\n\n- [ ] item\n- other", ["markdown"], "§ Head\n\n- [ ] item\n- other"),
            ("```py\n<b>x</b> **y**\n```", ["markdown"], "    <b>x</b> **y**"),
            ("<h2>Head</h2><p>a &amp; b<br>c</p><ul><li>x</ul>", ["html"], "§§ Head\na & b\nc\n\n- x"),
            ("<pre><code>a &lt; b ''x''</code></pre>", ["html"], "    a < b ''x''"),
            ("== Head ==\n'''bold''' [[Page|text]] {{term|shown}}", ["wiki"], "§ Head\nbold text shown"),
            ("\\section{Head}\nText \\emph{soft} $x^2$.", ["latex"], "§ Head\nText soft ⟦x^2⟧."),
            ("text <b>b</b> and $\\alpha$", ["html", "latex"], "text b and ⟦\\alpha⟧"),
            ("Files in C:\\temp\\new, costs $8 or $9, Vec<Int>, #include <a.h>", [], "Files in C:\\temp\\new, costs $8 or $9, Vec<Int>, #include <a.h>"),
        ],
    )
    def test_cases(self, text, kinds, clean):
        model = M.trained()
        assert M.kinds(text, model) == kinds
        assert M.clean(text, model) == clean

    def test_marginals_equal_enumeration(self):
        import itertools

        model = M.trained()
        top = M.parse("a **b <b>c</b>** and ''d'' &amp; <p>x <i>y</i></p>")
        flat = [(n, None if parent < 0 else parent) for n, parent in M.preorder(top)]
        weight = np.zeros((len(flat), 2))
        for d in range(len(M.DIALECTS)):
            for states in itertools.product((0, 1), repeat=len(flat)):
                p = model.root.get(M.DIALECTS[d], 1.0)
                for (n, parent), s in zip(flat, states, strict=True):
                    p *= model.evidence(n)[s]
                    p *= model.root_edge(n.type)[d][s] if parent is None else model.edge((flat[parent][0].type, states[parent]), n.type)[s]
                for i, s in enumerate(states):
                    weight[i, s] += p
        model.marginals(top)
        for (n, _), w in zip(flat, weight, strict=True):
            assert n.marginal == pytest.approx(w[1] / w.sum())

    @pytest.mark.parametrize(
        "left,right,unit,type_",
        [
            ("**", "**", "many words ", "md.stars"), ("__", "__", "many words ", "md.under"), ("~~", "~~", "many words ", "md.strike"), ("'''", "'''", "many words ", "wiki.quotes"),
            ("$", "$", "a_1 + ", "tex.dollar"), ("$$", "$$", "a_1 + ", "tex.display"), (r"\[", r"\]", "a_1 + ", "tex.display"), (r"\(", r"\)", "a_1 + ", "tex.display"),
            (r"\begin{align*}", r"\end{align*}", "a_1 + ", "tex.formula"),
        ],
    )
    def test_spans_of_any_length(self, left, right, unit, type_):
        for times in (2, 90, 500, 50_000):
            text = f"Before {left}{unit * times}b{right} after"
            got = [(n.start, n.end) for n in M.parse(text) if n.type == type_]
            assert got == [(7, len(text) - 6)]
            assert type_ not in {n.type for n in M.parse(text.replace(unit, unit + "\n\n", 1))}

    def test_arguments_of_any_length(self):
        text = "\\footnote{" + "many {words} " * 400 + "end} after"
        n = next(n for n in M.parse(text) if n.type == "tex.command")
        assert n.end == len(text) - 6 and n.edits == [(0, 10, ""), (n.end - 1, n.end, "")]

    def test_edge_rows(self, spark, texts):
        assert {r.key: r.clean for r in M.clean_column(texts, "doc_id", "body").collect()}[0] is None
        assert M.found_kinds(texts, "doc_id", "body").count() == 0 and M.found_kinds(texts.limit(0), "doc_id", "body").count() == 0


class TestHandwritten:
    LIB = "\n".join(f"call_{string.ascii_lowercase[i % 26]}({i * 7}, 'lib part {i * i}')" for i in range(40))

    def files(self, spark):
        own = "\n".join(f"own_{i * 3}(x, {i * i})" for i in range(40))
        edited = "\n".join(x + "  # edited" if i % 6 == 0 else x for i, x in enumerate(self.LIB.split("\n")))
        table_ = "T = [\n" + "\n".join("    " + ", ".join(str((i * 7919 + j * 104729) % 65536) for j in range(12)) + "," for i in range(30)) + "\n]\n"
        cases = {
            ("a::x-1.0", "third_party/lib/a.py"): (self.LIB, "vendored"), ("a::y-1.0", "src/plain.py"): (edited, "vendored"), ("a::y-1.0", "src/own.py"): (own, None),
            ("a::y-1.0", "src/short.py"): ("\n".join(self.LIB.split("\n")[:6]), None), ("a::y-1.0", "src/own_note.py"): ("# Copyright the y authors.\nx = f(1)\n", None),
            ("a::y-1.0", "src/other_note.py"): ("# Copyright the zed authors.\nx = f(1)\n", "vendored"), ("a::y-1.0", "src/gen.py"): ("# Code generated by tool v1. DO NOT EDIT.\nx = f(1)\n", "generated"),
            ("a::y-1.0", "src/maker.py"): ("# the line \"Code generated by tool. DO NOT EDIT.\" goes on top\nprint(head)\n", None), ("a::y-1.0", "src/states.c"): ("\n".join(f"case {i}: return F({i * 37 % 91}, {i});" for i in range(30)), "generated"),
            ("a::y-1.0", "web/a.js"): ("(function(n){" + "if(!a&&b!==c)throw Error('x');" * 60 + "})()", "minified"), ("a::y-1.0", "src/table.py"): (table_, "data"), ("a::y-1.0", "src/few.py"): ("T = [1, 2, 3]\n\ndef f(x):\n    return T[x]\n", None),
            ("a::y-1.0", "package-lock.json"): ('{"lockfileVersion": 2}', "generated"), ("a::y-1.0", "src/vendors/list.py"): (own + "\nz()", None), ("a::y-1.0", "conf.toml"): ("\n".join(f"[a.b{i}]\nk = {i}" for i in range(40)), None),
            (None, None): (None, None), ("a::y-1.0", "src/nothing.py"): ("", None),
        }
        rows_ = [(r, p, 0, t) for (r, p), (t, _) in cases.items()] + [("a::y-1.0", "src/gen.py", 0, cases["a::y-1.0", "src/gen.py"][0])]
        return cases, spark.createDataFrame(rows_, "repo_path string, file_path string, chunk_index int, content string").withColumn("fid", F.lit(1)).withColumn("line", F.lit("x"))

    def test_reasons(self, spark):
        cases, df = self.files(spark)
        got = {(r.repo_path, r.file_path): r.reason for r in H.not_handwritten(df).collect()}
        assert got == {k: why for k, (_, why) in cases.items() if why}
        assert H.not_handwritten(df.limit(0)).count() == 0

    def test_copies_of_indexed_projects(self, spark):
        def source(name, n=30):
            return "\n".join(f"def {name}_{i}(left, right): return {name}({i}, left)" for i in range(n))

        rows_ = [
            # bundles zlib by its folder, and has a plain copy of another file of it; zlib itself is indexed
            ("a::app-1.0", "third_party/zlib/a.c", source("first")), ("a::app-1.0", "src/plain.c", source("second")),
            ("a::zlib-1.2", "a.c", source("first")), ("a::zlib-1.2", "b.c", source("second")),
            # nobody but an app that names it holds zlib's file; a third project that names nothing copies it
            ("a::other-1.0", "src/b.c", source("second")),
            # alike without any announcement: nothing tells whose it is
            ("a::left-1.0", "x.c", source("alike")), ("a::right-1.0", "x.c", source("alike")),
            ("a::left-1.0", "LICENSE", source("terms")), ("a::zlib-1.2", "LICENSE", source("terms")),
        ]
        df = spark.createDataFrame([(r, p, 0, t) for r, p, t in rows_], "repo_path string, file_path string, chunk_index int, content string")
        got = {(r.repo_path, r.file_path) for r in H.not_handwritten(df).collect() if r.reason == "vendored"}
        assert got == {("a::app-1.0", "third_party/zlib/a.c"), ("a::app-1.0", "src/plain.c"), ("a::other-1.0", "src/b.c")}

    def test_copies_of_popular_helpers(self, spark):
        helper = "\n".join(f"static int helper_{i}(int x) {{ return x + {i * 7 % 11}; }}" for i in range(30))
        tail = "\n".join(f"int later_{i}(void) {{ return helper_{i}({i * 5 % 13}); }}" for i in range(40))
        rows_ = [("a::app-1.0", f"third_party/lib{i}/helper.c", 0, helper) for i in range(12)] + [("a::b-1.0", "src/helper.c", 0, helper)]
        # a note stands in the first chunk only
        rows_ += [("a::app-1.0", "src/c.c", 0, "/* Copied from libc */\n" + helper), ("a::app-1.0", "src/c.c", 1, tail), ("a::d-1.0", "src/tail.c", 0, tail)]
        df = spark.createDataFrame(rows_, "repo_path string, file_path string, chunk_index int, content string")
        got = {(r.repo_path, r.file_path) for r in H.not_handwritten(df).collect() if r.reason == "vendored"}
        assert {("a::b-1.0", "src/helper.c"), ("a::d-1.0", "src/tail.c")} <= got

    def test_project_names(self):
        for path, name in (("crates.io::a-b-1.2.3", "a-b"), ("git::https://x.example/o/r@abc123", "r"), ("/srv/x/proj", "proj"), ("pypi::p-0.1", "p")):
            assert H.project_name(path) == name


class TestPersonal:
    def test_held_out_lines(self):
        w, rng = P.trained_weights(), random.Random(99)
        right = missed = extra = 0
        for _ in range(1500):
            text, spans = pii_train.line(rng)
            got = {s.type for s in P.find(text, w)}
            want = {k for *_, k in spans}
            right, missed, extra = right + len(got & want), missed + len(want - got), extra + len(got - want)
        assert right / (right + missed) >= 0.95 and right / (right + extra) >= 0.97

    def test_the_best_labelling_is_the_best_of_all(self):
        w, rng = P.trained_weights(), random.Random(7)
        for _ in range(150):
            text, _ = pii_train.line(rng)
            for g in P.windows(P.segments(text)):
                if len(g) > 9:
                    continue
                got = P.best(g, w)

                def value(chosen):
                    v = sum(s.score for s in chosen)
                    for a, b in zip(chosen, chosen[1:]):
                        t = P.transition(a, b)
                        v += w.get(t, 0.0) if t else 0.0
                    return v

                top = 0.0
                for mask in range(1 << len(g)):
                    c = sorted((s for i, s in enumerate(g) if mask >> i & 1), key=lambda s: s.start)
                    if all(a.end <= b.start for a, b in zip(c, c[1:])):
                        top = max(top, value(c))
                assert value(got) == pytest.approx(top) if got else top <= 1e-9

    def test_gates_pass_all_forms(self):
        plain = lambda words: re.sub(r"\(\?:|\)\?|\\|(?<=\.)\?", "", words).replace("?", "").split("|")
        forms = [f"12 Old Mill {x.title()}" for x in P._STREET.split("|")] + [f"12 ter, {x} Lepic" for x in plain(P._WAY)] + [f"{x} Mayor 5" for x in plain(P._CALLE)]
        forms += [f"Linden{x}{gap}12, 50667 Köln" for x in plain(P._END) for gap in ("", " ")] + ["Karl-Marx-Allee 12"]
        forms += [f"{x.upper()}{gap}123" for x in plain(P._BOX) for gap in ("", " ", " no. ")] + ["BP 12", "C.P. 12", "PO Box 12"]
        forms += [f"{x}{gap}4, Old Mill House" for x in plain(P._FLAT) for gap in ("", " ", " #")]
        assert [x for x in forms if "address" not in {s.type for s in P.segments(x)}] == []
        codes = ["AB12 3456C", "AB 12 34 56 C", "AB123456C", "AB1234 56C", "XA1234567", "12345678-Z", "X1Y123456", "AB-12-3456", "A12345B6"]
        assert [x for x in codes if "id_number" not in {s.type for s in P.segments(x)}] == []

    def test_long_windows_keep_what_is_far_apart(self):
        w = P.trained_weights()
        log = "".join(f"2024-05-{1 + n % 28:02d} 12:{n % 60:02d}:11 started\n" for n in range(150))
        text = f"anna@mail.example\n{log}bob@mail.example\n{log}eve@mail.example"
        assert max(len(g) for g in P.windows(P.segments(text))) > 600
        assert [text[s.start : s.end] for s in P.find(text, w) if s.type == "email"] == ["anna@mail.example", "bob@mail.example", "eve@mail.example"]

    def test_long_windows_equal_all_predecessors(self):
        rng, kinds = random.Random(5), ("email", "phone", "name")
        for _ in range(20):
            w = {f"then:{a}>{b}": rng.uniform(-2, 2) for a in kinds for b in kinds}
            w |= {f"f{n}": rng.uniform(-6, 3) for n in range(9)}
            starts = sorted(rng.randint(0, 3000) for _ in range(300))
            group = [P.Segment(a, a + rng.randint(1, 60), rng.choice(kinds), [f"f{rng.randint(0, 8)}"]) for a in starts]
            got = P.best(group, w)
            value = {}
            for s in sorted(group, key=lambda s: s.end):
                before = [value[id(p)] + w.get(P.transition(p, s), 0.0) for p in group if p.end <= s.start]
                value[id(s)] = s.score + max([0.0, *before])
            links = sum(w.get(P.transition(a, b), 0.0) for a, b in zip(got, got[1:], strict=False))
            assert all(a.end <= b.start for a, b in zip(got, got[1:], strict=False))
            assert sum(s.score for s in got) + links == pytest.approx(max(0.0, *value.values()))

    @pytest.mark.parametrize(
        "text,want",
        [
            ("Reported by Anna Lindquist <anna@mail.example>", "Reported by [NAME] <[EMAIL]>"),
            ("call +44 7700 900123 or 030/23125123", "call [PHONE] or [PHONE]"),
            ("passport no. XA1234567, SSN 912-34-5678", "passport no. [ID_NUMBER], SSN [ID_NUMBER]"),
            ("I live at 12 Maple Street, Westford 12345.", "I live at [ADDRESS]."),
            ("git clone git@host.example:a/b.git and pkg@1.2.3, @Override", "git clone git@host.example:a/b.git and pkg@1.2.3, @Override"),
            ("build 966.40.2840 from 2020-05-15, epoch 1734931247940, 192.0.2.58:5175", "build 966.40.2840 from 2020-05-15, epoch 1734931247940, 192.0.2.58:5175"),
            ("the Merge Queue and Blue Anvil both wait at line 3, Main Street theme, lane 2", "the Merge Queue and Blue Anvil both wait at line 3, Main Street theme, lane 2"),
            ("", ""),
        ],
    )
    def test_redaction(self, text, want):
        assert P.redact(text, P.trained_weights()) == want

    def test_edge_rows(self, spark, texts):
        got = {r.key: r.redacted for r in P.redact_column(texts, "doc_id", "body").collect()}
        assert got == {**dict(enumerate(TEXTS)), 99: None}
        assert P.found_types(texts, "doc_id", "body").count() == 0 and P.found_types(texts.limit(0), "doc_id", "body").count() == 0
