import datetime as dt
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedimenta.functions import text as T
from sedimenta.operators import chunking as C
from sedimenta.operators import ledger as L
from sedimenta.operators import retrieval as R
from sedimenta.operators import store as S
from sedimenta.operators.symbols import split_lines

KEYS = "record_table string, scope_key string, item_key string"
ITEM = KEYS + ", content_hash string, file_mtime long, updated_at timestamp_ntz"
T0 = dt.datetime(2026, 1, 1)


def items(spark, *rows):
    return spark.createDataFrame([("code_chunks", "r", k, h, m, None) for k, h, m in rows], ITEM)


def keys(df):
    return sorted(r.item_key for r in df.collect())


class TestLedger:
    def test_life_of_a_lease(self, spark, tmp_path):
        led = L.WorkLedger(spark, f"file://{tmp_path}/ledger")
        work = items(spark, ("a", "h1", 1), ("b", None, 2))
        token, mine = led.lease(work, T0, 60)
        assert keys(mine) == ["a", "b"]
        assert keys(led.lease(work, T0, 60)[1]) == []  # held by a live lease
        late = T0 + dt.timedelta(seconds=61)
        token2, again = led.lease(work, late, 60)
        assert keys(again) == ["a", "b"]  # expired: pending again
        out = spark.range(2)
        assert led.complete(token, out) is False  # fenced off by the later lease
        assert led.complete(token2, out) and led.complete(token2, out)  # a retry changes nothing
        assert led.output().count() == 2
        assert keys(led.lease(work, late, 60)[1]) == []
        changed = items(spark, ("a", "h2", 1), ("b", None, 3), ("c", "x", None))
        assert keys(led.lease(changed, late, 60)[1]) == ["a", "b", "c"]

    def test_a_failed_write_leaves_no_trace(self, spark, tmp_path):
        led = L.WorkLedger(spark, f"file://{tmp_path}/ledger")
        token, _ = led.lease(items(spark, ("a", "h", 1)), T0, 60)
        spark.range(5).write.parquet(f"{led.root}/out/{token:012d}/x")  # died before it was published
        assert led.output() is None
        assert led.complete(token, spark.range(1)) and led.output().count() == 1
        assert led.lease(items(spark, ("a", "h", 1)), T0, 60)[0] is None

    def test_workers_at_the_same_time_get_different_items(self, spark, tmp_path):
        a, b = (L.WorkLedger(spark, f"file://{tmp_path}/ledger") for _ in range(2))
        work = items(spark, ("a", "h", 1), ("b", "h", 1), ("c", "h", 1))
        step, got = a._append, []

        def late(log, entry):  # the other worker leases after this one has decided
            if not got:
                got.append(b.lease(work.where("item_key <> 'c'"), T0, 60))
            return step(log, entry)

        a._append = late
        token, mine = a.lease(work, T0, 60)
        assert keys(got[0][1]) == ["a", "b"] and keys(mine) == ["c"]
        assert a.complete(token, mine) and b.complete(*got[0])
        assert sorted(r.item_key for r in a.output().collect()) == ["a", "b", "c"]
        assert sorted(r.item_key for r in a.output(after=got[0][0]).collect()) == ["c"]

    def test_a_lease_taken_over_while_it_completes_is_refused(self, spark, tmp_path):
        a, b = (L.WorkLedger(spark, f"file://{tmp_path}/ledger") for _ in range(2))
        work = items(spark, ("a", "h", 1))
        token, mine = a.lease(work, T0, 60)
        step, got = a._append, []

        def late(log, entry):
            if not got:
                got.append(b.lease(work, T0 + dt.timedelta(seconds=61), 60))
            return step(log, entry)

        a._append = late
        assert a.complete(token, mine) is False
        assert b.complete(*got[0]) and b.output().count() == 1

    def test_compaction_keeps_the_states(self, spark, tmp_path):
        led = L.WorkLedger(spark, f"file://{tmp_path}/ledger", compact_every=3)
        for n in range(4):
            token, mine = led.lease(items(spark, ("a", f"h{n}", n), (f"k{n}", "h", 1)), T0, 60)
            assert keys(mine) == ["a", f"k{n}"]
            assert n == 3 or led.complete(token, mine)
        assert led._folder.names("snapshots")
        got = {r.item_key: (r.work_state, r.content_hash) for r in led.states(T0).collect()}
        assert got == {"a": ("leased", "h2"), "k0": ("done", "h"), "k1": ("done", "h"), "k2": ("done", "h"), "k3": ("leased", None)}
        assert keys(led.lease(items(spark, ("a", "h9", 9), ("k0", "h", 1)), T0, 60)[1]) == []
        assert led.complete(token, mine) and led.output().count() == 8

    def test_entries(self, spark):
        rows = [("t", "s", "a", n, n) for n in (1, 2, 3)] + [("t", None, None, 2, 0), ("t", "s", "b", 4, 0), ("t", "s", "c", 5, 0)]
        events = spark.createDataFrame(rows, "record_table string, scope_key string, item_key string, token long, completed int")
        leases = spark.createDataFrame([(1, False, T0), (2, True, T0), (3, False, T0), (4, False, T0 + dt.timedelta(days=1))], "token long, completed boolean, expires_at timestamp_ntz")
        got = sorted((r.item_key or "", r.token, r.entry_state) for r in L.entry_states(events, leases, F.lit(T0).cast("timestamp_ntz")).collect())
        assert got == [("", 2, "done"), ("a", 1, "fenced"), ("a", 2, "done"), ("a", 3, "expired"), ("b", 4, "live"), ("c", 5, "expired")]

    def test_states_from_runs(self, spark):
        ledger = spark.createDataFrame(
            [(1, "code_chunks", "r", "a", "h1", 1, None, T0), (2, "code_chunks", "r", "a", "h2", 2, None, T0), (2, "code_chunks", None, None, None, None, None, None), (9, "code_chunks", "r", "z", "h", 1, None, T0)],
            "run_id long, record_table string, scope_key string, item_key string, content_hash string, file_mtime long, updated_at timestamp_ntz, recorded_at timestamp_ntz",
        )
        runs = spark.createDataFrame([(1, "succeeded"), (2, "failed")], "run_id long, run_state string")
        got = {r.item_key: (r.work_state, r.content_hash) for r in L.recorded_states(ledger, runs).collect()}
        assert got == {"a": ("done", "h1"), None: ("pending", None), "z": ("pending", None)}
        todo = L.pending_items(items(spark, ("a", "h1", 7), ("z", "h", 1), ("n", None, None)), L.recorded_states(ledger, runs))
        assert keys(todo) == ["n", "z"]

    def test_newest_rows_empty_tables_and_extra_columns(self, spark):
        df = spark.createDataFrame([(1, "r", "f", "h1", 1, T0, "x"), (2, "r", "f", "h2", 2, T0, "x"), (3, None, None, None, None, None, "x")], "id long, repo_path string, file_path string, content_hash string, file_mtime long, indexed_at timestamp_ntz, scope_key string")
        assert sorted((r.scope_key or "", r.content_hash or "") for r in L.newest_files(df).collect()) == [("", ""), ("r", "h2")]
        assert L.newest_files(df.limit(0)).count() == 0
        iss = spark.createDataFrame([(1, "r", 1, "a", None, T0), (2, "r", 1, "b", T0, T0)], "id long, repo string, number int, content_hash string, updated_at timestamp_ntz, indexed_at timestamp_ntz")
        assert [r.content_hash for r in L.newest_issues(iss).collect()] == ["b"]


class TestRetrieval:
    def test_bm25_equals_the_formula(self, spark):
        texts = {1: "red fox red", 2: "blue fox", 3: "Red! car", 4: "", 5: None, 6: "nothing here at all"}
        df = spark.createDataFrame(list(texts.items()), "id long, content string")
        got = {r.id: r.score for r in R.bm25(df, "id", "content", "RED fox red").collect()}
        docs = {i: t.lower().replace("!", "").split() for i, t in texts.items() if t is not None}
        avg = sum(map(len, docs.values())) / len(docs)
        want = {}
        for i, d in docs.items():
            s = 0.0
            for t in ("red", "fox"):
                n = sum(t in x for x in docs.values())
                tf = d.count(t)
                s += math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
            if s:
                want[i] = round(s, 6)
        assert got == pytest.approx(want)
        assert R.bm25(df, "id", "content", " !! ").count() == 0 and R.bm25(df.limit(0), "id", "content", "red").count() == 0

    def test_stored_index_gives_the_same_ranking(self, spark, tmp_path):
        from sedimenta.operators.postings import PostingsIndex

        rng = random.Random(3)
        rows = [(i, " ".join(rng.choice("red blue fox car tree sky".split()) for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(90, None), (91, "")]
        df = spark.createDataFrame(rows, "id long, content string").withColumn("term", F.lit("x"))
        index = PostingsIndex.build(df, "id", "content", f"file://{tmp_path}/ix", 4)
        want = R.bm25(df, "id", "content", "red Sky absent").orderBy(F.desc("score"), "id").limit(7)
        assert [tuple(r) for r in index.search("red Sky absent", 7).collect()] == [tuple(r) for r in want.collect()]
        assert index.search("...").count() == 0
        empty = PostingsIndex.build(df.limit(0), "id", "content", f"file://{tmp_path}/ix", 4)
        assert empty.search("red").count() == 0

    def test_search_index_equals_the_scans(self, spark, tmp_path, monkeypatch):
        from sedimenta.operators import search_index as X

        monkeypatch.setattr(X, "LEAF_ROWS", 20)
        monkeypatch.setattr(X, "FILE_ROWS", 50)
        rng = random.Random(5)
        rows = [(i, " ".join(rng.choice("red blue fox car tree sky".split()) for _ in range(rng.randint(0, 20))), [float(rng.choice((0, 6)) + rng.random()), float(rng.choice((0, 6)) + rng.random()), rng.random()], "a" if i % 3 else None) for i in range(400)]
        rows += [(500, None, None, "a"), (501, "", [0.0] * 3, "a"), (502, "red", [1.0], None), (503, "red", rows[0][2], "a"), (504, "red fox", rows[0][2], "a")]
        df = spark.createDataFrame(rows, "id long, content string, embedding array<float>, language string").withColumn("key", F.lit(1)).withColumn("leaf", F.lit("x"))
        index = X.SearchIndex.build(df, "id", "content", "embedding", f"file://{tmp_path}/ix", 3, ("language",), 4)
        again = X.SearchIndex(spark, index.path)
        only = F.col("language") == "a"
        for q in (rows[0][2], [-1.0, 0.2, 0.1], [3.0, 3.0, 1.0]):
            for where in (None, only):
                d = df if where is None else df.where(where)
                d = d.select("id", F.round(R.cosine_distance("embedding", q), 6).alias("d")).where("d IS NOT NULL").orderBy("d", "id").limit(7)
                assert again.nearest(q, 7, where) == [tuple(r) for r in d.collect()]
            for arg in ({}, {"where": only}, {"where": only, "prefilter": True}):
                want = R.hybrid_search(df, "id", "content", "embedding", "red fox", q, 10, **arg).select("id", "content", "rrf_score")
                assert again.hybrid("red fox", q, 10, **arg).select("id", "content", "rrf_score").collect() == want.collect()
        assert again.nearest([0.0] * 3) == again.nearest([1.0]) == [] and again.hybrid("...", [0.0] * 3).count() == 0 and again.rows([]).count() == 0
        assert len(again._leaf) > 5 and index.bm25("red", 3).columns == [c for c in df.columns if c != "embedding"] + ["rrf_score"]
        empty = X.SearchIndex.build(df.limit(0), "id", "content", "embedding", f"file://{tmp_path}/ix", 3)
        assert empty.hybrid("red", [1.0, 0.0, 0.0]).count() == 0

    def test_cosine_forms_agree_and_skip_unusable(self, spark):
        rng = random.Random(1)
        rows = [(i, [rng.uniform(-1, 1) for _ in range(200)]) for i in range(20)] + [(90, None), (91, [0.0] * 200), (92, [1.0] * 3)]
        df = spark.createDataFrame(rows, "id long, v array<float>")
        q = rows[0][1]
        wide = {r.id: r.d for r in df.select("id", R.cosine_distance("v", q).alias("d")).collect()}
        short = spark.createDataFrame([(i, v[:8] if v else v) for i, v in rows], "id long, v array<float>")
        small = {r.id: r.d for r in short.select("id", R.cosine_distance("v", q[:8]).alias("d")).collect()}
        for got, n in ((wide, 200), (small, 8)):
            for i, v in rows[:20]:
                a, b = v[:n], q[:n]
                want = 1 - sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
                assert got[i] == pytest.approx(want, abs=1e-5)
            assert [got[i] for i in (90, 91, 92)] == [None] * 3

    def test_fusion_and_filters(self, spark):
        df = spark.createDataFrame([(i, "fox " * (i + 1) + "x" * i, [float(i), 1.0], "a" if i % 2 else None, ["p"] if i < 3 else None) for i in range(8)], "id long, content string, embedding array<float>, language string, project array<string>")
        df = df.withColumn("repo_path", F.lit("r")).withColumn("symbol_kind", F.lit(None).cast("string"))
        both = R.fuse([spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int"), spark.createDataFrame([(2, 1)], "id long, rank int")], "id")
        assert {r.id: r.rrf_score for r in both.collect()} == {1: round(1 / 61, 9), 2: round(1 / 61 + 1 / 62, 9)}
        assert {r.id for r in R.search_code(df, "fox", [0.0, 1.0], projects=["p"]).collect()} == {0, 1, 2}
        assert {r.language for r in R.search_code(df, "fox", [0.0, 1.0], language="a", prefilter=True).collect()} == {"a"}
        assert R.over_fetch(10, False) == 10 and R.over_fetch(3, True) == 20 and R.over_fetch(10, True) == 30

    def test_reconstruct(self, spark):
        df = spark.createDataFrame([(1, "r", "f", 0, "a\nb\nc", 1), (2, "r", "f", 1, "C\r\nd\n", 3), (3, "r", "g", 0, "x", None), (4, "r", "h", 0, None, 1), (5, "r", "f", 2, "late", 9)], "id long, repo_path string, file_path string, chunk_index int, content string, start_line int")
        assert {r.file_path: r.source for r in R.reconstruct(df).collect()} == {"f": "a\nb\nc\nd\nlate", "g": "x"}


class TestStore:
    def test_upsert_modes(self, spark):
        old = spark.createDataFrame([(1, "a", "h1", ["p"]), (2, "b", "h2", None), (None, "n", "h", None)], "k int, v string, content_hash string, project array<string>")
        new = spark.createDataFrame([(1, "A", "h1", ["q"]), (2, "B", "x", None), (3, "C", "y", ["z"]), (None, "N", "h9", None)], "k int, v string, content_hash string, project array<string>")
        got = {r.k: (r.v, r.project) for r in S.upsert(old, new, ["k"], merge=S.PROJECT_MERGE, when=S.hash_differs).collect()}
        assert got == {1: ("a", ["p"]), 2: ("B", None), 3: ("C", ["z"]), None: ("N", None)}
        always = S.upsert(old, new, ["k"], merge=S.PROJECT_MERGE)
        assert {r.k: (r.v, r.project) for r in always.collect()}[1] == ("A", ["p", "q"])
        assert sorted(map(str, S.upsert(always, new, ["k"], merge=S.PROJECT_MERGE).collect())) == sorted(map(str, always.collect()))  # twice is once
        assert S.upsert(old, new.limit(0), ["k"]).count() == 3 and S.upsert(old.limit(0), new, ["k"]).count() == 4

    def test_versions_swap_and_are_dropped(self, spark, tmp_path):
        t = S.VersionedTable(spark, f"file://{tmp_path}/t", spark.range(0).schema)
        assert t.read().count() == 0
        for n in (1, 2, 3):
            assert t.publish(spark.range(n)) == n
        assert t.read().count() == 3 and len(list((tmp_path / "t/data").iterdir())) == 2
        t.change(lambda df: df.where("id > 0"))  # reads the version that it replaces
        assert t.read().count() == 2

    def test_of_two_writers_of_one_version_the_second_is_refused(self, spark, tmp_path):
        a, b = (S.VersionedTable(spark, f"file://{tmp_path}/t", spark.range(0).schema) for _ in range(2))
        a.publish(spark.range(1), base=0)
        with pytest.raises(S.Conflict):
            b.publish(spark.range(2), base=0)
        assert b.read().count() == 1
        # a change that is made while another is published is made again from its result
        made = []

        def add(df):
            made.append(1)
            if len(made) == 1:
                a.change(lambda x: x.unionByName(spark.range(10, 11)))
            return df.unionByName(spark.range(20, 21))

        b.change(add)
        assert sorted(r.id for r in a.read().collect()) == [0, 10, 20] and len(made) == 2

    def test_parts_change_apart(self, spark, tmp_path):
        schema = "k string, v int"
        a, b = (S.VersionedTable(spark, f"file://{tmp_path}/t", spark.createDataFrame([], schema).schema, "k", 16) for _ in range(2))
        rows = spark.createDataFrame([(f"k{i}", 0) for i in range(40)] + [(None, 0)], schema)
        a.publish(rows)
        one, two = (spark.createDataFrame([(k,)], "k string") for k in ("k1", "k2"))
        p1, p2 = a.buckets_of(one), a.buckets_of(two)
        assert len(p1) == len(p2) == 1 and p1 != p2
        base = a.version()
        a.change(lambda t: t.withColumn("v", F.when(F.col("k") == "k1", 1).otherwise(F.col("v"))), p1)
        # another part changed meanwhile: both changes stand, and nothing is made again
        b.publish(b.read(base, p2).withColumn("v", F.when(F.col("k") == "k2", 2).otherwise(F.col("v"))), base, p2)
        got = {r.k: r.v for r in a.read().collect()}
        assert len(got) == 41 and {k: v for k, v in got.items() if v} == {"k1": 1, "k2": 2}
        with pytest.raises(S.Conflict):
            b.publish(b.read(base, p2), base, p2)
        with pytest.raises(ValueError):
            b.publish(rows, only=p2)
        a.change(lambda t: t.limit(0))
        assert b.read().count() == 0

    def test_files_that_one_writer_creates(self, spark, tmp_path):
        from concurrent.futures import ThreadPoolExecutor

        from sedimenta.sources.shared import Folder

        f = Folder(spark, f"file://{tmp_path}/f")
        with ThreadPoolExecutor(8) as pool:
            won = list(pool.map(lambda i: f.create("x/1", f"text {i}"), range(32)))
        assert sum(won) == 1 and f.text("x/1") == f"text {won.index(True)}" and f.names("x") == ["1"] and f.names("none") == []
        assert f._rename_once("x/2", "b") and not f._rename_once("x/2", "c") and f.text("x/2") == "b" and f.names("x") == ["1", "2"]

    def test_evolve_and_truncate(self, spark):
        df = spark.createDataFrame([("a",), (None,)], "project string")
        assert [r.project for r in S.evolve_projects(df).collect()] == [["a"], None]
        assert S.evolve_projects(spark.range(1)).first().project is None
        t = spark.createDataFrame([("é" * 5,), ("abc",), (None,), ("\U0001f680x",)], "t string")
        assert [r.x for r in t.select(T.byte_truncate(F.col("t"), 3).alias("x")).collect()] == ["é", "abc", None, ""]

    def test_path_functions(self, spark):
        df = spark.createDataFrame([("crates.io::a-b-1.2.3",), ("git::https://x/y@abc",), ("pypi::p-1",), ("/srv/x",), ("hackage::noversion",)], "p string")
        p = F.col("p")
        got = [tuple(r) for r in df.select(T.source_kind(p), T.package_name(p), T.package_version(p), T.git_url(p), T.git_rev(p)).collect()]
        assert got == [("crates.io", "a-b", "1.2.3", None, None), ("git", None, None, "https://x/y", "abc"), ("local", None, None, None, None), ("local", None, None, None, None), ("hackage", None, None, None, None)]
        assert df.where("p LIKE 'pypi%'").select(T.source_kind(p, True), T.package_name(p, True)).first() == ("pypi", "p")


class TestChunks:
    def test_windows(self):
        assert C.line_windows([]) == []
        assert [c[2:4] for c in C.line_windows(["a", "b", "c"])] == [(1, 3)]
        assert len(C.line_windows(["x"] * (256 * 120 + 200))) == 256
        assert len(C.line_windows(["x"] * 110)) == 1
        w = C.line_windows([str(i) for i in range(300)])
        assert len(w) >= 2 and w[0][3] >= w[1][2]
        assert [c[2] for c in C.line_windows([""] * 105 + ["x"] * 200)][0] == 106 - 105

    @settings(max_examples=40, deadline=None)
    @given(st.lists(st.sampled_from(["", "x", "y" * 90, "z" * 9000]), max_size=400))
    def test_windows_cover_all_small_lines(self, lines):
        w = C.line_windows(lines)
        assert all(len(c[1].encode()) <= C.MAX_BYTES and c[1].strip() for c in w)
        assert [c[0] for c in w] == list(range(len(w)))
        assert all(b[2] - a[2] >= C.STEP for a, b in zip(w, w[1:]))

    def test_native_windows_equal_the_loop(self, spark):
        rng = random.Random(4)
        texts = ["\n".join(rng.choice(["", "a", "b" * 50, "c" * 300]) for _ in range(rng.randint(0, 500))) + rng.choice(["", "\n", "\r\n"]) for _ in range(60)] + ["", None, "\n" * 300]
        df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
        got = {}
        for r in C.chunk_lines(df, "id", "t").collect():
            got.setdefault(r.id, []).append((r.chunk_index, r.content, r.start_line, r.end_line, None))
        for i, t in enumerate(texts):
            assert sorted(got.get(i, [])) == C.line_windows(split_lines(t or "")), i

    def test_symbols_and_tails(self):
        src = "def f():\n    return 1\n" + "\n".join(f"x{i} = {i}" for i in range(400))
        out = C.make_chunks(src, "python")
        assert out[0][4] == "function" and out[1][4] is None and out[-1][3] == 402 and out[1][2] == 1
        assert [c[4] for c in C.make_chunks("just text", "text")] == [None]

    def test_markdown(self):
        assert C.markdown_chunks("small") == ["small"]
        text = "intro\n" + "".join(f"## H{i}\n" + "word " * 300 + "\n" for i in range(4)) + "## Big\n### A\n" + "x" * 5000 + "\n### B\nend\n"
        out = C.markdown_chunks(text)
        assert out[0] == "intro" and out[1].startswith("## H0") and len(out) == 8
        assert all(len(c.encode()) <= 4000 for c in out) and out[-1] == "### B\nend"
