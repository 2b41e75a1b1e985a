import gzip
import io
import json
import tarfile
import zipfile

import pytest

from sedimenta import ingest
from sedimenta.operators.embed import HashEmbedder, HttpEmbedder, word_overlap
from sedimenta.operators.store import old_versions
from sedimenta.sources import files, packages, rest
from sedimenta.streaming import sync
from sedimenta.tools import Tools

EMBED = HashEmbedder(16)


@pytest.fixture
def store(spark, tmp_path):
    return ingest.Store(spark, f"file://{tmp_path}/store")


@pytest.fixture
def repo(tmp_path):
    r = tmp_path / "proj"
    for name, text in {
        "src/a.py": "def alpha():\n    return 'resolver snapshot'\n\nclass B:\n    def m(self):\n        return 2\n",
        "src/skip/c.py": "x = 1\n", "target/t.py": "y = 1\n", "notes.txt": "nothing", "README.md": "# Title here\n\nSome words about the project, more than fifty bytes of them.\n", ".gitignore": "skip/\n*.log\n!keep.log\n",
        "conf.toml": "a = 1\n", "café+x.sh": "echo 1\n", "node_modules/deep/d.js": "let d", ".hidden/_e.py": "e = 1\n",
    }.items():
        p = r / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (r / "bad.py").write_bytes(b"\xff\xfe x")
    return r


def test_scan_rules(spark, repo):
    got = {r.rel_path for r in files.code_files(spark, str(repo)).select("rel_path").collect()}
    assert got == {"src/a.py", "conf.toml", "bad.py", "café+x.sh", ".hidden/_e.py"}
    listed = {r.rel_path: r for r in files.scan(spark, str(repo), files.SKIPPED).collect()}
    assert "node_modules/deep/d.js" not in listed and "notes.txt" in listed
    assert listed["src/a.py"].file_mtime == (repo / "src/a.py").stat().st_mtime_ns and listed["notes.txt"].size == 7
    assert files.scan(spark, str(repo / "none")).count() == 0
    assert {r.rel_path for r in files.code_files(spark, str(repo), ["*.txt"]).select("rel_path").collect()} == got | {"notes.txt"}
    assert [r.rel_path for r in files.doc_files(spark, str(repo)).collect()] == ["README.md"]


def test_index_twice_changes_nothing_and_edits_are_seen(spark, store, repo):
    assert ingest.index_folder(store, str(repo), EMBED, "p1") == {"index": 4, "not_text": 1}
    first = {(r.file_path, r.chunk_index): r for r in store.read("code_chunks").collect()}
    assert {k[0] for k in first} == {"src/a.py", "conf.toml", "café+x.sh", ".hidden/_e.py"}
    assert [r.symbol_kind for k, r in sorted(first.items()) if k[0] == "src/a.py"] == ["function", "class", "method"]
    assert ingest.index_folder(store, str(repo), EMBED, "p2") == {"unchanged": 4, "not_text": 1}
    again = {(r.file_path, r.chunk_index): r for r in store.read("code_chunks").collect()}
    assert again.keys() == first.keys() and {tuple(r.project) for r in again.values()} == {("p1", "p2")}
    (repo / "src/a.py").write_text("def alpha():\n    return 3\n")
    assert ingest.index_folder(store, str(repo), EMBED)["reindex"] == 1
    now = {(r.file_path, r.chunk_index): r for r in store.read("code_chunks").collect()}
    assert now["src/a.py", 0].content.endswith("return 3") and ("src/a.py", 1) in now
    doc = store.read("documents").first()
    assert (doc.doc_kind, doc.title, doc.source_path) == ("readme", "Title here", "README.md")
    t = Tools(store, EMBED, projects=["p1"], reranker=word_overlap)
    assert "src/a.py" in t.search_code("alpha return") and "README.md" in t.search_docs("words about the project")
    assert "alpha" in Tools(store, EMBED, projects=[]).bm25_search("alpha") and t.search_github("x") == "No results found."
    # the same answers from the stored indexes, which a change makes stale
    asked = lambda: (t.search_code("alpha return"), t.search_docs("words about the project"), t.bm25_search("alpha"), t.search_github("x"))
    scanned = asked()
    assert [bool(store.refresh_index(n)) for n in ("code_chunks", "documents", "github_issues")] == [True, True, False]
    assert store.index("code_chunks") is not None and asked() == scanned and store.refresh_index("code_chunks").path == store.index("code_chunks").path
    store.change("code_chunks", lambda df: df)
    assert store.index("code_chunks") is None and asked() == scanned
    assert Tools(store, EMBED, projects=["other"]).list_repos() == "No results found."
    assert t.get_file(str(repo), "none.py").startswith("No chunks")
    counts = ingest.prune(store, store.read("repo_index"), dry_run=True)
    assert counts["repo_index"] == 1 and store.read("code_chunks").count() == len(now)
    ingest.prune(store, store.read("repo_index"))
    assert store.read("code_chunks").count() == store.read("documents").count() == store.read("repo_index").count() == 0


def _tar(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for n, b in members.items():
            i = tarfile.TarInfo(n)
            i.size = len(b)
            t.addfile(i, io.BytesIO(b))
    return gzip.compress(out.getvalue())


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in members.items():
            z.writestr(n, b)
    return out.getvalue()


def test_packages(spark, store):
    def transport(url):
        if "crates" in url:
            return 200, {}, _tar({"pkg-1.0/src/lib.rs": b"pub fn go() {}\n", "pkg-1.0/../../etc/x": b"no", "pkg-1.0/Cargo.toml": b"a = 1\n"})
        if "hackage" in url:
            return 200, {}, _tar({"other/A.hs": b"module A where\n\nf :: Int\nf = 1\n"})
        if url.endswith("/json"):
            return 200, {}, json.dumps({"urls": [{"packagetype": "bdist_wheel", "url": "w", "filename": "p-1.whl"}]}).encode()
        if url == "w":
            return 200, {}, _zip({"p/a.py": b"def f():\n    pass\n"})
        return 404, {}, b""

    c = packages.fetch_crate("pkg", "1.0", transport)
    assert c.repo_path == "crates.io::pkg-1.0" and sorted(c.files) == ["Cargo.toml", "src/lib.rs"]
    h = packages.fetch_haskell("pkg", "1.0", transport)
    assert h.repo_path == "hackage::pkg-1.0" and sorted(h.files) == ["A.hs"]
    assert sorted(packages.fetch_pypi("p", "1", transport).files) == ["p/a.py"]
    with pytest.raises(LookupError):
        packages.fetch_crate("pkg", "1.0", lambda u: (404, {}, b""))
    calls = []
    g = packages.fetch_git("https://x.example/r", branch="main", git=lambda a, cwd: calls.append(a[:5]) or "0123456789abcdef")
    assert g.repo_path == "git::https://x.example/r@0123456789ab" and calls[0][:4] == ["clone", "--depth", "1", "--branch"]
    t = Tools(store, EMBED, projects=["p"])
    assert t.fetch_package("pkg", "1.0", "rust", transport).startswith("Indexed pkg-1.0 from rust: 2 chunks.")
    assert t.fetch_package("pkg", "1.0", "rust", transport).startswith("Already indexed")
    assert Tools(store, EMBED, projects=["q"]).fetch_package("pkg", "1.0", "rust", transport).startswith("Added pkg-1.0 to project 'q': 2 chunks")
    assert "status 404" in t.fetch_package("none", "9", "python", lambda u: (404, {}, b""))


PAGES = {
    "issues": [
        {"number": 1, "state": "open", "title": " One ", "body": " text ", "user": {"login": "a"}, "labels": [{"name": "x"}, {"name": "y"}], "created_at": "2026-01-01T00:00:00Z", "updated_at": "2026-01-02T00:00:00+02:00"},
        {"number": 2, "title": "PR", "pull_request": {"url": "u"}, "updated_at": "2026-09-01T00:00:00Z"},
        {"number": 3, "state": "closed", "title": "Three", "body": None, "user": None, "updated_at": "bad time"},
    ],
    "issues/comments": [{"id": 5, "body": "short", "issue_url": "https://a/issues/1"}, {"id": 6, "body": "long enough for a comment to stay", "issue_url": "https://a/issues/1", "updated_at": "2026-01-03T00:00:00Z"}, {"id": 7, "body": "long enough but without a parent number", "issue_url": "https://a/issues/x"}],
    "pulls": [{"number": 9, "state": "closed", "title": "P", "merged_at": "2026-01-01T00:00:00Z", "base": {"ref": "main"}, "head": {"ref": "f"}, "updated_at": "2026-01-01T00:00:00Z"}],
}


def transport(url, headers):
    path = url.split("/repos/o/r/")[1].split("?")[0]
    if path == "pulls/comments":
        raise OSError("down")
    items = PAGES[path]
    if "page=2" in url:
        return 200, {}, json.dumps(items[1:]).encode()
    return 200, {"Link": f'<{url}&page=2>; rel="next", <x>; rel="last"'}, json.dumps(items[:1]).encode()


def test_pull_streams(spark, store):
    got = sync.pull(store, "o/r", EMBED, transport=f"{__name__}:transport")
    assert (got["issues"], got["prs"], got["issue_comments"]) == (2, 1, 1) and "down" in got["pr_comments"]
    issues = {r.number: r for r in store.read("github_issues").collect()}
    assert issues[1].content == "One\n\ntext" and issues[1].labels == "x, y" and issues[3].updated_at is None
    assert store.read("github_prs").first().state == "merged"
    state = {r.scope_key: r for r in store.read("sync_state").collect()}
    assert state["o/r:issues"].watermark == "2026-01-02T00:00:00+02:00" and state["o/r:pr_comments"].error_count == 1 and state["o/r:pr_comments"].watermark is None
    again = sync.pull(store, "o/r", EMBED, ["prs"], transport=f"{__name__}:transport")
    assert again == {"prs": 0}
    with pytest.raises(ValueError):
        sync.pull(store, "nope", EMBED)


def test_follow_replays_without_repeating(spark, store, tmp_path):
    src = tmp_path / "feed"
    src.mkdir()
    (src / "1.json").write_text(json.dumps({"item": json.dumps(PAGES["issues"][0])}) + "\n")
    stream = spark.readStream.schema("item STRING").json(str(src))
    for check in ("c1", "c2"):  # the second checkpoint delivers everything again
        sync.follow(store, "o/r", "issues", stream, EMBED, f"file://{tmp_path}/{check}").awaitTermination()
    assert store.read("github_issues").count() == 1


def test_links_paths_and_retries(tmp_path):
    assert rest.next_link('<a>; rel="prev", <b>; rel="next"') == "b" and rest.next_link("") is None
    assert files.write_reconstructed("x", str(tmp_path), "git::u@1", "a/b.py").endswith("git__u@1/a/b.py")
    for bad in ("../../x", "/etc/x", "."):
        with pytest.raises(ValueError):
            files.write_reconstructed("x", str(tmp_path), "r", bad)
    waits = []
    e = HttpEmbedder("http://x.invalid", "m", sleep=waits.append)
    answers = [TimeoutError(), ConnectionError(), json.dumps({"embeddings": [[1.0]]}).encode()]

    def post(body):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    e._post = post
    assert e(["t"]) == [[1.0]] and waits == [2.0, 4.0]


def test_old_versions_keep_ties(spark):
    df = spark.createDataFrame([("a-1", "crates.io", "a", 1), ("a-2", "crates.io", "a", 2), ("a-3", "pypi", "a", 1), ("b-1", "pypi", "b", 5), ("b-2", "pypi", "b", 5), ("l", "local", None, 0)], "repo_path string, source_kind string, package_name string, indexed_at int")
    assert [r.repo_path for r in old_versions(df).collect()] == ["a-1"] and old_versions(df, "b").count() == 0


def test_model_server(monkeypatch):
    import urllib.error

    from sedimenta.operators.embed import HttpReranker, ensure_model

    asked = []

    def call(url, body):
        asked.append(url.rsplit("/", 1)[-1])
        if asked == ["embed"]:
            raise urllib.error.HTTPError(url, 404, "no model", None, None)
        return {"models": [{"name": "m:latest", "size_vram": 0}]} if url.endswith("/ps") else {}

    assert "does not run on a GPU" in ensure_model("http://h", "m", call) and asked == ["embed", "pull", "embed", "ps"]
    assert ensure_model("http://h", "m", lambda url, body: {"models": [{"name": "m", "size_vram": 5}]}) == ""

    def broken(url, body):
        raise urllib.error.HTTPError(url, 500, "down", None, None)

    with pytest.raises(urllib.error.HTTPError):
        ensure_model("http://h", "m", broken)
    r = HttpReranker("http://h/rerank", "m")
    monkeypatch.setattr(r, "_post", lambda body: json.dumps({"results": [{"index": i, "relevance_score": len(t)} for i, t in reversed(list(enumerate(json.loads(body)["documents"])))]}).encode())
    assert r("q", ["aa", "b", "cccc"]) == [2.0, 1.0, 4.0]
