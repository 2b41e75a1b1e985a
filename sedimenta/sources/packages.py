"""Package registries and version control: fetching, unpacking, and files as rows.

The network is behind ``Transport``, a callable from an address to (status, headers, body), so that the
fetchers run against anything. Archives are unpacked in memory; members that lead out of the archive
and links are left out.
"""

from __future__ import annotations

import gzip
import io
import json
import os
import subprocess
import tarfile
import tempfile
import urllib.error
import urllib.request
import zipfile
from collections.abc import Callable, Mapping
from dataclasses import dataclass

Transport = Callable[[str], tuple[int, Mapping[str, str], bytes]]

CRATES = "https://static.crates.io/crates/{p}/{p}-{v}.crate"
CHAP = "https://chap.intersectmbo.org/package/{p}-{v}.tar.gz"
HACKAGE = "https://hackage.haskell.org/package/{p}-{v}/{p}-{v}.tar.gz"
PYPI = "https://pypi.org/pypi/{p}/{v}/json"


@dataclass(frozen=True)
class Package:
    """Files of one fetched package, by relative path."""

    repo_path: str
    source_kind: str
    name: str | None
    version: str | None
    files: dict[str, bytes]
    git_url: str | None = None
    git_rev: str | None = None


def http(url: str, timeout: float = 60, agent: str = "sedimenta/0.1") -> tuple[int, Mapping[str, str], bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers or {}), e.read()


def _safe(name: str) -> str | None:
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
    return None if not parts or ".." in parts or name.startswith("/") else "/".join(parts)


def untar(data: bytes) -> dict[str, bytes]:
    out = {}
    with tarfile.open(fileobj=io.BytesIO(gzip.decompress(data))) as t:
        for m in t:
            if m.isfile() and (name := _safe(m.name)):
                out[name] = t.extractfile(m).read()
    return out


def unzip(data: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {name: z.read(m) for m in z.infolist() if not m.is_dir() and (name := _safe(m.filename))}


def package_root(files: dict[str, bytes], name: str) -> dict[str, bytes]:
    """Files below ``name/``, else below the first folder, else all."""
    folders = sorted({f.split("/", 1)[0] for f in files if "/" in f})
    root = name if name in folders else folders[0] if folders else None
    return {f[len(root) + 1 :]: b for f, b in files.items() if f.startswith(root + "/")} if root else files


def _get(transport: Transport, url: str) -> bytes:
    status, _, body = transport(url)
    if status != 200:
        raise LookupError(f"{url}: status {status}")
    return body


def fetch_crate(package: str, version: str, transport: Transport = http) -> Package:
    data = _get(transport, CRATES.format(p=package, v=version))
    return Package(f"crates.io::{package}-{version}", "crates.io", package, version, package_root(untar(data), f"{package}-{version}"))


def fetch_haskell(package: str, version: str, transport: Transport = http) -> Package:
    """From the first of the two registries that has it; the source tag says which."""
    seen = []
    for kind, url in (("chap", CHAP), ("hackage", HACKAGE)):
        status, _, body = transport(url.format(p=package, v=version))
        if 200 <= status < 300:
            return Package(f"{kind}::{package}-{version}", kind, package, version, package_root(untar(body), f"{package}-{version}"))
        seen.append(f"{kind} {status}")
    raise LookupError(f"{package}-{version} not found ({', '.join(seen)})")


def choose_distribution(urls: list[dict]) -> dict:
    """A source distribution, else a wheel, else the first."""
    rank = lambda u: 0 if u["packagetype"] == "sdist" else 1 if u["filename"].endswith(".whl") else 2
    if not urls:
        raise LookupError("no distributions")
    return min(urls, key=rank)


def fetch_pypi(package: str, version: str, transport: Transport = http) -> Package:
    meta = json.loads(_get(transport, PYPI.format(p=package, v=version)))
    dist = choose_distribution(meta["urls"])
    data = _get(transport, dist["url"])
    if dist["filename"].endswith(".tar.gz"):
        files = package_root(untar(data), f"{package}-{version}")
    elif dist["filename"].endswith(".whl"):
        files = unzip(data)
    else:
        raise ValueError(f"unsupported archive: {dist['filename']}")
    return Package(f"pypi::{package}-{version}", "pypi", package, version, files)


def _git(args: list[str], cwd: str | None = None) -> str:
    r = subprocess.run(["git", *args], cwd=cwd, capture_output=True, text=True)
    if r.returncode:
        raise RuntimeError(f"git {' '.join(args)} failed:\n{r.stderr}")
    return r.stdout.strip()


def fetch_git(url: str, rev: str | None = None, branch: str | None = None, tag: str | None = None, git: Callable[[list[str], str | None], str] = _git) -> Package:
    """A branch or tag (the branch first) or the head by a shallow clone, a revision by a whole one."""
    with tempfile.TemporaryDirectory() as tmp:
        if branch or tag:
            git(["clone", "--depth", "1", "--branch", branch or tag, url, tmp], None)
        elif rev:
            git(["clone", url, tmp], None)
            git(["checkout", rev], tmp)
        else:
            git(["clone", "--depth", "1", url, tmp], None)
        head = git(["rev-parse", "HEAD"], tmp)
        files = {}
        for folder, names, found in os.walk(tmp):
            names[:] = [n for n in names if n != ".git"]
            for f in found:
                p = os.path.join(folder, f)
                if not os.path.islink(p):
                    with open(p, "rb") as h:
                        files[os.path.relpath(p, tmp)] = h.read()
    return Package(f"git::{url}@{head[:12]}", "git", None, None, files, url, head)
