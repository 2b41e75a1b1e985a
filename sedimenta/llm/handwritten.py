"""Source files that nobody wrote by hand in their project: generated, minified, vendored or data.

Each chunk is read once and leaves a small profile: sums of what its lines look like, notes found in
its head and the hashes of its longer lines. Profiles are added up by file.

Vendored copies are known by a folder or note that names another project; copies without one, edited
ones too, by an inverted index: for every line hash the projects that hold it. The rarest lines of a file
choose the projects it is compared with; containment counts all of the file's lines. Folders and notes
tell which of two projects has the copy, else the times of the files. Files too short to tell stay with
their project. The remaining files are judged by composition: notes of tools, lock files, runs of numbered
statements, long lines of short names and signs, literals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.sources.shared import checkpoint, put_shared_file
from sedimenta.sources.tables import spread, table

#: A line counts for containment from so many characters on.
LINE_CHARS = 12
#: Containment that makes a copy, and the lines a file needs for it.
CONTAINMENT, COPY_LINES = 0.6, 15
#: Lines that a copy needs of which nothing says that it is one.
SILENT_LINES = 30
#: Files with a note of origin up to which their notes (some 40 bytes each) are broadcast.
NOTED_FILES = 500_000
#: Greatest size of the filter that lets lines of several projects pass (16 MB).
FILTER_BITS = 27
#: Share of a file that decides its kind, and the least amount of characters of literals.
SHARE, DATA_CHARS = 0.5, 600
#: Numbered statements in a row that nobody writes by hand; fewer suffice where the path speaks of generation.
RUN_LINES, RUN_LINES_NAMED = 8, 3
#: Lines at the head of a file in which a note of its origin is looked for.
HEAD_LINES = 40

# A note of origin is a sentence about the file itself: a marker, a subject with a verb of making, such a
# verb with who or what made it, or an order not to edit beside such a verb.
_MADE = r"(?:auto-?)?generated|produced|emitted|machine[- ](?:written|generated|made)|compiled|transpiled"
_BY = r"(?:automatically|by machine|mechanically|programmatically|by(?! hand)|from|with|using|via|on|at|in|through)"
_NOTE = re.compile(
    r"@generated\b|<?auto-?generated>|auto-?generated(?:\s*$|[\s:;,.\-]+(?:file|code|by|from|with|using|do not|don't|on|at)\b|\s*[.:;\-]\s*)"
    # this file was ... generated
    rf"|(?:this|the) (?:file|code|source|module|header|class|script|document|page|content)s?(?: here)?(?: was| is|'s| has been| gets)(?: \w+ly)? (?:(?:auto-?|machine[- ])?generated|(?:{_MADE}) {_BY})\b"
    # generated by, code generated from, machine written.
    rf"|(?:(?:file|code|source|module|parser|bindings?|stubs?) )?(?:automatically |machine[- ])?generated(?: automatically)?(?: {_BY}\b|\s*[:;.]|\s*$)|machine[- ](?:written|generated|made)\b(?! (?:files?|code)\b)"
    rf"|(?:file |code )?(?:produced|emitted|compiled|transpiled|built|created|written) (?:automatically|mechanically|programmatically|by machine)\b"
    r"|generator: \S+; source: |note: (?:this is )?machine[- ](?:written|generated)|output of \S+ \S+.*(?:do not|don't|never) (?:modify|edit|change|touch)|regenerate (?:this file |it |me )?(?:with|by|using|via) "
    r"|(?:do not|don't) (?:edit|modify|change|touch)\b.*\b(?:generated|generator|overwritten|regenerated)|[\w ]*\bgenerated\b.*\b(?:do not|don't) (?:edit|modify|change|touch)\b"
    # other languages
    r"|(?:diese )?datei (?:wurde|wird|ist) .*(?:erzeugt|generiert)|automatisch (?:erzeugt|generiert)|(?:ce )?fichier (?:est |a été )?(?:automatiquement )?(?:auto-?)?(?:généré|produit)\b|(?:este )?archivo (?:fue |es |ha sido )?(?:generado|producido)\b",
    re.I,
)
_COMMENT = re.compile(r"[\s/*#;%\-(<!]*")
# Sentences that say whose the file is, in the words that licences and copiers use.
_HOLDERS = r"authors|contributors|developers|project|team|maintainers|community|foundation"
_FOREIGN = re.compile(
    rf"(?:\(c\)|©|copyright)(?: \(c\)| ©)?(?: \d[\d, \-–]*)?(?: by)? the (\S+) (?:{_HOLDERS})\b|licen[cs]e: see (?:the )?(\S+) sources?\b"
    rf"|original (?:authors?|source|version|code): (?:see )?([^/\s]+)/|(?:copied|adapted|derived|vendored|forked|ported) (?:verbatim )?from (?:the )?(\S+) "
    r"|bundled copy of (?:the )?(\S+) |(?:taken|imported|lifted|borrowed) (?:verbatim )?(?:out of|from) (?:the )?(\S+) project|upstream\s*[=:]\s*(\S+)",
    re.I,
)
#: The kept comment with which a library is distributed: its name, a version, and a note of rights near it.
_BANNER = re.compile(r"\A\s*(?:/\*!|/\*\*?\s*@(?:license|preserve))[\s*]*(?:@(?:license|preserve)\s+)?([A-Za-z@][\w.\-/]*)(?: [\w.\-]+){0,4}?,? v?\d+\.\d+(?:\.\d+)*\b", re.I)
_RIGHTS = re.compile(r"\(c\)|©|copyright|licen[cs]e", re.I)
_FOLDER = re.compile(
    r"(?:^|/)(?:vendor|_vendor|third_party|third-party|thirdparty|3rdparty|node_modules|bower_components|deps|subprojects|external|extern"
    r"|contrib/bundled|bundled|Godeps/_workspace)/(?:src/)?([^/]+)/|(?:^|/)(?:vendor|_vendor|third_party|thirdparty|node_modules)/([^/]+)$"
)
_LOCK_NAME = re.compile(
    r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|pnpm-lock\.yaml|yarn\.lock|[Cc]argo\.lock|[Pp]oetry\.lock|[Pp]ipfile\.lock|[Gg]emfile\.lock|composer\.lock|go\.sum|flake\.lock"
    r"|[\w.-]*[.-]lock\.(?:json|ya?ml|toml|txt)|cabal\.project\.freeze)$"
)
_LOCK_TEXT = re.compile(r"lockfileVersion|\"?integrity\"?: \"?sha(?:1|256|384|512)-|^\s*\"?resolved\"?:? \"?https?://|^checksum = \"[0-9a-f]{64}\"", re.M)
_MIN_NAME = re.compile(r"\.min\.(?:js|mjs|cjs|css|ts|jsx|tsx)$")
_GENERATED_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.py|\.pb\.(?:go|cc|h|rs|swift)|\.generated\.\w+|\.g\.(?:dart|cs|ts))$")
_GENERATED_FOLDER = re.compile(r"(?:^|/)(?:_*(?:auto)?gen(?:erated)?_*|codegen)/|_(?:auto)?gen(?:erated)?\.\w+$")
#: Texts of licences are alike in many projects and nobody's source.
_LEGAL = r"(?i)(?:^|/)(?:licen[cs]e|copying|notice|unlicense)[^/]*$"
_NUMBER = re.compile(r"\d+")
_NAMED = re.compile(r"\d+|[^\W\d_]+")
_LITERAL = re.compile(r"(?:[\s\[\](){},;:.+\-]|0[xX][0-9a-fA-F]+|\b\d[\d_.eE]*[uUlLfF]*|\"[^\"\w]*[0-9A-Fa-f]{2,}\"|\"[A-Za-z0-9+/=_-]{24,}\"|'[A-Za-z0-9+/=_-]{24,}'|\\x[0-9a-fA-F]{2})+")
_TOKEN = re.compile(r"(?P<word>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<string>\"[^\"\n]*\"|'[^'\n]*')")
_BLOB = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
#: Languages whose files are lists of settings; numbered runs are no sign there.
SETTINGS = frozenset({"json", "yaml", "yml", "toml", "nix", "ini", "cfg", "sh", "md", "txt", "tex", "cabal"})


def project_name(repo_path: str) -> str:
    """The name of a project without source tag, version, owner or revision."""
    if repo_path.startswith("git::") or "::" not in repo_path:
        return re.sub(r"(?<=[^/])@[^@/]*$", "", repo_path).rstrip("/").removesuffix(".git").rsplit("/", 1)[-1]
    return re.sub(r"-\d[\w.+-]*$", "", repo_path.split("::", 1)[1])


def foreign_packages(repo_path: str | None, file_path: str | None, head: str) -> list[str]:
    """Other projects that a file's folder or head say it comes from."""
    own = project_name(repo_path or "")
    found = []
    m = _FOLDER.search(file_path or "")
    if m:
        found.append(re.sub(r"[-@]v?\d[\w.+-]*$", "", m.group(1) or m.group(2)))
    for m in _FOREIGN.finditer(head):
        name = next(g for g in m.groups() if g).strip(".,;:()'\"")
        if name != own:
            found.append(name)
    m = _BANNER.match(head)
    if m and _RIGHTS.search(head[:1500]):
        plain = lambda x: re.sub(r"(?:[.\-]?js)$|[^a-z0-9]", "", x.lower().rsplit("/", 1)[-1])
        name = plain(m[1])
        if name and name not in plain(own) and plain(own) not in name:
            found.append(m[1])
    return sorted(set(found))


def _numbered(lines: list[str]) -> int:
    """Length of the longest run of statements of one form in which a number counts up by one.

    A line continues a run if the line of the same form within the last four lines has a number, at the
    same place, that is less by one.
    """
    last: dict[str, tuple[int, list[int], int]] = {}
    longest = 0
    for i, line in enumerate(lines):
        if not any(c.isdigit() for c in line):
            continue
        form = _NAMED.sub(lambda m: "9" if m.group()[0].isdigit() else "a", line)
        numbers = [int(x[:15]) for x in _NUMBER.findall(line)[:8]]
        before = last.get(form)
        run = 0
        if before and i - before[0] <= 4 and any(b - a == 1 for a, b in zip(before[1], numbers, strict=False)):
            run = before[2] + 1
            longest = max(longest, run)
        last[form] = (i, numbers, run)
    return longest


def composition(line: str) -> str | None:
    """What a long line with few blanks is made of: "dense" code (short names, signs), "data", or None (a path, prose)."""
    n = len(line)
    words = short = named = numbers = strings = 0
    for m in _TOKEN.finditer(line):
        size = m.end() - m.start()
        if m.lastgroup == "word":
            words, short, named = words + 1, short + (size <= 3), named + size
        elif m.lastgroup == "number":
            numbers += size
        else:
            strings += size
    signs = n - named - numbers - strings - line.count(" ")
    # a path has one kind of sign, code has many
    varied = sum(1 for c in set(line) if not c.isalnum() and c != " ") >= 4
    if words and varied and (short >= 0.3 * words or words >= 8) and signs >= 0.08 * n:
        return "dense"
    if numbers + strings >= 0.6 * n or words <= 1 and n >= 200:
        return "data"
    return "dense" if varied and signs >= 0.2 * n else None


def profile(repo_path: str | None, file_path: str | None, chunk_index: int | None, text: str) -> dict:
    """What one chunk tells about its file."""
    lines = text.split("\n")
    full = [x for x in lines if x.strip()]
    extension = (file_path or "").rsplit(".", 1)[-1].lower()
    head = "\n".join(lines[:HEAD_LINES]) if not chunk_index else ""
    note = bool(head) and any(_NOTE.match(x[_COMMENT.match(x).end() :]) for x in head.split("\n"))
    dense = data = 0
    for x in full:
        s = x.strip()
        n = len(s)
        if n >= 200 and s.count(" ") < 0.1 * n and composition(s) == "dense":
            dense += n
        lit = _LITERAL.match(s)
        if lit and lit.end() >= 0.9 * n and any(c.isdigit() for c in s):
            data += n
        elif n >= 40:
            blob = sum(len(b) for b in _BLOB.findall(s) if not b.islower() and not b.isalpha())
            if blob >= 0.6 * n:
                data += n
    run = 0 if extension in SETTINGS else _numbered([x.strip() for x in full])
    if run >= RUN_LINES_NAMED and _GENERATED_FOLDER.search(file_path or ""):
        run = max(run, RUN_LINES)
    hashes = np.unique(np.array([xxhash.xxh3_64_intdigest(s) for x in full if len(s := x.strip()) >= LINE_CHARS], np.uint64)).view(np.int64)
    return {
        "chars": sum(len(x.strip()) for x in full),
        "lines": len(full),
        "dense": dense,
        "data": data,
        "numbered": run,
        "generated": note or bool(_GENERATED_NAME.search(file_path or "")) or bool(_LOCK_NAME.search(file_path or "")) or len(_LOCK_TEXT.findall(head)) >= 1,
        "min_name": bool(_MIN_NAME.search(file_path or "")),
        "own": project_name(repo_path or ""),
        "foreign": foreign_packages(repo_path, file_path, head),
        "hashes": hashes,
    }


_KINDS = {
    "chars": pa.int64(), "lines": pa.int64(), "dense": pa.int64(), "data": pa.int64(), "numbered": pa.int64(),
    "generated": pa.bool_(), "min_name": pa.bool_(), "own": pa.string(), "foreign": pa.list_(pa.string()), "hashes": pa.list_(pa.int64()),
}
_SCHEMA = "repo_path string, file_path string, chars long, lines long, dense long, data long, numbered long, generated boolean, min_name boolean, own string, foreign array<string>, hashes array<long>, file_time long"


def profiles(chunks: DataFrame) -> DataFrame:
    """A profile of each chunk; a null content is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                rows = [profile(*r) for r in zip(*(part.column(j).to_pylist() for j in range(4)), strict=True)]
                cols = [pa.array([r[k] for r in rows], kind) for k, kind in _KINDS.items()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols, part.column(4)], names=["repo_path", "file_path", *_KINDS, "file_time"])

    time = F.col("file_mtime").cast("long") if "file_mtime" in chunks.columns else F.lit(None).cast("long")
    return spread(chunks.select("repo_path", "file_path", "chunk_index", F.coalesce("content", F.lit("")).alias("content"), time.alias("file_time"))).mapInArrow(run, _SCHEMA)


def _project(name: Column) -> Column:
    return F.xxhash64(F.lower(name))


def _only_known(files: DataFrame, known: DataFrame, most: int = FILTER_BITS) -> DataFrame:
    """``files`` with ``hashes`` thinned to those that a Bloom filter of ``known`` (line) passes.

    The filter has 16 bits for each known line and at most 2 ** most, which is what comes to the driver and goes
    to the workers; where very many lines are known it passes more, and the join behind it still decides.
    """
    bits = min(most, max(17, (16 * known.count()).bit_length()))
    mask, page = (1 << bits) - 1, 1 << min(bits, 20)
    place = F.explode(F.array(F.col("line").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("line", 33).bitwiseAND(F.lit(mask))))

    def bitmap(t: pa.Table) -> pa.Table:
        at = t.column("at").to_numpy()
        one = np.zeros(page, bool)
        one[at % page] = True
        return pa.table({"page": pa.array([int(at[0]) // page], pa.int64()), "bits": pa.array([np.packbits(one, bitorder="little").tobytes()], pa.binary())})

    pages = known.select(place.alias("at")).groupBy(F.floor(F.col("at") / page).alias("page")).applyInArrow(bitmap, "page long, bits binary")
    whole = np.zeros(((1 << bits) // page, page // 8), np.uint8)
    for r in pages.collect():
        whole[r.page] = np.frombuffer(r.bits, np.uint8)
    name = put_shared_file(files.sparkSession, whole.tobytes(), ".bloom")
    columns = [c for c in files.columns if c != "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.memmap(SparkFiles.get(name), np.uint8, "r")

        def there(h: np.ndarray) -> np.ndarray:
            return (full[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1

        for batch in batches:
            lists = batch.column(len(columns))
            h = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ok = there(h & mask) & there((h.view(np.uint64) >> np.uint64(33)).view(np.int64) & mask)
            ends = np.concatenate([[0], np.cumsum(ok)])[np.concatenate([[0], np.cumsum(sizes)])]
            thin = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[ok], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], thin], names=[*columns, "hashes"])

    return files.select(*columns, "hashes").mapInArrow(run, files.select(*columns, "hashes").schema)


def copied_files(found: DataFrame) -> DataFrame:
    """fid of files of which most lines stand in one other project, and that are the copy of the two.

    ``found``: profiles with fid and rid, hashes of the file's and the repository's name. Every line of
    every file is posted under the file's project: the foreign one that its folder or note names, else its
    own. Only lines of several projects are kept. Files of which enough lines are such lines are compared
    with the projects that hold one of their rarest lines; so many are taken that a project without any of
    them can't hold enough of the file. Containment is then counted over all of the file's lines, frequent
    ones included, so nothing depends on how many projects hold a line.

    Where lines are shared, the announcements tell the copy. A file of project A that P contains is the
    copy if announced copies of P contain it, if a file of A names P, or if P is named anywhere and A is
    not; but never if P names A and A doesn't name P. Where nothing is announced, a file of at least
    SILENT_LINES lines is a copy if most of the lines stood in P before it by the files' times
    (``file_time``); of equal or unknown times neither is one.
    """
    own = _project(F.col("own"))
    # a note in a file's head holds for all of its chunks
    notes = found.where(F.size("foreign") > 0).groupBy("fid").agg(F.array_distinct(F.flatten(F.collect_set(F.transform("foreign", _project)))).alias("of"))
    if found.where(F.size("foreign") > 0).count() <= NOTED_FILES:
        notes = F.broadcast(notes)
    said = F.col("of").isNotNull()
    packages = F.when(said, F.col("of")).otherwise(F.array(own))
    compared = found.where(~F.coalesce(F.col("file_path").rlike(_LEGAL), F.lit(False)))
    files = compared.join(notes, "fid", "left").select("fid", "rid", own.alias("own"), said.alias("said"), "file_time", packages.alias("packages"), "hashes")

    def posted(some: DataFrame) -> DataFrame:
        return some.select("fid", "rid", "own", "said", "file_time", F.explode("packages").alias("package"), "hashes").withColumn("line", F.explode("hashes")).drop("hashes")

    shared = posted(files).groupBy("line").agg(F.min("package").alias("a"), F.max("package").alias("b"), F.count("*").alias("n")).where("a != b")
    shared = checkpoint(found.sparkSession, shared.select("line", "n"))
    # lines of one project only, nearly all there are, leave before the files' lines are shuffled
    lines = checkpoint(found.sparkSession, posted(_only_known(files, shared)).join(shared, "line"))

    # files that may be copies: enough of their lines stand in several projects
    plain = lines.where(~F.col("said")).groupBy("fid", "line").agg(F.first("rid").alias("rid"), F.first("own").alias("own"), F.first("n").alias("n"), F.min("file_time").alias("file_time"))
    some = plain.groupBy("fid").agg(F.count("*").alias("held")).where(F.col("held") >= CONTAINMENT * COPY_LINES)
    total = found.join(some, "fid").select("fid", "held", F.explode("hashes").alias("line")).distinct().groupBy("fid", "held").agg(F.count("*").alias("total"))
    total = total.where((F.col("total") >= COPY_LINES) & (F.col("held") >= CONTAINMENT * F.col("total")))
    # of total lines, held - ceil(CONTAINMENT * total) + 1 shared ones can't all be missing in what holds enough
    asked = checkpoint(found.sparkSession, plain.join(total, "fid").withColumn("first", F.col("held") - F.ceil(CONTAINMENT * F.col("total")) + 1))

    # a posting remembers one repository that holds it, or that there are several; of announced copies too
    rid = F.when(F.col("said"), F.col("rid"))
    postings = lines.groupBy("line", "package").agg(
        F.min("rid").alias("lo"), F.max("rid").alias("hi"), F.min(rid).alias("said_lo"), F.max(rid).alias("said_hi"), F.min("file_time").alias("since")
    )
    postings = postings.join(asked.select("line").distinct(), "line", "left_semi")
    rarest = asked.withColumn("r", F.row_number().over(Window.partitionBy("fid").orderBy("n", "line"))).where(F.col("r") <= F.col("first"))
    elsewhere = (F.col("package") != F.col("own")) & ((F.col("lo") != F.col("rid")) | (F.col("hi") != F.col("rid")))
    pairs = rarest.join(postings, "line").where(elsewhere).select("fid", "package").distinct()
    announced = F.coalesce((F.col("said_lo") != F.col("rid")) | (F.col("said_hi") != F.col("rid")), F.lit(False))
    # +1 for a line that the other project had before this file, -1 for one that it got later
    earlier = F.coalesce(F.signum(F.col("file_time") - F.col("since")), F.lit(0))
    held = (
        asked.drop("held").join(pairs, "fid").join(postings, ["line", "package"]).where(elsewhere)
        .groupBy("fid", "own", "package", "total").agg(F.count("*").alias("held"), F.sum(announced.cast("int")).alias("held_said"), F.sum(earlier).alias("earlier"))
        .where(F.col("held") >= CONTAINMENT * F.col("total"))
    )

    names = found.where(F.size("foreign") > 0).select(own.alias("by"), F.explode(F.transform("foreign", _project)).alias("of")).distinct()
    known = names.select("of").distinct()
    side = (
        held.join(names.select(F.col("by").alias("own"), F.col("of").alias("package"), F.lit(True).alias("forth")), ["own", "package"], "left")
        .join(names.select(F.col("of").alias("own"), F.col("by").alias("package"), F.lit(True).alias("back")), ["own", "package"], "left")
        .join(known.select(F.col("of").alias("package"), F.lit(True).alias("package_known")), "package", "left")
        .join(known.select(F.col("of").alias("own"), F.lit(True).alias("own_known")), "own", "left")
    )
    one_way = F.col("back").isNull() & ((F.col("held_said") >= CONTAINMENT * F.col("total")) | (F.col("package_known").isNotNull() & F.col("own_known").isNull()))
    unsaid = F.col("forth").isNull() & F.col("back").isNull() & F.col("package_known").isNull() & F.col("own_known").isNull() & (F.col("held_said") == 0)
    later = F.col("earlier") > 0
    return side.where(F.col("forth").isNotNull() | one_way | (unsaid & (F.col("total") >= SILENT_LINES) & later)).select("fid").distinct()


def not_handwritten(chunks: DataFrame) -> DataFrame:
    """repo_path, file_path and reason of each file that is generated, minified, vendored or data.

    The first reason in the order vendored, generated, minified, data is given. All rows of a file are
    taken together, rows delivered again included (shares stay the same). A null path is a value of its
    own; null and empty contents tell nothing, so a file of such only is judged by its path. An empty
    table gives no rows. ``file_mtime`` may be absent.
    """
    named = profiles(chunks).withColumn("fid", F.xxhash64("repo_path", "file_path", F.isnull("repo_path"))).withColumn("rid", F.xxhash64("repo_path"))
    found = checkpoint(chunks.sparkSession, named)
    copies = copied_files(found).withColumn("copied", F.lit(True))
    sums = found.groupBy("repo_path", "file_path", "fid").agg(
        *[F.sum(c).alias(c) for c in ("chars", "lines", "dense", "data")],
        F.max("numbered").alias("numbered"),
        F.max("generated").alias("generated"),
        F.max("min_name").alias("min_name"),
        F.max(F.size("foreign")).alias("foreign"),
    )
    j = sums.join(copies, "fid", "left")
    reason = (
        F.when((F.col("foreign") > 0) | F.col("copied"), "vendored")
        .when(F.col("generated") | (F.col("numbered") >= RUN_LINES), "generated")
        .when(F.col("min_name") | (F.col("dense") > SHARE * F.col("chars")), "minified")
        .when((F.col("data") > SHARE * F.col("chars")) & (F.col("data") >= DATA_CHARS), "data")
    )
    return j.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("repo_path", "file_path", "reason")


def p4_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not hand-written, with the reason."""
    return not_handwritten(table(spark, sf_dir, "code_chunks", "repo_path", "file_path", "chunk_index", "content", "file_mtime"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not hand-written."""
    return p4_reasons(spark, sf_dir).select("repo_path", "file_path")


QUERIES = {"p4_found": p4_found, "p4_reasons": p4_reasons}
ORACLES: dict[str, str] = {}
