import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import handwritten as H


@pytest.mark.parametrize("line,note", [
    ("# Generated files are skipped by this walker", False), ("# Generated by protoc 3.2", True), ("// This file is generated. Edit x.proto instead", True), ("/* machine-generated code is hard to read */", False),
    ("# This module generates bindings", False), ("-- the generated parser is checked by hand", False), ("# This file was created by hand", False), ("# This file was automatically generated by SWIG", True),
    ('// the line "Code generated by x. DO NOT EDIT." goes on top', False), ("// Code generated by stringer; DO NOT EDIT.", True), ("// <auto-generated>", True), ("# autogenerated", True), ("; Automatisch erzeugt, bitte nicht bearbeiten", True),
    ("// DO NOT EDIT, regenerated on every build", True), ("# see how the tables are generated in build.py", False), ("# Generated code lives in out/", False),
])
def test_notes_speak_of_the_file_itself(line, note):
    assert H.profile("a::x-1", "src/a.py", 0, f"{line}\nx = 1\n")["generated"] == note


def test_banners_of_distributed_libraries():
    banner = "/*!\n * jQuery JavaScript Library v3.7.1\n * https://jquery.com/\n *\n * Copyright OpenJS Foundation and other contributors\n * Released under the MIT license\n */\n(function (global) {})();\n"
    assert H.foreign_packages("git::https://x.example/o/app@1", "static/jq.js", banner) == ["jQuery"]
    assert H.foreign_packages("git::https://x.example/o/jquery@1", "src/jq.js", banner) == []
    assert H.foreign_packages("git::https://x.example/o/app@1", "a.js", "/*! app.js 1.2.0 | (c) us | MIT license */") == []
    assert H.foreign_packages("git::https://x.example/o/app@1", "a.js", "/* lodash 4.17 is used below, under its licence */") == []


@pytest.mark.parametrize("line,kind", [
    ("!function(e,t){for(var n=0,r=t.length;n<r;n++)e[t[n]]=n?t[n-1]:null;return e}({},['a','b']);" * 4, "dense"), ("0x1f,0x2e,255,13,8,99,1024,77," * 12, "data"), ("QUJD" * 60, "data"),
    ("/usr/share/applications/company/department/products/releases/binaries/documents/templates/reports" * 3, None), (".a{color:red;margin:0}.b>c{padding:1px 2px}#d{top:0;left:0}" * 5, "dense"),
])
def test_composition_of_long_lines(line, kind):
    assert H.composition(line) == kind


def source(name, n=40):
    return "\n".join(f"def {name}_{i * 37 % 91}(left, right): return {name}({i * 53 % 97}, left)" for i in range(n))


def test_silent_edited_copies_are_told_by_their_times(spark):
    edited = "\n".join(x + "  # changed" if i % 5 == 0 else x for i, x in enumerate(source("parse").split("\n")))
    rows = [
        ("a::first-1.0", "parse.py", 0, source("parse"), 100), ("a::second-1.0", "lib/p.py", 0, edited, 900), ("a::third-1.0", "p.py", 0, edited, None),
        ("a::first-1.0", "same.py", 0, source("same"), 5), ("a::second-1.0", "same.py", 0, source("same"), 5), ("a::second-1.0", "own.py", 0, source("own"), 1), ("a::first-1.0", "short.py", 0, source("brief", 20), 1), ("a::second-1.0", "short.py", 0, source("brief", 20), 7),
    ]
    df = spark.createDataFrame(rows, "repo_path string, file_path string, chunk_index int, content string, file_mtime long").withColumn("file_time", F.lit("x"))
    assert {(r.repo_path, r.file_path, r.reason) for r in H.not_handwritten(df).collect()} == {("a::second-1.0", "lib/p.py", "vendored")}
    assert H.not_handwritten(df.drop("file_mtime")).count() == 0


@pytest.mark.parametrize("bits", [17, 20])
def test_the_filter_passes_all_known_lines_and_few_others(spark, bits):
    rng = np.random.default_rng(1)
    known = rng.integers(-(2**63), 2**63, 500)
    other = rng.integers(-(2**63), 2**63, 5000)
    files = spark.createDataFrame([(1, [int(x) for x in known] + [int(x) for x in other]), (2, []), (3, None), (4, [int(known[0])])], "fid long, hashes array<long>")
    lines = spark.createDataFrame([(int(x),) for x in known], "line long")
    got = {r.fid: r.hashes for r in H._only_known(files, lines, bits).collect()}
    assert set(known.tolist()) <= set(got[1]) and len(got[1]) < 600 and not got[2] and not got[3] and got[4] == [int(known[0])]
    assert isinstance(pa.array(got[1]), pa.Array)
    none = H._only_known(files, lines.limit(0), bits)
    assert none.where(F.size("hashes") > 0).count() == 0
