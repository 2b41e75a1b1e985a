import time

import pytest

from sedimenta.operators import symbols as S
from sedimenta.operators.symbols import C_DOC, HASKELL_DOC, RUST_DOC, doc_start, extract_symbols
from sedimenta.plans.cases import TIDE_TS, KETTLE_JS, GARDEN_PY, BROKEN_PY, MINT_RS, BREWERY_HS, PRESS_HS, CELLAR_NIX, LIBRARY_JAVA, RAIL_KT, CLOCK_C, KILN_CPP, BRIDGE_TEX  # noqa: E501


def pairs(source, language):
    return [(s.kind, s.name) for s in extract_symbols(source, language)]


CASES = [
    ("typescript", TIDE_TS, "function readTide, function forecast, function high, function low, class Harbour, interface Berth, type Port, enum Flag"),
    ("javascript", KETTLE_JS, "function boil, function drops, function pour"),
    ("python", GARDEN_PY, "function sow, class Greenhouse, method Greenhouse.warmth, function water"),
    ("python", BROKEN_PY, "function prune, class Orchard, method Orchard.pick, function press"),
    ("rust", MINT_RS, "struct Coin, function Coin::strike, function Coin::polish, function Ingot::grams, enum Alloy, trait Weigh, type Tally, const DIES, function lock, function main"),
    ("haskell", BREWERY_HS, "function mash, struct Malt, struct Cask, type Recipe, class Vessel, impl Vessel, function hopRate"),
    ("haskell", PRESS_HS, "impl Printer, function sheets"),
    ("nix", CELLAR_NIX, "binding vintage, binding racks, binding labels.front"),
    ("java", "package chess;\n\n/** A board. */\npublic\nclass Board {}\n", "class Board"),
    ("java", LIBRARY_JAVA, "class Shelf, constructor Shelf.Shelf, method Shelf.borrow, enum Genre, method Genre.pages, interface Reader, method Reader.turn, record Loan, annotation Rare"),
    ("kotlin", RAIL_KT, "class Wagon, property Wagon.doors, method Wagon.board, object Wagon.Companion, property Wagon.Companion.GAUGE, object Depot, method Depot.shunt, function depart, property platforms"),
    ("c", CLOCK_C, "const LARGER, function wind, struct wheel, struct hand, enum chime, type wheel_t, type strike_fn"),
    ("cpp", KILN_CPP, "class Oven, function degrees, function fire, function ash"),
    ("latex", BRIDGE_TEX, "section Spans, figure The old arch, subsection Loads, lemma lem:keystone, equation equation@L11"),
    ("go", "package oats\nfunc Mill() {}\n", ""),
    ("rust", "", ""),
]


@pytest.mark.parametrize("language,source,want", CASES)
def test_symbols(language, source, want):
    assert ", ".join(f"{k} {n}" for k, n in pairs(source, language)) == want


def test_documentation_lines_belong_to_the_symbol():
    assert doc_start(["use std::io;", "/// Rings.", "#[inline]", "fn bell() {}"], 3, RUST_DOC) == 1
    assert doc_start(["-- Salt first.", "{- then pepper -}", "season = 1"], 2, HASKELL_DOC) == 0
    assert doc_start(["int lamps;", "light()"], 1, C_DOC) == 1
    s = extract_symbols("/// Rings.\npub fn bell() {}\n", "rust")[0]
    assert (s.start_line, s.end_line, s.content) == (1, 2, "/// Rings.\npub fn bell() {}")


def test_a_signature_and_all_guarded_cases_are_one_symbol():
    mash = extract_symbols(BREWERY_HS, "haskell")[0]
    assert mash.content.startswith("-- | Litres") and mash.content.endswith("mash kilos Roasted = kilos * 4.8")
    assert (mash.start_line, mash.end_line) == (6, 11)


def test_large_symbols_are_left_out():
    assert extract_symbols("def stack():\n" + "    crates = 12\n" * 900, "python") == []


@pytest.mark.parametrize("language,source", [
    ("typescript", "const sum = 0 +\n" + "".join(f"  crate{i} * 3 +\n" for i in range(6000)) + "  1\nfunction tail() {}\n"),
    ("typescript", "const chain = start\n" + "\n" * 40_000 + "  .next()\nfunction tail() {}\n"),
    ("kotlin", "val sum = 0 +\n" + "".join(f"  crate{i} * 3 +\n" for i in range(6000)) + "  1\nfun tail() {}\n"),
    ("rust", "fn deep() " + "{" * 20_000 + "}" * 20_000 + "\nfn tail() {}\n"),
    ("latex", "\\[ open\n" * 20_000 + "\\section{tail}\n"),
])
def test_long_statements_are_read_in_linear_time(language, source):
    began = time.perf_counter()
    assert "tail" in [s.name for s in extract_symbols(source, language)]
    assert time.perf_counter() - began < 1


def test_a_file_beyond_its_time_has_no_symbols(monkeypatch):
    monkeypatch.setattr(S, "BUDGET_S", -1)
    assert extract_symbols(MINT_RS, "rust") == []
