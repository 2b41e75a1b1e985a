"""The element tree, and pages written by hand that the generator knows nothing of."""

import time

import pytest

from sedimenta.llm import markup as M


def nodes(text):
    top = M.parse(text)
    M.trained().marginals(top)
    return M.preorder(top)


def test_elements_hold_their_children_and_texts():
    text = "<div><p>One <b>two</b> three</p><br><ul><li>four<li>five</ul></div>"
    tree = nodes(text)
    kinds = [(n.type, -1 if p < 0 else p) for n, p in tree]
    assert kinds == [("html.block", -1), ("html.block", 0), ("text", 1), ("html.inline", 1), ("text", 3), ("text", 1), ("html.void", 0), ("html.list", 0), ("html.open", 7), ("text", 7), ("html.open", 7), ("text", 7)]
    assert [text[n.start : n.end] for n, _ in tree if n.type == "text"] == ["One ", "two", " three", "four", "five"]
    assert all((n.marginal > 0.9) == (n.type != "text") for n, _ in tree)


def test_a_script_is_no_content_and_a_paragraph_is():
    tree = nodes("<script>var a = {b: 1}; function go() { return a; }</script>\n<p>Plain words follow; they stay.</p>")
    content = {n.start: 1 - n.marginal for n, _ in tree if n.type == "text"}
    assert [round(x) for _, x in sorted(content.items())] == [0, 1]


def test_tags_are_judged_with_what_they_enclose():
    model = M.trained()
    assert M.clean("Use <version> of List<T>item</T> here.", model) == "Use <version> of List<T>item</T> here."
    assert M.clean("a </b> b <i>c", model).split() == ["a", "b", "c"]


@pytest.mark.parametrize("text", [
    "<div>" * 4000 + "deep" + "</div>" * 4000, "<li>x\n" * 20_000, "<code>" * 20_000, "`a\n\n" * 20_000, "<!-- " * 20_000, "\\begin{verbatim} " * 5_000, "# Head\n" * 20_000, "<b>" * 9_000 + "</i>" * 9_000, "a | b\n|---|\n" * 10_000,
])
def test_large_and_deep_pages_take_linear_time(text):
    began = time.perf_counter()
    M.clean(text, M.trained())
    assert time.perf_counter() - began < 8


PAGES = [
    (["html"], """<!DOCTYPE html>
<html lang="en"><head><title>Sourdough at home</title><meta charset="utf-8">
<style>body { font-family: serif; } .box { margin: 0 auto; }</style></head>
<body><header><h1>Sourdough at home</h1></header>
<p>Mix the <em>levain</em> &amp; water first.</p>
<ol><li>Rest for 30&nbsp;minutes</li><li>Fold <strong>twice</strong></li></ol>
<pre>hydration = water / flour</pre>
<script>window.track = function (x) { return x; };</script>
<footer><a href="/about">About us</a></footer></body></html>""",
     ["§ Sourdough at home", "Mix the levain & water first.", "- Rest for 30\xa0minutes", "- Fold twice", "    hydration = water / flour", "About us"], ["window.track", "font-family", "<", "&amp;"]),
    (["html", "markdown"], """<p align="center"><img src="logo.svg" width="120"></p>

# kestrel

[![build](https://ci.example/b.svg)](https://ci.example/b)

A small **bird ringing** diary. See [the manual](docs/manual.md).

```sh
kestrel add --ring "A 123" > log
```

| Ring | Count |
|------|-------|
| A123 | 4     |
""", ["§ kestrel", "A small bird ringing diary. See the manual.", '    kestrel add --ring "A 123" > log', "A123 \t 4"], ["**", "](", "|--", "<p"]),
    (["wiki"], """{{Short description|Alpine flower}}
'''Gentiana verna''' is a [[flowering plant|plant]] of the ''Alps''.

== Habitat ==
* Meadows above {{convert|1500}}
* Limestone

[[Category:Gentiana]]""", ["Gentiana verna is a plant of the Alps.", "§ Habitat", "* Limestone"], ["'''", "[[", "{{"]),
    (["latex"], r"""\documentclass{article}
\begin{document}
\section{Tides}
The height is \emph{nearly} $h = a\cos(\omega t)$.
\begin{itemize}
\item spring tides
\end{itemize}
\begin{verbatim}
print(h)
\end{verbatim}
\end{document}""", ["§ Tides", r"The height is nearly ⟦h = a\cos(\omega t)⟧.", "- spring tides", "    print(h)"], ["\\section", "\\begin", "\\item"]),
    ([], "Dear all,\n\nthe price rose from $4 to $7 (see C:\\prices\\new.txt), so a < b holds.\nmap<int, list<int>> stays.\n", ["the price rose from $4 to $7 (see C:\\prices\\new.txt), so a < b holds.", "map<int, list<int>> stays."], []),
]


@pytest.mark.parametrize("kinds,text,lines,gone", PAGES)
def test_pages_written_by_hand(kinds, text, lines, gone):
    model = M.trained()
    assert M.kinds(text, model) == kinds
    clean = M.clean(text, model)
    assert [x for x in lines if x not in clean] == [] and [x for x in gone if x in clean] == []
