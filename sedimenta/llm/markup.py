"""Markup residue: a tree of possible markup in a text, judged by message passing.

A text is parsed into a tree. The root is the page, whose hidden state is the dialect it is written in;
below it stand the elements of HTML, from start tag to end tag, with what they hold as their children,
and nodes for everything else that has the shape of markup (a pair of stars, a command), nested by
containment. Each is either markup or literal. The stretches of text of an element are nodes too, which
are content or residue (a script's). Parent-child potentials say how often a node of a type is markup
below a page of a dialect, or inside another node; evidence potentials say what markup and literal
characters of that shape look like. Messages pass up from the leaves to the root and down again
(sum-product, exact on a tree), and every node gets the probability that its characters are content.
The potentials are counted on labelled pages: ``python -m sedimenta.llm.markup_pages`` rewrites
``markup_weights.json``, which workers read.

What stands in code (fenced, inline, verbatim, preformatted) is literal; no nodes are made of it.

In the clean text a heading stands alone behind one section sign for each level, list items behind "- ",
code blocks are indented by four spaces, formulas stand in white square brackets; texts without markup
come out as they are (with line feeds as line ends).
"""

from __future__ import annotations

import html
import json
import math
import os
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.sources.tables import spread, table

KINDS = ("html", "markdown", "wiki", "latex")
DIALECTS = ("plain", *KINDS)

# Elements of HTML.
TAGS = frozenset(
    """a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col
    colgroup data dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head
    header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol optgroup option output
    p param picture pre q ref rp rt ruby s samp script section select small source span strike strong style sub summary sup
    svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr nowiki syntaxhighlight math""".split()
)
#: Elements by what they are; others are of the group "other".
GROUPS = {
    "block": "address article aside blockquote body center details div dl dd dt fieldset figcaption figure footer form header html main nav p section summary caption".split(),
    "list": "ul ol li menu".split(),
    "cell": "table thead tbody tfoot tr td th colgroup".split(),
    "heading": "h1 h2 h3 h4 h5 h6 title".split(),
    "data": "script style head noscript template svg math iframe object canvas".split(),
    "inline": "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label legend map mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var button option select optgroup progress textarea nowiki ref syntaxhighlight picture audio video".split(),
}
_GROUP = {n: g for g, names in GROUPS.items() for n in names}
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Frequent commands of LaTeX.
COMMANDS = frozenset(
    """alpha approx author beta bf bibliography bigskip caption cdot centering chapter chi cite clearpage date delta documentclass
    dots emph end epsilon eta exp footnote frac gamma ge geq hline href hspace in includegraphics infty input int item
    itshape kappa label lambda large ldots le left leq lim linebreak log maketitle mathbb mathbf mathcal mathrm medskip mu nabla
    ne neq newcommand newline newpage noindent nu omega omit overline pageref par paragraph part partial phi pi prod
    psi quad qquad ref rho right rightarrow section sigma small smallskip sqrt subparagraph subsection subsubsection sum tableofcontents
    tau textbf textit textrm textsc textsf texttt theta times tiny title to underline usepackage varepsilon vspace
    xi zeta begin""".split()
)
_BREAKS = frozenset("br p div li ul ol dl dt dd tr table thead tbody h1 h2 h3 h4 h5 h6 hr pre blockquote section article header footer details summary title head body html nav main aside figure figcaption address form center caption".split())
_TEX_HEADS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
_TEX_DROP = frozenset("label ref cite pageref usepackage documentclass includegraphics input bibliography begin end vspace hspace newcommand".split())

_ZONE = re.compile(
    r"(?P<fence>^[ \t>]*(?:[-*+][ \t]+|\d+[.)][ \t]+)?(?P<mark>`{3,}|~{3,})(?P<info>[^`\n]*)$)"
    r"|<(?P<tag>pre|script|style|nowiki|syntaxhighlight|textarea|code|kbd|samp|tt)\b[^<>]*>"
    r"|(?P<comment><!--)"
    r"|\\begin\{(?P<env>verbatim\*?|lstlisting|minted|Verbatim|alltt)\}(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?"
    r"|\\(?:verb|lstinline)\*?(?P<delim>[|!+/=@\"])"
    r"|(?<!\\)(?P<ticks>`+)",
    re.M | re.I,
)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*)?)/?>|<!DOCTYPE[^<>]*>", re.I)
_ENTITY = re.compile(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_ATX = re.compile(r"^([ \t]*(?:>[ \t]*)*(?:[-*+][ \t]+)?)(#{1,6})([ \t]+)(\S.*?)([ \t]+#+)?[ \t]*$", re.M)
_SETEXT = re.compile(r"^([ \t]*(?:>[ \t]*)*)([^\s>|#*+\-].*|[*_]{1,3}\w.*)\n[ \t>]*(=+|-+)[ \t]*$", re.M)
_STARS = re.compile(r"(?<![*\\\w])(\*{1,3})(?=[^\s*])")
_STARS_END = re.compile(r"(?<=[^\s*\\])\*{1,3}(?!\*)")
#: A star that is no sign of multiplication between blanks.
_STAR = re.compile(r"(?<!\s)\*|\*(?!\s)")
_UNDER = re.compile(r"(?<![\w\\])(_{1,3})(?=[^\s_])")
_UNDER_END = re.compile(r"(?<=[^\s_\\])_{1,3}(?!\w)")
_STRIKE = re.compile(r"(?<![~\\])(~~)(?=[^\s~])")
_STRIKE_END = re.compile(r"(?<=[^\s~])~~(?!~)")
_LINK = re.compile(r"(!?)\[((?:[^\[\]\n]|\[[^\[\]\n]*\]|\n(?!\s*\n))*)\]\([ \t]*(<[^<>\n]*>|[^\s()<>]*(?:\([^\s()]*\)[^\s()<>]*)?)([ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'))?[ \t]*\)")
_REFLINK = re.compile(r"(!?)\[([^\[\]\n]+(?:\n[^\[\]\n]+)?)\]\[([^\[\]\n]*)\]")
_REFDEF = re.compile(r"^[ ]{0,3}\[([^\[\]\n]+)\]:[ \t]*(<[^<>\n]*>|\S+)[^\n]*$", re.M)
_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")
_TABLE_RULE = re.compile(r"^[ \t>]*(?:\|[ \t]*:?-+:?[ \t]*\||\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?)[ \t]*$", re.M)
_WIKI_HEAD = re.compile(r"^(={1,6})[ \t]*([^=\s](?:[^\n]*?[^=\s])?)[ \t]*\1[ \t]*$", re.M)
_QUOTES = re.compile(r"(?<!')('{2}|'{3}|'{5})(?=[^'\s])")
_QUOTES_END = re.compile(r"(?<=[^'\s])'{2,5}(?!')")
_WIKI_LINK = re.compile(r"\[\[([^\[\]\n|]+)((?:\|[^\[\]\n]*)?)\]\]")
_EXT_LINK = re.compile(r"(?<![\]\[\w])\[((?:https?|ftp)://[^\s\[\]]+|mailto:[^\s\[\]]+)([ \t]+[^\[\]\n]+)?\](?![(\[])")
_TEMPLATE = re.compile(r"(?<![{$])\{\{([^{}|\n]+)((?:\|[^{}]*)?)\}\}(?!\})")
_WIKI_TABLE = re.compile(r"^[ \t:]*\{\|[^\n]*\n(?:[^\n]*\n)*?[ \t]*\|\}", re.M)
_ENV = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")
_COMMAND = re.compile(r"(?<!\\)\\([A-Za-z]{2,})(\*?)((?:\[[^\]\n]*\])?)(\{)?")
_BRACE = re.compile(r"[{}]")
_ESCAPED = re.compile(r"(?<!\\)\\([%&_#${}])")
_DISPLAY = re.compile(r"(?<!\\)\$\$(?!\$)|\\[\[(]")
_DISPLAY_END = re.compile(r"\$\$|\\[\])]")
_FORMULA = re.compile(r"\\begin\{((?:equation|align|gather|multline|eqnarray|displaymath|math)\*?)\}")
_FORMULA_END = re.compile(r"\\end\{[a-z]+\*?\}")
_DOLLAR = re.compile(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]*?[^\s$\\])\$(?![\d$\w])")
_LINE_END = re.compile(r"\n")
_CLOSING = {"$$": "$$", "\\[": "\\]", "\\(": "\\)"}
_BLANK_LINE = re.compile(r"\n\s*\n")
_MATH = re.compile(r"[\\^=_{}<>+]")
_LIST_ITEM = re.compile(r"^[ \t]*(?:[*+#:;]+|-)[ \t]", re.M)


class Node:
    """Characters that may be markup: its kind and type, evidence bits, span, and the edits that take it off.

    ``inner`` is what an element holds between its tags. A node of the type "text" has no kind; for it, being
    markup means being no content.
    """

    __slots__ = ("bits", "children", "edits", "end", "inner", "kind", "marginal", "start", "type")

    def __init__(self, kind: str, type_: str, bits: tuple[bool, ...], start: int, end: int, edits: list[tuple[int, int, str]]):
        self.kind, self.type, self.bits, self.start, self.end, self.edits = kind, type_, bits, start, end, edits
        self.children: list[Node] = []
        self.inner: tuple[int, int] | None = None
        self.marginal = 0.0


def _first_on_line(t: str, at: int) -> bool:
    """Whether only blanks stand before a place on its line, which is not the first."""
    while at and t[at - 1] in " \t":
        at -= 1
    return at > 0 and t[at - 1] == "\n"


def _after_blank_line(t: str, at: int) -> bool:
    """Whether the line that begins at a place is the first, or follows an empty one."""
    while at and t[at - 1] in " \t":
        at -= 1
    return at == 0 or t[max(0, at - 2) : at] == "\n\n"


def _indented(code: str) -> str:
    body = code.strip("\n")
    return "\n" + "\n".join("    " + x if x.strip() else "" for x in body.split("\n")) + "\n"


def _zones(text: str) -> tuple[list[Node], str]:
    """Nodes of code and comments, and the text with their characters masked."""
    nodes: list[Node] = []
    masks: list[tuple[int, int]] = []
    at = 0
    # what closes nothing after some place is not looked for again
    missing: set[str] = set()
    blank = _places(_BLANK_LINE, text) if "`" in text else []

    def close_of(name: str, pattern: str, flags: int = 0) -> re.Match[str] | None:
        if name in missing:
            return None
        m = re.compile(pattern, flags).search(text, at)
        if not m:
            missing.add(name)
        return m

    while m := _ZONE.search(text, at):
        a, at = m.start(), m.end()
        if m["fence"] is not None:
            mark = m["mark"]
            close = re.compile(rf"^[ \t>]*{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", re.M).search(text, at)
            end, stop = (close.start(), close.end()) if close else (len(text), len(text))
            head = m["fence"]
            body = text[at:end]
            quote = head[: len(head) - len(head.lstrip(" \t>"))]
            if ">" in quote:
                body = re.sub(r"^[ \t]*>[ \t]?", "", body, flags=re.M)
            nodes.append(Node("markdown", "md.fence", (close is not None, bool(body.strip()), not m["info"].strip() or bool(re.fullmatch(r"[\w+#.{}=\-:, ]+", m["info"].strip()))), a, stop, [(a, stop, _indented(body))]))
        elif m["tag"]:
            tag = m["tag"].lower()
            close = close_of(tag, rf"</{tag}\s*>", re.I)
            if not close:
                continue
            stop, body = close.end(), text[at : close.start()]
            if tag in ("script", "style"):
                # its text is a node of its own: the tags go, and the text if it is no content
                n = Node("html", "html.data", (True, True, True), a, stop, [(a, at, ""), (close.start(), stop, "")])
                n.inner = (at, close.start())
                nodes.append(n)
                masks.append((a, stop))
                at = stop
                continue
            if tag == "nowiki":
                put = body
            else:
                body = html.unescape(re.sub(r"</?[A-Za-z][^<>]*>", "", body))
                put = _indented(body) if tag in ("pre", "syntaxhighlight", "textarea") or "\n" in body.strip() else body
            nodes.append(Node("wiki" if tag in ("nowiki", "syntaxhighlight") else "html", "html.code", (True, bool(body.strip()), True), a, stop, [(a, stop, put)]))
        elif m["comment"]:
            close = close_of("-->", "-->")
            if not close:
                continue
            stop = close.end()
            nodes.append(Node("html", "html.comment", (True, True, True), a, stop, [(a, stop, "")]))
        elif m["env"]:
            close = close_of(m["env"], re.escape(f"\\end{{{m['env']}}}"))
            if not close:
                continue
            stop = close.end()
            nodes.append(Node("latex", "tex.verbatim", (True, True, True), a, stop, [(a, stop, _indented(text[at : close.start()]))]))
        elif m["delim"]:
            line = text.find("\n", at)
            end = text.find(m["delim"], at, len(text) if line < 0 else line)
            if end < 0:
                continue
            stop = end + 1
            nodes.append(Node("latex", "tex.verbatim", (True, True, True), a, stop, [(a, stop, text[at:end])]))
        else:
            ticks = m["ticks"]
            k = bisect_left(blank, at)
            end = blank[k] if k < len(blank) else len(text)
            close = re.compile(rf"(?<!`){ticks}(?!`)").search(text, at, end)
            body = text[at : close.start()] if close else ""
            if not close or not body.strip():
                continue
            stop = close.end()
            # `word'' quotes of LaTeX are no code
            nodes.append(Node("markdown", "md.code", (len(body) <= 200, "''" not in body, "\n" not in body), a, stop, [(a, stop, body.strip() if len(ticks) > 1 else body)]))
        masks.append((a, stop))
        at = stop
    if not masks:
        return nodes, text
    out, last = [], 0
    for a, b in masks:
        out += [text[last:a], "\x00" * (b - a)]
        last = b
    out.append(text[last:])
    return nodes, "".join(out)


def _pair(kind: str, type_: str, bits: tuple[bool, ...], a: int, b: int, open_: int, close: int, put: str = "") -> Node:
    """A node whose markers stand at both ends of its span."""
    return Node(kind, type_, bits, a, b, [(a, a + open_, put), (b - close, b, put)])


def _places(pattern: re.Pattern[str], t: str) -> list[int]:
    return [m.start() for m in pattern.finditer(t)]


def _enclosed(t: str, opener: re.Pattern[str], closer: re.Pattern[str], stops: Callable[[str], list[int]], closing: Callable[[re.Match[str]], str], least: int = 1) -> Iterator[tuple[int, int, int, int]]:
    """Start, inner start, inner end and end of spans from an opener to its next closing text before a stop.

    Closing texts and stops are listed once and searched by bisection, so spans of any length are found
    in linear time, many openers without a closer included.
    """
    ends: dict[str, list[int]] = defaultdict(list)
    for m in closer.finditer(t):
        ends[m[0]].append(m.start())
    at = 0
    while ends and (m := opener.search(t, at)):
        at = m.start() + 1
        close = closing(m)
        places, barred = ends.get(close, []), stops(close)
        i, j = bisect_left(places, m.end() + least), bisect_left(barred, m.end())
        if i < len(places) and (j == len(barred) or places[i] <= barred[j]):
            at = places[i] + len(close)
            yield m.start(), m.end(), places[i], at


def _words(s: str) -> bool:
    return bool(re.fullmatch(r"[\w\s.,;:!?'’()/\x00-]+", s))


def _candidates(text: str, t: str) -> Iterator[Node]:
    if "<" in t:
        yield from _tags(t)
        for m in _AUTOLINK.finditer(t):
            yield Node("markdown", "md.autolink", (True, True, True), m.start(), m.end(), [(m.start(), m.end(), m[1])])
    if "&" in t:
        for m in _ENTITY.finditer(t):
            known = m[1][0] == "#" or m[1] + ";" in html.entities.html5
            yield Node("html", "html.entity", (known, True, True), m.start(), m.end(), [(m.start(), m.end(), html.unescape(m[0]))])
    if "#" in t:
        for m in _ATX.finditer(t):
            a, b = m.span()
            blank = _after_blank_line(t, a)
            # the own hash signs go, a closing row too
            edits = [(m.start(2), m.end(3), "\n" * (a > 0 and not blank) + "§" * len(m[2]) + " ")]
            if m[5]:
                edits.append((m.start(5), m.end(5), ""))
            yield Node("markdown", "md.heading", (blank, len(m[4]) <= 120, not m[4][0].isdigit()), a, b, edits)
    if "\n=" in t or "\n-" in t or "\n>" in t or "\n " in t:
        for m in _SETEXT.finditer(t):
            if _LIST_ITEM.match(m[2] + " ") or "\x00" * 3 in m[3]:
                continue
            a = m.start()
            blank = _after_blank_line(t, a)
            head = m.start(2)
            edits = [(head, head, "§" * (1 if m[3][0] == "=" else 2) + " "), (m.end(2), m.end(), "")]
            yield Node("markdown", "md.setext", (blank, len(m[3]) >= 3, not m[2].startswith("=")), a, m.end(), edits)
    if "*" in t:
        barred = sorted(_places(_BLANK_LINE, t) + _places(_STAR, t))
        for a, i, j, b in _enclosed(t, _STARS, _STARS_END, lambda _: barred, lambda m: m[1]):
            s = t[i:j]
            yield _pair("markdown", "md.stars", (_words(s), " " in s or s.isalpha(), "\n" not in s), a, b, i - a, b - j)
    if "_" in t:
        blank = _places(_BLANK_LINE, t)
        for a, i, j, b in _enclosed(t, _UNDER, _UNDER_END, lambda _: blank, lambda m: m[1]):
            s = t[i:j]
            yield _pair("markdown", "md.under", (_words(s), " " in s, not re.fullmatch(r"\w*", s) or s.isalpha()), a, b, i - a, b - j)
    if "~~" in t:
        lines = _places(_LINE_END, t)
        for a, i, j, b in _enclosed(t, _STRIKE, _STRIKE_END, lambda _: lines, lambda m: m[1]):
            yield _pair("markdown", "md.strike", (_words(t[i:j]), True, True), a, b, 2, 2)
    if "[" in t:
        yield from _links(t)
    if "|" in t:
        for m in _TABLE_RULE.finditer(t):
            if "|" not in m[0] or "-" not in m[0]:
                continue
            end = m.start()
            while end and t[end - 1] == "\n":
                end -= 1
            before = t[t.rfind("\n", 0, end) + 1 : end]
            stop = t.find("\n", m.end() + 1)
            after = t[m.end() + 1 : len(t) if stop < 0 else stop]
            yield Node("markdown", "md.table", ("|" in before, "|" in after, True), m.start(), m.end(), [(m.start(), min(len(t), m.end() + 1), "")] + _rows(t, m))
        if "{|" in t:
            for m in _WIKI_TABLE.finditer(t):
                yield Node("wiki", "wiki.table", (True, "\n|-" in m[0], True), m.start(), m.end(), _wiki_rows(t, m))
    if "=" in t:
        for m in _WIKI_HEAD.finditer(t):
            k = len(m[1])
            a, b = m.span()
            yield Node("wiki", "wiki.heading", (k >= 2, len(m[2]) <= 120, True), a, b, [(a, m.start(2), "§" * max(1, k - 1) + " "), (m.end(2), b, "")])
    if "''" in t:
        ends = _places(_LINE_END, t)
        for a, i, j, b in _enclosed(t, _QUOTES, _QUOTES_END, lambda _: ends, lambda m: m[1]):
            yield _pair("wiki", "wiki.quotes", (_words(t[i:j]), t[i] not in ",;)+", "``" not in t[max(0, a - 200) : a]), a, b, i - a, b - j)
    if "{{" in t:
        for m in _TEMPLATE.finditer(t):
            shown = m[2].split("|")[-1].split("=", 1)[-1] if m[2] else ""
            yield Node("wiki", "wiki.template", (bool(m[2]), m[1][0].isalpha(), not m[1].endswith(" ")), m.start(), m.end(), [(m.start(), m.end(), shown)])
    if "\\" in t:
        yield from _tex(t)
    if "$" in t:
        for m in _DOLLAR.finditer(t):
            s = m[1]
            yield Node("latex", "tex.dollar", (bool(_MATH.search(s)), not s[0].isdigit() or bool(re.search(r"[\\^=_]", s)), len(s.split()) < 4 or "\\" in s), m.start(), m.end(), [(m.start(), m.start() + 1, "⟦"), (m.end() - 1, m.end(), "⟧")])
    if "$$" in t or "\\[" in t or "\\(" in t:
        empty = _places(_BLANK_LINE, t)
        dollars = sorted(empty + [i for i, c in enumerate(t) if c == "$"]) if "$$" in t else []
        for a, i, j, b in _enclosed(t, _DISPLAY, _DISPLAY_END, lambda close: dollars if close == "$$" else empty, lambda m: _CLOSING[m[0]]):
            s = t[i:j]
            yield Node("latex", "tex.display", (bool(_MATH.search(s)), t[a] == "$" or " " in s or bool(re.search(r"[\\^=_]", s)), True), a, b, [(a, i, "⟦"), (j, b, "⟧")])


def _tags(t: str) -> Iterator[Node]:
    """Elements with both tags, and tags that stand alone."""
    opened: list[tuple[str, re.Match[str]]] = []
    waiting: dict[str, int] = defaultdict(int)
    for m in _TAG.finditer(t):
        a, b = m.span()
        if m[2] is None:
            yield Node("html", "html.void", (True, True, True), a, b, [(a, b, "")])
            continue
        name = m[2].lower()
        if name in VOID or m[0].endswith("/>"):
            yield Node("html", "html.void", _tag_bits(t, m), a, b, [(a, b, _tag_text(t, m))])
        elif not m[1]:
            opened.append((name, m))
            waiting[name] += 1
        elif not waiting[name]:
            yield Node("html", "html.close", _tag_bits(t, m), a, b, [(a, b, _tag_text(t, m))])
        else:
            while True:
                other, first = opened.pop()
                waiting[other] -= 1
                if other == name:
                    break
                yield Node("html", "html.open", _tag_bits(t, first), *first.span(), [(*first.span(), _tag_text(t, first))])
            n = Node("html", f"html.{_GROUP.get(name, 'other')}", _tag_bits(t, first), first.start(), b, [(*first.span(), _tag_text(t, first)), (a, b, _tag_text(t, m))])
            n.inner = (first.end(), a)
            yield n
    for _, m in opened:
        yield Node("html", "html.open", _tag_bits(t, m), *m.span(), [(*m.span(), _tag_text(t, m))])


def _tag_bits(t: str, m: re.Match[str]) -> tuple[bool, bool, bool]:
    name, a, attributes = m[2].lower(), m.start(), m[3].rstrip("/").strip()
    glued = a > 0 and t[a - 1].isalnum() and not m[1] and name not in ("br", "sup", "sub", "b", "i", "em", "strong", "span", "a", "wbr", "code")
    return (name in TAGS, not glued, not attributes or "=" in attributes or name in ("input", "option", "details", "script", "video"))


def _tag_text(t: str, m: re.Match[str]) -> str:
    """What stands for a tag in the clean text."""
    name, b = m[2].lower(), m.end()
    if name == "li" and not m[1]:
        return "- " if _first_on_line(t, m.start()) else "\n- "
    if name in _BREAKS and re.fullmatch("h[1-6]", name) and not m[1]:
        return "§" * int(name[1]) + " "
    if name in ("br", "hr") or (name in _BREAKS and m[1] and b < len(t) and t[b] != "\n"):
        return "\n"
    return "\t" if name in ("td", "th") and not m[1] else ""


def _links(t: str) -> Iterator[Node]:
    defined = {m[1].strip().lower() for m in _REFDEF.finditer(t)} if "]:" in t else set()
    glued = lambda m: m.start() > 0 and (t[m.start() - 1].isalnum() or t[m.start() - 1] in "_)]")
    if "](" in t:
        found = list(_LINK.finditer(t))
        # an image may stand in a link's text
        found += [i for m in found if "](" in m[2] for i in _LINK.finditer(t, m.start(2), m.end(2))]
        for m in found:
            address = m[3].strip("<>")
            yield Node("markdown", "md.link", (bool(re.search(r"[/.#:]|^$", address)), not glued(m), True), m.start(), m.end(), [(m.start(), m.start(2), ""), (m.end(2), m.end(), "")])
    if "][" in t:
        for m in _REFLINK.finditer(t):
            known = (m[3] or m[2]).strip().lower() in defined
            yield Node("markdown", "md.reflink", (known, not glued(m), " " in m[2] or known), m.start(), m.end(), [(m.start(), m.start(2), ""), (m.end(2), m.end(), "")])
    if defined:
        for m in _REFDEF.finditer(t):
            address = m[2].strip("<>")
            yield Node("markdown", "md.refdef", (bool(re.search(r"://|^[#/.]|^mailto:|\.\w{2,4}(?:[/#?]|$)", address)), True, True), m.start(), m.end(), [(m.start(), min(len(t), m.end() + 1), "")])
    if "[[" in t:
        for m in _WIKI_LINK.finditer(t):
            special = bool(re.match(r"\s*(?:Category|Kategorie|Catégorie|Categoría|Категория|File|Image|Datei|Fichier|Archivo|Файл)\s*:", m[1], re.I))
            shown = (m[1].split(":", 1)[1] if special and not m[2] else m[2].rsplit("|", 1)[-1] or m[1]) if special or m[2] else m[1]
            plain = m[1][0] not in " -!$" and not re.fullmatch(r"[\d\s,.\-]+", m[1])
            yield Node("wiki", "wiki.link", (plain, bool(special or m[2] or m[1][0].isalpha()), not glued(m) or bool(m[2])), m.start(), m.end(), [(m.start(), m.end(), shown)])
    if "://" in t or "mailto:" in t:
        for m in _EXT_LINK.finditer(t):
            yield Node("wiki", "wiki.extlink", (bool(m[2]), True, True), m.start(), m.end(), [(m.start(), m.start() + 1 if not m[2] else m.end(1) + 1, ""), (m.end() - 1, m.end(), "")])


def _rows(t: str, rule: re.Match[str]) -> list[tuple[int, int, str]]:
    """Edits of the cells' bars in the rows around a rule."""
    edits: list[tuple[int, int, str]] = []

    def row(a: int, b: int) -> None:
        for k in [i for i in range(a, b) if t[i] == "|" and t[i - 1 : i] != "\\"]:
            edge = not t[a:k].strip(" \t>") or not t[k + 1 : b].strip()
            edits.append((k, k + 1, "" if edge else "\t"))

    b = rule.start() - 1
    if b > 0:
        a = t.rfind("\n", 0, b) + 1
        if "|" in t[a:b]:
            row(a, b)
    a = rule.end() + 1
    while a < len(t):
        b = t.find("\n", a)
        b = len(t) if b < 0 else b
        # a further rule sees to the rows below it
        if "|" not in t[a:b] or not t[a:b].strip() or _TABLE_RULE.match(t, a, b):
            break
        row(a, b)
        a = b + 1
    return edits


def _wiki_rows(t: str, m: re.Match[str]) -> list[tuple[int, int, str]]:
    edits, a = [], m.start()
    for line in m[0].split("\n"):
        s = line.strip()
        b = a + len(line)
        if s.startswith(("{|", "|}", "|-")):
            edits.append((a, min(m.end(), b + 1), ""))
        elif s[:1] in "|!":
            i = a + line.index(s[0])
            edits.append((i, i + (2 if s.startswith("|+") else 1), ""))
            edits += [(a + k.start(), a + k.end(), "\t") for k in re.finditer(r"\|\||!!", line) if a + k.start() > i]
        a = b + 1
    return edits


def _tex(t: str) -> Iterator[Node]:
    blank = _places(_BLANK_LINE, t)
    for a, i, j, b in _enclosed(t, _FORMULA, _FORMULA_END, lambda _: blank, lambda m: rf"\end{{{m[1]}}}", 0):
        yield Node("latex", "tex.formula", (True, True, True), a, b, [(a, i, "⟦"), (j, b, "⟧")])
    for m in _ENV.finditer(t):
        yield Node("latex", "tex.env", (True, True, True), m.start(), m.end(), [(m.start(), m.end(), "")])
    # where the group that begins at a place ends, its brace included
    closed: dict[int, int] = {}
    opened: list[int] = []
    for m in _BRACE.finditer(t):
        if m[0] == "{":
            opened.append(m.end())
        elif opened:
            closed[opened.pop()] = m.end()
    for m in _COMMAND.finditer(t):
        name = m[1]
        if name in ("begin", "end") and m[4]:
            continue
        a, b = m.span()
        path = (a > 0 and (t[a - 1].isalnum() or t[a - 1] in "_:.")) or t[b : b + 1] == "\\" and not m[4] and name not in COMMANDS
        edits = [(a, b, "")]
        end = b
        if m[4]:
            if b in closed:
                end = closed[b]
                if name in _TEX_HEADS:
                    edits = [(a, b, "§" * _TEX_HEADS[name] + " "), (end - 1, end, "")]
                elif name in _TEX_DROP:
                    edits = [(a, end, "")]
                elif name == "href" and t[end : end + 1] == "{" and (k := t.find("}", end)) > 0:
                    edits = [(a, end + 1, ""), (k, k + 1, "")]
                    end = k + 1
                else:
                    edits = [(a, b, ""), (end - 1, end, "")]
        elif name == "item":
            edits = [(a, b, "-")]
        yield Node("latex", "tex.command", (name in COMMANDS, m[4] is not None, not path), a, end, edits)
    for m in _ESCAPED.finditer(t):
        yield Node("latex", "tex.escape", (m[1] in "%&", m[1] not in "_#", True), m.start(), m.end(), [(m.start(), m.start() + 1, "")])


def parse(text: str) -> list[Node]:
    """Top-level nodes of a text, with their children."""
    zones, masked = _zones(text)
    found = sorted([*zones, *_candidates(text, masked)], key=lambda n: (n.start, -n.end))
    top: list[Node] = []
    stack: list[Node] = []
    for n in found:
        while stack and stack[-1].end < n.end:
            stack.pop()
        while stack and stack[-1].end <= n.start:
            stack.pop()
        (stack[-1].children if stack else top).append(n)
        stack.append(n)
    for n in found:
        if n.inner:
            _add_texts(n, text)
    return top


_INK = re.compile(r"\S")
_PROSE = re.compile(r"[^\W\d_]{2,}[ \n]+[^\W\d_]{2,}")
_CODE_SIGN = re.compile(r"[{};=]|\(\)|=>|//|/\*")


def _add_texts(n: Node, text: str) -> None:
    """The stretches of an element between its children become nodes, in their order."""
    out: list[Node] = []
    at, stop = n.inner
    for c in [*n.children, None]:
        end = stop if c is None else min(c.start, stop)
        if end > at and _INK.search(text, at, end):
            signs = sum(1 for _ in _CODE_SIGN.finditer(text, at, end))
            out.append(Node("", "text", (bool(_PROSE.search(text, at, end)), signs * 40 < end - at, signs > 0), at, end, [(at, end, "")]))
        if c is not None:
            out.append(c)
            at = max(at, c.end)
    n.children = out


def preorder(top: list[Node]) -> list[tuple[Node, int]]:
    """All nodes with the place of their parent in the list (-1 below the page), parents first."""
    out: list[tuple[Node, int]] = []
    todo = [(n, -1) for n in reversed(top)]
    while todo:
        n, parent = todo.pop()
        out.append((n, parent))
        at = len(out) - 1
        todo += [(c, at) for c in reversed(n.children)]
    return out


class Model:
    """Potentials of the tree: dialects, (type, state) below a dialect or a parent, evidence of a state."""

    _TABLES = ("root", "below", "inside", "bit", "count")

    def __init__(self) -> None:
        self.root: dict[str, float] = defaultdict(lambda: 1.0)
        self.below: dict[tuple, float] = defaultdict(lambda: 0.05)
        self.inside: dict[tuple, float] = defaultdict(lambda: 0.5)
        self.bit: dict[tuple, float] = defaultdict(lambda: 0.5)
        self.count: dict[tuple, float] = defaultdict(lambda: 1.0)

    def learn(self, dialect: str, text: str, spans: list[tuple[int, int, str]]) -> None:
        """Count a labelled page; spans: (start, end, kind) of what is markup in it."""
        self.root[dialect] += 1

        states: list[int] = []
        nodes = preorder(parse(text))
        for n, parent in nodes:
            s = int(any(a <= n.start and n.end <= b and k == n.kind for a, b, k in spans))
            states.append(s)
            if parent < 0:
                self.below[dialect, n.type, s] += 1
            else:
                self.inside[nodes[parent][0].type, states[parent], n.type, s] += 1
            self.count[n.type, s] += 1
            for i, x in enumerate(n.bits):
                self.bit[n.type, s, i, x] += 1

    def to_json(self) -> str:
        return json.dumps({name: {json.dumps(k): v for k, v in sorted(getattr(self, name).items(), key=str)} for name in self._TABLES}, indent=0, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Model:
        model = cls()
        for name, entries in json.loads(text).items():
            for k, v in entries.items():
                key = json.loads(k)
                getattr(model, name)[tuple(key) if isinstance(key, list) else key] = v
        return model.freeze()

    def freeze(self) -> Model:
        """Plain tables, for pickling."""
        for name in self._TABLES:
            setattr(self, name, dict(getattr(self, name)))
        self.memo: dict = {}
        return self

    def evidence(self, n: Node) -> tuple[float, float]:
        key = (n.type, n.bits)
        e = self.memo.get(key)
        if e is None:
            e = []
            for s in (0, 1):
                p = 1.0
                for i, x in enumerate(n.bits):
                    yes, no = self.bit.get((n.type, s, i, x), 0.5), self.bit.get((n.type, s, i, not x), 0.5)
                    p *= yes / (yes + no)
                e.append(p)
            e = self.memo[key] = tuple(e)
        return e

    def edge(self, parent: tuple[str, int], type_: str) -> tuple[float, float]:
        key = (parent, type_)
        e = self.memo.get(key)
        if e is None:
            # of a pair that was not seen, the type's own frequency
            base = [self.count.get((type_, s), 1.0) for s in (0, 1)]
            w = [self.inside.get((*parent, type_, s), 0.0) + 2 * base[s] / sum(base) for s in (0, 1)]
            e = self.memo[key] = (w[0] / sum(w), w[1] / sum(w))
        return e

    def root_edge(self, type_: str) -> list[tuple[float, float]]:
        e = self.memo.get(type_)
        if e is None:
            e = self.memo[type_] = [tuple((self.below.get((d, type_, s), 0.05)) / self.root.get(d, 1.0) for s in (0, 1)) for d in DIALECTS]
        return e

    def marginals(self, top: list[Node]) -> list[float]:
        """Set each node's probability of being markup; returns the dialects' probabilities."""
        prior = [self.root.get(d, 1.0) for d in DIALECTS]

        nodes = preorder(top)
        # upward: what the subtree of each node says of its two states
        score = [list(self.evidence(n)) for n, _ in nodes]
        lam: list[tuple[float, float]] = [(0.0, 0.0)] * len(nodes)
        belief = [math.log(p) for p in prior]
        messages: dict[int, list[float]] = {}
        for i in range(len(nodes) - 1, -1, -1):
            n, parent = nodes[i]
            a, b = score[i]
            z = a + b
            u, v = lam[i] = (a / z, b / z)
            if parent < 0:
                m = messages[i] = [u * x + v * y for x, y in self.root_edge(n.type)]
                belief = [b + math.log(x) for b, x in zip(belief, m, strict=True)]
                continue
            kind = nodes[parent][0].type
            for s in (0, 1):
                x, y = self.edge((kind, s), n.type)
                score[parent][s] *= u * x + v * y
            if min(score[parent]) < 1e-200:  # many children: only the ratio counts
                top_score = max(score[parent])
                score[parent] = [max(w / top_score, 1e-100) for w in score[parent]]
        high = max(belief)
        p = [math.exp(b - high) for b in belief]
        z = sum(p)
        p = [x / z for x in p]

        # downward: what everything else says
        own: list[tuple[float, float]] = [(0.0, 0.0)] * len(nodes)
        for i, (n, parent) in enumerate(nodes):
            u, v = lam[i]
            q0 = q1 = 0.0
            if parent < 0:
                for d, (x, y) in enumerate(self.root_edge(n.type)):
                    w = p[d] / messages[i][d]
                    q0 += w * x
                    q1 += w * y
            else:
                kind = nodes[parent][0].type
                for s in (0, 1):
                    x, y = self.edge((kind, s), n.type)
                    w = own[parent][s] / (u * x + v * y)
                    q0 += w * x
                    q1 += w * y
            a, b = q0 * u, q1 * v
            own[i] = (a / (a + b), b / (a + b))
            n.marginal = own[i][1]
        return p


def _line_ends(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def analyse(text: str, model: Model, formulas: bool = True) -> list[Node]:
    """All nodes of a text that are markup (of a marginal above one half), in order.

    Without ``formulas``, nodes inside a formula are left out: its commands are its content.
    """
    top = parse(_line_ends(text))
    if not top:
        return []
    model.marginals(top)
    out: list[Node] = []
    left_out: set[int] = set()
    for i, (n, parent) in enumerate(preorder(top)):
        if parent in left_out:
            left_out.add(i)
        elif n.marginal > 0.5:
            out.append(n)
            if not formulas and n.type in ("tex.dollar", "tex.display", "tex.formula"):
                left_out.add(i)
    return out


def kinds(text: str, model: Model) -> list[str]:
    return sorted({n.kind for n in analyse(text, model)} - {""})


def clean(text: str, model: Model) -> str:
    """The text without its markup; see the head of the module for what stands for its structure."""
    text = _line_ends(text)
    edits = sorted({e for n in analyse(text, model, formulas=False) for e in n.edits}, key=lambda e: (e[0], -e[1]))
    if not edits:
        return text
    out, at = [], 0
    for a, b, put in edits:
        if a < at:
            continue
        out += [text[at:a], put]
        at = b
    out.append(text[at:])
    done = re.sub(r"[ \t]+\n", "\n", "".join(out))
    return re.sub(r"\n{3,}", "\n\n", done).strip("\n")


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model that ``markup_pages`` counted and wrote beside this module."""
    with open(os.path.join(os.path.dirname(__file__), "markup_weights.json")) as f:
        return Model.from_json(f.read())


def _each(df: DataFrame, key: str, text: str) -> DataFrame:
    return spread(df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))).where(F.length("text") > 0)


def found_kinds(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and markup_kind: one row for each row and kind of markup in it.

    Null and empty texts have none; repeated rows count each; texts of any length are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trained()
        for batch in batches:
            ks, out = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for x in kinds(t, model):
                    ks.append(k)
                    out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(out, pa.string())], names=["key", "markup_kind"])

    return _each(df, key, text).mapInArrow(run, "key long, markup_kind string")


def clean_column(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and clean of every row; a null text stays null, an empty one empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trained()
        for batch in batches:
            done = [clean(t, model) if t else t for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], names=["key", "clean"])

    return spread(df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))).mapInArrow(run, "key long, clean string")


SOURCES = (("documents", "doc_id", "content"), ("github_issues", "id", "body"))


def _both(spark: SparkSession, sf_dir: str, op, column: str) -> DataFrame:
    out = None
    for name, key, text in SOURCES:
        one = op(table(spark, sf_dir, name, key, text), key, text)
        one = one.select(F.lit(name).alias("record_table"), F.col("key").alias("record_id"), column)
        out = one if out is None else out.unionByName(one)
    return out


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of markup in each document and issue."""
    return _both(spark, sf_dir, found_kinds, "markup_kind")


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and issue without its markup."""
    return _both(spark, sf_dir, clean_column, "clean")


QUERIES = {"p3_found": p3_found, "p3_clean": p3_clean}
ORACLES: dict[str, str] = {}
