"""Labelled pages for the markup model: invented text in known markup, with look-alikes that are none."""

from __future__ import annotations

import os
import random

_WORDS = """river stone garden signal harbour paper window morning copper engine ladder meadow winter basket candle mirror
pencil button market village bridge lantern forest island carpet kettle pillow ticket wagon violin""".split()

#: Literal text that has the shape of markup, by nothing but chance.
_LITERALS = (
    "if a < b and c > d then stop", "Vec<Widget> and Map<String, List<Int>>", "#include <vector.h> is first, C# too", "it costs $8 or $58 per box",
    "between $5 and $12 a day", "files are in C:\\temp\\new\\table", "the pattern \\d+\\s* matches", "\\w+ or \\bword\\b", "R&D and a && b", "x == 4 & y == 5",
    "snake_case_name and other_name_x", "_private_name in some_module_x", "2 * 3 * 4 = 24", "*.py, *.c and *.h", "f(**kwargs, **opts)", "a[i][j] = b[k]", "see [5] and [12]",
    "x = '' or y = ''", "it's the dogs' bowl", "[[ -z x ]] && exit", "[[1, 2], [3, 4]]", "{{ 1, 2 }, { 3, 4 }}", "cost ~ 5 ~ 6", "a | b | c", "<user@host> wrote", "-> and <-", "a ~= b ~~ c",
    "100% & more; rest", "AT&T; and so on", "__init__.py and __main__", "3 > 2 > 1", "-----", "***", "- [ ] open task", "> quoted line", "1) first", "* item", "=====", "&x; &yy", "${{ name }}", "Pair<Key> of a Box<Item> is open", "class <Name> or <T>", "<path> is a file and <n> a number", "List<T>item</T>", "use <version> here", "\\(group\\) in a pattern", "#12 is fixed", "! not [x](y z)",
)


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.text, self.spans = rng, "", []

    def words(self, a: int = 2, b: int = 8) -> str:
        return " ".join(self.rng.choice(_WORDS) for _ in range(self.rng.randint(a, b)))

    def put(self, s: str, kind: str | None = None) -> None:
        if kind:
            self.spans.append((len(self.text), len(self.text) + len(s), kind))
        self.text += s

    def inline(self, kind: str) -> None:
        r, w = self.rng, self.words(1, 3)
        x = r.choice
        if kind == "html":
            self.put(x([f"<b>{w}</b>", f"<em>{w}</em>", "<br>", "<br/>", f'<span style="color:red">{w}</span>', f'<a href="https://x.example/p">{w}</a>', "&mdash;", "&nbsp;", "&lt;", "&amp;", "&#8212;", f"<sup>{w}</sup>", "<!-- note -->", f'<img src="a/b.png" width="9">', f"<EM>{w}</EM>", f"<code>{w}</code>"]), kind)
        elif kind == "markdown":
            self.put(x([f"**{w}**", f"*{w}*", f"_{w}_", f"__{w}__", f"***{w}***", f"~~{w}~~", f"`{w}`", f"[{w}](https://x.example/p)", f"![{w}](img/a.png)", f"[{w}][ref]", f"[{w}](doc/a.md)"]), kind)
            if self.text.endswith("[ref]"):
                self.refs = True
        elif kind == "wiki":
            self.put(x([f"'''{w}'''", f"''{w}''", f"[[{w}]]", f"[[Page {w}|{w}]]", f"[https://x.example/p {w}]", f"{{{{term|{w}}}}}", f"{{{{note|{w}|2}}}}"]), kind)
        else:
            self.put(x([f"\\textbf{{{w}}}", f"\\emph{{{w}}}", f"\\texttt{{{w}}}", "$x^2 + y_1$", "$\\alpha + 1$", "$n$", "\\(\\frac{1}{2}\\)", "\\ref{sec:a}", "\\cite{key}", "12\\%", "\\ldots", f"\\footnote{{{w}}}", "\\_", "\\&"]), kind)

    def sentence(self, kinds: list[str], literals: float) -> None:
        for _ in range(self.rng.randint(1, 3)):
            self.put(self.words().capitalize() + " ")
            if kinds and self.rng.random() < 0.5:
                self.inline(self.rng.choice(kinds))
                self.put(" ")
            if self.rng.random() < literals:
                self.put(self.rng.choice(_LITERALS) + " ")
            self.put(self.words(1, 4) + self.rng.choice(".?!;") + " ")

    def element(self, depth: int = 0) -> str:
        """HTML as pages have it: elements in elements, with text between them."""
        r, w = self.rng, self.words(1, 4)
        x = r.random()
        if depth > 3 or x < 0.25:
            return r.choice((w, w, f"{w}; {self.words(2, 9)}.", f"{w} = {r.randint(1, 99)};", f"{w}() and {self.words(1, 3)}", f"{w} // {w}", f"<b>{w}; {w}</b>", f"<b>{w}</b>", f"<em>{w}</em> {self.words(1, 3)}", f'<a href="/p/{r.randint(1, 99)}">{w}</a>', f"{w}<br>{self.words(1, 2)}", f"<code>{w}</code>", f'<img src="a.png" alt="{w}">', "<br />", f'<input type="text" name="{w.split()[0]}" />', f"{w} &amp; {self.words(1, 2)}", f"<span>{w}</span>"))
        inner = [self.element(depth + 1) for _ in range(r.randint(1, 3))]
        if x < 0.5:
            name = r.choice(("div", "p", "section", "article", "blockquote", "main", "header", "footer", "nav", "center"))
            attributes = r.choice(("", "", f' class="{w.split()[0]}"', f' id="n{r.randint(1, 9)}"', ' align="center"'))
            return f"<{name}{attributes}>" + r.choice(("\n", "", "  ")).join(inner) + f"</{name}>"
        if x < 0.7:
            items = "".join(f"<li>{i}{r.choice(('</li>', '</li>', ''))}" + r.choice(("\n", "")) for i in inner)
            name = r.choice(("ul", "ol"))
            return f"<{name}>{items}</{name}>"
        if x < 0.85:
            rows = "".join("<tr>" + "".join(f"<{c}>{i}</{c}>" for i in inner) + "</tr>" for c in ("th", "td"))
            return f"<table>{rows}</table>"
        return f"<h{r.randint(1, 5)}>{w}</h{r.randint(1, 5)}>" + "\n".join(inner) if r.random() < 0.3 else (lambda k: f"<h{k}>{w}</h{k}>\n" + "\n".join(inner))(r.randint(1, 5))

    def script(self) -> None:
        """A script or style sheet, whose text is no content."""
        r, w = self.rng, self.words(1, 1)
        name = r.choice(("script", "style"))
        body = r.choice((f"var {w} = {{a: 1}};\nfunction go() {{ return {w}; }}", f"window.{w} = window.{w} || [];")) if name == "script" else f".{w} {{ color: red; margin: 0 }}\nbody {{ font: {w} }}"
        start = len(self.text)
        self.put(f"<{name}>{body}</{name}>", "html")
        self.spans.append((start + len(name) + 2, len(self.text) - len(name) - 3, ""))

    def wrapped(self, kind: str) -> None:
        """Markup of another kind within an element."""
        a, b = self.rng.choice((("<details>\n", "\n</details>"), ("<div>\n\n", "\n\n</div>"), ("<b>", "</b>"), ("<p>", "</p>"), ("<li>", "</li>"), ("<blockquote>\n", "\n</blockquote>"), ("<td>", "</td>"), ("<span>", "</span>")))
        start = len(self.text)
        self.text += a
        self.sentence([kind, kind, "html"], 0.05)
        self.text = self.text.rstrip() + b
        self.spans.append((start, len(self.text), "html"))

    def block(self, kind: str) -> None:
        if kind == "html" and self.rng.random() < 0.5:
            if self.rng.random() < 0.15:
                self.script()
            else:
                self.put(self.element(), kind)
            return
        r, w = self.rng, self.words(1, 3).capitalize()
        x = r.random()
        code = f"x = {w.split()[0]}[1]\nif a < b: return '''{w}''' # {w}"
        if kind == "html":
            body = [f"<h2>{w}</h2>", f"<ul>\n  <li>{w}\n  <li>{w}</li>\n</ul>", f"<p>{w}</p>", f"<pre><code>{w} &lt;x&gt; **{w}**</code></pre>", f"<table border=1><tr><td>{w}</td></tr></table>", f"<!-- {w} -->", f"<details>\n<summary>{w}</summary>\n{w}\n</details>", f'<div class="n">{w}</div>', "<hr>"]
        elif kind == "markdown":
            body = [f"{'#' * r.randint(1, 5)} {w}", f"## {w} ##", f"{w}\n{'=' * r.randint(4, 20)}", f"{w}\n{'-' * r.randint(4, 20)}", f"```python\n{code}\n```", f"~~~\n{code}\n~~~", f"| {w} | {w} |\n|---|---:|\n| {w} | 5 |", "[ref]: https://x.example/p"]
        elif kind == "wiki":
            k = "=" * r.randint(2, 5)
            body = [f"{k} {w} {k}", f"{k}{w}{k}", f'{{| class="n"\n! {w} !! {w}\n|-\n| {w} || 5\n|}}', f"[[Category:{w}]]", f"{{{{infobox|a={w}|2}}}}", f"'''{w}''' {self.words()}"]
        else:
            body = [f"\\section{{{w}}}\\label{{sec:a}}", f"\\subsection*{{{w}}}", f"\\begin{{itemize}}\n  \\item {w}\n\\end{{itemize}}", "\\begin{equation}\n  x = \\frac{1}{n}\n\\end{equation}", f"\\begin{{verbatim}}\n{code}\n\\end{{verbatim}}", "\\[ \\sqrt{x^2} \\]", "$$\\frac{1}{n}$$", "\\maketitle"]
        self.put(body[int(x * len(body))], kind)


def page(rng: random.Random) -> tuple[str, str, list[tuple[int, int, str]]]:
    """(dialect, text, spans of markup with their kind)."""
    p = _Page(rng)
    p.refs = False
    dialect = rng.choices(("plain", "html", "markdown", "wiki", "latex"), (3, 2, 4, 2, 2))[0]
    own = [] if dialect == "plain" else [dialect]
    kinds = own * 4
    if rng.random() < 0.2:  # strays of another kind
        kinds.append(rng.choice(("html", "markdown", "wiki", "latex")))
    if dialect == "markdown" and rng.random() < 0.3:
        kinds += ["html", "latex"]
    literals = 0.5 if dialect == "plain" else 0.12
    for _ in range(rng.randint(1, 6)):
        if own and rng.random() < 0.5:
            if dialect != "html" and rng.random() < 0.1:
                p.wrapped(dialect)
            else:
                p.block(dialect)
        elif rng.random() < 0.15:
            p.put(rng.choice(_LITERALS))
        else:
            if rng.random() < 0.3:
                p.put(rng.choice(("- ", "* ", "1. ", "> ", "- [ ] ")))
            p.sentence(kinds, literals)
            p.text = p.text.rstrip()
        p.put("\n\n")
    if p.refs:
        p.put("[ref]: https://x.example/p", "markdown")
    return dialect, p.text, p.spans


def main(pages: int = 4000, seed: int = 5) -> None:
    from sedimenta.llm.markup import Model

    rng, model = random.Random(seed), Model()
    for _ in range(pages):
        model.learn(*page(rng))
    with open(os.path.join(os.path.dirname(__file__), "markup_weights.json"), "w") as out:
        out.write(model.to_json())


if __name__ == "__main__":
    main()
