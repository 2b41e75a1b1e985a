"""One form for texts that look the same.

A text is brought to its canonical form in three steps, all of which keep what the eye can tell apart
(case, digits, accents, raised figures, quotation marks):

1. Invisible characters go; every kind of space becomes a space, CRLF a line feed.
2. Full-width, half-width and ligature forms are replaced by the letters they show, and the text is
   composed (NFC). Quick-check properties isolate the unstable segments first: a character that is
   inert under composition and is no such form is stable, so only runs of other characters, with the
   starter before and the character after them, are normalised and spliced into the unchanged text.
3. Look-alike letters of Latin, Greek, Cyrillic, Armenian, Cherokee and Lisu become one letter: within a
   word the script that owns a letter without a twin decides (Latin if none does). Latin letters that are
   drawn as others, and signs that are drawn as ASCII ones, are replaced wherever they stand.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.sources.shared import checkpoint
from sedimenta.sources.tables import spread, table

# Letters of other scripts that are drawn like a Latin letter, and that letter below each.
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXocj"
CYRILLIC = "АВЕЅІЈКМНОРСТХаеорсухѕіјһԁԛԝ"
CYRILLIC_AS = "ABESIJKMHOPCTXaeopcyxsijhdqw"
ARMENIAN = "ՍՕՏԼհոսցօզ"
ARMENIAN_AS = "UOSLhnugoq"
CHEROKEE = "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ"
CHEROKEE_AS = "ABCDEGHJKLMPRSTVWZ"
LISU = "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ"
LISU_AS = "ABCDEFGHIJKLMNOPRSTUVWXYZ"
#: Latin letters drawn like others, and signs drawn like ASCII signs.
SAME = "ɑɡƖǀꓸꞌʼʹ․∶꞉ː։∕⁄ǃꜝ"
SAME_AS = "aglI.’’'.:::://!!"
#: Hyphens that are drawn like the hyphen-minus.
HYPHENS = "\u2010\u2011"
#: Characters without a glyph (format controls, soft hyphen, fillers, variation selectors).
INVISIBLE = r"\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb\U000e0000-\U000e0fff"

_SCRIPTS = {
    "\u0370-\u03ff": dict(zip(GREEK, GREEK_AS, strict=True)), "\u0400-\u052f": dict(zip(CYRILLIC, CYRILLIC_AS, strict=True)), "\u0531-\u0587": dict(zip(ARMENIAN, ARMENIAN_AS, strict=True)),
    "\u13a0-\u13f5": dict(zip(CHEROKEE, CHEROKEE_AS, strict=True)), "\ua4d0-\ua4f7": dict(zip(LISU, LISU_AS, strict=True)),
}
_TWIN = {c: a for letters in _SCRIPTS.values() for c, a in letters.items()}
_TO_LATIN = str.maketrans(_TWIN)
_SAME = str.maketrans(dict(zip(SAME, SAME_AS, strict=True)))
_HAS_SAME = re.compile(f"[{re.escape(SAME)}]")


def _to_script(letters: dict[str, str]) -> dict[int, str]:
    """Latin letters, and those of other scripts that look like them, as letters of one script."""
    own = {a: c for c, a in letters.items()}
    return str.maketrans(own | {c: own[a] for c, a in _TWIN.items() if a in own and c not in letters})


#: A joiner inside an emoji sequence is visible: it makes one picture of two.
_PICTURE = r"\u2600-\u27bf\U0001f300-\U0001faff"
_INVISIBLE = re.compile(f"(?<![{_PICTURE}\ufe0f])\u200d|\u200d(?![{_PICTURE}])|(?!\u200d)[{INVISIBLE}]")
_SPACE = re.compile(r"[\t\x0b\x0c\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_NEWLINE = re.compile(r"\r\n?|[\x85\u2028\u2029]")
_OTHER = "".join(_SCRIPTS)
_LETTER = r"A-Za-z\u00aa-\u024f\u0300-\u036f" + _OTHER
_WORD = re.compile(f"[{_LETTER}]*[{_OTHER}][{_LETTER}]*")
_PURE = re.compile("|".join(f"[{r}]+" for r in _SCRIPTS))
#: Composed letters whose base has a twin: their script does not show by themselves.
_HAS_TWIN_MARK = re.compile("[" + "".join(c for c in map(chr, range(0x370, 0x530)) if (d := unicodedata.normalize("NFD", c)) != c and d[0] in _TWIN) + "]")
#: Of each script a letter without a twin, and its letters for those of others; Cyrillic comes first.
_OWNED = [(re.compile(f"(?![{''.join(letters)}])[{r}]"), _to_script(letters)) for r, letters in sorted(_SCRIPTS.items(), key=lambda x: x[0] != "\u0400-\u052f")]
_LATIN_TWINS = frozenset(_TWIN.values())
_HAS_LATIN = re.compile("[" + "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" if c not in _LATIN_TWINS) + "\u00df-\u024f]")
#: Of a word whose other letters are of one script, Latin letters without a twin in it decide for Latin.
_LATIN_BESIDE = [(re.compile(f"[{r}]"), re.compile("[" + "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" if c not in set(letters.values())) + "\u00df-\u024f]")) for r, letters in _SCRIPTS.items()]


@lru_cache(maxsize=8192)
def _form(c: str) -> str | None:
    """What a presentation form shows, None if the character is no such form.

    Full-width, half-width and ligature forms only: a raised figure, a fraction or a sign such as the
    trade mark looks different from its letters.
    """
    d = unicodedata.decomposition(c)
    if d.startswith(("<wide>", "<narrow>")) or "ﬀ" <= c <= "ﬆ" or c in "ĲĳǇǈǉǊǋǌǱǲǳǄǅǆ":
        return unicodedata.normalize("NFKC", c)
    if "\u2160" <= c <= "\u217f":  # Roman numerals are drawn as the letters
        return unicodedata.normalize("NFKC", c)
    return "μ" if c == "µ" else None


@lru_cache(maxsize=1)
def _unstable() -> re.Pattern[str]:
    """Runs of characters that may change: forms, marks and whatever fails the quick check.

    Built from the character database once in a worker. Of the planes above the first, every
    character is taken as unstable; they are rare, and normalising a stable one changes nothing.
    """
    found = []
    for cp in [*range(0x80, 0x3400), *range(0xA640, 0xABF0), *range(0xF900, 0xFFF0)]:
        c = chr(cp)
        mark = unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Mc") or 0x1160 <= cp <= 0x11FF
        if mark or not unicodedata.is_normalized("NFC", c) or _form(c) is not None:
            found.append(re.escape(c))
    return re.compile(f"[{''.join(found)}]+(?:[\U00010000-\U0010ffff]+[{''.join(found)}]*)*|[\U00010000-\U0010ffff]+[{''.join(found)}]*")


def _splice(text: str) -> str:
    """Normalise the unstable segments, each with the starter before it, and splice them into the rest."""
    out, at = [], 0
    for m in _unstable().finditer(text):
        start = max(at, m.start() - 1)
        out.append(text[at:start])
        segment = text[start : m.end()]
        out.append(unicodedata.normalize("NFC", "".join(f if (f := _form(c)) is not None else c for c in segment)))
        at = m.end()
    out.append(text[at:])
    return "".join(out) if at else text


def _word(m: re.Match[str]) -> str:
    """A word with Greek or Cyrillic letters in the script that owns one of its letters; marks are looked at apart."""
    w = m.group()
    owned = any(p.search(w) for p, _ in _OWNED)
    if owned and _PURE.fullmatch(w) and not _HAS_TWIN_MARK.search(w):
        return w
    d = unicodedata.normalize("NFD", w)
    # letters that no script of the word can draw otherwise
    latin = _HAS_LATIN.search(d) or all(not there.search(d) or alone.search(d) for there, alone in _LATIN_BESIDE)
    if latin:
        d = d.translate(_TO_LATIN)
    else:
        d = d.translate(next((to for p, to in _OWNED if p.search(d)), _TO_LATIN))
    return unicodedata.normalize("NFC", d)


def canonical(text: str) -> str:
    """The one form of a text; a text in that form is its own. ASCII text without controls is returned as it is."""
    if text.isascii():
        if "\r" not in text and "\t" not in text and "\x0b" not in text and "\x0c" not in text:
            return text
        return _SPACE.sub(" ", _NEWLINE.sub("\n", text))
    text = _INVISIBLE.sub("", text)
    text = _SPACE.sub(" ", _NEWLINE.sub("\n", text))
    text = _splice(text)
    for h in HYPHENS:
        text = text.replace(h, "-")
    if _HAS_SAME.search(text):
        text = text.translate(_SAME)
    return _WORD.sub(_word, text)


def canonical_column(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text and canonical of every row; a null text stays null, an empty one empty. Repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [None if t is None else canonical(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.string())], names=["key", "text", "canonical"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(run, f"key {kind}, text string, canonical string")


def _digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, and digests of the text and of its canonical form, of rows with non-empty text."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, one = [], []
            for t in batch.column(1).to_pylist():
                raw = t.encode("utf-8", "surrogatepass")
                c = canonical(t)
                a = hashlib.blake2b(raw, digest_size=16).digest()
                own.append(a)
                one.append(a if c is t else hashlib.blake2b(c.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary()), pa.array(one, pa.binary())], names=["key", "own", "one"])

    kept = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).where(F.length("text") > 0)
    return kept.mapInArrow(run, "key long, own binary, one binary")


def lookalike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Membership: key, form, string, representative, n_rows and n_strings of rows that look like a row of another string.

    ``form`` and ``string`` are digests of the canonical form and of the text itself. Rows of one form look
    the same; rows of one string are copies, for which the one of smallest key stands; ``n_rows`` counts
    them, ``n_strings`` the different strings of the form. Rows with null or empty text, and forms of which all
    rows have one string, take no part. Texts are read and normalised once; only 16-byte digests are kept (in
    the shared folder) and shuffled, and copies are counted before they are.
    """
    return _members(checkpoint(df.sparkSession, _digests(df, key, text)))


def _strings(d: DataFrame) -> DataFrame:
    """One row for each string of the forms that have several: one, own, representative, n_rows."""
    strings = d.groupBy("one", "own").agg(F.min("key").alias("representative"), F.count("*").alias("n_rows"))
    mixed = strings.groupBy("one").agg(F.count("*").alias("n_strings")).where("n_strings > 1")
    return strings.join(mixed, "one")


def _members(d: DataFrame) -> DataFrame:
    return d.join(_strings(d), ["one", "own"]).select("key", F.col("one").alias("form"), F.col("own").alias("string"), "representative", "n_rows", "n_strings")


def class_pairs(members: DataFrame) -> DataFrame:
    """representative_a < representative_b, rows_a, rows_b: pairs of different strings that look the same, one for all their copies."""
    one = members.where("key = representative").select("form", "representative", "n_rows")
    a, b = one.alias("a"), one.alias("b")
    both = a.join(b, (F.col("a.form") == F.col("b.form")) & (F.col("a.representative") < F.col("b.representative")))
    return both.select(F.col("a.representative").alias("representative_a"), F.col("b.representative").alias("representative_b"), F.col("a.n_rows").alias("rows_a"), F.col("b.n_rows").alias("rows_b"))


def lookalike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id_a < doc_id_b: rows whose texts differ and have the same canonical form.

    Pairs of strings come first, one for all copies; then each side is replaced by its copies, so rows that
    are copies of each other never meet. The result has a row for each pair of rows, as many as there are:
    where strings have many copies, ``lookalike_classes`` and ``class_pairs`` say the same in fewer rows.
    """
    members = checkpoint(df.sparkSession, lookalike_classes(df, key, text))
    of = members.select("key", "representative")
    pairs = class_pairs(members).select("representative_a", "representative_b")
    left = pairs.join(of.select(F.col("key").alias("x"), F.col("representative").alias("representative_a")), "representative_a")
    both = left.join(of.select(F.col("key").alias("y"), F.col("representative").alias("representative_b")), "representative_b")
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).where("doc_id_a < doc_id_b")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that look the same and are not the same string."""
    return lookalike_pairs(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that look like others, with the class of equal strings that each is in."""
    found = lookalike_classes(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return found.select(F.col("key").alias("doc_id"), "representative", "n_rows", "n_strings")


def p9_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical form of each document's text."""
    return canonical_column(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text").select(F.col("key").alias("doc_id"), "canonical")


QUERIES = {"p9_found": p9_found, "p9_classes": p9_classes, "p9_canonical": p9_canonical}
ORACLES: dict[str, str] = {}
