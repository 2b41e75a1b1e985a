"""Personal information in free text, found by a semi-Markov conditional random field.

Candidate segments of a text (whole spans of bounded length, of one type each) are scored by features
of the whole span: its form, its parts, its checksum, the words before and after it. Every span of two
to four adjacent capitalised words or initials is a candidate name; whether its words are everyday words,
and how they begin and end, are features like others, as is a list of given names. A labelling is a
set of segments that do not overlap, with everything between them outside; its weight is the
exponential of the segments' scores and of the scores of neighbouring types. Dynamic programming over
the segments' ends finds the best labelling, so boundaries and types are chosen jointly: a number is a
phone, an identity number or part of an address, never two of them. Texts fall into independent
windows where no segment is near. The weights are trained by maximum likelihood (``pii_train``) on
invented labelled lines; forward and backward sums run over the same lattice.
"""

from __future__ import annotations

import base64
import json
import math
import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.sources.tables import spread, table

TYPES = ("email", "phone", "id_number", "address", "name")
#: Segments further apart than this many characters don't influence each other.
WINDOW = 80
#: A segment has at most so many characters.
LONGEST = 160
#: A name has at most so many words, particles such as "van" not counted.
NAME_WORDS = 4
#: Public vocabularies whose lower-case words count as everyday words.
VOCABULARIES = "/opt/tokenizers"
EVERYDAY = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")

# Given names.
GIVEN = frozenset(
    """adam ahmed aisha alejandro alessandro alice amara amelia amina andrea andreas anita anna antonio aria arjun astrid birgit bruno
    camille carlos carmen catherine chiara chloe chloé christian clara claudia claire daniel david deepa diego dmitri eduardo elena
    elias elise emil emilia emma erik esther eva fatima felix fernando florian franz fatou gabriel georg giulia greta hana hannah hans
    hassan heidi helena henrik hugo ibrahim ines ingrid irene isabel ivan jack jakob jan javier jean jens jonas josé jose juan julia
    julien jürgen karim karin katarina kenji klaus kofi lars laura layla leila lena leonardo linda lisa louis luca lucas lucia luis
    lukas magnus malik manuel marco maria marie marta martin mateo matteo michael miguel mohammed monika nadia natalia nicolas nina noor
    olga olivia omar oskar pablo paul pavel pedro peter petra philip pierre priya rafael rania ravi ricardo robert rosa ruben samir
    samuel sandra sara sarah sebastian simon sofia sophie søren stefan sven tariq thomas tomas tomás ulrike viktor wei xavier yasmin
    yuki yusuf zoe zoë""".split()
)
# Endings of family names.
ENDINGS = tuple(
    """mann sen son ssen stedt quist berg burg garth hurst well brecht oldt holt wick row vane ardo elli etti ini eau inski inska ski ska
    ová ova ov ev enko escu ez berger dottir ström gren lund dahl stein feld bach hoff sson ton ley ham ford worth wood man""".split()
)
_PARTICLES = "van|von|de|da|del|della|der|di|la|le|bin|ibn|al|ten|zu|zur|af|dos"
# Types of streets.
_STREET = (
    "street|st|avenue|ave|road|rd|lane|ln|drive|dr|close|court|ct|way|terrace|place|pl|square|sq|crescent|boulevard|blvd|row|gardens|grove|hill|mews"
    "|parkway|pkwy|highway|hwy|circle|cir|plaza|trail|loop|alley|quay|walk|rise|parade|esplanade|promenade|wharf|turnpike|crossing|ridge|heights|green|park|bypass|embankment|broadway"
)
_W = r"[^\W\d_][\w’'\-]*"
_CAP = r"[A-ZÀ-ÖØ-Þ](?:[^\W\d_]|[’'\-])+"
_CITY = rf"{_CAP}(?: {_CAP}){{0,2}}"
_TOWN_FIRST = frozenset("new old san santa santo saint sainte st bad los las la le el port north south east west den great upper lower".split())
_UK = r"[A-Z]{1,2}\d{1,2}[A-Z]? ?\d[A-Z]{2}"
_SEP = r"(?:, ?|\r?\n[ \t>]*| )"

_EMAIL_LEFT = re.compile(r"[\w.+%'\-]+$")
_EMAIL_RIGHT = re.compile(r"[^\W_](?:[\w\-]*[^\W_])?(?:\.[^\W_](?:[\w\-]*[^\W_])?)+")
_AT = re.compile(r"(?i)(?<=[\w.+\-])(?:[ ]?[\[({<][ ]?at[ ]?[\])}>][ ]?|[ ]at[ ]|＠|[ ]@[ ])")
_DOTTED = re.compile(r"(?i)[\w\-]+(?:(?:[ ]?[\[({][ ]?dot[ ]?[\])}][ ]?|[ ]dot[ ]|\.)[\w\-]+)+")
_DIGITS = re.compile(r"(?<![\w])(?:\+|\(\+?|00)?\d[\d ()./\-]{4,}\d(?:,?[ ]?(?:ext\.?|extension|x|poste|Durchwahl|DW)[ ]?\d{1,5})?", re.I)
_GROUP = re.compile(r"\d+")
_ID_CODE = tuple(
    re.compile(rf"(?<![\w\-])(?!(?:DNI|SSN|NIE|NIF|NI|ID)\b)(?:{p})(?![\w\-])")
    for p in (r"[A-Z]{1,2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]", r"[A-Z]{1,2}\d{6,9}", r"\d{7,8}-?[A-Z]", r"[A-Z]\d[A-Z]\d{6}\d?", r"[A-Z]{1,3}-\d{2,4}-\d{2,4}(?:-\d{2,4})?", r"(?=[A-Z]*\d[A-Z0-9]*\d)[A-Z][A-Z0-9]{7,13}")
)
_ID_WORD = re.compile(
    r"passport|passeport|pasaporte|reisepass|passaporto|identity|\bid (?:no|number|nr)|id[- ]card|identification|personalausweis|ausweis|carte d'identité|dni\b|\bnie\b|\bnif\b|social|sozialversicherung|ssn\b|sécurité|seguridad|insurance|nino\b"
    r"|\bni\b|national|versicherten|steuer|tax id|\bcpf\b|codice fiscale|pesel|personnummer",
    re.I,
)
_PHONE_WORD = re.compile(r"tel\b|tel[.:]|phone|mobile|mobil|call|cell|handy|fax|sms|number|numéro|nummer|rückruf|anruf|portable|teléfono|móvil|dial|whatsapp|line|reach|unter", re.I)
_NOT_NUMBER = re.compile(r"(?:epoch|build|version|v|port|ports|pid|trace|id|chunk|rows?|line|code|entries|gave|release|rev|commit|0x[\da-f]*|#|=|\$|€|£)[ :]*$", re.I)
_ADDRESS_WORD = re.compile(r"address|adresse|dirección|live|ship|lives|lieferung|invoice|office|deliver|post|send|goes to|street|home|geocoder|board|visit|moved", re.I)
_TYPES_OF_STREET = "|".join(f"{t}|{t.title()}|{t.upper()}" for t in _STREET.split("|"))
# The words of addresses, for the patterns and for the gates before them.
_WAY = r"rue|avenue|av\.|boulevard|bd|place|chemin|impasse|allée|allee|quai|cours|route|via|viale|corso|piazza"
_CALLE = r"calle|c/|avenida|avda\.?|plaza|paseo|carrer|rua"
_END = r"straße|strasse|str\.|weg|platz|gasse|allee|ring|damm|ufer|plein|straat|laan|gracht|kade|gatan|vägen|gade|vej"
_BOX = r"p\. ?o\. ?box|po box|post(?: office)? box|postfach|postbus|apartado(?: de correos)?|casilla|boîte postale|b\.?p\.?|c\.?p\.?"
_FLAT = r"flat|apt\.?|apartment|unit|suite|room"
_ADDRESS = (
    ("number_street", re.compile(rf"(?<![\w.])\d{{1,5}}[a-zA-Z]?(?: bis| ter)?,? (?:{_CAP} ){{1,3}}(?:{_TYPES_OF_STREET})\b\.?(?:{_SEP}{_CITY}(?:,? (?:{_UK}|[A-Z]{{2}} \d{{5}}|\d{{3,6}}))?)?")),
    ("rue", re.compile(rf"(?<![\w.])\d{{1,4}}(?: ?(?:bis|ter|[a-d]))?,? (?i:{_WAY}) (?i:(?:de la|de l'|du|des|de|d') ?)?{_W}(?: {_CAP}){{0,2}}(?:,? (?:\d{{5}} )?{_CITY})?")),
    ("calle", re.compile(rf"(?<![\w])(?i:{_CALLE}) ?(?i:(?:de la|del|de|dos|da) )?{_W}(?: {_CAP}){{0,2}},? (?i:número |num\. |nº |n° )?\d{{1,4}}(?:, \d{{1,2}}[ºª] ?[A-Z]?)?(?:, (?:\d{{5}} )?{_CITY})?")),
    ("strasse", re.compile(rf"(?<![\w])(?:{_CAP}[ \-])?{_CAP}(?i:{_END}) ?\d{{1,4}}(?: ?[a-z]\b)?(?:,? (?:\d{{4}} [A-Z]{{2}}|\d{{4,5}}) {_CITY})?")),
    ("box", re.compile(rf"(?<![\w])(?i:{_BOX}) ?(?i:n[º°o]\.? ?)?\d{{1,6}}(?:,? (?:\d{{4,5}} )?{_CITY})?")),
    ("flat", re.compile(rf"(?<![\w])(?i:{_FLAT}) ?#?\d{{1,4}}[a-z]?, ?(?:\d{{1,4}}[a-z]? )?(?:{_CAP} ){{1,3}}(?:House|house|{_TYPES_OF_STREET})\b\.?(?:{_SEP}{_CITY}(?:,? (?:{_UK}|\d{{4,6}}))?)?")),
)
#: A numbered place of any words in a town: its words need not be of a known kind.
_PLAIN_ADDRESS = re.compile(rf"(?<![\w.])\d{{1,5}}[a-zA-Z]?,? (?:{_CAP} ){{1,3}}{_CAP}, {_CITY}(?:,? (?:{_UK}|[A-Z]{{2}} \d{{5}}|\d{{4,6}}))?(?!\w)")
_ADDRESS_SIGN = re.compile(
    rf"(?i)\d[a-z]?(?: bis| ter)?,? (?:[^\W\d_][\w’'\-]* ){{1,3}}(?:{_STREET})\b|\d(?: ?(?:bis|ter|[a-d]))?,? (?:{_WAY}) |(?<!\w)(?:{_CALLE}) ?\w"
    rf"|[\w’'\-](?:{_END}) ?\d|(?<!\w)(?:{_BOX}) ?(?:n[º°o]\.? ?)?\d|(?<!\w)(?:{_FLAT}) ?#?\d"
)
#: Words with which an address may begin, be part of it, or end a part of it: any text with an address has one.
_ADDRESS_WORDS = frozenset(re.findall(r"[^\W\d_]+", f"{_STREET} {_WAY} {_FLAT}".lower())) | frozenset("c b p bp cp pn bn cn bpn cpn".split())
_ADDRESS_STARTS = tuple(re.findall(r"[^\W\d_]{3,}", f"{_CALLE} box postfach postbus apartado casilla boîte"))
_ADDRESS_ENDS = tuple(re.findall(r"[^\W\d_]+", _END))
_LETTERS = re.compile(r"[^\W\d_]+").findall
#: Any identity code holds one of these.
_ID_GATE = re.compile(r"\d{3}(?:-?\d{3}|-\d)|\d\d[ \-]?\d\d[ \-]?\d\d|[A-Z]\d[A-Z]\d|\d-\d\d\d?-\d|[A-Z]-\d\d|\d[A-Z]+\d")
_NAME_WORD = re.compile(r"[^\W\d_][^\W\d_’']*(?:[’'\-][^\W\d_]+)*")
_INITIAL = re.compile(r"(?<![\w.@/+\-])[A-ZÀ-Þ]\.(?:[ -]?[A-ZÀ-Þ]\.)* ?(?:(?:%s) )?(?=[A-ZÀ-Þ][\w’'\-]{2})" % _PARTICLES)
_NAME_AT = re.compile(
    rf"(?P<first>{_W})(?P<middle>(?: [A-ZÀ-Þ]\.)*)(?P<part>(?: (?:{_PARTICLES}))*) (?P<last>[^\W\d_][^\W\d_’']*(?:[’'\-][^\W\d_]+)*)", re.I
)
_TITLE = re.compile(r"(?:^|\W)(?:dr|prof|mr|mrs|ms|herrn?|frau|señora?|sra?|mme|m|ing|sir|madame|monsieur|doña|don)\.? $", re.I)
#: Words that are followed by whoever does, gets or says something.
_AGENT = re.compile(
    r"(?:^|\W)(?:by|from|to|for|with|and|or|cc|thanks|thank|ask|asked|ping|poke|meet|met|call|called|says?|said|told|asks|wrote|per|via|after|hi|hello|hey|dear|regards|cheers|sincerely|greetings|von|mit|an|laut|durch|danke|gruß|grüße"
    r"|merci à|gracias a|avec|par|selon|de|à|con|por|según|para|goes to|on \w+day)(?::|,|\s)\s*$",
    re.I,
)
#: Roles, with or without a sign that a value follows.
_ROLE = re.compile(r"(?:author|owner|maintainer|reporter|assignee|assigned|reviewer|contact|customer|client|patient|user|name|member|employee|manager|sender|recipient|attn|-by)s?(?: is| was|)(?:[ :=>]+[\[(\"']*| - | )$", re.I)
_SAYS = re.compile(r"(?i)^,? (?:says?|said|asks?|asked|wrote|writes|schrieb|sagte|meint|dit|a dit|dijo|has|had|is|was|reported|found|noticed|replied|called|wants|told|thinks|and I)\b|^'s |^’s ")
_CARD = re.compile(r"^(?:,| \(|:|\n)\s*(?:passport|ssn|dni|nie|id\b|social|national|tel|phone|mobile|personal|numéro|p\.?o|\+?\(?\d|[\w.]+@)|^ <|^\" <", re.I)
_HANDLE = re.compile(r"^(?: [(@<]|, \+|: \+)")
#: A family name before initials.
_LAST_INITIALS = re.compile(r"(?<![\w@/.])[A-ZÀ-Þ][\w’'\-]{2,}, (?:[A-ZÀ-Þ]\.[ -]?)+")
_BAD_LAST = frozenset("street st avenue road lane drive house terrace court box the and for with from this that when says".split())
_CAPITAL = r"[A-ZÀ-ÖØ-Þ](?:(?:[^\W\d_]|[’'\-](?=[^\W\d_]))+|\.(?!\w)|(?!\w))"
#: Adjacent capitalised words and initials, with particles and commas between them.
_CAPITALS = re.compile(rf"(?<![\w@/.+\-]){_CAPITAL}(?:,? (?:(?:{_PARTICLES}) )*{_CAPITAL})+")
_PART = re.compile(rf"(?P<sep>,? )(?P<part>(?:(?:{_PARTICLES}) )*)(?={_CAPITAL})")
_ONE_CAPITAL = re.compile(_CAPITAL)
#: Signs of markup around a heading, a cell or an emphasised term.
_HEADING_LEFT = re.compile(r"(?:^[ \t]*(?:#+|=+)|\||!|'''|\*\*|__|<\w+[^<>]*>|\\\w+\{)[ \t]*$")
_HEADING_RIGHT = re.compile(r" ?(?:\r?\n(?:==|--)|=|[|#}]|</|\]\]|'''|\*\*|!!)")
_CONTRACTED = re.compile(r"[’'](?:ll|ve|re|d|m|t|LL|VE|RE|D|M|T)$")
#: Words of German sentences, where any noun is capitalised.
_GERMAN = frozenset("und der die das nicht ist mit für ein eine einen auf den dem von zu wird sich auch bei wenn oder nach im".split())


class Segment:
    __slots__ = ("end", "features", "score", "start", "type")

    def __init__(self, start: int, end: int, type_: str, features: list[str]):
        self.start, self.end, self.type, self.features, self.score = start, end, type_, features, 0.0


def _before(text: str, a: int, n: int = 34) -> str:
    s = text[max(0, a - n) : a]
    k = s.rfind("\n")
    return s[k + 1 :] if k >= 0 and s[k + 1 :].strip() else s


def _emails(text: str) -> Iterator[Segment]:
    at = text.find("@")
    while at >= 0:
        left = _EMAIL_LEFT.search(text, max(0, at - 64), at)
        right = _EMAIL_RIGHT.match(text, at + 1)
        if left and right and right.end() - at <= 100:
            a, b = left.start(), right.end()
            while a < at and text[a] in ".-'":
                a += 1
            if text[a:at].lower().startswith("mailto:"):
                a += 7
            local, host = text[a:at], right.group()
            f = ["email", "email:plain"]
            if host[0].isdigit():
                f.append("email:version")
            if local.lower() in ("git", "hg", "svn", "ssh"):
                f.append("email:tool")
            if text[b : b + 1] == ":" and text[b + 1 : b + 2].strip():
                f.append("email:path")
            if a > 0 and text[a - 1] in "/@:" and text[max(0, a - 7) : a].lower() != "mailto:":
                f.append("email:glued")
            if not host.rsplit(".", 1)[-1].isalpha():
                f.append("email:tld")
            if local:
                yield Segment(a, b, "email", f)
        at = text.find("@", at + 1)
    for m in _AT.finditer(text):
        left = _EMAIL_LEFT.search(text, max(0, m.start() - 64), m.start())
        right = _DOTTED.match(text, m.end())
        if not left or not right or right.end() - left.start() > LONGEST:
            continue
        spoken = m.group().strip().lower() == "at"
        dotted = bool(re.search(r"(?i)dot", right.group()))
        f = ["email", "email:spelled"]
        if spoken and not dotted:
            f.append("email:at_only")  # "look at file.name"
        if dotted:
            f.append("email:dot")
        if not re.fullmatch(r"[A-Za-z]{2,}", re.split(r"[^\w]+", right.group())[-1]):
            f.append("email:tld")
        yield Segment(left.start(), right.end(), "email", f)


def _numbers(text: str) -> Iterator[Segment]:
    """Phones and identity numbers: runs of digit groups, whole or without groups at their ends."""
    for m in _DIGITS.finditer(text):
        run = m.group()
        total = sum(map(str.isdigit, run))
        if total < 7:
            continue
        groups = [(g.start(), g.end()) for g in _GROUP.finditer(run)]
        spans = {(0, len(groups))}
        if len(groups) > 1 and total > 9:
            spans |= {(i, len(groups)) for i in range(1, min(4, len(groups)))} | {(0, len(groups) - i) for i in range(1, min(3, len(groups)))}
        for i, j in spans:
            a, b = groups[i][0], groups[j - 1][1]
            while a > 0 and run[a - 1] in "(+":
                a -= 1
            if j == len(groups):
                b = len(run)
            if run[a:b].count("(") > run[a:b].count(")"):
                a += 1
            s = run[a:b].strip()
            a += len(run[a:b]) - len(run[a:b].lstrip())
            core = re.split(r"(?i),?[ ]?(?:ext|x|poste|durch|dw)", s)[0]
            digits = sum(map(str.isdigit, core))
            if not 7 <= digits <= 15:
                continue
            yield from _number(text, m.start() + a, m.start() + a + len(s), core, digits, (i, j) == (0, len(groups)))


def _number(text: str, a: int, b: int, s: str, digits: int, whole: bool) -> Iterator[Segment]:
    form = re.sub(r"\d", "9", s)
    groups = form.replace("(", " ").replace(")", " ").replace(".", " ").replace("-", " ").replace("/", " ").split()
    left = _before(text, a)
    f = ["phone"]
    plus = s.startswith(("+", "(+", "00"))
    if plus:
        f.append("phone:international")
    elif s[0] == "0" or s.startswith("(0"):
        f.append("phone:trunk")
    elif s[0] == "(":
        f.append("phone:area")
    else:
        f.append("phone:bare")
    f.append(f"phone:digits{'<9' if digits < 9 else '>13' if digits > 13 else '9-13'}")
    f.append(f"phone:groups{min(len(groups), 5)}")
    if [len(g) for g in groups[-3:]] == [3, 3, 4]:
        f.append("phone:3-3-4")
    if len(groups) == 1 and not plus:
        f.append("phone:solid")
    if not whole:
        f.append("phone:part")
    if re.fullmatch(r"(?:19|20)\d\d[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12]\d|3[01])(?!\d).*|(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)\d\d(?!\d).*", s):
        f.append("phone:date")
    if re.match(r":\d\d", text[b : b + 3]) or re.search(r"\d[:T]$", text[max(0, a - 2) : a]):
        f.append("phone:clock")
    if re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", s):
        f.append("phone:ip")
    if re.fullmatch(r"\d+(?:\.\d+){1,3}", s) and len(groups[-1]) < 4:
        f.append("phone:version")
    if re.fullmatch(r"\d{4}(?: \d{4})+", s):
        f.append("phone:fours")
    if re.fullmatch(r"\d+-\d+", s) and s[0] != "0":
        f.append("phone:two")
    if text[max(0, a - 4) : a].lower() == "tel:" or _PHONE_WORD.search(left):
        f.append("phone:word")
    if _NOT_NUMBER.search(left):
        f.append("phone:not")
    if a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_$#=/\\" and text[max(0, a - 4) : a].lower() != "tel:"):
        f.append("phone:glued")
    if b < len(text) and (text[b].isalnum() or text[b] in "_%" or text[b : b + 2] in (" r", "px", " m", " k") and re.match(r" (?:rows|ms|kb|mb)\b", text[b : b + 6])):
        f.append("phone:unit")
    if _ID_WORD.search(left):
        f.append("phone:id_word")
    yield Segment(a, b, "phone", f)
    g = ["id", "id:digits"]
    if re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}", s):
        g.append("id:3-2-4" + ("" if "-" in s else ":space"))
    elif re.fullmatch(r"[123478] ?\d\d ?\d\d ?\d[\dAB] ?\d{3} ?\d{3}(?: ?\d\d)?", s):
        g.append("id:nir")
    elif len(groups) == 1:
        g.append("id:solid")
    else:
        g.append("id:other")
    if _ID_WORD.search(left):
        g.append("id:word")
        g.append(g[2] + ":word")
    elif _PHONE_WORD.search(left):
        g.append("id:phone_word")
    if plus or s[0] in "(":
        g.append("id:phone_form")
    if not whole:
        g.append("id:part")
    g += [x.replace("phone", "id") for x in f if x in ("phone:date", "phone:clock")]
    if _NOT_NUMBER.search(left):
        g.append("id:not")
    yield Segment(a, b, "id_number", g)


def _codes(text: str) -> Iterator[Segment]:
    if not _ID_GATE.search(text):
        return
    for m in sorted((m for p in _ID_CODE for m in p.finditer(text)), key=lambda m: m.span()):
        s = m.group()
        if sum(map(str.isdigit, s)) < 6:
            continue
        left = _before(text, m.start())
        f = ["id", "id:code"]
        bare = re.sub(r"[ \-]", "", s)
        if re.fullmatch(r"\d{8}[A-Z]", bare):
            f.append("id:dni" if "TRWAGMYFPDXBNJZSQVHLCKE"[int(bare[:8]) % 23] == bare[8] else "id:dni_like")
        elif re.fullmatch(r"[A-Z]{2}\d{6}[A-D]", bare):
            f.append("id:nino")
        elif re.fullmatch(r"[A-Z]{1,2}\d{6,8}", bare) and bare == s:
            f.append("id:passport_form")
        elif re.fullmatch(r"[A-Z]{1,3}-\d{3}-\d{4}", s):
            f.append("id:card_form")
        else:
            f.append("id:other_code")
        if _ID_WORD.search(left):
            f.append("id:word")
            f.append("id:code:word")
        if _NOT_NUMBER.search(left):
            f.append("id:not")
        yield Segment(m.start(), m.end(), "id_number", f)


def _addresses(text: str, words: set[str]) -> Iterator[Segment]:
    for m in _PLAIN_ADDRESS.finditer(text):
        if m.end() - m.start() <= LONGEST:
            yield from _address(text, "number_words", m.start(), m.end())
    # every form of address has one of these words; most texts have none
    words = words.union(*(_LETTERS(w) for w in words if not w.isalpha()))
    if _ADDRESS_WORDS.isdisjoint(words) and not any(w.endswith(_ADDRESS_ENDS) or w.startswith(_ADDRESS_STARTS) for w in words):
        return
    for sign in _ADDRESS_SIGN.finditer(text):
        lo = max(0, sign.start() - 60)
        hi = min(len(text), sign.end() + LONGEST)
        for name, pattern in _ADDRESS:
            for m in pattern.finditer(text, lo, hi):
                if m.start() > sign.end() or m.end() < sign.start() or m.end() - m.start() > LONGEST:
                    continue
                yield from _address(text, name, m.start(), m.end())
                # the words of a town may run into the sentence after it
                town = re.search(rf"(?:[,\n]|\d|[A-Z]{{2}}) ?({_CITY})$", m.group())
                k = town[1].count(" ") if town else 0
                for cut in range(1, k + 1):
                    yield from _address(text, name, m.start(), m.start() + len(m.group().rsplit(" ", cut)[0]))


def _address(text: str, name: str, a: int, b: int) -> Iterator[Segment]:
    left = _before(text, a)
    s = text[a:b]
    f = ["address", f"address:{name}"]
    town = re.search(rf"(?:[,\n]|\d|[A-Z]{{2}}) ?({_CITY})(?:,? (?:{_UK}|[A-Z]{{2}} \d{{5}}|\d{{3,6}}))?$", s)
    if town:
        words_of = town[1].split(" ")
        f.append(f"address:town{len(words_of)}")
        if len(words_of) > 1 and words_of[0].lower() in _TOWN_FIRST:
            f.append("address:town_first")
    if re.search(r"\d{4,6}(?!.*\d)|" + _UK, s):
        f.append("address:postcode")
    if "," in s or "\n" in s:
        f.append("address:city")
    if _ADDRESS_WORD.search(left):
        f.append("address:word")
    if re.search(r"(?i)\b(?:line|theme|lane|chapter|page|row|step|version)\b[ ,]*$", left) or re.match(r"(?i)[ ,]*theme", text[b : b + 8]):
        f.append("address:not")
    after = text[b : b + 12]
    if re.match(r",? ?(?:[A-ZÀ-Þ][a-zà-ÿ]|\d)|-\w", after):
        f.append("address:cut" if re.match(r",|-", after) else "address:more")
    if re.search(r"(?i)(?:flat|apt\.?|apartment|unit|suite) ?#?\d+[a-z]?, ?$", left):
        f.append("address:flat_before")
    words = re.findall(r"[^\W\d_]{2,}", s)
    if words and not any(w[0].isupper() for w in words):
        f.append("address:lower")
    f.append("address:long" if len(s) > 24 else "address:short")
    yield Segment(a, b, "address", f)


@lru_cache(maxsize=2)
def everyday_words(folder: str = VOCABULARIES, names: tuple[str, ...] = EVERYDAY) -> frozenset[str]:
    """Words that stand in lower case, with a blank before them, in a public vocabulary (read on the driver, about 35,000)."""
    found = set()
    for name in names:
        with open(os.path.join(folder, name), "rb") as f:
            for line in f:
                raw = base64.b64decode(line.split()[0]) if line.strip() else b""
                if raw[:1] == b" ":
                    w = raw[1:].decode("utf-8", "ignore")
                    if len(w) > 2 and w.isalpha() and w.islower():
                        found.add(w)
    return frozenset(found)


def _kind(word: str, everyday: frozenset[str]) -> str:
    """What a word looks like by itself: given name, initial, everyday word, or none of these."""
    low = word.lower()
    if len(word) <= 2 and (len(word) == 1 or word[1] == "."):
        return "initial"
    parts = low.replace("’", "'").split("-")
    if all(p in GIVEN for p in parts):
        return "given"
    if all(p in everyday or p.removesuffix("s") in everyday for p in parts):
        return "everyday"
    return "other"


def _name_features(text: str, a: int, b: int, words: list[str], form: str, particle: bool, run: tuple[int, int], everyday: frozenset[str], german: bool) -> list[str]:
    """Features of a whole name; ``words`` in the order given names, family name; ``run`` is the stretch of capitals around it."""
    first, last = words[0], words[-1]
    kinds = [_kind(w, everyday) for w in words]
    one, two = kinds[0], kinds[-1]
    low = last.lower()
    family = low.endswith(ENDINGS) and len(low) >= 5
    loud = [w.isupper() for w in words if not re.fullmatch(r"\w\.?", w)]
    upper = all(loud)
    case = "lower" if first.islower() and last.islower() else "upper" if upper and len(last) > 2 else "mixed" if any(loud) else "title" if all(w[0].isupper() for w in words) else "mixed"
    if any(w[1:] != w[1:].lower() and not w.isupper() and not re.search(r"[’'\-]|^(?:Mc|Mac|De|Di|Van|O)[A-Z]", w) for w in words):
        case = "camel"
    f = ["name", f"name:{form}", f"name:first:{one}", f"name:last:{two}", f"name:{one}+{two}", f"name:{case}", f"name:{one}:{case}", f"name:words{len(words)}", "name:family" if family else "name:no_family", f"name:{one}:{'family' if family else two}"]
    if german:
        f += [f"name:german:{one}", f"name:german:{one}+{two}"]
    if len(words) > 2:
        f.append(f"name:middle:{kinds[1]}")
    if particle:
        f.append("name:particle")
    if low in _BAD_LAST or low in GIVEN:
        f.append("name:bad_last")
    if two == "other" and case == "title":
        f += [f"name:end:{low[-3:]}", f"name:end:{low[-2:]}", f"name:begin:{low[:3]}"]
    if one == "other" and case == "title":
        g = first.lower()
        f += [f"name:first_end:{g[-2:]}", f"name:first_begin:{g[:3]}", f"name:first_begin:{g[:2]}"]
    shape = "".join("v" if c in "aeiouyáéíóúàèìòùäöüâêîôûåæø" else "c" if c.isalpha() else c for c in low)
    if re.search("c{4}|v{4}", shape) or not re.search("v", shape):
        f.append("name:unspeakable")
    left = text[max(0, a - 24) : a]
    line = left.rsplit("\n", 1)[-1]
    cue = "title" if _TITLE.search(left) else "role" if _ROLE.search(left) else "agent" if _AGENT.search(left) else None
    if cue:
        f += ["name:cue", f"name:cue:{cue}", f"name:{one}:cue"]
    right = text[b : b + 16]
    if _SAYS.match(right):
        f += ["name:says", f"name:{one}:says"]
    if _CARD.match(right):
        f += ["name:card", f"name:{one}:card"]
    elif _HANDLE.match(right):
        f.append("name:handle")
    if (not line.strip() or re.fullmatch(r"[ \t>*\-]+", line)) and (not right or right[0] == "\n"):
        f += ["name:alone", f"name:{one}:alone"]
    if a == 0 or not line.strip(" \t>*#-") or re.search(r"[.!?:;][)\"']? $", left):
        f.append("name:sentence")
        if one == "everyday":
            f.append("name:sentence:everyday")
    if run[0] < a:
        f.append("name:more_left")
        if one == "given":
            f.append("name:more_left:given")
    if run[1] > b:
        f.append("name:more_right")
    if a > 0 and (text[a - 1] in "@/._+-=<#" or text[a - 1].isalnum()) or b < len(text) and (text[b] in "@/_+=" or text[b].isalnum() or text[b] == "(" or re.match(r"[.\-]\w", text[b : b + 2])):
        f.append("name:glued")
    if _HEADING_LEFT.search(line) or _HEADING_RIGHT.match(right):
        f += ["name:heading", f"name:heading:{one}"]
    if re.search(r"(?:::|->|=>|\bEither|\bMaybe|\bnew|\bclass|\bimport|\btype|\bdata) $", left) or re.match(r" ?(?:::|->|=>|\()", right):
        f.append("name:code")
    if re.match(r"(?i)[ ,]*(?:street|st\b|road|house|terrace|plein|ave|drive|court|close)", right):
        f.append("name:street")
    if re.search(r"\d[a-zA-Z]?,? $", left) or re.match(r",? \d", right):
        f.append("name:number")
    return f


def _names(text: str, words: set[str], everyday: frozenset[str]) -> Iterator[Segment]:
    seen: set[tuple[int, int]] = set()
    german = len(_GERMAN & words) > 2

    def segment(a: int, b: int, parts: list[str], form: str, particle: bool, run: tuple[int, int]) -> Iterator[Segment]:
        if (a, b) not in seen:
            seen.add((a, b))
            yield Segment(a, b, "name", _name_features(text, a, b, parts, form, particle, run, everyday, german))

    # every span of two to NAME_WORDS neighbouring capitalised words or initials
    for m in _CAPITALS.finditer(text):
        spans, seps = [], []
        at = m.start()
        while at < m.end():
            w = _ONE_CAPITAL.match(text, at)
            spans.append(w.span())
            sep = _PART.match(text, w.end())
            if not sep or sep.end() >= m.end():
                break
            seps.append((sep["sep"] == ", ", bool(sep["part"])))
            at = sep.end()
        said = [text[a:b] for a, b in spans]
        for i in range(len(spans) - 1):
            if _CONTRACTED.search(said[i]):
                continue
            for j in range(i + 1, min(len(spans), i + NAME_WORDS)):
                a, b = spans[i][0], spans[j][1]
                if _CONTRACTED.search(said[j]):
                    break
                commas = [c for c, _ in seps[i:j]]
                if not any(commas):
                    if not said[j].endswith("."):
                        yield from segment(a, b, said[i : j + 1], "first_last", any(p for _, p in seps[i:j]), m.span())
                elif commas[0] and not any(commas[1:]):
                    # a family name and what is before it: the given names follow
                    part = re.search(rf"(?<!\w)(?:(?:{_PARTICLES}) )+$", text[max(0, a - 12) : a])
                    s = a - len(part.group()) if part else a
                    yield from segment(s, b, [*said[i + 1 : j + 1], said[i]], "last_first", bool(part), m.span())
    # in other cases only the list tells a name from two words
    if not GIVEN.isdisjoint(words):
        for w in _NAME_WORD.finditer(text):
            word = w.group()
            if word.lower().split("-")[0] not in GIVEN:
                continue
            a = w.start()
            m = _NAME_AT.match(text, a)
            if m and (m["first"] == word or m["first"].startswith(word)) and not _CONTRACTED.search(m["last"]):
                yield from segment(a, m.end(), [m["first"], *m["middle"].split(), m["last"]], "first_last", bool(m["part"]), (a, m.end()))
            if a >= 3 and text[a - 2 : a] == ", ":
                m = re.search(r"[^\W\d_][^\W\d_’']*(?:[’'\-][^\W\d_]+)*$", text[max(0, a - 42) : a - 2])
                if m:
                    s = a - 2 - len(m.group())
                    part = re.search(rf"(?i)(?<!\w)(?:(?:{_PARTICLES}) )+$", text[max(0, s - 12) : s])
                    s -= len(part.group()) if part else 0
                    yield from segment(s, w.end(), [word, m.group()], "last_first", bool(part), (s, w.end()))
    for m in _INITIAL.finditer(text):
        last = _NAME_WORD.match(text, m.end())
        if last:
            yield from segment(m.start(), last.end(), [m.group()[:2], last.group()], "first_last", False, (m.start(), last.end()))
    for m in _LAST_INITIALS.finditer(text):
        b = m.start() + len(m.group().rstrip())
        yield from segment(m.start(), b, ["X.", m.group().split(",")[0]], "last_first", False, (m.start(), b))


_SPLIT = re.compile(r"[\W_]+").split


def segments(text: str, everyday: frozenset[str] | None = None) -> list[Segment]:
    """All candidate segments of a text, by their start."""
    everyday = everyday_words() if everyday is None else everyday
    found: dict[tuple[int, int, str], Segment] = {}
    words = set(_SPLIT(text.lower()))
    for finder in (_emails(text), _numbers(text), _codes(text), _addresses(text, words), _names(text, words, everyday)):
        for s in finder:
            found.setdefault((s.start, s.end, s.type), s)
    return sorted(found.values(), key=lambda s: (s.start, s.end, s.type))


def windows(found: list[Segment]) -> Iterator[list[Segment]]:
    """Groups of segments that may influence each other."""
    group: list[Segment] = []
    end = 0
    for s in found:
        if group and s.start - end > WINDOW:
            yield group
            group = []
        group.append(s)
        end = max(end, s.end) if len(group) > 1 else s.end
    if group:
        yield group


def transition(a: Segment, b: Segment) -> str | None:
    """Feature of two neighbouring segments of a labelling."""
    return f"then:{a.type}>{b.type}" if b.start - a.end <= WINDOW else None


def best(group: list[Segment], weights: dict[str, float]) -> list[Segment]:
    """The labelling of greatest weight: dynamic programming over the segments' ends."""
    get = weights.get
    for s in group:
        s.score = sum(get(f, 0.0) for f in s.features)
    value = [0.0] * len(group)
    back = [-1] * len(group)
    order = sorted(range(len(group)), key=lambda i: (group[i].end, group[i].start))
    ends = [group[i].end for i in order]
    # the best labelling of the segments up to each place of the order, and its last segment
    upto = [(0.0, -1)]
    for i in order:
        s = group[i]
        near, last = bisect_left(ends, s.start - WINDOW), bisect_right(ends, s.start)
        # beyond the window no transition counts, so one best value stands for all of them
        top, prev = upto[near]
        for j in reversed(order[near:last]):
            v = value[j] + get(transition(group[j], s), 0.0)
            if v > top:
                top, prev = v, j
        value[i], back[i] = top + s.score, prev
        upto.append(max(upto[-1], (value[i], i), key=lambda x: x[0]))
    if not group:
        return []
    i = max(range(len(group)), key=value.__getitem__)
    if value[i] <= 0:
        return []
    out = []
    while i >= 0:
        out.append(group[i])
        i = back[i]
    return out[::-1]


def log_partition(group: list[Segment], weights: dict[str, float]) -> tuple[float, dict[int, float], dict[tuple[int, int], float]]:
    """Log of the sum over all labellings, and the probabilities of segments and of neighbouring pairs (for training)."""
    n = len(group)
    score = [math.exp(min(30.0, sum(weights.get(f, 0.0) for f in s.features))) for s in group]
    link = {(j, i): math.exp(weights.get(t, 0.0)) if (t := transition(group[j], group[i])) else 1.0 for i in range(n) for j in range(n) if group[j].end <= group[i].start}
    order = sorted(range(n), key=lambda i: (group[i].end, group[i].start))
    fore, rear = [0.0] * n, [0.0] * n
    for i in order:
        fore[i] = score[i] * (1.0 + sum(fore[j] * w for (j, k), w in link.items() if k == i))
    for i in reversed(order):
        rear[i] = 1.0 + sum(score[k] * rear[k] * w for (j, k), w in link.items() if j == i)
    z = 1.0 + sum(fore)
    one = {i: fore[i] * rear[i] / z for i in range(n)}
    two = {(j, i): fore[j] * w * score[i] * rear[i] / z for (j, i), w in link.items()}
    return math.log(z), one, two


@lru_cache(maxsize=1)
def trained_weights() -> dict[str, float]:
    """The weights that ``pii_train`` wrote beside this module."""
    with open(os.path.join(os.path.dirname(__file__), "pii_weights.json")) as f:
        return json.load(f)


def find(text: str, weights: dict[str, float], everyday: frozenset[str] | None = None) -> list[Segment]:
    """Personal information of a text, in order, without overlaps."""
    return [s for g in windows(segments(text, everyday)) for s in best(g, weights)]


def redact(text: str, weights: dict[str, float], everyday: frozenset[str] | None = None) -> str:
    """The text with a placeholder of its type for each item, such as [NAME], and otherwise unchanged."""
    out, at = [], 0
    for s in find(text, weights, everyday):
        out += [text[at : s.start], f"[{s.type.upper()}]"]
        at = s.end
    return "".join(out) + text[at:] if out else text


def found_types(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and pii_kind: one row for each row and kind that occurs in it.

    Null and empty texts have none; repeated rows count each; texts of any length are read whole.
    """
    weights, words = trained_weights(), everyday_words()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, out = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for x in sorted({s.type for s in find(t, weights, words)}):
                    ks.append(k)
                    out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(out, pa.string())], names=["key", "pii_kind"])

    kept = spread(df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))).where(F.length("text") > 0)
    return kept.mapInArrow(run, "key long, pii_kind string")


def redact_column(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and redacted of every row; a null text stays null, an empty one empty."""
    weights, words = trained_weights(), everyday_words()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [redact(t, weights, words) if t else t for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], names=["key", "redacted"])

    return spread(df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))).mapInArrow(run, "key long, redacted string")


SOURCES = (("github_issues", "body"), ("github_issue_comments", "content"))


def _both(spark: SparkSession, sf_dir: str, op, column: str) -> DataFrame:
    out = None
    for name, text in SOURCES:
        one = op(table(spark, sf_dir, name, "id", text), "id", text)
        one = one.select(F.lit(name).alias("record_table"), F.col("key").alias("record_id"), column)
        out = one if out is None else out.unionByName(one)
    return out


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of personal information in each issue and comment."""
    return _both(spark, sf_dir, found_types, "pii_kind")


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each issue's body and comment's content with placeholders for personal information."""
    return _both(spark, sf_dir, redact_column, "redacted")


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted}
ORACLES: dict[str, str] = {}
