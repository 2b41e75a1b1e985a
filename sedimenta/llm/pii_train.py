"""Training of the segment weights: ``python -m sedimenta.llm.pii_train``.

Invented labelled lines, with look-alikes that are no personal information, and stochastic gradient
ascent on the conditional likelihood with forward-backward sums over the candidate lattice. Most names
are spoken together by the rules of several languages, so that the model learns how names sound, not a
list; capitalised everyday words and invented words in code stand against them.
"""

from __future__ import annotations

import json
import os
import random
import zlib
from collections import defaultdict
from functools import lru_cache

from sedimenta.llm.pii import ENDINGS, GIVEN, everyday_words, log_partition, segments, transition, windows

_STEMS = "Ander Peter Nil Lind Berg Hol Stav Kor Mark Win Fer Gal Rom Sand Nor Ost Wald Har Bren Cas Del Mor Tor Vel Kall Jans Lars Hag".split()
_PLAIN = "Smith Jones Garcia Silva Rossi Dubois Nakamura Okafor Haddad Novak Costa Weber Keller Fischer Moreno Laurent Tanaka Mensah".split()
_WORDS = "river stone signal harbour paper window copper engine ladder meadow basket mirror pencil market bridge lantern forest carpet kettle wagon".split()
_PLACES = "Oakfield Maple Kirk Church Station Abbey Castle Linden Rosen Birken Park Victoria Elm Cedar Mill".split()
_CITIES = "Westford Brookvale Neustadt Port-Royal Arnsby Lakeview Altdorf Montclair Villarosa Eastmoor Sainte-Rive".split() + ["San Pedro", "New Harbour", "Bad Linden"]
#: Sounds of names by language: (given names, family names), each a row of choices that are spoken one after the other.
_SOUNDS = {
    "chinese": (("b p m f d t l g k h j q x zh ch sh z c y w", "an ang ao ei en eng i ia iao in ing iong ou u ui un uo", "- b m f d l g h j q x zh y w", "ang ao en i in ing ong u ua uan un uo"), ("b d f g h j k l m p t w x y z zh ch sh", "an ang ao e en eng i ia iang iao in iu ou u ua uan ue uo")),
    "yoruba": (("ade olu ayo ola ife temi oyin bola tunde femi kole", "wale seun tunde bola dele mide kemi ike yemi sola dapo tayo"), ("ade olu ogun oye aki ola fa odu", "yemi wole sanya lade nle bayo shina toye biyi sola")),
    "igbo": (("chi nne oba uche nka ngo eme ike ada obi nwa", "nna oma eze ka zi chukwu dinma ke ora kwe biora"), ("o e a nwa eze oko", "ke bi fo nu ku dili", "ze ri nkwo ama a")),
    "bantu": (("tha nko si lin mo ka bu ze ngu wan le pa", "ndi mbi ko la thi wi ngi se bo so le", "- we le ni la so si"), ("mo ma ndlo nko dla ki ka mu wa mwa", "ko la ndi mi ngi tha ri si", "ena mo vu si ni la wa")),
    "akan": (("kwa ko a e ya k", "me fi si dwo ma ku bena wabena", "- ma wa"), ("men bo a o", "sah ateng ddo wusu ppiah nsu frifa", "- -darko -boateng -mensah")),
    "indian": (("raj vik san pra ana dee lak sri kri ven sub ram man har shr ni aru gay", "esh ram deep jay itha shmi kant kumar iya nath pal preet inder vi athi ush"), ("ra ven sub gu cha ban mal sha ku pa iy ne", "nga kata ra pta tter dho ma tra", "nathan swamy jee kar wal pathi rathi murthy ni ar an")),
    "slavic": (("bog mil stan vlad jar rad dra zor bor lju svet tad", "islav dan ana ka imir oslava ica an mila en eusz ena"), ("mar kov pet nov wis jan dub ste kra vol hor", "chuk ko ovic enko owska iak icek ev ska anov niewski")),
    "arabic": (("mu ha fa sa kha ra na za ya ja ta ab", "sa ser lid mir di si hi wa ri bi ti za", "- m d n l a r h"), ("al- el- ben - - -", "ha sha ma na kha za mu ra ba", "ddad rif nsour ssar lil yed stafa hmed di")),
    "japanese": (("ka ki ku sa shi su ta chi tsu na no ha hi fu ma mi yu yo ri", "ka ki ko sa shi su to na no ha hi ma mi yu ri ru", "- ko ka to ya mi na ro"), ("ta na ka su mi ya ko shi fu o i ma ha", "na ka zu ya ma shi mu ga ki", "ka moto mura ki ta da no to wa shita")),
    "korean": (("min ji hye soo jun ho eun seo yeon woo kyung tae", "- -", "min ji hye soo jun ho eun seo yeon woo hoon"), ("k p ch j l y h s", "im ark oi ang ung ee oon wang eo")),
    "turkic": (("a me e mu o ce ay ze bu gü nur", "hmet rve lif rat sman m la ynep rak lten yan"), ("yil de a kay o ko ce ka er", "maz mir kin a zturk c lik ra dogan", "- er oglu han")),
    "romance": (("gi lu fran mar be ale ele va ro do isa gon", "anni cia cesco tina atrice ssandro onora lentina mualdo rotea bella zalo"), ("ro fe gi be va mon to men", "ssi rra ordano llini lencia teiro rres doza", "- ni - rez")),
    "germanic": (("ger hei wil frie ing ul sig bert ro lud gud bryn", "hard ke helm derike eborg rich frid hild lf wig run jar"), ("schu hof berg kru brand stein wal", "ster mann er ger hauer bach dner", "- - er")),
    "celtic": (("sio ca ae ni fio rhi gwe el cai sea", "bhan itlin ife amh nn annon n wyn mhe mus"), ("o' mc mac fitz -", "bri cal cul do ke gal", "en lum loch nnell nnedy lagher ley gan")),
    "polynesian": (("ka lei ma wi tu ha ki", "lani ia re hina ne mana ri", "- ka hu ta"), ("ka ma ta pa ra", "mea hoe kau ne ki", "loha nui whiri a ri")),
    "baltic": (("jan vil ai mar gin kris dai", "is nius ste tynas tare taps na"), ("ber kal ozo pe kaz", "zins nins lins trauskas lauskas", "- - iene")),
}
_GERMAN_STEMS = "Mess Zähl Prüf Rech Werk Haupt Neben Daten Quell Ziel Speich Les Schreib Such Lauf Fehl Zeit Wort Satz Bild Schalt Ketten Baum Netz Dienst Frag Antwort Kopf Fuß Grund Kern Teil Stück Block Zweck Mittel Muster Modell Recht Wirt Sprach".split()
_GERMAN_NOUN = "ung heit keit schaft nis er el e ling tum ion ität or fall gang stand zug griff schritt lauf teil wert satz bau plan punkt".split()
_GERMAN_ADJECTIVE = "neu alt klein gut lang kurz hoch tief breit eng klar still voll ganz halb fest lose frei nah fern bunt hell dunkel wicht günst stet täg zeit sach örtlich mensch".split()
_GERMAN_SENTENCES = ("der {n} ist nicht auf dem {n}", "die {n} wird mit der {n} geprüft", "wenn das nicht geht, ist die {n} leer", "bitte den {n} und die {n} prüfen", "für eine {n} ist das zu langsam", "nach dem {n} wird ein {n} gelesen", "das {n} und der {n} auch")
_CODE = (
    "f :: Either {X} Int", "parse :: {X} -> Maybe {X}", "class {X} extends {X}", "new {X}({X} {w})", "import {X} from {w}", "type {X} = {X} Int", "data {X} = {X} {w}", "throws {X} Exception", "Either {X} Int", "instance {X} {X} where", "Map String {X}", "impl {X} for {X}",
    "the {X} Server and {X} {W}", "{W} {X} release", "module {X} ({W})", "{X} {W} API", "use {X} {X} types", "In {X} {W} we see it", "Visual {X} {W}", "{W} {W} by default",
)
_NONE = (
    "build {d}{d}.{d}.{d}{d}{d} from 20{d}1-0{c}-1{d} is fine", "epoch 17{d}{d}{d}{d}{d}{d}{d}{d} vs 16{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}", "ports 8080 84{d}{d} 52{d}{d} and pid 4{d}{d}{d}{d}",
    "{d}{d}{d}-{d}{d}{d}{d}{d}{d}{d} rows, chunk {d}{d}{d}{d}-{d}{d}{d}{d}", "address 0x7f{d}{d}{d}{d}{d}{d} maps to 10.{c}.1{d}.{d}:80{d}{d}", "trace id {d}{d}a{d}{d}{d}{d}{d}{d}{d}b{d}{d}e{d}", "git clone git@host.example.com:{w}/{w}.git fails",
    "install {w}@{c}.{d}.{d} first", "@{w} @{w}-bot please look", "line {c}{d}, Main Street theme, lane {c} of the {w}", "the Merge Queue and the Blue Lamp both wait", "Open Market and Copper Bridge wait", "Either Paper Int", "Der große Ordner prüft den Speicher",
    "phone and email fields in the form are idle", "look at {w}.{w} and at the end of {w}.{w}", "error E{d}{d}{d}{d} in {w}_{w}", "sha 9f{d}{d}{d}{d}{d}{d}c2 of 20{d}{d}", "timeout {d}{d}{d}{d}{d}{d}{d}{d} ms", "order {d}{d}{d}{d}{d}{d}{d}{d}{d} = {d}{d}{d}",
    "version {c}.{d}.{d}{d}.{d}{d}{d}{d}", "[{c}/{c}{d}] copy {w}", "@Override and @{w}.{w} decorators", "T{d}{d}{d} done at 1{c}:{d}{d}, 20{d}2-1{c}-0{d}T1{d}:0{d}:{d}{d}Z", "expected {d}{d}{d}{d}{d} entries but got {d}{d}", "class X{d} extends Y.Z", "A. The {w} is late", "see Table {c}, Row {d}",
    "{d}{d}{d} wide row slots", "0{d}{d}-{d}{d}{d}{d}{d}{d}{d} rows, chunk {d}{d}{d}{d}-{d}{d}{d}{d}", "0{d}{d}{d}-{d}{d}{d}{d} rows", "00{d}-{d}{d}{d}{d}{d}{d}{d} rows",
    "2.1 {w} 3.{d} {w}", "id {d}{d}{d}{d}{d}{d}{d} was skipped", "rate limit 60/{d}{d}{d}{d}", "key AB{d}{d}{d}{d}{d}{d} = {w}", "commit {d}{d}{d}{d}{d}{d}{d}", "Test Runner and Quick Start", "unit {c}, block {d}", "room {c}, {w}", "Peter pan was here", "user daniel_{w} logged in", "by hand and by eye", "de la {w}",
)


class _Line:
    def __init__(self, rng: random.Random):
        self.rng, self.text, self.spans = rng, "", []
        self.tongue = "de" if rng.random() < 0.2 else "en"

    def put(self, s: str, kind: str | None = None) -> _Line:
        if kind:
            self.spans.append((len(self.text), len(self.text) + len(s), kind))
        self.text += s
        return self

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def words(self, a: int = 2, b: int = 6) -> str:
        return " ".join(self.rng.choice(_WORDS) for _ in range(self.rng.randint(a, b)))

    def spoken(self, language: str, part: int) -> str:
        s = "".join("" if x == "-" else x for x in (self.rng.choice(row.split()) for row in _SOUNDS[language][part]))
        return "-".join(("'".join(y.capitalize() for y in x.split("'")) for x in s.strip("-").split("-")))

    def family(self) -> str:
        r = self.rng
        if r.random() < 0.5:
            return r.choice(_PLAIN) if r.random() < 0.15 else r.choice(_STEMS) + r.choice(ENDINGS)
        last = self.spoken(r.choice(sorted(_SOUNDS)), 1)
        return last + "-" + self.spoken(r.choice(sorted(_SOUNDS)), 1) if r.random() < 0.06 else last

    def name(self) -> None:
        r = self.rng
        last = self.family()
        if r.random() < 0.45:
            given = r.choice(sorted(GIVEN)).title()
            if r.random() < 0.1:
                given += "-" + r.choice(sorted(GIVEN)).title()
        else:
            language = r.choice(sorted(_SOUNDS))
            given = self.spoken(language, 0)
            if r.random() < 0.6:
                last = self.spoken(language, 1)
            if language == "chinese" and r.random() < 0.5:
                given, last = last, given
            elif r.random() < 0.2:
                given += " " + self.spoken(language, 0)
            if len(given) < 3 or len(last) < 2:
                given, last = "Thandeka", "Wirihana"
        s = r.choice((f"{given} {last}", f"{given} {last}", f"{given} {r.choice('ABCDEKLM')}. {last}", f"{given[0]}. {last}", f"{last}, {given}", f"{last}, {given[0]}.", f"{given} van {last}", f"{given} de {last}"))
        if r.random() < 0.1:
            s = s.upper()
        elif r.random() < 0.1 and "." not in s and s.split()[0].lower() in GIVEN:
            s = s.lower()
        if r.random() < 0.1:
            self.put("Dr. ")
        self.put(s, "name")

    def email(self) -> None:
        r, w = self.rng, self.rng.choice
        local = w((f"{w(_WORDS)}{self.digits(2)}", f"{w(_WORDS)}.{w(_WORDS)}", f"{w(_WORDS)}_{w(_WORDS)}", f"{w(_WORDS)}+{w(_WORDS)}", w(_WORDS)))
        host = w((f"{w(_WORDS)}.example", f"mail.{w(_WORDS)}.org", "example.com", f"uni.{w(_WORDS)}.de"))
        x = r.random()
        if x < 0.7:
            s = f"{local}@{host}"
        elif x < 0.8:
            s = f"{local} at {host.replace('.', ' dot ')}"
        elif x < 0.9:
            s = f"{local}[at]{host.replace('.', '[dot]')}"
        else:
            s = f"{local} (at) {host}"
        if r.random() < 0.1:
            self.put("mailto:")
        self.put(s.upper() if r.random() < 0.08 else s, "email")

    def phone(self) -> None:
        d, r = self.digits, self.rng
        s = r.choice((
            f"+44 7{d(3)} {d(6)}", f"07{d(3)} {d(3)} {d(3)}", f"020 {d(4)} {d(4)}", f"+49 (0)30 {d(5)} {d(3)}", f"030/{d(8)}", f"+33 6 {d(2)} {d(2)} {d(2)} {d(2)}", f"0{r.choice('12345')} {d(2)} {d(2)} {d(2)} {d(2)}", f"+1 ({r.randint(201, 989)}) 555-{d(4)}",
            f"({r.randint(201, 989)}) 555-{d(4)}", f"{r.randint(201, 989)}.555.{d(4)}", f"{r.randint(201, 989)}-555-{d(4)}", f"{r.randint(201, 989)} 555 {d(4)}", f"+1-{r.randint(201, 989)}-555-{d(4)}", f"00{r.choice((33, 44, 49))}{d(1)} {d(8)}", f"04{d(2)} {d(3)} {d(3)}", f"+{r.choice((44, 49, 34))}{d(10)}", f"+1 ({r.randint(201, 989)}) 555-{d(4)} ext. {d(2)}", f"+34 6{d(2)} {d(3)} {d(3)}",
        ))
        if r.random() < 0.15:
            self.put("tel:")
        self.put(s, "phone")

    def id_number(self, word: bool = True) -> None:
        d, r = self.digits, self.rng
        n = r.randint(10**7, 10**8 - 1)
        kind = r.choice((
            ("passport no. ", f"{r.choice('XCPA')}{r.choice('ABKZ')}{d(7)}"), ("(passport: ", f"{r.choice('CPL')}{d(8)}"), ("SSN ", f"9{d(2)}-{d(2)}-{d(4)}"), ("social security number ", f"9{d(2)} {d(2)} {d(4)}"), ("national insurance no. ", f"QQ{d(6)}{r.choice('ABCD')}"),
            ("NI number ", f"QQ {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}"), ("DNI ", f"{n}{'TRWAGMYFPDXBNJZSQVHLCKE'[n % 23]}"), ("DNI ", f"{n}-{'TRWAGMYFPDXBNJZSQVHLCKE'[n % 23]}"), ("numéro de sécurité sociale ", f"{r.choice('12')} {d(2)} {r.randint(10, 12)} {d(2)} {d(3)} {d(3)} {d(2)}"), ("Personalausweis Nr. ", f"L{d(1)}{r.choice('CFGHJKL')}{d(6)}"),
            ("id card number is ", f"{r.choice('HLTA')}{r.choice('XYZ')}-{d(3)}-{d(4)}"), ("ID number ", f"{d(9)}"), ("Reisepass ", f"C{d(8)}"),
        ))
        bare = kind[0].startswith(("SSN", "DNI")) and r.random() < 0.35
        if not bare:
            self.put(kind[0])
        self.put(kind[1], "id_number")

    def address(self) -> None:
        r, d = self.rng, self.digits
        n, p, c = r.randint(1, 300), r.choice(_PLACES), r.choice(_CITIES)
        s = r.choice((
            f"{n} {p} {r.choice(('St', 'Street', 'Ave', 'Road', 'Rd.', 'Drive', 'Lane', 'Parkway', 'Hwy', 'Circle', 'Trail'))}, {c} {d(5)}", f"{n}a {p} {r.choice(('Close', 'Court', 'Way'))}, {c}", f"{n} rue des {p}s, {d(5)} {c}", f"{n} bis, avenue du {p}, {c}", f"calle {p.lower()} número {n}, {c}", f"C/ {p} {n}, 3º B, {d(5)} {c}",
            f"{p}str. {n}, {d(5)} {c}", f"{p}straße {n}, {d(5)} {c}", f"{p}plein {n}, {d(4)} AB {c}", f"P.O. Box {n}, {c}", f"Postfach {n}, {d(5)} {c}", f"Flat {r.randint(1, 40)}, {p} House, {c}", f"Apt {r.randint(1, 40)}, {n} {p} Terrace\n{c} K{d(1)} {d(1)}XQ", f"{n} {p} Road", f"{p}weg {n}", f"{n} {p} {r.choice(_PLACES)}, {c}", f"{n} {p} {r.choice(_PLACES)}, {c} {d(5)}",
        ))
        self.put(s, "address")

    def invented(self) -> str:
        """A word of code or of a product."""
        r = self.rng
        s = "".join(r.choice("b d f g k l m n p r s t v w x z br dr kl pr str tr v".split()) + r.choice("a e i o u ai ea oo".split()) for _ in range(r.randint(1, 2))) + r.choice("b d k l m n p r s t x ck sk lt rk nd".split())
        return (s + r.choice(("", "", "", "Id", "Map", "Core", "Net"))).capitalize()

    def marked(self, s: str) -> str:
        """Under markup of a heading, a cell or an emphasis."""
        a, b = self.rng.choice((("# ", "\n"), ("## ", " ##\n"), ("", "\n====="), ("", "\n-----"), ("| ", " | x |"), ("=== ", " ==="), ("<h2>", "</h2>"), ("<title>", "</title>"), ("\\section{", "}"), ("'''", "'''"), ("**", "**"), ("! ", " !! y"), ("<li>", " <b>"), ("<p>", " is"), ("[[Category:", "]]")))
        return ("\n" if b[:1] == "\n" or a[:1] == "#" else "") + a + s + b

    def noun(self) -> str:
        r = self.rng
        s = r.choice(_GERMAN_STEMS)
        return (s + r.choice(_GERMAN_STEMS).lower() if r.random() < 0.2 else s) + r.choice(_GERMAN_NOUN)

    def adjective(self) -> str:
        r = self.rng
        s = r.choice(_GERMAN_ADJECTIVE) if r.random() < 0.4 else r.choice(_GERMAN_STEMS).lower()
        s = ("ge" if r.random() < 0.2 else r.choice(("", "", "ver", "un", "be", "vor", "ab", "über"))) + s + r.choice(("", "ig", "lich", "isch", "bar", "sam", "los", "t", "et", "end", "er"))
        return s.capitalize() + r.choice("e e e er es en em".split())

    def german(self) -> str:
        s = self.rng.choice(_GERMAN_SENTENCES)
        while "{n}" in s:
            s = s.replace("{n}", self.noun(), 1)
        return s

    def decoy(self) -> None:
        """Capitals that are no name: titles, headings, products, types and sentences' first words."""
        r, every = self.rng, _every()
        words = [w.capitalize() for w in r.choices(every, k=r.randint(2, 4))]
        x = r.random()
        if x < 0.3:
            s = r.choice(_CODE)
            while "{" in s:
                s = s.replace("{X}", self.invented(), 1).replace("{W}", r.choice(every).capitalize(), 1).replace("{w}", r.choice(_WORDS), 1)
        elif x < 0.75:
            s = " ".join(words)
            s = s.upper() if r.random() < 0.2 else s
            if r.random() < 0.2:
                self.put(self.marked(s))
                return
            if r.random() < 0.15:
                s += r.choice((" and ", " or ", " und ")) + " ".join(w.capitalize() for w in r.choices(every, k=2)) + r.choice((" both wait", " are here", " fail", ""))
            s = r.choice(("", "see ", "from ", "by ", "with ", "the ", "# ", "- ", "to ", "The ", "for ", "and ", "On ", "customer ", "says ")) + s + r.choice(("", " is slow", ", then", ".", ":", " (old)", " and so on", " has gone", ", 3 of 4"))
        elif x < 0.85:
            s = f"{words[0]} {self.invented()}" if r.random() < 0.5 else f"{self.invented()} {words[0]}"
        elif x < 0.88 or self.tongue == "de":
            a = self.adjective() if r.random() < 0.75 else r.choice(("Der", "Die", "Das", "Ein", "Kein", "Jeder", "Dieser", "Im", "Mit", "Bei"))
            s = self.marked(f"{a} {self.noun()}") if r.random() < 0.6 else r.choice(("", "", "- ", "siehe ", "laut ", "und ")) + f"{a} {self.noun()}" + r.choice((" ist leer", "\n", " wird", "", "."))
        elif x < 0.92:
            s = r.choice(("On", "Last", "By", "Every", "Since")) + " " + r.choice("Monday Tuesday Wednesday Thursday Friday Saturday Sunday January March April June August October".split()) + r.choice((" the ", " ", ", ")) + r.choice((words[0], r.choice(_WORDS)))
        else:
            s = r.choice(_PLACES) + " " + r.choice(("House", "Station", "Centre", "School", "Office", "Park", words[0])) + r.choice((" is far", ", closed", ""))
        self.put(s)

    def clock(self) -> None:
        """Dates and times as logs have them."""
        d, r = self.digits, self.rng
        date = r.choice(("{y}-{m:02}-{d:02}", "{y}/{m:02}/{d:02}", "{d:02}.{m:02}.{y}", "{y}-{m:02}-{d:02}")).format(y=r.randint(1995, 2031), m=r.randint(1, 12), d=r.randint(1, 28))
        s = date + r.choice((f" {r.randint(10, 23)}", f" 0{d(1)}", f" {r.randint(10, 23)}:{r.randint(10, 59)}", f" {r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}", f" {r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}.{d(3)}", f"T0{d(1)}:1{d(1)}:3{d(1)}Z", f" 1{d(1)} {d(2)} {d(2)}", f" - {date}", ""))
        self.put(r.choice(("", "[", "at ", "since ", "(")) + s + r.choice(("", "]", " build ", " INFO ", ")", f" {d(4)}")))


_AROUND = {
    "name": (("From: ", " ("), ("Reported by ", " on the call."), ("Thanks to ", " for it."), ("with ", " on this"), ("", " asked why it fails"), ("", ""), ("  ", ""), ("(", ") "), ("says ", "."), ("customer ", ", was imported"), ("Signed-off-by: ", " <"), ("assigned: ", " (out)"), ('"', '"'), ("laut ", " gilt das"), ("avec ", ", on a vu"), ("As ", " told us"), ("As ", " said, it holds"), ("", " wrote this; it is fine."), ("and ", " replied"), ("", " or "), ("When ", " came"), ("But ", " left"), ("If ", " agrees"), ("yesterday ", " ran it"), ("after ", " left"), ("Pregunta de ", ": "), ("Message de ", ""), ("Hi ", ","), ("frag ", " dazu"), ("von ", " geprüft"), (" - ", " - "), ("see ", " for more.")),
    "email": (("contact: ", ""), ("<", ">"), ("(", ")"), ("cc ", ""), ("reach me at ", "."), ('"', '"'), ("", ""), ("user=", " (code 401)"), ("escribe a ", ", gracias"), (" - ", " - ")),
    "phone": (("it gave 8651. ", ""), ("and b < 3. ", " Use it"), ("Call me on ", " today."), ("Mobile ", ""), ("", " (office hours only)"), ("", ""), ("my number: ", ""), ("Rückruf unter ", ""), ('"', '"'), ("(", ") "), ("see ", " for more."), ("sms=>", " sent=false"), (" - ", " - ")),
    "id_number": (("customer ", ", was imported"), ("", ""), ("(", ") "), ("payload ", " accepted"), ("I pasted by mistake: ", ""), ("row 3 has ", ""), ('"', '"'), ("see ", " for more."), (" - ", " - ")),
    "address": (("I live at ", " so it fits"), ("Our office: ", ""), ("Invoice goes to ", ""), ("address = ", ""), ("", ""), ("(", ") "), ('"', '"'), ("ship it to ", "."), ("see ", " for more."), (" - ", " - ")),
}


@lru_cache(maxsize=1)
def _every() -> list[str]:
    return sorted(w for w in everyday_words() if len(w) > 3)


def line(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    x = _Line(rng)
    if x.tongue == "de":
        x.put(x.german() + rng.choice((". ", "\n")))
    elif rng.random() < 0.5:
        x.put(x.words().capitalize() + rng.choice((". ", " ", ": ")))
    for _ in range(rng.choice((0, 1, 1, 1, 2))):
        y = rng.random()
        if y < 0.3:
            x.decoy() if y < 0.25 else x.clock()
            if x.tongue == "de":
                x.put(rng.choice((". ", "\n")) + x.german())
            x.put(rng.choice((". ", " ", "\n")))
            continue
        if rng.random() < 0.35:
            s = rng.choice(_NONE)
            while "{" in s:
                s = s.replace("{d}", x.digits(1), 1).replace("{c}", rng.choice("123456789"), 1).replace("{w}", rng.choice(_WORDS), 1)
            x.put(s + rng.choice((". ", " ", "\n")))
            continue
        kind = rng.choice(("name", "name", "email", "phone", "id_number", "address"))
        a, b = rng.choice(_AROUND[kind])
        x.put(a)
        getattr(x, kind)()
        if kind == "name" and rng.random() < 0.25:
            x.put(rng.choice((" <", ", ", "\n", ": ")))
            getattr(x, rng.choice(("email", "phone", "id_number", "address")))()
        x.put(b)
        x.put(rng.choice((" ", "\n", ". ")))
    x.put(x.words().capitalize() if rng.random() < 0.5 else x.words())
    return x.text, x.spans


def train(lines: int = 80000, rounds: int = 5, seed: int = 3, rate: float = 0.3, decay: float = 2e-4) -> dict[str, float]:
    rng = random.Random(seed)
    examples = []
    # no vocabulary has all everyday words: each line is read with one that lacks some
    lexicons = [frozenset(w for w in everyday_words() if zlib.crc32(f"{i} {w}".encode()) % 8) for i in range(8)]
    for _ in range(lines):
        text, spans = line(rng)
        want = set(spans)
        for g in windows(segments(text, rng.choice(lexicons))):
            gold = [i for i, s in enumerate(g) if (s.start, s.end, s.type) in want]
            gold = [i for n, i in enumerate(gold) if all(g[j].end <= g[i].start or g[i].end <= g[j].start for j in gold[:n])]
            examples.append((g, sorted(gold, key=lambda i: g[i].start)))
    weights: dict[str, float] = defaultdict(float)
    square: dict[str, float] = defaultdict(lambda: 1e-2)
    for _ in range(rounds):
        rng.shuffle(examples)
        for g, gold in examples:
            _, one, two = log_partition(g, weights)
            grad: dict[str, float] = defaultdict(float)
            for i in gold:
                for f in g[i].features:
                    grad[f] += 1
            for a, b in zip(gold, gold[1:], strict=False):
                t = transition(g[a], g[b])
                if t:
                    grad[t] += 1
            for i, p in one.items():
                for f in g[i].features:
                    grad[f] -= p
            for (a, b), p in two.items():
                t = transition(g[a], g[b])
                if t:
                    grad[t] -= p
            for f, d in grad.items():
                d -= decay * weights[f]
                square[f] += d * d
                weights[f] += rate * d / square[f] ** 0.5
    return {f: round(w, 3) for f, w in sorted(weights.items()) if abs(w) > 0.05}


if __name__ == "__main__":
    with open(os.path.join(os.path.dirname(__file__), "pii_weights.json"), "w") as out:
        json.dump(train(), out, indent=0, sort_keys=True)
