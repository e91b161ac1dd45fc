"""Problem 5: personal information inside free text.

Weak-supervision aggregation. Broad patterns and a gazetteer propose spans; labelers (formats, gazetteer, context
words before and after, counter-evidence) vote on each; expectation-maximisation over a bounded sample of rows
estimates how far each labeler can be trusted, and its soft labels train the final span classifier, which sees votes
and the span's shape. All of a text is searched, in every turn and think part.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.base import arrow_map, id_and_text
from lexmill.llm.lookalikes import ALIKE, MIXED, ignorable, table
from lexmill.session import materialise

KINDS = ("email", "phone", "id_number", "address", "name")
#: Common given names of several languages, a start for the gazetteer; the sample adds what it finds.
GIVEN = """Lena Ruth Clara Hugo Felix Mira Nora Dylan Elias Marcus Anika Tomas Priya Owen Javier Andrés Begoña Lucía Inés Mateo Jürgen Jonas Anke Greta Chloé Margaux Hélène Rémi Luc Antoine
Anna Maria Peter Paul John James Mary Robert Michael Sarah David Laura Thomas Julia Daniel Emma Lukas Sofia Carlos Ana Pedro João José Juan Luis Carmen Pablo Diego Elena Marta Miguel Beatriz Tiago Inês Rafael Catarina
Pierre Marie Jean Camille Louis Sophie Claire Julien Nicolas Hans Karl Ingrid Klaus Sabine Stefan Katrin Heinz Amit Rahul Anjali Sunita Rajesh Kavita Mohan Neha Anil Vikas Deepak Pooja Arjun
Виктор Мария Ольга Анна Павел Игорь Иван Сергей Дмитрий Наталья Елена Татьяна Алексей Андрей Юлия अनिल विकास कविता मोहन सुनीता राजेश नेहा अमित प्रिया दीपक पूजा राहुल अंजलि""".split()
W = r"[^\W\d_](?:[^\W_]|['’\-](?=[^\W\d_])|[ऀ-ॣ०-ൿ̀-ͯ])*"
#: The same words, for counting: runs are not tried again.
W_FAST = re.compile(r"[^\W\d_](?:[^\W_]++|['’\-](?=[^\W\d_])|[ऀ-ॣ०-ൿ̀-ͯ]++)*+")
#: Particles before a family name.
OF = r"(?:[ \t](?:de|da|do|dos|das|del|la|di|van|von|der|den)(?=[ \t])){0,3}"
FAMILY = re.compile(rf"(?:\s{{1,3}}[^\W\d_]\.)?{OF}\s{{1,3}}({W})")
TWO = re.compile(rf"[\s\"':=]*({W})(?:\s{{1,3}}[^\W\d_]\.)?{OF}\s{{1,3}}({W})")
#: A second family name, also after a particle; not a field's label.
MORE_FAMILY = re.compile(rf"{OF}[ \t]({W})(?![\w:=@])")
BEFORE_NAME = ("my name is", "name=", "name:", "applicant:", "dr.", "mr.", "mrs.", "ms.", "prof.", "\"contact\":", "attention", "ask for", "you can reach", "it was", "me llamo", "ich heiße", "je m'appelle", "je m’appelle", "меня зовут", "заявитель:", "solicitante:", "antragsteller:", "demandeur :", "demandeur:", "मेरा नाम", "आवेदक:", "herr", "frau", "signed by", "meu nome é", "requerente:")
AFTER_NAME = re.compile(r"\s*(?:signed|\(\(?\+?\d|\|\s*\+?\(?\d|\"?,? *\"tel\"|और मेरा|है|का पता|से .{0,24}बात|and my|und wohne|y vivo|mon adresse|, mon adresse|, мой адрес|; |addr=|, documento|, ausweis|, num|, номер|, आधार|, पैन|, पहचान|, पासपोर्ट)", re.I)
#: What follows a name in scripts without letter case, where no capital shows one: beginnings, and the whole context.
AFTER_CASELESS = (" का पता", " है और मेरा", " से ")
AFTER_CASELESS_WHOLE = re.compile(r" (?:का पता|है और मेरा|से [^\n]{0,24}बात)")
LAST_TWO = re.compile(rf"(?<![\wऀ-ॣ०-ൿ])({W})(?:\s{{1,3}}[^\W\d_]\.)?[ \t]{{1,3}}({W})$")
EMAIL = re.compile(r"[\w.+\-]+(?:@| {0,2}[(\[] ?at ?[)\]] {0,2})[\w\-]+(?:(?:\.| {0,2}[(\[] ?dot ?[)\]] {0,2})[\w\-]+)*|[\w.+\-]+ at [\w\-]+(?: dot [\w\-]+)+", re.I)
NUMBER = re.compile(r"\+?\(?\d[\d ./()\-–]{2,}\d")
TOWN = rf"{W}(?: {W})?"
STREETS = "street|st\\.|avenue|ave\\.?|lane|ln\\.?|road|rd\\.?|close|hill|drive|court|way|place|square|terrace|crescent|gardens|grove|row|walk|boulevard|blvd\\.?"
ADDRESS = (
    re.compile(rf"(?:p\.? ?o\.? ?box|postfach|apartado(?: de correos)?|caixa postal|boîte postale|а/я)\s+\d+(?:,\s*(?:\d{{4,6}}\s+)?{TOWN}(?:\s+\d{{4,6}})?)?", re.I),
    re.compile(rf"(?:(?:flat|apt\.?|apartment|unit|suite|room|house)\s*\w+,\s*)?\d+(?:-?[a-z])?\s+(?:{W}\s+){{1,3}}?(?:{STREETS})(?!\w)(?:,\s*{W}(?:\s+\d{{4,6}})?|[ \t]*\r?\n[ \t]*{W}\s+\d{{4,6}}(?!\d))?", re.I),
    re.compile(rf"\d+(?: ?(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|chemin|impasse|allée|quai|route)\s+(?:de |du |des |la |d')*{TOWN}(?:,\s*\d{{5}}\s+{W})?", re.I),
    re.compile(rf"[^\W\d_]+(?:-[^\W\d_]+)*?(?:straße|strasse|str\.|gasse|platz|allee)\s+\d+ ?[a-z]?(?!\w)(?:,\s*\d{{5}}\s+{W})?", re.I),
    re.compile(rf"(?:calle|c/|avenida|avda\.?|plaza|paseo|camino|rua|travessa|praça)\s+(?:{W}\s+){{0,2}}{W},?\s+(?:n[.º°]?\s?)?\d+(?!\w)(?:,\s*\d{{4,5}}(?:-\d{{3}})?\s+{W})?", re.I),
    re.compile(rf"(?:ул\.|улица|просп\.|проспект|пер\.|переулок|пл\.)\s*{W}(?: {W})?,\s*(?:д\.|дом)\s*\d+\w?(?:,\s*кв\.\s*\d+)?(?:,\s*г\.\s*{W})?", re.I),
    re.compile(rf"मकान (?:नंबर|नं\.?|संख्या|सं\.?)\s*\d+(?:,\s*गली\s*\d+)?(?:,\s*{W}(?: {W})?){{0,3}}(?:\s*[-–]\s*\d{{6}})?"),
)
#: Words that make a text worth one of the address patterns.
PLACES = {w: k for k, ws in enumerate((
    ("box", "postfach", "apartado", "а/я", "caixa postal", "boîte postale"),
    ("street", " avenue", " lane", " road", " close", " hill", " drive", " court", " place", " square", " terrace", " crescent", " st.", " ave", "boulevard"),
    (" rue ", " avenue ", " boulevard ", " chemin ", " impasse ", " allée ", " quai "),
    ("straße", "strasse", "str.", "gasse", "platz ", "allee"),
    ("calle ", "avenida", "plaza ", "paseo ", "rua ", "travessa", "c/"),
    ("ул.", "улица", "просп", "пер.", "переулок"),
    ("मकान",),
)) for w in ws}
NEAR_PHONE = re.compile(r"(?:phone|tel\b|telephone|mobile|call|reach|(?:old|new|my|phone|contact|mobile) number|fax|whatsapp|appelez|téléphone|llame|teléfono|rufen|telefon|звоните|телефон|फ़ोन|फोन|मोबाइल|telefone|ligue)[^\n;]{0,45}$")
AFTER_PHONE = re.compile(r"^[)\s,|\"]*(?:पर बात|है|an\b|\|)")
NEAR_ID = re.compile(r"(?:aadhaar|aadhar|\bssn\b|\bpan\b|passport|social security|identity|national id|\bid (?:no|number|card)|tax (?:id|no|number)|\btin\b|ausweis\w*|steuer\w*|identidad|\bdni\b|\bnif\b|identité|паспорт\w*|\bинн\b|снилс|आधार|पैन|पासपोर्ट|पहचान|contribuinte|\bcpf\b)[^\n;,]{0,22}$")
NEAR_OTHER = re.compile(r"(?:order|batch|catalogue|catalog|isbn|version|constant|value|serial|invoice|ticket|tracking|model|file|machine|build|release|milestone|page|step|install\w*|rounded|under|answered|from|bestell\w*|pedido|commande|заказ\w*|ऑर्डर)[^.;\n]{0,22}$")
NEAR_ADDRESS = re.compile(r"(?:live at|lives at|address|addr=|parcel to|send|shop is at|deliver\w* to|wohn\w*|anschrift|vivo en|dirección|adresse|habite|адрес|живу|पता|पत्र|moro|endereço)[^\n]{0,30}$")
PHONE_FORMS = re.compile(r"\+\d{1,3}[ .\-]?\(?\d{1,5}\)?(?:[ .\-]?\d{2,5}){1,4}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4}|0\d(?: \d{2}){4}|0\d{2,5}[ /\-]\d{3,8}(?: \d{2,4})?")
ID_FORMS = re.compile(r"\d{4}([ -]?)\d{4}\1\d{4}|\d{3}-\d{2}-\d{4}|[A-Za-z]{5}\d{4}[A-Za-z]|[A-Za-z]\d{7,8}")
OTHER_FORMS = re.compile(r"\d+\.\d{4,}|\d{1,3}(?:\.\d{1,3}){3}|\d{4}[-./]\d{2}[-./]\d{2}|\d{1,2}[-./]\d{1,2}[-./]\d{4}|\d+(?:-\d+){4,}|\d{14,}|\d+(?:\.\d+){2,4}|\d+ ?[-–/] ?\d{1,4}")
SAMPLE_ROWS = 4000
#: Given names learnt at most, the ones of most family names first; words a task counts before it passes them on.
NAMES_AT_MOST, WORDS_AT_ONCE = 100_000, 300_000


@lru_cache(None)
def _same_width() -> dict[int, str]:
    """Full-width forms and special spaces as the one plain character they look like."""
    return {k: v for k, v in table(False).items() if len(v) == 1 and (0xFF00 <= k <= 0xFFEF or v == " ")}


@lru_cache(None)
def _has_width() -> re.Pattern:
    return re.compile("[" + "".join(re.escape(chr(k)) for k in sorted(_same_width())) + "]")


def plain(text: str) -> tuple[str, list[int] | None]:
    """The text with full-width forms, special spaces and look-alike letters plain and invisible characters gone; with the place of each
    character in the original where that differs."""
    if text.isascii():
        return text, None
    t = text.translate(_same_width()) if _has_width().search(text) else text
    if _MAY_MIX.search(t) and MIXED.search(t):
        t = _WORD.sub(lambda m: m.group().translate(_ALIKE) if MIXED.search(m.group()) else m.group(), t)
    if any(map(t.__contains__, _INVISIBLE)):
        at = [k for k, c in enumerate(t) if not ignorable(c)]
        return "".join([t[k] for k in at]), at
    return t, None


#: A text without any of these mixes no alphabets; most texts end here.
_MAY_MIX = re.compile("[\u0370-\u04ff]")
_WORD, _ALIKE = re.compile(r"\w+"), {ord(k): v for k, v in ALIKE.items()}
_INVISIBLE = ("​", "‌", "‍", "⁠", "﻿", "­", "‎", "‏")


def digits(span: str) -> str:
    """The span with digits of any script as 0-9."""
    return span if span.isascii() else "".join(str(unicodedata.digit(c)) if c.isdigit() and unicodedata.digit(c, None) is not None else c for c in span)


class Lexicon:
    """Given names and common words of a sample: what the gazetteer labelers know."""

    def __init__(self, given: set[str], common: set[str]):
        self.given, self.common = given, common
        self.reset()

    def __getstate__(self):
        return self.given, self.common

    def __setstate__(self, s):
        self.given, self.common = s
        self.reset()

    def reset(self):
        self.find = ahocorasick.Automaton()
        for w, k in PLACES.items():
            self.find.add_word(w, ("place", k))
        for w in BEFORE_NAME:
            self.find.add_word(w, ("before", len(w)))
        for w in AFTER_CASELESS:
            self.find.add_word(w, ("after", len(w)))
        for w in self.given:
            self.find.add_word(w, ("given", len(w)))
        for w in ("@", "at)", "at]", " dot "):
            self.find.add_word(w, ("mail", len(w)))
        self.find.make_automaton()


_STREET = re.compile(rf"\d+(?:-?[a-z])?\s+((?:{W}\s+){{1,3}}?)(?:{STREETS})(?!\w)", re.I)


def _ordinary(span: str, lexicon: Lexicon) -> bool:
    """Whether what stands between number and street word are everyday words: a sentence, not a street."""
    m = _STREET.search(span)
    return bool(m) and all(w in lexicon.common for w in m.group(1).lower().split())


def _mark(c: str) -> bool:
    return c.isalnum() or c == "_" or "ऀ" <= c <= "ൿ" and c not in "।॥"


def _caseless(w: str) -> bool:
    return w[0].lower() == w[0].upper()


def _name_case(m: re.Match | None) -> bool:
    """Whether both words may be of a name: capital, or of a script without letter case."""
    return bool(m) and not m.group(1)[0].islower() and not m.group(2)[0].islower()


def _two_before(t: str, at: int) -> re.Match | None:
    """The two words without letter case that a context after names follows at this place; their places count from
    at - 60, or 0."""
    if not AFTER_CASELESS_WHOLE.match(t, at):
        return None
    m = LAST_TWO.search(t[max(0, at - 60) : at])
    return m if m and _caseless(m.group(1)) and _caseless(m.group(2)) else None


def candidates(t: str, lexicon: Lexicon) -> list[tuple[str, int, int, tuple, tuple]]:
    """(group, start, end, votes, shape) of every span a pattern or the gazetteer proposes, none inside another."""
    low = t.lower()
    if len(low) != len(t):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
    out, taken = [], []
    mail, place = False, set()
    given, before, after = [], [], []
    for end, (what, n) in lexicon.find.iter(low):
        s, e = end + 1 - n, end + 1
        if what == "mail":
            mail = True
        elif what == "place":
            place.add(n)
        elif what == "given":
            if (s == 0 or not _mark(low[s - 1])) and e < len(low) and not _mark(low[e]):
                given.append((s, e))
        elif what == "after":
            after.append(s)
        else:
            before.append((s, e))
    if mail:
        for m in EMAIL.finditer(t):
            s, e = m.span()
            while e > s and t[e - 1] in ".-":
                e -= 1
            out.append(("email", s, e, _email_votes(t, s, e), _email_shape(t[s:e])))
            taken.append((s, e))
    if place:
        found = sorted(m.span() for k in place for m in ADDRESS[k].finditer(t) if k != 1 or not _ordinary(m.group(), lexicon))
        last = -1
        for s, e in found:
            if s < last:
                continue
            if last > 0 and out and out[-1][0] == "address" and s - last <= 3 and not t[last:s].strip(" ,;\n") and ("box" in t[s:e].lower()) != ("box" in t[out[-1][1] : last].lower()):
                s = out.pop()[1]  # street and box of one address
                taken.pop()
            last = e
            out.append(("address", s, e, _address_votes(t, low, s, e), _address_shape(t[s:e])))
            taken.append((s, e))
    for m in NUMBER.finditer(t):
        s, e = m.span()
        span = m.group()
        n = sum(c.isdigit() for c in span)
        left = t[s - 1] if s else " "
        if n < 7 and not (n == 4 and left.isalpha() and s >= 5 and t[s - 5 : s].isalpha() and len(span) == 4 and e < len(t) and t[e].isalpha()):
            continue
        if left.isalnum() or left in "_.":
            k = s
            while k and (t[k - 1].isalnum()):
                k -= 1
            whole = t[k : e + (n == 4)]
            if not ID_FORMS.fullmatch(digits(whole)) or k and t[k - 1] in "_@.":
                continue
            s, e = k, k + len(whole)
        elif e < len(t) and (t[e].isalpha() or t[e] == "_"):
            continue
        if span.count(")") > span.count("(") and span.endswith(")"):
            e -= 1
        if any(a < e and s < b for a, b in taken):
            continue
        out.append(("number", s, e, _number_votes(t, low, s, e), _number_shape(t[s:e])))
    names: dict[int, tuple[int, int, bool]] = {}
    for s, e in given:
        m = FAMILY.match(t, e)
        if m and (m.group(1).lower() in lexicon.common and _case(m.group(1)) != "title" or _case(t[s:e]) == "title" and _case(m.group(1)) == "lower"):
            continue  # a given name alone
        if m and (s == 0 or low[s - 1] not in ".+@-_"):
            names[s] = (s, m.end(), True)
    for s, e in before:
        if s and _mark(low[s - 1]) and _mark(low[s]):
            continue
        m = TWO.match(t, e)
        if _name_case(m) and m.start(1) not in names and not (_caseless(m.group(2)) and m.group(2) in lexicon.common):
            names[m.start(1)] = (m.start(1), m.end(), False)
    for at in after:
        m = _two_before(t, at)
        if m and m.group(2) not in lexicon.common:
            s = max(0, at - 60) + m.start(1)
            names.setdefault(s, (s, at, False))
    for s, e, known in sorted(names.values()):
        if any(a < e and s < b for a, b in taken) or e < len(t) and t[e] in "@_":
            continue
        more = MORE_FAMILY.match(t, e)
        votes, shape = _name_votes(t, low, s, e, known, lexicon), _name_shape(t, low, s, e, lexicon)
        if more and more.group(1).lower() not in lexicon.common and more.group(1).lower() not in lexicon.given and not _caseless(more.group(1)) and more.group(1)[0].isupper() and _case(more.group(1)) == _case(t[s:e].split()[-1]):
            e = more.end()  # a family name of two words
        out.append(("name", s, e, votes, shape))
        taken.append((s, e))
    return out


# Votes: a class of the group (0: none of it) or -1. Shapes: small categorical features.


def _email_votes(t, s, e):
    span = t[s:e].lower()
    local, _, domain = re.sub(r" ?[(\[] ?at ?[)\]] ?| at ", "@", span).partition("@")
    domain = re.sub(r" ?[(\[] ?dot ?[)\]] ?| dot ", ".", domain)
    parts = domain.split(".")
    good = len(parts) > 1 and parts[-1].isalpha() and len(parts[-1]) > 1
    return (
        1 if re.fullmatch(r"[\w+\-][\w.+\-]*", local) and good else 0,
        0 if parts[-1].isdigit() or re.fullmatch(r"[\d.]+\w*", domain) else 1 if good else -1,
        1 if re.search(r"(?:mail|contact|write|reach|cc:|schreiben|escrib|écrivez|пишите|मुझे|bounced|tried)\W[^\n]{0,40}$", t[max(0, s - 50) : s].lower()) else -1,
        0 if re.search(r"(?:install|package|version|import|pip|npm)\s*$", t[max(0, s - 20) : s].lower()) else -1,
    )


def _email_shape(span):
    return ("disguised" if "@" not in span else "plain", "digits" if span[-1].isdigit() else "letters", f"dots{min(3, span.count('.'))}")


def _address_votes(t, low, s, e):
    span = low[s:e]
    return (
        1 if re.search(r"\d", span) else 0,
        1 if NEAR_ADDRESS.search(low[max(0, s - 60) : s]) else -1,
        1 if re.search(r"\d{4,6}", span) or span.count(",") >= 2 else -1,
        1 if re.search(r"box|flat|straße|strasse|gasse|calle|\brue\b|ул\.|मकान|\d+-?[a-z]?\s+\S+\s+(?:street|avenue|lane|road|close|hill)", span) else -1,
        0 if re.match(r"\d+ (?:of|in|on|at|the|to|from|and|a|has|was|is)\b", span) else -1,
        1 if s == 0 or t[s - 1] == "\n" or t[s - 1] in "=:" else -1,
    )


def _address_shape(span):
    return ("box" if "box" in span.lower() else "street", f"commas{min(3, span.count(','))}", "capital" if re.search(r"\d[\w-]*,? (?:\S+ )?[A-ZÀ-ÝА-Я]", span) else "no")


def _number_votes(t, low, s, e):
    span = re.sub(" +", " ", digits(t[s:e]))
    before, after = low[max(0, s - 60) : s].rpartition("\n")[2], low[e : e + 24]
    three = re.fullmatch(r"\d{4}[ -]\d{4}[ -]\d{4}", span)
    return (
        1 if PHONE_FORMS.fullmatch(span) and not three and 8 <= sum(c.isdigit() for c in span) <= 15 else -1,
        2 if ID_FORMS.fullmatch(span) else -1,
        1 if NEAR_PHONE.search(before) else -1,
        2 if NEAR_ID.search(before) else 0 if ID_FORMS.fullmatch(span) and not NEAR_PHONE.search(before) else -1,
        0 if NEAR_OTHER.search(before) else -1,
        0 if OTHER_FORMS.fullmatch(span) else -1,
        1 if AFTER_PHONE.search(after) and not NEAR_ID.search(before) else -1,
        1 if not before.strip(" |>-*") and re.match(r"[ .]*(?:\n|<\|im_end|$)", after) else -1,
    )


def _number_shape(span):
    d = digits(span)
    return (re.sub(r"[A-Za-z]+", "a", re.sub(r"\d+", lambda m: str(min(9, len(m.group()))), d))[:14], f"n{min(16, sum(c.isdigit() for c in d))}", "zero" if d.lstrip("(+").startswith("0") else "other")


def _case(w: str) -> str:
    return "upper" if w.isupper() and len(w) > 1 else "title" if w[0].isupper() else "lower" if w[0].islower() else "none"


def _name_votes(t, low, s, e, known, lexicon):
    first, *_, last = low[s:e].split()
    before = low[max(0, s - 18) : s].rstrip(" \"'=").rstrip()
    rest = t[e : e + 40]
    c = _case(t[s:e].split()[-1])
    cue = before.endswith(tuple(x.rstrip(" =\"") for x in BEFORE_NAME)) or before.endswith(("name", "contact\":", "|"))
    return (
        1 if known else -1,
        1 if cue else -1,
        1 if AFTER_NAME.match(rest) else -1,
        0 if last in lexicon.common else 1 if c in ("title", "none") else -1,
        1 if c == _case(t[s]+t[s+1]) and c != "lower" else -1,
        0 if re.match(rf"\s(?:{STREETS}|bridge|archive|river|valley|mountains?|method|treaty|county|island|lake|bay|university)\b", low[e : e + 14]) else -1,
        0 if first in lexicon.common and not known else -1,
    )


def _name_shape(t, low, s, e, lexicon):
    words = t[s:e].split()
    return (f"{_case(words[0])}-{_case(words[-1])}", "initial" if len(words) > 2 else "two", "common" if words[-1].lower() in lexicon.common else "rare", "short" if len(words[-1]) < 3 else "long")


GROUPS = {"email": ("email",), "number": ("phone", "id_number"), "address": ("address",), "name": ("name",)}
#: How likely a labeler is right before the sample speaks, and the weight of that.
TRUST, WEIGHT = 0.85, 8.0


class Model:
    """For each group: labelers' reliabilities and the span classifier."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.part = lexicon, {}

    def fit(self, seen: list[tuple[str, tuple, tuple]]) -> Model:
        for g, kinds in GROUPS.items():
            mine = [(v, sh) for group, v, sh in seen if group == g]
            n = len(kinds) + 1
            width = {"email": 4, "address": 6, "number": 8, "name": 7}[g]
            votes = np.array([v for v, _ in mine], int).reshape(-1, width)
            right, prior, soft = _em(votes, n)
            feature: dict[str, int] = {}
            rows = [[feature.setdefault(x, len(feature)) for x in _features(v, sh)] for v, sh in mine]
            # reliabilities also teach the classifier on every single vote and on votes the sample has not met
            w = _softmax_fit(rows, soft, len(feature), n)
            self.part[g] = (right, prior, feature, w)
        return self

    def classes(self, g: str, votes: list[tuple], shapes: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        right, prior, feature, w = self.part[g]
        v = np.array(votes, int)
        score = _posterior(v, right, prior)
        for k, (vv, sh) in enumerate(zip(votes, shapes)):
            for x in _features(vv, sh):
                if (j := feature.get(x)) is not None:
                    score[k] += w[j]
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def _features(votes, shape):
    return [f"v{k}={v}" for k, v in enumerate(votes)] + [f"s{k}={x}" for k, x in enumerate(shape)]


def _posterior(votes: np.ndarray, right: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Log posterior of each class from the votes by the labelers' reliabilities."""
    n = len(prior)
    score = np.tile(np.log(prior), (len(votes), 1))
    for k in range(votes.shape[1] if votes.ndim == 2 else 0):
        v = votes[:, k]
        has = v >= 0
        wrong = (1 - right[k]) / max(1, n - 1)
        for c in range(n):
            score[has, c] += np.log(np.where(v[has] == c, right[k], wrong))
    return score


def _em(votes: np.ndarray, n: int, rounds: int = 25):
    """Reliability of each labeler, class shares, soft labels."""
    right, prior = np.full(votes.shape[1], TRUST), np.full(n, 1 / n)
    soft = np.zeros((len(votes), n))
    for _ in range(rounds if len(votes) else 0):
        score = _posterior(votes, right, prior)
        soft = np.exp(score - score.max(axis=1, keepdims=True))
        soft /= soft.sum(axis=1, keepdims=True)
        prior = (soft.sum(axis=0) + 2) / (len(votes) + 2 * n)
        for k in range(votes.shape[1]):
            has = np.flatnonzero(votes[:, k] >= 0)
            hit = soft[has, votes[has, k]].sum()
            right[k] = min(0.98, max(0.55, (hit + WEIGHT * TRUST) / (len(has) + WEIGHT)))
    return right, prior, soft


def _softmax_fit(rows: list[list[int]], soft: np.ndarray, features: int, n: int, rounds: int = 150) -> np.ndarray:
    w = np.zeros((features, n))
    if not rows:
        return w
    x = np.zeros((len(rows), features))
    for k, r in enumerate(rows):
        x[k, r] = 1
    g2 = np.full_like(w, 1e-6)
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = x.T @ (soft - p) / len(rows) - 1e-3 * w
        g2 += grad * grad
        w += 0.3 * grad / np.sqrt(g2)
    return w


@lru_cache(None)
def _cues() -> ahocorasick.Automaton:
    find = ahocorasick.Automaton()
    for w in BEFORE_NAME:
        find.add_word(w, (True, len(w)))
    for w in AFTER_CASELESS:
        find.add_word(w, (False, len(w)))
    find.make_automaton()
    return find


def _near_cues(t: str):
    """(first, second) word, in lower case, at each context of names."""
    low = t.lower()
    if len(low) != len(t):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
    for end, (before, n) in _cues().iter(low):
        m = TWO.match(t, end + 1) if before else _two_before(t, end + 1 - n)
        if _name_case(m):
            yield m.group(1).lower(), m.group(2).lower()


def _counts(batches):
    """(word, other, n, cued): in how many texts a word stands, and at a context of names; the words after it there."""

    def flush():
        rows = [(w, None, n, cued[w]) for w, n in df.items()] + [(w, o, 0, 0) for w, o in follow]
        df.clear(), cued.clear(), follow.clear()
        cols = list(zip(*rows)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["word", "other", "n", "cued"])

    df, cued, follow = Counter(), Counter(), set()
    for b in batches:
        for t in b.column(1).to_pylist():
            t = plain(t)[0]
            df.update(set(W_FAST.findall(t.lower())))
            if near := set(_near_cues(t)):
                follow |= near
                cued.update({first for first, _ in near})
            if len(df) + len(follow) > WORDS_AT_ONCE:
                yield flush()
    yield flush()


def _name_words(df: dict[str, int], cued: dict[str, int], follow: dict[str, int], n: int) -> tuple[set[str], set[str]]:
    """(given names, common words) from document frequencies, how often a word stands at a context of names and before
    how many different words there, in n texts. A name stands at such a context in a good part of its texts."""
    known = {w.lower() for w in GIVEN}
    least = max(3, n // 800)
    common = {w for w, k in df.items() if k >= least and w not in known}
    given = known | {w for w, k in follow.items() if k >= 3 and len(w) > 2 and df.get(w, 0) < n / 20 and cued[w] >= 0.2 * df.get(w, 0)}
    return given, common - given


def lexicon(d: DataFrame) -> Lexicon:
    """Given names and common words of all distinct texts of (_id, _text), by one aggregation over the rows."""
    d = d.where("_text is not null and trim(_text) <> ''")
    keyed = d.select("_id", F.xxhash64("_text").alias("k1"), F.xxhash64(F.lit(5), "_text").alias("k2"))
    firsts = materialise(keyed.groupBy("k1", "k2").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("times")), "p5k")
    n = firsts.count()
    copies = keyed.join(firsts.where("times > 1"), ["k1", "k2"]).where("_id <> _first").select("_id")
    counted = arrow_map(d.join(copies, "_id", "left_anti"), _counts, "word string, other string, n long, cued long")
    pairs = counted.groupBy("word", "other").agg(F.sum("n").alias("n"), F.sum("cued").alias("cued"))
    words = materialise(pairs.groupBy("word").agg(F.sum("n").alias("n"), F.sum("cued").alias("cued"), F.count("other").alias("names")).where((F.col("n") >= max(3, n // 800)) | (F.col("names") >= 3)), "p5w")
    rows = words.where(F.col("n") >= max(3, n // 800)).collect()  # as many as words of one text in 800, times 800, at most
    rows += words.where((F.col("n") < max(3, n // 800)) & (F.col("cued") >= 0.2 * F.col("n"))).orderBy(F.desc("names"), "word").limit(NAMES_AT_MOST).collect()
    return Lexicon(*_name_words({r.word: r.n for r in rows}, {r.word: r.cued for r in rows}, {r.word: r.names for r in rows if r.names}, n))


def learn(texts: list[str], words: Lexicon | None = None) -> Model:
    """A model from sample texts, without labels; `words`: names and common words of the whole corpus, else those of the
    sample."""
    distinct = list(dict.fromkeys(plain(t)[0] for t in texts))
    if words is None:
        df, cued, follow = Counter(), Counter(), set()
        for t in distinct:
            df.update(set(W_FAST.findall(t.lower())))
            near = set(_near_cues(t))
            follow |= near
            cued.update({first for first, _ in near})
        words = Lexicon(*_name_words(df, cued, Counter(first for first, _ in follow), len(distinct)))
    return Model(words).fit([(g, v, sh) for t in distinct for g, _, _, v, sh in candidates(t, words)])


def train(df: DataFrame, id_col: str = "ord", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """A model from the word counts of all rows and a bounded sample of about `rows` rows, drawn by a hash of the id."""
    n = df.count()
    place = F.pmod(F.xxhash64(F.lit("pii"), id_col), F.lit(1_000_003)) / 1_000_003.0
    got = df.where(F.col(text_col).isNotNull() & (place < rows / max(1, n))).select(id_col, text_col).limit(2 * rows).collect()
    return learn([r[1] for r in sorted(got)], lexicon(id_and_text(df, id_col, text_col)))


def spans(model: Model, text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, confidence) in order of place."""
    t, at = plain(text)
    found = candidates(t, model.lexicon)
    out = []
    for g, kinds in GROUPS.items():
        mine = [c for c in found if c[0] == g]
        if mine:
            which, p = model.classes(g, [c[3] for c in mine], [c[4] for c in mine])
            out += [(kinds[k - 1], c[1], c[2], float(q)) for c, k, q in zip(mine, which, p) if k > 0]
    out.sort(key=lambda x: (x[1], x[2]))
    if at is not None:
        out = [(k, at[s], at[e - 1] + 1, q) for k, s, e, q in out]
    return out


def mentions(df: DataFrame, model: Model, id_col: str = "ord", text_col: str = "text") -> DataFrame:
    """(id, kind, nth, start, end, confidence) of each mention; nth counts a kind's mentions in the text from 1.

    Null and empty texts have none; a repeated value counts each time.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on

    def run(batches):
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t:
                    continue
                n: dict[str, int] = {}
                for kind, s, e, q in spans(shared.value, t):
                    n[kind] = n.get(kind, 0) + 1
                    rows.append((i, kind, n[kind], s, e, q))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = (b.schema.field(0).type, pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["_id", "kind", "nth", "start", "end", "confidence"])

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(id_and_text(df, id_col, text_col), run, f"_id {kind}, kind string, nth long, start int, end int, confidence double").withColumnRenamed("_id", id_col)


def redact(df: DataFrame, model: Model, id_col: str = "ord", text_col: str = "text") -> DataFrame:
    """(id, redacted) of every row: each mention replaced by its placeholder, as [EMAIL]; the rest is unchanged, a
    null text stays null."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                if t:
                    for kind, s, e, _ in reversed(spans(shared.value, t)):
                        t = f"{t[:s]}[{kind.upper()}]{t[e:]}"
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["_id", "redacted"])

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(id_and_text(df, id_col, text_col), run, f"_id {kind}, redacted string").withColumnRenamed("_id", id_col)


def found(df: DataFrame, id_col: str = "ord", text_col: str = "text") -> DataFrame:
    """(ord, kind, nth) of each mention."""
    return mentions(df, train(df, id_col, text_col), id_col, text_col).select(id_col, "kind", "nth")
