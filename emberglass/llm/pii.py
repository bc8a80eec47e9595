"""Personal information inside free text: found, and replaced by a placeholder of its type.

Patterns propose spans, check sums and shapes confirm them, words nearby raise or lower their score. A span counts from a
score of ``ACCEPT``; of overlapping spans the type that comes first in ``_ORDER`` keeps the place.
"""

from __future__ import annotations

import re as stdlib_re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCEPT = 1.0
_ORDER = ("email", "street_address", "identity_number", "phone", "person_name")
#: Most names a name list may have: it is sent to every executor.
MOST_NAMES = 500_000

# Characters with a plain form of the same length, so that places in the text stay the same.
_PLAIN = {i: chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F)} | {i: "-" for i in (0x2010, 0x2011, 0x2012, 0x2013, 0x2212)} | {i: " " for i in (0xA0, 0x2007, 0x2009, 0x202F, 0x3000)} | {0x2019: "'"}
_NEEDS_PLAIN = re.compile("[" + "".join(map(re.escape, map(chr, _PLAIN))) + "]")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


# ---- e-mail ----
_AT = r"(?:\s?@\s?|\s?[\(\[\{]\s?at\s?[\)\]\}]\s?)"
_DOT = r"(?:\.|\s?[\(\[\{]\s?dot\s?[\)\]\}]\s?)"
_LOCAL = r"[\p{L}\p{N}_+\-%]"
_EMAIL = re.compile(rf"(?i)(?<![\p{{L}}\p{{N}}_@])(?P<local>{_LOCAL}+(?:(?:\.|\s?[\(\[\{{]\s?dot\s?[\)\]\}}]\s?){_LOCAL}+)*){_AT}(?P<host>[\p{{L}}\p{{N}}\-]+(?:{_DOT}[\p{{L}}\p{{N}}\-]+)+)")
_SPELLED_EMAIL = re.compile(rf"(?i)(?<![\p{{L}}\p{{N}}_@])(?P<local>{_LOCAL}+(?:(?:\.|\s+dot\s+){_LOCAL}+)*)\s+at\s+(?P<host>[\p{{L}}\p{{N}}\-]+(?:\s+dot\s+[\p{{L}}\p{{N}}\-]+)+)")
_FILES = {"png", "jpg", "jpeg", "gif", "svg", "webp", "bmp", "ico", "pdf", "txt", "js", "css", "json", "zip", "mp3", "mp4"}


def _emails(t: str, low: str) -> Iterator[Span]:
    found = list(_EMAIL.finditer(t)) if "@" in t or "at)" in low or "at]" in low or "at}" in low or "at )" in low else []
    if " dot " in low:
        found += _SPELLED_EMAIL.finditer(t)
    for m in found:
        last = re.split(r"[^\p{L}\p{N}\-]+", m["host"])[-1].lower()
        if last in _FILES or len(last) < 2 or last.isdigit():
            continue
        yield Span("email", m.start(), m.end(), 2.0)


# ---- street address ----
_STREET = r"(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|boulevard|blvd|court|ct|close|terrace|place|way|square|crescent|parade)"
_FLAT = r"(?:(?:flat|apt|apartment|unit|suite|wohnung|piso|appt|appartement)\.?\s+\d{1,4}\s?[a-z]?,?\s+)"
_HOUSE = r"(?:[\p{L}'\-]+\s+(?:house|court|lodge|mansions|building)(?:,)\s+)"
_TOWN = r"[\p{L}'\-]+(?:\s+(?:bay|hill|park|beach|city|springs|falls|heights))?"
_AFTER = rf"(?:,\s*(?:\d{{4,5}}\s+{_TOWN}|{_TOWN}(?:\s+\d{{4,5}}\b)?))?"
_NUMBER = r"\d{1,5}\s?[a-d]?(?:\s?-\s?\d{1,4})?"
_ADDRESS = (
    re.compile(rf"(?i)(?<![\p{{L}}\p{{N}}]){_FLAT}?{_HOUSE}?{_NUMBER}\s+(?:(?:n|s|e|w|north|south|east|west)\.?\s+)?(?P<name>[\p{{L}}'\-]+(?:\s+[\p{{L}}'\-]+){{0,2}}?)\s+{_STREET}\b\.?{_AFTER}"),
    re.compile(rf"(?i)(?<![\p{{L}}\p{{N}}]){_FLAT}?{_NUMBER},?\s+(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours)\s+(?:(?:de|du|des)\s+(?:la\s+|l')?|d'|de\s+l')?(?P<name>[\p{{L}}'\-]+){_AFTER}"),
    re.compile(rf"(?i)(?<![\p{{L}}\p{{N}}]){_FLAT}?(?:calle|avenida|avda\.?|paseo|plaza|camino|carrera|ronda de|via|viale|corso)\s+(?:(?:de|del)\s+(?:la\s+|los\s+|las\s+)?)?(?P<name>[\p{{L}}'\-]+(?:\s+[\p{{L}}'\-]+)?),?\s+{_NUMBER}(?![\p{{L}}\p{{N}}]){_AFTER}"),
    re.compile(rf"(?i)(?<![\p{{L}}\p{{N}}])(?P<name>[\p{{L}}\-]{{2,}}(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm|ring)),?\s+{_NUMBER}(?![\p{{L}}\p{{N}}]){_AFTER}"),
)
_HOME = re.compile(r"(?i)\b(?:live[sd]? at|address|home|deliver|ship|parcel|meet at|adresse|wohn\w*|habite|vivo en|dirección|moved to|door)\b")
_GAME = re.compile(r"(?i)\b(?:streets|blocks|boss|loot|in game)\b")


# Words without which a pattern cannot match: looked for first, as that is far cheaper.
_ADDRESS_WORDS = (
    tuple(" " + w for w in _STREET[3:-1].split("|")),
    ("rue ", "avenue ", "boulevard ", "place ", "chemin ", "allée ", "impasse ", "quai ", "cours "),
    ("calle ", "avenida ", "avda", "paseo ", "plaza ", "camino ", "carrera ", "ronda de ", "via ", "viale ", "corso "),
    ("straße", "strasse", "str.", "gasse", "weg", "platz", "allee", "ufer", "damm", "ring"),
)


def _addresses(t: str, low: str) -> Iterator[Span]:
    for p, needed in zip(_ADDRESS, _ADDRESS_WORDS, strict=True):
        if not any(w in low for w in needed):
            continue
        for m in p.finditer(t):
            near = t[max(0, m.start() - 40) : m.start()]
            score = 0.7 + 0.6 * bool(_HOME.search(near)) - 0.8 * bool(_GAME.search(m[0]))
            words = m["name"].split()
            if any(w[0].isupper() for w in words):
                score += 0.4
            if len(words) == 1 and words[0].lower() in {"the", "a", "my", "this", "that", "one", "of"}:
                score -= 1.5
            yield Span("street_address", m.start(), m.end(), score)


# ---- identity number ----
_LABEL = (
    r"(?:social security(?:\s+(?:number|no\.?))?|ssn|passport(?:\s+(?:no\.?|number))?|passnummer|reisepass(?:nummer)?|passeport|pasaporte|id[ -]?card|identity card|identity number|id number|"
    r"ausweis(?:nummer|nr\.?)?|personalausweis|carte d'identité|dni|nie|nif|national insurance|nino?|driver'?s?'? licen[cs]e|driving licen[cs]e|führerschein(?:nummer)?|permis de conduire|licencia de conducir|"
    r"tax[ -]?(?:id|number|payer number)|tin|steuer[ -]?id|steuernummer|numéro fiscal|nss|sécurité sociale|seguridad social|sozialversicherungsnummer)"
)
_VALUE = r"(?P<value>(?=[A-Z0-9.\-/ ]*\d(?:[A-Z0-9.\-/ ]*\d){4})[A-Z0-9]{1,12}(?:(?:[.\-/]| (?=[A-Z]?\d|[A-Z]\b))[A-Z0-9]{1,9}){0,6})"
_IDENTITY = re.compile(rf"(?i:(?<![\p{{L}}\p{{N}}]){_LABEL}(?![\p{{L}}]))(?P<between>[\s:#=,.]*(?:(?i:is|es|ist|est|lautet|it's|its|no|no\.|number|nummer|numéro|número|nr|nr\.|:|=|was|war|here|hier)[\s:#=,.]+){{0,3}}){_VALUE}")


_LABEL_NEAR = re.compile(rf"(?i)(?<![\p{{L}}\p{{N}}]){_LABEL}(?![\p{{L}}])")


def luhn(digits: str) -> bool:
    """Luhn's check sum."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return bool(digits) and total % 10 == 0


def mod97(text: str) -> bool:
    """The check sum of ISO 7064, with letters as 10 to 35; the last two digits are the check digits."""
    plain = "".join(str(int(c, 36)) for c in text if c.isascii() and c.isalnum())
    return len(plain) > 4 and int(plain) % 97 == 1


def _eleven(d: str) -> bool:
    """Two check digits modulo 11 behind nine digits."""
    if len(d) != 11:
        return False
    for n in (9, 10):
        s = sum(int(d[i]) * (n + 1 - i) for i in range(n)) * 10 % 11 % 10
        if s != int(d[n]):
            return False
    return True


def _letter(text: str) -> bool:
    """Eight digits and the letter that their remainder by 23 selects."""
    m = re.fullmatch(r"(\d{8})-?([A-Z])", text)
    return bool(m) and "TRWAGMYFPDXBNJZSQVHLCKE"[int(m[1]) % 23] == m[2]


_SHAPES = re.compile(r"\d{3}[- ]\d{2}[- ]\d{4}|\d{2} ?\d{3} ?\d{3} ?\d{3}|\d{2}-\d{7}|\d{9}|[A-Z]{2}\d{7}|\d{2} \d{4} \d{4} \d{2}|\d{3}\.\d{3}\.\d{3}-\d{2}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|\d{8}-?[A-Z]|[A-Z]\d{2}[A-Z]\d{5}|[A-Z]\d{8}")


def checked(value: str) -> bool:
    """Whether one of the check sums of identity numbers holds."""
    d = re.sub(r"\D", "", value)
    return luhn(d) or mod97(re.sub(r"[^A-Z0-9]", "", value.upper())) or _eleven(d) or _letter(value.upper())


_LABEL_WORDS = ("social", "ssn", "pass", "pasaporte", "id", "identi", "ausweis", "dni", "nie", "nif", "insurance", "nin", "licen", "schein", "permis", "tax", "tin", "steuer", "fiscal", "nss", "segur", "sécur")
_ANY_DIGIT = stdlib_re.compile(r"\d")


def _identities(t: str, low: str) -> Iterator[Span]:
    for m in _IDENTITY.finditer(t):
        value = m["value"].rstrip(" .-/")
        while True:  # a word behind the number is no part of it
            cut = re.sub(r" (?![^ ]*\d)[A-Z]{2,}$", "", value)
            if cut == value:
                break
            value = cut
        shaped = value
        while shaped and not _SHAPES.fullmatch(shaped):  # what stands behind a number of known shape is no part of it
            shaped = shaped[: max((shaped.rfind(c) for c in " .-/"), default=-1)] if re.search("[ .\\-/]", shaped) else ""
        value = shaped or value
        if len(re.sub(r"\D", "", value)) < 5:
            continue
        score = 0.7 + 0.5 * bool(shaped) + 0.3 * checked(value)  # the label alone is not enough
        yield Span("identity_number", m.start("value"), m.start("value") + len(value), score)


_BARE = re.compile(r"(?<![\p{L}\p{N}_.+\-,/$#])(?:(?P<eleven>\d{3}\.\d{3}\.\d{3}-\d{2})|(?P<letter>\d{8}-?[A-Z])|(?P<social>(?!000|666)\d{3}-(?!00)\d{2}-(?!0000)\d{4}))(?![\p{L}\p{N}_]|[.,:\-/]\d)")


def _bare_identities(t: str) -> Iterator[Span]:
    """Numbers without a label right before them, of a shape of their own: the check digits or letter decide, or where a shape has none, a label word nearby."""
    for m in _BARE.finditer(t):
        near = t[max(0, m.start() - 40) : m.start()] + " " + t[m.end() : m.end() + 25]
        confirmed = _eleven(re.sub(r"\D", "", m[0])) if m["eleven"] else _letter(m[0]) if m["letter"] else bool(_LABEL_NEAR.search(near))
        score = 0.5 + 0.6 * confirmed - 1.5 * bool(_OTHER.search(t[max(0, m.start() - 28) : m.start()]))
        yield Span("identity_number", m.start(), m.end(), score)


# ---- phone ----
_PHONE = re.compile(
    r"(?<![\p{L}\p{N}_.+\-,/$#])(?P<n>(?:\+|00)\s?\d{1,3}(?:[\s.\-/]?\(\d{1,4}\))?(?:[\s.\-/]?\d{1,6}){1,6}"
    r"|\(\+?\d{1,5}\)[\s.\-/]?\d{2,6}(?:[\s.\-/]?\d{2,6}){1,4}"
    r"|0\d{1,4}(?:[\s.\-/]\d{2,8}){1,4}"
    r"|\d{3}[\s.\-]\d{3}[\s.\-]\d{4}"
    r"|\d{7,15}"
    r"|\d{2,5}(?:[\s.\-/]\d{2,8}){1,5})(?![\p{L}\p{N}_]|[.,:\-/]\d)"
)
_DIGIT_WORD = r"(?:zero|oh|o|one|two|three|four|five|six|seven|eight|nine|null|eins|zwo|zwei|drei|vier|fünf|sechs|sieben|acht|neun|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|zéro|un|deux|trois|quatre|cinq|sept|huit|neuf|double|triple)"
_SPOKEN = re.compile(rf"(?i)(?<![\p{{L}}\p{{N}}]){_DIGIT_WORD}(?:[\s,\-]+{_DIGIT_WORD}){{6,}}(?![\p{{L}}])")
_TWO_SPOKEN = stdlib_re.compile(rf"\b{_DIGIT_WORD}[\s,\-]+{_DIGIT_WORD}\b")
_CALL = re.compile(r"(?i)\b(?:call|phone|tel|telephone|cell|mobile|text|whats\w*|number is|ring|ruf|anruf\w*|telefon|handy|nummer|appelle|téléphone|portable|teléfono|móvil|llama\w*|line|landline|sms|fax|reach me)\b")
_OTHER = re.compile(r"(?i)\b(?:ticket|order|serial|invoice|message|build|version|ip|level|paid|credits|case|bug|tracking|sku|ref|card|score|room|port|issue|pr|id|release)\b[\s:#.]*(?:no\.?|number|nr\.?|shows|is)?[\s:#.]*$")


def _phones(t: str, low: str, digits: int) -> Iterator[Span]:
    for m in _PHONE.finditer(t) if digits >= 7 else ():
        text = m["n"]
        d = re.sub(r"\D", "", text)
        if not 7 <= len(d) <= 15:
            continue
        before, after = t[max(0, m.start() - 28) : m.start()], t[m.end() : m.end() + 22]
        score = 0.0
        if text[0] == "+" or text.startswith("00"):
            score += 1.2
        elif text[0] == "(":
            score += 1.1
        elif text[0] == "0" and re.fullmatch(r"0\d{1,4}(?:[\s.\-/]\d{2,8}){1,4}", text):
            score += 0.7
        elif re.fullmatch(r"[2-9]\d{2}([\s.\-])[2-9]\d{2}\1\d{4}", text):
            score += 1.0
        elif re.fullmatch(r"\d{4}-\d{2}-\d{2}.*", text) or re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", text):
            score -= 1.0
        if _CALL.search(before) or _CALL.search(after):
            score += 0.8
        if _OTHER.search(before):
            score -= 1.5
        yield Span("phone", m.start("n"), m.end("n"), score)
    if low.count(" ") + low.count("-") > 5 and _TWO_SPOKEN.search(low):
        for m in _SPOKEN.finditer(t):
            near = t[max(0, m.start() - 28) : m.start()] + " " + t[m.end() : m.end() + 22]
            yield Span("phone", m.start(), m.end(), 0.7 + 0.6 * bool(_CALL.search(near)))


# ---- person name ----
_W = r"[\p{L}][\p{L}\p{M}'\-]*\p{L}"
_NAME_WORD = stdlib_re.compile(r"(?<![\w@/+.\-])[^\W\d_](?:[^\W\d_]|['\-\u0300-\u036f])*[^\W\d_](?![\w@+]|-\d)")
#: Words that lead to a name or stand near one and are none themselves.
_NO_NAME = frozenset(
    "my name is am are called me llamo mi nombre es soy ich heiße heisse mein je m'appelle mon nom est regards signed sincerely gruß grüße gruss ask for met with paid by belongs to teacher coach boss mister mr mrs ms miss dr "
    "prof herr frau señor señora sr sra monsieur madame mme why does who contact from cousin brother sister friend neighbour neighbor attn dear the a an this that it and or but so if in on at of i you he she we they your our call mount "
    "meet email mail write send text cell tel whats merci gracias danke hello hi hey yo ok lol gg thanks anyone did can could would should where what when no not yes flat apt house server level score ping just joined posting ship deliver vivo parcel".split()
)
#: Words right before a name, right behind one, and right behind a place or thing that bears one.
_BEFORE = tuple(
    " " + w
    for w in (
        "my name is", "name's", "i am called", "me llamo", "mi nombre es", "soy", "ich heiße", "ich heisse", "mein name ist", "je m'appelle", "mon nom est", "regards,", "signed,", "sincerely,", "gruß,", "grüße,", "ask for", "met with",
        "met", "paid by", "belongs to", "teacher", "coach", "boss", "mister", "mr", "mr.", "mrs", "mrs.", "ms", "ms.", "miss", "dr", "dr.", "prof", "prof.", "herr", "frau", "señor", "señora", "sr", "sr.", "sra", "sra.", "monsieur",
        "madame", "mme", "why does", "who is", "cousin", "brother", "sister", "friend", "neighbor", "neighbour", "attn", "attn:", "dear",
    )
)
_BEHIND = ("signed the", "told me", "still on vacation", "saw the", "own two", "owns two", "called support", "at the desk", "at the raid", "last week", "and i was", ", merci", "is my", "said", "wrote", "lives", "works at", "phoned", "emailed")
_PLACES = ("stadium", "ladder", "update", "raid", "arena", "club", "lounge", "market", "trading", "map", "mount", "house", "road", "street", "avenue", "cup", "league", "bay", "bridge", "hall", "school", "airport", "park", "tower", "server", "build", "mode")
_GAP = re.compile(r"(?:\s+|\s+\p{L}\.\s*(?:\p{L}\.\s*)?|\s+\p{L}\s+)")
_INITIAL_AFTER = re.compile(r"\s\p{Lu}\.(?!\s?\p{L})|\s\p{Lu}\.(?=\s+\p{Ll})")
_INITIAL_BEFORE = re.compile(r"(?<![\p{L}\p{N}_.])\p{L}\.\s?(?:\p{L}\.\s?)?$")


def _fold(w: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", w.casefold()) if not unicodedata.combining(c)) if not w.isascii() else w.lower()


class Names:
    """Known given and family names, and the endings that many of them share, by which unknown names are guessed."""

    def __init__(self, rows: list[tuple[str | None, str | None]]):
        self.given = {_fold(n.strip()) for k, n in rows if n and n.strip() and k != "family"}
        self.family = {_fold(n.strip()) for k, n in rows if n and n.strip() and k != "given"}
        self.given_ends, self.family_ends = self._ends(self.given), self._ends(self.family)
        self.seen: dict[str, tuple[float, float]] = {}

    @staticmethod
    def _ends(words: set[str]) -> set[str]:
        count: dict[str, int] = {}
        for w in words:
            for n in (3, 4, 5):
                if len(w) > n + 1:
                    count[w[-n:]] = count.get(w[-n:], 0) + 1
        return {e for e, c in count.items() if c >= max(3, len(words) // 80)}

    def weights(self, word: str) -> tuple[float, float]:
        """How much a word looks like a given and like a family name, 0 to 1; kept for the words seen so far."""
        hit = self.seen.get(word)
        if hit is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            hit = self.seen[word] = (0.0, 0.0) if word.lower() in _NO_NAME else (self._weight(word, self.given_ends, self.given), self._weight(word, self.family_ends, self.family))
        return hit

    def _weight(self, word: str, ends: set[str], known: set[str]) -> float:
        w = _fold(word)
        if w in known:
            return 1.0
        if any(w.endswith(x) and w[: -len(x)] in known for x in ("ova", "a", "s")):
            return 0.8
        if any(w[-n:] in ends for n in (5, 4, 3)):
            return 0.6 if word[0].isupper() else 0.5
        return 0.0 if len(word) < 4 or not word.isalpha() else 0.3 if word[0].isupper() else 0.2

    def find(self, t: str, low: str) -> Iterator[Span]:
        words = list(_NAME_WORD.finditer(t))
        both = [self.weights(m[0]) for m in words]
        g, f = [b[0] for b in both], [b[1] for b in both]
        strong = [max(b) >= 0.5 for b in both]
        weak = any(w in low for w in _BEHIND)  # without a word behind it no weak pair can pass
        if not weak and not any(strong):
            return
        strong.append(False)
        i = 0
        while i < len(words):
            best: tuple[float, int, int, int] | None = None  # score, start, end, words
            m = words[i]
            if g[i] + f[i] == 0 or not (weak or strong[i] or strong[i + 1]):
                i += 1
                continue
            start = m.start()
            if i + 1 < len(words):
                n = words[i + 1]
                between = t[m.end() : n.start()]
                pair = 0.0
                if _GAP.fullmatch(between) and "\n" not in between:
                    pair = max(g[i] + f[i + 1] if g[i] and f[i + 1] else 0, 0.8 * (f[i] + g[i + 1]) if f[i] and g[i + 1] else 0)
                elif between in (", ", ","):
                    pair = f[i] + g[i + 1] if f[i] and g[i + 1] else 0.0
                if pair and (m[0][0].isupper() == n[0][0].isupper() or "." in between):
                    best = (self._scored(t, start, n.end(), pair, max(g[i], f[i], g[i + 1], f[i + 1])), start, n.end(), 2)
            lead = _INITIAL_BEFORE.search(t, max(0, start - 8), start)
            if lead and f[i] and (not best or best[0] < ACCEPT):
                best = (self._scored(t, lead.start(), m.end(), f[i] + 0.5, f[i]), lead.start(), m.end(), 1)
            tail = _INITIAL_AFTER.match(t, m.end())
            if tail and g[i] and not (best and best[0] >= ACCEPT):
                best = (self._scored(t, start, tail.end(), g[i] + 0.5, g[i]), start, tail.end(), 1)
            if best and best[0] >= ACCEPT:
                yield Span("person_name", best[1], best[2], best[0])
                i += best[3]
            else:
                i += 1

    @staticmethod
    def _scored(t: str, start: int, end: int, base: float, least: float) -> float:
        """Two known words suffice; with anything less the words nearby decide, and words like no name need them on both sides."""
        behind = t[end : end + 24].lstrip().lower()
        after = behind.startswith(_BEHIND)
        if least < 0.5 and not after:
            return 0.0
        before = (" " + t[max(0, start - 24) : start].lower().rstrip()).endswith(_BEFORE)
        if least < 0.5 and not before:
            return 0.0
        return 0.55 * base + 0.6 * (before + after) - 0.6 * behind.startswith(_PLACES)


def find_in(text: str | None, names: Names) -> list[Span]:
    """All mentions of one text in order of place; none for null and empty text."""
    if not text:
        return []
    t = text.translate(_PLAIN) if not text.isascii() and _NEEDS_PLAIN.search(text) else text
    low = t.lower()
    spans: list[Span] = []
    digits = len(_ANY_DIGIT.findall(t))
    spans += _emails(t, low)
    if digits:
        spans += _addresses(t, low)
        if digits >= 5 and any(w in low for w in _LABEL_WORDS):
            spans += _identities(t, low)
        if digits >= 8:
            spans += _bare_identities(t)
    spans += _phones(t, low, digits)
    spans += names.find(t, low)
    taken: list[Span] = []
    for s in sorted((s for s in spans if s.score >= ACCEPT), key=lambda s: (_ORDER.index(s.kind), -s.score, s.start)):
        if all(s.end <= o.start or s.start >= o.end for o in taken):
            taken.append(s)
    return sorted(taken, key=lambda s: s.start)


def remembering(most: int = 50_000):
    """``find_in`` that keeps the results of short texts it has seen, as messages repeat."""
    seen: dict[str, list[Span]] = {}

    def find(text: str | None, names: Names) -> list[Span]:
        if not text or len(text) > 400:
            return find_in(text, names)
        spans = seen.get(text)
        if spans is None:
            if len(seen) >= most:
                seen.clear()
            spans = seen[text] = find_in(text, names)
        return spans

    return find


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with ``[TYPE]`` in place of each span; all else as it was."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join([*out, text[at:]])


def load_names(known_names: DataFrame) -> Names:
    """The name list; fails when it has more than ``MOST_NAMES`` rows."""
    rows = known_names.select("given_or_family", "known_name").where("known_name is not null").limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} known names")
    return Names([(r[0], r[1]) for r in rows])


def mentions(texts: DataFrame, known_names: DataFrame) -> DataFrame:
    """``(id, pii_type, span_start, span_end, score)``, one row per mention in ``texts(id, text)``.

    Places count code points from 0. Null and empty texts have no mention, repeated rows give repeated mentions, extra columns
    are ignored, whole texts are read. No shuffle: texts are searched in the Arrow batches they are read in; the name list is
    broadcast, its size checked.
    """
    shared = texts.sparkSession.sparkContext.broadcast(load_names(known_names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known = shared.value, remembering()
        for b in batches:
            rows = [(i, s) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for s in known(t, names)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in rows], pa.int64()), pa.array([s.kind for _, s in rows], pa.string()), pa.array([s.start for _, s in rows], pa.int64()), pa.array([s.end for _, s in rows], pa.int64()), pa.array([s.score for _, s in rows], pa.float64())],
                names=["id", "pii_type", "span_start", "span_end", "score"],
            )

    spoken = texts.select(F.col("id").cast("bigint"), F.col("text").cast("string")).where("text is not null and text <> ''")
    return spoken.mapInArrow(run, "id bigint, pii_type string, span_start bigint, span_end bigint, score double")


def redact(texts: DataFrame, known_names: DataFrame) -> DataFrame:
    """``(id, text, n_found)`` with placeholders in the texts; null stays null, empty stays empty."""
    shared = texts.sparkSession.sparkContext.broadcast(load_names(known_names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known = shared.value, remembering()
        for b in batches:
            texts_ = b.column(1).to_pylist()
            found = [known(t, names) for t in texts_]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([redacted(t, s) for t, s in zip(texts_, found, strict=True)], pa.string()), pa.array([len(s) for s in found], pa.int32())], names=["id", "text", "n_found"])

    return texts.select(F.col("id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "id bigint, text string, n_found int")
