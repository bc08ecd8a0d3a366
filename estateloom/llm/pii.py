"""Personal data in free text: patterns propose spans, validators and nearby words score them, typed placeholders replace them.

Every proposal has a kind and a score: what its form alone is worth, plus what validators (Luhn, mod 97, check letters)
confirm, plus what the words next to it say for or against. Proposals below the threshold fall away, overlapping ones are
settled by score. Spark partitions the texts; the scan is a helper run over Arrow batches, so no key can be hot.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estateloom.functions.skew import salted_join, spread
from estateloom.operators import parse_recovery

THRESHOLD = 1.0
Span = tuple[int, int, str, float]

#: full-width forms read as their ASCII counterparts, one for one, so that positions stay
_NARROW = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0xA0: 0x20}

# ---------------------------------------------------------------- e-mail
_LOCAL = r"[\w][\w.+%'-]*"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
_AT = r"(?:@|\s*[\[({]\s*at\s*[\])}]\s*|\s+AT\s+|\s+at\s+)"
_DOT = r"(?:\.|\s*[\[({]\s*dot\s*[\])}]\s*|\s+DOT\s+|\s+dot\s+)"
_EMAIL = re.compile(rf"(?<![\w.+%-])(?P<local>{_LOCAL})(?P<at>{_AT})(?P<domain>{_LABEL}(?:{_DOT}{_LABEL})+)")
_SPELLED = re.compile(r"[\[({]|\s")


def _emails(text: str) -> Iterable[Span]:
    for m in _EMAIL.finditer(text):
        at, domain, end = m.group("at"), m.group("domain"), m.end()
        labels = re.split(_DOT, domain)
        if " at " in at and not re.search(r"(?i)dot", domain):
            continue  # "at" in a sentence
        if not labels[-1].isalpha() or len(labels[-1]) < 2:
            continue  # versions, addresses of hosts
        if not _SPELLED.search(at) and re.search(r"\s", domain):
            # a plain address followed by a sentence with "dot" in it
            end = m.start("domain") + len(re.match(rf"{_LABEL}(?:\.{_LABEL})*", domain).group())
        yield m.start(), end, "email", 2.0


# ---------------------------------------------------------------- phone
_EXT = r"(?:\s*(?:,|;)?\s*(?:ext|extn|extension|x|durchwahl|poste|doorkies|anexo)\.?\s*\d{1,6})?"
_PHONE = re.compile(
    rf"""(?<![\w+./:@#-])(?:
      (?P<intl>(?:\+|00)[1-9]\d{{0,2}}[\s.\-/]?(?:\(0\))?[\s.\-/]?(?:\(\d{{1,4}}\)[\s.\-/]?)?\d(?:[\s.\-/]?\d){{5,14}})
    | (?P<nanp>(?:1[\s.\-])?(?:\(\d{{3}}\)\s?|\d{{3}}[\s.\-])\d{{3}}[\s.\-]\d{{4}})
    | (?P<trunk>0\d(?:[\d]|[\s.\-/](?=\d)){{6,14}})
    | (?P<loose>(?:\(\d{{2,5}}\)|\d)(?:[\s.\-/()]?\d){{6,13}})
    ){_EXT}(?![\w@]|[.\-:/]\d)""",
    re.X | re.I,
)
_PHONE_WORD = re.compile(r"(?i)(?:\b(?:tel|tél|telefon|telephone|phone|fon|mobile|mobil|móvil|movil|cell|handy|call|ring|dial|fax|on-call|oncall|hotline|reach (?:them|him|her|me|us) (?:on|at)|whatsapp|sms|pager|m|t|p)\b[.:]?|電話|电话|手机|هاتف|тел\.?|फ़ोन)\s*[:.]?\s*$")
_ID_WORD_BEFORE = re.compile(
    r"(?i)(?:\b(?:passport|reisepass|passnummer|pasaporte|passeport|ssn|soc(?:ial)?\.?\s*sec(?:urity)?\.?|nino|ni number|national insurance|national id|personal id|identity card|id card|id number|personalausweis|ausweis|"
    r"steuer-?id|steuernummer|tax id|tin|nif|nie|dni|cpf|pan|aadhaar|pesel|bsn|driving licen[cs]e|driver'?s? licen[cs]e|führerschein|permis de conduire|licen[cs]e|carte d'identité|nir|insee|sin|iban|credit card|card|kreditkarte)"
    r"(?:\s*(?:no|nr|number|num|nummer|n°|#)\b\.?)?)\s*[:.#]?\s*(?:is\s+)?$"
)
_NOT_PHONE = re.compile(r"(?i)\b(?:po|order|ticket|inc|chg|serial|asset|build|key|ref|invoice|version|licen[cs]e|mac|port|ports|row|sheet|id|bestellung|contract|sku|part|account|konto)\b[\s:#.-]*(?:no\.?|number|ref|key|tag)?[\s:#.-]*$")
_DATE_LIKE = re.compile(r"(?:19|20)\d\d[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./](?:19|20)\d\d|\d{1,3}(?:\.\d{1,3}){3}|(?:19|20)\d{6}")


def _phones(text: str) -> Iterable[Span]:
    for m in _PHONE.finditer(text):
        number, before = m.group(), text[max(0, m.start() - 32) : m.start()]
        main = re.split(r"(?i)[a-z]", number)[0]
        digits = sum(c.isdigit() for c in main)
        if not 7 <= digits <= 15 or _DATE_LIKE.fullmatch(main.strip()):
            continue
        score = {"intl": 1.2, "nanp": 1.0, "trunk": 0.7 if re.search(r"[\s.\-/]", number) else 0.4, "loose": 0.0}[m.lastgroup if m.lastgroup else "loose"]
        if m.lastgroup != "intl" and len(number) > len(main) and m.lastgroup != "loose":
            score += 0.3
        score += 1.0 * bool(_PHONE_WORD.search(before)) - 1.5 * bool(_ID_WORD_BEFORE.search(before)) - 1.2 * bool(_NOT_PHONE.search(before))
        if m.lastgroup == "trunk" and digits in (9, 10, 11, 12) and re.search(r"[\s./-]", number):
            score += 0.4
        yield m.start(), m.end(), "phone", score


# ---------------------------------------------------------------- identity numbers
_ID_LABEL = re.compile(
    r"(?i)(?<![\w-])(?P<label>passport|reisepass|pasaporte|passeport|ssn|soc\.?\s*sec\.?|social security|nino|ni number|national insurance|national id(?:entity)?|personal id|identity card|id card|personalausweis|"
    r"steuer-?id(?:nr)?|steueridentifikationsnummer|steuernummer|tax id|tin|nif|nie|dni|cpf|pan|aadhaar|pesel|bsn|driv(?:ing|er'?s?) licen[cs]e|führerschein|permis de conduire|carte d'identité|nir|iban|credit card|kreditkarte)"
    r"(?:\s*(?:no|nr|number|num|nummer|n°|#)\b\.?)?\s*[:.#]?\s*(?P<value>[A-Za-z0-9](?:[A-Za-z0-9]|[ .\-/](?=[A-Za-z0-9])){4,33})"
)
_ID_FORMS = [
    (re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), 1.0),  # nine digits 3-2-4
    (re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])"), 0.4),  # IBAN, confirmed by mod 97
    (re.compile(r"(?<![\w-])(?:\d[ -]?){12,18}\d(?![\w-])"), 0.2),  # payment card, confirmed by Luhn
]
#: labels of numbers that have a checksum everywhere
_CHECKED = {"iban", "credit card", "kreditkarte"}
#: one or more groups of letters and digits that make up a number
_GROUP = re.compile(r"[ ]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return len(digits) > 1 and total % 10 == 0


def mod97(iban: str) -> bool:
    compact = re.sub(r"\W", "", iban).upper()
    return len(compact) >= 15 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def dni_letter(value: str) -> bool:
    m = re.fullmatch(r"(\d{8})([A-Z])", re.sub(r"\W", "", value).upper())
    return bool(m) and "TRWAGMYFPDXBNJZSQVHLCKE"[int(m.group(1)) % 23] == m.group(2)


def _number_part(value: str) -> str:
    """The leading groups of ``value`` that belong to a number: groups with a digit, capitals at its ends."""
    parts, kept = _GROUP.split(value), []
    for i, p in enumerate(parts):
        short_capitals = p.isupper() and p.isalpha() and len(p) <= 2
        if any(c.isdigit() for c in p) or (short_capitals and (i == 0 or (i + 1 == len(parts) or not any(c.isdigit() for c in parts[i + 1])) and kept and len(p) == 1)):
            kept.append(p)
        else:
            break
    return " ".join(kept)


def _ids(text: str) -> Iterable[Span]:
    for m in _ID_LABEL.finditer(text):
        value = _number_part(m.group("value")).rstrip(" .-/")
        digits = sum(c.isdigit() for c in value)
        if len(value) < 5 or digits < 4:
            continue
        if m.group("label").lower() in ("pan", "tin", "nir", "nie", "sin") and not m.group("label").isupper():
            continue
        confirmed = mod97(value) if re.match(r"[A-Z]{2}\d{2}", value) and len(value) > 14 else dni_letter(value) or (value.isdigit() and luhn(value))
        # account and card numbers always have a checksum: one that fails is no such number, whatever its label says; the
        # letters and digits of other numbers are wrong in hand-written notes often enough to count for them only
        refuted = m.group("label").lower() in _CHECKED and not (mod97(value) if value[:1].isalpha() else luhn(re.sub(r"\D", "", value)))
        yield m.start("value"), m.start("value") + len(value), "id_number", 1.6 + 0.4 * confirmed - 1.0 * refuted
    for form, score in _ID_FORMS:
        for m in form.finditer(text):
            value, before = m.group(), text[max(0, m.start() - 32) : m.start()]
            digits = re.sub(r"\D", "", value)
            score_here = score - 1.2 * bool(_NOT_PHONE.search(before))
            if score < 1:
                score_here += 1.0 * (mod97(value) if value[0].isalpha() else luhn(digits) and digits[0] in "3456" and len(set(digits)) > 1 and 13 <= len(digits) <= 19)
                score_here -= 0.5 * bool(re.search(r"\D", value) and not re.fullmatch(r"(?:\d{4}[ -]){3,4}\d{1,4}|[A-Z].*", value))
            yield m.start(), m.end(), "id_number", score_here


# ---------------------------------------------------------------- street addresses
# Street words behind the name (English, German), before it (Romance languages), and towns' continuation.
_EN_TYPES = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Close|Way|Terrace|Drive|Dr|Court|Ct|Place|Pl|Square|Sq|Boulevard|Blvd|Crescent|Gardens|Grove|Hill|Row|Walk|Park|Mews|Quay|Highway|Hwy|Parkway|Circle|Alley|Yard)"
_DE_TYPES = r"(?:[Ss]tra(?:ß|ss)e|[Ss]tr\.|[Ww]eg|[Gg]asse|[Pp]latz|[Aa]llee|[Rr]ing|[Uu]fer|[Dd]amm|[Gg]raben|[Hh]of|[Ss]teig|[Cc]haussee)"
_ES_TYPES = r"(?:Calle|C/|Avda\.?|Avenida|Av\.|Plaza|Pza\.?|Paseo|Camino|Carrera|Ronda|Travesía|Via|Viale|Piazza|Corso|Rua)"
_FR_TYPES = r"(?:rue|bd\.?|boulevard|av\.?|avenue|chemin|place|allée|impasse|quai|route|cours|square|passage)"
_CAP = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:['’-][^\W\d_]+)*"
_TOWN = rf"{_CAP}(?:[ -]{_CAP}){{0,3}}"
_POST = r"(?:[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}|\d{5}(?:-\d{4})?)"
_FLAT = r"(?:(?:APT|Apt|apt|Apartment|FLAT|Flat|flat|UNIT|Unit|SUITE|Suite|STE|Ste|Room|Floor|Whg|Wohnung|piso|Piso|bât|appt)\.?\s*(?:no\.?\s*)?\d{1,4}[A-Za-z]?|#\s?\d{1,4}[A-Za-z]?)"
_SEP = r"(?:,\s*|\s+)"
_ADDRESSES = [
    # 12a Old Mill Road APT 3, Bramholt XX5 8BE
    re.compile(
        rf"(?<![\w.:#/-])(?:{_FLAT},?\s+)?\d{{1,5}}\s?[A-Za-z]?(?:-\d{{1,4}}[a-z]?)?\s+(?:St\.?\s+)?(?:{_CAP}\s+){{1,4}}?(?:{_EN_TYPES}|{_EN_TYPES.upper()})\b\.?"
        rf"(?:{_SEP}{_FLAT})?(?:,\s*{_TOWN}(?:{_SEP}{_POST})?(?![\w])|,?\s+{_POST}(?![\w]))?(?:{_SEP}{_FLAT})?"
    ),
    # Lerchenstraße 23b, 07044 Weißkirch
    re.compile(
        rf"(?<![\w-])(?:{_CAP}-)*{_CAP}?{_DE_TYPES}\s+\d{{1,4}}\s?[a-z]?(?![\w])(?:{_SEP}{_FLAT})?(?:{_SEP}(?:D-|A-|CH-)?\d{{4,5}}\s+{_TOWN})?"
    ),
    # Calle del Olivo 5, 47587 Villasur
    re.compile(
        rf"(?<![\w-]){_ES_TYPES}\s+(?:(?:de|del|la|las|los|el|di|da|do|dos)\s+)*{_CAP}(?:\s+(?:(?:de|del|la|las|los|y)\s+)*{_CAP}){{0,4}},?\s+(?:n[.º°]\s*)?\d{{1,4}}[a-z]?(?![\w])(?:,\s*\d{{1,2}}[º°ªo]\s?\w?)?(?:{_SEP}{_FLAT})?(?:{_SEP}\d{{4,5}}\s+{_TOWN})?"
    ),
    # 103 bis rue des Tilleuls, 88711 Saint-Orvin
    re.compile(
        rf"(?<![\w-])\d{{1,4}}(?:\s?(?:bis|ter|[a-c]))?,?\s+{_FR_TYPES}\s+(?:(?:de|du|des|la|le|les|l['’]|d['’])\s*)*{_CAP}(?:[ -](?:(?:de|du|des|la|le|les)\s+)*{_CAP}){{0,4}}(?:{_SEP}{_FLAT})?(?:{_SEP}\d{{4,5}}\s+{_TOWN})?"
    ),
]
#: what a match of each pattern holds, from the same word lists, so no address can miss it
_STREET_HINT = re.compile(rf"\b(?:{_EN_TYPES}|{_EN_TYPES.upper()})\b|{_DE_TYPES}\s+\d|(?<![\w-]){_ES_TYPES}\s|\s{_FR_TYPES}\s")


def _addresses(text: str) -> Iterable[Span]:
    for i, form in enumerate(_ADDRESSES):
        for m in form.finditer(text):
            value = m.group()
            tail = re.search(r",\s*(?P<town>[^\W\d_][^,\d]*)$", value)
            if i == 0 and tail:
                # the next remark is no town: capitals throughout, a title, a word known as none, or a sentence that goes on
                words = tail.group("town").split()
                goes_on = re.match(r"[ \t]+[^\W\d_A-ZÀ-Þ][\w'’]*|[ \t]+\d", text[m.end() :])
                if goes_on or words[0].isupper() or words[-1].isupper() or words[0].lower() in _TITLES or words[0].lower() in _KNOWN["words"] - {"port"}:
                    value = value[: tail.start()]
            yield m.start(), m.start() + len(value), "address", 1.5


# ---------------------------------------------------------------- names
# Titles, particles, and words beside which a person is named.
_TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "hr", "fr", "sr", "sra", "srta", "mme", "mlle", "sig", "ing", "sir", "don", "doña", "dott", "г-н", "г-жа", "السيد", "السيدة", "श्री", "श्रीमती", "डॉ"}
_PARTICLES = {"de", "la", "del", "della", "di", "da", "dos", "du", "des", "le", "van", "der", "den", "von", "zu", "zur", "bin", "ibn", "el", "al", "y", "e", "ter", "ten", "af", "av", "op"}
_CUES_BEFORE = [
    "signed off by", "handed over from", "handed over to", "handed over by", "escalate to", "escalated to", "built by", "owned by", "approved by", "reported by", "maintained by", "run by", "managed by", "written by", "confirmed by",
    "ansprechpartner", "ansprechpartnerin", "contact person", "contact", "ask", "per", "cc", "owner", "responsable", "responsible", "负责人", "联系人", "担当者", "voir avec", "approved", "kontakt", "contacto", "propietario", "verantwortlich",
    "ответственный", "المسؤول", "प्रभारी", "attn", "c/o", "engineer", "manager", "speak to", "talk to", "thanks to", "dear", "hello", "hi", "hallo", "bonjour", "estimado", "i.a.", "gez.", "regards", "gruß", "freigegeben von",
]
#: cues that are words of ordinary sentences too: beside these a name needs the lexicon, a title or a name's form
_WEAK_CUES = {"ask", "per", "contact", "owner", "approved", "engineer", "manager", "cc", "responsible", "hi", "responsable"}
_CUES_AFTER = re.compile(
    r"\s*(?:\(|,)?\s*(?:is the only one|confirmed in|confirmed that|confirmed it|has console access|said in|said that|owns the|owns this|signed off|approved (?:it|this|the)|will decide|handed over|joined|left the|is on call|is on leave|wrote|asked for|takes over|hat bestätigt|a confirmé|confirmó|asks that|is responsible|is the owner)"
)
_AFTER_HEADS = ("is the", "confirmed", "has console", "said ", "owns th", "signed off", "approved", "will decide", "handed over", "joined", "left the", "is on", "wrote", "asked for", "takes over", "hat best", "a confirm", "confirmó", "asks that", "is responsible")
#: the mark that opens a signature, on a line of its own (also in quoted mail)
_SIGNATURE = re.compile(r"(?:^|\n)(?:>[ \t]*)*--[ \t]*\r?\n(?:>[ \t]*)*(?=[^\W\d_])")
_LATIN = r"[^\W\d_]"
_WORD = re.compile(r"(?:[^\W\d_]|[’'](?=[^\W\d_])|-(?=[^\W\d_])|[ऀ-ॿ])+\.?")
_OTHER_SCRIPT = re.compile(r"[؀-ۿݐ-ݿ]+(?: [؀-ۿݐ-ݿ]+){0,3}|[Ѐ-ӿ]+(?:-[Ѐ-ӿ]+)?(?: [Ѐ-ӿ]+(?:-[Ѐ-ӿ]+)?){0,3}|[ऀ-ॿ]+(?: [ऀ-ॿ]+){0,3}|[一-鿿ぁ-ヿ]{1,4} [一-鿿ぁ-ヿ]{1,4}(?![一-鿿ぁ-ヿ])|[一-鿿]{2,3}(?![一-鿿ぁ-ヿ])|[가-힯]{2,4}")
_CUE = re.compile(r"(?i)(?<!\w)(?P<cue>" + "|".join(re.escape(c).replace(r"\ ", r"\s+") for c in sorted(_CUES_BEFORE, key=len, reverse=True)) + r")(?!\w)\s*[:(]?\s*(?:is\s+|ist\s+)?(?=[^\W\d_])")
_CUE_HEADS = tuple({c.split()[0] for c in _CUES_BEFORE})
_TITLE = re.compile(r"(?i)(?<![\w.@-])(?P<title>" + "|".join(sorted(map(re.escape, _TITLES - {"don", "fr", "sir"}), key=len, reverse=True)) + r"|Fr)\.?\s+(?=[^\W\d_])")
#: words that are capitalised beside a cue but name no person
_KNOWN: dict[str, set[str]] = {
    "words": {
        "team", "ops", "the", "this", "that", "who", "what", "when", "where", "it", "its", "operations", "support", "desk", "service", "helpdesk", "wintel",
        "fleet", "network", "data", "platform", "finance", "payments", "cab", "vendor", "admin", "it-service", "nobody", "someone", "everyone", "him", "her",
        "them", "us", "me", "dba", "may", "june", "july", "september", "october", "november", "december", "january", "february", "march", "april", "august",
        "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "nord", "süd", "row", "export", "runbook", "workshop", "sheet",
        "confirmed", "according", "stand", "prüfung", "server", "cluster", "gateway", "front", "end", "rack", "group", "wave", "phase", "port", "ports",
        "mail", "tel", "phone", "mobile", "fax", "email", "lead", "leads", "office", "site", "hall", "annex", "colo", "vale", "dc", "datacenter", "centre",
        "center", "legacy", "patch", "build", "serial", "ticket", "product", "licence", "license", "asset", "backup", "winter-freeze", "betrieb", "durch",
        "old", "new", "file", "files", "note", "notes", "line", "see", "name", "id", "column", "po", "mac", "cidr", "eol", "fsmo", "roles", "unknown", "none",
        "yes", "no", "pending", "prod", "test", "dev", "uat", "gib", "mib", "tib", "ansprechpartner", "contact", "kontakt", "owner",
    }
}


_REMARK_ENDS = re.compile(r"(?:\s+[A-Z]\.)?(?:\s*$|\s*[\n\r\"“”);:|/.,]|\s+(?:in|first|is|was|has|confirmed|\(|-|/))")


class Lexicon:
    """Name tokens by kind. ``ordinary`` tokens also occur as words, so one of them alone is no name."""

    def __init__(self, tokens: Iterable[tuple[str, str]]):
        self.kind: dict[str, set[str]] = {}
        for token, kind in tokens:
            if token:
                self.kind.setdefault(token.lower(), set()).add(kind)

    def has(self, word: str) -> bool:
        w = word.lower().rstrip(".")
        return w in self.kind or any(p in self.kind for p in re.split(r"[-’']", w) if len(p) > 3)


def _words(text: str, at: int, most: int = 7) -> list[tuple[int, int, str]]:
    """Words from ``at`` on, as long as only single blanks or a comma with a blank part them."""
    out = []
    while len(out) < most and (m := _WORD.match(text, at)):
        out.append((m.start(), m.end(), m.group()))
        gap = re.match(r", |[ 　]", text[m.end() :])
        if not gap:
            break
        at = m.end() + gap.end()
    return out


def _is_initial(w: str) -> bool:
    return bool(re.fullmatch(rf"{_LATIN}\.|[A-Z]", w)) and w[0].isupper()


def _namelike(w: str, lexicon: Lexicon, loose: bool) -> bool:
    bare = w.rstrip(".")
    if w.endswith(".") and not _is_initial(w):
        w = bare
    if bare.lower() in _KNOWN["words"] or bare.lower() in _TITLES or len(bare) < 2:
        return False
    if lexicon.has(bare):
        return True
    if (bare.isupper() and len(bare) < 4) or any(p.isupper() and len(p) in (2, 3) for p in bare.split("-")[:1] if "-" in bare):
        return False
    return loose and (bare[0].isupper() or re.match(r"(?:al|el|ben|bin|o)[-’']", bare)) is not None


def _name_at(text: str, at: int, lexicon: Lexicon, loose: bool) -> tuple[int, int, float] | None:
    """The person's name that starts at ``at``: title (left out), given names, initials, particles, surname; or SURNAME, Given."""
    titled = 0.0
    while m := _TITLE.match(text, at):
        at, titled = m.end(), 1.0
    if m := _OTHER_SCRIPT.match(text, at):
        return at, m.end(), 1.2
    words = _words(text, at)
    parts: list[tuple[int, int, str, str]] = []
    # given name and surname in small letters: one must be known, and the remark ends or goes on as after names
    small = len(words) > 1 and all(w.islower() and w.replace("-", "").isalpha() and len(w) > 2 and w not in _KNOWN["words"] for _, _, w in words[:2]) and ("surname" in lexicon.kind.get(words[1][2], ()) or "given" in lexicon.kind.get(words[0][2], ()))
    if small and loose and text[words[0][1]] == " " and _REMARK_ENDS.match(text, words[1][1]):
        return words[0][0], words[1][1], 0.9 + titled
    for i, (start, end, w) in enumerate(words):
        after_comma = bool(parts) and text[parts[-1][1]] == ","
        last = w.endswith(".") and not _is_initial(w)
        core_end = end - 1 if last else end
        if after_comma:
            # SURNAME, Given: one surname, then given names or initials known as such
            cores = [p for p in parts if p[3] == "name"]
            given = lexicon.kind.get(w.rstrip(".").lower(), set())
            reversed_ = "given" in given or _is_initial(w)
            if loose and not titled and not reversed_ and lexicon.kind.get(cores[-1][2].lower() if cores else "", {"surname"}) != {"given"}:
                # an unknown given name: a single capitalised word up to the end of the remark
                rest = _REMARK_ENDS.match(text, core_end)
                reversed_ = bool(rest) and w[0].isupper() and not w.isupper() and _namelike(w, lexicon, True)
            if len(cores) != 1 or any(p[3] == "initial" for p in parts) or not reversed_:
                break
            parts.append((start, core_end, w, "given"))
            if last:
                break
            continue
        if parts and parts[-1][3] == "given":
            if _is_initial(w):
                parts.append((start, end, w, "initial"))
                continue
            break
        low = w.lower()
        if _is_initial(w) and (i + 1 < len(words) or parts):
            parts.append((start, end, w, "initial"))
        elif low in _PARTICLES and (w == low or w.istitle()) and i + 1 < len(words) and not last:
            nxt = next((x for _, _, x in words[i + 1 :] if x.lower() not in _PARTICLES), "")
            if not (nxt and _namelike(nxt, lexicon, loose or bool(titled) or bool(parts))):
                break
            parts.append((start, end, w, "particle"))
        elif _namelike(w, lexicon, loose or bool(titled) or bool(parts)) and sum(p[3] == "name" for p in parts) < 4:
            parts.append((start, core_end, w, "name"))
            if last:
                break
        else:
            break
    while parts and (parts[-1][3] == "particle" or (parts[-1][3] == "initial" and not any(p[3] == "name" for p in parts))):
        parts.pop()
    names = [p for p in parts if p[3] in ("name", "given")]
    if not names:
        return None
    if len(names) == 1 and names[0][2].islower():
        return None
    known = sum(lexicon.has(p[2]) for p in names)
    two = len(names) > 1 or any(p[3] == "initial" for p in parts)
    return parts[0][0], parts[-1][1], 0.2 + titled + min(known, 2) * 0.5 + 0.3 * two


class Disjoint:
    """Spans that do not overlap, kept in order."""

    def __init__(self, spans: Iterable[Span] = ()):
        self.spans: list[Span] = []
        for s in spans:
            self.add(s)

    def hit(self, start: int, end: int) -> bool:
        i = bisect_left(self.spans, (start,))
        return (i < len(self.spans) and self.spans[i][0] < end) or (i > 0 and self.spans[i - 1][1] > start)

    def add(self, s: Span) -> None:
        if not self.hit(s[0], s[1]):
            insort(self.spans, s)


def _names(text: str, lexicon: Lexicon, taken: list[Span]) -> Iterable[Span]:
    inside = Disjoint(taken).hit
    low = text.lower()
    for m in _CUE.finditer(text) if any(c in low for c in _CUE_HEADS) else ():
        cue = re.sub(r"\s+", " ", m.group("cue").lower())
        if found := _name_at(text, m.end(), lexicon, True):
            start, end, score = found
            score += 0.3 if cue in _WEAK_CUES else 0.9
            if text[end : end + 1] in "@＠" and text[end : end + 1] or inside(start, end):
                continue
            yield start, end, "name", score
    for m in _TITLE.finditer(text):
        if (found := _name_at(text, m.start(), lexicon, True)) and not inside(*found[:2]):
            yield found[0], found[1], "name", found[2] + (0.2 if found[2] > 1 else 0)
    for m in _CUES_AFTER.finditer(text) if any(c in low for c in _AFTER_HEADS) else ():
        # a name in front of the cue: try the starts before it, the longest that ends there wins
        head = text[max(0, m.start() - 60) : m.start()]
        base = m.start() - len(head)
        for w in re.finditer(r"(?<![\w'’-])[^\W\d_]", head):
            found = _name_at(text, base + w.start(), lexicon, True)
            if found and found[1] == m.start() and not inside(*found[:2]):
                yield found[0], found[1], "name", found[2] + 0.8
                break
        else:
            # two unknown words in small letters that open the remark
            small = re.search(r"(?:^|[\n>(;/.\"-])\s*([^\W\d_]{3,} [^\W\d_]{3,}(?:-[^\W\d_]{2,})?)$", head)
            if small and not any(w in _KNOWN["words"] or w in _PARTICLES for w in small.group(1).split()):
                yield base + small.start(1), m.start(), "name", 1.1
    for m in _SIGNATURE.finditer(text):
        found = _name_at(text, m.end(), lexicon, True)
        if found and re.match(r"[ \t]*(?:\||\n|\r|$|,)", text[found[1] :]) and not inside(*found[:2]):
            yield found[0], found[1], "name", found[2] + 0.9
        elif (small := re.compile(r"[^\W\d_]{3,}(?: [^\W\d_]{3,}(?:-[^\W\d_]{2,})?){1,2}(?=[ \t]*\|)").match(text, m.end())) and not inside(*small.span()):
            yield *small.span(), "name", 1.1
    # two tokens of the lexicon side by side need no cue
    for m in _WORD.finditer(text):
        if "given" in lexicon.kind.get(m.group().lower(), ()) or "surname" in lexicon.kind.get(m.group().lower(), ()):
            found = _name_at(text, m.start(), lexicon, False)
            if found and found[2] >= 1.5 and not inside(*found[:2]) and m.group()[0].isupper():
                yield found[0], found[1], "name", found[2] - 0.4


# ---------------------------------------------------------------- all kinds
_DIGITS = re.compile(r"\d.*\d.*\d.*\d", re.S)
_AT_SIGN = re.compile(r"@|\bAT\b|[\[({]\s*at\s*[\])}]|\bdot\b", re.I)


def find(text: str, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal data in ``text``; overlaps go to the higher score, then the longer span."""
    t = text.translate(_NARROW)
    spans: list[Span] = []
    if _AT_SIGN.search(t):
        spans += _emails(t)
    if _DIGITS.search(t):
        spans += _phones(t)
        spans += _ids(t)
    if any(c.isdigit() for c in t) and _STREET_HINT.search(t):
        spans += _addresses(t)
    fixed = [s for s in spans if s[3] >= THRESHOLD]
    fixed += _names(t, lexicon, [s for s in fixed if s[2] in ("email", "address")])
    kept = Disjoint(sorted((s for s in fixed if s[3] >= THRESHOLD), key=lambda s: (-s[3], s[0] - s[1])))
    return [(a, b, k) for a, b, k, _ in kept.spans]


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    for start, end, kind in reversed(spans):
        text = f"{text[:start]}[{kind.upper()}]{text[end:]}"
    return text


def lexicon_rows(lexicon: DataFrame, limit: int = 1_000_000) -> list[tuple[str, str]]:
    """The lexicon for every task; a fixed list of names, refused beyond ``limit`` rows."""
    rows = lexicon.select("token", "kind").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the name lexicon has more than {limit} rows")
    return [(r.token, r.kind) for r in rows]


def notes_of(raw: str, header: str | None) -> str:
    """The ``notes`` of a messy-inventory line as they stand in it: from where the record grammar sees the field begin, or, in a
    line that breaks before it, from the broken field on; without the line ending, and without the quotes around the field."""
    separator, names = parse_recovery.read_header(header)
    text = parse_recovery.strip_line_ending(raw)
    at = names.index("notes") if "notes" in names else max(len(names) - 1, 0)
    starts: list[int] = []
    try:
        fields, _ = parse_recovery.RecordGrammar(separator).record(text, 0, True, starts)
    except parse_recovery.SyntaxFault:
        return text[starts[min(at, len(starts) - 1)] :]
    if len(fields) <= at:
        return text
    end = starts[at + 1] - 1 if at + 1 < len(starts) and len(fields) == len(names) else len(text)
    note = text[starts[at] : end]
    return note[1:-1] if len(note) > 1 and note[0] == note[-1] == '"' else note


def texts_of(claims: DataFrame, lines: DataFrame) -> DataFrame:
    """(source_table, row_key, text, header, is_line): quotes of claims, and messy-inventory lines with the header of their file."""
    messy = lines.where("file_kind = 'messy-inventory'")
    headers = messy.where("line_no = 1").groupBy("file_id").agg(F.min_by("raw_line", "line_id").alias("header"))
    body = salted_join(messy.where("line_no > 1").select("file_id", "line_id", "raw_line"), headers, ["file_id"], ["line_id"], "left")
    quotes = claims.select(F.lit("claims").alias("source_table"), F.col("claim_id").alias("row_key"), F.col("evidence_quote").alias("text"), F.lit(None).cast("string").alias("header"), F.lit(False).alias("is_line"))
    return quotes.unionByName(body.select(F.lit("inventory_lines").alias("source_table"), F.col("line_id").cast("string").alias("row_key"), F.col("raw_line").alias("text"), "header", F.lit(True).alias("is_line")))


def scanned(texts: DataFrame, lexicon: DataFrame, text: str | Column = "text") -> DataFrame:
    """(source_table, row_key, found: array of (start, end, kind, pii_text), redacted) for every row of ``texts``.

    Rows with ``is_line`` are inventory lines, of which only the notes are read (``notes_of``).

    Edge cases: null texts give no spans and null; empty and blank texts none; repeated rows are scanned as they come; an
    empty lexicon leaves names to titles and cue words; an empty table gives an empty table; further columns are ignored.
    """
    names = lexicon.sparkSession.sparkContext.broadcast(lexicon_rows(lexicon))
    lines = "is_line" in texts.columns
    item = pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("kind", pa.string()), ("pii_text", pa.string())])
    schema = pa.schema([("source_table", pa.string()), ("row_key", pa.string()), ("found", pa.list_(item)), ("redacted", pa.string())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(names.value)
        for b in it:
            found, redacted = [], []
            said = b.column("text").to_pylist()
            if lines:
                said = [notes_of(t, h) if is_line and t is not None else t for t, h, is_line in zip(said, b.column("header").to_pylist(), b.column("is_line").to_pylist(), strict=True)]
            for t in said:
                spans = find(t, lex) if t else []
                found.append([(s, e, k, t[s:e]) for s, e, k in spans])
                redacted.append(redact(t, spans) if spans else t)
            as_rows = [[dict(zip(("start_pos", "end_pos", "kind", "pii_text"), x, strict=True)) for x in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column("source_table").cast(pa.string()), b.column("row_key").cast(pa.string()), pa.array(as_rows, pa.list_(item)), pa.array(redacted, pa.string())], schema=schema)

    rows = texts.select("source_table", "row_key", F.col(text).alias("text") if isinstance(text, str) else text.alias("text"), *(["header", "is_line"] if lines else []))
    return spread(rows, "row_key").mapInArrow(batches, "source_table string, row_key string, found array<struct<start_pos:int,end_pos:int,kind:string,pii_text:string>>, redacted string")
