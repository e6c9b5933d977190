"""Candidate segments of personal information in a text, each with the features of its whole span."""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass, field

KINDS = ("email", "phone", "name", "address", "id_number")

_I = re.IGNORECASE
_LETTER = r"[^\W\d_]"
_MAIL = re.compile(r"[A-Za-z0-9][\w.+%'-]*@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w@])")
_HIDDEN = re.compile(r"[A-Za-z0-9][\w.+%-]*(\s?[\[({<]\s?at\s?[\])}>]\s?|\s+at\s+|\s?@\s?)[A-Za-z0-9-]+(?:(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\s+dot\s+|\.)[A-Za-z0-9-]+)+", _I)
_AT_HOST = re.compile(r"\sat\s+[a-z0-9-]+\.[a-z0-9]")
_PHONES = (
    ("plus", re.compile(r"(?<![\w+])\+\d(?:[ .()/-]{0,3}\d){7,14}(?!\w)")),
    ("us", re.compile(r"(?<![\w.+-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])")),
    ("zero", re.compile(r"(?<![\w.+-])0\d{1,4}(?:[ /-]{1,3}\d{2,8}){1,6}(?!\w)")),
)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?(?![A-Za-z0-9])")
_CARD = re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])")
_CARD_SHAPE = re.compile(r"\d{13,19}|(\d{4}[ -]){3}\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5}")
_IDS = (
    ("3-2-4", re.compile(r"(?<![\w-])\d{3}[-. ]\d{2}[-. ]\d{4}(?![\w-])")),
    ("letter7", re.compile(r"(?<![\w-])[A-Z]\d{6,8}[A-Z]?(?![\w-])", _I)),
    ("dots", re.compile(r"(?<![\w.-])\d{1,2}\.\d{3}\.\d{3}-[\dkK](?![\w-])")),
    ("4-2-3", re.compile(r"(?<![\w-])\d{4}-[A-Z]{2}-\d{3}(?![\w-])", _I)),
    ("pairs", re.compile(r"(?<![\w-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z](?![\w-])", _I)),
    ("plain", re.compile(r"(?<![\w.:@/-])(?:\d{8}[A-Z]|\d{9,11})(?![\w.:/-])", _I)),
)
# Words for kinds of streets, before or after a street's name, in four languages.
_TYPES_EN = r"(?:Avenue|Ave|Street|St|Road|Rd|Lane|Ln|Court|Ct|Boulevard|Blvd|Drive|Dr|Square|Sq|Way|Place|Pl|Terrace|Close|Crescent|Highway|Parkway)"
_ENDS_DE = r"(?:weg|stra(?:ss|ß)e|str\.|gasse|platz|allee|damm|ring|ufer|steig|graben|markt)"
_TYPES_ES = r"(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Carrera|Ronda|Via|Piazza)"
_TYPES_FR = r"(?:rue|avenue|boulevard|place|chemin|quai|impasse|allée|route|cours|square|passage)"
_W = rf"{_LETTER}(?:{_LETTER}|['’-])*"
_STREETS = (
    ("number-name-type", tuple(f" {t}" for t in _TYPES_EN[3:-1].lower().split("|")), re.compile(rf"(?<![\w.,:/@#-])\d{{1,5}}[a-z]?,? +({_W}(?: +{_W}){{0,2}}) +{_TYPES_EN}\b", _I)),
    ("name-ending", ("weg", "strasse", "straße", "str.", "gasse", "platz", "allee", "damm", "ring", "ufer", "steig", "graben", "markt"), re.compile(rf"(?<!\w)(?:(?:Alte|Neue|Lange|Kurze|Kleine|Große|Grosse|Obere|Untere|Hohe)[rn]? )?({_LETTER}{{2,}}-?{_ENDS_DE}),? \d{{1,4}} ?[a-z]?\b", _I)),
    ("preposition", ("am ", "an d", "im ", "in der ", "zum ", "zur ", "auf de", "unter den ", "hinter dem "), re.compile(rf"(?<!\w)(?:Am|An der|An den|Im|In der|Zum|Zur|Auf der|Auf dem|Unter den|Hinter dem) ({_LETTER}{{3,}}) \d{{1,4}}[a-z]?\b", _I)),
    ("type-name-number", ("calle ", "c/", "avenida ", "avda", "plaza ", "paseo ", "camino ", "carrera ", "ronda ", "via ", "piazza "), re.compile(rf"(?<!\w){_TYPES_ES}(?: (?:de|del|la|las|los|el))* ({_W}(?: {_W})?),? +(?:n[.ºo°]{{1,2}} ?)?\d{{1,4}}\b", _I)),
    ("number-type-name", tuple(f" {t} " for t in _TYPES_FR[3:-1].split("|")), re.compile(rf"(?<![\w.,:/@#-])\d{{1,4}}(?: ?(?:bis|ter|quater))?,? {_TYPES_FR}(?: (?:de la|de|du|des|la|le|les))*(?: d['’]| l['’]| )({_W})", _I)),
)
_WORD = re.compile(rf"{_LETTER}+(?:['’-]{_LETTER}+)*")
_CAPS = re.compile(r"(?<![\w@.'’-])[A-ZÀ-ÖØ-ÞŠŽ][^\W\d_]*(?:['’-][^\W\d_]+)*,? (?:[A-ZÀ-ÖØ-ÞŠŽ]\. )?(?:(?:van|von|de|der|den|di|da|del|la|le)[ -]){0,2}[A-ZÀ-ÖØ-ÞŠŽ][^\W\d_]*(?:['’-][^\W\d_]+)*(?![\w@])")
_POSSESSIVE = ("'s", "’s", "'S")
_PAIR = re.compile(rf"({_W})(,? )(?:({_LETTER})\. )?((?:(?:van|von|de|der|den|di|da|del|la|le) ){{0,2}}{_W})\Z", _I)

# Words for documents and accounts of persons, for things that bear numbers, and words beside names, in four languages.
PERSON_WORD = frozenset(
    "passport licence license identity ssn id citizen visa tax taxpayer insurance security iban account card paid payroll issued holder resident pasaporte dni nie nif carné seguridad cuenta tarjeta passeport permis carte sécurité compte titulaire inhaber".split()
)
PERSON_STEM = ("ausweis", "reisepass", "führerschein", "steuer", "sozialvers", "konto")
THING_WORD = frozenset(
    "asset part build sku serial model device order ticket invoice version release firmware host node commit hash checksum sample test dummy batch article item room shelf stock warehouse parcel tracking window ratio amount job run log teil artikel bestellung gerät pieza pedido lote pièce commande colis".split()
)
BEFORE_NAME = frozenset(
    "attn attention ask asked by from to for cc with and is thanks thank dear hi contact holder reach name called mr mrs ms dr prof herr frau nach von an sr sra señor señora de para mme m monsieur madame à par regards sincerely colleague manager owner".split()
)
AFTER_NAME = frozenset("wrote writes signed asked asks said says called calls lives moved will has is was joined left about for at on from fragen schreibt dijo escribió demande écrit phone tel mobile home mail email".split())
_LAST_WORD, _FIRST_WORD = re.compile(r"(\w+)(\W{0,3})\Z"), re.compile(r"(?:['’]s\b)?(\W{0,3})(\w+)?")
# Words that begin or end capitalised pairs which are no persons.
NOT_NAMES = frozenset(
    "the a an on re subject fwd dear hi hello team platform people status decision next please after without risk half nobody original message monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december avenue ave street st road rd lane ln court ct boulevard blvd drive square way place room floor office port north south east west old new seven die das der am im alte neue calle plaza avenida rue ordner stand thema niemand wir ohne für bitte entscheidung las los el la sin estado decisión hemos nadie comprobad sigue le les il on no notes checklist svc api vat iban id".split()
)
_COUNTRY_LENGTH = {"DE": 22, "GB": 22, "NL": 18, "AT": 20, "FR": 27, "ES": 24, "IT": 27, "CH": 21, "BE": 16, "IE": 22, "PT": 25, "PL": 28, "DK": 18, "NO": 15, "SE": 24, "FI": 18, "LU": 20, "CZ": 24, "GR": 27}  # fixed values


@functools.lru_cache(maxsize=1 << 17)
def fold(word: str) -> str:
    """A word without case, accents and apostrophes."""
    if word.isascii():
        return word.lower().replace("'", "")
    w = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))
    return w.replace("'", "").replace("’", "").replace("ø", "o").replace("ł", "l").replace("ß", "ss")


def folded_words(text: str | None) -> set[str]:
    """Whatever ``candidates`` may look up in a lexicon for a text: its folded words, and two or three neighbours joined by hyphens."""
    words = [fold(w[:-2] if w[-2:] in _POSSESSIVE else w) for w in _WORD.findall(text or "")]
    joined = ("-".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1))
    return {*words, *joined}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_end(text: str) -> tuple[int, bool]:
    """(length of the IBAN at the start of ``text``, whether its check digits are right)."""
    want = _COUNTRY_LENGTH.get(text[:2].upper())
    plain, cut = "", []
    for i, c in enumerate(text):
        if c != " ":
            plain += c
            cut.append(i + 1)
    for n in [want] if want else range(len(plain), 14, -1):
        if len(plain) >= n and int("".join(str(int(c, 36)) for c in plain[4:n] + plain[:4])) % 97 == 1:
            return cut[n - 1], True
    return cut[want - 1] if want and len(plain) >= want else len(text), False


@dataclass
class Lexicon:
    """Given and family names, folded."""

    given: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()
    both: frozenset[str] = field(init=False)
    _seen: set[str] = field(init=False, default_factory=set, repr=False)
    _names: set[str] = field(init=False, default_factory=set, repr=False)

    _pairs: dict[str, list[str] | None] = field(init=False, default_factory=dict, repr=False)

    def __post_init__(self):
        self.both = self.given | self.family

    def names_among(self, words: list[str]) -> set[str]:
        """Those of the words of a text, perhaps with a possessive ending, that are names; words seen before are looked up only."""
        distinct = set(words)
        if new := distinct - self._seen:
            if len(self._seen) > 500_000:
                self._seen.clear()
                self._names.clear()
                new = distinct
            self._seen |= new
            self._names |= {w for w in new if fold(w[:-2] if w[-2:] in _POSSESSIVE else w) in self.both}
        return distinct & self._names


@dataclass(frozen=True, slots=True)
class Candidate:
    start: int
    end: int
    kind: str
    features: tuple[str, ...]


def _mails(text: str) -> list[Candidate]:
    out = []
    if "@" in text:
        out = [Candidate(m.start(), m.end(), "email", ("mail:plain",)) for m in _MAIL.finditer(text)]
    low = text.lower()
    if "at" in low and ("dot" in low or any(x in low for x in ("[at", "(at", "{at", "<at", "[ at", "( at")) or " at " in low and _AT_HOST.search(low)) or " @" in text or "@ " in text:
        at, plain = 0, [*out]
        while m := _HIDDEN.search(text, at):
            at = m.end(1)  # what follows the sign may itself be the name of an address
            if any(c.start < m.end() and m.start() < c.end for c in plain):
                continue
            word = re.split(r"[\s\])}>.]", m[0])[-1].lower()
            how = "bracket" if re.search(r"[\[({<]", m[1]) else "word" if m[1].strip().lower() == "at" else "sign"
            top = "mail:top" if re.fullmatch(r"com|org|net|edu|gov|io|example|test|invalid|local|de|fr|es|uk|eu|us|ch|at|info|biz", word) else "mail:notop"
            out.append(Candidate(m.start(), m.end(), "email", (f"mail:{how}", top, "mail:dotword" if re.search(r"dot", m[0], _I) else "mail:dot")))
    return out


@functools.lru_cache(maxsize=1 << 16)
def _cue(word: str) -> str:
    """What a word in lower case says of a number beside it."""
    return "person" if word in PERSON_WORD or any(s in word for s in PERSON_STEM) else "thing" if word in THING_WORD else ""


_RUN = re.compile(r"\w+")
_CLAUSE = re.compile(r"[.!?]\s|\n")
_ENOUGH_DIGITS = re.compile(r"(?:\d\W{0,3}){6}|\d{4}-[A-Za-z]{2}-\d{3}")  # every number's shape has one of these


def _numbers(text: str) -> list[Candidate]:
    out, ibans = [], []
    if not _ENOUGH_DIGITS.search(text):
        return out

    def context(s: int, e: int, prefix: str) -> tuple[str, ...]:
        left, right = _CLAUSE.split(text[max(0, s - 30) : s])[-1], _CLAUSE.split(text[e : e + 30], maxsplit=1)[0]
        out = []
        for side, where in ((left, "before"), (right, "after")):
            cues = {c for w in _RUN.findall(side.lower()) if (c := _cue(w))}
            out += [f"{prefix}{c}-{where}" for c in ("person", "thing") if c in cues]
        return tuple(out)

    for m in _IBAN.finditer(text):
        n, ok = iban_end(m[0])
        if not ok and not re.search(r"\d{4}", m[0][4:]):
            continue
        ibans.append((m.start(), m.end()))
        out.append(Candidate(m.start(), m.start() + n, "id_number", ("id:iban", "id:check-right" if ok else "id:check-wrong", *context(m.start(), m.start() + n, "id:"))))
    cards = [m for m in _CARD.finditer(text) if _CARD_SHAPE.fullmatch(m[0])]
    whole = ibans + [m.span() for m in cards]  # a part of such a number, right or wrong, is no number of its own
    free = lambda m, spans=whole: not any(s < m.end() and m.start() < e for s, e in spans)
    for m in cards:
        if free(m, ibans):
            digits = re.sub(r"\D", "", m[0])
            out.append(Candidate(m.start(), m.end(), "id_number", ("id:card", "id:check-right" if luhn(digits) else "id:check-wrong", *context(m.start(), m.end(), "id:"))))
    for name, p in _IDS:
        for m in p.finditer(text):
            if free(m):
                out.append(Candidate(m.start(), m.end(), "id_number", ("id:shape", f"id:{name}", *context(m.start(), m.end(), "id:"))))
    for name, p in _PHONES:
        for m in p.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            if free(m) and 8 <= n <= 16:
                out.append(Candidate(m.start(), m.end(), "phone", ("phone:any", f"phone:{name}", *context(m.start(), m.end(), "phone:"))))
    return out


def _addresses(text: str) -> list[Candidate]:
    out = []
    plain = text.islower() or text.isupper()
    low = text.lower()
    for name, hint, p in _STREETS:
        for h in hint:
            if h in low:
                break
        else:
            continue
        for m in p.finditer(text):
            words = m[1].split()
            cased = plain or all(w[0].isupper() for w in words if w.lower() not in ("de", "la", "du", "des", "del", "of", "the"))
            stop = any(w.lower() in ("the", "a", "of", "on", "in", "at", "for", "and", "days", "points", "open", "checks", "from", "to", "with", "is") for w in words)
            out.append(Candidate(m.start(), m.end(), "address", ("street:any", f"street:{name}", "street:cased" if cased else "street:uncased", *(("street:stop",) if stop else ()))))
    return out


def _pair(pair: str, lex: Lexicon) -> list[str] | None:
    """Features of two words (and an initial) without their surroundings; None: they aren't two words."""
    m = _PAIR.match(pair)
    if not m:
        return None
    a, b = fold(m[1]), fold(m[4].replace(" ", "-"))
    fs = ["name:any", "name:comma" if "," in m[2] else "name:plain"]
    first, last = (b, a) if "," in m[2] else (a, b)
    known = (first in lex.given, last in lex.family)
    fs.append(f"name:given-{'known' if known[0] else 'new'}-family-{'known' if known[1] else 'new'}")
    if known != (True, True) and a in lex.family and b in lex.given:
        fs.append("name:turned")
    elif known == (False, False) and (a in lex.both) != (b in lex.both):
        fs.append("name:odd-role")
    if a in lex.given and b in lex.given and not (a in lex.family or b in lex.family):
        fs.append("name:two-given")
    if a in NOT_NAMES or b in NOT_NAMES or len(a) < 2 or len(b) < 2:
        fs.append("name:common-word")
    if m[3]:
        fs.append("name:initial")
    if not (m[1][0].isupper() and m[4].split()[-1][0].isupper()):
        fs.append("name:uncased")
    return fs


def _name(text: str, s: int, e: int, lex: Lexicon) -> Candidate | None:
    pair = text[s:e]
    if pair in lex._pairs:
        fs = lex._pairs[pair]
    else:
        if len(lex._pairs) > 100_000:
            lex._pairs.clear()
        fs = lex._pairs[pair] = _pair(pair, lex)
    if fs is None:
        return None
    fs = fs.copy()
    left, right = text[max(0, s - 24) : s], text[e : e + 24]
    if (m := _LAST_WORD.search(left)) and "\n" not in m[2]:
        fs.append(f"name:{'before' if m[1].lower() in BEFORE_NAME else 'time' if m[1].isdigit() else 'word'}-left")
        if ":" in m[2]:
            fs.append("name:colon-left")
    else:
        fs.append("name:start")
    m = _FIRST_WORD.match(right)
    if "\n" in m[1] or not m[2]:
        fs.append("name:end")
    else:
        fs.append(f"name:{'after' if m[2].lower() in AFTER_NAME else 'digit' if m[2][0].isdigit() else 'word'}-right")
        if any(c in m[1] for c in "<|(;"):
            fs.append("name:sign-right")
    if fs[-1] == "name:end" and "name:start" in fs:
        fs.append("name:alone")
    return Candidate(s, e, "name", tuple(fs))


def _names(text: str, lex: Lexicon) -> list[Candidate]:
    spans = set()
    raws = _WORD.findall(text)
    known = lex.names_among(raws)
    hits = [i for i, r in enumerate(raws) if r in known] if known else []
    if len(hits) > 1 and any(j - i <= 2 for i, j in zip(hits, hits[1:], strict=False)):
        words = [m.span() for m in _WORD.finditer(text)]
        for i in hits[:-1]:
            (s, e), j = words[i], i + 1
            if j + 1 < len(words) and len(raws[j]) == 1 and text[words[j][1] : words[j][1] + 2] == ". " and text[e : words[j][0]] in (" ", ", "):
                j += 1
            elif text[e : words[j][0]] not in (" ", ", "):
                continue
            if raws[j] in known:
                spans.add((s, words[j][1] - (2 if raws[j][-2:] in _POSSESSIVE else 0)))
    for m in _CAPS.finditer(text):
        e = m.end() - (2 if m[0][-2:] in _POSSESSIVE else 0)
        spans.add((m.start(), e))
        inner = m[0].find(" ") + 1  # the pair that begins at the second word may be the name
        n = _CAPS.match(text, m.start() + inner)
        if n:
            spans.add((n.start(), n.end() - (2 if n[0][-2:] in _POSSESSIVE else 0)))
    return [c for s, e in sorted(spans) if (c := _name(text, s, e, lex))]


_HAS_DIGIT = re.compile(r"\d")


def candidates(text: str, lex: Lexicon) -> list[Candidate]:
    """All candidates of a text, by end."""
    out = _mails(text) + _names(text, lex)
    if _HAS_DIGIT.search(text):
        out += _numbers(text) + _addresses(text)
    return sorted(out, key=lambda c: (c.end, c.start, c.kind))
