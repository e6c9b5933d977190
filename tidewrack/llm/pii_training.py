"""Annotated sentences for the personal-information model, made from patterns with a fixed seed.

The wording is of no corpus: it shares no run of words with the texts that the model is used on. A pattern holds slots: ``{E}`` mail address, ``{P}`` phone, ``{N}`` name, ``{A}`` address, ``{I}`` number of a person;
slots in lower case are filled alike but are no personal information there (a part number, a test card, a street
without house number, a pair of capitalised words).
"""

from __future__ import annotations

import random
import re

from tidewrack.llm.pii_candidates import Candidate, Lexicon, candidates, fold, luhn

# Invented parts of the training sentences.
GIVEN = "Alba Bruno Clara Dario Emma Felix Gina Hugo Irma Jonas Karla Ludo Mona Nils Olga Paul Rita Sven Tilda Viktor".split()
FAMILY = "Aldermoss Birkwood Caldering Dovetree Emberly Fontrose Grimwald Heatherby Inglemark Jarnfeld Kirkhollow Lindqvale Marlowick Nordhaven Oakhurst-Lee O'Hallow Pemberlane Rookwell Stormvik Thornbury".split()
STREETS = "Maple Harvest Foxglove Meadowlark Granite Willowbrook".split()
PATTERNS = (
    "Kindly forward the slides to {E} by tonight.", "Cc: {E}, {E}", "write me under mailto:{E} any time", "old thread by <{E}> below", "{N} <{E}>", "Sender: {E}\nhi all", "{N} / {E} / {P}", "the voucher goes out to {E}", "{E} or {P}", "{E}", "Schreib doch {E} an", "mi correo: {E}",
    "{E} bounced again", "my new mailbox {E} works", "both {E} and {E} were copied", "either {P} or {E}", "invite {E}; she replies fast", "Sent by {N} with {E} in copy",
    "ring {P} after lunch", "you get him on {P} all day", "desk of {N} ({P})", "mobile:{P} office:{P}", "the new client is {N}, {P}", "{P}", "somebody tried {P} in vain", "Rückruf bitte auf {P}", "mi móvil es {P}", "mon portable : {P}", "fax {P}", "voicemail from {P} at noon",
    "Attention: {N}", "Could you ask {N} whether it fits?", "big thanks to {N} and {N}", "we hired {N} in spring", "{N} signed it", "the card's holder, {N}", "I borrowed {N}'s charger", "gestern hat {N} angerufen", "habla con {N} mañana", "demande à {N} ce soir",
    "Write to {N}: {E}", "Find {N} at {E} or so", "{N}", "Bye\n{N}", "Bye,\n{N}\n{P}", "Cheers\n{N}\n{A}", "On 3 June 2026 at 08:15, {N} <{E}> wrote:", "Le 3 juin 2026, {N} <{E}> a écrit :", "{N}, mobile {P}, resident of {A}", "{N} {P} in case of fire, {A}", "I saw {N} at lunch",
    "Contact {N} if it burns", "Caller: {N}; mobile: {P}; flat: {A}", "mentioned by {N} in passing", "{N} asked for leave", "{N} will join on Friday", "{N} has left the firm", "with {N} and {N} on board", "as {N} says, it holds", "Dear {N},", "Mr {N} came by", "Frau {N} ist krank", "Sra. {N} no vino", "Mme {N} est là",
    "{N} about the trip", "from {N} for the board", "signed off by {N}", "said {N}.", "{N} lives in {A}", "Manager {N} approved",
    "Deliver the chairs to {A} on Monday.", "Our bill should name {A}.", "{A}", "Wir ziehen nach {A} um", "vivo en {A} desde mayo", "j'habite {A} maintenant", "no doorbell at {A}", "the flat in {A} is small", "Return to sender: {A}", "she moved from {A} to {A}", "Bye\n{A}", "pick me up at {A}, please",
    "a copy of passport {I} for the visa", "enter tax id {I} on page two", "Social Security no. {I}", "identity card ({I}) was scanned twice", "Personalausweis {I} liegt bei", "his licence {I} expires in May", "insurance number {I} went missing", "mi pasaporte {I} caduca", "permis {I} perdu", "{I} issued for {N}", "ID {I}, holder {N}", "id number: {I}", "Steuernummer {I}", "resident card {I}",
    "someone billed card {C} again", "she paid by {C} online", "{C}", "{B}", "IBAN: {B}", "wire it to {B} please", "Konto {B} für {N}", "her account {B}, in the name of {N}", "new bank details {B}",
    "part {i} ships from the warehouse", "asset {i} needs a label", "build {i} is green", "the serial {i} is worn off", "order {i} was cancelled", "article {i} sold out", "device {i} rebooted", "parcel {i} is lost", "invoice {i} was paid late", "Teil {i} fehlt", "lote {i} agotado", "model {i} in stock", "batch {i} failed",
    "dummy IBAN {b} for the demo", "a test card such as {c}", "{b}", "{c}", "card {c} with a typo", "the form rejects {b}", "the form rejects {c}",
    "road works along {s} today", "{s} is a quiet place", "the {w} lounge has a sofa", "{w} was delayed by the review", "drop it into the {w} channel", "questions about {w}", "Dear All, the {w} draft", "{w}: summary", "thanks to {w} we ship", "from {w} to {w}", "{w} will move", "{w} has 3 tasks", "{w}", "ask the {w} people", "for {w} by Monday", "{w}\nall good",
    "3 Street lamps broke", "from 20240102 to 20240309", "host 198.51.100.23 rebooted", "agent-core@2.11.0 was tagged", "poke @Gina later", "{g} thinks it is fine", "{g} won't come to the office", "2 stairs at the side and 1 way in",
    "{g} at the corner dot com boom", "paid 2,310.55 USD on 2024-03-05", "meet at six dot", "scale 120:480", "step 88213 ended", "sha 9f31c07be2aa4d10", "{g} and {g} played chess", "The Risk and The Gain", "at 4 on the hour by the road", "look at page dot two",
    "We spent 2 weeks in one place", "It was 7 degrees on the way down", "some 8 people of the close circle", "1 error on the drive", "12 pages for one court", "{g} {g} and me went home", "for {g} {g} said yes", "4 of us drive", "Bye\n{g}", "Next Week Only", "Good Morning Everyone", "New Plan", "{w} and {N} met", "{w}, {w} and {w} are fine", "{w}, {w}: agreed", "for {w}, {w} or {w}", "find it at {E} instead", "reply at {E}", "the {w}, {w}",
)
_SLOT = re.compile(r"\{(\w)\}")


def _digits(r: random.Random, shape: str) -> str:
    return "".join(str(r.randint(0, 9)) if c == "9" else r.choice("ABCDEFGHKLMNPRSTX") if c == "X" else c for c in shape)


def _card(r: random.Random, right: bool) -> str:
    n = r.choice((15, 16))
    while True:
        d = str(r.randint(3, 6)) + "".join(str(r.randint(0, 9)) for _ in range(n - 1))
        if luhn(d) == right:
            break
    sep = r.choice(("", " ", "-"))
    return sep.join((d[:4], d[4:8], d[8:12], d[12:]) if n == 16 else (d[:4], d[4:10], d[10:]))


def _iban(r: random.Random, right: bool) -> str:
    land, body = r.choice((("DE", "9" * 18), ("GB", "XXXX" + "9" * 14), ("NL", "XXXX" + "9" * 10), ("AT", "9" * 16)))
    b = _digits(r, body)
    check = 98 - int("".join(str(int(c, 36)) for c in b + land + "00")) % 97
    if not right:
        check = (check + r.randint(1, 90)) % 97 + 1
    s = f"{land}{check:02d}{b}"
    return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.6 else s


def _fill(slot: str, r: random.Random) -> str:
    given, family, street = r.choice(GIVEN), r.choice(FAMILY), r.choice(STREETS)
    if slot == "E":
        local = r.choice((f"{given}.{family}", f"{given}_{family}+x", f"{given}{r.randint(1, 99)}", f"{given[0]}{family}")).lower().replace("'", "")
        host = r.choice(("mail.fernhill", "north-gate", "coral"))
        return r.choice((f"{local}@{host}.example", f"{local}@{host}.test", f"{local} (at) {host}.example", f"{local}[at]{host}[dot]example", f"{local} at {host.split('.')[0]} dot test"))
    if slot == "P":
        return _digits(r, r.choice(("+1 999 555 9999", "+1-999-555-9999", "+1999555 9999".replace(" ", ""), "(999) 555-9999", "999-555-9999", "999.555.9999", "+44 20 7946 0999", "020 7946 0999", "+49 30 99999 999", "030 / 99999-999", "0049 30 99999999", "+33 1 99 00 99 99", "01 99 00 99 99")))
    if slot == "N":
        n = r.choice((f"{given} {family}", f"{given} {family}", f"{given} {family}", f"{family}, {given}", f"{given} {r.choice('ABKT')}. {family}"))
        return r.choice((n, n, n, n, n.upper(), n.lower()))
    if slot in "As":
        n = r.randint(1, 900)
        forms = (("{n} {s} Street", "{s} Street"), ("{n} {s} Lane", "{s} Lane"), ("{s}weg {n}", "{s}weg"), ("Alte {s}straße {n}a", "{s}straße"), ("Calle {s}, {n}", "Calle {s}"), ("{n}, rue des {s}", "rue des {s}"), ("Am {s} {n}", "Am {s}"))
        filled = r.choice(forms)[slot == "s"].format(n=n, s=street)
        return filled.lower() if r.random() < 0.15 else filled
    if slot in "Ii":
        return _digits(r, r.choice(("999-99-9999", "999 99 9999", "X9999999X", "99.999.999-9", "9999-XX-999", "XX 99 99 99 X")))
    if slot in "Cc":
        return _card(r, slot == "C")
    if slot in "Bb":
        return _iban(r, slot == "B")
    if slot == "w":
        return f"{r.choice(('Copper', 'Silent', 'Winter', 'Golden'))} {r.choice(('Harbor', 'Anchor', 'Meadow', 'Lantern', 'Orchard'))}"
    return given


KIND = {"E": "email", "P": "phone", "N": "name", "A": "address", "I": "id_number", "C": "id_number", "B": "id_number"}


def annotated(seed: int = 7, copies: int = 12) -> list[tuple[str, list[tuple[int, str]]]]:
    """(sentence, [(start, kind)]) for ``copies`` fillings of each pattern."""
    r, out = random.Random(seed), []
    for pattern in PATTERNS:
        for _ in range(copies):
            text, marks, at = "", [], 0
            for m in _SLOT.finditer(pattern):
                text += pattern[at : m.start()]
                if m[1] in KIND:
                    marks.append((len(text), KIND[m[1]]))
                text += _fill(m[1], r)
                at = m.end()
            out.append((text + pattern[at:], marks))
    return out


def examples(seed: int = 7, known: int = 3) -> list[tuple[str, list[Candidate], set[Candidate]]]:
    """Each sentence with its candidates and right candidates; ``known`` of four names are in the lexicon, so weights for new names are learned too."""
    of = lambda names: frozenset(fold(n) for i, n in enumerate(names) if i % 4 < known)
    lex = Lexicon(of(GIVEN), of(FAMILY))
    out = []
    for text, marks in annotated(seed):
        segments = candidates(text, lex)
        right = set()
        for mark in marks:
            fits = [c for c in segments if (c.start, c.kind) == mark]
            if fits:
                right.add(max(fits, key=lambda c: c.end))
        if segments:
            out.append((text, segments, right))
    return out
