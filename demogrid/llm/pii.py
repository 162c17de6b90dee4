"""Surrogates for personal data: detected entities get keyed replacements of the same type, format,
script and (for names) gender.

A replacement is a keyed permutation (a Feistel network) of the entity's free characters within its
format: two entities never get the same one, an entity gets the same one in every document, and no
table of all entities is needed to write the texts. Over the distinct entities of all documents,
collisions are checked: a replacement that is itself somebody's real value, or that two entities
share after such a change, is drawn again with the next tweak; only those few exceptions are joined
back to the documents. Once a person is named in a text, later bare mentions of a part of the name are that person too.
A value whose format is used up after a few tweaks, or has no free character
at all, is drawn from a wider format, which grows with every further tweak; so a free one is always found."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import whole

EXCEPTIONS_BROADCAST = 50_000  # exceptions (a few MB) that may be sent to every task; more are joined
FORMAT_TWEAKS = 12  # draws within the format of the value; from this tweak on the format is wider and longer
WIDE = 12  # characters of a wider format, at least

#: Given names by gender and script (fixed lists; replacements stay within a list).
GIVEN = {
    ("f", "latin"): "Alice Anna Barbara Camille Carla Charlotte Claire Elena Emma Hannah Ingrid Julia Laura Lucía Maria Sofía".split(),
    ("m", "latin"): "Adrian Andreas Carlos David Diego Emil Felix Henri Hugo James Jonas Lukas Martin Peter Thomas Walter".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Ольга Татьяна".split(),
    ("m", "cyrillic"): "Алексей Борис Виктор Дмитрий Иван Михаил Николай Сергей".split(),
    ("f", "greek"): "Άννα Ελένη Ιωάννα Μαρία Σοφία Χριστίνα".split(),
    ("m", "greek"): "Ανδρέας Γιάννης Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
#: Further given names that tell a person when a capitalised word follows (fixed list); their letters are permuted.
FIRST = {
    "f": "Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Lisa Nancy Margaret Sandra Emily Michelle Amanda Melissa Deborah Stephanie Rebecca "
         "Cynthia Kathleen Amy Angela Nicole Catherine Diane Monika Sabine Petra Ursula Katrin Sophie Isabelle Céline Amélie Carmen Pilar Marta Teresa".split(),
    "m": "John Robert Michael William Richard Joseph Christopher Daniel Matthew Anthony Steven Andrew Paul Joshua Kenneth Kevin Brian Timothy Ronald Edward "
         "Jeffrey Ryan Jacob Nicholas Eric Jonathan Stephen Klaus Jürgen Wolfgang Stefan Dieter Pierre François Philippe Juan José Luis Javier Miguel Pedro "
         "Manuel Pablo Fernando".split(),
}
#: Country codes of one and two digits; all others have three (fixed values).
_CODES = {"1", "7", "20", "27", *map(str, range(30, 35)), "36", "39", "40", "41", *map(str, range(43, 50)), *map(str, range(51, 59)),
          *map(str, range(60, 67)), "81", "82", "84", "86", *map(str, range(90, 96)), "98"}
#: Words that announce a number that is no telephone number (fixed list).
_COUNTED = re.compile(r"(?:invoice|order|room|ticket|batch|serial|article|item|page|isbn|issn|account|facture|commande|rechnung|bestellung|zimmer|factura|pedido)"
                      r"(?:[ .:#]{1,3}(?:no|nr|num|number|id)\b)?[ .:#]{0,3}$", re.IGNORECASE)
#: Titles that announce a name, with the gender they tell (fixed list).
TITLES = {"Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Don": "m", "Mrs": "f", "Ms": "f", "Miss": "f",
          "Frau": "f", "Madame": "f", "Mme": "f", "Mademoiselle": "f", "Señora": "f", "Doña": "f", "Dr": "", "Prof": ""}

_NAMES = {n: f"given_{key[0]}_{key[1]}" for key, names in GIVEN.items() for n in names} | {n: f"first_{g}" for g, names in FIRST.items() for n in names}
_CAP = r"[^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]+"
#: What is looked for (fixed patterns). Numbers are one pattern, so that a find uses up its digits.
_EMAIL = re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![\w-])")
_SECRET = re.compile(r"(?i:(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?)([A-Za-z0-9+/_-]{6,})")
_SECRET_WORDS = ("passw", "pwd", "secret", "token", "key")
_ACCESS = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NUMERIC = re.compile(r"[0-9+(][0-9 ()./+-]{5,}[0-9]")
_BYTE = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_NUMBER = re.compile(
    rf"(?<![0-9.])(?P<ip>(?:{_BYTE}\.){{3}}{_BYTE})(?![0-9]|\.[0-9])"
    r"|(?<![0-9.+-])(?P<card>[0-9](?:[ -]?[0-9]){12,18})(?![0-9-])"
    r"|(?<![0-9-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"
    r"|(?<![\w+])(?P<phone>(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{2,4}[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4})?"
    # after a country prefix: pairs of digits, with or without three digits before them; area code and one long block; no separators
    r"|\+[1-9][0-9]{0,2}[ .-]?(?:\(0\)[ .-]?)?(?:[0-9]{1,3}(?:[ .-][0-9]{3})?(?:[ .-][0-9]{2}){2,4}|(?:\([0-9]{1,5}\)[ .-]?|[0-9]{1,5}[ .-])[0-9]{5,9}|[0-9]{7,12})"
    # national: French pairs; German area code and one long block, three and pairs or pairs; Spanish pairs
    r"|0[1-9](?P<sep>[ .-])[0-9]{2}(?:(?P=sep)[0-9]{2}){3}"
    r"|(?:\(0[1-9][0-9]{1,4}\)[ .-]?|0[1-9][0-9]{1,4}[ ./-])(?:[0-9]{5,9}|[0-9]{3}(?:[ .-][0-9]{2}){2}|[0-9]{2}(?:[ .-][0-9]{2}){2,3})"
    r"|[6-9][0-9]{2}(?:[ .-][0-9]{2}){3}|9[0-9][ .-][0-9]{3}(?:[ .-][0-9]{2}){2})(?![0-9-])")
_TITLED = re.compile(rf"(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[ ](?P<name1>{_CAP})(?:[ ](?P<name2>{_CAP}))?")
_NAMED = re.compile(rf"(?P<given>{'|'.join(sorted(_NAMES, key=len, reverse=True))})[ ](?P<sur>{_CAP})")
_DIGIT = re.compile(r"[0-9]")
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Entity:
    kind: str
    value: str  # canonical form: mentions of the same entity agree on it
    start: int
    end: int


def script_of(text: str) -> str:
    c = text[0] if text else ""
    return "cyrillic" if "\u0400" <= c <= "\u04ff" else "greek" if "\u0370" <= c <= "\u03ff" else "latin"


def _people(text: str) -> Iterator[tuple[int, int, list[Entity]]]:
    for m in _TITLED.finditer(text):
        gender = TITLES[m["title"]]
        if m["name2"]:
            kind = _NAMES.get(m["name1"]) or "first" + (gender and f"_{gender}")
            yield *m.span(), [Entity(kind, m["name1"], *m.span("name1")), Entity("surname", m["name2"], *m.span("name2"))]
        else:
            yield *m.span(), [Entity("surname", m["name1"], *m.span("name1"))]
    for m in _NAMED.finditer(text):
        yield *m.span(), [Entity(_NAMES[m["given"]], m["given"], *m.span("given")), Entity("surname", m["sur"], *m.span("sur"))]


def _with_bare_mentions(text: str, found: list[Entity]) -> list[Entity]:
    """The entities, and every later word that is a part of a name found before it, as the entity it was first."""
    named: dict[str, Entity] = {}
    for e in found:
        if e.kind == "surname" or e.kind.startswith(("first", "given_")):
            named.setdefault(e.value, e)
    if not named:
        return found
    out, left = [], iter([*found, Entity("", "", len(text), len(text))])
    after = next(left)
    for m in _LETTERS.finditer(text, min(e.end for e in named.values())):
        while after.end <= m.start() and after.kind:
            out.append(after)
            after = next(left)
        e = named.get(m.group())
        if e is not None and e.end <= m.start() and m.end() <= after.start:
            out.append(Entity(e.kind, e.value, *m.span()))
    return [*out, *([after] if after.kind else []), *(e for e in left if e.kind)]


def find_entities(text: str | None) -> list[Entity]:
    """Entities of a text in order, not overlapping: the first to begin stays, of those the first kind in the list below.

    A person gives one entity per part of the name. Patterns start at characters that are rare in prose, so most text
    is only skimmed."""
    text = text or ""
    found: list[tuple[int, int, list[Entity]]] = []
    at = text.find("@")
    while at >= 0:
        for m in _EMAIL.finditer(text, max(0, at - 65), at + 400):
            if m.start() < at < m.end():
                found.append((*m.span(), [Entity("email", m.group().lower(), *m.span())]))
                break
        at = text.find("@", at + 1)
    low = text.lower()
    if any(w in low for w in _SECRET_WORDS):
        for m in _SECRET.finditer(text):
            if m.start() == 0 or not text[m.start() - 1].isalnum():
                found.append((*m.span(1), [Entity("secret", m[1], *m.span(1))]))
    if _DIGIT.search(text):
        left = text
        for kind, pattern in (("access_key", _ACCESS), ("iban", _IBAN)):
            for m in pattern.finditer(text):
                if m.start() == 0 or not text[m.start() - 1].isalnum():
                    found.append((*m.span(), [Entity(kind, canonical(kind, m.group()), *m.span())]))
                    left = left[:m.start()] + "x" * (m.end() - m.start()) + left[m.end():]
        for c in _NUMERIC.finditer(left):
            for m in _NUMBER.finditer(left, c.start(), c.end() + 2):
                kind, mention = next(k for k in ("ip", "card", "ssn", "phone") if m[k]), m.group()
                if kind == "phone" and mention[0] not in "+(" and _COUNTED.search(left, max(0, m.start() - 24), m.start()):
                    continue
                found.append((*m.span(), [Entity(kind, canonical(kind, mention), *m.span())]))
    for s, e, made in _people(text):
        if s == 0 or not text[s - 1].isalnum():
            found.append((s, e, made))
    out, at = [], 0
    for s, e, made in sorted(found, key=lambda f: f[0]):
        if s >= at:
            out += made
            at = e
    return _with_bare_mentions(text, out)


def canonical(kind: str, mention: str) -> str:
    """Case of e-mail addresses, separators of numbers, country code and trunk zero of telephone numbers do not tell entities apart."""
    if kind == "email":
        return mention.lower()
    if kind == "phone":
        digits = "".join(_DIGIT.findall(mention))
        abroad = mention.startswith("+")
        if not abroad and digits[:2] == "00" and digits[2:3] not in ("", "0"):
            abroad, digits = True, digits[2:]
        if abroad:
            digits = digits[next((n for n in (1, 2) if digits[:n] in _CODES), 3):]
        return digits[1:] if digits[:1] == "0" else digits
    if kind in ("card", "ssn"):
        return "".join(_DIGIT.findall(mention))
    if kind == "iban":
        return mention.replace(" ", "")
    return mention


class Permuter:
    """Keyed permutations of {0 … size-1}: Feistel rounds, repeated until the value is within range."""

    ROUNDS = 6

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def __call__(self, tweak: str, x: int, size: int) -> int:
        if size < 2:
            return x
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, salt = (1 << half) - 1, tweak.encode()
        nbytes = (half + 7) // 8
        while True:
            left, right = x >> half, x & mask
            for r in range(self.ROUNDS):
                h = hashlib.blake2b(bytes([r]) + right.to_bytes(nbytes, "big") + salt, digest_size=max(8, min(64, nbytes)), key=self.key).digest()
                left, right = right, left ^ (int.from_bytes(h, "big") & mask)
            x = left << half | right
            if x < size:
                return x


#: Letters that stand for each other (fixed classes): names keep vowels and consonants in place.
_SETS = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЭЮЯ",
         "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "áéíóú", "àèìòù", "äëïöü", "âêîôû"]
_CLASS = {c: s for s in _SETS for c in s}
#: First and last letter of other scripts (fixed ranges); a letter is replaced by one of its range.
_RANGES = [(0x4E00, 0x9FA5), (0x3041, 0x3096), (0x30A1, 0x30FA), (0xAC00, 0xD7A3), (0x05D0, 0x05EA), (0x0621, 0x063A), (0x0641, 0x064A), (0x0905, 0x0939),
           (0x0985, 0x09B9), (0x0E01, 0x0E2E), (0x0531, 0x0556), (0x0561, 0x0586), (0x10D0, 0x10F0)]
_SCRIPTS = ["".join(c for c in map(chr, range(a, b + 1)) if c.isalpha()) for a, b in _RANGES]
_LOWER, _FIGURES = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _letters_like(c: str) -> str | None:
    """The letters that may stand for a letter of a name; None if it has to stay."""
    return _CLASS.get(c) or (next((s for s in _SCRIPTS if c in s), None) if ord(c) > 0x0500 else None)


def _slots(p: Permuter, tweak: str, text: str, classes: list[str | None]) -> str:
    """Permute the characters that have a class, taken together as one mixed-radix number."""
    x, size, shape = 0, 1, []
    for c, s in zip(text, classes):
        shape.append(str(len(s)) + s[0] if s else c)
        if s:
            x, size = x * len(s) + s.index(c), size * len(s)
    x = p(tweak + "|" + "".join(shape), x, size)
    out = []
    for c, s in zip(reversed(text), reversed(classes)):
        if s:
            x, r = divmod(x, len(s))
            c = s[r]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _iban_check(country: str, body: str) -> str:
    n = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - n % 97:02d}"


def _email_sets(value: str) -> list[str | None]:
    at = value.index("@")
    labels = value[at + 1:].split(".")
    fixed = 2 if len(labels) > 1 and labels[-2] == "example" else 1
    free = at + 1 + len(".".join(labels[:-fixed]))

    # labels before a reserved domain keep their letters
    def of(i: int, c: str) -> str | None:
        if i >= free:
            return None
        return _FIGURES if c in _FIGURES else _LOWER if c in _LOWER and (i < at or fixed == 1) else None
    return [of(i, c) for i, c in enumerate(value)]


def _drawn(p: Permuter, tweak: str, value: str, sets: list[str]) -> str:
    """A keyed draw of one character of every set."""
    x = int.from_bytes(hashlib.shake_256(p.key + f"{tweak}|{value}".encode("utf-8", "surrogatepass")).digest(2 * len(sets) + 16), "big")
    out = []
    for s in sets:
        x, r = divmod(x, len(s))
        out.append(s[r])
    return "".join(out)


def _wider(p: Permuter, kind: str, value: str, tweak: int) -> str:
    """A draw from a format of the same kind with more room; it is one character longer with every tweak.

    The draws are not one-to-one by themselves: like all others they are checked against the real values and each other."""
    t, more = f"{kind}#wide#{tweak}", max(1, tweak - FORMAT_TWEAKS + 1)
    room = max(WIDE, len(value)) + more
    if kind == "email":
        at = value.index("@")
        return _drawn(p, t, value, [_LOWER] * (max(WIDE, at) + more) + [x or c for x, c in zip(_email_sets(value)[at:], value[at:])])
    if kind == "ip":  # a private or documentation address of the longer protocol
        private = value.startswith(("10.", "192.168.")) or value.startswith("172.") and 16 <= int(value.split(".")[1]) < 32
        groups = _drawn(p, t, value, ["0123456789abcdef"] * 24)
        return ("fd00:db8:" if private else "2001:db8:") + ":".join(groups[i:i + 4] for i in range(0, 24, 4))
    if kind == "card":
        head = value[0] + _drawn(p, t, value, [_FIGURES] * (len(value) - 1 + more))
        return next(head + d for d in _drawn(p, t, value, [_FIGURES]) + _FIGURES if luhn(head + d) == luhn(value))
    if kind in ("phone", "ssn"):
        return value[:1] + _drawn(p, t, value, [_FIGURES] * (len(value) + more))
    if kind == "iban":
        body = _drawn(p, t, value, [_FIGURES if c.isdigit() else _LOWER.upper() for c in value[4:]] + [_FIGURES] * more)
        return value[:2] + _iban_check(value[:2], body) + body
    if kind == "access_key":
        return value[:4] + _drawn(p, t, value, [_LOWER.upper() + _FIGURES] * (len(value) - 4 + more))
    if kind == "secret":
        return _drawn(p, t, value, [_LOWER + _FIGURES] * room)
    # a name: its letters like before, then syllables (or letters of its script)
    sets = [_letters_like(c) or (_SETS[4] if c.isupper() or not i else _SETS[1 + i % 2]) for i, c in enumerate(value)]
    tail = [sets[-1]] if sets[-1] in _SCRIPTS else [_SETS[6], _SETS[5]] if sets[-1][0] in "аб" else [_SETS[10], _SETS[9]] if sets[-1][0] in "αβ" else [_SETS[2], _SETS[1]]
    return _drawn(p, t, value, sets + [tail[i % len(tail)] for i in range(max(2, WIDE // 2 - len(value)) + more)])


def surrogate(p: Permuter, kind: str, value: str, tweak: int = 0) -> str:
    """The replacement of a canonical value. For a fixed key, kind and tweak below FORMAT_TWEAKS it is one-to-one, but
    for values without a free character, which always get one of a wider format."""
    if tweak >= FORMAT_TWEAKS and not kind.startswith("given_"):
        return _wider(p, kind, value, tweak)
    t = f"{kind}#{tweak}"
    if kind.startswith("given_"):
        _, gender, script = kind.split("_")
        names = GIVEN[gender, script]
        return names[p(t, names.index(value), len(names))]
    if kind in ("surname", "first", "first_f", "first_m"):
        classes = [_letters_like(c) for c in value]
        return _slots(p, t, value, classes) if any(classes) else _wider(p, kind, value, tweak)
    if kind == "email":
        return _slots(p, t, value, _email_sets(value))
    if kind == "ip":
        a = [int(o) for o in value.split(".")]
        def sort(b: list[int]) -> str:
            private = b[0] == 10 or b[:2] == [192, 168] or (b[0] == 172 and 16 <= b[1] < 32)
            return "private" if private else "special" if b[0] in (0, 127) or b[0] >= 224 else "public"
        x = int.from_bytes(bytes(a), "big")
        while True:  # an address of the same sort
            x = p(t, x, 1 << 32)
            b = list(x.to_bytes(4, "big"))
            if sort(b) == sort(a):
                return ".".join(map(str, b))
    if kind == "card":
        # the first digit tells the issuer; a valid number stays valid, an invalid one invalid
        figures = "0123456789"
        valid, out = luhn(value), value
        while True:
            if valid:
                head = _slots(p, t, out[:-1], [None] + [figures] * (len(out) - 2))
                return next(head + d for d in figures if luhn(head + d))
            out = _slots(p, t, out, [None] + [figures] * (len(out) - 1))
            if not luhn(out):
                return out
    if kind == "phone":
        # leading digits of groups stay in 2-9 or 0-1; the reserved exchange 555 stays
        figures = "0123456789"
        keep = range(3, 6) if len(value) == 10 and value[3:6] == "555" else ()
        return _slots(p, t, value, [None if i in keep else "23456789" if i == 0 and c in "23456789" else None if i == 0 else figures for i, c in enumerate(value)])
    if kind == "ssn":
        return _slots(p, t, value, ["0123456789"] * len(value))
    if kind == "iban":
        body = _slots(p, t, value[4:], ["0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in value[4:]])
        return value[:2] + _iban_check(value[:2], body) + body
    if kind == "access_key":
        return value[:4] + _slots(p, t, value[4:], ["ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"] * (len(value) - 4))
    hexadecimal = all(c in "0123456789abcdef" for c in value)
    sets = ("0123456789abcdef",) if hexadecimal else ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    classes = [next((s for s in sets if c in s), None) for c in value]
    return _slots(p, t + ("x" if hexadecimal else ""), value, classes) if any(classes) else _wider(p, kind, value, tweak)


def rendered(kind: str, mention: str, value: str) -> str:
    """A canonical replacement in the form of the mention: its separators, prefix and case. What it is longer follows at the end
    (in an e-mail address at the end of the name)."""
    if kind == "email":
        longer = len(value) - len(mention)
        if longer > 0:
            at = mention.index("@")
            mention = mention[:at] + ("A" if mention.isupper() else " ") * longer + mention[at:]
        return "".join(r.upper() if m.isupper() else r for m, r in zip(mention, value))
    if kind in ("phone", "card", "ssn"):
        # country code and trunk zero come first and stay
        keep, at = len(_DIGIT.findall(mention)) - len(canonical(kind, mention)), 0
        while keep:
            keep -= mention[at] in _FIGURES
            at += 1
        digits = iter(value)
        return mention[:at] + "".join(next(digits) if c in "0123456789" else c for c in mention[at:]) + "".join(digits)
    if kind == "iban":
        chars = iter(value)
        return "".join(c if c == " " else next(chars) for c in mention) + "".join(chars)
    return value


def rewrite(p: Permuter, text: str | None, tweaks: dict[tuple[str, str], int]) -> tuple[str | None, list[tuple]]:
    """The text with replacements, and (kind, start, end, surrogate) of each entity; positions are in the old text."""
    if not text:
        return text, []
    out, spans, at = [], [], 0
    for e in find_entities(text):
        new = rendered(e.kind, text[e.start:e.end], surrogate(p, e.kind, e.value, tweaks.get((e.kind, e.value), 0)))
        out += [text[at:e.start], new]
        spans.append((e.kind, e.start, e.end, new))
        at = e.end
    return ("".join([*out, text[at:]]), spans) if spans else (text, spans)


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, value): the distinct entities of all texts."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = {(e.kind, e.value) for t in pdf["text"] for e in find_entities(t)}
            yield pd.DataFrame(sorted(found), columns=["kind", "value"])
    return docs.select(F.col(text).alias("text")).mapInPandas(run, "kind string, value string").distinct()


def collision_exceptions(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, tweak): the entities whose first replacement collides, with the tweak that does not.

    A replacement must not be a real value of its kind (given names, which come from short lists, may be), and no two
    entities may share one; of those that do, the one with the lowest tweak, then value, keeps it."""
    p = Permuter(key)

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf.assign(made=[surrogate(p, k, v, int(t)) for k, v, t in zip(pdf["kind"], pdf["value"], pdf["tweak"])])

    def drawn(df: DataFrame) -> DataFrame:
        return df.select("kind", "value", "tweak").mapInPandas(draw, "kind string, value string, tweak int, made string")

    found = cut_lineage(found.filter(~F.col("kind").startswith("given_")))
    real = found.select("kind", F.col("value").alias("made"), F.lit(True).alias("real"))
    now = drawn(found.withColumn("tweak", F.lit(0)))
    while True:  # the wider formats grow, so the rounds end
        best = F.struct("tweak", "value")
        shared = now.groupBy("kind", "made").agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("first")).filter("n > 1").drop("n")
        judged = cut_lineage(now.join(real, ["kind", "made"], "left").join(shared, ["kind", "made"], "left").withColumn(
            "bad", F.coalesce("real", F.lit(False)) | F.coalesce(F.col("first") != best, F.lit(False))).select("kind", "value", "tweak", "made", "bad"))
        if judged.filter("bad").limit(1).count() == 0:
            return judged.filter("tweak > 0").select("kind", "value", "tweak")
        now = judged.filter("not bad").drop("bad").unionByName(drawn(judged.filter("bad").withColumn("tweak", F.col("tweak") + 1)))


SPANS = "array<struct<kind:string,start:int,end:int,surrogate:string>>"


def replace_entities(docs: DataFrame, key: bytes, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """Every row with the entities of its text replaced, and ``pii``: array of (kind, start, end, surrogate).

    Positions are code points of the old text. ``n_chars``, if there, follows the new text where it changed. NULL and ''
    stay as they are; rows without entities are unchanged; other columns stay, one named ``pii`` is replaced."""
    docs = docs.drop("pii")
    p = Permuter(key)
    exceptions = cut_lineage(collision_exceptions(entities(docs, text), key))
    n = exceptions.count()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", pii {SPANS}"
    names = docs.columns

    if n <= EXCEPTIONS_BROADCAST:
        few = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["value"]): r["tweak"] for r in exceptions.collect()})
        source, tweaks_of = docs, lambda pdf: (few.value for _ in range(len(pdf)))
    else:
        def keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                found = [(k, e.kind, e.value) for k, t in zip(pdf["_k"], pdf["text"]) for e in {(x.kind, x.value): x for x in find_entities(t)}.values()]
                yield pd.DataFrame(found, columns=["_k", "kind", "value"]).astype({"_k": "int64"})
        keyed = docs.withColumn("_k", F.xxhash64(whole(text)))
        mine = (keyed.select("_k", F.col(text).alias("text")).mapInPandas(keys, "_k long, kind string, value string").distinct()
                .join(exceptions, ["kind", "value"]).groupBy("_k").agg(F.collect_list(F.struct("kind", "value", "tweak")).alias("_t")))
        source = keyed.join(mine, "_k", "left").drop("_k")
        tweaks_of = lambda pdf: ({(x["kind"], x["value"]): x["tweak"] for x in (t if t is not None else ())} for t in pdf["_t"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole_pdf in parts:
            for at in range(0, len(whole_pdf), 500):
                pdf = whole_pdf.iloc[at:at + 500]
                done = [rewrite(p, t, tw) for t, tw in zip(pdf[text], tweaks_of(pdf))]
                changed = np.array([len(s) > 0 for _, s in done], dtype=bool)
                out = pdf[names].assign(**{text: [t for t, _ in done], "pii": [[dict(zip(("kind", "start", "end", "surrogate"), x)) for x in s] for _, s in done]})
                if chars in out.columns and changed.any():
                    out.loc[changed, chars] = [len(t) for (t, _), c in zip(done, changed) if c]
                yield out

    return source.mapInPandas(run, schema)
