"""Personal data and secrets replaced by keyed surrogates of the same type and format.

Detected: e-mail addresses, phone numbers, IPv4 and IPv6 addresses, payment cards and other long
numbers, IBANs, US social security numbers, secrets after a key word, and people named after a
title. A name that a document gives with a title is replaced wherever the document has it again,
unless the document also has that word in small letters.

A surrogate is a keyed permutation of the values that share an entity's type and format: digits
stay digits, letters stay letters of their script and case, separators stay, octets stay octets,
check digits stay right (or wrong), given names of the built-in lists stay within their language
and gender (a title's, where it has one and the name is in no list or in the other gender's), vowels stay vowels in other names. As it is a permutation, distinct entities of a
format get distinct surrogates, and one entity gets one surrogate in every document, which
preserves coreference. The way a phone number is set out doesn't matter, nor does letter case,
except in secrets. Each word of a name is an entity of its own, so that a person's full and short
names stay related.

``collisions`` checks what the permutation can't promise: that no surrogate is itself an entity of
the corpus, or another entity's surrogate. Such entities get a further attempt, which enters the
permutation as a tweak, until none is left; after ``LONGER`` attempts every format grows, by more
with each attempt, so that free values never run out. Values without a letter or digit to permute
(a masked password) get keyed ones instead. Given names stay within lists all of whose names
may be real, so they are not checked against entities, but none stays itself. Moved entities are few; up to ``BROADCAST`` of them are sent to
all executors, more are joined to their documents.

Tables hold entities and surrogates sealed with the key only, and go when they are used.

Texts go through detection twice, once for the corpus' entities and once to be replaced. It looks
for rare characters and words first and runs its patterns at those places only, which costs less
than keeping texts or spans between the passes would.

Defined results: null texts stay null, empty ones empty; texts without entities are unchanged to
the byte; repeated rows get equal replacements; overlapping matches: the leftmost, then the first
type in the order of TYPES; input columns may have any names.
"""

from __future__ import annotations

import hashlib
import ipaddress
import itertools
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.common import dropped, in_worker, keeps, small_batches, written

KEY = b"replace this key"  # production passes its own
BROADCAST = 50_000
ROUNDS = 8
#: Attempts after which a surrogate may be longer than its entity.
LONGER = 6

#: Titles by gender (m, f, or n for either), and given names by language and gender.
TITLES = {
    "m": "Mr Mister Herr Monsieur Señor Sr Don".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Mademoiselle Mlle Señora Sra Señorita Doña".split(),
    "n": "Dr Prof Professor Docteur Doktor Doctor Doctora".split(),
}
GIVEN = {
    "en m": "James John Robert Michael William David Richard Joseph Thomas Charles George Henry Edward Peter Paul Andrew".split(),
    "en f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Emily Alice Helen Laura".split(),
    "fr m": "Jean Pierre Michel André Philippe Louis Jacques Bernard François Antoine Nicolas Julien".split(),
    "fr f": "Marie Jeanne Françoise Monique Catherine Nathalie Isabelle Sylvie Camille Chloé Sophie Claire".split(),
    "de m": "Hans Klaus Jürgen Wolfgang Stefan Andreas Uwe Lukas Felix Jonas Karl Heinrich".split(),
    "de f": "Ursula Monika Petra Sabine Renate Helga Karin Brigitte Ingrid Lena Hannah Greta".split(),
    "es m": "José Antonio Manuel Javier Carlos Miguel Alejandro Diego Pablo Luis Fernando Sergio".split(),
    "es f": "Carmen María Josefa Isabel Dolores Pilar Teresa Ana Lucía Elena Rosa Marta".split(),
}
# The languages of titles, and small words within names.
TITLE_LANGUAGES = {
    "en": "Mr Mister Mrs Ms Miss".split(),
    "de": "Herr Frau".split(),
    "fr": "Monsieur Madame Mme Mademoiselle Mlle".split(),
    "es": "Señor Sr Don Señora Sra Señorita Doña".split(),
}
PARTICLES = "van von der den ter de del della di da du la le los las zu zur y bin ibn al el".split()
_LIST_OF = {n.lower(): (k, i) for k, names in GIVEN.items() for i, n in enumerate(names)}

#: Letters that may stand for each other: by script, vowels and consonants apart.
_ALPHABETS = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àâáäæãå", "éèêë", "îïíì", "ôöóòœõ", "ùûüú", "çñ", "ß", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ", "ϊϋΐΰ", "ς", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "ёіїє", "йґў", "ъь"]
_PLACE = {c: (letters, i) for letters in _ALPHABETS for i, c in enumerate(letters)}


@lru_cache(maxsize=10_000)
def _place(c: str) -> tuple[str, int] | None:
    """Alphabet and place of a small letter or digit: of the list, else the letters of its kind (vowels
    apart, if they are accented) next to it in Unicode; none if there is nothing to exchange it for."""
    if c in _PLACE:
        return _PLACE[c]
    if not c.isalnum() or c.lower() != c:
        return None

    def kind(x: str) -> tuple:
        base = unicodedata.normalize("NFD", x)[0]
        return unicodedata.category(x), base == x, base in "aeiouyαεηιουωаеиоуыэюя"

    near = [x for x in map(chr, range(ord(c) & ~127, (ord(c) | 127) + 1)) if x not in _PLACE and x.isalnum() and x.lower() == x and len(x.upper()) == 1 and kind(x) == kind(c)]
    return ("".join(near), near.index(c)) if len(near) > 1 and c in near else None


def permuted(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..size-1: a Feistel network over the next even number of bits, walked until inside."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, head = (1 << half) - 1, hashlib.blake2b(f"{size}|{tweak}".encode(), key=key[:64], digest_size=16).digest()
    width = (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            f = hashlib.blake2b(head + bytes([r]) + right.to_bytes(width, "big"), digest_size=min(64, width + 4))
            left, right = right, left ^ (int.from_bytes(f.digest(), "big") & mask)
        value = left << half | right
        if value < size:
            return value


def by_alphabet(text: str, key: bytes, tweak: str) -> str:
    """Text with every letter and digit that has an alphabet replaced within it, all at once; case stays."""
    lower = [c.lower() for c in text]
    places = [_place(c) for c in lower]
    shape = "|".join([(low if low == c else c) if p is None else f"{p[0][0]}{int(low != c)}" for c, low, p in zip(text, lower, places, strict=True)])
    value, size = 0, 1
    for p in places:
        if p:
            value, size = value * len(p[0]) + p[1], size * len(p[0])
    value = permuted(value, size, key, f"{tweak}|{shape}")
    out = list(text)
    for i in range(len(text) - 1, -1, -1):
        if places[i]:
            letters = places[i][0]
            value, digit = divmod(value, len(letters))
            out[i] = letters[digit] if text[i] == lower[i] or len(letters[digit].upper()) != 1 else letters[digit].upper()
    return "".join(out)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _fill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order; digits beyond it follow."""
    it = iter(digits)
    return "".join([next(it) if c in "0123456789" else c for c in shape]) + "".join(it)


def _fixed(text: str) -> bool:
    """Whether by_alphabet can only return the text itself."""
    return not any((p := _place(c.lower())) and len(p[0]) > 1 for c in text)


def _keyed(e: str, key: bytes, tweak: str, width: int) -> str:
    """So many digits that depend on the entity and the attempt."""
    return f"{permuted(0, 10**width, key, f'{tweak}|{e}|longer'):0{width}d}"


def _growth(tweak: str) -> int:
    """By how many steps the surrogate of this attempt is longer than its entity."""
    return max(0, int(tweak.rpartition("|")[2]) - LONGER + 1)


def _more(e: str, key: bytes, tweak: str) -> str:
    """What a surrogate grows by: its format may have too few other values."""
    steps = _growth(tweak)
    return _keyed(e, key, tweak, 3 + steps) if steps else ""


def _email(e: str, key: bytes, tweak: str) -> str:
    name, _, top = e.rpartition(".")
    if _fixed(name):
        user, _, host = name.partition("@")
        return f"{_keyed(e, key, tweak, max(6, len(user)) + _growth(tweak))}@{host}.{top}"
    out = by_alphabet(name, key, f"{tweak}|{top}") + "." + top
    return out.replace("@", f"{_more(e, key, tweak)}@", 1)


def _number(e: str, key: bytes, tweak: str) -> str:
    return by_alphabet(e, key, tweak) + _more(e, key, tweak)


def _card(e: str, key: bytes, tweak: str) -> str:
    good, out = _luhn(e), e
    while True:  # walks within the numbers with a right, or a wrong, check digit
        out = by_alphabet(out, key, f"{tweak}|card")
        if _luhn(out) == good:
            break
    more = _more(e, key, tweak)
    return next(x for c in "0123456789" if _luhn(x := out + more + c) == good) if more else out


def _ip(e: str, key: bytes, tweak: str) -> str:
    value = permuted(int.from_bytes(bytes(map(int, e.split("."))), "big"), 1 << 32, key, tweak)
    return ".".join(map(str, value.to_bytes(4, "big"))) + _more(e, key, tweak)


def _ip6(e: str, key: bytes, tweak: str) -> str:
    """Groups of zeros stay, until the surrogate has to grow; other groups are permuted together."""
    groups = [int(g, 16) for g in ipaddress.IPv6Address(e).exploded.split(":")]
    own = [i for i, g in enumerate(groups) if g]
    value = 0
    for i in own:
        value = value * 65535 + groups[i] - 1
    value = permuted(value, 65535 ** len(own), key, f"{tweak}|{own}")
    for i in reversed(own):
        value, g = divmod(value, 65535)
        groups[i] = g + 1
    for k, i in enumerate([i for i in range(8) if i not in own][: _growth(tweak)]):
        groups[i] = 1 + permuted(0, 65535, key, f"{tweak}|{e}|{k}")
    return str(ipaddress.IPv6Address(":".join(f"{g:x}" for g in groups)))


def _phone(e: str, key: bytes, tweak: str) -> str:
    """Digits; a number of nine digits (French, without its first 0) keeps a first digit that isn't 0."""
    out = by_alphabet(e, key, tweak)
    while len(e) == 9 and e[0] != "0" and out[0] == "0":
        out = by_alphabet(out, key, tweak)
    return out + _more(e, key, tweak)


def _iban_is_right(e: str) -> bool:
    return int("".join(str(int(c, 36)) for c in e[4:] + e[:4])) % 97 == 1


def _iban(e: str, key: bytes, tweak: str) -> str:
    country, body = e[:2], e[4:]
    body = by_alphabet(body, key, f"{tweak}|{country}") + _more(e, key, tweak)
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    return f"{country}{check:02d}{body}"


def _secret(e: str, key: bytes, tweak: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", e) and not e.isdigit():
        upper = e.upper() == e
        new = f"{permuted(int(e, 16), 16 ** len(e), key, f'{tweak}|hex{len(e)}{upper}'):0{len(e)}x}" + _more(e, key, tweak)
        return new.upper() if upper else new
    if _fixed(e):
        return _keyed(e, key, tweak, len(e) + _growth(tweak))
    return by_alphabet(e, key, tweak) + _more(e, key, tweak)


def _syllables(word: str, e: str, key: bytes, tweak: str, count: int) -> str:
    """So many keyed pairs of consonant and vowel in the script of the word's last letter."""
    first = "α" if "α" <= word[-1] <= "ω" else "а" if "а" <= word[-1] <= "ӿ" else "a"
    at = next(i for i, letters in enumerate(_ALPHABETS) if letters[0] == first)
    a, b = _ALPHABETS[at + 1], _ALPHABETS[at]
    value, out = permuted(0, (len(a) * len(b)) ** count, key, f"{tweak}|{e}|syllables"), ""
    for _ in range(count):
        value, x = divmod(value, len(a) * len(b))
        out += a[x // len(b)] + b[x % len(b)]
    return out


@lru_cache(maxsize=10_000)
def _after(names: str, key: bytes, tweak: str) -> list[int]:
    """Each place of a list of names sent to the next in a keyed order, so that none stays."""
    order = sorted(range(len(GIVEN[names])), key=lambda i: permuted(i, len(GIVEN[names]), key, tweak))
    return [order[(order.index(i) + 1) % len(order)] for i in range(len(order))]


def _given(e: str, key: bytes, tweak: str) -> str:
    """Another given name of the list, so of the language and gender."""
    names, i = _LIST_OF[e]
    return GIVEN[names][_after(names, key, tweak)[i]].lower()


def _titled(e: str, key: bytes, tweak: str) -> str:
    """A given name of the language and gender that a title asks for; with each attempt one name more, joined by hyphens."""
    own, names = e.split("|")
    count = int(tweak.rpartition("|")[2]) + 1
    value, out = permuted(0, len(GIVEN[names]) ** count, key, f"{tweak}|{e}"), []
    for _ in range(count):
        value, i = divmod(value, len(GIVEN[names]))
        out.append(GIVEN[names][i].lower())
    return "-".join(out) if out != [own] else GIVEN[names][(i + 1) % len(GIVEN[names])].lower()


def _name(e: str, key: bytes, tweak: str) -> str:
    """Names that are in no list keep their length, script and vowels."""
    new = _syllables(e, e, key, tweak, (len(e) + 1) // 2) if _fixed(e) else by_alphabet(e, key, tweak)
    grown = _growth(tweak)
    return new + (_syllables(e, e, key, f"{tweak}|longer", grown) if grown else "")


#: Each type's permutation of its normal form; where matches begin together the first type counts.
SURROGATE: dict[str, Callable[[str, bytes, str], str]] = {
    "secret": _secret, "email": _email, "iban": _iban, "ip6": _ip6, "ip": _ip, "ssn": _number, "card": _card, "phone": _phone, "given": _given, "titled": _titled, "name": _name,
}
TYPES = {t: i for i, t in enumerate(SURROGATE)}

#: Gender and language of each title; "M." is one only with its full stop.
_TITLE_OF = {t: (g, next((k for k, own in TITLE_LANGUAGES.items() if t in own), None)) for g, titles in TITLES.items() for t in titles} | {"M.": ("m", "fr")}
_UPPER = "A-Z" + "".join(c for c in map(chr, range(0xC0, 0x590)) if c.isupper())
_WORD = rf"[{_UPPER}][^\W\d_]+"
_NAME = rf"(?:[{_UPPER}]['’])?{_WORD}(?:[-'’]{_WORD})*"
_IPV4 = r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_JWT = r"eyJ[A-Za-z0-9_-]{6,}(?:\.[A-Za-z0-9_-]+){1,2}"
SECRET = re.compile(rf"(?i:\b(?:api[_-]?key|access[_-]?key|secret|token|password|passwd|pwd)\b[\"']?\s*[:=]\s*)(?:\"([^\"\s]{{6,}})\"|'([^'\s]{{6,}})'|({_JWT}|[A-Za-z0-9+/_=-]{{12,}}))")
#: Short passwords without quotes have a digit.
PASSWORD = re.compile(r"(?i:\b(?:password|passwd|pwd)\b\s*[:=]\s*)(?=[^\s\"',;]*[0-9])([^\s\"',;<>&]{6,}?)(?=[.!?]?(?:[\s,;<>&]|$))")
#: Secrets that need no word before them: signed tokens, access keys, passwords in addresses.
SIGNED = re.compile(rf"\b{_JWT}\b")
ACCESS = re.compile(r"\bAKIA[0-9A-Z]{16}\b")
LOGIN = re.compile(r"://[^\s/:@]+:([^\s/@]+)@")
_SECRET_WORDS = ("key", "secret", "token", "passw", "pwd")
EMAIL_USER = re.compile(r"[\w.+-]")
EMAIL_HOST = re.compile(r"@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}(?![\w-])")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b")
IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
FRENCH = r"0[1-9][0-9]{8}(?![0-9])|\+33[ .-]?[1-9](?:[ .-]?[0-9]{2}){4}(?![0-9]|[ -][0-9])|0[1-9](?:[ .-][0-9]{2}){4}(?![0-9]|[ -][0-9])"
#: What may hold numbers: four digits or more, with at most two separators between each.
DIGITS = re.compile(r"[0-9](?:[ .()-]{0,2}[0-9]){3,}")
NUMBERS = re.compile(
    rf"(?P<ip>(?<![0-9.]){_IPV4}(?![0-9]|\.[0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<card>(?<![0-9.])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}(?![0-9])|(?<![0-9.])[0-9]{13,19}(?![0-9]))"
    rf"|(?P<phone>(?<![\w+])(?:{FRENCH})"
    r"|(?<![0-9\w])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9]|[ -][0-9])"
    r"|(?<!\w)0[1-9][0-9]{1,3}[ /-][0-9]{6,8}(?![0-9]|[ -][0-9])"
    r"|(?<!\w)\+[0-9]{1,3}(?:[ .-]?[0-9]{2,8}){2,5}(?![0-9]))"
)
_BETWEEN = r"(?:[ ]{1,3}|[ ]?\n[ ]?)"
PERSON = re.compile(rf"\.?{_BETWEEN}({_NAME}(?:{_BETWEEN}(?:(?:{'|'.join(PARTICLES)})[ ]){{0,2}}{_NAME}){{0,2}})")
INITIAL = re.compile(rf"{_WORD}[ ]$")
CAPITALISED = re.compile(rf"(?<!\w){_WORD}")
SMALL = re.compile(r"[^\W\d_]+")


def normal(kind: str, text: str) -> str:
    """What two mentions of one entity have in common."""
    if kind == "iban":
        return text.replace(" ", "").lower()[:2].upper() + text.replace(" ", "")[2:].lower()
    if kind == "phone":
        digits = _digits(text)
        if re.fullmatch(FRENCH, text):
            return digits[-9:]
        if text[0] == "+" and (m := re.match(r"\+([0-9]{1,3})[ .(-]", text)):  # the country's code stays
            digits = digits[len(m[1]) :]
        return digits[-10:] if len(digits) >= 10 else digits
    if kind in ("card", "ssn"):
        return _digits(text)
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))
    if kind == "ip6":
        return str(ipaddress.IPv6Address(text))
    return text if kind == "secret" else text.lower()


def _cased(text: str, new: str) -> str:
    """A surrogate in small letters with the text's capitals."""
    if text.upper() == text and text.lower() != text and len(text) > 1:
        return new.upper()
    out = "".join([n.upper() if o.isupper() and len(n.upper()) == 1 else n for o, n in zip(text, new)]) + new[min(len(text), len(new)) :]
    return "-".join(x[:1].upper() + x[1:] for x in out.split("-")) if "-" in new and "-" not in text and text[:1].isupper() else out


def render(kind: str, text: str, new: str) -> str:
    """The surrogate of a normal form, set out as the text was."""
    if kind == "phone":
        digits = _digits(text)
        return _fill(text, digits[: len(digits) - len(normal(kind, text))] + new)
    if kind in ("card", "ssn"):
        return _fill(text, new)
    if kind == "iban":
        it = iter(new.upper())
        return "".join([c if c == " " else next(it) for c in text]) + "".join(it)
    if kind == "ip6":
        new = new if "::" in text else ":".join(f"{int(g, 16):x}" for g in ipaddress.IPv6Address(new).exploded.split(":"))
        return new.upper() if text.upper() == text else new
    return _cased(text, new) if kind in ("email", "given", "titled", "name") else new


Found = tuple[int, int, str, str]


def _secrets(text: str) -> Iterator[Found]:
    low = text.lower()
    if any(w in low for w in _SECRET_WORDS):
        for m in itertools.chain(SECRET.finditer(text), PASSWORD.finditer(text)):
            yield *m.span(m.lastindex), "secret", m[m.lastindex]
    for mark, pattern in (("eyJ", SIGNED), ("AKIA", ACCESS), ("://", LOGIN)):
        if mark in text and (mark != "://" or "@" in text):
            for m in pattern.finditer(text):
                yield *m.span(m.lastindex or 0), "secret", m[m.lastindex or 0]


def _emails(text: str) -> Iterator[Found]:
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin and EMAIL_USER.match(text, begin - 1):
            begin -= 1
        m = EMAIL_HOST.match(text, at) if begin < at else None
        if m:
            yield begin, m.end(), "email", text[begin : m.end()].lower()
        at = text.find("@", m.end() if m else at + 1)


def _numbers(text: str) -> Iterator[Found]:
    for region in DIGITS.finditer(text):
        # What begins before the digits: "+" of a country, "(" of an area.
        at, end = max(0, region.start() - 2), min(len(text), region.end() + 2)
        while m := NUMBERS.search(text, at, end):
            yield *m.span(), m.lastgroup, normal(m.lastgroup, m[0])
            at = m.end()
    for m in IBAN.finditer(text):
        if _iban_is_right(m[0].replace(" ", "")):
            yield *m.span(), "iban", normal("iban", m[0])
    if text.count(":") > 1:
        for m in IP6.finditer(text):
            try:
                value = int(ipaddress.IPv6Address(m[0]))
            except ValueError:
                continue
            if value > 1 and any(c in "0123456789" for c in m[0]) and len(m[0]) > 6:  # not "a::", nor this machine
                yield *m.span(), "ip6", normal("ip6", m[0])


def _words(text: str, begin: int, end: int) -> Iterator[Found]:
    for m in CAPITALISED.finditer(text, begin, end):
        low = m[0].lower()
        yield *m.span(), "given" if low in _LIST_OF else "name", low


def _named(text: str, begin: int, end: int, gender: str, language: str | None) -> list[Found]:
    """The words of a person's name; the title decides on the gender of a given name that is in no list or in another gender's."""
    words = list(_words(text, begin, end))
    start, stop, kind, low = words[0]
    if kind == "given" and gender != "n" and _LIST_OF[low][0][-1] != gender:
        words[0] = start, stop, "titled", f"{low}|{_LIST_OF[low][0][:2]} {gender}"
    elif kind == "name" and gender != "n" and language and len(words) > 1 and text[stop] in " \n" and low not in PARTICLES:
        words[0] = start, stop, "titled", f"{low}|{language} {gender}"
    return words


def _people(text: str) -> Iterator[Found]:
    titled: list[Found] = []
    for title, (gender, language) in _TITLE_OF.items():
        at = text.find(title)
        while at >= 0:
            end = at + len(title)
            begins = at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_")
            if begins and (m := PERSON.match(text, end)) and not (title == "M." and INITIAL.search(text, max(0, at - 40), at)):
                titled += _named(text, *m.span(1), gender, language)
            at = text.find(title, end)
    if not titled:
        return
    yield from titled
    known = {f[3].partition("|")[0]: f[2:] for f in titled}
    common = {w for w in SMALL.findall(text) if w in known}
    for m in CAPITALISED.finditer(text):
        low = m[0].lower()
        if low in known and low not in common:
            yield *m.span(), *known[low]


def find(text: str) -> list[Found]:
    """Start, end, type and normal form of each entity, in order, without overlaps."""
    out = [*_secrets(text), *_emails(text), *_people(text)]
    if DIGITS.search(text) or text.count(":") > 1:
        out += _numbers(text)
    if len(out) > 1:
        out.sort(key=lambda f: (f[0], TYPES[f[2]], -f[1]))
    end, kept = -1, []
    for e in out:
        if e[0] >= end:
            kept.append(e)
            end = e[1]
    return kept


@lru_cache(maxsize=50_000)
def surrogate(kind: str, entity: str, key: bytes, attempt: int = 0) -> str:
    return SURROGATE[kind](entity, key, f"{kind}|{attempt}")


keeps("surrogates", surrogate.cache_clear)


def replaced(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[str]]:
    """The text with its entities replaced, and the entities' types."""
    found = find(text)
    if not found:
        return text, []
    out, at = [], 0
    for start, end, kind, entity in found:
        new = surrogate(kind, entity, key, attempts.get((kind, entity), 0))
        out += [text[at:start], render(kind, text[start:end], new)]
        at = end
    return "".join([*out, text[at:]]), [f[2] for f in found]


def sealed(text: str, key: bytes) -> str:
    """The text under a key, for tables: equal texts give equal seals, and only who has the key can open one."""
    own = hashlib.blake2b(key, digest_size=32, person=b"seal").digest()
    data = text.encode()
    head = hashlib.blake2b(data, key=own, digest_size=16).digest()
    return (head + _masked(data, own, head)).hex()


def opened(seal: str, key: bytes) -> str:
    data = bytes.fromhex(seal)
    return _masked(data[16:], hashlib.blake2b(key, digest_size=32, person=b"seal").digest(), data[:16]).decode()


def _masked(data: bytes, key: bytes, head: bytes) -> bytes:
    mask = b"".join(hashlib.blake2b(head + i.to_bytes(4, "big"), key=key).digest() for i in range(-(-len(data) // 64)))
    return bytes(a ^ b for a, b in zip(data, mask))


def entities(df: DataFrame, column: str = "text", prints: bool = False, key: bytes = KEY) -> DataFrame:
    """type and sealed entity of each mention, with the md5 of its text if asked for."""
    extra = ["print"] * prints

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("surrogates")
        for b in batches:
            rows = [(i, f[2], f[3]) for i, t in enumerate(b.column(0).to_pylist()) if t for f in find(t)]
            at = pa.array([r[0] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.string()), pa.array([sealed(r[2], key) for r in rows], pa.string()), *(c.take(at) for c in b.columns[1:])], names=["type", "entity", *extra])

    small_batches(df.sparkSession)
    text = df[column].cast("string")
    return df.select(text.alias("t"), *([F.md5(text).alias("print")] * prints)).mapInArrow(run, "type string, entity string" + ", print string" * prints)


def assigned(rows: DataFrame, key: bytes) -> DataFrame:
    """type, entity, attempt with the surrogate of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("surrogates")
        for b in batches:
            new = [surrogate(*x[:2], key, x[2]) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=["type", "entity", "attempt", "surrogate"])

    return rows.select("type", "entity", "attempt").mapInArrow(run, "type string, entity string, attempt int, surrogate string")


def assigned_sealed(rows: DataFrame, key: bytes) -> DataFrame:
    """The same for sealed entities; surrogates come sealed too, so that tables have neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("surrogates")
        for b in batches:
            new = [sealed(surrogate(t, opened(e, key), key, a), key) for t, e, a in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=["type", "entity", "attempt", "surrogate"])

    return rows.select("type", "entity", "attempt").mapInArrow(run, "type string, entity string, attempt int, surrogate string")


def collisions(mentions: DataFrame, key: bytes, compute: Callable[[DataFrame, bytes], DataFrame] = assigned) -> DataFrame | None:
    """type, entity and attempt of the entities whose first surrogate is taken; None if there are none.

    Taken: it is an entity of the corpus, or the surrogate of an entity that comes earlier (by
    attempt, then by name; names that a title picks give way to those of the lists). Each round gives such entities
    their next attempt and looks again; its tables go with the next one.
    """
    family = F.when(F.col("type") == "titled", "given").otherwise(F.col("type")).alias("family")
    every = written(mentions.groupBy("type", "entity").agg(F.lit(0).alias("attempt")), "entities")
    current = written(compute(every, key), "surrogates")
    changed = False
    for _ in itertools.count():  # formats grow with each attempt, so it ends
        real = every.select("type", F.col("entity").alias("surrogate"))
        # A given name stays within its short list, all of whose names may be real.
        is_real = current.filter("type NOT IN ('given', 'titled')").join(real, ["type", "surrogate"], "left_semi").select("type", "entity")
        keeper = current.groupBy(family, "surrogate").agg(F.min(F.struct("attempt", F.col("type") == "titled", "entity")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = current.select("*", family).join(keeper, ["family", "surrogate"]).filter(F.col("entity") != F.col("first.entity")).select("type", "entity")
        taken = written(is_real.union(shared).distinct(), "taken")
        if taken.isEmpty():
            dropped(every)
            dropped(taken)
            return current.filter("attempt > 0").select("type", "entity", "attempt") if changed else None
        changed = True
        again = current.join(taken, ["type", "entity"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        current, before = written(current.join(taken, ["type", "entity"], "left_anti").unionByName(compute(again, key)), "surrogates"), current
        dropped(before)
        dropped(taken)


def _replace(df: DataFrame, key: bytes, shared, listed: bool) -> DataFrame:
    """Columns c0 (the text, replaced) and on, then ``types``; ``listed``: the last column has a row's own attempts."""
    fields = [f for f in df.schema.fields if not (listed and f.name == "attempts")]
    kept = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("surrogates")
        common = shared.value if shared else {}
        for b in batches:
            own = b.column(b.num_columns - 1).to_pylist() if listed else [None] * b.num_rows
            texts, types = [], []
            for t, rows in zip(b.column(0).to_pylist(), own, strict=True):
                attempts = {(r["type"], opened(r["entity"], key)): r["attempt"] for r in rows} if rows else common
                new, found = (None, []) if t is None else replaced(t, key, attempts)
                texts.append(new)
                types.append(["given" if x == "titled" else x for x in found])
            columns = b.columns[1 : b.num_columns - 1] if listed else b.columns[1:]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *columns, pa.array(types, pa.list_(pa.string()))], names=[*kept, "types"])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, T.StructType([*fields, T.StructField("types", T.ArrayType(T.StringType()))]))


def surrogates(df: DataFrame, key: bytes = KEY, column: str = "text", broadcast: int = BROADCAST, types_as: str = "_types") -> DataFrame:
    """All columns of the input, the text replaced, plus ``types_as``: the types of its entities in order.

    If the input has a column of that name, the types' one has an underscore more in front.
    """
    names = df.columns
    while types_as.lower() in {n.lower() for n in names}:
        types_as = f"_{types_as}"
    at = names.index(column)
    places = [at, *(i for i in range(len(names)) if i != at)]
    numbered = df.toDF(*(f"c{places.index(i)}" for i in range(len(names))))
    plain = numbered.select(F.col("c0").cast("string").alias("c0"), *(f"c{i}" for i in range(1, len(names))))

    def named(out: DataFrame) -> DataFrame:
        return out.select(*(f"c{places.index(i)}" for i in range(len(names))), "types").toDF(*names, types_as)

    clashes = collisions(entities(plain, "c0", key=key), key, assigned_sealed)
    if clashes is None:
        return named(_replace(plain, key, None, False))
    few = clashes.limit(broadcast + 1).collect()
    if len(few) <= broadcast:
        shared = df.sparkSession.sparkContext.broadcast({(r.type, opened(r.entity, key)): r.attempt for r in few})
        return named(_replace(plain, key, shared, False))
    mine = entities(plain, "c0", prints=True, key=key).join(clashes, ["type", "entity"]).groupBy("print").agg(F.collect_set(F.struct("type", "entity", "attempt")).alias("attempts"))
    joined = plain.withColumn("print", F.md5("c0")).join(mine, "print", "left").select(*plain.columns, "attempts")
    return named(_replace(joined, key, None, True))
