"""Keyed surrogates for personal information, one-to-one by construction.

A surrogate is a function of key, list of names, kind and value alone, so it is made where the
value is found, without a table of all values. Two different values never get the same one,
however many are in use, as every step can be undone:

- Digits and letters go through a keyed permutation of all texts of the same form (same digits
  and letters of the same script at the same places), which moves every one of them.
- A family name does so too, vowels for vowels, and gets an ending that no listed name has. So
  it is never a listed name nor one that the detector takes for one.
- A given name has its own surrogate from a table over the list: same first letter (initials
  stay, so "A. Pérez" and "Ana Pérez" remain one person) and same last letter, which marks gender
  where a language has it; the lists hold no gender beyond that.

Spellings of one value (case, accents' form, separators, width of digits, at and dot written
out) get spellings of one surrogate. The surrogate of a number or address can be another value
of the collection, which is itself replaced: in a format that is in full use nothing else is left.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from functools import lru_cache
from itertools import product

import regex

SP = r"[ \t\u00a0\u2009\u202f]"
PARTICLES = frozenset("de del de la von van der den di da du le zu zum zur dos das y e".split())
WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’]*")
RUN = regex.compile(r"[\p{L}\p{N}\p{M}]+")
VOWELS = set("aeiouy" "αεηιουω" "аеёиоуыэюяіїє")
ASCII = "abcdefghijklmnopqrstuvwxyz"
PIECE = 24  # letters permuted at once; longer runs go piece by piece
# Words written out in an email address, and parts of an address that stay.
WRITTEN = frozenset("at dot arroba punto punkt point arobase".split())
STREETS = frozenset(
    """calle avda avenida av plaza pza plza paseo ronda camino travesía carretera ctra glorieta rambla rue avenue boulevard bd blvd place chemin
    impasse quai allée cours route square passage street road lane court drive close way terrace crescent gardens st rd ln ct ave sq old new upper lower
    north south east west great little am im beim zum zur an der auf in hinter unter den alte alter neue neuer große kleine obere untere bis ter quater
    n nº nº. núm número del de la las los du des d l c""".split()
)
STREET_ENDS = ("straße", "strasse", "str", "gasse", "weg", "allee", "platz", "ring", "damm", "ufer", "steig", "pfad", "chaussee")
# Country codes by their first digits; all others have three digits.
COUNTRY = regex.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")


def fold(text: str) -> str:
    """NFC in lower case; both Greek small sigmas count as one."""
    return unicodedata.normalize("NFC", text).lower().replace("ς", "σ")


def plain_digits(text: str) -> str:
    """Decimal digits of any script as 0-9."""
    return text if text.isascii() else "".join(str(unicodedata.decimal(c)) if unicodedata.decimal(c, None) is not None else c for c in text)


def identity(kind: str, value: str) -> str:
    """What makes two spellings the same value: case, accents' form, separators and width of digits don't count."""
    v = plain_digits(fold(value))
    if kind in ("phone", "id_number"):
        return regex.sub(r"[^\p{L}\p{N}]", "", v)
    if kind == "email":
        return plain_email(v)
    return regex.sub(r"\s+", " ", v)


def form(value: str) -> str:
    """The form a surrogate keeps: a for letters, 9 for digits, all else as it stands."""
    return regex.sub(r"\p{L}", "a", regex.sub(r"\p{N}", "9", unicodedata.normalize("NFC", value)))


def email_runs(value: str) -> list[tuple]:
    """(match, whether it is at or dot written out) of the runs of letters and digits."""
    found = []
    for m in RUN.finditer(value):
        written = m.group().lower() in WRITTEN and regex.search(r"[\s(\[{]\Z", value[: m.start()]) and regex.match(r"[\s)\]}]", value[m.end() :])
        found.append((m, bool(written)))
    return found


def plain_email(value: str) -> str:
    """Without brackets and blanks, and with @ and . for at and dot written out."""
    out, at = [], 0
    for m, written in email_runs(value):
        out += [value[at : m.start()], ("@" if m.group()[0] in "aA" else ".") if written else m.group()]
        at = m.end()
    return regex.sub(r"[\s()\[\]{}]", "", "".join([*out, value[at:]]))


# --- letters


@lru_cache(10_000)
def letters(c: str, mark: str, by_sound: bool) -> str:
    """The letters one may stand for another, of which c (lower case) is one: same script block, category and,
    where asked, vowel or consonant; with a following mark, those that don't merge with it. '' if there is none."""
    kind, base = unicodedata.category(c), ord(c) & ~0x7F

    def sound(x: str) -> bool:
        return by_sound and unicodedata.normalize("NFD", x)[0] in VOWELS

    def fits(x: str) -> bool:
        return unicodedata.category(x) == kind and x.lower() == x and (len(x.upper()) == 1 and x.upper().lower() == x) and unicodedata.normalize("NFC", x + mark) == x + mark and sound(x) == sound(c)

    found = "".join(x for x in map(chr, range(base, base + 0x80)) if fits(x))
    return found if c in found and len(found) > 1 else ""


def permuted(key: bytes, label: str, n: int, value: int, back: bool = False) -> int:
    """A keyed permutation of range(n), or its inverse: four Feistel rounds on a square around it, walked until inside."""
    if n <= 1:
        return value
    half = math.isqrt(n - 1) + 1
    key = key if len(key) <= 64 else hashlib.sha256(key).digest()

    def f(r: int, x: int) -> int:
        h = hashlib.blake2b(f"{label}|{n}|{r}|{x}".encode("utf-8", "surrogatepass"), key=key, digest_size=32).digest()
        return int.from_bytes(h, "big")

    while True:
        a, b = divmod(value, half)
        for r in (3, 2, 1, 0) if back else range(4):
            a, b = ((b - f(r, a)) % half, a) if back else (b, (a + f(r, b)) % half)
        value = a * half + b
        if value < n:
            return value


def moved(key: bytes, label: str, n: int, value: int) -> int:
    """A keyed permutation of range(n) that leaves no value where it is (n > 1): one step along a keyed cycle of all."""
    return permuted(key, label, n, (permuted(key, label, n, value) + 1) % n, back=True) if n > 1 else value


class Surrogates:
    """Surrogates under a key, for a list of (name_part, kind, lang)."""

    KEPT = 100_000  # runs remembered; beyond that they are made anew, alike

    def __init__(self, key: str, parts: list[tuple[str, str, str | None]]):
        self.key = key.encode() or b"\0"
        self.made: dict[tuple, str] = {}
        self.endings: dict[str, list[str]] = {}
        given = sorted({fold(n) for n, k, _ in parts if k == "given" and n})
        self.listed = {fold(n) for n, k, _ in parts if k in ("given", "family") and n}
        self.given: dict[str, str] = {}
        for n in given:
            self.given[n] = self.new_given(n)

    # -- runs of letters and digits

    def run(self, role: str, run: str, by_sound: bool = False, shut=()) -> str:
        """A run of letters and digits of any script, in NFC, by a permutation of all of its form.

        Runs in ``shut`` never go in and never come out."""
        low = "".join(x if len(x := c.lower()) == 1 else c for c in run).replace("ς", "σ")
        new = self.made.get((role, low))
        if new is None:
            new = "".join(self.piece(f"{role}|{k}", low[k : k + PIECE], by_sound, () if k else shut) for k in range(0, len(low), PIECE))
            if len(self.made) < self.KEPT:
                self.made[role, low] = new
        return "".join(n.upper() if c != lo and len(n.upper()) == 1 else n for c, lo, n in zip(run, low, new))

    def piece(self, role: str, low: str, by_sound: bool, shut) -> str:
        places, value, size, label = [], 0, 1, [role]
        for i, c in enumerate(low):
            d = unicodedata.decimal(c, None)
            if d is not None:
                alphabet = "".join(chr(ord(c) - d + k) for k in range(10))
                name = "9"  # whatever the digits' script
            else:
                mark = low[i + 1] if i + 1 < len(low) and unicodedata.category(low[i + 1])[0] == "M" else ""
                alphabet = letters(c, mark, by_sound) if unicodedata.category(c)[0] == "L" else ""
                name = alphabet[:1] + mark
            if not alphabet:
                label.append(f"={c}")
                continue
            places.append((i, alphabet))
            value, size = value * len(alphabet) + alphabet.index(c), size * len(alphabet)
            label.append(name)
        out = list(low)
        while places:
            value = moved(self.key, "|".join(label), size, value)
            v = value
            for i, alphabet in reversed(places):
                v, k = divmod(v, len(alphabet))
                out[i] = alphabet[k]
            if "".join(out) not in shut:
                break
        return "".join(out)

    def digits(self, role: str, value: str) -> str:
        """A number with letters and separators: all of it permuted as one run, separators and leading zeros staying."""
        at = [i for i, c in enumerate(value) if unicodedata.category(c)[0] in "LN"]
        zeros = 0
        while zeros < len(at) - 1 and unicodedata.decimal(value[at[zeros]], None) == 0:
            zeros += 1
        run = "".join(value[i] for i in at[zeros:])
        first = unicodedata.decimal(run[0], None) if run else None
        if first is None or len(run) == 1:
            new = self.run(f"{role}|{zeros}", run)
        else:  # the first digit isn't 0 and doesn't become it
            new = self.run(f"{role}|{zeros}", run, shut=LeadingZero())
        out = list(value)
        for i, c in zip(at[zeros:], new):
            out[i] = c
        return "".join(out)

    # -- names

    def ending(self, last: str) -> list[str]:
        """Endings of equal length, in the script of a letter, that no listed name has."""
        low = ASCII if regex.match(r"\p{Latin}", last) else letters(last, "", False) or ASCII
        got = self.endings.get(low)
        if got is None:
            size, sounds = 2, [[c for c in low if (unicodedata.normalize("NFD", c)[0] in VOWELS) == v] or list(low) for v in (True, False)]
            while not got:
                taken = {n[-size:] for n in self.listed}
                free = [e for e in map("".join, product(*[sounds[k % 2] for k in range(size)])) if e not in taken]
                got = sorted(free, key=lambda e: hashlib.blake2b(e.encode(), key=self.key[:64], digest_size=8).digest())[:8]
                size += 1
            self.endings[low] = got
        return got

    def family(self, word: str) -> str:
        """A family name of the same letters' sounds, with an ending no listed name has."""
        new = self.run("family", word, by_sound=True)
        last = next((c for c in reversed(fold(new)) if unicodedata.category(c)[0] == "L"), "a")
        ends = self.ending(last)
        end = ends[len(new) % len(ends)]
        upper = sum(c.isupper() for c in word) > 1 and word.upper() == word
        return new + (end.upper() if upper else end)

    def new_given(self, name: str) -> str:
        """First and last letter stay; what is between is drawn until it is no listed name and no other's surrogate."""
        used, k = set(self.given.values()) | self.listed, 0
        while True:
            # From a full round on, letters are added, so this ends.
            inner = name[1:-1] if len(name) > 2 else "an"
            new = name[0] + self.run(f"given|{name[0]}|{name[-1]}|{k}", inner + "ano" * (k // 50), by_sound=True) + name[-1]
            if new not in used and not any(new.endswith(e) for e in self.ending(name[-1])):
                return new
            k += 1

    def name(self, value: str) -> str:
        words = list(WORD.finditer(value))
        roles = ["given" if fold(w.group()) in self.given else "same" if len(w.group()) == 1 or fold(w.group()) in PARTICLES else "family" for w in words]
        if words and set(roles) == {"same"}:
            roles[-1] = "family"
        out, at = [], 0
        for w, role in zip(words, roles):
            new = w.group()
            if role == "given":
                new = self.given[fold(new)]
                new = new.upper() if w.group().isupper() and len(w.group()) > 1 else new if w.group().islower() else new[0].upper() + new[1:]
            elif role == "family":
                new = self.family(new)
            out += [value[at : w.start()], new]
            at = w.end()
        return "".join([*out, value[at:]])

    # -- kinds

    def email(self, value: str) -> str:
        """The runs change, each alike wherever it comes; how at and dot are written and the top-level domain stay."""
        runs, out, at = email_runs(value), [], 0
        last = max((i for i, (_, written) in enumerate(runs) if not written), default=-1)
        for i, (m, written) in enumerate(runs):
            out += [value[at : m.start()], m.group() if written or i == last > 0 else self.run("email", m.group(), shut=WRITTEN)]
            at = m.end()
        return "".join([*out, value[at:]])

    def phone(self, value: str) -> str:
        """The country code after + or 00 stays."""
        m = regex.match(r"(\(?\+|00)", value)
        code = m and COUNTRY.match(plain_digits(value), m.end())
        if not code:
            return self.digits("phone", value)
        return value[: code.end()] + self.digits(f"phone|{code.group()}", value[code.end() :])

    def address(self, value: str) -> str:
        """Kinds of street, articles and separators stay; names and house numbers change."""
        out, at = [], 0
        for m in RUN.finditer(value):
            run, low = m.group(), fold(m.group())
            if low in STREETS or low in STREET_ENDS:
                new = run
            elif unicodedata.decimal(run[0], None) is not None:
                new = self.digits("house", run) if not regex.fullmatch(r"\d+\p{L}", run) else self.digits("house", run[:-1]) + self.run("stair", run[-1])
            else:
                end = next((e for e in STREET_ENDS if low.endswith(e) and len(low) > len(e)), "") if len(low) == len(run) else ""
                head = run[: len(run) - len(end)]
                new = self.run(f"street|{end}", head, by_sound=True, shut=STREETS) + run[len(head) :]
            out += [value[at : m.start()], new]
            at = m.end()
        return "".join([*out, value[at:]])

    def __call__(self, kind: str, value: str) -> str:
        v = unicodedata.normalize("NFC", value)
        if kind == "name":
            return self.name(v)
        if kind == "email":
            return self.email(v)
        if kind == "address":
            return self.address(v)
        return self.phone(v) if kind == "phone" else self.digits(kind, v)


class LeadingZero:
    """The runs that begin with a zero."""

    def __contains__(self, run: str) -> bool:
        return unicodedata.decimal(run[0], None) == 0
