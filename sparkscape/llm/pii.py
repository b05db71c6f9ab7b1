"""Personal information in free text: finding, typed placeholders and keyed surrogates.

Detection runs in Arrow batches on the text in NFC, with every place mapped back to the
text as it stands. Kinds are looked for in a fixed order, and what one has taken is closed
to the next: e-mail addresses, street addresses, identity numbers, telephone numbers, names.
One automaton over the text tells which kinds can be in it at all and where family names end;
the patterns of numbers begin at digits, what stands before them is judged only where one is found.

Names need evidence: a known given name, an initial or a form of address beside a family
name. Family names are the listed ones and words built like them: the beginnings and endings
that many listed names share (learned from the list, see ``FamilyShape``).

What is found is replaced in the same pass (``cells``), by surrogates (see ``surrogates``) or placeholders.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscape.llm.surrogates import PARTICLES, SP, Surrogates, fold, form, identity, permuted  # noqa: F401 - names used from here
from sparkscape.session import fixed_rows

PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
I = regex.IGNORECASE

# --- e-mail

_ATOM = r"[\p{L}\p{N}_%+\-]+(?:\.[\p{L}\p{N}_%+\-]+)*"
_AT = rf"(?:{SP}?@{SP}?|{SP}?[(\[{{]{SP}?(?:at|@|arroba|arobase){SP}?[)\]}}]{SP}?)"
_DOT = rf"(?:\.|{SP}?[(\[{{]{SP}?(?:dot|punto|punkt|point|\.){SP}?[)\]}}]{SP}?|{SP}(?:dot|punto|punkt|point){SP})"
_SPELT_DOT = rf"(?:{SP}?[(\[{{]{SP}?(?:dot|punto|punkt|point|\.){SP}?[)\]}}]{SP}?|{SP}(?:dot|punto|punkt|point){SP})"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?"
_TLD = r"\p{L}{2,}(?![\p{L}\p{N}\-])"
EMAIL = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}._%+\-]){_ATOM}(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}{_TLD}|{SP}(?:at|arroba|arobase){SP}{_LABEL}(?:{_DOT}{_LABEL})*{_SPELT_DOT}{_TLD})", I
)

# --- street addresses

_W = r"\p{L}[\p{L}\p{M}'’]*(?:-\p{L}[\p{L}\p{M}'’]*)*"
_CAP = r"\p{Lu}[\p{L}\p{M}'’]*(?:-\p{L}[\p{L}\p{M}'’]*)*"
# More than one word only where a border follows the last.
_NAME = rf"(?:(?-i:{_CAP}(?:{SP}{_CAP}){{1,3}})(?=,|{SP}*[;.|)\n\r]|$|{SP}+\d|{SP}(?-i:St|Rd|Ln)\b)|{_W})"
ADDRESS = [
    regex.compile(
        rf"(?<![\p{{L}}\p{{N}}])(?:c/|calle|avda\.?|avenida|av\.|plaza|pza\.|plza\.|paseo|ronda|camino|travesía|carretera|ctra\.|glorieta|rambla){SP}*(?<=[/{SP[1:-1]}.])(?:del?{SP}+(?:l[ao]s?{SP}+)?)?{_NAME}"
        rf"(?:,?{SP}+(?:n[º°]|n\.º|núm\.?|número)?{SP}*)\d{{1,4}}(?:{SP}?(?:bis|ter)\b|[a-z]\b)?(?![\p{{L}}\d])",
        I,
    ),
    regex.compile(
        rf"(?<![\p{{L}}\p{{N}}.,/])\d{{1,4}}(?:{SP}?(?:bis|ter|quater)|[a-d])?,?{SP}+(?:rue|avenue|av\.|boulevard|bd\.?|blvd\.?|place|chemin|impasse|quai|allée|cours|route|square|passage){SP}+(?:(?:de{SP}+la|des|de|du){SP}+|de{SP}+l['’]|d['’])?{_NAME}(?![\p{{L}}])", I
    ),
    regex.compile(
        rf"(?<![\p{{L}}\p{{N}}.,/=])\d{{1,4}}[A-Za-z]?{SP}+(?:(?:Old|New|Upper|Lower|North|South|East|West|Great|Little){SP}+)?{_CAP}(?:{SP}{_CAP}){{0,2}}?{SP}+(?:(?:Street|Road|Lane|Court|Avenue|Drive|Close|Way|Place|Square|Terrace|Crescent|Gardens|Boulevard|STREET|ROAD|LANE|COURT|AVENUE|DRIVE)\b|(?:St|Rd|Ln|Ct|Ave|Sq|Blvd|ST|RD|LN|CT|AVE)\b\.?)"
    ),
    regex.compile(rf"(?<![\p{{L}}\p{{N}}.,/=])\d{{1,4}}[a-z]?{SP}+(?:(?:old|new){SP}+)?{_W}{SP}+(?:(?:street|road|lane|court|avenue)\b|(?:st|rd|ave)\.)"),
]

# A street noun at the end of the word: found by the number, then extended to the left.
ENDS = r"(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|damm|ufer|steig|pfad|chaussee)"
ADDRESS_NUMBER = regex.compile(rf"(?<={SP})\d{{1,4}}(?:{SP}?[a-z](?![\p{{L}}\d.]))?(?![\p{{L}}\d])", I)
ADDRESS_NOUN = regex.compile(rf"(?r){ENDS}{SP}+", I)
ADDRESS_START = regex.compile(rf"(?r)(?<![\p{{L}}\p{{N}}'’-])(?:(?-i:Am|Im|Beim|Zum|Zur|An{SP}+der|Auf{SP}+der|In{SP}+der|Hinter{SP}+der|Unter{SP}+den|AM|IM){SP}+)?(?:(?:Alter?|Neuer?|Große|Kleine|Obere|Untere){SP}+)?{_W}-?", I)

# --- identity numbers, most telling first

_B, _E = r"(?<![\p{L}\p{N}_.+\-#…])", r"(?![\p{L}\p{N}_…])"
_DL = "[A-HJ-NP-TV-Za-hj-np-tv-z]"
ID_LABEL = r"(?<![\p{L}\p{N}])(?:DNI|NIE|NIF|documento(?:\s+n[º°o.]+)?|SSN|social security (?:no\.|number)|NI number|ID number|n[°º] (?:de )?sécu(?:rité sociale)?|NIR|Personalausweis|Ausweis(?:-Nr\.|nummer)?|SV-Nummer|Versicherungsnummer|passport(?: no\.)?|id)\s*[:=]?\s*"
_LABELLED = regex.compile(rf"(?r){ID_LABEL}", I)
# (pattern that begins at a digit or is rare, what must stand before it, whether that belongs to the number)
ID_NUMBER = [
    (regex.compile(rf"{_B}[XYZxyz][- ]?\d{{7}}[- ]?{_DL}{_E}"), None, False),
    (regex.compile(rf"{_B}\d{{2}}\.\d{{3}}\.\d{{3}}(?:[- ]?{_DL})?{_E}"), None, False),
    (regex.compile(rf"{_B}(?<![=:])\d{{8}}-?{_DL}{_E}"), None, False),
    (regex.compile(rf"\d{{8}}[- ]?{_DL}{_E}", I), regex.compile(rf"(?r)(?:{ID_LABEL}|[=(/:]{SP}?|\b(?:dice|shows|steht|porte){SP})", I), False),
    (regex.compile(rf"{_B}\d{{2}}{SP}?\d{{6}}{SP}?\p{{L}}{SP}?\d{{3}}{_E}"), None, False),
    (regex.compile(rf"\d{{2}}[- ]?\d{{2}}[- ]?\d{{2}}[- ]?[A-Da-d]{_E}"), regex.compile(rf"(?r){_B}[A-Za-z]{{2}}[- ]?"), True),
    (regex.compile(rf"{_B}[1-9]{SP}?\d{{2}}{SP}?\d{{2}}{SP}?(?:\d{{2}}|2[AB]){SP}?\d{{3}}{SP}?\d{{3}}{SP}?\d{{2}}{_E}"), None, False),
    (regex.compile(rf"{_B}(?<![=/])\d{{3}}[-{SP[1:-1]}]\d{{2}}[-{SP[1:-1]}]\d{{4}}{_E}"), None, False),
    (regex.compile(rf"\d{{3}}[-{SP[1:-1]}]\d{{2}}[-{SP[1:-1]}]\d{{4}}{_E}"), _LABELLED, False),
    (regex.compile(rf"(?=[LMPR-TV-Z][0-9A-Z]{{8}}){_B}(?=(?:\w*\d){{4}})[LMPR-TV-Z][0-9A-Z]{{8}}\d?{_E}"), None, False),
    (re.compile(r"(?<![^\W_])[A-Za-z](?=[A-Za-z]{0,5}[0-9])(?=(?:[0-9A-Za-z]*?[0-9]){4})[0-9A-Za-z]{8}[0-9]?(?![\w…])"), _LABELLED, False),
    (regex.compile(rf"\d{{8,9}}{_E}"), regex.compile(r"(?r)\b(?:DNI|NIE|NIF|SSN|NIR)\s*[:=]?\s*", I), False),
]

# --- telephone numbers

_S = r"[    .\-/]"
_PB, _PE = r"(?<![\p{L}\p{N}_+=#@…]|\d[.,\-/:])", r"(?![\p{L}\p{N}_…]|[.,\-/:]\d)"
PHONE = [
    # international: +34 ..., (+34) ..., 0034 ...
    regex.compile(rf"(?<![\p{{L}}\p{{N}}_])(?:\(\+\d{{1,3}}\)|\+\d{{1,3}}|{_PB}(?<!\d[    ])00(?:1|3[0-469]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58]|351|353|352)){_S}?(?:\(0\){_S}?)?(?:\(\d{{1,4}}\){_S}?)?\d{{1,5}}(?:{_S}?\d{{2,8}}){{1,4}}{_PE}"),
    regex.compile(rf"{_PB}[5-9]\d{{2}}(?:{_S}\d{{3}}{_S}\d{{3}}|(?:{_S}\d{{2}}){{3}}){_PE}"),
    regex.compile(rf"{_PB}[5-9]\d{{8}}{_PE}"),
    regex.compile(rf"{_PB}0\d(?:{_S}\d{{2}}){{4}}{_PE}"),
    regex.compile(rf"{_PB}0[1-9]\d{{8}}{_PE}"),
    regex.compile(rf"{_PB}(?:\(0\d{{2,4}}\){_S}?|0\d{{2,4}}{_S})\d{{3,6}}(?:{_S}\d{{2,5}})?{_PE}"),
    regex.compile(rf"(?=\(?\d){_PB}(?:1{_S})?(?:\([2-9]\d{{2}}\){_S}?|[2-9]\d{{2}}{_S})[2-9]\d{{2}}{_S}\d{{4}}{_PE}"),
    regex.compile(rf"{_PB}555-\d{{4}}{_PE}"),
]

# --- names

TITLES = "Dr Dra Prof Profa Pr Sr Sra Srta Mr Mrs Ms Miss Mme Mlle Herr Herrn Frau Don Doña Señor Señora Señorita Monsieur Madame Mademoiselle Sir Lady Lic Ing Maître"
_WORD = r"\p{L}[\p{L}\p{M}'’]*"


class FamilyShape:
    """Whether a word is a family name: listed, or with a beginning and an ending that at least
    ``support`` listed names share. Fitted on the whole list of name parts, which is of fixed size."""

    def __init__(self, listed: list[str], support: int = 8):
        self.listed = {fold(n) for n in listed}
        heads, tails = Counter(), Counter()
        for n in self.listed:
            heads.update(n[:k] for k in range(2, min(6, len(n))))
            tails.update(n[-k:] for k in range(4, min(8, len(n))))
        self.heads = tuple(h for h, c in heads.items() if c >= support)
        self.tails = tuple(t for t, c in tails.items() if c >= support)
        self.known: dict[str, bool] = {}
        # Every family name ends in one of these.
        rest = {n for n in self.listed if not (self.tails and n.endswith(self.tails))}
        self.hints = sorted(rest | {t for t in self.tails if not any(t != u and t.endswith(u) for u in self.tails)})

    def __call__(self, word: str) -> bool:
        got = self.known.get(word)
        if got is None:
            w = fold(word)
            got = w in self.listed or (len(w) >= 5 and bool(self.heads) and w.startswith(self.heads) and w.endswith(self.tails))
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = got
        return got


# All that normalizing can change: letters with marks after them, and single characters that have another NFC form.
MARKED = regex.compile(r"\P{M}?\p{M}+|[\u0340-\u0387\u0958-\u0fff\u1100-\u11ff\u1f00-\u1fff\u2000\u2001\u2126\u212a\u212b\u2329\u232a\u2adc\uf900-\ufaff\ufb00-\ufb4f\U0001d15e-\U0001d1c0\U0002f800-\U0002fa1f]\p{M}*")


class Mapped:
    """A text in NFC and, for each of its places, the place in the text as it stands."""

    def __init__(self, text: str):
        self.raw = text
        if unicodedata.is_normalized("NFC", text):
            self.text, self.at = text, None
            return
        out: list[str] = []
        self.at, done = [], 0
        for m in MARKED.finditer(text):
            out.append(text[done : m.start()])
            self.at.extend(range(done, m.start()))
            c, n = unicodedata.normalize("NFC", m.group()), m.end() - m.start()
            out.append(c)
            self.at.extend(m.start() + (k if n == len(c) else 0) for k in range(len(c)))
            done = m.end()
        out.append(text[done:])
        self.at.extend(range(done, len(text) + 1))
        self.text = "".join(out)

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.at is None else (self.at[a], self.at[b])


DIGIT = re.compile(r"\d")
# What a text must hold for a kind to be looked for: bits of ``Detector.scan``.
AT, CALLE, RUE, ENDING, FAMILY, LABEL = 1, 2, 4, 8, 16, 32
BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CUES = {
    AT: "@ arroba arobase",
    CALLE: "c/ calle avda avenida av. plaza pza. plza. paseo ronda camino travesía carretera ctra. glorieta rambla",
    RUE: "rue avenue av. boulevard bd blvd place chemin impasse quai allée cours route square passage",
    ENDING: "straße strasse str. gasse weg allee platz ring damm ufer steig pfad chaussee",
}


def spans(found: list[tuple[int, int]], s: str) -> str:
    """The text with the found places closed."""
    out, at = [], 0
    for a, b in found:
        out += [s[at:a], "\x00" * (b - a)]
        at = b
    return "".join([*out, s[at:]])


class Detector:
    """Finds the entities of a text; built once in each worker from the list of name parts."""

    def __init__(self, parts: list[tuple[str, str]]):
        given = sorted({fold(n) for n, k in parts if k == "given" and n}, key=lambda n: (-len(n), n))
        self.given = set(given)
        self.family = FamilyShape([n for n, k in parts if k == "family" and n])
        titles = "|".join(sorted(TITLES.split(), key=lambda t: (-len(t), t)))
        self.particles = PARTICLES
        names = "|".join(map(regex.escape, given)) or "(?!)"
        self.anchor = regex.compile(rf"(?<![\p{{L}}\p{{M}}\p{{N}}_@.]|\p{{L}}[-'’])(?:(?P<given>{names})(?![\p{{L}}\p{{M}}\p{{N}}_'’@]|-\d)|(?P<title>(?:{titles})(?![\p{{L}}\p{{M}}\p{{N}}_'’])\.?)|(?P<initial>\p{{L}})\.)", I)
        self.word = regex.compile(rf"{_WORD}(?:-{_WORD})*")
        self.gap = regex.compile(SP + "{1,3}")
        self.tail_initial = regex.compile(rf"\p{{L}}\.(?={SP}|-)")
        self.before = regex.compile(rf"(?r)(?<![\p{{L}}\p{{M}}\p{{N}}_@.-])({_WORD}(?:-{_WORD})*(?:{SP}{_WORD}(?:-{_WORD})*)*),{SP}{{1,2}}")
        self.chain = regex.compile(rf"(?r)(?:(?<!\p{{L}})(?:{'|'.join(sorted(self.particles))}){SP}{{1,3}})+", I)
        longest = max(map(len, given), default=1)
        # From a name's beginning to its first family name: given name and up to five steps; beyond it only particles.
        self.reach, self.ahead = 6 * (longest + 4) + max(map(len, self.family.listed), default=0), longest + 40
        self.cues = ahocorasick.Automaton()
        bits: Counter = Counter()
        for bit, words in CUES.items():
            for w in words.split():
                bits[w] |= bit
        for h in self.family.hints:
            bits[h] |= FAMILY
        for w in ("dni", "nie", "nif", "documento", "ssn", "security", "number", "sécu", "nir", "ausweis", "nummer", "passport", "id:", "id=", *(f"id{c}" for c in BLANKS)):
            bits[w] |= LABEL
        for w, bit in bits.items():
            if w:
                self.cues.add_word(w, bit)
        self.cues.make_automaton()

    def scan(self, low: str) -> tuple[int, list[int]]:
        """What a lower-case text can hold, and the ends of what may be family names; one pass."""
        flags, ends, n = 0, [], len(low)
        for end, bit in self.cues.iter(low):
            flags |= bit
            if bit & FAMILY and (end + 1 == n or not low[end + 1].isalpha()):
                ends.append(end + 1)
        return flags, ends

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) in the text as it stands, in order, without overlaps."""
        m = Mapped(text)
        s = m.text
        low = s.lower().replace("ς", "σ")
        flags, ends = self.scan(low)
        taken: list[tuple[int, int, str]] = []
        free = s

        def close(found: list[tuple[int, int]], kind: str) -> None:
            nonlocal free
            if found:
                taken.extend((a, b, kind) for a, b in found)
                free = spans(found, free)

        if flags & AT or WRITTEN_AT.search(low):
            close([x.span() for x in EMAIL.finditer(s)], "email")
        if DIGIT.search(s):
            for p, cue in zip(ADDRESS, (CALLE, RUE, 0, 0)):
                if flags & cue == cue or cue == RUE and flags & cue:
                    close([x.span() for x in p.finditer(free)], "address")
            if flags & ENDING:
                close(self.by_noun(free), "address")
            for p, left, own in ID_NUMBER:
                if left is _LABELLED and not flags & LABEL:
                    continue
                found = [(x.span(), left.match(free, 0, x.start()) if left else None) for x in p.finditer(free)]
                close([(y.start() if own else a, b) for (a, b), y in found if y or not left], "id_number")
            for p in PHONE:
                close([x.span() for x in p.finditer(free)], "phone")
        if ends:
            taken.extend((a, b, "name") for a, b in self.names(free, self.windows(free, ends if len(low) == len(s) else None)))
        taken.sort()
        return [(*m.span(a, b), k) for a, b, k in taken]

    @staticmethod
    def by_noun(free: str) -> list[tuple[int, int]]:
        """Streets named by the end of a word, such as Hauptstraße 5."""
        found: list[tuple[int, int]] = []
        for x in ADDRESS_NUMBER.finditer(free):
            noun = ADDRESS_NOUN.match(free, found[-1][1] if found else 0, x.start())
            start = noun and ADDRESS_START.match(free, found[-1][1] if found else 0, noun.start())
            if start:  # the noun alone (a verb, for all one knows) is no street
                found.append((start.start(), x.end()))
        return found

    def windows(self, s: str, ends: list[int] | None) -> list[tuple[int, int]]:
        """Stretches around possible family names in which every name's beginning or given name lies."""
        if ends is None:
            return [(0, len(s))]
        out: list[tuple[int, int]] = []
        for e in ends:
            lo = max(0, e - self.reach)
            for k in range(lo, max(-1, lo - 6), -1):  # a run of particles that reaches beyond
                c = self.chain.match(s, 0, k)
                if c:
                    lo = max(0, c.start() - self.reach)
                    break
            hi = min(len(s), e + self.ahead)
            if out and lo <= out[-1][1]:
                out[-1] = (min(lo, out[-1][0]), hi)
            else:
                out.append((lo, hi))
        return out

    def families(self, s: str, at: int) -> int:
        """End of the family name or names (with particles) that begin at a place; the place itself if none do."""
        end, pos = at, at
        while True:
            w = self.word.match(s, pos)
            if not w:
                return end
            parts = w.group().split("-")
            if all(map(self.family, parts)):
                end = w.end()
            elif self.family(parts[0]) and len(parts) > 1:
                return w.start() + len(parts[0])
            elif not (fold(w.group()) in self.particles):
                return end
            g = self.gap.match(s, w.end())
            if not g:
                return end
            pos = g.end()

    def after_given(self, s: str, at: int) -> int:
        """End of the name whose given name ends at a place; -1 if no family name follows."""
        pos = at
        for _ in range(4):
            g = self.gap.match(s, pos)
            if not g:
                return -1
            end = self.families(s, g.end())
            if end > g.end():
                return end
            i = self.tail_initial.match(s, g.end())
            if i:
                pos = i.end()
                continue
            w = self.word.match(s, g.end())
            if w and fold(w.group()) in self.given:
                pos = w.end()
                continue
            return -1
        return -1

    def names(self, s: str, windows: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        done = 0
        for x in (x for lo, hi in windows for x in self.anchor.finditer(s, lo, hi)):
            if x.start() < done:
                continue
            if x["given"]:
                end = self.after_given(s, x.end())
                if end > 0:
                    yield x.start(), end
                    done = end
                    continue
            elif x["title"]:
                g = self.gap.match(s, x.end())
                if g:
                    end = self.families(s, g.end())
                    if end > g.end():
                        yield g.end(), end
                        done = end
                continue
            else:
                pos = x.end()
                g = self.gap.match(s, pos)
                start = g.end() if g else pos
                end = self.families(s, start)
                if end > start:
                    yield x.start(), end
                    done = end
                    continue
            # family first: "Family, Given" or "Family, G."
            b = self.before.match(s, done, x.start())
            if b:
                start = self._last_families(s, b.start(1), b.end(1))
                if start >= 0:
                    end = x.end()
                    i = regex.match(rf"{SP}\p{{L}}\.(?![\p{{L}}])", s[end : end + 3]) if x["given"] else None
                    end += i.end() if i and not self.family((self.word.match(s, end + i.end() + 1) or i).group()) else 0
                    yield start, end
                    done = end

    def _last_families(self, s: str, a: int, b: int) -> int:
        """Where the run of family names that ends at b begins; -1 if the last word is none."""
        words = [(w.start(), w.end(), w.group()) for w in self.word.finditer(s, a, b)]
        start = -1
        for k in range(len(words) - 1, -1, -1):
            if all(map(self.family, words[k][2].split("-"))):
                start = words[k][0]
            elif not (start >= 0 and fold(words[k][2]) in self.particles and k > 0 and fold(words[k - 1][2]) in self.given):
                break
        return start


WRITTEN_AT = re.compile(r"\bat\b")


# --- operators


def name_parts(table: DataFrame) -> list[tuple]:
    """Rows of the (fixed, small) list of name parts, null names left out."""
    return [tuple(r) for r in fixed_rows(table.select("name_part", "kind", "lang").where("name_part is not null and kind is not null"))]


_DETECTORS: dict[int, Detector] = {}


def detector(parts: list[tuple]) -> Detector:
    key = hash(tuple(parts))
    if key not in _DETECTORS:
        _DETECTORS.clear()
        _DETECTORS[key] = Detector([p[:2] for p in parts])
    return _DETECTORS[key]


_SURROGATES: dict[tuple, Surrogates] = {}


def surrogates(key: str, parts: list[tuple]) -> Surrogates:
    at = (key, hash(tuple(parts)))
    if at not in _SURROGATES:
        _SURROGATES.clear()
        _SURROGATES[at] = Surrogates(key, parts)
    return _SURROGATES[at]


def cells(documents: DataFrame, parts_table: DataFrame, key: str) -> DataFrame:
    """doc_id, kind, found, surrogate, place: every occurrence. Null and empty texts have none."""
    parts = documents.sparkSession.sparkContext.broadcast(name_parts(parts_table))

    def run(batches):
        d, new = detector(parts.value), surrogates(key, parts.value)
        for b in batches:
            out = [(i, k, t[a:e], new(k, t[a:e]), a) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for a, e, k in d.find(t)]
            cols = list(zip(*out)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "kind", "found", "surrogate", "place"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, kind string, found string, surrogate string, place int")


def found(documents: DataFrame, parts_table: DataFrame, key: str = "found") -> DataFrame:
    """doc_id, kind, found: one row per distinct value in a document that is replaced."""
    return cells(documents, parts_table, key).select("doc_id", "kind", "found").distinct()


def replaced(documents: DataFrame, parts_table: DataFrame, make) -> DataFrame:
    """doc_id, text with make(parts)(kind, value) in place of what is found; null stays null."""
    parts = documents.sparkSession.sparkContext.broadcast(name_parts(parts_table))

    def replace(d: Detector, new, t: str) -> str:
        out, at = [], 0
        for a, e, k in d.find(t):
            out += [t[at:a], new(k, t[a:e])]
            at = e
        return "".join([*out, t[at:]])

    def run(batches):
        d, new = detector(parts.value), make(parts.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([replace(d, new, t) if t else t for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, text string")


def redacted(documents: DataFrame, parts_table: DataFrame) -> DataFrame:
    """doc_id, text with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS], [NAME]; all else unchanged, null stays null."""
    return replaced(documents, parts_table, lambda parts: lambda kind, value: PLACEHOLDER[kind])


def with_surrogates(documents: DataFrame, parts_table: DataFrame, key: str) -> DataFrame:
    """doc_id, text with keyed surrogates in place of personal information; null stays null. One pass, no shuffle."""
    return replaced(documents, parts_table, lambda parts: surrogates(key, parts))


def surrogate_map(values: DataFrame, parts_table: DataFrame, key: str) -> DataFrame:
    """kind, found, surrogate of kind, found rows; rows with a null kind or value are left out."""
    parts = values.sparkSession.sparkContext.broadcast(name_parts(parts_table))

    def run(batches):
        new = surrogates(key, parts.value)
        for b in batches:
            made = [new(k, v) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.string())], names=["kind", "found", "surrogate"])

    return values.select("kind", "found").where("kind is not null and found is not null").mapInArrow(run, "kind string, found string, surrogate string")


def checked(documents: DataFrame, parts_table: DataFrame, key: str) -> DataFrame:
    """kind, n_values, split, shared, unchanged, other_form: the promises of the surrogates over all values found.

    split: values whose spellings have more than one surrogate; shared: surrogates of more than one value;
    unchanged: values that are their own surrogate; other_form: values whose surrogate has another form
    (names: another number of words or other separators; else digits, letters and signs at other places).
    """
    rows = cells(documents, parts_table, key).select("kind", "found", "surrogate").distinct()

    def run(batches):
        for b in batches:
            kinds, own, new = (b.column(k).to_pylist() for k in range(3))
            ids = [[identity(k, v) for k, v in zip(kinds, side)] for side in (own, new)]
            shape = lambda k, v: regex.sub("a+", "a", form(v)) if k == "name" else form(v)
            other = [shape(k, a) != shape(k, c) for k, a, c in zip(kinds, own, new)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids[0], pa.string()), pa.array(ids[1], pa.string()), pa.array(other, pa.bool_())], names=["kind", "own", "new", "other"])

    ids = rows.mapInArrow(run, "kind string, own string, new string, other boolean").groupBy("kind", "own", "new").agg(F.max("other").alias("other"))
    by_own = ids.groupBy("kind", "own").agg(F.count("*").alias("n"), F.max(F.col("own") == F.col("new")).alias("same"), F.max("other").alias("other"))
    values = by_own.groupBy("kind").agg(F.count("*").alias("n_values"), F.count_if(F.col("n") > 1).alias("split"), F.count_if("same").alias("unchanged"), F.count_if("other").alias("other_form"))
    shared = ids.groupBy("kind", "new").agg(F.count("*").alias("n")).groupBy("kind").agg(F.count_if(F.col("n") > 1).alias("shared"))
    return values.join(F.broadcast(shared), "kind")  # one row a kind
