"""Exact scans of one text: the part of detection that regular expressions of the JVM can't express.

A pattern of bounded length is tried again one character after each match's start, so that a value inside an earlier,
rejected match is found; some patterns are cut at their last separator until a prefix passes; hits of one recogniser that
overlap become one. All work is linear in the text: the numeric patterns run only around digits, e-mails only around @.
"""

from __future__ import annotations

import re
from re import _parser
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from . import phones
from .phones import digits

#: Characters between groups of digits, and the rank by which a union of overlapping spans is named.
BLANK = "\t \u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
GAP, CARD_GAP, PHONE_GAP = f"[{BLANK}]{{1,4}}", f"[{BLANK}-]{{1,4}}", f"[{BLANK}./()-]{{1,4}}"
PRIORITY = {"SECRET": 7, "IBAN": 6, "CARD": 5, "SSN": 4, "NATID": 4, "PHONE": 3, "TAXID": 2, "EMAIL": 1, "PERSON": 0, "ORG": 0, "LOCATION": 0}
#: Kinds in order; of kinds that used equally many units the later one is named.
KINDS = ["EMAIL", "PHONE", "SSN", "NATID", "TAXID", "CARD", "IBAN", "SECRET", "PERSON", "ORG", "LOCATION"]
UNITS = 500_000  # validations that one request may cost
PASSES = 4  # of masking, before a request is blocked
B, E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
SEPARATOR = re.compile(f"[{BLANK}./()-]")
TOKEN = re.compile(r"\[\s*([A-Za-z]+)[ _-]*([0-9]+)\s*\]")


class Blocked(Exception):
    """The request must not go out; the message names kinds and counts, never a text."""


class Exhausted(Blocked):
    """The request's validations are spent: its texts were not fully examined. No wrapper may pass over it."""


class Budget:
    """Validations left, and what each kind has used."""

    def __init__(self, units: float = UNITS):
        self.left, self.used = units, {}

    def spend(self, kind: str, units: float = 1) -> None:
        self.left -= units
        self.used[kind] = self.used.get(kind, 0) + units

    def check(self) -> None:
        """Raises if nothing is left, even if the last validation was the last one needed."""
        if self.left <= 0:
            most = max(self.used.values(), default=0)
            by = [k for k in KINDS if self.used.get(k) == most]
            raise Exhausted("budget exhausted" + (f", most by {by[-1]}" if by else ""))


def luhn(h: str) -> bool:
    d = [ord(c) - 48 for c in reversed(digits(h))]
    return bool(d) and (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def card(h: str) -> bool:
    return 13 <= len(digits(h)) <= 19 and luhn(h)


def weighted(h: str, weights) -> int:
    return sum((ord(c) - 48) * w for c, w in zip(h, weights))


def bsn(h: str) -> bool:
    s = weighted(h, (9, 8, 7, 6, 5, 4, 3, 2, -1))
    return s != 0 and s % 11 == 0


def nif(h: str) -> bool:
    r = weighted(h, range(9, 1, -1)) % 11
    return int(h[8]) == (0 if r < 2 else 11 - r)


def mod_11_10(h: str) -> bool:
    p = 10
    for c in h[:-1]:
        p = ((p + int(c)) % 10 or 10) * 2 % 11
    return (11 - p) % 10 == int(h[-1])


def steuer_id(h: str) -> bool:
    body = h[:10]
    often = [c for c in set(body) if body.count(c) > 1]
    return h[0] != "0" and len(often) == 1 and body.count(often[0]) <= 3 and often[0] * 3 not in body and mod_11_10(h)


def lv_code(h: str) -> bool:
    h = h.replace("-", "")
    return h[:2] == "32" or (1 - weighted(h, (1, 6, 3, 7, 9, 10, 5, 8, 4, 2))) % 11 % 10 == int(h[10])


def gb_vat(h: str) -> bool:
    s = weighted(h, range(8, 1, -1)) + int(h[7:9])
    return s % 97 == 0 or (s + 55) % 97 == 0


def cn_id(h: str) -> bool:
    #: Weights and check characters.
    return h[17].upper() == "10X98765432"[weighted(h, (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)) % 11]


def it_cf(h: str) -> bool:
    #: Weights of the odd places for A..Z; the digits share those of A..J.
    odd = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)
    v = [ord(c) - (65 if c >= "A" else 48) for c in h.upper()]
    return (sum(odd[x] for x in v[:15:2]) + sum(v[1:15:2])) % 26 == v[15]


def es_dni(h: str) -> bool:
    #: Check letters.
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(h[:8].upper().translate(str.maketrans("XYZ", "012"))) % 23] == h[8].upper()


def nino(h: str) -> bool:
    #: Letters and pairs that are not given out.
    h = h.upper()
    return h[0] not in "DFIQUV" and h[1] not in "DFIOQUV" and h[:2] not in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")


def iban_verified(h: str) -> bool:
    from .validators import IBAN_LENGTHS

    c = "".join(h.split()).upper()
    if len(c) < 4 or not (c.isascii() and c.isalnum()):
        return False
    return int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1 and IBAN_LENGTHS.get(c[:2], len(c)) == len(c)


def plain(check: Callable[[str], bool], n: int | None = None) -> Callable[[str, Budget], bool]:
    """A rule on ASCII digits and letters that costs nothing; n: the last n characters only."""
    return lambda h, budget: h.isascii() and check(h if n is None else h[-n:])


def _iban(h: str, budget: Budget) -> bool:
    if not any("a" <= c <= "z" for c in h):
        return True
    budget.spend("IBAN", 0.5)
    return iban_verified(h)


def _international(h: str, budget: Budget) -> bool:
    budget.spend("PHONE")
    return phones.international(h)


@dataclass(frozen=True)
class Recogniser:
    name: str
    kind: str
    pattern: re.Pattern
    check: Callable[[str, Budget], bool] | None = None
    again: bool = True  # try one character after each match's start
    shrink: bool = False
    verified: Callable[[str], bool] | None = None
    reach: int = 0  # characters that the pattern may take after its first digit
    run: int = 1  # digits in a row that every match has
    sign: str = ""  # a character that every match has


def _of(name, kind, pattern, check=None, **more) -> Recogniser:
    return Recogniser(name, kind, re.compile(pattern), check, reach=_parser.parse(pattern).getwidth()[1], **more)


#: The patterns.
NUMERIC = [
    _of("iban", "IBAN", rf"{B}[A-Za-z]{{2}}\d{{2}}(?:[A-Za-z0-9]{{11,30}}|(?:{GAP}[A-Za-z0-9]{{4}}){{2,7}}(?:{GAP}[A-Za-z0-9]{{1,4}})?){E}", _iban, shrink=True, verified=iban_verified, run=2),
    _of("card", "CARD", rf"{B}(?:\d{{4}}{CARD_GAP}\d{{4}}{CARD_GAP}\d{{4}}{CARD_GAP}\d{{4}}(?:{CARD_GAP}\d{{1,3}})?|\d{{4}}{CARD_GAP}\d{{6}}{CARD_GAP}\d{{4,5}}|\d{{13,19}}){E}", lambda h, _: card(h), shrink=True, run=4),
    _of("phone_cc", "PHONE", rf"\+\d{{1,3}}(?:{PHONE_GAP}\d{{1,8}}){{1,6}}{E}|\+\d{{8,15}}{E}", _international, shrink=True, sign="+"),
    _of("phone_us", "PHONE", rf"(?:\+1(?:{PHONE_GAP})?)?(?:\(\d{{3}}\)(?:{PHONE_GAP})?|\d{{3}}{PHONE_GAP})\d{{3}}{PHONE_GAP}\d{{4}}|\+\d{{1,3}}{PHONE_GAP}\d{{2,4}}{PHONE_GAP}\d{{2,4}}{PHONE_GAP}\d{{3,4}}|\+\d{{1,3}}{PHONE_GAP}\d{{2,4}}{PHONE_GAP}\d{{5,8}}"),
    _of("ssn", "SSN", rf"{B}\d{{3}}-\d{{2}}-\d{{4}}{E}", run=4, sign="-"),
    _of("it_cf", "NATID", rf"{B}[A-Za-z]{{6}}\d{{2}}[A-Za-z]\d{{2}}[A-Za-z]\d{{3}}[A-Za-z]{E}", plain(it_cf), run=3),
    _of("gb_nino", "NATID", rf"{B}[A-Za-z]{{2}}(?:\d{{6}}|{GAP}\d{{2}}{GAP}\d{{2}}{GAP}\d{{2}}{GAP})[A-Da-d]{E}", lambda h, _: nino(h), run=2),
    _of("es_dni", "NATID", rf"{B}(?:[XYZxyz]\d{{7}}|\d{{8}})[A-Za-z]{E}", plain(es_dni), run=7),
    _of("fr_nir", "NATID", rf"{B}[12]\d{{2}}(?:0[1-9]|1[0-2]|20|3\d|4[0-2]|[5-9]\d)\d{{10}}{E}", plain(lambda h: 97 - int(h[:13]) % 97 == int(h[13:])), run=15),
    _of("nine_digit", "NATID", rf"{B}\d{{9}}{E}", plain(lambda h: bsn(h) or nif(h)), run=9),
    _of("eleven_digit", "NATID", rf"{B}\d{{11}}{E}", plain(lambda h: steuer_id(h) or lv_code(h)), run=11),
    _of("lv_dashed", "NATID", rf"{B}\d{{6}}-\d{{5}}{E}", plain(lv_code), run=6, sign="-"),
    _of("cn_id", "NATID", rf"{B}\d{{17}}[0-9Xx]{E}", plain(cn_id), run=17),
    _of("vat_it_bare", "TAXID", rf"{B}\d{{11}}{E}", plain(luhn), run=11),
    _of("vat_it", "TAXID", rf"{B}[Ii][Tt]\d{{11}}{E}", plain(luhn, 11), run=11),
    _of("vat_de", "TAXID", rf"{B}[Dd][Ee]\d{{9}}{E}", plain(mod_11_10, 9), run=9),
    _of("vat_gb", "TAXID", rf"{B}[Gg][Bb]\d{{9}}{E}", plain(gb_vat, 9), run=9),
    _of("vat_pt", "TAXID", rf"{B}[Pp][Tt]\d{{9}}{E}", plain(nif, 9), run=9),
    _of("vat_nl", "TAXID", rf"{B}[Nn][Ll]\d{{9}}[Bb]\d{{2}}{E}", verified=lambda h: h.isascii() and bsn(h[2:11]), run=9),
]
FORMS = {
    "trunk": rf"{B}0\d{{1,4}}{PHONE_GAP}\d{{3,4}}{PHONE_GAP}\d{{3,4}}{E}|{B}0\d{{1,4}}{PHONE_GAP}\d{{4,8}}{E}|{B}0\d{{6,11}}{E}",
    "trunk_pairs": rf"{B}0\d(?:{PHONE_GAP}\d{{2}}){{4}}{E}",
    "groups": rf"{B}[1-9]\d{{1,2}}(?:{PHONE_GAP}\d{{2,4}}){{1,3}}{E}",
    "long_block": rf"{B}[1-9]\d{{2}}{PHONE_GAP}\d{{6,8}}{E}",
}
SECRET = re.compile(rf"{B}(?:sk-[A-Za-z0-9_-]{{5,}}[A-Za-z0-9_]{E}|AKIA[0-9A-Z]{{16}}{E})")
NAMES = ["secret", "iban", "card", "phone_cc", "email", *[r.name for r in NUMERIC[3:]]]
DOMESTIC = [f"phone_{f}" for f in FORMS]
_local = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_domain, _top, _word = re.compile("[A-Za-z0-9.-]+"), re.compile(r"\.[A-Za-z]{2,}"), re.compile(r"\w*")
_decimal: np.ndarray | None = None  # by code point, made when a worker first needs it
AROUND = 8  # characters that a numeric pattern may need before its first digit, and between two digits of a number


def domestic(locales: list[str] | None = None) -> list[Recogniser]:
    """Recognisers of domestic phone numbers, one per form that a chosen region uses."""
    chosen, out = phones.regions(locales), []
    for form, pattern in FORMS.items():
        own = [r for r in phones.FAMILIES[form] if r in chosen]

        def check(h, budget, own=own):
            for r in own:
                budget.spend("PHONE")
                if phones.national(r, h):
                    return True
            return False

        if own:
            out.append(_of(f"phone_{form}", "PHONE", pattern, check, shrink=form in ("groups", "long_block")))
    return out


def emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        local = text[last:at]
        start = at - len(local) + len(local.rstrip(_local))
        m = _domain.match(text, at + 1) if start < at else None
        tops = [t for t in _top.finditer(m[0]) if t.start()] if m else []
        last = at + 1
        if tops:
            last = at + 1 + tops[-1].end()
            yield start, last
        at = text.find("@", last)


def digit_runs(text: str) -> list[tuple[int, int]]:
    """Where decimal digits of any script stand in a row: [start, end) of each run."""
    global _decimal
    if _decimal is None:
        _decimal = np.fromiter((chr(i).isdecimal() for i in range(0x110000)), dtype=bool, count=0x110000)
    inside = np.zeros(len(text) + 2, dtype=np.int8)
    inside[1:-1] = _decimal[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    edge = np.flatnonzero(inside[1:] != inside[:-1]).tolist()
    return list(zip(edge[::2], edge[1::2]))


def areas(text: str, reach: int, runs: list[tuple[int, int]] | None = None):
    """Stretches around digits, up to `reach` characters (what a pattern may take at most) after the last one and then to
    the end of a word, so that no match ends before the pattern does."""
    first = end = None
    for start, stop in digit_runs(text) if runs is None else runs:
        if first is None:
            first = start
        elif start - end > AROUND + reach:
            yield max(0, first - AROUND), _word.match(text, min(len(text), end + reach)).end()
            first = start
        end = stop
    if first is not None:
        yield max(0, first - AROUND), _word.match(text, min(len(text), end + reach)).end()


def _shrunk(r: Recogniser, text: str, start: int, end: int, passes) -> int | None:
    while True:
        cut = [m.start() for m in SEPARATOR.finditer(text, start, end)]
        if not cut or cut[-1] == start:
            return None
        end = cut[-1]
        prefix = text[start:end]
        m = r.pattern.match(prefix)
        if m and m.end() == len(prefix) and passes(prefix):
            return end


def spans_of(r: Recogniser, text: str, where: list[tuple[int, int]], budget: Budget):
    """Disjoint spans of one numeric recogniser."""
    known: dict[str, bool] = {}

    def passes(h: str) -> bool:
        if h not in known:
            budget.check()
            known[h] = r.check(h, budget)
        return known[h]

    runs: list[list[int]] = []
    for at, stop in where:
        while m := r.pattern.search(text, at, stop):
            start, end = m.span()
            if r.check and not passes(m[0]):
                end = _shrunk(r, text, start, end, passes) if r.shrink else None
            if end is not None:
                if runs and start < runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], end)
                else:
                    runs.append([start, end])
            at = start + 1
    return runs


def scan(text: str, names: list[str] | None = None, locales: list[str] | None = None, budget: Budget | None = None, extra: list[Recogniser] | None = None):
    """Raw spans (kind, start, end, text, verified). names: recognisers, all without domestic phones by default."""
    budget = budget or Budget()
    chosen = None if names is None else set(names)
    want = lambda n: chosen is None or n in chosen
    out = []
    if want("secret") and ("sk-" in text or "AKIA" in text):
        out += [("SECRET", *m.span(), m[0], True) for m in SECRET.finditer(text)]
    if want("email"):
        out += [("EMAIL", s, e, text[s:e], True) for s, e in emails(text)]
    runs = digit_runs(text)
    longest = max((end - start for start, end in runs), default=0)
    if longest:
        where: dict[int, list] = {}
        for r in [*[r for r in NUMERIC if want(r.name)], *(extra if extra is not None else domestic(locales) if locales is not None or chosen and chosen & set(DOMESTIC) else [])]:
            if chosen is not None and r.name.startswith("phone_") and r.name not in chosen:
                continue
            if r.run > longest or r.sign not in text:
                continue
            if r.reach not in where:
                where[r.reach] = list(areas(text, r.reach, runs))
            for s, e in spans_of(r, text, where[r.reach], budget):
                h = text[s:e]
                out.append((r.kind, s, e, h, r.verified is None or r.verified(h)))
    budget.check()
    return out


def union(found: list[tuple]) -> list[tuple]:
    """Overlapping spans as one, named by an e-mail that equals it, else by rank, length and first start; a union is
    verified only if the naming span equals it. Spans that only touch stay apart."""
    out, group = [], []

    def close():
        start, end = min(s[1] for s in group), max(s[2] for s in group)
        mail = [s for s in group if s[0] == "EMAIL" and (s[1], s[2]) == (start, end)]
        best = mail[0] if mail else max(group, key=lambda s: (PRIORITY.get(s[0], 0), s[2] - s[1], -s[1], s[0]))
        out.append((best[0], start, end, bool(best[4] and (best[1], best[2]) == (start, end))))

    high = -1
    for s in sorted(found, key=lambda s: (s[1], -s[2])):
        if group and s[1] >= high:
            close()
            group = []
        high = s[2] if not group else max(high, s[2])
        group.append(s)
    if group:
        close()
    return out


def is_token(text: str) -> bool:
    m = TOKEN.fullmatch(text.strip())
    return bool(m) and m[1].upper() in PRIORITY


class Vault:
    """One request's placeholders. Numbers that a text already uses in a token of its own are not given out."""

    def __init__(self, texts: list[str] = ()):
        self.original: dict[str, str] = {}
        self.token: dict[str, str] = {}
        self.taken = {f"[{m[1].upper()}_{m[2]}]" for t in texts if "[" in t for m in TOKEN.finditer(t)}
        self.last: dict[str, int] = {}

    def put(self, kind: str, text: str) -> str:
        if text not in self.token:
            n = self.last.get(kind, 0) + 1
            while f"[{kind}_{n}]" in self.taken:
                n += 1
            self.last[kind] = n
            self.token[text] = f"[{kind}_{n}]"
            self.original[self.token[text]] = text
        return self.token[text]


def mask(text: str, vault: Vault, budget: Budget, names=None, locales=None, extra=None, passes: int = PASSES) -> str:
    """Masks until nothing more is found; what is still found after `passes` blocks the request."""
    extra = domestic(locales) if extra is None and locales is not None else extra
    return mask_by(lambda _, t: union(scan(t, names, locales, budget, extra)), text, vault, passes)


def mask_by(find: Callable[[int, str], list[tuple]], text: str, vault: Vault, passes: int = PASSES) -> str:
    """As mask(), with find(pass, text) giving the disjoint spans (kind, start, end, ...) in order."""
    for k in range(passes + 1):
        spans = [s for s in find(k, text) if not is_token(text[s[1] : s[2]])]
        if not spans:
            return text
        if k == passes:
            raise Blocked(f"not masked in {passes} passes: " + ", ".join(f"{kind} {sum(s[0] == kind for s in spans)}" for kind in sorted({s[0] for s in spans})))
        parts, at = [], 0
        for kind, start, end, *_ in spans:
            parts += [text[at:start], vault.put(kind, text[start:end])]
            at = end
        text = "".join(parts) + text[at:]
    return text
