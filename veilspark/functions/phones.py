"""Numbering plans: which digits can be a telephone number, by region and by country code.

The plans are rules on the national number (without the trunk 0, except in Italy, where it belongs to the number).
"""

from __future__ import annotations

import re

#: Patterns of national numbers.
PLANS = {
    "de": r"1(?:5\d{9}|6[0-3]\d{7,8}|7\d{8,9})|[2-9]\d{5,10}",
    "es": r"[67][0-9]\d{7}|[89][1-8]\d{7}",
    "fr": r"[1-9]\d{8}",
    "gb": r"1\d{8,9}|2[0-9]\d{8}|3[0347]\d{8}|7[1-57-9]\d{8}|8(?:00\d{6,7}|[47]\d{8})",
    "it": r"0\d{5,10}|3\d{8,9}",
    "lv": r"[268]\d{7}",
    "nl": r"[1-57]\d{8}|6[1-58]\d{7}|8[58]\d{7}",
    "pt": r"2[1-9]\d{7}|9[1-36]\d{7}|[378]\d{8}",
    "cn": r"1[3-9]\d{9}|(?:10|2\d)\d{8}|[3-9]\d{2}\d{7,8}",
}
#: Country codes of the regions, and which other codes are assigned (three digits unless listed as two).
CODES = {"49": "de", "34": "es", "33": "fr", "44": "gb", "39": "it", "371": "lv", "31": "nl", "351": "pt", "86": "cn"}
TWO = re.compile(r"2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]")
THREE = re.compile(r"2[1-69]|3[578]|42|50|59|6[7-9]|80|85|87|88|9[679]")
#: Regions of each family of domestic forms.
FAMILIES = {
    "trunk": ("de", "fr", "gb", "it", "nl", "cn"),
    "trunk_pairs": ("fr",),
    "groups": ("es", "it", "lv", "pt", "cn"),
    "long_block": ("it",),
}
REGIONS = tuple(PLANS)
_plans = {k: re.compile(v) for k, v in PLANS.items()}
_north_america = re.compile(r"[2-9]\d{2}[2-9]\d{6}")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def regions(locales: list[str] | None) -> tuple[str, ...]:
    """The regions that locales name; all without a list. Chinese may be named by its language; unknown ones count for none."""
    if locales is None:
        return REGIONS
    named = {{"zh": "cn"}.get(x.strip().lower(), x.strip().lower()) for x in locales}
    return tuple(r for r in REGIONS if r in named)


def national(region: str, text: str) -> bool:
    """Whether the digits of a number as written inside a region follow its plan."""
    d = digits(text)
    if d.startswith("0") and region in ("es", "lv", "pt"):
        return False
    if d.startswith("0") and region != "it":
        d = d[1:]
    return bool(_plans[region].fullmatch(d))


def international(text: str) -> bool:
    """Whether +digits is a number: an assigned country code, and that country's plan where it is known."""
    d = digits(text)
    if not 8 <= len(d) <= 15:
        return False
    for n in (2, 3):
        if d[:n] in CODES:
            region, rest = CODES[d[:n]], d[n:]
            if rest.startswith("0") and region != "it":
                rest = rest[1:]  # the bracketed trunk zero
            return bool(_plans[region].fullmatch(rest))
    if d[0] == "1":
        return bool(_north_america.fullmatch(d[1:]))
    return d[0] == "7" and len(d) == 11 or bool(TWO.match(d) or (THREE.match(d) and len(d) >= 9))
