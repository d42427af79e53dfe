"""Checksum and range rules as SQL over a string column: usable in any DataFrame or SQL expression, evaluated in the JVM.

Each function returns a boolean SQL expression on `h`. Expressions without a fold are plain arithmetic that other SQL
engines read as well.
"""

from __future__ import annotations


def digit(h: str, i: int) -> str:
    return f"cast(substr({h}, {i}, 1) AS int)"


def weighted(h: str, weights: list[int], start: int = 1) -> str:
    return "(" + " + ".join(f"{digit(h, start + k)} * ({w})" for k, w in enumerate(weights)) + ")"


def bsn(h: str) -> str:
    s = weighted(h, [9, 8, 7, 6, 5, 4, 3, 2, -1])
    return f"({s} <> 0 AND {s} % 11 = 0)"


def nif(h: str) -> str:
    r = f"({weighted(h, [9, 8, 7, 6, 5, 4, 3, 2])} % 11)"
    return f"({digit(h, 9)} = CASE WHEN {r} < 2 THEN 0 ELSE 11 - {r} END)"


def nine_digit_id(h: str) -> str:
    return f"({bsn(h)} OR {nif(h)})"


def lv_code(h: str) -> str:
    s = weighted(h, [1, 6, 3, 7, 9, 10, 5, 8, 4, 2])
    return f"(substr({h}, 1, 2) = '32' OR (((1 - {s}) % 11 + 11) % 11) % 10 = {digit(h, 11)})"


def piva(h: str) -> str:
    """Italian VAT number: doubled digits at even places, 9 taken off above 9."""
    terms = [digit(h, i) if i % 2 else f"CASE WHEN {digit(h, i)} > 4 THEN 2 * {digit(h, i)} - 9 ELSE 2 * {digit(h, i)} END" for i in range(1, 11)]
    return f"((10 - ({' + '.join(terms)}) % 10) % 10 = {digit(h, 11)})"


def gb_vat(h: str) -> str:
    s = weighted(h, [8, 7, 6, 5, 4, 3, 2])
    pair = f"(10 * {digit(h, 8)} + {digit(h, 9)})"
    return f"(({s} + {pair}) % 97 = 0 OR ({s} + {pair} + 55) % 97 = 0)"


def cn_id(h: str) -> str:
    s = weighted(h, [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2])
    return f"(upper(substr({h}, 18, 1)) = substr('10X98765432', {s} % 11 + 1, 1))"


def fr_nir(h: str) -> str:
    return f"(97 - cast(substr({h}, 1, 13) AS bigint) % 97 = cast(substr({h}, 14, 2) AS bigint))"


def es_dni(h: str) -> str:
    lead = f"CASE upper(substr({h}, 1, 1)) WHEN 'X' THEN '0' WHEN 'Y' THEN '1' WHEN 'Z' THEN '2' ELSE substr({h}, 1, 1) END"
    return f"(substr('TRWAGMYFPDXBNJZSQVHLCKE', cast(cast(concat({lead}, substr({h}, 2, 7)) AS bigint) % 23 + 1 AS int), 1) = upper(substr({h}, 9, 1)))"


def nino_prefix(h: str) -> str:
    a, b, both = f"upper(substr({h}, 1, 1))", f"upper(substr({h}, 2, 1))", f"upper(substr({h}, 1, 2))"
    return f"({a} NOT IN ('D','F','I','Q','U','V') AND {b} NOT IN ('D','F','I','O','Q','U','V') AND {both} NOT IN ('BG','GB','KN','NK','NT','TN','ZZ'))"


def it_cf(h: str) -> str:
    #: Weights of the odd places for A..Z; the digits 0..9 share those of A..J.
    odd = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]
    place = lambda i: f"(CASE WHEN upper(substr({h},{i},1)) >= 'A' THEN ascii(upper(substr({h},{i},1))) - 65 ELSE ascii(substr({h},{i},1)) - 48 END)"
    table = ",".join(f"{v:02d}" for v in odd)
    terms = [f"cast(substr('{table}', {place(i)} * 3 + 1, 2) AS int)" if i % 2 else place(i) for i in range(1, 16)]
    return f"(({' + '.join(terms)}) % 26 = ascii(upper(substr({h}, 16, 1))) - 65)"


def luhn(h: str) -> str:
    return f"luhn_check(regexp_replace({h}, '[^0-9]', ''))"


def card(h: str) -> str:
    d = f"regexp_replace({h}, '[^0-9]', '')"
    return f"(length({d}) BETWEEN 13 AND 19 AND luhn_check({d}))"


def iso7064_11_10(h: str, n: int) -> str:
    fold = f"aggregate(transform(sequence(1, {n - 1}), i -> cast(substr({h}, i, 1) AS int)), 10, (p, d) -> (CASE WHEN (p + d) % 10 = 0 THEN 10 ELSE (p + d) % 10 END) * 2 % 11)"
    return f"((11 - {fold}) % 10 = {digit(h, n)})"


def de_vat(h: str) -> str:
    return iso7064_11_10(h, 9)


def de_steuerid(h: str) -> str:
    n = f"transform(sequence(0, 9), v -> size(filter(sequence(1, 10), i -> substr({h}, i, 1) = cast(v AS string))))"
    triple = f"exists(sequence(1, 8), i -> substr({h}, i, 1) = substr({h}, i + 1, 1) AND substr({h}, i, 1) = substr({h}, i + 2, 1))"
    return f"(substr({h}, 1, 1) <> '0' AND size(filter({n}, c -> c > 1)) = 1 AND array_max({n}) <= 3 AND NOT {triple} AND {iso7064_11_10(h, 11)})"


def eleven_digit_id(h: str) -> str:
    return f"({de_steuerid(h)} OR {lv_code(h)})"


#: IBAN lengths by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
    "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
}


def iban_mod97(h: str) -> str:
    c = f"upper(regexp_replace({h}, '[^A-Za-z0-9]', ''))"
    return (
        f"(length({c}) >= 4 AND aggregate(split(concat(substr({c}, 5), substr({c}, 1, 4)), ''), 0, (r, x) -> CASE WHEN x = '' THEN r "
        f"WHEN x >= 'A' THEN (r * 100 + ascii(x) - 55) % 97 ELSE (r * 10 + ascii(x) - 48) % 97 END) = 1)"
    )


def iban_length(h: str) -> str:
    c = f"regexp_replace({h}, '[^A-Za-z0-9]', '')"
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in IBAN_LENGTHS.items())
    return f"(CASE upper(substr({c}, 1, 2)) {cases} ELSE length({c}) END = length({c}))"


def iban_gate(h: str) -> str:
    """Upper-case candidates pass by shape; one with a lower-case letter must verify."""
    return f"(NOT rlike({h}, '[a-z]') OR ({iban_mod97(h)} AND {iban_length(h)}))"
