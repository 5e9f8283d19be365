"""Operator 3: format-preserving Feistel pseudonyms (DataFrame functions only).

Candidates are found by patterns, validated by what their kind demands, and
replaced by a keyed permutation of the same format: equal values get equal
pseudonyms in every document under the same key, different values different
ones, and the key holder can invert them.

* Digit strings of length n are split in halves; each round adds a keyed hash
  of one half to the other modulo a power of ten, over an even number of rounds.
* Results that are not valid values of the kind are permuted again until they
  are (cycle walking), so the permutation stays within the valid values.
* Dates (year, month, day or day, month, year, else month, day, year; between -,
  / or .) are numbered by days; the day number is permuted within the range of
  years.  A month or day written with one digit gets one digit again.
* IBANs are found by the layout of each country's account number (``IBANS``);
  digits and letters move within their alphabet and the check digits are made anew.
* Card numbers keep length and separators and get the check digit that makes
  their Luhn sum what it was; addresses of four numbers keep four numbers from
  0 to 255; phone numbers keep their country code and layout; the local part of
  an e-mail address keeps its letters' and digits' places, and hexadecimal
  secrets length and case (Feistel rounds on characters).

Cases
-----
* null text: null; empty text and texts without candidates: unchanged.
* candidates that fail their validation (a date such as 2021-02-30, 300.1.2.3)
  are left as they are.  A card number inside a candidate that is no IBAN is
  still replaced, by one that does not make the candidate an IBAN.
* a date valid as day/month and as month/day is taken as day/month.
* ties: where two patterns begin at the same place the longer kind in ``KINDS``
  order wins; candidates never overlap.
* repeated rows and null ids: every row is treated by itself, with equal results.
* empty table: empty; extra columns are ignored by ``pseudonymise`` and returned
  by ``cleaned``.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescan.llm import common

KEY = "lurescan-demo-key"
ROUNDS = 8
#: Longest cycle walk; half or more of all values are valid, so a walk of 40 misses with 1e-12.
WALK = 40

#: Longest walk of dates; a seventh of the numbers is valid for the rarest form, so it misses with 1e-13.
DATE_WALK = 200

#: Layout of the account number by country: n digits, a letters, c either.
IBANS = {
    "AD": "8n12c", "AE": "19n", "AL": "8n16c", "AT": "16n", "AZ": "4a20c", "BA": "16n", "BE": "12n", "BG": "4a6n8c",
    "BH": "4a14c", "BI": "23n", "BR": "23n1a1c", "BY": "4c4n16c", "CH": "5n12c", "CR": "18n", "CY": "8n16c",
    "CZ": "20n", "DE": "18n", "DJ": "23n", "DK": "14n", "DO": "4c20n", "EE": "16n", "EG": "25n", "ES": "20n",
    "FI": "14n", "FK": "2a12n", "FO": "14n", "FR": "10n11c2n", "GB": "4a14n", "GE": "2a16n", "GI": "4a15c",
    "GL": "14n", "GR": "7n16c", "GT": "24c", "HN": "4a20n", "HR": "17n", "HU": "24n", "IE": "4a14n", "IL": "19n",
    "IQ": "4a15n", "IS": "22n", "IT": "1a10n12c", "JO": "4a4n18c", "KW": "4a22c", "KZ": "3n13c", "LB": "4n20c",
    "LC": "4a24c", "LI": "5n12c", "LT": "16n", "LU": "3n13c", "LV": "4a13c", "LY": "21n", "MC": "10n11c2n",
    "MD": "20c", "ME": "18n", "MK": "3n10c2n", "MN": "16n", "MR": "23n", "MT": "4a5n18c", "MU": "4a19n3a",
    "NI": "4a20n", "NL": "4a10n", "NO": "11n", "OM": "3n16c", "PK": "4a16c", "PL": "24n", "PS": "4a21c", "PT": "21n",
    "QA": "4a21c", "RO": "4a16c", "RS": "18n", "RU": "14n15c", "SA": "2n18c", "SC": "4a20n3a", "SD": "14n",
    "SE": "20n", "SI": "15n", "SK": "20n", "SM": "1a10n12c", "SO": "19n", "ST": "21n", "SV": "4a20n", "TL": "19n",
    "TN": "20n", "TR": "6n16c", "UA": "6n19c", "VA": "18n", "VG": "4a16n", "XK": "16n", "YE": "4a4n18c",
}


def _iban_pattern() -> str:
    """One alternative a layout, in groups of four; then digits of any length after an unlisted country."""
    countries: dict[str, list[str]] = {}
    for country, layout in IBANS.items():
        countries.setdefault(layout, []).append(country)
    ways = []
    for layout, names in countries.items():
        kinds = "".join(k * int(n) for n, k in re.findall("([0-9]+)([nac])", layout))
        places = [{"n": "[0-9]", "a": "[A-Z]", "c": "[0-9A-Z]"}[k] for k in kinds]
        groups = ["".join(f"{p}{{{len(list(g))}}}" for p, g in itertools.groupby(places[i:i + 4])) for i in range(0, len(places), 4)]
        ways.append(f"(?:{'|'.join(names)})[0-9]{{2}}" + "".join(f" ?{g}" for g in groups) + "(?![0-9A-Za-z])")
    ways.append("[A-Z]{2}[0-9]{2}(?: ?[0-9]{4}){3,7}(?: ?[0-9]{1,3})?(?![0-9A-Za-z])")
    return rf"(?<![0-9A-Za-z])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(ways)})"


#: What may not follow a date; the time of day after a T may.
_END = "(?!(?!T[0-9]{2}:)[0-9A-Za-z])"

#: Patterns in order of precedence (Java syntax).
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "iban": _iban_pattern(),
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?[ -]?[0-9]{3,4}[ -]?[0-9]{3,4}(?![0-9A-Za-z])",
    "local_phone": r"(?<![0-9A-Za-z+)-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "ssn": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "address": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "date": rf"(?<![0-9A-Za-z-])[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}(?!-){_END}|(?<![0-9A-Za-z/])[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}(?!/){_END}"
            rf"|(?<![0-9A-Za-z.])[0-9]{{4}}\.[0-9]{{1,2}}\.[0-9]{{1,2}}(?!\.[0-9]){_END}",
    "dmy": rf"(?<![0-9A-Za-z/])[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}(?!/){_END}|(?<![0-9A-Za-z-])[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}(?!-){_END}"
           rf"|(?<![0-9A-Za-z.])[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}}(?!\.[0-9]){_END}",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
FIRST_DAY, LAST_DAY = "1900-01-01", "2099-12-31"
DAYS = 73049  # days from FIRST_DAY to LAST_DAY, both included
BIG = "decimal(20,0)"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def number_hash(key: str, *parts: Column) -> Column:
    """60 bits of SHA-256 as a whole number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *parts), 256), 1, 15), 16, 10).cast("long")


def _ten(n: Column) -> Column:
    return F.round(F.pow(F.lit(10.0), n)).cast("long")


def feistel(text: Column, key: str, tweak: Column, inverse: bool = False) -> Column:
    """Keyed permutation of digit strings of up to 36 digits; length 1 too.

    The halves have a = n div 2 and b = n - a digits; even rounds change the
    right half by a hash of the left, odd rounds the left by a hash of the
    right.
    """
    n = F.length(text)
    a = F.floor(n / 2).cast("int")
    start = F.struct(F.coalesce(F.substring(text, F.lit(1), a).try_cast("long"), F.lit(0).cast("long")).alias("l"),
                     F.coalesce(F.substring(text, a + 1, n - a).try_cast("long"), F.lit(0).cast("long")).alias("r"))
    size_l, size_r = _ten(a), _ten(n - a)
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    sign = -1 if inverse else 1

    def one(x, i):
        even = i % 2 == 0
        left = F.pmod(x["l"] + sign * (number_hash(key, tweak, n.cast("string"), i.cast("string"), x["r"].cast("string")) % size_l), size_l)
        right = F.pmod(x["r"] + sign * (number_hash(key, tweak, n.cast("string"), i.cast("string"), x["l"].cast("string")) % size_r), size_r)
        return F.struct(F.when(even, x["l"]).otherwise(left).alias("l"), F.when(even, right).otherwise(x["r"]).alias("r"))

    end = F.aggregate(rounds, start, one, lambda x: F.concat(
        F.when(a > 0, F.lpad(x["l"].cast("string"), a, "0")).otherwise(F.lit("")), F.lpad(x["r"].cast("string"), n - a, "0")))
    return end


def let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def cycle(first: Column, valid, step, steps: int = WALK) -> Column:
    """``step`` again and again until the result is valid."""
    def one(x, _):
        return (F.when(x["done"], x).when(valid(x["v"]), F.struct(x["v"].alias("v"), F.lit(True).alias("done")))
                .otherwise(F.struct(step(x["v"]).alias("v"), F.lit(False).alias("done"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(first.alias("v"), F.lit(False).alias("done")), one, lambda x: x["v"])


def walk(text: Column, valid, key: str, tweak: Column, inverse: bool = False, steps: int = WALK) -> Column:
    """Feistel again and again until the result is valid."""
    return cycle(feistel(text, key, tweak, inverse), valid, lambda v: feistel(v, key, tweak, inverse), steps)


def permute_number(value: Column, size: int, key: str, tweak: Column, inverse: bool = False) -> Column:
    """Keyed permutation of whole numbers below ``size``."""
    n = len(str(size - 1))
    out = walk(F.lpad(value.cast("string"), n, "0"), lambda v: v.cast("long") < size, key, tweak, inverse)
    return out.cast("long")


def put_digits(shape: Column, ds: Column, place: str = "[0-9]") -> Column:
    """Write the digits ``ds`` in the places of the digits of ``shape`` (or of other characters)."""
    chars = F.split(shape, "")
    state = F.aggregate(
        chars, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda x, c: F.when(c.rlike(f"^{place}$"), F.struct(
            F.concat(x["out"], F.substring(ds, x["at"], F.lit(1))).alias("out"), (x["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(x["out"], c).alias("out"), x["at"].alias("at"))),
        lambda x: x["out"])
    return state


def luhn(ds: Column) -> Column:
    """Luhn sum modulo 10 of a digit string."""
    rev = F.split(F.reverse(ds), "")
    return F.aggregate(F.zip_with(rev, F.sequence(F.lit(0), F.length(ds) - 1), lambda c, i: F.when(
        i % 2 == 1, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int"))),
        F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0))) % 10


def _kind(x: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, p in reversed(PATTERNS.items()):
        out = F.when(x.rlike(f"^(?:{p})$"), F.lit(kind)).otherwise(out)
    return out


def _card(x: Column, key: str, inverse: bool) -> Column:
    ds = digits(x)
    body = F.substring(ds, F.lit(1), F.length(ds) - 1)
    new = feistel(body, key, F.lit("card"), inverse)
    # the last digit counts once: it makes up for the change of the others' sum
    rest = F.pmod(luhn(ds) - luhn(F.concat(new, F.lit("0"))), F.lit(10))
    return put_digits(x, F.concat(new, rest.cast("string")))


def _address(x: Column, key: str, inverse: bool) -> Column:
    p = F.split(x, r"\.")
    value = F.aggregate(p, F.lit(0).cast("long"), lambda s, v: s * 256 + v.cast("long"))
    new = permute_number(value, 1 << 32, key, F.lit("address"), inverse)
    return F.concat_ws(".", *[(F.shiftright(new, s).bitwiseAND(F.lit(255).cast("long"))).cast("string") for s in (24, 16, 8, 0)])


def _fields(x: Column, order: str) -> dict[str, Column]:
    """Year, month and day of a date as written, by ``order`` such as "dmy"."""
    parts = F.split(x, "[-/.]")
    return {f: F.get(parts, F.lit(i)) for i, f in enumerate(order)}


def _date_of(x: Column, order: str) -> Column:
    f = _fields(x, order)
    text = F.concat_ws("-", f["y"], F.lpad(f["m"], 2, "0"), F.lpad(f["d"], 2, "0"))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def _valid_day(x: Column, order: str) -> Column:
    return F.coalesce(_date_of(x, order).between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date")), F.lit(False))


def _day(x: Column, order: str, key: str, inverse: bool) -> Column:
    """Another day in the same form; what was month/day does not become a valid day/month."""
    f, first = _fields(x, order), F.lit(FIRST_DAY).cast("date")

    def day(v):
        return F.date_add(first, v.cast("int"))

    def fits(v):
        ok = (v.cast("int") < DAYS) & ((F.length(f["m"]) == 2) | (F.month(day(v)) < 10)) & ((F.length(f["d"]) == 2) | (F.day(day(v)) < 10))
        return ok & (F.day(day(v)) > 12) if order == "mdy" else ok

    n = F.lpad(F.datediff(_date_of(x, order), first).cast("string"), len(str(DAYS - 1)), "0")

    def write(new):
        written = {"y": F.date_format(new, "yyyy")}
        for name, form in (("m", "MM"), ("d", "dd")):
            two = F.date_format(new, form)
            written[name] = F.when(F.length(f[name]) == 1, F.substring(two, 2, 1)).otherwise(two)
        return F.concat(*[written[c] for c in order])

    return put_digits(x, let(day(walk(n, fits, key, F.lit("date"), inverse, DATE_WALK)), write))


#: Alphabets within which a character may be shifted: first code, size.
ALPHABETS = {"letters": (("[a-z]", 97, 26), ("[A-Z]", 65, 26), ("[0-9]", 48, 10))}


def char_feistel(text: Column, key: str, tweak: Column, hexadecimal: bool, inverse: bool) -> Column:
    """Feistel on characters: in turn, one half's characters are shifted by a keyed hash of the other half.

    A character moves within its own alphabet (a-z, A-Z, 0-9, or the sixteen
    hexadecimal digits) and others stay, so the shape of the text is kept.
    """
    n = F.length(text)
    a = F.floor(n / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), a).alias("l"), F.substring(text, a + 1, n - a).alias("r"))
    rounds = F.sequence(F.lit(5), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(5))
    sign = -1 if inverse else 1

    def shift(half, other, i):
        def one(c, k):
            h = sign * number_hash(key, tweak, n.cast("string"), i.cast("string"), k.cast("string"), other)
            if hexadecimal:
                return F.lower(F.hex(F.pmod(F.conv(c, 16, 10).cast("long") + h, F.lit(16))))
            out = c
            for pattern, low, size in ALPHABETS["letters"]:
                out = F.when(c.rlike(f"^{pattern}$"), F.chr(F.lit(low) + F.pmod(F.ascii(c) - low + h, F.lit(size)))).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(half, ""), one), "")

    return F.aggregate(rounds, start, lambda s, i: F.struct(
        F.when(i % 2 == 0, s["l"]).otherwise(shift(s["l"], s["r"], i)).alias("l"),
        F.when(i % 2 == 0, shift(s["r"], s["l"], i)).otherwise(s["r"]).alias("r")), lambda s: F.concat(s["l"], s["r"]))


def _local(x: Column, key: str, inverse: bool) -> Column:
    """The local part of an address, within its shape; the domain stays and is the tweak."""
    local, domain = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(local, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    return F.concat(char_feistel(local, key, F.concat(F.lit("email"), domain, shape), False, inverse), F.lit("@"), domain)


def _secret(x: Column, key: str, inverse: bool) -> Column:
    end = char_feistel(F.lower(x), key, F.lit("secret"), True, inverse)
    return F.when(x.rlike("[A-F]"), F.upper(end)).otherwise(end)


def _iban_rest(country: Column, bban: Column) -> Column:
    """Number modulo 97 of the account with check digits 00; letters count as 10 to 35."""
    text = F.concat(bban, country, F.lit("00"))
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: F.when(
        c.rlike("[A-Z]"), (s * 100 + F.ascii(c) - 55) % 97).otherwise((s * 10 + c.try_cast("int")) % 97))


def _iban_parts(x: Column) -> tuple[Column, Column, Column]:
    """Country, check digits, account."""
    cs = F.regexp_replace(x, "[^0-9A-Z]", "")
    return F.substring(cs, 1, 2), F.substring(cs, 3, 2), F.substring(cs, F.lit(5), F.length(cs))


def _valid_iban(x: Column) -> Column:
    country, check, bban = _iban_parts(x)
    return F.lit(98) - _iban_rest(country, bban) == check.try_cast("int")


def _iban(x: Column, key: str, inverse: bool) -> Column:
    country, _, bban = _iban_parts(x)
    tweak = F.concat(F.lit("iban"), country)
    new = F.when(bban.rlike("[A-Z]"), char_feistel(bban, key, tweak, False, inverse)).otherwise(feistel(bban, key, tweak, inverse))
    check = F.lpad((F.lit(98) - _iban_rest(country, new)).cast("string"), 2, "0")
    return put_digits(x, F.concat(country, check, new), "[0-9A-Z]")


def _card_within(x: Column, key: str, inverse: bool) -> Column:
    """``x``, which is no IBAN, with another card number in the place of its own; it never becomes an IBAN."""
    card = F.regexp_extract(x, PATTERNS["card"], 0)
    at = F.instr(x, card)
    before, after = F.substring(x, F.lit(1), at - 1), F.substring(x, at + F.length(card), F.length(x))
    new = cycle(_card(card, key, inverse), lambda v: ~_valid_iban(F.concat(before, v, after)), lambda v: _card(v, key, inverse))
    return F.concat(before, new, after)


def _phone(x: Column, key: str, inverse: bool) -> Column:
    """The country code (digits before the first separator) stays."""
    head = F.regexp_extract(x, r"^(\+[0-9]{1,3}?)(?:[ (-]|[0-9]{7,}$)", 1)
    rest = F.substring(x, F.length(head) + 1, F.length(x))
    return F.concat(head, put_digits(rest, feistel(digits(rest), key, F.concat(F.lit("phone"), head), inverse)))


def _valid_ssn(ds: Column) -> Column:
    return ~ds.rlike("^(000|666|9)") & ~ds.rlike("^...00") & ~ds.rlike("0000$")


def replace_one(x: Column, key: str, inverse: bool = False, other_numbers: str | None = "card") -> Column:
    """struct(kind, text): the pseudonym of one candidate; kind null if it is none."""
    return let(_kind(x), lambda kind: _replace(x, kind, key, inverse, other_numbers))


def _replace(x: Column, kind: Column, key: str, inverse: bool, other_numbers: str | None) -> Column:
    ds = digits(x)
    octets = F.forall(F.split(x, r"\."), lambda v: (v.cast("int") <= 255) & (v.cast("int").cast("string") == v))
    cases = {
        "email": (F.lit(True), _local(x, key, inverse)),
        "secret": (x.rlike("[0-9]") & x.rlike("[A-Fa-f]"), _secret(x, key, inverse)),
        "iban": (_valid_iban(x), _iban(x, key, inverse)),
        "phone": (F.length(ds).between(8, 15), _phone(x, key, inverse)),
        "local_phone": (F.length(ds) == 10, put_digits(x, feistel(ds, key, F.lit("local_phone"), inverse))),
        "ssn": (_valid_ssn(ds), put_digits(x, walk(ds, _valid_ssn, key, F.lit("ssn"), inverse))),
        "address": (octets, _address(x, key, inverse)),
        "date": (_valid_day(x, "ymd"), _day(x, "ymd", key, inverse)),
        "dmy": (_valid_day(x, "dmy"), _day(x, "dmy", key, inverse)),
        "card": (F.length(ds).between(13, 19) & (luhn(ds) == 0), _card(x, key, inverse)),
    }
    # kinds that a candidate is tried as after it failed its own
    within = F.regexp_extract(x, PATTERNS["card"], 0)
    in_iban = (kind == "iban") & (within != "")
    again = [
        ("mdy", (kind == "dmy") & _valid_day(x, "mdy"), _day(x, "mdy", key, inverse)),
        ("card", in_iban & (luhn(digits(within)) == 0), _card_within(x, key, inverse)),
    ]
    if other_numbers is not None:
        again += [(other_numbers, (kind == "card") & F.length(ds).between(13, 19) & (luhn(ds) != 0), _card(x, key, inverse)),
                  (other_numbers, in_iban & (luhn(digits(within)) != 0), _card_within(x, key, inverse))]
    out = F.struct(F.lit(None).cast("string").alias("kind"), x.alias("text"))
    for name, ok, new in again:
        out = F.when(ok, F.struct(F.lit(name).alias("kind"), new.alias("text"))).otherwise(out)
    for name, (ok, new) in cases.items():
        out = F.when((kind == name) & ok, F.struct(F.lit(name).alias("kind"), new.alias("text"))).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text", inverse: bool = False,
                 other_numbers: str | None = "card") -> DataFrame:
    """id, text with pseudonyms, and the replaced values' kinds, in order.

    Numbers of a card's length that fail its check digit (order numbers, time
    stamps, ISBNs, mistyped cards) are replaced too and reported as
    ``other_numbers``; None leaves them.

    Everything happens within the row: the text is cut at its candidates, each
    candidate is replaced, and the parts are put together again.  Texts with
    neither a digit nor an @ are not searched.
    """
    text = F.col(f"`{text_col}`").cast("string")
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), found.alias("found"))
    rows = rows.withColumn("new", F.transform("found", lambda x: replace_one(x, key, inverse, other_numbers)))
    gaps = F.split("text", ANY, -1)
    parts = F.zip_with(F.array_append(F.transform("new", lambda n: n["text"]), F.lit("")), gaps, lambda n, g: F.concat(g, n))
    out = F.when(F.size("new") > 0, F.array_join(parts, "")).otherwise(F.col("text"))
    kinds = F.filter(F.transform("new", lambda n: n["kind"]), lambda k: k.isNotNull())
    return rows.select(F.col("id").alias(id_col), out.alias(text_col), kinds.alias("kinds"))


def cleaned(docs: DataFrame, key: str = KEY, text_col: str = "text", other_numbers: str | None = "card") -> DataFrame:
    """``docs`` with its text pseudonymised, all columns."""
    whole = common.fresh(docs, "_whole")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole), F.col(f"`{text_col}`").alias("text"))
    done = pseudonymise(rows, key, whole, "text", other_numbers=other_numbers)
    return done.select(*[(F.col("text") if c == text_col else F.col(whole).getField(c)).alias(c) for c in docs.columns])


def query(spark, sf_dir) -> DataFrame:
    out = pseudonymise(common.documents(spark, sf_dir).select("doc_id", "text"), other_numbers="number")
    return out.select("doc_id", "text", F.size("kinds").cast("long").alias("n_replaced"), F.array_join("kinds", ",").alias("kinds"))
