"""Format-preserving pseudonyms of personal data, by Feistel networks.

Each value found is replaced by one of its own format: digits stay digits, separators stay where they are, a card
number still passes its check, an address or a date is still valid. The replacement is a keyed permutation of all
values of that format, so equal values get equal pseudonyms in every document, whatever separators they are written
with, different values stay different, and who holds the key can undo it. Nothing is kept between documents.

The network: a number of n digits in a radix is cut in two; each of ten rounds adds a keyed hash of one half to the
other, modulo that half's range. A range that is no power (days of a calendar) walks the cycle until it is inside.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import ipaddress
import math
import re
import warnings
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
#: Digits permuted as one number.
BLOCK = 2048
#: For tests and examples only; pass a secret of your own.
EXAMPLE_KEY = b"gleaner example key"
KEY_SETTING = "spark.gleaner.pii.key"
KINDS = ("email", "card", "account", "phone", "ip", "secret", "date", "national_id", "iban")
# Names of months.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
OTHER_MONTHS = {
    "de": ("januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"),
    "fr": ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    "es": ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
}
# Names under which many people have their mail; they name no one.
SECOND = frozenset(("co", "com", "org", "net", "ac", "gov", "edu"))
PROVIDERS = frozenset(("example", "gmail", "googlemail", "outlook", "hotmail", "live", "yahoo", "icloud", "aol", "gmx", "web", "t-online", "orange", "free", "laposte", "wanadoo", "telefonica", "proton", "protonmail", "mail"))


def session_key(spark: SparkSession) -> bytes:
    """The key that the session sets, at most 64 bytes of UTF-8; else the example key, with a warning, as anyone can undo that."""
    given = spark.conf.get(KEY_SETTING, None)
    if not given:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with the published example key", stacklevel=2)
    return (given or EXAMPLE_KEY.decode()).encode()[:64]


def _round(key: bytes, tweak: bytes, i: int, value: int, modulus: int) -> int:
    data = tweak + bytes([i]) + value.to_bytes((value.bit_length() + 7) // 8 or 1, "little")
    if modulus >> 256:  # one digest would leave the upper digits of a longer half as they are
        more = range(modulus.bit_length() // 512 + 2)
        digest = b"".join(hashlib.blake2b(j.to_bytes(4, "little") + data, key=key).digest() for j in more)
    else:
        digest = hashlib.blake2b(data, key=key, digest_size=32).digest()
    return int.from_bytes(digest, "little") % modulus


def feistel(value: int, low: int, high: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """Keyed permutation of range(low * high), value = a * high + b with a below low and b below high."""
    a, b = divmod(value, high)
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if i % 2:
            b = (b + sign * _round(key, tweak, i, a, high)) % high
        else:
            a = (a + sign * _round(key, tweak, i, b, low)) % low
    return a * high + b


def permute_digits(digits: str, radix: int, key: bytes, tweak: str, back: bool = False) -> str:
    """Keyed permutation of all strings of as many digits (0-9, then a-z) in the radix."""
    n, names = len(digits), "0123456789abcdefghijklmnopqrstuvwxyz"
    if not n:
        return digits
    if n > BLOCK:  # in blocks, each keyed by the pseudonym of the one before
        parts, last = [], f"{tweak}/{n}"
        for at in range(0, n, BLOCK):
            given = digits[at : at + BLOCK]
            parts.append(permute_digits(given, radix, key, last, back))
            last = f"{tweak}/{n}/{hashlib.blake2b((last + (given if back else parts[-1])).encode(), digest_size=16).hexdigest()}"
        return "".join(parts)
    u = n // 2
    x = feistel(int(digits, radix), radix**u, radix ** (n - u), key, f"{tweak}/{radix}/{n}".encode(), back)
    out = []
    for _ in range(n):
        x, d = divmod(x, radix)
        out.append(names[d])
    return "".join(reversed(out))


def permute_range(x: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """Keyed permutation of range(size), by walking the cycle of a slightly larger one."""
    low = math.isqrt(size) + 1
    high = -(-size // low)
    x = feistel(x, low, high, key, tweak.encode(), back)
    while x >= size:
        x = feistel(x, low, high, key, tweak.encode(), back)
    return x


def luhn(digits: str) -> int:
    """The check digit that belongs behind the digits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _filled(form: str, digits: str) -> str:
    """form with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


#: Years of two digits are those from 1950 to 2049.
_CENTURY = 50


def _moved_day(day: datetime.date, key: bytes, back: bool, fits: Callable[[datetime.date], bool], tweak: str = "date", first: int = FIRST_DAY, last: int = LAST_DAY) -> datetime.date | None:
    """The day's pseudonym among those that fit, by walking the cycle; None outside the years that are permuted."""
    x = day.toordinal() - first
    if not 0 <= x <= last - first:
        return None
    while True:
        x = permute_range(x, last - first + 1, key, tweak, back)
        new = datetime.date.fromordinal(first + x)
        if fits(new):
            return new


def _date(m: re.Match, key: bytes, back: bool) -> str | None:
    """A date in digits: order, separator and the width of each part stay."""
    form = m[0]
    mark = re.search(r"[-/.]", form)[0]
    parts = form.split(mark)
    order = "ymd" if len(parts[0]) == 4 else "mdy" if int(parts[1]) > 12 else "dmy"
    of = dict(zip(order, parts, strict=True))
    short = len(of["y"]) == 2
    year = int(of["y"]) + (1900 if int(of["y"]) >= _CENTURY else 2000) * short
    try:
        day = datetime.date(year, int(of["m"]), int(of["d"]))
    except ValueError:
        return None
    # days after the 12th go to such days, others to others: so what told month from day still does
    late, narrow = int(of["d"]) > 12, {c: len(of[c]) == 1 for c in "md"}
    fits = lambda new: (new.day > 12) == late and (not narrow["d"] or new.day < 10) and (not narrow["m"] or new.month < 10)
    if short:
        new = _moved_day(day, key, back, fits, "date/2", datetime.date(1900 + _CENTURY, 1, 1).toordinal(), datetime.date(1999 + _CENTURY, 12, 31).toordinal())
    else:
        new = _moved_day(day, key, back, fits)
    if new is None:
        return None
    shown = {"y": f"{new.year % 100:02}" if short else f"{new.year:04}", "m": str(new.month) if narrow["m"] else f"{new.month:02}", "d": str(new.day) if narrow["d"] else f"{new.day:02}"}
    return mark.join(shown[c] for c in order)


def _language(name: str, dotted: bool, of: bool) -> str | None:
    """Whose name of a month it is: what stands around it decides, then where it is a name at all."""
    found = [x for x in ("de", "fr", "es") if name.lower() in OTHER_MONTHS[x]]
    if dotted:
        return "de" if "de" in found else found[0] if found else None
    if of:
        return "es" if "es" in found else None
    if name in MONTHS:  # English, and no other language's alone
        return None
    return ("fr" if "fr" in found and not (name == "Mai") else found[0]) if found else None


def _foreign_date(m: re.Match, key: bytes, back: bool) -> str | None:
    """A date with a German, French or Spanish month: language, case, marks and the day's width stay."""
    name, dotted, of = m["month"], m["mark"] == ".", bool(m["of"])
    language = _language(name, dotted, of)
    if language is None:
        return None
    case = str.lower if name.islower() else str.upper if name.isupper() else str.capitalize
    try:
        day = datetime.date(int(m["year"]), OTHER_MONTHS[language].index(name.lower()) + 1, int(m["day"]))
    except ValueError:
        return None
    one, shown = len(m["day"]) == 1, lambda d: case(OTHER_MONTHS[language][d.month - 1])
    new = _moved_day(day, key, back, lambda d: (not one or d.day < 10) and _language(shown(d), dotted, of) == language)
    if new is None:
        return None
    parts = {"day": str(new.day) if one else f"{new.day:02}", "month": shown(new), "year": f"{new.year:04}"}
    at, out = m.start(), []
    for g in ("day", "month", "year"):
        out += [m.string[at : m.start(g)], parts[g]]
        at = m.end(g)
    return "".join([*out, m.string[at : m.end()]])


def _named_date(m: re.Match, key: bytes, back: bool) -> str | None:
    """A date with its month in words: the name stays whole or short, a day of one digit stays such; days of two digits may begin with a zero."""
    short = len(m["month"]) == 3 and m["month"] != "May"  # May is both, so it stands for the whole names
    try:
        month = next(i for i, name in enumerate(MONTHS, 1) if m["month"] in (name, name[:3]))
        day = datetime.date(int(m["year"]), month, int(m["day"])).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    one, x = len(m["day"]) == 1, day - FIRST_DAY
    while True:
        x = permute_range(x, LAST_DAY - FIRST_DAY + 1, key, "date", back)
        new = datetime.date.fromordinal(FIRST_DAY + x)
        if (not one or new.day < 10) and not (short and new.month == 5):
            break
    name = MONTHS[new.month - 1]
    parts = {"day": str(new.day) if one else f"{new.day:02}", "month": name[:3] if short else name, "year": f"{new.year:04}"}
    at, out = m.start(), []
    for g in sorted(parts, key=m.start):
        out += [m.string[at : m.start(g)], parts[g]]
        at = m.end(g)
    return "".join([*out, m.string[at : m.end()]])


def _ip6(m: re.Match, key: bytes, back: bool) -> str | None:
    """Hexadecimal digits among such digits; colons stay, so it is still an address. Those of fewer than eight digits name no host."""
    try:
        ipaddress.IPv6Address(m[0])
    except ValueError:
        return None
    if len(m[0].replace(":", "")) < 8:
        return None
    new = permute_digits(m[0].replace(":", "").lower(), 16, key, "ip6", back)
    new = iter(new.upper() if m[0].isupper() else new)
    return "".join(c if c == ":" else next(new) for c in m[0])


def _iban(found: str, key: bytes, back: bool) -> str | None:
    """The number that found begins with, replaced: country and layout stay, the account is permuted, and the check digits are those that belong to it."""
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    while True:
        plain = found.replace(" ", "")
        if not 15 <= len(plain) <= 34:
            return None
        if 2 <= int(plain[2:4]) <= 98 and number(plain[4:] + plain[:4]) % 97 == 1:
            break
        found = found.rpartition(" ")[0]  # words in capitals may follow
    account = _letters(plain[4:], key, f"iban/{plain[:2].upper()}", back)
    account = account.lower() if plain.islower() else account.upper()
    new = iter(f"{plain[:2]}{98 - number(account + plain[:2] + '00') % 97:02}{account}")
    return "".join(c if c == " " else next(new) for c in found)


def _ip(m: re.Match, key: bytes, back: bool) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255:
        return None
    x = permute_range(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _number(m: re.Match, key: bytes, back: bool) -> tuple[str, str]:
    form = m[0]
    digits = re.sub(r"\D", "", form)
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", form):
        return "national_id", _filled(form, permute_digits(digits, 10, key, "national_id", back))
    if 13 <= len(digits) <= 19 and "(" not in form and "+" not in form:
        if luhn(digits[:-1]) == int(digits[-1]):
            new = permute_digits(digits[:-1], 10, key, "card", back)
            return "card", _filled(form, new + str(luhn(new)))
        # no card, and none after: of the numbers that fail the check, the failing digit moves with the others
        wrong = (int(digits[-1]) - luhn(digits[:-1])) % 10
        new = permute_digits(digits[:-1], 10, key, f"account/{wrong}", back)
        return "account", _filled(form, new + str((luhn(new) + wrong) % 10))
    if _NATIONAL.fullmatch(form):  # the first digit is what makes it such a number
        return "phone", _filled(form, digits[0] + permute_digits(digits[1:], 10, key, f"phone/{digits[0]}", back))
    plus = form.startswith("+")
    if plus or not form.isdigit():
        stay = max(0, min(3, len(digits) - 10))  # what may be a country's code
        return "phone", _filled(form, digits[:stay] + permute_digits(digits[stay:], 10, key, "phone", back))
    return "account", _filled(form, permute_digits(digits, 10, key, "account", back))


def _letters(text: str, key: bytes, tweak: str, back: bool) -> str:
    """Digits among digits, ASCII letters among letters, case and everything else in place."""
    digits = "".join(c for c in text if c.isascii() and c.isdigit())
    letters = "".join(c.lower() for c in text if c.isascii() and c.isalpha())
    code = "".join("0123456789abcdefghijklmnop"[ord(c) - 97] for c in letters)
    moved = permute_digits(code, 26, key, tweak, back) if code else ""
    new_digits = iter(permute_digits(digits, 10, key, tweak, back))
    new_letters = iter(chr("0123456789abcdefghijklmnop".index(c) + 97) for c in moved)
    out = []
    for c in text:
        if c.isascii() and c.isdigit():
            out.append(next(new_digits))
        elif c.isascii() and c.isalpha():
            x = next(new_letters)
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def _mixed(text: str, key: bytes, tweak: str, back: bool) -> str:
    """ASCII letters and digits permuted together, as one number whose digits are of two radices: texts that differ in one place differ in all."""
    places = [i for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    if not places or len(places) > 256:
        return _letters(text, key, tweak, back)
    radices = [10 if text[i].isdigit() else 26 for i in places]
    x = 0
    for i, r in zip(places, radices, strict=True):
        x = x * r + (int(text[i]) if r == 10 else ord(text[i].lower()) - 97)
    x = permute_range(x, math.prod(radices), key, f"{tweak}/{''.join('d' if r == 10 else 'l' for r in radices)}", back)
    out = list(text)
    for i, r in zip(reversed(places), reversed(radices), strict=True):
        x, d = divmod(x, r)
        out[i] = str(d) if r == 10 else chr(97 + d).upper() if text[i].isupper() else chr(97 + d)
    return "".join(out)


_EMAIL = re.compile(r"(?<![\w.+-])([\w.+-]++)@((?:[\w-]++\.)+[A-Za-z]{2,})")
_HEX = re.compile(r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])")
_NAMED = re.compile(r"""(?i)\b(token|secret|password|passwd|passwort|kennwort|pwd|contraseña|mot de passe|mdp|api[_-]?key|access[_-]?key)(["']?\s{0,3}[=:]\s{0,3}["']?)([A-Za-z0-9_/+.-]{8,}+)""")
_BEARER = re.compile(r"(?i)\bbearer\s{1,3}(?=[^\s0-9]{0,200}[0-9])([A-Za-z0-9_/+.=~-]{16,}+)")
_KEYED = re.compile(r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk[-_](?:live_|test_)?[0-9A-Za-z]{20,})(?![0-9A-Za-z])")
_IP = re.compile(r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d.]*\d)")
_DATE = re.compile(
    r"(?<![\d/.-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4}|\d{1,2}/\d{1,2}/\d{2}|\d{2}([.-])\d{2}\3\d{2})(?![\d/-]|\.\d)"
)
_MONTH = "|".join((*MONTHS, *(x[:3] for x in MONTHS)))
_DAY_FIRST = re.compile(rf"(?<![\w/.-])(?P<day>[0-9]{{1,2}}) (?P<month>{_MONTH}),? (?P<year>[0-9]{{4}})(?![\w/-])")
_MONTH_FIRST = re.compile(rf"(?<!\w)(?P<month>{_MONTH}) (?P<day>[0-9]{{1,2}}),? (?P<year>[0-9]{{4}})(?![\w/-])")
_OTHER = "|".join(sorted({x for names in OTHER_MONTHS.values() for x in names}, key=len, reverse=True))
_FOREIGN = re.compile(rf"(?i)(?<![\w/.-])(?P<day>[0-9]{{1,2}})(?P<mark>\.|er|º)? (?P<of>de )?(?P<month>{_OTHER})(?: del?)? (?P<year>[0-9]{{4}})(?![\w/-])")
# in small letters those alone whose accounts are digits: words may follow
_IBAN = re.compile(r"(?<![0-9A-Za-z])(?:[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30}|[a-z]{2}[0-9]{2}(?: ?[0-9]{4}){3,7}(?: ?[0-9]{1,3})?)(?![0-9A-Za-z])")
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){2,7}|[0-9A-F]{0,4}(?::[0-9A-F]{0,4}){2,7})(?![0-9A-Za-z:])")
#: German (0171 2345678, 089/123456), French (01 23 45 67 89) and Spanish (612 345 678, 91 123 45 67) numbers as they are dialled at home.
_HOME = r"0\d{2,4}[ /-]\d{5,8}|0\d(?:[ .]\d{2}){4}|[679]\d{2}(?:[ .-]\d{3}){2}|9\d[ .]\d{3}(?:[ .]\d{2}){2}"
_NATIONAL = re.compile(_HOME)
_SOCIAL = re.compile(r"(?i)\b(?:ssn|social security(?: (?:number|no\.?))?)[:# ]{1,3}([0-9]{3} [0-9]{2} [0-9]{4})(?!\d)")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(
    r"(?<![\w.])(?:"
    r"\d{3}-\d{2}-\d{4}|\d{13,}+|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}"  # national ids, cards, accounts
    r"|(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}|\+\d{1,3}[ .-]\d(?:[ .-]\d{2}){4}|\d{3}[ .-]\d{3}[ .-]\d{4}"  # phones
    rf"|{_HOME}"
    r"|\d{9,12})(?!\w|[.-]\d)"
)


@lru_cache(maxsize=1 << 14)
def _secret(value: str, key: bytes, back: bool) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        new = permute_digits(value.lower(), 16, key, "hex", back)
        return new.upper() if value.isupper() else new
    return _letters(value, key, "secret", back)


def pseudonyms(text: str, key: bytes = EXAMPLE_KEY, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with its personal data replaced, and how many values of each kind there were; back undoes it.

    Patterns go from the most to the least specific, all over the text as given; what one has taken no later one touches.
    """
    found, starts, spans = dict.fromkeys(KINDS, 0), [], []

    def take(kind: str, start: int, end: int, new: str | None) -> None:
        i = bisect.bisect_left(starts, start)
        if new is None or i < len(spans) and spans[i][0] < end or i and spans[i - 1][1] > start:
            return
        starts.insert(i, start)
        spans.insert(i, (start, end, new))
        found[kind] += 1

    if "@" in text:
        for m in _EMAIL.finditer(text):
            take("email", *m.span(), f"{_mixed(m[1], key, 'email', back)}@{_domain(m[2], key, back)}")
    for m in _NAMED.finditer(text):
        take("secret", *m.span(3), _secret(m[3], key, back))
    for m in _BEARER.finditer(text):
        take("secret", *m.span(1), _secret(m[1], key, back))
    for m in _KEYED.finditer(text):
        take("secret", *m.span(), m[0][:4] + _letters(m[0][4:], key, "secret", back))
    if _DIGIT.search(text):
        for m in _HEX.finditer(text):
            take("secret", *m.span(), _secret(m[0], key, back))
        for m in _IBAN.finditer(text):
            new = _iban(m[0], key, back)
            take("iban", m.start(), m.start() + len(new or ""), new)
        for m in _IP6.finditer(text) if ":" in text else ():
            take("ip", *m.span(), _ip6(m, key, back))
        for m in _IP.finditer(text):
            take("ip", *m.span(), _ip(m, key, back))
        for m in _DATE.finditer(text):
            take("date", *m.span(), _date(m, key, back))
        for pattern in (_DAY_FIRST, _MONTH_FIRST):
            for m in pattern.finditer(text):
                take("date", *m.span(), _named_date(m, key, back))
        for m in _FOREIGN.finditer(text):
            take("date", *m.span(), _foreign_date(m, key, back))
        for m in _SOCIAL.finditer(text):
            take("national_id", *m.span(1), _filled(m[1], permute_digits(m[1].replace(" ", ""), 10, key, "national_id", back)))
        for m in _DIGITS.finditer(text):
            kind, new = _number(m, key, back)
            take(kind, *m.span(), new)
    at, out = 0, []
    for start, end, new in spans:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), found


def _domain(name: str, key: bytes, back: bool) -> str:
    """Labels are permuted, but for the last and for names that very many people have their mail under, with the second-level labels (co.uk) before them."""
    labels = name.split(".")
    own = len(labels) - 1 - (len(labels) > 2 and labels[-2].lower() in SECOND)

    def moved(label: str) -> str:
        if label.lower() in PROVIDERS or label.lower() in SECOND:
            return label
        while True:  # what is no such name stays none
            label = _letters(label, key, "host", back)
            if label.lower() not in PROVIDERS and label.lower() not in SECOND:
                return label

    return ".".join([*map(moved, labels[:own]), *labels[own:]])


def pseudonymise(docs: DataFrame, key: bytes = EXAMPLE_KEY, back: bool = False) -> DataFrame:
    """The rows of docs with their personal data replaced in text, and a long column n_<kind> for each kind.

    docs: doc_id, text and any other columns, which stay as they are, but for n_chars, where there is one, set to the
    new text's length. A null text stays null and counts nothing; an empty table gives no rows; repeated rows
    get equal texts; columns that are named like the counts are replaced by them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType

    counts = [f"n_{k}" for k in KINDS]
    kept = [f for f in docs.schema if f.name not in counts]
    schema = StructType([*kept, *(StructField(c, LongType()) for c in counts)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            texts, numbers = [], [[] for _ in KINDS]
            for value in batch.column("text"):
                text, found = pseudonyms(t, key, back) if (t := value.as_py()) is not None else (None, dict.fromkeys(KINDS, 0))
                texts.append(text)
                for n, k in zip(numbers, KINDS, strict=True):
                    n.append(found[k])
            columns = {f.name: batch.column(f.name) for f in kept} | dict(zip(counts, map(pa.array, numbers), strict=True))
            columns["text"] = pa.array(texts, arrow.field("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], arrow.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) or columns[f.name].type != f.type else columns[f.name] for f in arrow], schema=arrow)

    return docs.select(*[F.col(f.name) for f in kept]).mapInArrow(run, schema)
