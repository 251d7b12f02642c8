"""Personal data replaced by keyed pseudonyms of the same format.

Card, account, phone, social security and network numbers, mail addresses and dates are found by
pattern and validated. Each value is a number below the count of valid values of its format; a
Feistel network with a keyed round function permutes these numbers. Equal values get equal
pseudonyms in all documents, different values different ones, and the pseudonym is valid too.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date
from hashlib import blake2b
from math import isqrt

from pyspark.sql import DataFrame

from footfall.llm.common import map_texts

ROUNDS = 10
LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
FIRST, LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
MARK = re.compile(r"[0-9@]")
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "phone": r"(?<![0-9+])\+1[\x20.-]?\([0-9]{3}\)[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])|(?<![0-9+])(?:\+1[\x20.-]?)?(?:\([2-9][0-9]{2}\)[\x20.-]?|[2-9][0-9]{2}[\x20.-])[2-9][0-9]{2}[\x20.-][0-9]{4}(?![0-9])|(?<![0-9+])\+1[2-9][0-9]{9}(?![0-9])",
    "abroad": r"(?<![0-9+])\+[2-9][0-9]{0,2}(?:[\x20.-]?\([0-9]{1,4}\))?(?:[\x20.-]?[0-9]{1,12}){1,6}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iso": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "day": r"(?<![0-9./])(?:[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9-])(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9-])",
}
#: The back reference of the card pattern stands for its own group in the joined pattern.
PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()).replace("([\\x20-])", "(?P<gap>[\\x20-])").replace("\\1[0-9]{4}\\1", "(?P=gap)[0-9]{4}(?P=gap)"))
EACH = {k: re.compile(p) for k, p in PATTERNS.items()}


class Feistel:
    """A keyed permutation of the numbers below any n, by unbalanced halves and cycle walking."""

    def __init__(self, key: bytes):
        self.key = blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, n: int, step: int, half: int) -> int:
        return int.from_bytes(blake2b(f"{kind}:{n}:{step}:{half}".encode(), key=self.key, digest_size=16).digest())

    def __call__(self, kind: str, n: int, x: int) -> int:
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(x, b)
            for step in range(0, ROUNDS, 2):
                left = (left + self._round(kind, n, step, right)) % a
                right = (right + self._round(kind, n, step + 1, left)) % b
            x = left * b + right
            if x < n:
                return x


def luhn(digits: str) -> int:
    """The check digit behind these digits."""
    doubled = [int(d) * (2 - i % 2) for i, d in enumerate(reversed(digits))]
    return -sum(d // 10 + d % 10 for d in doubled) % 10


def mixed(feistel: Feistel, kind: str, text: str) -> str:
    """Permute a string within its shape: digits stay digits, letters letters of their case, others stay."""
    sets = [DIGITS if c in DIGITS else LOWER if c in LOWER else LOWER.upper() if c in LOWER.upper() else "" for c in text]
    shape = "".join("9" if s == DIGITS else "a" if s == LOWER else "A" if s else c for s, c in zip(sets, text, strict=True))
    n, x = 1, 0
    for c, s in zip(text, sets, strict=True):
        if s:
            n, x = n * len(s), x * len(s) + s.index(c)
    if n == 1:
        return text
    x = feistel(f"{kind}:{shape}", n, x)
    out = []
    for c, s in zip(reversed(text), reversed(sets), strict=True):
        if s:
            x, at = divmod(x, len(s))
            c = s[at]
        out.append(c)
    return "".join(reversed(out))


def _refill(value: str, digits: str) -> str:
    """The value with its digits replaced in order."""
    fresh = iter(digits)
    return "".join(next(fresh) if c in DIGITS else c for c in value)


def _email(f: Feistel, value: str) -> str | None:
    local, domain = value.split("@")
    host, dot, rest = domain.partition(".")
    return f"{mixed(f, 'local', local)}@{mixed(f, 'host', host)}{dot}{rest}"


def _card(f: Feistel, value: str) -> str | None:
    digits = re.sub("[^0-9]", "", value)
    if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = str(f("card", 9 * 10 ** (len(digits) - 2), int(digits[:-1]) - 10 ** (len(digits) - 2)) + 10 ** (len(digits) - 2)) if digits[0] != "0" else None
    return None if body is None else _refill(value, body + str(luhn(body)))


def _phone(f: Feistel, value: str) -> str | None:
    """Ten digits of the North American plan; a leading 1 stays.

    Area and exchange from 200 to 999 stay in that range, other numbers outside it.
    """
    digits = re.sub("[^0-9]", "", value)
    area, exchange, line = int(digits[-10:-7]) - 200, int(digits[-7:-4]) - 200, int(digits[-4:])
    if min(area, exchange) >= 0:
        x = f("phone", 800 * 800 * 10_000, (area * 800 + exchange) * 10_000 + line)
        made = f"{x // 8_000_000 + 200}{x // 10_000 % 800 + 200}{x % 10_000:04d}"
    else:
        made = digits[-10:]
        while True:
            made = f"{f('phone outside', 10**10, int(made)):010d}"
            if made[0] < "2" or made[3] < "2":
                break
    return _refill(value, digits[:-10] + made)


def _abroad(f: Feistel, value: str) -> str | None:
    """Eight to fifteen digits; the first two, mostly the country's code, stay."""
    digits = re.sub("[^0-9]", "", value)
    return _refill(value, digits[:2] + mixed(f, f"phone {digits[:2]}", digits[2:])) if 8 <= len(digits) <= 15 else None


def _ssn(f: Feistel, value: str) -> str | None:
    area, group, serial = map(int, value.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    x = f("ssn", 898 * 99 * 9999, ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1)
    area = x // (99 * 9999) + 1
    return f"{area + (area >= 666):03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"


def _shifted(f: Feistel, year: str, month: str, day: str) -> tuple[str, str, str] | None:
    try:
        at = date(int(year), int(month), int(day)).toordinal()
    except ValueError:
        return None
    if not FIRST <= at <= LAST:
        return None
    made = date.fromordinal(FIRST + f("date", LAST - FIRST + 1, at - FIRST))
    return f"{made.year:04d}", f"{made.month:02d}", f"{made.day:02d}"


def _iso(f: Feistel, value: str) -> str | None:
    made = _shifted(f, *value.split("-"))
    return made and "-".join(made)


def _day(f: Feistel, value: str) -> str | None:
    """Day, month, year; with slashes also month, day, year where only that is a date."""
    mark = value[2]
    a, b, year = value.split(mark)
    made = _shifted(f, year, b, a)
    if made:
        return mark.join(made[::-1])
    made = _shifted(f, year, a, b) if mark == "/" else None
    return made and mark.join((made[1], made[2], made[0]))


def _ip(f: Feistel, value: str) -> str | None:
    """Four parts up to 255; each keeps its number of digits."""
    parts = value.split(".")
    if any(int(p) > 255 or (p[0] == "0" and len(p) > 1) for p in parts):
        return None
    least = [(0, 10, 100)[len(p) - 1] for p in parts]
    sizes = [(10, 90, 156)[len(p) - 1] for p in parts]
    n, x = 1, 0
    for p, low, size in zip(parts, least, sizes, strict=True):
        n, x = n * size, x * size + int(p) - low
    x = f("ip " + "".join(str(len(p)) for p in parts), n, x)
    made = []
    for low, size in zip(reversed(least), reversed(sizes), strict=True):
        x, at = divmod(x, size)
        made.append(str(low + at))
    return ".".join(reversed(made))


def _iban(f: Feistel, value: str) -> str | None:
    plain = value.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = mixed(f, f"iban {plain[:2]}", plain[4:])
    fresh = iter(f"{plain[:2]}{98 - number(body + plain[:2] + '00') % 97:02d}{body}")
    return "".join(c if c == " " else next(fresh) for c in value)


KINDS: dict[str, Callable[[Feistel, str], str | None]] = {
    "email": _email, "iban": _iban, "phone": _phone, "abroad": _abroad, "ssn": _ssn, "iso": _iso, "day": _day, "ip": _ip, "card": _card,
}
COUNTED = {"email": "n_email", "iban": "n_iban", "phone": "n_phone", "abroad": "n_phone", "ssn": "n_ssn", "iso": "n_date", "day": "n_date", "ip": "n_ip", "card": "n_card"}


class Replacer:
    """Replaces the values of a text; remembers pseudonyms up to a bound."""

    def __init__(self, key: bytes):
        self.feistel = Feistel(key)
        self.known: dict[tuple[str, str], str | None] = {}

    def _made(self, kind: str, value: str) -> str | None:
        if (kind, value) not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[kind, value] = KINDS[kind](self.feistel, value)
        return self.known[kind, value]

    def __call__(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many of each kind.

        Where the first kind that fits is not valid the others are tried at the same place, then
        the search goes on at the next character.
        """
        counts: dict[str, int] = {}
        if not MARK.search(text):
            return text, counts
        out, done, at = [], 0, 0
        while match := PATTERN.search(text, at):
            start = match.start()
            for kind, pattern in EACH.items():
                m = pattern.match(text, start)
                made = m and self._made(kind, m[0])
                if made:
                    out += [text[done:start], made]
                    done = at = m.end()
                    counts[COUNTED[kind]] = counts.get(COUNTED[kind], 0) + 1
                    break
            else:
                at = start + 1
        return "".join(out) + text[done:], counts


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """Replace the text column by the same texts with pseudonyms, and add one count per kind.

    Whole texts are searched. Null texts become empty, texts without personal data stay as they
    are, and every row stays, repeated or not. Columns named like the counts are replaced.
    """
    names = list(dict.fromkeys(COUNTED.values()))
    column = text

    def make():
        replacer = Replacer(key)

        def work(texts: list[str]) -> dict[str, object]:
            made = [replacer(t) for t in texts]
            return {column: [t for t, _ in made]} | {n: [c.get(n, 0) for _, c in made] for n in names}

        return work

    keep = [c for c in docs.columns if c != text and c not in names]
    return map_texts(docs, text, make, ", ".join([f"{text} string", *(f"{n} bigint" for n in names)]), keep)
