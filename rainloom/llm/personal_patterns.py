"""The base rules for personal data, and the parts of a text that a model looks at for more."""

from __future__ import annotations

import re

#: Kinds in the order in which they are listed; the last one has no base rule.
KINDS = ["email", "ip", "card", "phone", "secret"]
BASE_KINDS = KINDS[:4]

_MAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# greedy runs of digits are never cut, so a match starts where a run does
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?i)(?:token|key|secret|password|passwd|pwd)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_-]{16,})")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]\S*+(?:\x20[^\s0-9]*+[0-9]\S*+)*+")
TOKEN = re.compile(r"[^\W_]+|\S")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        value = ord(d) - 48
        total += value if k % 2 == 0 else (2 * value - 9 if value > 4 else 2 * value)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    found, floor = [], 0
    for m in _MAIL.finditer(text):
        start = floor + len(text[floor : m.start()].rstrip(_LOCAL))
        if start < m.start():
            found.append(("email", start, m.end()))
            floor = m.end()
        else:
            floor = m.start() + 1
    return found


def addresses(text: str) -> list[Span]:
    # a part of more than three digits may still be small by leading zeros
    fine = lambda m: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))
    return [("ip", m.start(), m.end()) for m in _IP.finditer(text) if fine(m)]


def cards(text: str) -> list[Span]:
    found = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    return found


def phones(text: str) -> list[Span]:
    return [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]


def base_spans(text: str) -> list[Span]:
    """All base spans, kind by kind; offsets are code points, the end exclusive."""
    return emails(text) + addresses(text) + cards(text) + phones(text)


def secrets(text: str) -> list[Span]:
    """Values that a naming word and an equals sign or colon stand before: examples for the model."""
    return [("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text)]


def listed(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in listed(spans))


def islands(text: str) -> list[tuple[int, int]]:
    """Runs of words that hold a digit or an at sign, joined by single spaces where each has a digit."""
    found, floor = [], 0
    for m in _MARK.finditer(text):
        start = m.start()
        while start > floor and not text[start - 1].isspace():
            start -= 1
        found.append((start, m.end()))
        floor = m.end()
    return found
