"""User regexes as trees: character sets in a row, choices and repetitions.

The syntax is that of the engine that runs them (java.util.regex).  Sets are bit masks over the ASCII
characters, the other characters that the regex names, and one place for all the rest.  Look-arounds
and anchors match no character and count as empty; possessive and atomic parts count as plain
ones.  What cannot be read is an error, never guessed at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Union

_ASCII = 128
# Repetitions are written out, so a regex has at most so many places.
MOST_PLACES = 3000
_PERL = {
    "d": [(48, 57)], "w": [(48, 57), (65, 90), (95, 95), (97, 122)],
    "s": [(9, 13), (32, 32)], "h": [(9, 9), (32, 32)], "v": [(10, 13)],
}
_POSIX = {
    "Lower": [(97, 122)], "Upper": [(65, 90)], "Alpha": [(65, 90), (97, 122)], "Digit": [(48, 57)],
    "Alnum": [(48, 57), (65, 90), (97, 122)], "Punct": [(33, 47), (58, 64), (91, 96), (123, 126)],
    "Graph": [(33, 126)], "Print": [(32, 126)], "Blank": [(9, 9), (32, 32)], "Cntrl": [(0, 31), (127, 127)],
    "XDigit": [(48, 57), (65, 70), (97, 102)], "Space": [(9, 13), (32, 32)], "ASCII": [(0, 127)],
}
_CONTROL = {"t": 9, "n": 10, "r": 13, "f": 12, "a": 7, "e": 27}


class UnreadableRegex(ValueError):
    """Syntax that these trees do not cover."""


@dataclass(frozen=True)
class Chars:
    mask: int


@dataclass(frozen=True)
class Row:
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Choice:
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Repeat:
    item: Node
    least: int
    most: int | None


Node = Union[Chars, Row, Choice, Repeat]
EMPTY = Row(())


class Alphabet:
    """Places of the masks: ASCII, then characters that the regex names, then all others."""

    def __init__(self, regex: str) -> None:
        named = {ord(c) for c in regex if ord(c) >= _ASCII}
        named |= {int(x, 16) for x in re.findall(r"\\u([0-9A-Fa-f]{4})", regex) if int(x, 16) >= _ASCII}
        # The other case of a named letter has a place, too.
        named |= {ord(o) for c in list(named) for o in (chr(c).lower(), chr(c).upper()) if len(o) == 1}
        self.extra = sorted(x for x in named if x >= _ASCII)
        self.places = {c: _ASCII + i for i, c in enumerate(self.extra)}
        self.rest = 1 << (_ASCII + len(self.extra))
        self.all = (self.rest << 1) - 1

    def one(self, code: int) -> int:
        return 1 << (code if code < _ASCII else self.places[code]) if (
            code < _ASCII or code in self.places) else self.rest

    def span(self, low: int, high: int) -> int:
        mask = 0
        if low < _ASCII:
            top = min(high, _ASCII - 1)
            mask |= ((1 << (top - low + 1)) - 1) << low
        if high >= _ASCII:
            mask |= self.rest
            for code, place in self.places.items():
                if low <= code <= high:
                    mask |= 1 << place
        return mask

    def spans(self, ranges: list[tuple[int, int]]) -> int:
        mask = 0
        for low, high in ranges:
            mask |= self.span(low, high)
        return mask

    def any_case(self, mask: int) -> int:
        found = mask
        for code in [*range(_ASCII), *self.extra]:
            if mask & self.one(code):
                for other in (chr(code).lower(), chr(code).upper()):
                    if len(other) == 1:
                        found |= self.one(ord(other))
        return found

    def character(self, mask: int) -> str:
        """A character of a set, a printable one where there is one."""
        for code in [*range(97, 123), *range(48, 58), *range(65, 91), *range(33, 127), 32, *range(32),
                     127, *self.extra]:
            if mask & self.one(code):
                return chr(code)
        return next(chr(c) for c in range(0x4E00, 0x9FFF) if c not in self.places)


class _Reader:
    def __init__(self, regex: str) -> None:
        self.text, self.at, self.letters = regex, 0, Alphabet(regex)

    def peek(self, size: int = 1) -> str:
        return self.text[self.at:self.at + size]

    def take(self, size: int = 1) -> str:
        found = self.peek(size)
        if len(found) < size:
            raise UnreadableRegex("ends too early")
        self.at += size
        return found

    def accept(self, text: str) -> bool:
        if self.text.startswith(text, self.at):
            self.at += len(text)
            return True
        return False

    def until(self, end: str) -> str:
        close = self.text.find(end, self.at)
        if close < 0:
            raise UnreadableRegex(f"no {end}")
        found, self.at = self.text[self.at:close], close + len(end)
        return found

    def choice(self, flags: str) -> Node:
        rows, items = [], []
        while self.at < len(self.text) and self.peek() != ")":
            if self.accept("|"):
                rows.append(Row(tuple(items)))
                items = []
                continue
            item, flags = self.item(flags)
            if item is not None:
                items.append(self.repeated(item))
        rows.append(Row(tuple(items)))
        return rows[0] if len(rows) == 1 else Choice(tuple(rows))

    def repeated(self, item: Node) -> Node:
        while True:
            if self.accept("*"):
                least, most = 0, None
            elif self.accept("+"):
                least, most = 1, None
            elif self.accept("?"):
                least, most = 0, 1
            elif self.peek() == "{":
                found = re.compile(r"\{(\d{1,9})(,)?(\d{1,9})?\}").match(self.text, self.at)
                if not found:
                    raise UnreadableRegex("a brace that is no repetition")
                self.at = found.end()
                least = int(found[1])
                most = int(found[3]) if found[3] else None if found[2] else least
                if most is not None and most < least:
                    raise UnreadableRegex("a repetition from more to fewer")
            else:
                return item
            if not self.accept("?"):  # lazy: the same matches in another order
                self.accept("+")
            item = Repeat(item, least, most)

    def cased(self, mask: int, flags: str) -> Chars:
        return Chars(self.letters.any_case(mask) if "i" in flags else mask)

    def item(self, flags: str) -> tuple[Node | None, str]:
        if self.accept("("):
            return self.group(flags)
        if self.accept("["):
            return self.cased(self.set(flags), flags), flags
        c = self.take()
        if c == ".":
            line_ends = 0 if "s" in flags else self.letters.one(10) | self.letters.one(13)
            return Chars(self.letters.all & ~line_ends), flags
        if c in "^$":
            return EMPTY, flags
        if c == "\\":
            return self.escape(flags), flags
        if c in "*+?{":
            raise UnreadableRegex("a repetition of nothing")
        return self.cased(self.letters.one(ord(c)), flags), flags

    def group(self, flags: str) -> tuple[Node | None, str]:
        empty = False
        inner = flags
        if self.accept("?"):
            if self.accept("=") or self.accept("!") or self.accept("<=") or self.accept("<!"):
                empty = True
            elif self.accept("<"):
                self.until(">")
            elif not (self.accept(":") or self.accept(">")):
                found = re.compile(r"([a-zA-Z]*)(?:-([a-zA-Z]*))?([:)])").match(self.text, self.at)
                if not found:
                    raise UnreadableRegex("a group of an unknown kind")
                self.at = found.end()
                inner = "".join(sorted((set(flags) | set(found[1])) - set(found[2] or "")))
                if set(found[1]) - set("ismuUd"):
                    raise UnreadableRegex(f"flags {found[1]}")
                if found[3] == ")":
                    return None, inner
        node = self.choice(inner)
        if not self.accept(")"):
            raise UnreadableRegex("no closing bracket")
        return EMPTY if empty else node, flags

    def property(self) -> int:
        name = self.until("}") if self.accept("{") else self.take()
        name = name.removeprefix("Is")
        if name in _POSIX:
            return self.letters.spans(_POSIX[name])
        letters = {"L": "Alpha", "Lu": "Upper", "Ll": "Lower", "N": "Digit", "Nd": "Digit",
                   "Alphabetic": "Alpha", "P": "Punct", "Z": "Blank", "White_Space": "Space"}
        if name not in letters:
            raise UnreadableRegex(f"property {name}")
        # All characters beyond ASCII count as members: a set may be too large, never too small.
        return self.letters.spans([*_POSIX[letters[name]], (_ASCII, 0x10FFFF)])

    def code(self, c: str) -> int:
        """The character that an escape stands for."""
        if c in _CONTROL:
            return _CONTROL[c]
        if c == "x":
            return int(self.until("}"), 16) if self.accept("{") else int(self.take(2), 16)
        if c == "u":
            return int(self.take(4), 16)
        if c.isalnum():
            raise UnreadableRegex(f"\\{c}")
        return ord(c)

    def escaped_set(self, c: str) -> int | None:
        if c in _PERL:
            return self.letters.spans(_PERL[c])
        if c.lower() in _PERL:
            return self.letters.all & ~self.letters.spans(_PERL[c.lower()])
        if c == "p":
            return self.property()
        if c == "P":
            # A complement, again never too small.
            return self.letters.all & ~self.property() | self.letters.span(_ASCII, 0x10FFFF)
        return None

    def escape(self, flags: str) -> Node:
        c = self.take()
        if c in "bBAzZG":
            return EMPTY
        if c == "Q":
            literal = self.until("\\E") if "\\E" in self.text[self.at:] else self.take(
                len(self.text) - self.at)
            return Row(tuple(self.cased(self.letters.one(ord(x)), flags) for x in literal))
        if c in "123456789k":
            raise UnreadableRegex("a back reference")
        found = self.escaped_set(c)
        return self.cased(self.letters.one(self.code(c)) if found is None else found, flags)

    def set(self, flags: str) -> int:
        negated, mask, first, both = self.accept("^"), 0, True, None
        while True:
            if self.at >= len(self.text):
                raise UnreadableRegex("no ] of a set")
            if self.peek() == "]" and not first:
                self.at += 1
                break
            if self.accept("&&"):
                both, mask = mask if both is None else both & mask, 0
                continue
            first = False
            if self.accept("["):
                mask |= self.set(flags)
                continue
            c = self.take()
            if c == "\\":
                c = self.take()
                found = self.escaped_set(c)
                if found is not None:
                    mask |= found
                    continue
                low = self.code(c)
            else:
                low = ord(c)
            if self.peek() == "-" and self.peek(2)[1:] not in ("]", "[", ""):
                self.at += 1
                c = self.take()
                high = self.code(self.take()) if c == "\\" else ord(c)
                if high < low:
                    raise UnreadableRegex("a range from high to low")
                mask |= self.letters.span(low, high)
            else:
                mask |= self.letters.one(low)
        if both is not None:
            mask &= both
        if "i" in flags:
            mask = self.letters.any_case(mask)
        if not negated:
            return mask
        # A complement takes the characters beyond ASCII in that its own set may hold in part only.
        loose = self.letters.span(_ASCII, 0x10FFFF) if re.search(r"\\[pP]", self.text) else self.letters.rest
        return self.letters.all & ~mask | loose


def read_regex(regex: str) -> tuple[Node, Alphabet]:
    reader = _Reader(regex)
    node = reader.choice("")
    if reader.at < len(regex):
        raise UnreadableRegex("a closing bracket too many")
    return node, reader.letters


def _letter(mask: int) -> str | None:
    """The one ASCII character of a set, if it has just one."""
    return chr(mask.bit_length() - 1) if mask and mask & (mask - 1) == 0 and mask < 1 << _ASCII else None


# Literals of which one must occur are at most so many.
_MOST_LITERALS = 8


def required_literals(regex: str) -> tuple[str, ...]:
    """Texts of which every match holds at least one; none where that is not certain.

    Of all places in a row the one with the longest shortest literal is taken; all branches of a
    choice have to have one.
    """
    try:
        node, _ = read_regex(regex)
    except (ValueError, RecursionError):
        return ()

    def better(a: frozenset[str], b: frozenset[str]) -> frozenset[str]:
        rank = lambda s: (min(map(len, s)), -len(s)) if s else (0, 0)
        return max(a, b, key=rank)

    def whole(node: Node) -> frozenset[str] | None:
        """All texts of a node, if they are few."""
        if isinstance(node, Chars):
            letter = _letter(node.mask)
            if letter:
                return frozenset(letter)
            codes = [c for c in range(_ASCII) if node.mask >> c & 1]
            few = node.mask < 1 << _ASCII and len(codes) <= _MOST_LITERALS
            return frozenset(map(chr, codes)) if few else None
        if isinstance(node, Choice):
            parts = [whole(x) for x in node.items]
            found = None if None in parts else frozenset().union(*parts)
            return found if found is not None and len(found) <= _MOST_LITERALS else None
        if isinstance(node, Repeat):
            inner = whole(node.item) if node.most is not None and node.most <= 16 else None
            if inner is None or node.least != node.most and (node.least, node.most) != (0, 1):
                return None
            found = frozenset({""})
            for _ in range(node.least):
                found = frozenset(a + b for a in found for b in inner)
                if len(found) > _MOST_LITERALS:
                    return None
            return found if node.least == node.most else found | inner
        found = frozenset({""})
        for x in node.items:
            inner = whole(x)
            found = frozenset(a + b for a in found for b in inner) if inner is not None else None
            if found is None or len(found) > _MOST_LITERALS:
                return None
        return found

    def best(node: Node) -> frozenset[str]:
        texts = whole(node)
        if texts is not None:
            return texts if texts and "" not in texts else frozenset()
        if isinstance(node, Choice):
            parts = [best(x) for x in node.items]
            found = frozenset().union(*parts) if all(parts) else frozenset()
            return found if len(found) <= _MOST_LITERALS else frozenset()
        if isinstance(node, Repeat):
            return best(node.item) if node.least else frozenset()
        if isinstance(node, Chars):
            return frozenset()
        found, run = frozenset(), frozenset({""})
        for x in node.items:
            inner = whole(x)
            grown = frozenset(a + b for a in run for b in inner) if inner is not None else None
            if grown is None or len(grown) > _MOST_LITERALS:
                found = better(found, run if "" not in run else frozenset())
                run = frozenset({""}) if inner is None else inner
                found = better(found, best(x))
            else:
                run = grown
        return better(found, run if "" not in run else frozenset())

    return tuple(sorted(best(node)))
