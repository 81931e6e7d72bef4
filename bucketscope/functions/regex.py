"""Key patterns: Unicode-aware patterns in the Perl-like syntax of the listing filters, compiled for Java.

The two dialects agree on most syntax. Where the same text means something else, it is spelt otherwise: anchors around a
final newline, Unicode classes, ASCII bracket classes, group names and a few escapes. A pattern is parsed as groups,
alternatives, sequences and repetitions, so one that is malformed is refused before it reaches a task; and the parse tells
what text every match holds, which scans can test without the pattern.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException

# ASCII bracket classes.
BRACKET_CLASSES = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t ",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": " -~",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\f\r ",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}
_GENERAL_CATEGORY = re.compile(r"[A-Z][a-z]?$")
_FLAGS = re.compile(r"\(\?([A-Za-z]*)(-[A-Za-z]+)?([:)])")
_COUNT = re.compile(r"\{([0-9]*)(,?)([0-9]*)\}")
_NAMED_GROUP = re.compile(r"\(\?P?<([A-Za-z_][A-Za-z0-9_]*)>")
_NAMED_REFERENCE = re.compile(r"\(\?P=([A-Za-z_][A-Za-z0-9_]*)\)|\\k<([A-Za-z_][A-Za-z0-9_]*)>")
_BRACKET = re.compile(r"\[:(\^?)([a-z]+):\]")


@dataclass(frozen=True)
class KeyPattern:
    """A pattern for Java, and text that every key it is found in begins with, ends with or holds, where that is known."""

    java: str
    begins: str | None = None
    ends: str | None = None
    holds: tuple[str, ...] = ()


def compile_pattern(pattern: str) -> KeyPattern:
    """``ValueError`` for a pattern that is malformed or that Java cannot express."""
    text, sequence = _Parser(pattern).run()
    java = "(?Ud)" + text
    _check_in_java(java, pattern)
    begins = sequence[1] if len(sequence) > 1 and sequence[0] is _START and isinstance(sequence[1], str) else None
    ends = sequence[-2] if len(sequence) > 1 and sequence[-1] is _END and isinstance(sequence[-2], str) else None
    inner = {part for part in sequence if isinstance(part, str)} - {begins, ends}
    return KeyPattern(java, begins, ends, tuple(sorted(inner, key=lambda t: (-len(t), t))))


def _check_in_java(java: str, pattern: str) -> None:
    """What the parser lets pass Java may still refuse; with a driver's JVM at hand that shows before any task runs."""
    context = SparkContext._active_spark_context
    if context is None:
        return
    try:
        context._jvm.java.util.regex.Pattern.compile(java)
    except (Py4JJavaError, IllegalArgumentException) as error:
        raise ValueError(f"invalid pattern {pattern!r}: {error}") from None


def to_java(pattern: str) -> str:
    """The Java pattern that finds what ``pattern`` finds."""
    return compile_pattern(pattern).java


def literal_head(pattern: str) -> str | None:
    """Text that every key begins with in which the pattern is found, where it can be told."""
    return compile_pattern(pattern).begins


#: parts of a sequence beside the texts in it: the ends of the key, and whatever may lie between two texts
_START, _END, _GAP = object(), object(), object()


def _joined(*sequences: list) -> list:
    """Sequences one after the other, with neighbouring texts as one."""
    out: list = []
    for part in (part for sequence in sequences for part in sequence):
        if out and isinstance(part, str) and isinstance(out[-1], str):
            out[-1] += part
        elif not (out and part is _GAP and out[-1] is _GAP):
            out.append(part)
    return out


class _Parser:
    def __init__(self, pattern: str):
        self.text = pattern
        self.at = 0
        self.names: dict[str, str] = {}
        self.multiline = [False]
        self.insensitive = [False]
        self.spaced = [False]

    def run(self) -> tuple[str, list]:
        text, sequence = self._alternatives()
        if self.at < len(self.text):
            raise ValueError(f"unopened group in pattern {self.text!r}")
        return text, sequence

    def _alternatives(self) -> tuple[str, list]:
        branches = [self._sequence()]
        while self.text.startswith("|", self.at):
            self.at += 1
            branches.append(self._sequence())
        return "|".join(text for text, _ in branches), branches[0][1] if len(branches) == 1 else [_GAP]

    def _sequence(self) -> tuple[str, list]:
        texts: list[str] = []
        sequence: list = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            if blank := self._blank():
                texts.append(blank)
                continue
            if self._repetition() is not None:
                raise ValueError(f"nothing to repeat in pattern {self.text!r}")
            text, part, repeatable = self._piece()
            while repeatable and (found := self._repetition()):
                least, most, spelt = found
                text += spelt
                part = [_GAP] if least == 0 else [*part, _GAP]
                if self._repetition(peek=True):
                    # a repetition of a repetition needs a group in Java
                    text = f"(?:{text})"
            texts.append(text)
            sequence = _joined(sequence, part)
        return "".join(texts), sequence

    def _blank(self) -> str:
        """Blanks and comments, which mean nothing in spaced patterns."""
        if not self.spaced[-1]:
            return ""
        found = re.compile(r"(?:\s|#[^\n]*(?:\n|$))+").match(self.text, self.at)
        if found:
            self.at = found.end()
        return found.group() if found else ""

    def _repetition(self, peek: bool = False) -> tuple[int, int | None, str] | None:
        """Least and most times and the text of a repetition at this place; braces that are no count are none."""
        start = self.at
        self._blank()
        char = self.text[self.at : self.at + 1]
        count = _COUNT.match(self.text, self.at) if char == "{" else None
        if char and char in "*+?":
            least, most, spelt = {"*": (0, None, "*"), "+": (1, None, "+"), "?": (0, 1, "?")}[char]
            self.at += 1
        elif count and (count.group(1) or (count.group(2) and count.group(3))):
            least = int(count.group(1) or 0)
            most = least if not count.group(2) else int(count.group(3)) if count.group(3) else None
            if most is not None and most < least:
                raise ValueError(f"repetition {count.group()} in pattern {self.text!r} has its ends the wrong way round")
            spelt = f"{{{least}{count.group(2)}{count.group(3)}}}"
            self.at = count.end()
        else:
            self.at = start
            return None
        # lazy and possessive forms
        if self.text[self.at : self.at + 1] in ("?", "+"):
            spelt += self.text[self.at]
            self.at += 1
        if peek:
            self.at = start
        return least, most, spelt

    def _take(self, pattern: re.Pattern[str]) -> re.Match[str] | None:
        match = pattern.match(self.text, self.at)
        if match:
            self.at = match.end()
        return match

    def _literal(self, char: str) -> list:
        return [_GAP] if self.insensitive[-1] and char.upper() != char.lower() else [char]

    def _piece(self) -> tuple[str, list, bool]:
        """A piece for Java, its sequence, and whether it can be repeated."""
        char = self.text[self.at]
        if char == "\\":
            if named := self._named_reference():
                return named, [_GAP], True
            text, literal = self._escape(in_class=False)
            if text == "\\A":
                return text, [_START], True
            if text in (r"\z",):
                return text, [_END], True
            if text in ("", r"\b", r"\B", r"\b(?=\w)", r"\b(?<=\w)"):
                return text, [], True
            return text, self._literal(literal) if literal else [_GAP], True
        if char == "[":
            return self._class(), [_GAP], True
        if char == "(":
            if named := self._named_reference():
                return named, [_GAP], True
            return self._group()
        self.at += 1
        if char == "$":
            return (r"(?![^\n])", [], True) if self.multiline[-1] else (r"\z", [_END], True)
        if char == "^":
            return (r"(?<![^\n])", [], True) if self.multiline[-1] else (char, [_START], True)
        if char == ".":
            return char, [_GAP], True
        return ("\\" + char if char in "{}" else char), self._literal(char), True

    def _inside(self, opening: str, look: bool = False) -> tuple[str, list, bool]:
        """The rest of a group whose opening was read; the flags set inside end with it."""
        for flags in (self.multiline, self.insensitive, self.spaced):
            flags.append(flags[-1])
        text, sequence = self._alternatives()
        if not self.text.startswith(")", self.at):
            raise ValueError(f"unclosed group in pattern {self.text!r}")
        self.at += 1
        for flags in (self.multiline, self.insensitive, self.spaced):
            flags.pop()
        return f"{opening}{text})", [] if look else sequence, True

    def _group(self) -> tuple[str, list, bool]:
        if self.text.startswith("(?#", self.at):
            close = self.text.find(")", self.at)
            if close < 0:
                raise ValueError("unclosed comment in pattern")
            self.at = close + 1
            return "", [], False
        if self.text.startswith("(?(", self.at):
            raise ValueError("unsupported conditional in pattern")
        named = self._take(_NAMED_GROUP)
        if named:
            alias = self.names.setdefault(named.group(1), f"g{len(self.names) + 1}")
            return self._inside(f"(?<{alias}>")
        for opening in ("(?=", "(?!", "(?<=", "(?<!"):
            if self.text.startswith(opening, self.at):
                self.at += len(opening)
                return self._inside(opening, look=True)
        if self.text.startswith("(?>", self.at):
            self.at += 3
            return self._inside("(?>")
        flags = self._take(_FLAGS)
        if flags is None:
            if self.text.startswith("(?", self.at):
                raise ValueError(f"unknown group in pattern {self.text!r}")
            self.at += 1
            return self._inside("(")
        on, off, end = flags.group(1), (flags.group(2) or "")[1:], flags.group(3)
        unknown = set(on + off) - set("imsuUx")
        if unknown:
            raise ValueError(f"unsupported flag in pattern: {sorted(unknown)}")
        # anchors are spelled out above and greed does not change whether a match exists
        keep = lambda letters: "".join("U" if f == "u" else f for f in letters if f not in "mU")
        java_on, java_off = keep(on), keep(off)
        spelt = f"(?{java_on}{'-' + java_off if java_off else ''}{end}" if java_on or java_off else "(?:" if end == ":" else ""
        before = [flags[-1] for flags in (self.multiline, self.insensitive, self.spaced)]
        for letter, flags in zip("mix", (self.multiline, self.insensitive, self.spaced)):
            if letter in on or letter in off:
                flags[-1] = letter in on
        if end != ":":
            return spelt, [], False
        found = self._inside(spelt)
        for flags, value in zip((self.multiline, self.insensitive, self.spaced), before):
            flags[-1] = value
        return found

    def _named_reference(self) -> str | None:
        match = self._take(_NAMED_REFERENCE)
        if match is None:
            return None
        name = match.group(1) or match.group(2)
        if name not in self.names:
            raise ValueError(f"unknown group in pattern: {name}")
        return rf"\k<{self.names[name]}>"

    def _escape(self, in_class: bool) -> tuple[str, str | None]:
        """An escape for Java, and the character it stands for if it is one."""
        following = self.text[self.at + 1 : self.at + 2]
        self.at += 2
        if following == "":
            raise ValueError("pattern ends in a backslash")
        if following in "hH":
            negated = "^" if following == "H" else ""
            return f"[{negated}0-9A-Fa-f]", None
        if following == "K":
            return "", None
        if following == "v":
            return r"\x0B", "\x0b"
        if following == "Z":
            return r"(?=\n*\z)", None
        if following in "QE":
            raise ValueError("unsupported quotation in pattern")
        if following in "bB" and self.text[self.at : self.at + 1] == "{":
            raise ValueError("unsupported word boundary in pattern")
        if following in "xuU":
            return self._code(following)
        if following in "pP":
            return self._property(following), None
        if following in "<>" and not in_class:
            return r"\b(?=\w)" if following == "<" else r"\b(?<=\w)", None
        if following.isdigit():
            digits = re.compile("[0-9]*").match(self.text, self.at)
            self.at = digits.end()
            return "\\" + following + digits.group(), None
        return "\\" + following, None if following.isalnum() else following

    def _code(self, letter: str) -> tuple[str, str]:
        """A character by its number, in braces or with two, four or eight digits."""
        width = {"x": 2, "u": 4, "U": 8}[letter]
        found = re.compile(rf"\{{([0-9A-Fa-f]+)\}}|([0-9A-Fa-f]{{{width}}})").match(self.text, self.at)
        number = int(found.group(1) or found.group(2), 16) if found else -1
        if not 0 <= number <= 0x10FFFF:
            raise ValueError(f"invalid character code in pattern {self.text!r}")
        self.at = found.end()
        return rf"\x{{{number:X}}}", chr(number)

    def _property(self, letter: str) -> str:
        if self.text[self.at : self.at + 1] != "{":
            self.at += 1
            return f"\\{letter}{self.text[self.at - 1 : self.at]}"
        close = self.text.find("}", self.at)
        if close < 0:
            raise ValueError("unclosed property in pattern")
        name = self.text[self.at + 1 : close]
        self.at = close + 1
        if name.startswith("^"):
            letter, name = ("P" if letter == "p" else "p"), name[1:]
        if "=" not in name and not _GENERAL_CATEGORY.match(name):
            name = f"Is{name}"
        return f"\\{letter}{{{name}}}"

    def _class(self) -> str:
        out = ["["]
        self.at += 1
        if self.text.startswith("^", self.at):
            out.append("^")
            self.at += 1
        if self.text.startswith("]", self.at):
            out.append(r"\]")
            self.at += 1
        while self.at < len(self.text):
            char = self.text[self.at]
            bracket = self._take(_BRACKET)
            if bracket:
                if bracket.group(2) not in BRACKET_CLASSES:
                    raise ValueError(f"unknown class in pattern: {bracket.group(0)}")
                out.append(f"[{bracket.group(1)}{BRACKET_CLASSES[bracket.group(2)]}]")
            elif char == "\\":
                out.append(self._escape(in_class=True)[0])
            elif char == "[":
                out.append(self._class())
            elif self.text.startswith(("--", "~~"), self.at):
                raise ValueError("unsupported set operation in pattern")
            else:
                out.append(char)
                self.at += 1
                if char == "]":
                    return "".join(out)
        raise ValueError("unclosed class in pattern")
