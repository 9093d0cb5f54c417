"""JSON5, Jsonic and ZON texts as plain Python values.

Members of one name merge where both are containers (objects by name, lists by place); else the later
one counts. ZON refuses a repeated field. All failures tell the line and column.
"""

from __future__ import annotations

import functools
import re

from .decode import _NUMBER, Lexeme, Malformed, real

_JSON5 = re.compile(
    r"""(?P<skip>[\s\ufeff]+|//[^\n]*|/\*.*?\*/)
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<punct>[{}\[\]:,])
    |(?P<word>[^\s{}\[\]:,"'/]+)""",
    re.VERBOSE | re.DOTALL,
)
_JSONIC = re.compile(
    r"""(?P<skip>[\s\ufeff]+|//[^\n]*|\#[^\n]*|/\*.*?\*/)
    |(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`)
    |(?P<punct>[{}\[\]:,])
    |(?P<word>[^\s{}\[\]:,"'`\#]+)""",
    re.VERBOSE | re.DOTALL,
)
_ZON = re.compile(
    r"""(?P<skip>\s+|//[^\n]*)
    |(?P<open>\.\{)
    |(?P<name>\.(?:[A-Za-z_]\w*|@"(?:[^"\\\n]|\\.)*"))
    |(?P<string>"(?:[^"\\\n]|\\.)*")
    |(?P<lines>\\\\[^\n]*(?:\n\s*\\\\[^\n]*)*)
    |(?P<char>'(?:[^'\\\n]|\\(?:u\{[0-9A-Fa-f]+\}|x[0-9A-Fa-f]{2}|.))')
    |(?P<punct>[},=])
    |(?P<word>[+-]?(?:[eEpP][+-](?=\d)|[\w.])+)""",
    re.VERBOSE,
)
_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|(\r\n|.))", re.DOTALL)
_PLAIN = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "0": "\0", "\n": "", "\r\n": "", "\u2028": "", "\u2029": ""}
_NAME = re.compile(r"[^\W\d$][\w$\u200c\u200d]*|\$[\w$\u200c\u200d]*")
_FLOAT = re.compile(r"[+-]?(?:(?:0|[1-9]\d*)(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?", re.ASCII)
_WHOLE = re.compile(r"[+-]?0(?:[xX]_*[0-9A-Fa-f][0-9A-Fa-f_]*|[oO]_*[0-7][0-7_]*|[bB]_*[01][01_]*)")
_WORDS = {"true": True, "false": False, "null": None}
_UNBOUND = {"Infinity": float("inf"), "NaN": float("nan"), "inf": float("inf"), "nan": float("nan")}


class _Tokens:
    """The tokens of one text, read one ahead of what is taken (two, where the next but one is asked for)."""

    def __init__(self, text: str, pattern: re.Pattern):
        self.text, self.pattern, self.at, self.commas = text, pattern, 0, False
        self.held = [self.read()]

    def read(self) -> tuple[str, str, int]:
        while self.at < len(self.text):
            m, at = self.pattern.match(self.text, self.at), self.at
            if m is None:
                raise self.failure("no token begins here", at)
            self.at = m.end()
            if m.lastgroup != "skip":
                self.commas = self.commas or m.lastgroup == "punct" and m[0] == ","
                return m.lastgroup, m[0], at
        return "end", "", len(self.text)

    def rest(self) -> None:
        """Reads on to the end: of several faults of a text, what is no token at all is told of."""
        while self.read()[0] != "end":
            pass

    def failure(self, what: str, at: int) -> Malformed:
        return Malformed(what, self.text.count("\n", 0, at) + 1, at - self.text.rfind("\n", 0, at))

    def take(self) -> tuple[str, str, int]:
        found = self.held.pop(0)
        if not self.held:
            self.held.append(self.read())
        return found

    def next(self, n: int = 0) -> tuple[str, str, int]:
        while len(self.held) <= n:
            self.held.append(self.read())
        return self.held[n]

    def sees(self, *words: str) -> bool:
        kind, word, _ = self.held[0]
        return kind in ("punct", "end") and word in words

    def eats(self, word: str) -> bool:
        found = self.sees(word)
        if found and word != "":
            self.take()
        return found

    def needs(self, word: str) -> None:
        if not self.eats(word):
            raise self.failure(f"{word or 'the end'} is wanted", self.held[0][2])


def _reading(pattern: re.Pattern):
    """Makes a reader of texts from one of tokens; of several faults that of a token is told, wherever it stands."""

    def of(read):
        @functools.wraps(read)
        def whole(text: str, lexemes: bool = False):
            t = _Tokens(text, pattern)
            try:
                return read(t, lexemes)
            except (ValueError, RecursionError):
                t.rest()
                raise

        return whole

    return of


def _merged(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return a | {k: _merged(a[k], v) if k in a else v for k, v in b.items()}
    if isinstance(a, list) and isinstance(b, list):
        return [*map(_merged, a, b), *a[len(b) :], *b[len(a) :]]
    return b


def _put(into: dict, name: str, value) -> None:
    into[name] = _merged(into[name], value) if name in into else value


def _unquoted(quoted: str) -> str:
    def char(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        return chr(min(int(code, 16), 0x10FFFF)) if code else _PLAIN.get(m[4], m[4])

    inner = quoted[1:-1]
    if "\\" not in inner:
        return inner
    # the halves of a surrogate pair become one character
    return _ESCAPE.sub(char, inner).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass")


def _number(word: str, lexemes: bool, gaps: bool = False) -> float | None:
    """The number that a word is, or None; gaps: underscores between digits are allowed."""
    if lexemes and _NUMBER.match(word):
        return Lexeme(word)
    if _WHOLE.fullmatch(word) and (gaps or "_" not in word and word.lstrip("+-")[1] in "xX"):
        return real(int(word.replace("_", ""), 0))
    plain = word.replace("_", "") if gaps and not word.startswith("_") else word
    return float(plain) if _FLOAT.fullmatch(plain) else None


@_reading(_JSON5)
def json5(t: _Tokens, lexemes: bool):
    def value():
        kind, word, at = t.take()
        if kind == "string":
            return _unquoted(word)
        if word == "{":
            out: dict = {}
            while not t.eats("}"):
                kind, word, at = t.take()
                if kind != "string" and not (kind == "word" and _NAME.fullmatch(word)):
                    raise t.failure("a member's name is wanted", at)
                t.needs(":")
                _put(out, _unquoted(word) if kind == "string" else word, value())
                if not t.eats(","):
                    t.needs("}")
                    break
            return out
        if word == "[":
            items = []
            while not t.eats("]"):
                items.append(value())
                if not t.eats(","):
                    t.needs("]")
                    break
            return items
        if kind == "word":
            if word in _WORDS:
                return _WORDS[word]
            if word.lstrip("+-") in ("Infinity", "NaN"):
                return _UNBOUND[word.lstrip("+-")] * (-1 if word[0] == "-" else 1)
            if (number := _number(word, lexemes)) is not None:
                return number
        raise t.failure("a value is wanted", at)

    out = value()
    t.needs("")
    return out


@_reading(_JSONIC)
def jsonic(t: _Tokens, lexemes: bool):
    """Quotes, commas and the outermost braces or brackets may be left out; a pair inside a list is dropped;
    nothing where a value could be is null, so is an empty text; ``a:b:1`` nests."""
    def entry():
        """(name or None, value) of the next pair or value."""
        kind, word, at = t.take()
        if word == "{" and kind == "punct":
            members, elements = entries("}")
            if elements:
                raise t.failure("a member without a value", at)
            return None, members
        if word == "[" and kind == "punct":
            return None, entries("]")[1]
        if kind not in ("string", "word"):
            raise t.failure("a value is wanted", at)
        if t.eats(":"):
            if t.sees(",", "}", "]", ""):
                return (_unquoted(word) if kind == "string" else word), None
            inner, value = entry()
            return (_unquoted(word) if kind == "string" else word), value if inner is None else {inner: value}
        if kind == "string":
            return None, _unquoted(word)
        if word in _WORDS:
            return None, _WORDS[word]
        number = _number(word, lexemes, gaps=True)
        return None, word if number is None else number

    def entries(close: str):
        """(members, elements) up to the closing mark."""
        members: dict = {}
        elements, empty = [], True
        while not t.eats(close):
            if t.eats(","):
                if empty and close != "}":
                    elements.append(None)
                empty = True
                continue
            name, value = entry()
            empty = False
            if name is None:
                elements.append(value)
            else:
                _put(members, name, value)
        return members, elements

    members, elements = entries("")
    if members and elements:
        raise t.failure("pairs and values side by side", 0)
    if members or not elements:
        return members or None
    return elements[0] if len(elements) == 1 and not (t.commas and t.text.rstrip().endswith(",")) else elements


@_reading(_ZON)
def zon(t: _Tokens, lexemes: bool):
    """Literals of Zig: a struct is an object, a tuple a list, an empty one an object, an enum literal its name,
    a character its code."""
    def named(word: str) -> str:
        return _unquoted(word[2:]) if word.startswith(".@") else word[1:]

    def value():
        kind, word, at = t.take()
        if kind == "open":
            fields, items = {}, []
            while not t.eats("}"):
                kind, word, at = t.next()
                if kind == "name" and t.next(1)[1] == "=":
                    t.take()
                    t.take()
                    if named(word) in fields:
                        raise t.failure("a field is repeated", at)
                    if items:
                        raise t.failure("a field inside a tuple", at)
                    fields[named(word)] = value()
                elif fields:
                    raise t.failure("a field's name is wanted", at)
                else:
                    items.append(value())
                if not t.eats(","):
                    t.needs("}")
                    break
            return items or fields
        if kind == "string":
            return _unquoted(word)
        if kind == "name":
            return named(word)
        if kind == "lines":
            return "\n".join(line.lstrip()[2:] for line in word.split("\n"))
        if kind == "char":
            return float(ord(_unquoted(word)))
        if kind == "word":
            if word in _WORDS:
                return _WORDS[word]
            if word.lstrip("+-") in ("inf", "nan"):
                return _UNBOUND[word.lstrip("+-")] * (-1 if word[0] == "-" else 1)
            if (number := _number(word, lexemes, gaps=True)) is not None:
                return number
        raise t.failure("a value is wanted", at)

    out = value()
    t.needs("")
    return out
