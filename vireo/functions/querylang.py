"""The query language: lexing, scopes, names and types."""

from __future__ import annotations

from dataclasses import dataclass, field

from vireo.functions.signatures import GrammarError, Sig, parse_type, to_signature


@dataclass(frozen=True)
class Scope:
    include: bool
    category: str
    value: str


@dataclass
class Query:
    names: list[str] = field(default_factory=list)
    type: tuple | None = None
    scopes: list[Scope] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)

    @property
    def signature(self) -> Sig | None:
        return to_signature(self.type) if self.type is not None else None


_OPEN, _SHUT = ["(#", "[:", "(", "["], ["#)", ":]", ")", "]"]
_PAIRS = [o + s for o, s in zip(_OPEN, _SHUT)]
_ASCII = set("!#$%&*+./<=>?@\\^|-~")
_NEVER = set("(),;[]`{}\"'")


def _symbol(c: str) -> bool:
    import unicodedata

    return c in _ASCII or c not in _NEVER and unicodedata.category(c)[0] in "SP"


def _symbols(word: str) -> bool:
    return bool(word) and word not in _OPEN + _SHUT + _PAIRS and _symbol(word[0])


def _alpha(word: str) -> bool:
    return word[:1].isalpha()


def lex(text: str) -> list[str]:
    """Small pieces: tuple names, brackets, one blank for a run of space, identifiers, symbol runs, commas."""
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if text.startswith("(,", i):
            j = i + 1
            while j < n and text[j] == ",":
                j += 1
            if j < n and text[j] == ")":
                out.append(text[i : j + 1])
                i = j + 1
                continue
        bracket = next((b for b in _PAIRS + _OPEN + _SHUT if text.startswith(b, i)), None)
        if bracket:
            out.append(bracket)
            i += len(bracket)
        elif c.isspace():
            while i < n and text[i].isspace():
                i += 1
            out.append(" ")
        elif c.isalpha() or c == "_":
            j = i + 1
            while j < n and (text[j].isalnum() or text[j] in "_'#-"):
                j += 1
            while j > i + 1 and text[j - 1] == "-":
                j -= 1
            out.append(text[i:j])
            i = j
        elif _symbol(c):
            j = i + 1
            while j < n and _symbol(text[j]):
                j += 1
            out.append(text[i:j])
            i = j
        else:
            if c == ",":
                out.append(",")
            i += 1
    return out


def _module(x: list[str], i: int) -> tuple[str, int] | None:
    """A dotted value and where it ends; a final dot stays in it."""
    if i >= len(x) or not _alpha(x[i]):
        return None
    value = x[i]
    i += 1
    while i < len(x) and x[i] == ".":
        if i + 1 < len(x) and _alpha(x[i + 1]):
            value += "." + x[i + 1]
            i += 2
        elif i + 1 >= len(x) or x[i + 1] == " ":
            return value + ".", i + 1
        else:
            break
    return value, i


def _dots(x: list[str], i: int) -> tuple[str, list[str]] | None:
    """A qualifier and what follows it: ``A.B.name``, ``A.B.(op)`` or ``A.B.op``."""
    if i >= len(x) or not _alpha(x[i]):
        return None
    if i + 1 >= len(x) or not x[i + 1].startswith("."):
        return None
    if x[i + 1] == ".":
        more = _dots(x, i + 2)
        if more:
            return x[i] + "." + more[0], more[1]
        return x[i], x[i + 2 :]
    return x[i], [x[i + 1][1:], *x[i + 2 :]]


def _default_category(value: str) -> str:
    return "module" if "." in value or value[:1].isupper() else "package"


def take_scopes(x: list[str]) -> tuple[list[Scope], list[str]]:
    scopes: list[Scope] = []
    rest: list[str] = []
    while x:
        sign = {"+": True, "-": False}.get(x[0])
        step = 0 if sign is None else 1
        if len(x) > step + 2 and _alpha(x[step]) and x[step + 1] in (":", ":-", ":.", ":-."):
            mark = x[step + 1]
            found = _module(x, step + 2)
            if found and (sign is None or mark in (":", ":-")):
                include = (True if sign is None else sign) and "-" not in mark
                scopes.append(Scope(include, x[step], ("." if mark.endswith(".") else "") + found[0]))
                x = x[found[1] :]
                continue
        if sign is not None and (found := _module(x, 1)):
            scopes.append(Scope(sign, _default_category(found[0]), found[0]))
            x = x[found[1] :]
            continue
        bracket = x[0] == "("
        lead = 1 if bracket else 0
        dot = len(x) > lead and x[lead] == "."
        found = _dots(x, lead + dot)
        if found:
            value, after = ("." if dot else "") + found[0], found[1]
            if bracket and len(after) > 1 and after[1] == ")":
                scopes.append(Scope(True, _default_category(value), value))
                rest += ["(", after[0], ")"]
                x = after[2:]
                continue
            if not bracket:
                scopes.append(Scope(True, _default_category(value), value))
                x = after
                continue
        rest.append(x[0])
        x = x[1:]
    return scopes, rest


def _names(x: list[str]) -> list[str]:
    out, i = [], 0
    while i < len(x):
        if x[i] == "(" and i + 2 < len(x) and x[i + 2] == ")":
            out += [x[i + 1]] if x[i + 1] != " " else []
            i += 3
        elif x[i] == "(" and i + 2 == len(x):
            out.append(x[i + 1])
            i += 2
        else:
            out += [x[i]] if x[i] != " " else []
            i += 1
    return out


def repaired(x: list[str]) -> str:
    """Unfinished arrows and brackets completed; ``_`` made an ordinary variable."""
    x = [w for w in x if w.strip()]
    if x and x[-1] in ("-", "="):
        x = [*x[:-1], x[-1] + ">"]
    if x and x[-1] in ("->", "=>"):
        x = [*x, "_"]
    stack: list[str] = []
    for w in x:
        if w in _OPEN:
            stack.insert(0, _SHUT[_OPEN.index(w)])
        elif stack and w == stack[0]:
            stack.pop(0)
    return " ".join(x + stack)


def _type(x: list[str]) -> tuple | None:
    try:
        return parse_type(repaired(x), query=True)
    except GrammarError:
        return None


def parse_query(text: str) -> Query:
    scopes, rest = take_scopes(lex(text))
    names = _names(rest)
    if all(map(_alpha, names)) or all(map(_symbols, names)) or len(names) == 1:
        return Query(names, None, scopes)
    if "::" in rest:
        at = rest.index("::")
        return Query(_names(rest[:at]), _type(rest[at + 1 :]), scopes)
    return Query([], _type(rest), scopes)


_LITERALS = ("exact", "package", "module")


def parse_tag(category: str, value: str) -> tuple[str, str] | None:
    """The canonical (category, value) of a scope; keys may be abbreviated. None where it cannot be read."""
    short = lambda x, literal: x != "" and literal.startswith(x.lower())
    if short(category, "is"):
        return next((("is", v) for v in _LITERALS if short(value, v)), None)
    for key in ("package", "module"):
        if short(category, key):
            return (key, value) if value else None
    return (category, value) if value else None


def render_query(q: Query) -> str:
    """The query as text, canonical scopes last, ignored scopes struck out with tildes."""
    scopes = [f"{'' if s.include else '-'}{s.category}:{s.value}" for s in q.scopes]
    from vireo.functions.signatures import pretty

    sig = q.signature
    return " ".join([*q.names, *([":: " + pretty(sig)] if sig else []), *scopes, *(f"~~{x}~~" for x in q.ignored)])
