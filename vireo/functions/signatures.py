"""Type and declaration grammar: text to trees, trees to signatures, signatures to text and to preorder arrays.

Types are tuples: ("con", name), ("var", name), ("app", f, x), ("fun", a, b), ("list", t), ("parr", t),
("tuple", boxed, parts), ("forall", context, t), ("infix", a, operator, b), ("paren", t), ("kind", t), ("bang", t) and
("other",) for anything that a signature cannot hold. Signature terms are ``Ty``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple


class GrammarError(ValueError):
    """The text is not of the grammar."""


class Ty(NamedTuple):
    tag: str  # con or var
    name: str
    args: tuple = ()


class Sig(NamedTuple):
    ctx: tuple[tuple[str, str], ...]
    types: tuple[Ty, ...]


@dataclass
class Decl:
    """kind: sig, pattern, alias, data, newtype, class, family, datafamily, instance, fixity"""

    kind: str
    names: list[str] = field(default_factory=list)
    binders: list[str] = field(default_factory=list)
    type: tuple | None = None


_SYMBOL = r"!#$%&*+./<=>?@\\^|~:\-"
_TOKEN = re.compile(
    rf"""\s+|(?P<tick>'(?=[\[(A-Z:]))|(?P<num>\d+)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<chr>'(?:[^'\\]|\\.)')
    |(?P<implicit>\?[a-z_][\w']*)
    |(?P<con>(?:[^\W\d_a-z][\w']*\#*\.)*[^\W\d_a-z][\w']*\#*)
    |(?P<var>(?:[^\W\d_a-z][\w']*\.)+[a-z_][\w']*\#*|[^\W\dA-Z][\w']*\#*)
    |(?P<uopen>\(\#(?![{_SYMBOL}]))|(?P<uclose>\#\))|(?P<popen>\[:(?![{_SYMBOL}]))|(?P<pclose>:\])
    |(?P<op>(?:[{_SYMBOL}]|[^\W\w]|[^\s\w()\[\]{{}},;`"'])+)|(?P<punct>[()\[\]{{}},;`])""",
    re.X,
)
_RESERVED = {"->", "=>", "::", "=", "|", "→", "⇒", "∷", "⊸", "%1->"}
_SAME = {"→": "->", "⇒": "=>", "∷": "::", "★": "*", "⊸": "->"}


def _tokens(text: str, unboxed: bool) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise GrammarError(f"bad character at {at}: {text}")
        kind, word = m.lastgroup, m.group()
        if kind in ("uopen", "uclose") and not unboxed:
            kind, word = ("punct", "(") if kind == "uopen" else ("op", "#")
            m = re.compile(re.escape(word)).match(text, at)
        if kind == "con" and not word[0].isupper() and not word[0].istitle():
            kind = "var" if word[0].isalpha() else kind
        if kind:
            word = _SAME.get(word, word)
            out.append((kind, word))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str, unboxed: bool = True, star: bool = True, query: bool = False):
        self.t, self.i, self.star, self.query = _tokens(text, unboxed), 0, star, query

    def peek(self, ahead: int = 0) -> str:
        return self.t[self.i + ahead][1] if self.i + ahead < len(self.t) else ""

    def kind(self, ahead: int = 0) -> str:
        return self.t[self.i + ahead][0] if self.i + ahead < len(self.t) else ""

    def next(self) -> str:
        if self.i >= len(self.t):
            raise GrammarError("unexpected end")
        self.i += 1
        return self.t[self.i - 1][1]

    def take(self, word: str) -> bool:
        if self.i < len(self.t) and self.t[self.i][1] == word and self.t[self.i][0] != "str":
            self.i += 1
            return True
        return False

    def expect(self, word: str) -> None:
        if not self.take(word):
            raise GrammarError(f"expected {word}, found {self.peek() or 'the end'}")

    def done(self) -> None:
        if self.i < len(self.t):
            raise GrammarError(f"unexpected {self.peek()}")

    # types

    def type(self) -> tuple:
        if self.peek() in ("forall", "∀"):
            self.next()
            while not self.take("."):
                if self.peek() == "->":
                    self.next()
                    break
                self.binder()
            inner = self.type()
            return ("forall", (), inner)
        left = self.infix()
        if self.take("=>"):
            return ("forall", self.context(left), self.type())
        if self.take("->"):
            return ("fun", left, self.type())
        if self.peek() in ("%1", "%") and self.kind() == "op":
            while self.i < len(self.t) and self.next() != "->":
                pass
            return ("fun", left, self.type())
        return left

    def binder(self) -> str:
        if self.take("(") or self.take("{"):
            name = self.next()
            if self.take("::"):
                self.type()
            if not (self.take(")") or self.take("}")):
                raise GrammarError("unclosed binder")
            return name
        if self.kind() == "var":
            return self.next()
        if self.take("@"):
            return self.binder()
        raise GrammarError(f"not a binder: {self.peek()}")

    def is_operator(self) -> bool:
        k, w = self.kind(), self.peek()
        if w == "`" or k == "tick" and self.kind(1) == "op":
            return True
        if k != "op" or w in _RESERVED or w == "!":
            return False
        return not (w == "*" and self.star) and w not in ("%1", "%") and not (w == "." and self.query)

    def operator(self) -> tuple[str, bool]:
        promoted = self.kind() == "tick"
        if promoted:
            self.next()
        if self.take("`"):
            name = self.next()
            self.expect("`")
            return name, promoted
        return self.next(), promoted

    def infix(self) -> tuple:
        left = self.application()
        while self.is_operator():
            if self.peek() == "~" and self.star is None:
                break
            name, promoted = self.operator()
            right = self.application()
            left = ("other",) if name in ("~", "~~") or promoted else ("infix", left, name, right)
        return left

    def starts_atom(self) -> bool:
        k, w = self.kind(), self.peek()
        if k in ("con", "num", "str", "chr", "uopen", "popen"):
            return True
        if k == "var":
            return w not in ("forall", "∀", "where", "family")
        if k == "tick":
            return self.kind(1) != "op" or self.peek(1).startswith(":") is False
        return w in ("(", "[", "!") or w == "*" and self.star or w == "~" and self.starts_lazy()

    def starts_lazy(self) -> bool:
        return False

    def application(self) -> tuple:
        if self.peek() in ("!", "~") and self.kind() == "op":
            self.next()
            return ("bang", self.application_tail(self.atom()))
        if self.peek() == "{" and self.peek(1) == "-":  # pragma such as UNPACK
            while self.next() != "}":
                pass
            return self.application()
        return self.application_tail(self.atom())

    def application_tail(self, f: tuple) -> tuple:
        while self.starts_atom():
            f = ("app", f, self.atom())
        return f

    def atom(self) -> tuple:
        k, w = self.kind(), self.next()
        if k == "con":
            return ("con", w)
        if k == "var":
            return ("other",) if w == "_" and not self.query else ("var", w)
        if k in ("num", "str", "chr"):
            return ("other",)
        if k == "tick":
            self.atom()
            return ("other",)
        if w == "*" and k == "op":
            return ("con", "*")
        if w == "!" and k == "op":
            return ("bang", self.atom())
        if k == "implicit":
            self.expect("::")
            self.type()
            return ("other",)
        if k == "uopen":
            if self.take(","):
                n = 1
                while self.take(","):
                    n += 1
                self.close("#)")
                return ("con", "(#" + "," * n + "#)")
            if self.kind() == "uclose":
                self.next()
                return ("con", "(##)")
            parts = [self.type()]
            if self.peek() == "|":
                while self.take("|"):
                    self.type()
                self.close("#)")
                return ("other",)
            while self.take(","):
                parts.append(self.type())
            self.close("#)")
            return ("tuple", False, tuple(parts)) if len(parts) > 1 else ("paren", parts[0])
        if k == "popen":
            inner = self.type()
            self.close(":]")
            return ("parr", inner)
        if w == "[":
            if self.take("]"):
                return ("con", "[]")
            inner = self.type()
            if self.take(","):
                self.type()
                while self.take(","):
                    self.type()
                self.expect("]")
                return ("other",)
            self.expect("]")
            return ("list", inner)
        if w == "(":
            if self.take(")"):
                return ("con", "()")
            if self.peek() == ",":
                n = 0
                while self.take(","):
                    n += 1
                self.expect(")")
                return ("con", "(" + "," * n + ")")
            if self.kind() == "op" and self.peek(1) == ")" and not (self.peek() == "*" and self.star):
                name = self.next()
                self.next()
                return ("con", name)
            inner = self.type()
            if self.take("::"):
                self.type()
                self.expect(")")
                return ("kind", inner)
            parts = [inner]
            while self.take(","):
                parts.append(self.type())
            self.expect(")")
            return ("tuple", True, tuple(parts)) if len(parts) > 1 else ("paren", inner)
        raise GrammarError(f"unexpected {w}")

    def close(self, word: str) -> None:
        if self.next() != word:
            raise GrammarError(f"expected {word}")

    def context(self, t: tuple) -> tuple:
        if t[0] == "tuple":
            return tuple(t[2])
        if t == ("con", "()"):
            return ()
        return (t,)

    # declarations

    def name(self) -> str:
        if self.take("("):
            commas = ""
            while self.take(","):
                commas += ","
            if commas or self.peek() == ")":
                self.expect(")")
                return f"({commas})"
            k, w = self.kind(), self.next()
            self.expect(")")
            if k not in ("op", "var", "con"):
                raise GrammarError("not a name")
            return w
        if self.kind() in ("var", "con"):
            return self.next()
        raise GrammarError(f"not a name: {self.peek()}")

    def head(self) -> tuple[str, list[str]]:
        """A declared type's name with its binders; the name may be infix or in brackets."""
        tuple_name = self.peek() == "(" and self.peek(1) in (",", ")")
        if not tuple_name and (self.kind() in ("var",) or self.peek() == "(" and not (self.kind(1) == "op" and self.peek(2) == ")")):
            at = self.i
            try:
                a = self.binder()
                if self.is_operator():
                    name, _ = self.operator()
                    return name, [a, self.binder()]
            except GrammarError:
                pass
            self.i = at
            self.expect("(")
            name, bound = self.head()
            self.expect(")")
        else:
            name, bound = self.name(), []
        while self.peek() in ("(", "@", "{") or self.kind() == "var" and self.peek() not in ("where", "family"):
            bound.append(self.binder())
        return name, bound

    def optional_context(self) -> None:
        depth = 0
        for j in range(self.i, len(self.t)):
            w = self.t[j][1]
            depth += w in "([" and len(w) == 1
            depth -= w in ")]" and len(w) == 1
            if w == "=>" and not depth:
                self.infix()
                self.expect("=>")
                return
            if w in ("::", "=", "|", "where") and not depth:
                return

    def optional_kind(self) -> None:
        if self.take("::"):
            self.type()

    def declaration(self) -> Decl:
        w = self.peek()
        if w in ("infix", "infixl", "infixr") and self.kind(1) != "op" or w in ("infixl", "infixr"):
            self.i = len(self.t)
            return Decl("fixity")
        if w == "type" and self.peek(1) == "family":
            self.i += 2
            name, bound = self.head()
            if self.take("="):
                if self.take("("):
                    self.binder()
                    self.optional_kind()
                    self.expect(")")
                else:
                    self.binder()
                if self.take("|"):
                    self.i = len(self.t)
            else:
                self.optional_kind()
            self.take("where")
            return Decl("family", [name], bound)
        if w == "type":
            self.next()
            name, bound = self.head()
            self.optional_kind()
            self.expect("=")
            return Decl("alias", [name], bound, self.type())
        if w == "data" and self.peek(1) == "family":
            self.i += 2
            name, bound = self.head()
            self.optional_kind()
            return Decl("datafamily", [name], bound)
        if w in ("data", "newtype"):
            self.next()
            self.optional_context()
            name, bound = self.head()
            self.optional_kind()
            self.take("where")
            return Decl(w, [name], bound)
        if w == "class":
            self.next()
            self.optional_context()
            name, bound = self.head()
            if self.take("|"):
                self.i = len(self.t)
            return Decl("class", [name], bound)
        if w == "instance":
            self.next()
            t = self.type()
            return Decl("instance", [], [], t)
        if w == "pattern" and self.peek(1) != "::" and self.peek(1) != ",":
            self.next()
            names = [self.name()]
            while self.take(","):
                names.append(self.name())
            self.expect("::")
            return Decl("pattern", names, [], self.type())
        names = [self.name()]
        while self.take(","):
            names.append(self.name())
        self.expect("::")
        return Decl("sig", names, [], self.type())


def _attempts(text: str):
    text = text.strip()
    text = text[:-1] if text.endswith(";") else text
    yield text, True, True
    if "#" in text:
        yield text, False, True
    if "*" in text:
        yield text, True, False
    if "#" in text and "*" in text:
        yield text, False, False


def _first(text: str, rule, query: bool = False):
    error: GrammarError | None = None
    for t, unboxed, star in _attempts(text):
        try:
            p = _Parser(t, unboxed, star, query)
            out = rule(p)
            p.done()
            return out
        except GrammarError as e:
            error = error or e
    raise error or GrammarError("empty")


def parse_type(text: str, query: bool = False) -> tuple:
    return _first(text, _Parser.type, query)


def _fields_unbanged(t: tuple) -> tuple:
    if t[0] == "fun":
        a = t[1]
        if a[0] == "bang":
            a = a[1][1] if a[1][0] == "paren" and a[1][1][0] == "app" else a[1]
        return ("fun", a, _fields_unbanged(t[2]))
    if t[0] == "forall":
        return ("forall", t[1], _fields_unbanged(t[2]))
    return t


def _record(text: str) -> Decl | None:
    """``Con :: { a :: X, b :: Y } -> T`` as the signature of the constructor."""
    m = re.fullmatch(r"\s*(\(?[^\s:{}]+\)?)\s*::\s*\{(.*)\}\s*->\s*(.+)", text)
    if not m:
        return None
    parts, depth, now = [], 0, ""
    for ch in m.group(2):
        depth += (ch in "([") - (ch in ")]")
        if ch == "," and not depth and "::" in now:
            parts.append(now)
            now = ""
        else:
            now += ch
    parts += [now] if now.strip() else []
    t = parse_type(m.group(3))
    for p in reversed(parts):
        names, _, kind = p.partition("::")
        field_type = parse_type(kind)
        for _ in names.split(","):
            t = ("fun", field_type, t)
    return Decl("sig", [m.group(1).strip("()")], [], t)


def parse_declaration(text: str) -> Decl:
    """One declaration; a signature that starts with an upper-case letter or a bracket is a constructor, whose fields
    lose their strictness marks."""
    text = re.sub(r"\{-#.*?#-\}", " ", text)
    if not text.strip():
        raise GrammarError("empty")
    if text[0].isupper() or text[0] == "(":
        found = _record(text)
        d = found or _first(text, _Parser.declaration)
        if d.kind == "sig" and d.type:
            d.type = _fields_unbanged(d.type)
        return d
    return _first(text, _Parser.declaration)


# signatures


def _apply(t: Ty, x: Ty) -> Ty:
    return t._replace(args=(*t.args, x))


def _term(t: tuple) -> Ty:
    kind = t[0]
    if kind == "con" or kind == "var":
        return Ty(kind, t[1])
    if kind == "app":
        return _apply(_term(t[1]), _term(t[2]))
    if kind == "fun":
        return Ty("con", "->", tuple(_arrows(t)))
    if kind == "list":
        return Ty("con", "[]", (_term(t[1]),))
    if kind == "parr":
        return Ty("con", "[::]", (_term(t[1]),))
    if kind == "tuple":
        commas = "," * (len(t[2]) - 1)
        return Ty("con", f"({commas})" if t[1] else f"(#{commas}#)", tuple(map(_term, t[2])))
    if kind == "forall":
        return Ty("con", "\\/", (_term(t[2]),))
    if kind == "infix":
        return Ty("con", t[2], (_term(t[1]), _term(t[3])))
    if kind in ("paren", "kind", "bang"):
        return _term(t[1])
    return Ty("var", "_")


def _arrows(t: tuple) -> list[Ty]:
    if t[0] == "paren":
        return _arrows(t[1])
    if t[0] == "fun":
        return [_term(t[1]), *_arrows(t[2])]
    return [_term(t)]


def _constraint(t: tuple) -> list[tuple[str, str]]:
    while t[0] == "paren":
        t = t[1]
    if t[0] == "infix":
        args, head = [t[1], t[3]], ("con", t[2])
    else:
        args, head = [], t
        while head[0] == "app":
            args.insert(0, head[2])
            head = head[1]
    return [(head[1], args[0][1])] if head[0] == "con" and args and args[0][0] == "var" else []


def to_signature(t: tuple) -> Sig:
    """Contexts and terms of a type: outer foralls and contexts flattened, arguments then result."""
    while t[0] == "paren":
        t = t[1]
    if t[0] == "forall":
        inner = to_signature(t[2])
        return Sig(tuple(c for x in t[1] for c in _constraint(x)) + inner.ctx, inner.types)
    return Sig((), tuple(_arrows(t)))


def items_of(d: Decl) -> list[tuple[str, str | None, Sig | None]]:
    """(kind, name, signature) rows of a declaration."""
    if d.kind == "sig":
        return [("signature", None, to_signature(d.type)), *(("name", n, None) for n in d.names)]
    if d.kind == "alias":
        return [("alias", d.names[0], to_signature(d.type))]
    if d.kind == "instance":
        return [("instance", None, to_signature(d.type))]
    return [("name", n, None) for n in d.names]


def pretty_type(t: Ty, inner: bool = False) -> str:
    if t.name == "->" and t.tag == "con" and len(t.args) > 1:
        text = " -> ".join(pretty_type(a, a.name == "->") for a in t.args)
        return f"({text})" if inner else text
    if t.tag == "con" and t.name == "[]" and len(t.args) == 1:
        return f"[{pretty_type(t.args[0])}]"
    if t.tag == "con" and re.fullmatch(r"\(,+\)", t.name) and len(t.args) == len(t.name) - 1:
        return "(" + ",".join(pretty_type(a) for a in t.args) + ")"
    name = t.name if re.match(r"[\w(\[]", t.name) else f"({t.name})"
    if not t.args:
        return name
    text = " ".join([name, *(pretty_type(a, True) for a in t.args)])
    return f"({text})" if inner else text


def pretty(s: Sig) -> str:
    ctx = [f"{c} {v}" for c, v in s.ctx]
    head = "" if not ctx else f"{ctx[0]} => " if len(ctx) == 1 else f"({', '.join(ctx)}) => "
    return head + " -> ".join(pretty_type(t, t.name == "->" and len(s.types) > 1) for t in s.types)


def preorder(types) -> list[tuple[str, str, int]]:
    """(tag, name, number of arguments) of every node, in preorder over all terms."""
    out, stack = [], list(reversed(types))
    while stack:
        t = stack.pop()
        out.append((t.tag, t.name, len(t.args)))
        stack += reversed(t.args)
    return out


def from_preorder(nodes) -> tuple[Ty, ...]:
    """The terms that ``preorder`` flattened."""
    nodes = list(nodes)
    stack: list[Ty] = []
    for tag, name, nargs in reversed(nodes):
        args = tuple(stack.pop() for _ in range(nargs))
        stack.append(Ty(tag, name, args))
    return tuple(reversed(stack))
