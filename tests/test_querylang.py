"""Query parsing, as data: text, names, type, scopes."""

import pytest

from vireo.functions.querylang import Scope, parse_query, parse_tag
from vireo.functions.signatures import pretty

S = Scope
CASES = [
    ("", [], None, []), ("map", ["map"], None, []), ("#", ["#"], None, []), ("c#", ["c#"], None, []), ("-", ["-"], None, []), ("->", ["->"], None, []),
    ("foldl'", ["foldl'"], None, []), ("fold'l", ["fold'l"], None, []), ("Int#", ["Int#"], None, []), ("concat map", ["concat", "map"], None, []),
    ("a -> b", [], "a -> b", []), ("a->b", [], "a -> b", []), ("(a b)", [], "a b", []), ("map :: a -> b", ["map"], "a -> b", []),
    ("+Data.Map map", ["map"], None, [S(True, "module", "Data.Map")]), ("a -> b package:foo", [], "a -> b", [S(True, "package", "foo")]),
    ("a -> b package:foo-bar", [], "a -> b", [S(True, "package", "foo-bar")]), ("Data.Map.map", ["map"], None, [S(True, "module", "Data.Map")]),
    ("[a]", [], "[a]", []), ("++", ["++"], None, []), ("(++)", ["++"], None, []), (":+:", [":+:"], None, []),
    ("bytestring-cvs +hackage", ["bytestring-cvs"], None, [S(True, "package", "hackage")]), ("m => c", [], "c", []), ("[b ()", [], "[b ()]", []), ("[b (", [], "[b ()]", []),
    ("_ -> a", [], "_ -> a", []), ("(a -> b) ->", [], "(a -> b) -> _", []), ("(a -> b) -", [], "(a -> b) -> _", []), ("Monad m => ", [], "Monad m => _", []),
    ("map is:exact", ["map"], None, [S(True, "is", "exact")]), ("sort set:hackage", ["sort"], None, [S(True, "set", "hackage")]),
    ("sort -set:hackage", ["sort"], None, [S(False, "set", "hackage")]), ("sort set:-hackage", ["sort"], None, [S(False, "set", "hackage")]),
    ("sort -set:-hackage", ["sort"], None, [S(False, "set", "hackage")]), ("package:bytestring-csv", [], None, [S(True, "package", "bytestring-csv")]),
    ("(>>=)", [">>="], None, []), ("(>>=", [">>="], None, []), ("Control.Monad.mplus", ["mplus"], None, [S(True, "module", "Control.Monad")]),
    ("Control.Monad.>>=", [">>="], None, [S(True, "module", "Control.Monad")]), ("Control.Monad.(>>=)", [">>="], None, [S(True, "module", "Control.Monad")]),
    ("(Control.Monad.>>=)", [">>="], None, [S(True, "module", "Control.Monad")]), ("Control.Monad.(>>=", [">>="], None, [S(True, "module", "Control.Monad")]),
    ("foo.bar", ["bar"], None, [S(True, "package", "foo")]), ("insert module:.Map", ["insert"], None, [S(True, "module", ".Map")]),
    ("insert module:Map.", ["insert"], None, [S(True, "module", "Map.")]), ("insert module:.Map.", ["insert"], None, [S(True, "module", ".Map.")]),
    (".Map.insert", ["insert"], None, [S(True, "module", ".Map")]), (".Map.", [], None, [S(True, "module", ".Map")]),
    ("author:Bryan-O'Sullivan", [], None, [S(True, "author", "Bryan-O'Sullivan")]), ("≡", ["≡"], None, []), ("( )", [], None, []),
]


@pytest.mark.parametrize("text,names,kind,scopes", CASES)
def test_parse(text, names, kind, scopes):
    q = parse_query(text)
    assert (q.names, q.scopes) == (names, scopes)
    assert (None if q.signature is None else pretty(q.signature)) == kind


def test_tags():
    assert parse_tag("is", "exact") == parse_tag("i", "ex") == ("is", "exact")
    assert parse_tag("is", "ping") is None and parse_tag("is", "") is None
    assert parse_tag("pack", "base") == ("package", "base") and parse_tag("m", "") is None
    assert parse_tag("author", "Me") == ("author", "Me") and parse_tag("author", "") is None
