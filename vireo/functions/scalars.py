"""Scalar functions as Column expressions; Python only where no expression exists."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def starts_upper(c: Column) -> Column:
    """Whether the first character is upper or title case; false for null."""
    return F.coalesce(c.rlike(r"^[\p{Lu}\p{Lt}]"), F.lit(False))


def starts_alpha(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\p{L}"), F.lit(False))


_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def unescape_basic(c: Column) -> Column:
    """The common entities, in the JVM."""
    for entity, char in _ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def unescape_html(c: Column) -> Column:
    """All named and numeric entities."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(html.unescape, na_action="ignore")

    return run(c)


def escape_html(c: Column) -> Column:
    for char, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]:
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def strip_tags(c: Column) -> Column:
    """Tags removed; an unclosed one takes the rest."""
    return F.regexp_replace(c, r"<[^>]*>?", "")


def inner_text(c: Column) -> Column:
    return unescape_basic(strip_tags(c))


def url_encode(c: Column) -> Column:
    """Percent encoding, with a blank as %20."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def url_decode(c: Column) -> Column:
    """Percent decoding with plus as a blank; null where it is malformed."""
    return F.try_url_decode(c)


def query_argument(url: Column, name: str) -> Column:
    return url_decode(F.regexp_extract(url, rf"[?&]{re.escape(name)}=([^&#]*)", 1))


def url_path(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, r"^(?:[a-z]+://[^/]*)?/?([^?#]*)", 1), "/"), lambda x: x != "")


def valid_request(path: Column, keys: Column) -> Column:
    """No path segment is all dots or holds a separator; argument keys are all lower case."""
    bad = F.exists(path, lambda p: p.rlike(r"^\.+$") | p.rlike(r"[/\\]"))
    return ~bad & F.forall(keys, lambda k: k.rlike("^[a-z]+$"))


def anchor(name: Column, is_value: Column) -> Column:
    """``#v:name`` or ``#t:name``; characters that an anchor can't hold become -codepoint-."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    safe = F.transform(chars, lambda c: F.when(c.rlike(r"^[A-Za-z0-9_.:]$"), c).otherwise(F.concat(F.lit("-"), F.ascii(c).cast("string"), F.lit("-"))))
    return F.concat(F.when(is_value, F.lit("#v:")).otherwise(F.lit("#t:")), F.array_join(safe, ""))


def package_url(package: Column, base: str = "https://packages.example/package/") -> Column:
    return F.concat(F.lit(base), package)


def module_url(module: Column) -> Column:
    return F.concat(F.lit("docs/"), F.replace(module, F.lit("."), F.lit("-")), F.lit(".html"))


def last_segment(module: Column) -> Column:
    return F.element_at(F.split(module, r"\."), -1)


def split_pair(c: Column, separator: str = "-") -> Column:
    """(before, after) the first separator; after is null where there is none."""
    at = F.instr(c, separator)
    return F.struct(F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c).alias("before"), F.when(at > 0, F.substring(c, at + len(separator), F.length(c))).alias("after"))


def join_pair(before: Column, after: Column, separator: str = "-") -> Column:
    return F.concat_ws(separator, before, after)


def first_word(c: Column) -> Column:
    """(first word, rest without leading blanks)"""
    t = F.ltrim(c)
    return F.struct(F.regexp_extract(t, r"^(\S*)", 1).alias("word"), F.regexp_extract(t, r"^\S*\s*([\s\S]*)$", 1).alias("rest"))


def natural_version(c: Column) -> Column:
    """``name-1.2.3`` as (name, [1, 2, 3]); no version gives an empty array."""
    name, version = F.regexp_extract(c, r"^(.*?)(?:-(\d+(?:\.\d+)*))?$", 1), F.regexp_extract(c, r"^(.*?)(?:-(\d+(?:\.\d+)*))?$", 2)
    parts = F.when(version == "", F.array().cast("array<int>")).otherwise(F.split(version, r"\.").cast("array<int>"))
    return F.struct(name.alias("name"), parts.alias("version"))


def trim_version(c: Column) -> Column:
    """At most three parts of a dotted version."""
    return F.array_join(F.slice(F.split(c, r"\."), 1, 3), ".")


def strip_prefix(c: Column, prefix: str) -> Column:
    """The rest after the prefix, or null."""
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, F.lit(len(prefix) + 1), F.length(c)))


def nul_joined(c: Column) -> Column:
    return F.concat_ws("\u0000", c)


def nul_split(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, "\u0000"))


def author_names(c: Column) -> Column:
    """Names of an author field: split at commas, ampersands and "and", cut at < or (, e-mail words dropped, words joined
    by dashes."""
    one = F.split(F.regexp_replace(c, r"(?:,|&|(?<!\S)and(?!\S))", "\u0001"), "\u0001")
    cut = F.transform(one, lambda x: F.trim(F.regexp_replace(x, r"[<(].*$", "")))
    words = F.transform(cut, lambda x: F.filter(F.split(x, r"\s+"), lambda w: (w != "") & ~w.contains("@")))
    return F.filter(F.transform(words, lambda w: F.array_join(w, "-")), lambda x: x != "")


def license_names(c: Column) -> Column:
    """Alternatives of a licence expression."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"[()]", ""), r"\s+OR\s+"), F.trim), lambda x: x != "")


def category_names(c: Column) -> Column:
    return F.filter(F.split(c, r"[ ,]"), lambda x: x != "")


def duration_seconds(c: Column) -> Column:
    """With a dot seconds, without milliseconds; 0 where it is no number."""
    x = F.coalesce(c.try_cast("double"), F.lit(0.0))
    return F.when(F.contains(c, F.lit(".")), x).otherwise(x / 1000.0)


def day_of(c: Column) -> Column:
    """The date before the T of a time stamp; null where it is none."""
    return F.split_part(c, F.lit("T"), F.lit(1)).try_cast("date")


def user_hash(c: Column) -> Column:
    return F.xxhash64(c)


def span_name(c: Column) -> Column:
    """The text inside ``<span class=name>``, tags removed; else the first bold-free words."""
    return inner_text(F.regexp_extract(c, r"<span class=name>(.*?)</span>", 1))


def wildcard(c: Column, pattern: str) -> Column:
    """``*`` matches any run; everything else is literal."""
    like = "".join("%" if ch == "*" else "\\" + ch if ch in "%_\\" else ch for ch in pattern)
    return c.like(like)


def wildcard_pattern(c: Column) -> Column:
    """A column of wildcard patterns as LIKE patterns."""
    for ch in ("\\", "%", "_"):
        c = F.replace(c, F.lit(ch), F.lit("\\" + ch))
    return F.replace(c, F.lit("*"), F.lit("%"))


def expand_url(item: Column, module: Column, package: Column) -> Column:
    """An item's url relative to its module's, and that to its package's; a scheme makes it absolute, and an empty url
    stays empty."""
    absolute = lambda u: u.rlike("^[a-z]*:")
    base = F.when(module.isNull(), F.coalesce(package, F.lit(""))).when(absolute(module) | (module == ""), module).otherwise(F.concat(F.coalesce(package, F.lit("")), module))
    return F.when(item.isNull() | (item == ""), F.lit("")).when(absolute(item), item).otherwise(F.concat(base, item))


def strip_math(c: Column) -> Column:
    """Docs without a leading escaped maths marker and the full stop after it."""
    return F.regexp_replace(c, r"^&lt;math&gt;(?:\. )?", "")


def local_docs_url(c: Column, local: str = "file/", remote: str = "file://") -> Column:
    return F.when(F.startswith(c, F.lit(remote)), F.concat(F.lit(local), F.substring(c, F.lit(len(remote) + 1), F.length(c)))).otherwise(c)


def result_line(module: Column, item: Column) -> Column:
    """A result as one line of text: module, then item without markup."""
    return F.concat_ws(" ", module, inner_text(item))


def info_block(line: Column, package: Column, module: Column, docs: Column) -> Column:
    """Line, (package module) and docs, each on lines of their own; absent parts leave no line."""
    return F.concat_ws("\n", line, F.nullif(F.concat_ws(" ", package, module), F.lit("")), F.nullif(F.trim(inner_text(docs)), F.lit("")))


def highlighted(text: str, names: list[str], left: str = "<b>", right: str = "</b>") -> str:
    """At each place the longest name that begins there is marked; runs of marked characters get one pair of marks."""
    low, marked, until = text.lower(), [False] * len(text), 0
    names = sorted((n.lower() for n in names if n), key=len, reverse=True)
    for i in range(len(text)):
        hit = next((len(n) for n in names if low.startswith(n, i)), 0)
        until = max(until, i + hit)
        marked[i] = i < until
    out = []
    for i, ch in enumerate(text):
        if marked[i] and not (i and marked[i - 1]):
            out.append(left)
        out.append(html.escape(ch, quote=True).replace("&#x27;", "&#39;") if left.startswith("<") else ch)
        if marked[i] and not (i + 1 < len(text) and marked[i + 1]):
            out.append(right)
    return "".join(out)


def highlight(c: Column, names: list[str], left: str = "<b>", right: str = "</b>") -> Column:
    """Query names marked in a plain text."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: highlighted(x, names, left, right), na_action="ignore")

    return run(c)


def highlight_item(item: str, names: list[str]) -> str:
    """Query names marked inside the name span of an item's HTML."""
    m = re.search(r"<s0>(.*?)</s0>", item)
    if not m:
        return item
    return item[: m.start()] + highlighted(html.unescape(m.group(1)), names) + item[m.end() :]


def searchable_name(kind: Column, name: Column) -> Column:
    """A package's name, a module's last segment, else the item's name; signatures and instances have none."""
    return F.when(kind == "module", last_segment(name)).when(kind.isin("signature", "instance"), F.lit(None)).otherwise(name)


def compressed(c: Column) -> Column:
    """A value's bytes, compressed one by one. Tables leave that to the Parquet codec."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        import gzip

        return s.map(lambda x: gzip.compress(x.encode(), mtime=0), na_action="ignore")

    return run(c)
