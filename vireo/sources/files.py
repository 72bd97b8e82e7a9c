"""Archives, directories, declaration files, sets and settings as DataFrames."""

from __future__ import annotations

import io
import re
import tarfile
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from enum import Enum
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vireo.functions import scalars as X
from vireo.functions.signatures import GrammarError, items_of, parse_declaration, preorder

FILE = "path string, body binary"


# archives and folders


def _members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for content in f["content"]:
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                for m in tar:
                    if m.isfile():
                        yield pd.DataFrame({"path": [m.name], "body": [tar.extractfile(m).read()]})


def archive(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of the regular files of tar archives, compressed or not. Archives are read in parallel; a bad one is
    an error."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_members, FILE)


def folder(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, body) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path"), F.col("content").alias("body"))


def declaring(files: DataFrame) -> DataFrame:
    """(path, body, package) of the files ``name.txt`` that declare the package they are named after."""
    package = F.regexp_extract("path", r"([^/]*)\.txt$", 1)
    line = F.concat(F.lit("@package "), package)
    return files.withColumn("package", package).where((package != "") & F.contains(F.decode("body", "UTF-8"), line))


def path_order(path: Column) -> Column:
    """Paths as what they sort by: folder names by name and then by version, number by number, greatest first."""
    number = lambda v: F.transform(F.split(v, r"\."), lambda x: F.lpad((F.lit(10**9) - x.cast("bigint")).cast("string"), 10, "0"))
    version = lambda p: F.regexp_extract(p, r"-([0-9]{1,9}(?:\.[0-9]{1,9})*)$", 1)
    part = lambda p: F.when(version(p) == "", p).otherwise(F.concat_ws("\0", F.regexp_replace(p, r"-[0-9.]+$", ""), F.array_join(F.concat(number(version(p)), F.array(F.lit("~"))), ".")))
    return F.array_join(F.transform(F.split(path, "/"), part), "\1")


def latest_files(files: DataFrame) -> DataFrame:
    """Of ``name/version/...`` paths the file of each name's greatest version."""
    parts = F.split("path", "/")
    rows = files.select("path", "body", F.element_at(parts, -3).alias("package"), F.element_at(parts, -2).alias("version"))
    number = F.transform(F.split("version", r"\."), lambda x: x.try_cast("int"))
    return rows.where(F.size(F.split("path", "/")) >= 3).groupBy("package").agg(F.max_by(F.struct("path", "body", "version"), number).alias("r")).select("package", "r.*")


class Download(Enum):
    ALWAYS = "always"
    NEVER = "never"
    MISSING = "missing"


def download(url: str, target: str, policy: Download = Download.MISSING, fetch=urllib.request.urlretrieve) -> str:
    """A file fetched to ``target`` by the policy: into a ``.part`` file that is renamed when it is whole."""
    path = Path(target)
    if policy is Download.NEVER or policy is Download.MISSING and path.exists():
        if not path.exists():
            raise FileNotFoundError(f"{target} is missing and must not be downloaded")
        return target
    part = path.with_name(path.name + ".part")
    fetch(url, str(part))
    part.rename(path)
    return target


# lines and declarations


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no, raw) of text bodies, numbered from 1, without carriage returns at line ends."""
    text = F.decode("body", "UTF-8")
    text = F.regexp_replace(text, "\n$", "")
    rows = files.where(F.length("body") > 0).select("path", F.posexplode(F.split(text, "\n")).alias("i", "raw"))
    return rows.select("path", (F.col("i") + 1).alias("line_no"), F.regexp_replace("raw", "\r$", "").alias("raw"))


def repaired(line: str) -> str:
    """A line with instance pragmas, bracketed fields and class bodies brought into the grammar."""
    while m := re.match(r"instance \[(?:incoherent|overlap ok|overlapping|safe)\] ", line):
        line = "instance " + line[m.end() :]
    if line.startswith("(#) "):
        line = "( # ) " + line[4:]
    if m := re.match(r"\[([\w(][^\]]*)\](.*)", line, re.S):
        line = m.group(1) + m.group(2)
    elif m := re.match(r"\[([:$>][^\]]*)\](.*)", line, re.S):
        line = f"({m.group(1)}){m.group(2)}"
    return line.partition(" where ")[0] if line.startswith("class ") else line


@dataclass
class Entry:
    kind: str  # package, module, decl
    name: str
    items: list
    text: str = ""
    names: tuple = ()
    is_signature: bool = False
    is_instance: bool = False


def read_line(line: str) -> list[Entry]:
    """The entries of a line; a signature of several names is split. GrammarError if it is none."""
    if line.startswith("@"):
        word, _, rest = line[1:].partition(" ")
        if word == "package" and len(rest.split()) == 1:
            return [Entry("package", rest.strip(), [("package", rest.strip(), None)], f"package {rest.strip()}", (rest.strip(),))]
        if word == "version":
            return []
        raise GrammarError(f"unknown attribute {line}")
    if line.startswith("module "):
        name = line[7:].strip()
        return [Entry("module", name, [("module", name, None)], line, (name,))]
    d = parse_declaration(line)
    if d.kind == "fixity":
        return []
    if d.kind == "sig":
        kind = line.split("::", 1)[1].strip()
        out = []
        for n in d.names:
            shown = n if re.match(r"[\w]", n) else f"({n})"
            out.append(Entry("decl", n, [i for i in items_of(d) if i[0] == "signature" or i[1] == n], f"{shown} :: {kind}", (n,), True))
        return out
    return [Entry("decl", d.names[0] if d.names else "", items_of(d), line, tuple(d.names), False, d.kind == "instance")]


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")


def render(e: Entry) -> str:
    """An entry as HTML with its name marked."""
    mark = lambda x: f"<s0>{_escape(x)}</s0>"
    if e.kind == "package":
        return f"<b>package</b> <span class=name>{mark(e.name)}</span>"
    if e.kind == "module":
        pre, dot, post = e.name.rpartition(".")
        return f"<b>module</b> {_escape(pre + dot)}<span class=name>{mark(post)}</span>"
    body = _escape(e.text)
    if len(e.names) == 1 and (at := e.text.find(e.names[0])) >= 0:
        pre, post = e.text[:at], e.text[at + len(e.names[0]) :]
        if pre.endswith("(") and post.startswith(")"):
            body = f"{_escape(pre[:-1])}<span class=name>({mark(e.names[0])})</span>{_escape(post[1:])}"
        else:
            body = f"{_escape(pre)}<span class=name>{mark(e.names[0])}</span>{_escape(post)}"
    for word in ("type family", "class", "data", "type", "newtype"):
        if body.startswith(word + " "):
            return f"<b>{word}</b> {body[len(word) + 1 :]}"
    return body


NODES = "array<struct<tag:string,name:string,nargs:int>>"
CONTEXT = "array<struct<cls:string,var:string>>"
ENTRY = f"path string, line_no int, entry_no int, entry string, name string, url string, docs string, item string, is_signature boolean, is_instance boolean, part_no int, kind string, part_name string, ctx {CONTEXT}, tree {NODES}, n_types int, warning string"


def entries_of(path: str, body: str) -> Iterator[tuple]:
    """Rows of one declaration file. Comments that follow a ``-- |`` line, and ``@url``, belong to the next declaration;
    blank lines, ``}`` and default methods drop them."""
    docs: list[str] = []
    url = ""
    for line_no, s in enumerate(body.split("\n"), 1):
        s = s[:-1] if s.endswith("\r") else s
        if s == "}" or s.startswith("($dm"):
            docs, url = [], ""
        elif s.startswith("-- | "):
            text = s[5:]
            if text.startswith("&lt;math&gt;"):
                text = text[12:].removeprefix(". ")
            docs = [text]
        elif s.startswith("--") or s.startswith("    --"):
            if docs:
                docs.append(s.removeprefix("    ").removeprefix("--").lstrip())
        elif s.startswith("@url "):
            url = s[5:]
        elif not s.strip():
            docs, url = [], ""
        else:
            try:
                found = read_line(repaired(s))
            except (GrammarError, RecursionError) as e:
                yield (path, line_no, 0, "warning", None, None, None, None, False, False, 0, "warning", None, None, None, None, f"{line_no}: {e or s}")
                found = []
            for i, e in enumerate(found):
                for j, (kind, name, sig) in enumerate(e.items):
                    ctx = None if sig is None else [{"cls": c, "var": v} for c, v in sig.ctx]
                    tree = None if sig is None else [{"tag": t, "name": n, "nargs": k} for t, n, k in preorder(sig.types)]
                    yield (path, line_no, i, e.kind, e.name, url, "".join(x + "\n" for x in docs), render(e), e.is_signature, e.is_instance, j, kind, name, ctx, tree, None if sig is None else len(sig.types), None)
            docs, url = [], ""


def _entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in re.split(r", (?![^<]*>)", ENTRY)]
    for f in frames:
        for path, body in zip(f["path"], f["body"]):
            rows = []
            for row in entries_of(path, bytes(body).decode("utf-8", "replace")):
                rows.append(row)
                if len(rows) == 5000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)


def parse_files(files: DataFrame) -> DataFrame:
    """Entries of declaration files: a row per part (signature, name, alias, instance, module, package) of each entry, and
    a row per warning. A file is parsed by one task, files in parallel."""
    return files.select("path", "body").mapInPandas(_entries, ENTRY)


def hierarchy(entries: DataFrame, package_url: str = X.package_url.__defaults__[0]) -> DataFrame:
    """Entries with their package and module carried forward and urls completed; a package's url is its file's ``base``, where
    there is one. A new package resets the module; instances have no target."""
    e = entries.where("entry <> 'warning'")
    home = F.concat(F.lit(package_url), "name")
    docs = F.lit("/docs/")
    if "base" in e.columns:
        home = F.coalesce("base", home)
        docs = F.when(F.endswith("base", F.lit("/")) | F.contains("base", F.lit("~ghc")), "").otherwise(docs)  # docs lie at the base itself
    url = F.when(F.col("url") != "", F.col("url"))
    anchor = F.when(F.col("name") != "", X.anchor(F.col("name"), F.col("is_signature"))).otherwise(F.lit(""))
    own = F.coalesce(url, F.when(F.col("entry") == "package", home).when(F.col("entry") == "module", F.concat(docs, F.replace("name", F.lit("."), F.lit("-")), F.lit(".html"))).otherwise(anchor))
    e = e.withColumn("url", own)
    w = Window.partitionBy("path").orderBy("line_no", "entry_no", "part_no").rowsBetween(Window.unboundedPreceding, 0)
    pair = F.struct("name", "url")
    e = e.withColumn("package_no", F.sum((F.col("entry") == "package").cast("int")).over(w))
    e = e.withColumn("package", F.last(F.when(F.col("entry") == "package", pair), ignorenulls=True).over(w))
    w = Window.partitionBy("path", "package_no").orderBy("line_no", "entry_no", "part_no").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("module_no", F.sum((F.col("entry") == "module").cast("int")).over(w))
    e = e.withColumn("module", F.last(F.when(F.col("entry") == "module", pair), ignorenulls=True).over(w))
    # a package is part of nothing, a module of its package only
    e = e.withColumn("own_package", F.when(F.col("entry") != "package", F.col("package"))).withColumn("own_module", F.when(F.col("entry") == "decl", F.col("module")))
    return e.withColumn("has_target", ~F.col("is_instance"))


def warnings(entries: DataFrame) -> DataFrame:
    return entries.where("entry = 'warning'").select("path", "line_no", "warning")


# package metadata


def parse_metadata(files: DataFrame) -> DataFrame:
    """Package descriptions as rows: package, version, synopsis, is_library, depends, tags (category, value), docs_dir.
    Fields may go on over indented lines; an unreadable file gives a row of defaults."""
    schema = "package string, version string, synopsis string, is_library boolean, depends array<string>, tags array<struct<category:string,value:string>>, docs_dir string, ok boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([metadata_of(p, bytes(b).decode("utf-8", "replace")) for p, b in zip(f["path"], f["body"])], columns=["package", "version", "synopsis", "is_library", "depends", "tags", "docs_dir", "ok"])

    return files.select("path", "body").mapInPandas(run, schema)


def metadata_fields(text: str) -> list[tuple[str, str]]:
    """(name in lower case, value) of ``name: value`` fields and (section, rest) of section heads, in order."""
    out: list[tuple[str, str]] = []
    indent = 0
    for raw in text.replace("\r", "").replace("\t", "    ").split("\n"):
        if not raw.strip() or raw.strip().startswith("--"):
            continue
        depth = len(raw) - len(raw.lstrip())
        m = re.match(r"\s*([A-Za-z][\w-]*)\s*:(.*)", raw)
        section = re.match(r"\s*(library|executable|test-suite|benchmark|foreign-library|common|flag|source-repository|custom-setup|if|else|elif)\b(.*)", raw, re.I)
        if m and not (out and depth > indent and ":" in m.group(2)[:1]):
            out.append((m.group(1).lower(), m.group(2).strip()))
            indent = depth
        elif section and not m:
            out.append(("#" + section.group(1).lower(), section.group(2).strip()))
            indent = depth
        elif out and depth > indent and not out[-1][0].startswith("#"):
            out[-1] = (out[-1][0], (out[-1][1] + "\n" + raw.strip()).strip())
    return out


def clean_authors(text: str) -> list[str]:
    out = []
    for part in re.split(r"[,&]", text):
        words: list[list[str]] = [[]]
        for w in part.split():
            if w == "and":
                words.append([])
            else:
                words[-1].append(w)
        for ws in words:
            name = "-".join(w for w in re.split(r"[<(]", " ".join(ws))[0].split() if "@" not in w)
            if name:
                out.append(name)
    return out


def metadata_of(path: str, text: str) -> tuple:
    stem = Path(path).stem
    fields = metadata_fields(text)
    one = dict(reversed([(k, v) for k, v in fields]))
    if not one.get("name"):
        return (stem, "0.0", "", False, [], [], None, False)
    depends: list[str] = []
    for k, v in fields:
        if k == "build-depends":
            depends += [m.group(1) for d in v.replace("\n", " ").split(",") if (m := re.match(r"\s*([A-Za-z0-9][\w-]*)", d))]
    tags = [("license", x.strip("() ")) for x in re.split(r"\s+OR\s+", one.get("license", "")) if x.strip("() ") and x.strip("() ").upper() != "NONE"]
    tags += [("category", x) for x in re.split(r"[ ,\n]", one.get("category", "")) if x]
    tags += [("author", x) for k in ("author", "maintainer") for x in clean_authors(one.get(k, ""))]
    tags = list(dict.fromkeys(tags))
    library = any(k == "#library" for k, _ in fields) or one.get("exposed-modules", "") != ""
    version = ".".join(re.findall(r"\d+", one.get("version", "").strip())) or "0.0"
    return (one["name"].strip(), version, " ".join(one.get("synopsis", "").split()), library, list(dict.fromkeys(depends)), [{"category": c, "value": v} for c, v in tags], one.get("haddock-html"), True)


def installed(spark: SparkSession, path: str) -> DataFrame:
    """A dump of installed packages, records apart by ``---`` lines, as (path, body) of package descriptions; all of them
    are libraries."""
    text = spark.read.option("lineSep", "\n---").text(path)  # three dashes inside a line are text
    body = F.regexp_replace(F.regexp_replace("value", "\r", ""), r"^(?:---)?\s+", "")
    rows = text.select(body.alias("body")).where(F.startswith("body", F.lit("name:")))
    name = F.trim(F.regexp_extract("body", r"^name:\s*(\S+)", 1))
    parsed = parse_metadata(rows.select(name.alias("path"), F.encode("body", "UTF-8").alias("body")))
    return parsed.withColumn("is_library", F.lit(True))


# sets and settings


def constraint_set(spark: SparkSession, path: str) -> DataFrame:
    """Names of ``name version`` lines of a constraints file, which are indented after the first, on the field's line."""
    t = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"^constraints:", "")).alias("v"), F.col("value").rlike(r"^(constraints:|\s)").alias("inside"))
    return t.where("inside and v <> '' and not startswith(v, '--')").select(F.regexp_extract("v", r"^(\S+)", 1).alias("package")).distinct()


def release_set(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """Names of ``incLib "name"`` lines of a release source, and of ``incGHCLib`` lines; of the latter alone if ``bundled``."""
    name = F.regexp_extract("value", r'^\s*,\s*inc' + ("GHC" if bundled else "(?:GHC)?") + r'Lib\s+"([^"]+)"', 1)
    return spark.read.text(path).select(name.alias("package")).where("package <> ''").distinct()


class SettingError(ValueError):
    pass


def read_settings(text: str, file: str = "settings") -> tuple[list[tuple[str, str]], list[tuple[str, str, int]]]:
    """(renames, module priorities) of a settings text, in order; blank and ``--`` lines are skipped, a bad line is an
    error that names it."""
    renames, modules = [], []
    for i, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.startswith("--"):
            continue
        if m := re.fullmatch(r'RenameTag\s+"((?:[^"\\]|\\.)*)"\s+"((?:[^"\\]|\\.)*)"\s*', line):
            renames.append((m.group(1), m.group(2)))
        elif m := re.fullmatch(r'ReorderModule\s+"([^"]*)"\s+"([^"]*)"\s+\(?(-?\d+)\)?\s*', line):
            modules.append((m.group(1), m.group(2), int(m.group(3))))
        else:
            raise SettingError(f"{file}:{i}: not a setting: {line}")
    return renames, modules


def settings_frames(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """Settings as two small frames, with their order."""
    renames, modules = read_settings(text)
    return (
        spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(renames)], "old string, new string, ord int"),
        spark.createDataFrame([(p, m, k, i) for i, (p, m, k) in enumerate(modules)], "package_pattern string, module_pattern string, priority int, ord int"),
    )


def keyword_page(html: str) -> str:
    """A page of keywords (headings with an id, text below) as a declaration file."""
    out = ["@package keyword", "", ""]
    for m in re.finditer(r"<h[1-6][^>]*>(?P<head>.*?)</h[1-6]>(?P<body>.*?)(?=<h[1-6]|\Z)", html, re.S | re.I):
        anchor = re.search(r'id="?([^"\s>]+)', m.group(0))
        words = [w for w in re.split(r"[,\s]+", re.sub(r"<[^>]+>", "", m.group("head"))) if w and w not in ("and", "or")]
        docs = [ln.strip() for ln in re.sub(r"<(?!/?(?:b|i|pre|tt|a)\b)[^>]+>", "", m.group("body")).strip().split("\n") if ln.strip()]
        for w in words:
            out += [f"-- | {docs[0]}" if docs else "-- | ", *(f"--   {d}" for d in docs[1:])]
            out += [f"@url #{anchor.group(1)}"] if anchor else []
            shown = w if re.match("[a-z_]", w) else f"({w})"
            out += [f"{shown} :: Keyword", ""]
    return "\n".join(out) + "\n"
