"""python -m vireo: build an index, search it, replay and summarise logs."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vireo.functions.querylang import parse_query

from vireo.operators import logs
from vireo.plans import output
from vireo.plans.index import Index, build, open_index
from vireo.session import session
from vireo.sources import composed, files


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vireo")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate", help="build an index from a folder of declaration files and package descriptions, or a tar archive")
    g.add_argument("source")
    g.add_argument("index")
    g.add_argument("--metadata", help="tar archive of package descriptions; a folder holds its own")
    g.add_argument("--constraints", help="constraints file: a package set")
    g.add_argument("--release", help="release source: a package set")
    g.add_argument("--settings", help="file of tag renames and module priorities")
    g.add_argument("--packages", nargs="*", help="only these packages")
    g.add_argument("--count", "-n", type=int, help="only the first packages by name")
    g.add_argument("--local", nargs="*", help="more folders; the source is then a dump of installed packages if none is named")
    g.add_argument("--haddock", help="root of relocatable docs; the source is a dump of installed packages")
    g.add_argument("--base", help="the source is one file of declarations whose urls start here")
    g.add_argument("--debug", action="store_true", help="print the seconds of each phase and the bytes of each table")
    s = sub.add_parser("search", help="search an index")
    s.add_argument("index")
    s.add_argument("query", nargs="+")
    s.add_argument("--json", action="store_true")
    s.add_argument("--jsonl", action="store_true")
    s.add_argument("--info", action="store_true", help="the first results at length, one unless --count says more")
    s.add_argument("--explain", action="store_true", help="cost parts of every signature")
    s.add_argument("--compare", nargs="+", help="cost parts of these signatures")
    s.add_argument("--link", action="store_true", help="the url of each result")
    s.add_argument("--numbers", action="store_true", help="number the results")
    s.add_argument("--colour", "--color", action=argparse.BooleanOptionalAction, help="mark the names of the query; by default on a terminal")
    s.add_argument("--repeat", type=int, default=1, help="open the index and search this many times")
    s.add_argument("--count", "-n", type=int, help="results at most: 10 lines, or all as JSON, by default")
    s.add_argument("--start", type=int, default=1)
    r = sub.add_parser("replay", help="run a log's queries again, timed")
    r.add_argument("index")
    r.add_argument("log")
    sub.add_parser("log", help="daily summary of a log").add_argument("log")
    return p


def _source(spark: SparkSession, a: argparse.Namespace) -> composed.Source:
    if a.haddock:
        return composed.relocatable(spark, a.source, a.haddock)
    if a.base:
        return composed.single(spark, a.source, os.path.basename(a.source).split(".")[0], a.base)
    if a.local is not None and not a.local:
        return composed.installed(spark, a.source)
    if a.source.endswith((".tar", ".tar.gz", ".tgz")):
        if a.metadata:
            found = composed.published(spark, a.source, a.metadata, [a.constraints] if a.constraints else [], a.release)
            return found if found.sets else composed.Source(found.files, found.metadata, None)
        return composed.Source(files.archive(spark, a.source), None, None)
    found = composed.directories(spark, [a.source, *(a.local or [])])
    found.wanted = None
    if a.constraints:
        found.sets["constraints"] = files.constraint_set(spark, a.constraints)
    if a.release:
        found.sets["release"] = files.release_set(spark, a.release)
    return found


def _search(index: Index, a: argparse.Namespace) -> None:
    text = " ".join(a.query)
    if a.explain:
        index.explain_types(text).orderBy(F.col("fp_cost").asc_nulls_last()).show(a.count or 100, False)
    elif a.compare:
        index.compare_types(text, a.compare).select("text", "work", "fp.rare", "fp.arity", "fp.terms", "arity_cost", "terms_cost", "missing_cost", "added_cost", "fp_cost").show(len(a.compare), False)
    elif a.json or a.jsonl:
        rows = output.to_json(index.search(text, a.count, a.start)).orderBy("rank")
        if a.jsonl:
            for row in rows.toLocalIterator():
                print(row["json"])
        else:
            print("[", end="")
            for i, row in enumerate(rows.toLocalIterator()):
                print(("\n," if i else "") + row["json"], end="")
            print("]")
    elif a.info:
        for row in output.info(index.search(text, a.count or 1, a.start)).orderBy("rank").collect():
            print(row["text"] + "\n")
    else:
        lines, more = output.distinct_lines(index.search(text, None, a.start), a.count or output.LINES, a.link)
        if a.colour if a.colour is not None else sys.stdout.isatty():
            lines = [output.coloured(line, parse_query(text).names) for line in lines]
        print("\n".join(f"{i}) {x}" if a.numbers else x for i, x in enumerate(lines, 1)) or "No results found")
        if more:
            print(f"-- more results follow; --count={(a.count or output.LINES) + 10} shows more")


def main(args: list[str] | None = None) -> None:
    a = _parser().parse_args(args)
    spark = session()
    if a.command == "generate":
        settings = "\n".join(r[0] for r in spark.read.text(a.settings).collect()) if a.settings else ""
        found = _source(spark, a).limited(a.packages, a.count)
        index = build(spark, found.files, a.index, found.metadata, found.sets, found.wanted, settings)
        print(f"{index.items.count()} items, {index.n_warnings} warnings")
        if a.debug:
            index.timing().show(100, False)
            index.sizes().show(100, False)
    elif a.command == "search":
        for _ in range(a.repeat):
            _search(open_index(spark, a.index), a)
    elif a.command == "replay":
        index = open_index(spark, a.index)
        asked = [r["query"] for r in logs.replay_queries(spark.read.text(a.log)).collect()]
        began = time.time()
        for q in asked:
            index.search(q).collect()
        took = time.time() - began
        print(f"{len(asked)} queries in {took:.2f} s, {took / max(1, len(asked)):.3f} s each")
    else:
        logs.daily_summary(logs.parse_lines(spark.read.text(a.log))).show(1000, False)


if __name__ == "__main__":
    main()
