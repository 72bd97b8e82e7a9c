"""Building, opening and searching an index, end to end on small corpora."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from tests.test_sources import archive
from vireo.__main__ import main
from vireo.plans import output, samples
from vireo.plans.index import VERSION, IndexError_, build, open_index
from vireo.sources import composed, files

LONG = "__start__" + "some_very_long_name_" * 20 + "__middle__" + "x" * 200 + "__end__"
CORPUS = {
    "/d/anna.txt": f"@package anna\n\nmodule Notes\n\n@url http://anna.example?long\n{LONG} :: a -> b\n",
    "/d/berta-1.11/berta.txt": "@url http://old.example/\n@package berta\n@version 1.11\n\nmodule Notes\n\n@url #kin\ntype family Kin (a :: Parent)\nstone :: Bool\n",
    "/d/berta-1.2/berta.txt": "@url http://new.example/\n@package berta\n@version 1.2\n\nmodule Notes\n@url #kin\ntype family Kin (a :: Parent)\n",
}


@pytest.fixture(scope="module")
def sample(spark):
    return samples.sample_index(spark)


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    texts = files.declaring(samples.files(spark, CORPUS))
    return build(spark, texts, f"file://{tmp_path_factory.mktemp('index')}/i", sets={"all": texts, "d": texts})


def found(index, text):
    return [r["item"].split("<s0>")[1].split("</s0>")[0] for r in index.search(text).orderBy("rank").collect()]


@pytest.mark.parametrize("text", ["__start__", "__end__", "__middle__"])
def test_long_names_are_found_by_any_part(tiny, text):
    assert tiny.search(text).first()["url"] == "http://anna.example?long"


def test_two_versions_of_a_package(tiny):
    rows = tiny.search("Kin").orderBy("rank").collect()
    # the greater version, 1.11, comes first; its url is relative to its package's
    assert [r["url"] for r in rows] == ["http://old.example//docs/Notes.html#kin", "http://new.example//docs/Notes.html#kin"]
    texts = [r["text"] for r in tiny.completions.orderBy("ord").collect()]
    assert texts == ["set:all", "set:d", "package:anna", "package:berta"]


@pytest.mark.parametrize(
    "text,names",
    [
        ("each", ["each", "each"]),
        ("each is:ping", ["each", "each"]),
        ("each package:more", ["each"]),
        ("each -package:core", ["each"]),
        ("each +mor", ["each"]),
        ("each package:nowhere", []),
        ("each module:No.Such", []),
        ("Base.List.each", ["each"]),
        ("Base.Types.(<+>)", ["&lt;+&gt;"]),
        ("fi", ["find", "first", "safeFirst"]),
        ("First", ["first", "safeFirst"]),
        ("first is:exact", ["first"]),
        ("length", ["length"]),
        ("Bool", ["Bool"]),
        ("set:even", ["core"]),
        ("author:Bea", ["core"]),
        ("category:Lists", ["more"]),
        ("set:-even", ["more", "quiet"]),
        ("", ["core", "more", "quiet"]),
        ("is:module", ["Types", "List", "List"]),
        ("quiet", ["quiet"]),
        ("(a -> b) -> [a] -> [b]", ["each", "each", "flipped"]),
        ("[a] -> (a -> b) -> [b]", ["flipped", "each", "each"]),
        ("[a] -> a", ["first", "safeFirst"]),
        ("first :: [a] -> Maybe a", ["safeFirst"]),
        ("[a] -> Maybe a", ["safeFirst"]),
    ],
)
def test_search(sample, text, names):
    assert found(sample, text) == names


@pytest.mark.parametrize("text,name", [("Ord a => [a] -> [a]", "sorted"), ("[(a, b)] -> a -> Maybe b", "find")])
def test_among_the_results(sample, text, name):
    assert name in found(sample, text)


def test_brackets_alone(sample):
    sample.search("( )").collect()


def test_docs_urls_and_warnings(sample):
    r = sample.search("each package:core").first()
    assert r["docs"] == "Apply a function to every element,\nin order.\n"
    assert r["url"] == "https://packages.example/package/core/docs/Base-List.html#v:each"
    assert r["module"]["url"] == "https://packages.example/package/core/docs/Base-List.html"
    assert sample.search("couples").first()["url"].endswith("#special") and sample.search("pairs").first()["url"].endswith("#special")
    assert sample.search("quiet").first()["docs"] == "Says nothing"
    assert [(w["line_no"]) for w in sample.warnings.collect()] == [7]


def test_explain_shows_every_signature(sample):
    rows = sample.explain_types("[a] -> a").collect()
    assert len(rows) == sample.sigs.count() and any(r["fp_cost"] == 0 for r in rows)


def test_outputs(sample):
    r = sample.search("each")
    rows = json.loads(output.json_array(r))
    assert [x["package"]["name"] for x in rows] == ["core", "more"]
    assert json.loads(output.json_array(sample.search("core")))[0]["package"] == {}
    back = output.from_json(output.to_json(r)).orderBy("rank").collect()
    assert [tuple(x) for x in back] == [tuple(x) for x in r.orderBy("rank").collect()]
    assert output.distinct_lines(r, 1) == (["Base.List each :: (a -> b) -> [a] -> [b]"], True)
    group = output.grouped(r).collect()
    assert len(group) == 1 and [(p["package"], p["modules"]) for p in group[0]["packages"]] == [("core", ["Base.List"]), ("more", ["More.List"])]
    assert output.json_page(lambda n, start: sample.search("each", n, start), start=2).count() == 1


def test_paging_starts_at_the_start(sample):
    whole = [r["url"] for r in sample.search("i").orderBy("rank").collect()]
    parts = [r["url"] for s in (1, 3, 5) for r in sample.search("i", 2, s).orderBy("rank").collect()]
    assert parts == whole[:6]


def test_facets_and_sizes(sample):
    assert [(r["category"], r["value"]) for r in sample.facets("each").orderBy("ord").collect()] == [("is", "exact"), ("package", "core"), ("package", "more")]
    assert [(r["category"], r["value"]) for r in sample.facets("each +more").orderBy("ord").collect()] == [("is", "exact")]
    sizes = {r["label"]: r["total"] for r in sample.sizes().collect()}
    assert sizes["Total"] == sum(v for k, v in sizes.items() if k != "Total") > 0


def test_broken_indexes(spark, sample, tmp_path):
    with pytest.raises(IndexError_, match="no index"):
        open_index(spark, f"file://{tmp_path}/none")
    shutil.copytree(sample.path.removeprefix("file://"), tmp_path / "i")
    manifest = tmp_path / "i/manifest.json"
    (tmp_path / "i/.manifest.json.crc").unlink(missing_ok=True)
    good = manifest.read_text()
    for text, message in ((good.replace(f'"version": {VERSION}', '"version": 7'), "format 7"), ("{", "damaged"), (good.replace('"sigs"', '"other"'), "lacks sigs")):
        manifest.write_text(text)
        with pytest.raises(IndexError_, match=message):
            open_index(spark, f"file://{tmp_path}/i")
    manifest.write_text(good)
    (tmp_path / "i/names/_SUCCESS").unlink()
    with pytest.raises(IndexError_, match="names is incomplete"):
        open_index(spark, f"file://{tmp_path}/i")


def test_empty_corpus(spark, tmp_path):
    index = build(spark, samples.files(spark, {"/x.txt": ""}), f"file://{tmp_path}/e")
    assert index.items.count() == 0 and index.search("a").count() == 0 and index.search("a -> b").count() == 0


def test_a_failed_build_leaves_nothing_and_an_index_is_not_overwritten(spark, sample, tmp_path):
    with pytest.raises(IndexError_, match="already"):
        build(spark, samples.files(spark, CORPUS), sample.path)
    assert sample.search("each").count() == 2
    bad = samples.files(spark, CORPUS).withColumn("body", F.raise_error(F.lit("broken disk")).cast("binary"))
    with pytest.raises(Exception, match="broken disk"):
        build(spark, bad, f"file://{tmp_path}/f")
    assert not [p for p in tmp_path.glob("f/*")]


def test_tag_tables(sample):
    rows = {(r["package"], r["module"]): (r["lo"], r["hi"]) for r in sample.containers.collect()}
    items = sample.items.select("item_id", "in_package", "in_module").collect()
    for (package, module), span in rows.items():
        own = [r["item_id"] for r in items if r["in_package"] == package and module in (None, r["in_module"])]
        assert span == (min(own), max(own))
    assert ("core", "Base.List") in rows and ("quiet", None) in rows
    categories = {(r["category"], r["value"]): [tuple(x) for x in r["ranges"]] for r in sample.categories.collect()}
    assert categories["set", "even"] == [rows["core", None]] and categories["category", "Lists"] == [rows["more", None]]


def test_compared_types(sample):
    rows = {r["text"]: r for r in sample.compare_types("[a] -> a", ["[a] -> a", "[b] -> Maybe b", "Bool"]).collect()}
    assert rows["[a] -> a"]["fp_cost"] == 0 and rows["[a] -> a"]["work"] is not None
    assert rows["[b] -> Maybe b"]["fp_cost"] > 0 and rows["[b] -> Maybe b"]["work"] is None and rows["Bool"]["fp_cost"] is None


def test_timing_and_warnings(sample):
    assert {r["label"] for r in sample.timing().collect()} == {"Total", "parse", "items", "names", "signatures", "tags"} and sample.n_warnings == 1
    assert {r["label"]: r["total"] for r in sample.sizes().collect()}["overhead"] > 0


def test_all_results_are_numbered(sample):
    rows = sample.search("i", None).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and [r["url"] for r in rows] == [r["url"] for r in sample.search("i", 500).orderBy("rank").collect()]
    assert [r["rank"] for r in sample.search("i", None, 3).orderBy("rank").collect()] == list(range(3, len(rows) + 1))


def _run(capsys, *args):
    main([str(a) for a in args])
    return capsys.readouterr().out.strip().split("\n")


def test_command_line(spark, sample, tmp_path, capsys):
    search = lambda *args: _run(capsys, "search", sample.path, *args)
    assert search("each", "--numbers", "--link", "--no-colour")[0].startswith("1) Base.List each :: (a -> b) -> [a] -> [b] -- https://packages.example/package/core/")
    assert "\033[93meach\033[0m" in search("each", "--colour")[0]
    assert search("nothing-like-it") == ["No results found"]
    assert len(json.loads("\n".join(search("e", "--json")))) == sample.search("e", 500).count() > 10
    assert len(search("i", "--jsonl", "-n", "3")) == 3
    lines = search("e")
    assert len(lines) == 11 and lines[-1] == "-- more results follow; --count=20 shows more"
    assert sum(line == "core Base.List" for line in search("i", "--info", "-n", "2")) <= 2 and search("each", "--info")[1] == "core Base.List"
    assert search("each", "--repeat", "2", "-n", "1").count("-- more results follow; --count=11 shows more") == 2
    assert any("Maybe" in line for line in search("[a] -> a", "--compare", "[a] -> a", "[a] -> Maybe a"))


def _dump(docs):
    return f"name: core\nversion: 1.0\nhaddock-html: {docs}/core\nlicense: MIT\ndescription: three --- dashes\n---\nname: absent\nversion: 3\nhaddock-html: {docs}/absent\n---\nname: bare\nversion: 2\n"


def test_sources_of_a_machine(spark, tmp_path):
    docs = tmp_path / "docs"
    for folder in ("core", "core-1.0"):
        (docs / folder).mkdir(parents=True)
        (docs / folder / "core.txt").write_text(samples.FILES["/core/1.0/core.txt"])
    (tmp_path / "dump").write_text(_dump(docs))
    found = composed.installed(spark, f"file://{tmp_path}/dump")
    assert [(r["path"].rsplit("/", 2)[-2], r["base"]) for r in found.files.collect()] == [("core", f"file://{docs}/core/")]
    assert sorted(r["package"] for r in found.wanted.collect()) == ["absent", "bare", "core"] and set(found.sets) == {"curated", "installed"}
    index = build(spark, found.files, f"file://{tmp_path}/a", found.metadata, found.sets, found.wanted)
    assert index.search("each").first()["url"] == f"file://{docs}/core/Base-List.html#v:each"
    assert {r["text"] for r in index.completions.collect()} >= {"set:curated", "set:installed"}
    moved = composed.relocatable(spark, f"file://{tmp_path}/dump", str(docs))
    assert [r["base"] for r in moved.files.collect()] == ["core-1.0/"]
    none = composed.relocatable(spark, f"file://{tmp_path}/dump", str(tmp_path / "nowhere"))
    assert none.files.count() == 0


def test_sources_of_folders_and_one_file(spark, tmp_path):
    d = tmp_path / "lib"
    d.mkdir()
    for n in ("core", "more"):
        (d / f"{n}.txt").write_text(next(t for p, t in samples.FILES.items() if n in p))
    (d / "other.txt").write_text("@package elsewhere\n")
    (d / "more.cabal").write_text(samples.METADATA["/more.cabal"])
    found = composed.directories(spark, [str(d)])
    assert sorted(r["package"] for r in found.wanted.collect()) == ["core", "more"]
    assert {k: [r["package"] for r in v.collect()] for k, v in found.sets.items()} == {"all": ["core"], "lib": ["core"]}
    assert {r["base"] for r in found.files.collect()} == {f"file://{d}/"}
    assert [r["package"] for r in found.limited(count=1).wanted.collect()] == ["core"] and [r["package"] for r in found.limited(["more"]).wanted.collect()] == ["more"]
    one = composed.single(spark, str(d / "core.txt"), "core", "http://other.example/")
    index = build(spark, one.files, f"file://{tmp_path}/o", one.metadata, one.sets, one.wanted)
    assert index.search("each").first()["url"].startswith("http://other.example/Base-List.html")


def test_published_source(spark, tmp_path):
    archive(tmp_path / "texts.tar.gz", {"core/1.0/core.txt": samples.FILES["/core/1.0/core.txt"], "more/2.1/more.txt": samples.FILES["/more/2.1/more.txt"]})
    archive(tmp_path / "described.tar.gz", {"core/1.0/core.cabal": samples.METADATA["/core.cabal"], "core/0.9/core.cabal": "name: core\nversion: 0.9\n", "more/2.1/more.cabal": samples.METADATA["/more.cabal"]})
    (tmp_path / "constraints").write_text("constraints: core ==1.0,\n             zip ==2\n")
    (tmp_path / "release").write_text('  , incGHCLib "core" "1.0"\n  , incLib "more" "2.1"\n')
    found = composed.published(spark, f"file://{tmp_path}/texts.tar.gz", f"file://{tmp_path}/described.tar.gz", [f"file://{tmp_path}/constraints"], f"file://{tmp_path}/release", always=("compiler",))
    assert sorted(r["package"] for r in found.wanted.collect()) == ["compiler", "core", "more", "zip"]
    assert {k: sorted(r["package"] for r in v.collect()) for k, v in found.sets.items()} == {"curated": ["core", "zip"], "platform": ["core", "more"], "bundled": ["core"]}
    assert {(r["package"], r["version"]) for r in found.metadata.collect()} == {("core", "1.0"), ("more", "2.1")} and found.files.count() == 2
