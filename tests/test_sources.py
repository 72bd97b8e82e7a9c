"""Sources, sets, settings, logs, streaming and relations on small inputs."""

import io
import tarfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vireo.operators import logs, names, sequences
from vireo.plans import samples
from vireo.sources import files
from vireo.streaming import daily


def archive(path, members):
    with tarfile.open(path, "w:gz") as t:
        for n, text in members.items():
            info = tarfile.TarInfo(n)
            info.size = len(text.encode())
            t.addfile(info, io.BytesIO(text.encode()))
        inner = tarfile.TarInfo("folder")
        inner.type = tarfile.DIRTYPE
        t.addfile(inner)


def test_archives_and_latest_versions(spark, tmp_path):
    archive(tmp_path / "m.tar.gz", {"a/1.9/a.cabal": "name: a\nversion: 1.9\n", "a/1.10/a.cabal": "name: a\nversion: 1.10\n", "b/2/b.cabal": "nonsense"})
    got = files.archive(spark, str(tmp_path / "m.tar.gz"))
    assert got.count() == 3
    meta = {r["package"]: r for r in files.parse_metadata(files.latest_files(got)).collect()}
    assert meta["a"]["version"] == "1.10" and meta["b"]["version"] == "0.0" and not meta["b"]["ok"]
    (tmp_path / "bad.tar").write_bytes(b"this is no archive")
    with pytest.raises(Exception, match="(?i)tar"):
        files.archive(spark, str(tmp_path / "bad.tar")).count()


def test_metadata(spark):
    text = "name: x\nversion: 1.2\nsynopsis: Some\n  thing\nlicense: BSD3 OR MIT\ncategory: Data, Text\nauthor: Ann Other and Bea <b@x.org>, c@x.org\nlibrary\n  build-depends: base >= 4, text\n    , bytes\n"
    r = files.parse_metadata(samples.files(spark, {"/x.cabal": text})).first()
    assert r["synopsis"] == "Some thing" and r["is_library"] and r["depends"] == ["base", "text", "bytes"]
    assert [(t["category"], t["value"]) for t in r["tags"]] == [("license", "BSD3"), ("license", "MIT"), ("category", "Data"), ("category", "Text"), ("author", "Ann-Other"), ("author", "Bea")]


def test_sets_settings_and_folders(spark, tmp_path):
    (tmp_path / "c").write_text("-- head\nconstraints: a ==1,\n             b ==2,\n             c installed\n")
    (tmp_path / "r").write_text('x = [\n  , incLib "one"\n  , incGHCLib "two"\n  , other "three"\n')
    assert sorted(r[0] for r in files.constraint_set(spark, str(tmp_path / "c")).collect()) == ["a", "b", "c"]
    assert sorted(r[0] for r in files.release_set(spark, str(tmp_path / "r")).collect()) == ["one", "two"]
    assert files.read_settings('-- x\n\nRenameTag "a" "b"\nReorderModule "p" "M.*" (-3)\n') == ([("a", "b")], [("p", "M.*", -3)])
    with pytest.raises(files.SettingError, match="f:2"):
        files.read_settings("\nwrong\n", "f")
    (tmp_path / "d/pkg-1.0").mkdir(parents=True)
    (tmp_path / "d/pkg-1.0/pkg.txt").write_text("@package pkg\n")
    (tmp_path / "d/pkg-1.0/notes.txt").write_text("@package pkg\n")
    assert [r["package"] for r in files.declaring(files.folder(spark, str(tmp_path / "d"))).collect()] == ["pkg"]


def test_downloads(tmp_path):
    target = str(tmp_path / "f")

    def fetch(url, part):
        with open(part, "w") as f:
            f.write(url)

    with pytest.raises(FileNotFoundError):
        files.download("u", target, files.Download.NEVER, fetch)
    assert open(files.download("u", target, fetch=fetch)).read() == "u"
    files.download("v", target, files.Download.MISSING, fetch)
    assert open(target).read() == "u"
    files.download("v", target, files.Download.ALWAYS, fetch)
    assert open(target).read() == "v" and not (tmp_path / "f.part").exists()


def test_lines(spark):
    rows = files.lines(samples.files(spark, {"/a": "x\r\n\ny", "/b": ""})).orderBy("line_no").collect()
    assert [(r["line_no"], r["raw"]) for r in rows] == [(1, "x"), (2, ""), (3, "y")]


LOG = [
    "2020-01-02T10:00:00.000 u1 0.5 /?q=map",
    "2020-01-01T10:00:00.000 u2 1500 /?q=fold",
    "2020-01-02T11:00:00.000 u1 0.25 /?q=zip ERROR: it broke",
    "2020-01-02T11:00:00.000 u3 9 /static ERROR: gone",
    "2020-01-02T11:00:00.000 - 9 /?q=own",
    "2020-01-02T11:00:00.000 u9 9 /?q=map+is:ping",
    "2020-01-02T11:00:00.000 u9 bad /?q=x",
    "garbage",
    "",
]


def test_logs(spark):
    lines = spark.createDataFrame([(x,) for x in LOG], "value string")
    rows = {str(r["day"]): r for r in logs.daily_summary(logs.parse_lines(lines)).collect()}
    a, b = rows["2020-01-01"], rows["2020-01-02"]
    assert (a["users"], a["uses"], a["slowest"], a["errors"]) == (1, 1, 1.5, 0)
    # the error that is no search adds to the count of the average alone
    assert (b["users"], b["uses"], b["slowest"], b["average"], b["errors"]) == (2, 3, 0.5, 0.75 / 4, 2)
    merged = logs.merge_summaries(logs.partial_summary(logs.parse_lines(lines)).unionByName(logs.partial_summary(logs.parse_lines(lines).limit(0))))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, logs.daily_summary(logs.parse_lines(lines)).collect()))
    both = logs.partial_summary(logs.parse_lines(lines)).unionByName(logs.partial_summary(logs.parse_lines(lines)))  # the same users twice
    assert {(str(r["day"]), r["users"], r["uses"]) for r in logs.merge_summaries(both).collect()} == {("2020-01-01", 1, 2), ("2020-01-02", 2, 6)}
    assert logs.replay_queries(lines).count() == 6


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    lines = spark.createDataFrame([(x,) for x in LOG], "value string")
    rows = logs.parse_lines(lines).select("day", "user", "seconds", "is_use", "is_error")
    for i, part in enumerate(rows.collect()):
        spark.createDataFrame([part], rows.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = daily.start(stream, "state", f"{tmp_path}/checkpoint", once=True)
    q.awaitTermination()
    got = daily.summarise(spark.table("state"))
    want = logs.daily_summary(rows)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    q = daily.start_files(stream, f"{tmp_path}/state", f"{tmp_path}/files")
    q.processAllAvailable()
    q.stop()
    got = daily.summarise(daily.latest(spark, f"{tmp_path}/state"))
    assert len(list(tmp_path.glob("state/batch=*"))) > 1 and sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("rows,needles,want", [(["Test", "more", "tex", "xtee"], ["te"], {"tex": 0 + 2, "xtee": 4, "Test": 3}), (["Base", "base"], ["base"], {"base": 0, "Base": 1}), (["a", "b", "", None], [], {"a": 4, "b": 4})])
def test_name_scores(spark, rows, needles, want):
    df = spark.createDataFrame(list(enumerate(rows)), "ord int, name string")
    found = {r["name"]: r["score"] for r in names.search_names(df, needles).collect()}
    assert found == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 12)), min_size=1, max_size=12))
def test_merged_intervals_hold_the_same_points(spark, pairs):
    df = spark.createDataFrame([(1, a, a + n) for a, n in pairs], "k int, lo int, hi int")
    merged = sorted((r["lo"], r["hi"]) for r in sequences.merge_intervals(df, "lo", "hi", ["k"]).collect())
    assert {p for a, z in merged for p in range(a, z + 1)} == {p for a, n in pairs for p in range(a, a + n + 1)}
    assert all(z < a for (_, z), (a, _) in zip(merged, merged[1:]))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 40)), max_size=12), st.lists(st.one_of(st.none(), st.integers(-5, 350)), min_size=1, max_size=40))
def test_points_in_ranges(spark, pairs, points):
    ranges = spark.createDataFrame([(a, a + n) for a, n in pairs], "lo int, hi int")
    df = spark.createDataFrame([(p, i) for i, p in enumerate(points)], "p int, i int")
    found = sorted(r["i"] for r in sequences.point_in_ranges(df, "p", ranges, "lo", "hi").collect())
    assert found == [i for i, p in enumerate(points) if p is not None and any(a <= p <= a + n for a, n in pairs)]


def test_numbers_and_offsets_without_keys(spark):
    df = spark.createDataFrame([((i * 37) % 101, i, i % 7) for i in range(150)], "a int, b int, size int").repartition(6)
    rows = sorted((r["a"], r["b"], r["size"]) for r in df.collect())
    sums = [sum(x[2] for x in rows[:i]) for i in range(len(rows) + 1)]
    number = {r["b"]: r["n"] for r in sequences.number_rows(df, ["a", "b"], 5).collect()}
    before = {r["b"]: r["at"] for r in sequences.prefix_offsets(df, F.col("size"), ["a", "b"]).collect()}
    upto = {r["b"]: r["end"] for r in sequences.inclusive_offsets(df, F.col("size"), ["a", "b"]).collect()}
    for i, (_, b, _) in enumerate(rows):
        assert (number[b], before[b], upto[b]) == (i + 5, sums[i], sums[i + 1])
    assert sequences.number_rows(df.limit(0), ["a"]).count() == 0 and sequences.prefix_offsets(df.limit(0), F.col("size"), ["a"]).count() == 0


def test_dense_ids(spark):
    df = spark.createDataFrame([((i * 37) % 101 if i % 10 else None, i) for i in range(200)], "a int, b int").repartition(7)
    rows = sorted(sequences.dense_ids(df, ["a", "b"]).collect(), key=lambda r: r["id"])
    assert [r["id"] for r in rows] == list(range(200)) and [(r["a"] is not None, r["a"] or 0, r["b"]) for r in rows] == sorted((r["a"] is not None, r["a"] or 0, r["b"]) for r in rows)
