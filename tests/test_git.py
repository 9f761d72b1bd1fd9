import subprocess

import pytest

from lorekeep.operators import index
from lorekeep.sources import gitlog


@pytest.fixture
def repo(tmp_path):
    path = tmp_path / "r"
    path.mkdir()

    def git(*args):
        return subprocess.run(["git", "-C", str(path), "-c", "user.name=t", "-c", "user.email=t@example.com", *args], check=True, capture_output=True, text=True).stdout.strip()

    def commit(message, **files):
        for name, body in files.items():
            (path / name).write_bytes(body)
        git("add", "-A"), git("commit", "-q", "--allow-empty", "-m", message)
        return git("rev-parse", "HEAD")

    git("init", "-q")
    return path, git, commit


ODD = {"é a.md": b"x\ny\nz\n", "tab\tand\nline.md": b"1\n", "b.bin": bytes(range(256))}


def history(repo):
    path, git, commit = repo
    one = commit("add(ws): one", **ODD, **{"old.md": b"a\nb\nc\nd\n"})
    git("mv", "old.md", "new.md"), git("rm", "-q", "é a.md")
    two = commit("two", **{"tab\tand\nline.md": b"1\n2\n"})
    three = commit("three")
    return {
        (one, "A", "é a.md", None, 3, 0), (one, "A", "tab\tand\nline.md", None, 1, 0), (one, "A", "b.bin", None, 0, 0), (one, "A", "old.md", None, 4, 0),
        (two, "R", "new.md", "old.md", 0, 0), (two, "D", "é a.md", None, 0, 3), (two, "M", "tab\tand\nline.md", None, 1, 0),
    }, [one, two, three]


@pytest.mark.parametrize("size", [1, 2, 2000])
def test_changes_in_partitions(spark, repo, monkeypatch, size):
    monkeypatch.setattr(gitlog, "COMMITS", size)
    expected, hashes = history(repo)
    options = {"path": str(repo[0])}
    for changes, found in ((True, expected), (False, set(hashes))):
        reader = gitlog._Reader(options, changes)
        parts = reader.partitions()
        assert len(parts) == -(-3 // size)
        rows = [r for p in parts for r in reader.read(p)]
        assert len(rows) == len(found) and {r if changes else r[0] for r in rows} == found
    assert sum(len(list(reader.read(p))) for p in gitlog._Reader({**options, "days": "1"}, False).partitions()) == 3


def test_sources_and_orphans(spark, repo):
    path, git, _ = repo
    expected, _ = history(repo)
    gitlog.register(spark)
    changes = spark.read.format("gitchanges").load(str(path))
    assert {tuple(r) for r in changes.collect()} == expected
    chunks = spark.createDataFrame([("é a.md",), ("é a.md",), ("lost.md",), ("new.md",)], "path string")
    files = spark.createDataFrame([("new.md",)], "path string")
    got = index.orphans(chunks, files, files.limit(0), gitlog.deleted_paths(changes))
    assert {tuple(r) for r in got.collect()} == {("é a.md", 2, True), ("lost.md", 1, False)}
    (path / "staged.md").write_text("s\n")
    git("add", "staged.md")
    assert [tuple(r) for r in spark.read.format("gitchanges").option("staged", True).load(str(path)).collect()] == [("", "A", "staged.md", None, 1, 0)]
    for name in ("gitlog", "gitchanges"):
        assert spark.read.format(name).load(str(path.parent / "none")).count() == 0
        assert spark.read.format(name).option("staged", True).load(str(path.parent / "none")).count() == 0


def test_failures_are_not_empty_results(repo):
    history(repo)
    reader = gitlog._Reader({"path": str(repo[0])}, True)
    with pytest.raises(RuntimeError):
        list(reader.read(gitlog.Commits(["0" * 40])))
    with pytest.raises(RuntimeError):
        gitlog._Stream({"path": str(repo[0])}, True).partitions({"commit": "0" * 40}, {"commit": repo[1]("rev-parse", "HEAD")})


def test_stream_of_commits(spark, repo, tmp_path):
    path, git, commit = repo
    gitlog.register(spark)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        spark.readStream.format("gitchanges").load(str(path)).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r.hash, r.path) for r in spark.read.schema("hash string, path string").parquet(out).collect())

    a = commit("a", f=b"1\n")
    assert run() == [(a, "f")]
    b, c = commit("b", g=b"1\n"), commit("c", f=b"2\n")
    assert run() == sorted([(a, "f"), (b, "g"), (c, "f")])
    git("reset", "-q", "--hard", b)
    d = commit("d", h=b"1\n")  # history was rewritten: c is gone, d is new
    assert run() == sorted([(a, "f"), (b, "g"), (c, "f"), (d, "h")]) == run()
