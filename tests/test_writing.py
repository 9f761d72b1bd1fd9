from lorekeep import config
from lorekeep.operators import writing


def test_settings():
    s = config.settings_from({"ttl_days": "9", "half_life_days": "x", "capture_enabled": "off", "unknown": 1})
    assert s.ttl_days == 9 and s.half_life_days == 14.0 and not s.captures
    assert config.settings_from(None) == config.Settings() and config.Settings().captures
    assert config.as_bool("maybe", True) and not config.as_bool("NO", True)


def test_workspace_choice():
    assert config.active_workspace(folder="/a/b/c", rules={"/a/x/**": "x", "/a/b/**": "b"}, configured="c") == "b"
    assert config.active_workspace(environment="e", session="s") == "e" and config.active_workspace() == "default"
    assert config.matches("/a/*", "/a/b") and config.matches("/a", "/a/b") and not config.matches("/a", "/ab")


TOPICS = [(1, "caching", "stale cache keys expire")]


def test_lessons(spark):
    rows = writing.lessons_of(spark.createDataFrame([(1, "stale cache keys broke -- waited -- no expiry -- set expiry -- notes"), (2, "no lesson"), (3, "todo -- a -- b -- c")], "id int, text string"))
    assert rows.count() == 2
    topics = spark.createDataFrame(TOPICS, "ord int, slug string, text string")
    chunks = spark.createDataFrame([], "tag string, hash string")
    got = {r.id: r for r in writing.append_lessons(rows.drop("text"), topics, chunks, "2024-01-01").collect()}
    assert got[1].status == "written" and got[1].slug == "caching" and got[1].text.startswith("## 2024-01-01: stale cache keys broke\n**Symptom:**")
    assert got[3].status == "rejected"


def test_tag_backfill(spark):
    df = spark.createDataFrame([("p", "---\ntags: [old]\n---\n- [exp] the `atomic_write` helper broke\n"), ("q", "no entries")], "path string, text string")
    r = writing.tag_backfill(df).collect()
    assert len(r) == 1 and r[0].new[0] == "old" and "atomic_write" in r[0].new


def test_commit_message(spark):
    changes = spark.createDataFrame([("A", "workspaces/w/t/2024-01-02-x.md", 10, 0), ("M", "shared/a.md", 1, 2)], "status string, path string, added int, deleted int")
    added = spark.createDataFrame([(1, "- [decision] use parquet because it is columnar"), (2, "- [ref] z")], "i int, value string")
    removed = spark.createDataFrame([(1, "- [exp] y")], "i int, value string")
    r = writing.commit_message(changes, added, removed, "add").first()
    assert r.subject.startswith("add(w): ") and len(r.subject) <= 72
    assert "Code: record-decision" in r.body and "Entries: +1 decision +1 ref -1 exp" in r.body and "because it is columnar" in r.body


def test_bootstrap_and_dream(spark):
    f = spark.createDataFrame([("p", 1, False, 6000, "a"), ("p", 2, True, 100, "b")], "plan string, ord int, is_delta boolean, chars int, path string")
    assert [r.line for r in writing.bootstrap_report(f, 1000).orderBy("ord").collect()] == ["a: 900/6000 truncated", "b: 100/100 full"]
    activity = spark.createDataFrame([("workspaces/w/t/a.md", 5, 1000.0, ["q1", "q2"], ["d1", "d2"]), ("workspaces/w/t/b.md", 1, 10.0, ["q"], ["d"])], "path string, count int, last_seen double, query_hashes array<string>, days_seen array<string>")
    files = spark.createDataFrame([("workspaces/w/t/a.md", "w", "- [exp] x"), ("workspaces/w/t/b.md", "w", ""), ("workspaces/v/t/c.md", "v", "")], "path string, workspace string, text string")
    got = {r.workspace: r for r in writing.dream(activity, files, 2000.0).collect()}
    assert got["w"].candidates == 1 and got["w"].promote == 1 and got["v"].status == "no_candidates"
