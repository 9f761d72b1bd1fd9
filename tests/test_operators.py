import json

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import index, joins, maintenance, ranking, recall, reports, tags, transcripts
from lorekeep.sources import gitlog, vault


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    import gzip

    root = tmp_path_factory.mktemp("vault")
    texts = {
        "workspaces/w1/topic-a/00-README.md": "---\nslug: topic-a\ntitle: A\ntype: moc\nstatus: active\naliases: [first, 'the a']\ntags:\n- One\n- two\n---\n# A\nbm25 ranking of chunks #rank\n",
        "workspaces/w1/topic-a/2024-01-02-note.md": "---\ntype: aspect\ntags: [x]\n---\n- [exp] the cache broke because of stale keys\n- [ref] see [[topic-b]] and [[w2:topic-c#s|c]] and [[first]] and [[gone]]\n",
        "workspaces/w1/topic-b/topic-b.md": "# B\nstale cache keys and more stale cache keys\n",
        "workspaces/w1/docs/handoff.md": "# H\n",
        "workspaces/w1/workspace.json": "{}",
        "workspaces/w2/topic-c/00-README.md": "# C\nc text\n",
        "workspaces/w2/workspace.json": "{}",
        "shared/tools.md": "- [tool] use `grep`\n",
    }
    for path, body in texts.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body)
    old = root / ".archive/topics/w1/2023-01-01-old-1700000000.md.gz"
    old.parent.mkdir(parents=True)
    old.write_bytes(gzip.compress(b"- [ref] archived words\n"))
    return str(root)


def test_scan(spark, home):
    got = {r.path: r for r in vault.files(spark, home).collect()}
    assert got["shared/tools.md"].workspace == "shared" and got["workspaces/w1/topic-a/00-README.md"].kind == "moc"
    zipped = vault.archives(spark, home).first()
    assert zipped.is_archive and zipped.text.startswith("- [ref] archived")
    assert {r.workspace for r in vault.workspaces(vault.files(spark, home, "*.json")).collect()} == {"w1", "w2"}
    assert {r.path.split("/")[-1] for r in vault.topic_landings(vault.files(spark, home)).collect()} == {"00-README.md", "topic-b.md"}


def test_frontmatter(spark, home):
    r = vault.files(spark, home).filter("kind = 'moc' AND workspace = 'w1'").select(vault.front("text").alias("f"), vault.front_tags("text").alias("t"), vault.body("text").alias("b")).first()
    assert r.f["slug"] == "topic-a" and r.t == ["one", "two"] and r.b.startswith("# A")


def test_index_recall_and_refresh(spark, home, tmp_path):
    files = vault.files(spark, home)
    chunks = index.build_chunks(files).cache()
    got = recall.recall(chunks, "stale cache keys", 5).collect()
    assert [r.path.split("/")[-1] for r in got] == ["topic-b.md", "2024-01-02-note.md"]
    assert got[0].score < got[1].score < 0
    with pytest.raises(ValueError):
        recall.recall(chunks, "the of and")
    assert recall.recall(chunks, "", 2).count() == 2
    assert recall.recall(chunks, "cache", workspace="w2").count() == 0
    index.write_index(chunks, str(tmp_path / "ix"), 4)
    phrases = recall.match_terms(recall.profile("stale cache keys"))
    read = lambda n: spark.read.parquet(str(tmp_path / "ix" / n))
    a = {r.chunk_id: r.score for r in recall.bm25_indexed(read("postings"), read("lengths"), phrases).collect()}
    b = {r.chunk_id: r.score for r in recall.bm25(chunks, phrases).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    moved = files.withColumn("mtime", F.when(F.col("path").contains("topic-b"), F.col("mtime") + 5).otherwise(F.col("mtime"))).filter("workspace <> 'w2'")
    changed = index.changed_paths(chunks, moved)
    assert {r.path.split("/")[-2] for r in changed.collect()} >= {"topic-b", "topic-c"}
    fresh = index.refresh(chunks, moved, changed)
    assert fresh.filter("workspace = 'w2'").count() == 0 and fresh.count() == chunks.filter("workspace <> 'w2'").count()


def test_profile():
    p = recall.profile("why did we drop `_forget.py` in raw_ttl_days yesterday", 7)
    assert p.subject == "_forget.py" and p.answer_type == "decision" and p.temporal and p.boundary == 7
    assert recall.match_terms(p)[0] == ["forget", "py"]


def test_wikilinks_resolve(spark, home):
    files = vault.files(spark, home)
    links = joins.wikilinks(files.select(F.col("workspace").alias("ws"), "text"), ["ws"])
    got = {r.slug: r for r in joins.resolve(links, index.slugs(files), files).collect()}
    assert got["topic-b"].path.endswith("topic-b.md") and got["topic-c"].path == "workspaces/w2/topic-c/00-README.md"
    assert got["first"].path.endswith("topic-a/00-README.md") and got["gone"].broken


def test_contradictions(spark):
    rows = [("a", 1, "- [ref] the payment gateway retry feature is enabled"), ("b", 1, "- [ref] payment gateway retry feature is disabled"), ("c", 1, "- [ref] payment gateway retry feature is not enabled"), ("d", 1, "- [ref] unrelated words enabled")]
    got = joins.contradictions(spark.createDataFrame(rows, "path string, line int, text string")).collect()
    assert {(r.path_a, r.path_b) for r in got} == {("a", "b"), ("a", "c")}
    assert next(r for r in got if r.path_b == "b").shared_entities == ["feature", "gateway", "payment", "retry"]


def test_similar_pairs_as_brute_force(spark):
    import random

    rng = random.Random(2)
    words = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(rng.sample(words, rng.randint(4, 14)))) for i in range(120)]
    sets = {i: set(t.split()) for i, t in rows}
    for low in (0.4, 0.85):
        got = {(r.id_a, r.id_b) for r in joins.similar_pairs(spark.createDataFrame(rows, "id int, text string"), low).collect()}
        assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= low}


def test_prune(spark):
    base = "alpha beta gamma delta epsilon zeta theta"
    rows = [("f", 1, f"- [ref] {base}"), ("f", 2, f"- [ref] {base} x"), ("f", 3, "- [ref] other valid_until: 2020-01-01"), ("f", 4, "- [ref] z (deprecated)"), ("g", 1, f"- [ref] {base}")]
    got = {(r.path, r.line): r.reason for r in maintenance.prune(spark.createDataFrame(rows, "path string, line int, text string"), "2024-01-01").collect()}
    assert got == {("f", 1): None, ("f", 2): "duplicate-newer-dropped", ("f", 3): "expired", ("f", 4): "superseded", ("g", 1): None}


def test_route(spark):
    topics = spark.createDataFrame([(1, "caching", "stale cache keys expire often"), (2, "deploy", "rolling deploy steps")], "ord int, slug string, text string")
    rows = [(1, "- [exp] stale cache keys"), (2, "- [secret-ref] vault"), (3, "- [skill-ref:deploys] x"), (4, "zz"), (5, "- [ref] extraordinary placeholder"), (6, "- [decision] quantum entanglement")]
    got = {r.id: (r.slug, r.section) for r in joins.route(spark.createDataFrame(rows, "id int, text string"), topics).collect()}
    assert got == {1: ("caching", "## [exp]"), 2: ("secrets", None), 3: ("deploys", None), 4: ("misc", None), 5: ("misc", "## [ref]"), 6: ("entanglement-decision", "## [decision]")}


def test_most_shared_equals_all_pairs(spark, monkeypatch):
    import random

    rng = random.Random(4)
    words = ["common", "usual", *(f"word{i}" for i in range(40))]
    draw = lambda: sorted({w for w in rng.choices(words, [30, 20, *[1] * 40], k=rng.randint(0, 9))})
    entries = [(i, draw()) for i in range(150)] + [(900, None), (901, []), (902, ["nowhere"])]
    topics = [(i, f"t{i}", draw()) for i in range(60)] + [(60, "empty", []), (61, "none", None)]
    e, t = spark.createDataFrame(entries, "id int, kw array<string>"), spark.createDataFrame(topics, "ord int, slug string, kw array<string>")
    for rows in (1024, 7):  # frequent words in one part, and dealt out
        monkeypatch.setattr(joins, "LIST_ROWS", rows)
        for least in (1, 3):
            expected = {}
            for i, kw in entries:
                c, _, slug = max((len(set(kw or ()) & set(tw or ())), -o, s) for o, s, tw in topics)
                if c:
                    expected[i] = (c, slug if c >= least else None)
            got = [(r.id, (r.overlap, r.slug)) for r in joins.most_shared(e, t, least, below=True).collect()]
            assert len(got) == len(expected) and dict(got) == expected
            found = {r.id: (r.overlap, r.slug) for r in joins.most_shared(e, t, least).collect()}
            assert found == {i: v for i, v in expected.items() if v[0] >= least}
    assert joins.most_shared(e.limit(0), t, 3, below=True).collect() == [] == joins.most_shared(e, t.limit(0)).collect()


def test_allocate(spark):
    rows = [("p", 1, False, 6000), ("p", 2, False, 100), ("p", 3, True, 3000), ("p", 4, True, 9000)]
    got = {r.ord: (r.take, r.status) for r in ranking.allocate(spark.createDataFrame(rows, "plan string, ord int, is_delta boolean, chars int"), 8000).collect()}
    assert got == {1: (1000, "truncated"), 2: (0, "DROPPED"), 3: (3000, "full"), 4: (4000, "truncated")}


def test_fill_and_tail(spark):
    rows = spark.createDataFrame([(1, 500), (2, 600), (3, 50)], "o int, n int")
    assert {r.o: r["take"] for r in ranking.fill(rows, 900, ["o"], "n").collect()} == {1: 500, 2: 400}
    turns = spark.createDataFrame([("s", 1, 10), ("s", 2, 10), ("s", 3, 100)], "sid string, t int, n int")
    assert [r.t for r in ranking.tail_budget(turns, 50, ["sid"], "t", "n").collect()] == [3]


def test_transcripts(spark, tmp_path):
    lines_ = [
        {"type": "user", "message": {"content": "do it"}}, {"type": "assistant", "message": {"content": [{"type": "thinking", "thinking": "hm\n  ok"}, {"type": "text", "text": "yes"}, {"type": "tool_use", "name": "Read", "input": {"file_path": "/a/b.py"}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "content": "x"}]}}, {"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "Bash", "input": {"command": "ls  -l"}}]}},
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, lines_)) + "\nnot json\n[1]\n")
    m = transcripts.messages(vault.jsonl(spark, str(tmp_path))).cache()
    assert m.count() == 4
    r = transcripts.capture(m).first()
    assert (r.turn_no, r.prompt, r["head"], r.actions, r.thinking) == (1, "do it", "yes", ["Read(b.py)", "Bash(ls -l)"], "hm ok")
    c = transcripts.turn_counts(m).first()
    assert (c.user_turns, c.assistant_turns) == (1, 2)
    assert transcripts.last_turn(m).count() == 4


def test_handoff(spark):
    t = "pre\n## 2024-07-01 a\n- host1: [done] 2024-06-01 x\n  more\n- host2: [doing] 2024-05-01 y\n\n## 2024-06-30b\nz\n## notes\nq"
    got = maintenance.rotate_handoff(spark.createDataFrame([("h", t)], "path string, text string"), "2024-07-19", keep=1).orderBy("i").collect()
    assert [(r.i, r.archived) for r in got] == [(0, False), (1, False), (2, True), (3, False)]
    assert got[1].stale == ["- host1: [done] 2024-06-01 x\n  more"]


def test_changelog(spark):
    rows = [("h1", "add(ws1): x", "Workspace: ws1, ws2\nTopics: a, b\nEntries: +2 decision -1 ref"), ("h2", "odd subject", ""), ("h3", "add(ws1): y", "Entries: -2 decision")]
    c = gitlog.commits(spark.createDataFrame(rows, "hash string, subject string, body string"))
    got = {r.workspace: r for r in reports.changelog(c).collect()}
    assert got["ws1"].commits == 2 and got["ws1"].entries == {"ref": -1} and got["ws1"].topics == ["a", "b"] and got["vault"].types == {"other": 1}


def test_git_source(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "f").write_text("x")
    run("add", "f"), run("commit", "-qm", "add(ws): f\n\nTopics: a")
    gitlog.register(spark)
    r = gitlog.commits(spark.read.format("gitlog").load(str(tmp_path))).first()
    assert r.type == "add" and r.trailers == {"Topics": "a"}
    assert spark.read.format("gitlog").load(str(tmp_path / "none")).count() == 0


def test_tags(spark):
    assert tags.extract("- [tool] use `atomic_write` in _topic.py via --apply for DXY", stop=frozenset({"use", "via", "for"}))[:3] == ["atomic_write", "_topic.py", "apply"]
    assert tags.extract("   ") == [] and tags.extract("x", 0) == []
    got = tags.extract("gold futures: gold futures fall, gold futures rise", stop=frozenset())
    assert got[0] == "gold-futures" and "gold" not in got


def test_validator_and_fix(spark):
    df = spark.createDataFrame([("workspaces/w/t/2024-01-02-my-note.md", "---\ntype: note\n---\nx")], "path string, text string")
    r = df.select(maintenance.issues("path", "text").alias("i"), maintenance.fixed_front("path", "text").alias("f")).first()
    assert "wrong-type:note!=aspect" in r.i and "missing-field:date" in r.i
    assert r.f["date"] == "2024-01-02" and r.f["topic"] == "t" and r.f["type"] == "note"


def test_migration(spark):
    df = spark.createDataFrame([("workspaces/w/t/a.md", "w", 0.0, "x\ny"), ("workspaces/w/t/sub/a.md", "w", 0.0, "y\nz"), ("workspaces/w/n.md", "w", 0.0, "q")], "path string, workspace string, mtime double, text string")
    plan = maintenance.migration_plan(df)
    merged = {r.dst: r.text for r in maintenance.merge_moves(plan, df).collect()}
    assert merged["workspaces/w/t/1970-01-01-a.md"] == "x\ny\nz" and merged["workspaces/w/n/00-README.md"] == "q"


def test_backups(spark):
    df = spark.createDataFrame([("a", 300000.0), ("b", 200000.0), ("c", 100.0)], "path string, mtime double")
    keep = lambda now: {r.path for r in maintenance.prune_backups(df, now).filter("keep").collect()}
    assert keep(300001.0) == {"a", "b"} and keep(900000.0) == {"a"}


def test_opposite_claims_are_all_found_in_any_blocks(spark, monkeypatch):
    import random

    rng = random.Random(5)
    words, said = [f"word{i}" for i in range(12)], ["is enabled", "is not enabled", "disabled", "works", "never broken", "on", "says nothing", "off"]
    rows = [(f"g{i % 3}", i, 1, f"{' '.join(rng.sample(words, 4))} {rng.choice(said)}") for i in range(150)]
    df = spark.createDataFrame(rows, "g string, path int, line int, text string")
    sides = df.select("g", "path", joins.keywords("text").alias("kw"), joins.polarity("text").alias("p"))
    a, b = sides.alias("a"), sides.alias("b")
    met = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.path") < F.col("b.path")) & joins.opposite(F.col("a.p"), F.col("b.p")))
    shared = met.select(F.col("a.path").alias("x"), F.col("b.path").alias("y"), F.size(F.array_intersect("a.kw", "b.kw")).alias("n")).filter("n >= 3")
    expected = sorted(tuple(r) for r in shared.collect())
    assert expected
    for block in (500_000, 256):  # groups share a block, and are cut
        monkeypatch.setattr(joins, "CLAIM_WORDS", block)
        assert sorted((r.id_a.path, r.id_b.path, r.n_shared) for r in joins.opposed_pairs(df, within="g").collect()) == expected


def test_similar_pairs_are_all_found_in_any_blocks(spark, monkeypatch):
    import random

    rng = random.Random(6)
    words = [f"word{i}" for i in range(40)]
    rows = [(i, i % 4, " ".join(rng.sample(words, rng.randint(1, 12)))) for i in range(160)]
    sets = {i: (g, set(t.split())) for i, g, t in rows}
    df = spark.createDataFrame(rows, "id int, g int, text string")
    for block, few in ((4_000_000, 65_536), (700, 5)):
        monkeypatch.setattr(joins, "PREFIX_WORDS", block), monkeypatch.setattr(joins, "FREQUENT", few)
        got = sorted((r.id_a, r.id_b) for r in joins.similar_pairs(df, 0.3, within="g").collect())
        assert got == [(a, b) for a in sets for b in sets if a < b and sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) / len(sets[a][1] | sets[b][1]) >= 0.3]


def test_meetings_of_frequent_words_make_no_rows(spark):
    """400 texts that share eight words: 79,800 pairs meet by each of them, none is similar, and none is written."""
    df = spark.createDataFrame([(i, "that with this from into over under near " + " ".join(f"w{i}x{j}" for j in range(30))) for i in range(400)], "id int, text string")
    assert joins.similar_pairs(df, 0.4).collect() == []
    assert not hasattr(joins, "meetings")


def test_pairs_are_verified_where_they_meet(spark):
    """Candidates once left their task to be joined with both whole sets, a pair a row."""
    df = spark.createDataFrame([(i, f"some words that are said {'again ' * (i % 2)} by text number{i % 3}") for i in range(9)], "id int, text string")
    pairs = joins.similar_pairs(df, 0.4, 0.9)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert pairs.count() and "array_intersect" not in plan and "ws" not in plan.split("FlatMapGroupsInArrow")[0]


def _sent(df, monkeypatch):
    """Numbers of the rows that are sent to cells at a time."""
    counts, dealt = [], type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: (counts.append(self.count()) if "home" in self.columns else None, dealt(self, *a))[1])
    return counts


def _texts(seed, n):
    import random

    rng = random.Random(seed)
    words = [f"word{i}" for i in range(400)]
    base = [rng.sample(words, rng.choice([3, 8, 20, 60, 150])) for _ in range(n // 3)]
    sets = [{*rng.sample(b, rng.randint(len(b) // 2, len(b))), *rng.sample(words, len(b) // 4)} for b in base for _ in range(3)]
    return [(i, " ".join(rng.sample(sorted(s), len(s)))) for i, s in enumerate(sets)], sets


def test_blocks_of_a_large_group_meet_in_passes(spark, monkeypatch):
    rows, sets = _texts(7, 300)
    df = spark.createDataFrame(rows, "id int, text string")
    expected = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(300) for b in range(a + 1, 300)}
    monkeypatch.setattr(joins, "PREFIX_WORDS", 1_000)  # of at least 19,200
    sent = _sent(df, monkeypatch)
    got = {(r.id_a, r.id_b): r.similarity for r in joins.lint_pairs(df).collect()}
    assert got == {p: s for p, s in expected.items() if 0.4 <= s <= 0.85 and 1.0 - s >= 0.15} and len(got) > 100
    assert len(sent) > 3 and max(sent) <= 2 * 300 < sum(sent)


def test_themes_of_a_large_group_are_those_of_all_pairs(spark, monkeypatch):
    rows, sets = _texts(8, 240)
    df = spark.createDataFrame([("w", f"p{i:03}", t, i) for i, t in rows], "workspace string, path string, text string, ord int")
    seeds, of = [], {}
    for i in range(240):
        first = [s for s in seeds if len(sets[s] & sets[i]) / len(sets[s] | sets[i]) > 0.3]
        of[i] = first[0] if first else i
        seeds += [] if first else [i]
    themes = {}
    for seed in seeds:
        members = [i for i in of if of[i] == seed]
        themes["-".join(sorted({w for i in members for w in sorted(sets[i])[:3]})[:3])] = (f"p{seed:03}", len(members))
    monkeypatch.setattr(joins, "PREFIX_WORDS", 3_000)
    sent = _sent(df, monkeypatch)
    assert {r.label: (r.seed, len(r.members)) for r in joins.themes(df).collect()} == themes and len(themes) > 20
    assert sent and max(sent) <= 2 * 240


def test_claims_are_sent_once_for_each_block_of_many(spark, monkeypatch):
    """8,000 claims of one group count 512,000 words, which once were two blocks."""
    rows = [(i, 1, f"this feature number{i % 50} is {'not ' * (i % 2000 == 0)}enabled") for i in range(8_000)]
    df = spark.createDataFrame(rows, "path int, line int, text string")
    sent = _sent(df, monkeypatch)
    pairs = joins.opposed_pairs(df, 2).collect()
    assert len(pairs) == 4 * 7_996 and {r.n_shared for r in pairs} == {2, 3}
    assert sent and max(sent) <= 8_000


def test_tags_of_a_long_entry_take_linear_time():
    import time

    start = time.monotonic()
    assert len(tags.extract(" ".join(f"word{chr(97 + i % 26)}{i}x" for i in range(20_000)))) == tags.SOFT_TOTAL
    assert time.monotonic() - start < 15  # comparing all words with each other takes a minute


def test_runs_of_a_long_text_take_linear_time(spark):
    import time

    from lorekeep.operators import lines

    text = "\n".join(f"key{chr(97 + i // 7 % 26)}: v{i}" for i in range(42_000))
    start = time.monotonic()
    got = spark.createDataFrame([(text,)], "t string").select(lines.group_by_prefix("t").alias("g")).first().g
    assert got.count("\n") == 5_999 and got.startswith("keya: [7 items: v0, v1, v2, v3, v4, +2 more]\nkeyb: [7 items: v7,")
    assert time.monotonic() - start < 15  # every run looked for all runs before


def test_routing_makes_no_row_of_a_word_or_a_pair(spark, monkeypatch):
    monkeypatch.setattr(joins, "LIST_ROWS", 2)
    e = spark.createDataFrame([(i, ["usual", "common", f"w{i}"]) for i in range(40)], "id int, kw array<string>")
    t = spark.createDataFrame([(7, s, ["usual", "common", f"w{k}"]) for k, s in enumerate(["a", "c", "b"])], "ord int, slug string, kw array<string>")
    best = joins.most_shared(e, t, 2)
    assert {r.id: (r.overlap, r.slug) for r in best.collect()} == {i: (3, "acb"[i]) if i < 3 else (2, "c") for i in range(40)}
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "explode(kw" not in plan and "kw" not in plan.split("FlatMapCoGroupsInArrow")[0]
