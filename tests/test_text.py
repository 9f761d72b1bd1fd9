import pytest
from pyspark.sql import functions as F

from lorekeep.functions import gate, paths, privacy, scores, text
from lorekeep.operators import lines


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "wanted"), [("  A  B\t", "a b"), ("", ""), ("É", "é")])
def test_normalize(spark, given, wanted):
    assert one(spark, text.normalize("t"), t=given) == wanted


def test_char_ngrams(spark):
    assert one(spark, text.char_ngrams("t"), t="abcab c") == ["abc", "bca", "cab", "ab ", "b c"]
    assert one(spark, text.char_ngrams("t"), t="ab") == []
    with pytest.raises(ValueError):
        text.char_ngrams("t", 0)


def test_jaccard(spark):
    assert one(spark, text.jaccard("a", "b"), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)
    assert one(spark, text.jaccard("a", "b"), a=[], b=[]) == 0.0


def test_words_know_letters_of_any_script(spark):
    assert one(spark, text.word_set("t"), t="Café ab naïve ab_cd được") == ["café", "naïve", "ab_cd", "được"]


def test_search_tokens_fold_single_marks(spark):
    assert one(spark, text.search_tokens("t"), t="Café _forget.py ÜBER") == ["cafe", "forget", "py", "uber"]


@pytest.mark.parametrize(("given", "wanted"), [("a #b c  #x #y", "a #b c"), ("#only", ""), ("none", "none"), ("", "")])
def test_strip_tags(spark, given, wanted):
    assert one(spark, text.strip_tags("t"), t=given) == wanted


def test_tag_suffix_round_trip(spark):
    both = text.strip_tags(F.concat("t", text.tag_suffix("g")))
    assert one(spark, both, t="an entry", g=["a", "b-c"]) == "an entry"


@pytest.mark.parametrize(("given", "wanted"), [("Foo Bar!", "foo-bar"), ("--x--", "x"), ("v1.2", "v1.2")])
def test_normalize_tag(spark, given, wanted):
    assert one(spark, text.normalize_tag("t"), t=given) == wanted


def test_collapse_prefixes(spark):
    assert one(spark, text.collapse_prefixes("g"), g=["chop", "chop-mask", "zz"]) == ["chop-mask", "zz"]


@pytest.mark.parametrize(("given", "wanted"), [('a, "b, c", d', ["a", "b, c", "d"]), ("'it''s', x", ["it's", "x"]), ("", [])])
def test_quoted_csv(spark, given, wanted):
    assert one(spark, text.split_quoted_csv("t"), t=given) == wanted


@pytest.mark.parametrize(("given", "parts"), [("a -- b -- c -- d", 5), ("a -- b -- c -- d -- e", 5), ("a -- b", None)])
def test_lesson_parts(spark, given, parts):
    got = one(spark, text.lesson_parts("t"), t=given)
    assert (got and len(got)) == parts


@pytest.mark.parametrize(("given", "ws", "slug"), [("ws:a", "ws", "a"), ("a", None, "a"), (":a", None, "a"), ("a:b:c", "a", "b:c")])
def test_split_token(spark, given, ws, slug):
    got = one(spark, text.split_token("t"), t=given)
    assert (got["ws"], got["slug"]) == (ws, slug)


def test_conflict_markers(spark):
    assert one(spark, text.has_conflict_markers("t"), t="a\n" + "<" * 7 + " x\n")
    assert not one(spark, text.has_conflict_markers("t"), t="<<<<<<<x")


# secrets are put together here, so that none stands in the source
SECRETS = {
    "aws-access-key": "AK" + "IA" + "B" * 16, "github-pat": "ghp" + "_" + "a" * 36, "gitlab-pat": "glpat" + "-" + "a" * 20, "slack-token": "xox" + "b-" + "1" * 12,
    "jwt": "ey" + "J" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12, "kv-secret": "password" + " = '" + "s" * 14, "db-url-creds": "postgres" + "://u:" + "p@", "private-block": "<private>x\ny</private>",
}


@pytest.mark.parametrize("label", SECRETS)
def test_redaction(spark, label):
    got = one(spark, privacy.sanitize("t"), t=f"before {SECRETS[label]} after")
    assert f"[REDACTED:{label}]" in got["text"] and got["n"] == 1
    assert one(spark, privacy.has_secret("t"), t=SECRETS[label])
    again = one(spark, privacy.sanitize("t"), t=got["text"])
    assert again["text"] == got["text"] and again["n"] == 0


def test_redaction_of_null_and_clean_text(spark):
    assert tuple(spark.range(1).select(privacy.sanitize(F.lit(None).cast("string")).alias("s")).first()["s"]) == ("", 0)
    assert one(spark, privacy.sanitize("t"), t="nothing here")["n"] == 0


@pytest.mark.parametrize(
    ("entry", "reason"),
    [
        ("", "empty"), ("   ", "empty"), ("- [exp] " + SECRETS["aws-access-key"] + " and some more text", "secret_leak"), ("[exp] TODO", "placeholder"), ("[exp] short", "too_short"),
        ("[exp] maybe it is something else here", "hedged_no_evidence"), ("[hypothesis] maybe it works, to verify with a run", None), ("[ref] a fact of more than twenty characters", "ref_without_source"),
        ("[ref] a fact of more than twenty characters Source: x", None), ("[decision] we use one thing over there now", "decision_without_rationale"), ("[decision] we use it because it is fast", None),
        ("[tool] a thing that does another thing", "tool_without_version_or_syntax"), ("[tool] run `thing` to do another thing", None), ("[hypothesis] this is an idle guess about it", "hypothesis_without_verify"),
        ("[goal] have more of the nice things here", "goal_without_status"), ("[goal] have more of it. Status: DONE", None), ("plain text of more than twenty characters", None),
    ],
)
def test_gate(spark, entry, reason):
    assert one(spark, gate.reason("t"), t=entry) == reason


def test_gate_english_only(spark):
    words = "- [exp] đây là một câu tiếng Việt dài"
    assert one(spark, gate.reason("t", english_only=True), t=words) == "not_english"
    assert one(spark, gate.reason("t"), t=words) is None


def test_sections(spark):
    got = one(spark, lines.sections("t"), t="intro\n# One ##\na\nb\n#### deep\n\n## Empty\n\n# Two\nc\n")
    assert [(s["heading"], s["content"]) for s in got] == [("", "intro"), ("One", "a\nb\n#### deep"), ("Two", "c")]


def test_chunks_cut_long_sections(spark):
    df = spark.createDataFrame([("p", "# H\n" + "x" * 3200)], "path string, text string")
    assert [(r.ci, r.heading, len(r.content)) for r in lines.chunks(df).orderBy("ci").collect()] == [(0, "H", 1500), (1, "H", 1500), (2, "H", 200)]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("a\na\na\nb\n", "a  (×3)\nb\n"), ("a\na\nb", "a\na\nb"), ("\n\n\n\n", "\n\n\n\n"), ("", ""), ("x\nx\nx", "x  (×3)")],
)
def test_collapse_repeats(spark, given, wanted):
    assert one(spark, lines.collapse_repeats("t"), t=given) == wanted


def test_group_by_prefix(spark):
    rows = "\n".join(f"k: v{i}" for i in range(6))
    assert one(spark, lines.group_by_prefix("t"), t=rows + "\n") == "k: [6 items: v0, v1, v2, v3, v4, +1 more]\n"
    four = "\n".join(f"k: v{i}" for i in range(4))
    assert one(spark, lines.group_by_prefix("t"), t=four) == four


def test_entry_blocks(spark):
    got = one(spark, lines.entry_blocks("t"), t="- [exp] a\n  more\n\n- [zzz] b\n* [ref] c\nend")
    assert [(e["line"], e["text"]) for e in got] == [(1, "- [exp] a\n  more"), (5, "* [ref] c")]


def test_scores(spark):
    assert one(spark, scores.half_life_decay("m", 86400.0 * 15, 14), m=86400.0) == pytest.approx(0.5)
    assert one(spark, scores.half_life_decay("m", 1.0, 14), m=0.0) == 0.0
    assert one(spark, scores.verdict("m"), m=0.5996) == "promote"


@pytest.mark.parametrize(
    ("path", "bucket"),
    [("shared/a.md", "shared"), ("x/settings.json", "meta"), ("other.md", "other"), ("workspaces/w/journal/d.md", "journal"), ("workspaces/w/docs/handoff.md", "handoff"), ("workspaces/w/t/00-README.md", "moc"),
     ("workspaces/w/t/lessons.md", "lessons"), ("workspaces/w/t/2024-01-01-a.md", "aspect"), ("workspaces/w/t/n.md", "topic"), ("workspaces/w/n.md", "ws-root")],
)
def test_bucket(spark, path, bucket):
    assert one(spark, paths.bucket("t"), t=path) == bucket
