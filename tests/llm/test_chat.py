import hashlib
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import chat

CONTROL = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", " ", "\\", "[", "<", "]", ">", "SYS", "[\\INST]", "[/\\TURN]", "a", "\n"]), max_size=12).map("".join)


@given(CONTROL)
@settings(max_examples=300, deadline=None)
def test_escape_round_trip(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[TURN]", "[/TURN]"))


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a\nb%"]), CONTROL), max_size=6))
@settings(max_examples=200, deadline=None)
def test_render_and_read_back(turns):
    done = chat.render_incrementally(chat.inst_template, turns)
    assert not done.rewrites
    assert chat.parse_inst(done.text) == turns
    assert [chat.unescape(done.text[a:b]) for a, b in done.contents] == [t for _, t in turns]
    assert all(a[1] == b[0] for a, b in zip(done.spans, done.spans[1:]))


def test_rewriting_templates_are_found():
    def last_only(turns):
        return "".join(f"<{r}>{t if i == len(turns) - 1 else ''}" for i, (r, t) in enumerate(turns))

    assert chat.render_incrementally(last_only, [("u", "a"), ("v", "b"), ("u", "c")]).rewrites == [1, 2]


def test_format_conversations(spark):
    rows = [(1, 1, "assistant", "b </s>"), (1, 0, "user", "a"), (2, 0, "user", None), (2, 0, "user", None), (3, None, None, "x"), (None, 0, "assistant", "y"), (3, 5, "assistant", ""), *chat.EXTRA]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb </s>\n") and got[1].loss_sha256 == sha("b </s>") and got[1].loss_chars == 6
    assert got[2].n_turns == 2 and got[2].loss_sha256 == sha("") and got[3].turns_sha256 == sha("\nx\nassistant\n\n")
    assert got[-7].loss_sha256 == sha("</s>[INST] ok [/INST]") and got[None].n_turns == 1
    assert got[1].formatted == "<s>[INST] a [/INST] b </\\s> </s>" or got[1].formatted == "<s>[INST] a [/INST] b <\\/s> </s>"
    assert chat.format_conversations(df.limit(0)).collect() == []


@pytest.mark.parametrize(("a", "b", "n"), [("", "", 0), ("abc", "abd", 2), ("ab", "abc", 2), ("x", "y", 0)])
def test_common_prefix(a, b, n):
    assert chat.common_prefix(a, b) == n


def test_masks_of_rewritten_history_are_null(spark):
    def last_only(turns):
        return "".join(f"<{r}>{t if i == len(turns) - 1 else ''}" for i, (r, t) in enumerate(turns))

    df = spark.createDataFrame([(1, 0, "assistant", "aaaa"), (1, 1, "assistant", "b"), (2, 0, "assistant", "aaaa")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(df, template=last_only, parse=lambda text: []).collect()}
    assert got[1].rewrites == [1] and got[1].spans is got[1].loss_spans is got[1].loss_chars is got[1].loss_sha256 is None
    assert got[2].rewrites == [] and got[2].loss_spans == [[11, 15]] and got[2].loss_chars == 4


@pytest.mark.parametrize("n", [1, 63, 64, 65, 128, 129, 300])
def test_long_conversations_are_placed_as_by_whole_prefixes(n):
    turns = [(("system", "user", "assistant", "tool")[i % 4], f"[INST]{i}</s>" * (i % 3)) for i in range(n)]
    assert chat.render_incrementally(chat.inst_template, turns) == chat.render_every_prefix(chat.inst_template, turns)


def test_late_rewriting_is_found():
    def forgetful(turns):
        kept = turns if len(turns) < 100 else turns[-50:]
        return "".join(f"<{r}>{t}" for r, t in kept)

    def counting(turns):  # appends, but by the place in the conversation
        return "".join(f"<{i} {r}>{t}" for i, (r, t) in enumerate(turns))

    turns = [("u", f"text {i}") for i in range(150)]
    for template in (forgetful, counting):
        assert chat.render_incrementally(template, turns) == chat.render_every_prefix(template, turns)
    assert chat.render_incrementally(forgetful, turns).rewrites[0] == 99
    assert not chat.render_incrementally(counting, turns).rewrites


def test_many_turns_take_linear_time():
    turns = [(("user", "assistant")[i % 2], f"text {i} </s>") for i in range(20_000)]
    start = time.monotonic()
    done = chat.render_incrementally(chat.inst_template, turns)
    assert time.monotonic() - start < 20
    assert [chat.unescape(done.text[a:b]) for a, b in done.contents] == [t for _, t in turns] and chat.parse_inst(done.text) == turns


def test_rewriting_that_is_undone_is_found():
    def hides(turns):
        kept = turns if not 70 <= len(turns) <= 100 else turns[-60:]
        return "".join(f"<{r}>{t}" for r, t in kept)

    turns = [("u", f"text {i}") for i in range(130)]
    done = chat.render_incrementally(hides, turns)
    assert done == chat.render_every_prefix(hides, turns) and {69, 100} <= set(done.rewrites)


def test_rewriting_that_is_undone_is_found_however_late():
    def hides(turns):
        kept = turns if not 1100 <= len(turns) <= 1200 else turns[-20:]
        return "".join(f"<{r}>{t}" for r, t in kept)

    turns = [("u", f"text {i}") for i in range(1300)]
    assert {1099, 1200} <= set(chat.render_incrementally(hides, turns).rewrites)


def test_a_template_that_wrongly_says_it_appends_is_found_out():
    def forgetful(turns):
        return "".join(f"<{r}>{t}" for r, t in (turns if len(turns) < 10 else turns[-5:]))

    turns = [("u", f"text {i}") for i in range(30)]
    forgetful.appends = True
    assert chat.render_incrementally(forgetful, turns) == chat.render_every_prefix(forgetful, turns)
