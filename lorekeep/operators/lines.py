"""Operators over the lines of texts: sections, entries, runs.

A document is one row, so its lines are walked inside the row by array functions; only results are rows.  No line
of a large corpus is shuffled to find out what it belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gate, text
from ..functions.text import let

CHUNK = 1500
_TAGS = "|".join(gate.TAGS)
HEADING = r"^(#{1,3})\s+(.+?)\s*#*$"
ENTRY = rf"(?i)^\s*[-*]\s+\[(?:{_TAGS})\]"
ANY_ENTRY = r"^\s*[-*]\s+\["


def _islands(lines: Column, starts) -> Column:
    """Positions (from 1) of the lines where ``starts`` holds."""
    return F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: starts(F.element_at(lines, i)))


def _bounds(at: Column, n: Column) -> Column:
    """[(start, end)] of islands that begin at the positions ``at`` and reach to the next one or to line n."""
    # bound once: each island looks at the next one
    return let(at, lambda at: F.transform(at, lambda a, i: F.struct(a.alias("a"), F.coalesce(F.get(at, i + 1) - 1, n).alias("b"))))


def sections(text_: str | Column) -> Column:
    """array<struct<heading, content>>: heading sections (levels 1 to 3) of a text with non-blank content."""

    def of(lines: Column) -> Column:
        at = F.concat(F.array(F.lit(0)), _islands(lines, lambda l: l.rlike(HEADING)))
        cut = F.transform(
            _bounds(at, F.size(lines)),
            lambda s: F.struct(
                F.when(s["a"] > 0, F.regexp_extract(F.element_at(lines, F.greatest(s["a"], F.lit(1))), HEADING, 2)).otherwise("").alias("heading"),
                text_strip(F.array_join(F.slice(lines, s["a"] + 1, F.greatest(s["b"] - s["a"], F.lit(0))), "\n")).alias("content"),
            ),
        )
        return F.filter(cut, lambda s: s["content"] != "")

    def cut(plain: Column) -> Column:
        # most texts have no heading, and are one section as they are
        whole = F.filter(F.array(F.struct(F.lit("").alias("heading"), text_strip(plain).alias("content"))), lambda s: s["content"] != "")
        return F.when(plain.rlike(r"(?m)^#{1,3}\s"), let(F.split(F.regexp_replace(plain, r"\n\z", ""), "\n"), of)).otherwise(whole)

    return let(text.line_feeds(text_), cut)


def text_strip(t: Column) -> Column:
    return F.btrim(t, F.lit(" \t\n\x0b\f\r"))


def slices(content: Column, size: int = CHUNK) -> Column:
    """A text in pieces of ``size`` characters."""
    n = F.floor((F.length(content) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.substring(content, i * size + 1, F.lit(size)))


def chunks(docs: DataFrame, text_col: str = "text", size: int = CHUNK) -> DataFrame:
    """The columns of ``docs`` but the text, with ci (from 0), heading, content of each chunk of each section."""
    parts = F.flatten(F.transform(sections(text_col), lambda s: F.transform(slices(s["content"], size), lambda c: F.struct(s["heading"].alias("heading"), c.alias("content")))))
    keep = [c for c in docs.columns if c != text_col]
    return docs.select(*keep, F.posexplode(parts).alias("ci", "p")).select(*keep, "ci", "p.heading", "p.content")


def entry_blocks(text_: str | Column, start: str = ENTRY) -> Column:
    """array<struct<line, text>>: bullets that match ``start`` with the indented non-blank lines that follow."""

    def of(lines: Column) -> Column:
        at = _islands(lines, lambda l: l.rlike(start))
        stop = _islands(lines, lambda l: ~l.rlike(r"^[ \t]+\S") | l.rlike(start))
        ends = lambda a: F.coalesce(F.get(F.filter(stop, lambda s: s > a), F.lit(0)), F.size(lines) + 1)
        return F.transform(at, lambda a: F.struct(a.alias("line"), F.array_join(F.slice(lines, a, ends(a) - a), "\n").alias("text")))

    empty = F.array().cast("array<struct<line:int,text:string>>")
    return let(text.lines(text_), lambda lines: F.when(F.size(lines) > 0, of(lines)).otherwise(empty))


def headed_blocks(text_: str | Column, start: str, stop: str = r"^#{1,6}\s") -> Column:
    """array<struct<line, text>>: from a line that matches ``start`` to before the next that matches ``stop``."""

    def of(lines: Column) -> Column:
        at = _islands(lines, lambda l: l.rlike(start))
        stops = _islands(lines, lambda l: l.rlike(stop))
        ends = lambda a: F.coalesce(F.get(F.filter(stops, lambda s: s > a), F.lit(0)), F.size(lines) + 1)
        return F.transform(at, lambda a: F.struct(a.alias("line"), F.array_join(F.slice(lines, a, ends(a) - a), "\n").alias("text")))

    empty = F.array().cast("array<struct<line:int,text:string>>")
    return let(text.lines(text_), lambda lines: F.when(F.size(lines) > 0, of(lines)).otherwise(empty))


def gate_entries(text_: str | Column) -> Column:
    """Entries as the gate sees them: headed blocks whole, bullets as their single line; in order of lines."""
    bullets = F.transform(entry_blocks(text_, r"^\s*[-*]\s*\[[a-zA-Z][a-zA-Z-]*\]"), lambda e: F.struct(e["line"].alias("line"), F.split(e["text"], "\n", 2)[0].alias("text")))
    blocks = headed_blocks(text_, r"^#{2,6}\s*\[[a-zA-Z][a-zA-Z-]*\]")
    return F.array_sort(F.concat(bullets, blocks))


def review_blocks(text_: str | Column) -> Column:
    return headed_blocks(text_, r"(?i)^##\s+\[self-review\]", r"^## ")


def lint_entries(docs: DataFrame, path: str = "path", text_col: str = "text") -> DataFrame:
    """path, line, type, text, source of typed bullets, continuation lines joined by blanks."""
    rows = docs.select(F.col(path).alias("path"), F.explode(entry_blocks(text_col, r"^\s*[-*]\s+\[\w[\w-]*\]\s+.")).alias("e"))
    parts = F.split("e.text", "\n")
    joined = F.array_join(F.transform(parts, lambda l, i: F.when(i == 0, F.trim(F.regexp_extract(l, r"^\s*[-*]\s+\[\w[\w-]*\]\s+(.+)", 1))).otherwise(F.trim(l))), " ")
    return rows.select("path", F.col("e.line").alias("line"), F.lower(F.regexp_extract("e.text", r"^\s*[-*]\s+\[(\w[\w-]*)\]", 1)).alias("type"), joined.alias("text")).withColumn(
        "source", F.nullif(F.trim(F.regexp_extract("text", r"(?i)Source:\s*(.+?)(?:\s*$|\s*\|)", 1)), F.lit(""))
    )


def typed_entry_count(text_: str | Column) -> Column:
    """Lines with a known ``[tag]``."""
    return F.size(F.filter(text.lines(text_), lambda l: l.rlike(rf"\[({_TAGS})\]")))


# -- runs of lines ----------------------------------------------------------------------------------------------------


def _runs(lines: Column, key) -> Column:
    """array<struct<a, n, k>>: start, length and key of the runs of neighbouring lines with equal keys."""
    keys = F.transform(lines, key)

    def of(k: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(k)), lambda i: (i == 1) | ~F.element_at(k, i).eqNullSafe(F.element_at(k, F.greatest(i - 1, F.lit(1)))))
        return F.transform(_bounds(at, F.size(k)), lambda s: F.struct(s["a"].alias("a"), (s["b"] - s["a"] + 1).alias("n"), F.element_at(k, s["a"]).alias("k")))

    return let(keys, of)


def _rebuilt(text_: Column, parts: Column) -> Column:
    return F.concat(F.array_join(F.flatten(parts), "\n"), F.when(F.endswith(text_, F.lit("\n")), "\n").otherwise(""))


def collapse_repeats(text_: str | Column, least: int = 3) -> Column:
    """Runs of ``least`` or more equal non-blank lines as ``line  (×N)``; a last line feed stays."""
    if least < 2:
        raise ValueError("a run has at least 2 lines")
    t = text.col(text_)

    def of(lines: Column) -> Column:
        return _rebuilt(
            t,
            F.transform(
                _runs(lines, lambda l: l),
                lambda r: F.when((r["n"] >= least) & F.element_at(lines, r["a"]).rlike(r"\S"), F.array(F.concat(F.element_at(lines, r["a"]), F.lit("  (×"), r["n"].cast("string"), F.lit(")")))).otherwise(F.slice(lines, r["a"], r["n"])),
            ),
        )

    return let(text.lines(t), lambda lines: F.when(F.size(lines) > 0, of(lines)).otherwise(t))


_PREFIX = r"^(\s*[-*]?\s*[A-Za-z][\w.-]*)\s*[:=]\s*(.+)$"


def group_by_prefix(text_: str | Column, most: int = 5) -> Column:
    """Runs of ``most`` or more ``key: value`` lines of one key as ``key: [N items: first ones, +K more]``."""
    if most < 2:
        raise ValueError("a group has at least 2 lines")
    t = text.col(text_)
    # inside a lambda nullif would match the line twice
    key = lambda l: let(F.trim(F.regexp_extract(l, _PREFIX, 1)), lambda k: F.when(k != "", k))

    def of(lines: Column) -> Column:
        def shown(r: Column) -> Column:
            part = F.slice(lines, r["a"], r["n"])
            k = r["k"]
            values = F.transform(F.slice(part, 1, most), lambda l: F.trim(F.regexp_extract(l, _PREFIX, 2)))
            more = F.when(r["n"] > most, F.concat(F.lit(", +"), (r["n"] - most).cast("string"), F.lit(" more"))).otherwise("")
            line = F.concat(k, F.lit(": ["), r["n"].cast("string"), F.lit(" items: "), F.array_join(values, ", "), more, F.lit("]"))
            return F.when(k.isNotNull() & (r["n"] >= most), F.array(line)).otherwise(part)

        # lines without a key are runs of nulls and stay as they are
        return _rebuilt(t, F.transform(_runs(lines, key), shown))

    return let(text.lines(t), lambda lines: F.when(F.size(lines) > 0, of(lines)).otherwise(t))


def compress_block(text_: str | Column, least: int = 3, most: int = 5) -> Column:
    return let(collapse_repeats(text_, least), lambda t: group_by_prefix(t, most))


def repeat_runs(docs: DataFrame, keys: list[str], text_col: str = "text", least: int = 3) -> DataFrame:
    """keys, line, n, content of every collapsible run."""
    found = let(text.lines(text_col), lambda lines: F.filter(F.transform(_runs(lines, lambda l: l), lambda r: F.struct(r["a"].alias("line"), r["n"].alias("n"), F.element_at(lines, r["a"]).alias("content"))), lambda r: (r["n"] >= least) & r["content"].rlike(r"\S")))
    return docs.select(*keys, F.explode(F.when(F.size(text.lines(text_col)) > 0, found)).alias("r")).select(*keys, "r.*")


# -- handoff ----------------------------------------------------------------------------------------------------------


def h2_sections(text_: str | Column) -> Column:
    """array<struct<i, text>>: the parts before and from each second-level heading; i = 0 is the preamble."""

    def of(lines: Column) -> Column:
        at = F.concat(F.array(F.lit(0)), _islands(lines, lambda l: l.rlike(r"^##\s")))
        return F.transform(_bounds(at, F.size(lines)), lambda s, i: F.struct(i.alias("i"), F.array_join(F.slice(lines, F.greatest(s["a"], F.lit(1)), F.when(s["a"] == 0, s["b"]).otherwise(s["b"] - s["a"] + 1)), "\n").alias("text")))

    empty = F.array().cast("array<struct<i:int,text:string>>")
    return let(F.split(text.col(text_), "\n"), lambda lines: F.when(F.size(lines) > 0, of(lines)).otherwise(empty))


def host_bullets(section: str | Column) -> Column:
    """array<struct<line, text>>: ``- host:`` bullets with the lines that continue them."""

    def of(lines: Column) -> Column:
        at = _islands(lines, lambda l: l.rlike(r"^- [\w.@-]+:"))
        stop = _islands(lines, lambda l: l.rlike(r"^(?:#|- )|^\s*$"))
        ends = lambda a: F.coalesce(F.get(F.filter(stop, lambda s: s > a), F.lit(0)), F.size(lines) + 1)
        return F.transform(at, lambda a: F.struct(a.alias("line"), F.array_join(F.slice(lines, a, ends(a) - a), "\n").alias("text")))

    return let(F.split(text.col(section), "\n"), of)


LIVE = r"(?i)\[[^\]]*(?:doing|blocker|thread|next)[^\]]*\]"
