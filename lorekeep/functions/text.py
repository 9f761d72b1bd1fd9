"""String functions as Column expressions: no Python runs per row.

Word classes are spelled out with ``\\p{L}\\p{N}`` because Java's ``\\w`` and ``\\b`` know ASCII only.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``\\s`` has it, NBSP and the Unicode blanks included.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
LETTERS = r"\p{L}\p{N}_"
#: Line ends that splitlines() knows besides \n.
_LINE_ENDS = r"\r\n|[\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, then) -> Column:
    """``then`` of a value computed once: without it, a lambda computes what it refers to for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def computed_once(df, name: str, value: Column):
    """``df`` with a column that filters further up refer to but do not compute again: they are not pushed through an explode."""
    return df.drop(name).select("*", F.explode(F.array(value)).alias(name))


def squeeze(text: str | Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(col(text), f"{SPACE}+", " "))


def normalize(text: str | Column) -> Column:
    """Lower case and squeezed: the form that n-grams and digests are taken of."""
    return squeeze(F.lower(col(text)))


def line_feeds(text: str | Column) -> Column:
    """A text whose lines all end by a line feed."""
    return F.regexp_replace(col(text), _LINE_ENDS, "\n")


def lines(text: str | Column) -> Column:
    """The lines of a text, as splitlines() gives them: no last empty one."""
    cut = lambda plain: F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(plain, r"\n\z", ""), "\n"))
    return let(line_feeds(text), cut)


def char_ngrams(text: str | Column, n: int = 3) -> Column:
    """Distinct character n-grams of the normalized text; none if it is shorter than n."""
    if n < 1:
        raise ValueError("n must be at least 1")
    # one pass: at each character, what a look ahead sees
    return F.array_distinct(F.regexp_extract_all(normalize(text), F.lit(f"(?s)(?=(.{{{n}}}))."), 1))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of two arrays of distinct items; 0 when both are empty."""
    # both are computed once, though each is looked at twice
    sizes = lambda p: F.struct(F.size(p["a"]).alias("a"), F.size(p["b"]).alias("b"), F.size(F.array_intersect(p["a"], p["b"])).alias("c"))
    ratio = lambda s: F.coalesce(s["c"] / F.nullif(s["a"] + s["b"] - s["c"], F.lit(0)), F.lit(0.0))
    return let(F.struct(col(a).alias("a"), col(b).alias("b")), lambda p: let(sizes(p), ratio))


def word_set(text: str | Column, least: int = 4, drop: list[str] | tuple[str, ...] = ()) -> Column:
    """Distinct lower-case words of at least ``least`` letters, without those in ``drop``."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(col(text)), F.lit(f"[{LETTERS}]{{{least},}}"), 0))
    return F.array_except(words, F.array(*map(F.lit, drop))) if drop else words


def has_word(text: str | Column, words: str) -> Column:
    """Whether an alternative of ``words`` (a pattern) stands as a whole word, letters of any script counting."""
    return col(text).rlike(f"(?:^|[^{LETTERS}])(?:{words})(?:$|[^{LETTERS}])")


def fold_table() -> tuple[str, str]:
    """Letters of Latin-1 and Latin Extended-A with one diacritic, and the letters without it."""
    marked, plain = "", ""
    for cp in range(0xC0, 0x180):
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) == 2 and parts[0].isascii() and chr(cp).islower():
            marked, plain = marked + chr(cp), plain + parts[0]
    return marked, plain


#: Tokens of a folded text.
TOKEN = r"[\p{L}\p{N}]+"


def folded(text: str | Column) -> Column:
    """Small letters without diacritics."""
    return F.translate(F.lower(col(text)), *fold_table())


def search_tokens(text: str | Column) -> Column:
    """Tokens of the full-text index: case-folded runs of letters and digits without diacritics."""
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), 0)


# -- tags -------------------------------------------------------------------------------------------------------------

TAG = "#[A-Za-z0-9_][A-Za-z0-9._-]*"


def strip_tags(line: str | Column) -> Column:
    """One line without the run of ``#tags`` at its end."""
    return F.regexp_replace(col(line), rf"\s*{TAG}(?:\s+{TAG})*\s*\z", "")


def strip_tags_text(text: str | Column) -> Column:
    """Each line without its trailing tags."""
    return F.array_join(F.transform(F.split(col(text), "\n"), strip_tags), "\n")


def inline_tags(text: str | Column) -> Column:
    """All inline tags in order of appearance, lower-case, without ``#``, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(col(text), F.lit(TAG), 0), lambda t: F.lower(F.substring(t, F.lit(2), F.length(t)))))


def tag_suffix(tags: str | Column) -> Column:
    """``"  #a #b"``, empty for no tags."""
    tags = col(tags)
    return F.when(F.size(tags) > 0, F.concat(F.lit("  "), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " "))).otherwise("")


def apply_inline_tags(text: str | Column, tags: str | Column) -> Column:
    """The suffix on the first line, in place of the tags it had."""
    parts = F.split(col(text), "\n", 2)
    first = F.concat(strip_tags(parts[0]), tag_suffix(tags))
    return F.when(F.size(parts) > 1, F.concat(first, F.lit("\n"), F.get(parts, F.lit(1)))).otherwise(first)


def normalize_tag(tag: str | Column) -> Column:
    """Lower case, other characters to single hyphens, no hyphen or dot at the ends."""
    t = F.regexp_replace(F.lower(F.trim(col(tag))), "[^a-z0-9._-]+", "-")
    return F.regexp_replace(F.regexp_replace(t, "-{2,}", "-"), r"^[-.]+|[-.]+$", "")


def drops_tag(tag: str | Column, least: int = 3) -> Column:
    """Whether a normalized tag says nothing: short, a number, a version, a date, a hash, mostly separators."""
    t = col(tag)
    core = F.regexp_replace(t, "[._-]", "")
    return (F.length(t) < least) | t.rlike(r"^\d+$|^v?\d+(?:\.\d+)+[a-z0-9]*$|^\d{4}-\d{2}-\d{2}$|^[0-9a-f]{7,}$") | (F.length(core) < 2) | core.rlike(r"^\d+$")


def collapse_prefixes(tags: str | Column) -> Column:
    """Tags that are no part of a longer one."""
    return let(col(tags), lambda all_: F.filter(all_, lambda t: ~F.exists(all_, lambda o: (o != t) & (F.length(o) > F.length(t)) & o.contains(t))))


def merge_tags(old: str | Column, new: str | Column, most: int = 15) -> Column:
    """Ordered union with a cap."""
    return F.slice(F.array_distinct(F.concat(col(old), col(new))), 1, most)


# -- names and tokens -------------------------------------------------------------------------------------------------

#: Names a topic must not get.
JUNK_SLUG = r"(example|placeholder|redacted|akia[a-z0-9]+|xxx+|^test-?\d*$|^todo$)"
SLUG = r"^[a-z0-9][a-z0-9-]{0,59}$"
WORKSPACE = r"^[a-z0-9][a-z0-9._-]{0,63}$"
NEW_WORKSPACE = r"^[a-z0-9][a-z0-9-]{0,30}$"


def slugify(words: str | Column, most: int = 60) -> Column:
    """An array of words as one kebab-case name; ``misc`` when nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.array_join(col(words), "-")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(t, 1, most), "-+$", ""), F.lit("")), F.lit("misc"))


def longest(words: str | Column, n: int) -> Column:
    """The n longest words, ties in alphabetical order."""
    ranked = F.array_sort(F.transform(col(words), lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w"))))
    return F.slice(F.transform(ranked, lambda r: r["w"]), 1, n)


def aspect_slug(text: str | Column, drop=()) -> Column:
    """A name of the five longest keywords, ``note`` for none."""
    words = word_set(text, 4, drop)
    return F.when(F.size(words) > 0, slugify(longest(words, 5))).otherwise("note")


def guard_slug(slug: str | Column, default: str = "misc") -> Column:
    return F.when(col(slug).rlike(JUNK_SLUG), default).otherwise(col(slug))


def valid_aspect_slug(slug: str | Column) -> Column:
    """Usable as the name of an aspect: well-formed, not reserved, not all digits."""
    s = col(slug)
    return s.rlike(SLUG) & ~s.isin("readme", "lessons", "00-readme") & ~s.rlike(r"^\d+$")


def split_token(token: str | Column) -> Column:
    """``ws:slug`` as a struct (ws, slug); ws is null without a colon or before an empty one."""
    t = F.trim(col(token))
    parts = F.split(t, ":", 2)
    return F.when(t.contains(":"), F.struct(F.nullif(F.trim(parts[0]), F.lit("")).alias("ws"), F.trim(F.get(parts, F.lit(1))).alias("slug"))).otherwise(F.struct(F.lit(None).cast("string").alias("ws"), t.alias("slug")))


def safe_token(token: str | Column) -> Column:
    """A query term without the characters that a match expression reads as syntax."""
    return squeeze(F.regexp_replace(col(token), r'["*^:()\[\]{}]', " "))


def truncate(text: str | Column, most: int = 60) -> Column:
    """The first line, cut with an ellipsis."""
    first = F.split(F.trim(col(text)), "\n", 2)[0]
    return F.when(F.length(first) > most, F.concat(F.substring(first, 1, most - 1), F.lit("…"))).otherwise(first)


def preview(text: str | Column, most: int = 80) -> Column:
    return F.substring(squeeze(text), 1, most)


def word_count(text: str | Column) -> Column:
    """Blank-separated tokens after the frontmatter."""
    t = squeeze(strip_fence(text))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def strip_fence(text: str | Column) -> Column:
    """Text after a leading ``---`` ... ``---`` pair."""
    parts = F.split(col(text), "---", 3)
    return F.when(col(text).startswith("---") & (F.size(parts) >= 3), F.get(parts, F.lit(2))).otherwise(col(text))


def lesson_parts(line: str | Column) -> Column:
    """``symptom -- tried -- cause -- fix [-- source]`` as an array of five; null for any other number of parts."""
    parts = F.transform(F.split(F.trim(col(line)), r"\s+--\s+"), lambda x: F.trim(x))
    return F.when(F.size(parts) == 5, parts).when(F.size(parts) == 4, F.concat(parts, F.array(F.lit(""))))


def split_quoted_csv(text: str | Column) -> Column:
    """Comma-separated items; quotes keep commas, and doubled quotes inside stand for one."""
    items = F.regexp_extract_all(col(text), F.lit(r"""(?:^|,)\s*("(?:[^"]|"")*"|'(?:[^']|'')*'|[^,]*?)\s*(?=,|$)"""), 1)
    bare = lambda s: F.when(s.rlike(r'^".*"$'), F.replace(F.substring(s, F.lit(2), F.length(s) - 2), F.lit('""'), F.lit('"'))).when(s.rlike(r"^'.*'$"), F.replace(F.substring(s, F.lit(2), F.length(s) - 2), F.lit("''"), F.lit("'"))).otherwise(s)
    return F.filter(F.transform(items, bare), lambda s: s != "")


def ignores_path(gitignore: str | Column, entry: str) -> Column:
    """Whether an ignore file has ``entry`` as a line of its own; comments and negations do not count."""
    return F.exists(lines(gitignore), lambda l: (F.trim(l) == entry) & ~F.trim(l).rlike("^[#!]"))


def has_conflict_markers(text: str | Column) -> Column:
    return col(text).rlike(r"(?m)^(?:<{7}|>{7})(?: |$)")


def has_source_ref(text: str | Column) -> Column:
    """A raw note that names its source: an attribution field, a Source line, or file.ext:line."""
    t = col(text)
    return t.rlike(r"(?m)^(source_file|source_files|repo|clone_path):") | t.rlike(r"(?m)^Source:") | t.rlike(r"[\w./-]+\.\w+:\d+")


def digest(tag: str | Column, text: str | Column) -> Column:
    """Key of the deduplication window: SHA-256 of tag, NUL and normalized text."""
    return F.sha2(F.concat(F.coalesce(col(tag), F.lit("")), F.lit("\x00"), normalize(text)), 256)


def salvage_hash(text: str | Column) -> Column:
    return F.sha1(F.lower(squeeze(text)))


def chunk_hash(content: str | Column) -> Column:
    """First 16 digits of the SHA-1 of the content without trailing tags."""
    return F.substring(F.sha1(strip_tags_text(content)), 1, 16)


def token_estimate(text: str | Column) -> Column:
    return F.floor(F.length(col(text)) / 4).cast("long")
