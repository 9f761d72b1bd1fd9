"""Classes of paths in a vault: ``shared/...`` and ``workspaces/<ws>/...``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SLUG, col

#: Names with a meaning of their own.
RESERVED_DIRS = ("docs", "skills", "research", "journal")
RESERVED_FILES = ("_MAP.md", "AGENTS.md", "workspace.json")
README, LESSONS = "00-README.md", "lessons.md"
DATED_ASPECT = r"^(\d{4}-\d{2}-\d{2})-([^/]+)\.md$"


def workspace(path: str | Column) -> Column:
    """The workspace of a path; ``shared`` for shared files, empty outside both."""
    p = col(path)
    return F.when(p.startswith("shared/"), "shared").otherwise(F.regexp_extract(p, r"(?:^|/)workspaces/([^/]+)/", 1))


def inner(path: str | Column) -> Column:
    """The part of a path inside its workspace."""
    return F.regexp_replace(col(path), r"^(?:.*/)?workspaces/[^/]+/", "")


def name(path: str | Column) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def folder(path: str | Column) -> Column:
    """The name of the folder a file is in, empty at the top."""
    return F.coalesce(F.try_element_at(F.split(col(path), "/"), F.lit(-2)), F.lit(""))


def slug(path: str | Column) -> Column:
    """A topic's name: the folder, or the stem of a file at the workspace's root."""
    return F.when(inner(path).contains("/"), folder(inner(path))).otherwise(F.regexp_replace(name(path), r"\.md$", ""))


def tier(path: str | Column, today: str) -> Column:
    """working, episodic, procedural or semantic."""
    i = inner(path)
    inside = col(path).rlike(r"(?:^|/)workspaces/[^/]+/")
    return (
        F.when(~inside, "semantic")
        .when(i.startswith("journal/"), F.when(name(path) == f"{today}.md", "working").otherwise("episodic"))
        .when(i.startswith("skills/"), "procedural")
        .when(i.startswith("docs/") & (name(path) == "handoff.md"), "working")
        .otherwise("semantic")
    )


def bucket(path: str | Column) -> Column:
    """One of twelve classes of a changed path."""
    p, i = col(path), inner(path)
    return (
        F.when(p.startswith("shared/"), "shared")
        .when(p.endswith(".json"), "meta")
        .when(~p.rlike("^workspaces/[^/]+/."), "other")
        .when(i.startswith("journal/"), "journal")
        .when(i == "docs/handoff.md", "handoff")
        .when(i == "docs/handoff-archive.md", "handoff-archive")
        .when(i.startswith("docs/"), "docs")
        .when(~i.contains("/"), "ws-root")
        .when(name(p) == README, "moc")
        .when(name(p) == LESSONS, "lessons")
        .when(name(p).rlike(DATED_ASPECT), "aspect")
        .otherwise("topic")
    )


def kind(path: str | Column) -> Column:
    """What the validator takes a file for: moc, aspect, lessons, or null for files out of its scope."""
    i = inner(path)
    return (
        F.when(~i.contains("/") | F.split(i, "/")[0].isin(*RESERVED_DIRS), F.lit(None).cast("string"))
        .when(name(path) == README, "moc")
        .when(name(path) == LESSONS, "lessons")
        .when(name(path).rlike(DATED_ASPECT), "aspect")
    )


def aspect_date(path: str | Column) -> Column:
    return F.try_to_date(F.nullif(F.regexp_extract(name(path), DATED_ASPECT, 1), F.lit("")), "yyyy-MM-dd")


def aspect_name(path: str | Column) -> Column:
    return F.regexp_extract(name(path), DATED_ASPECT, 2)


def is_topic_file(path: str | Column) -> Column:
    return ~F.split(inner(path), "/")[0].isin(*RESERVED_DIRS) & ~name(path).isin(*RESERVED_FILES)


def is_archive(path: str | Column) -> Column:
    return col(path).rlike(r"(?:^|/)\.archive/")


def archive_stem(path: str | Column) -> Column:
    """The stem an archived file had: without ``.md.gz`` and the time that was added."""
    return F.regexp_replace(F.regexp_replace(name(path), r"(\.md)?(\.gz)?$", ""), r"-\d{9,}$", "")


def migration_action(path: str | Column) -> Column:
    """What the move to topic folders does with a file of the old layout."""
    i, n = inner(path), name(path)
    depth = F.size(F.split(i, "/"))
    stem = F.regexp_replace(n, r"\.md$", "")
    return (
        F.when(F.split(i, "/")[0].isin(*RESERVED_DIRS) | n.isin(*RESERVED_FILES) | n.rlike("^[._]") | ~n.endswith(".md"), "skip")
        .when(n == README, "keep-readme")
        .when(n == LESSONS, "keep-lessons")
        .when(n.rlike(DATED_ASPECT), "keep-aspect")
        .when(depth == 1, F.when(stem.rlike(SLUG), "flat-to-folder").otherwise("flat-invalid"))
        .when(folder(path) == stem, "folder-note-to-readme")
        .when(depth == 2, "sibling-to-aspect")
        .otherwise("nested-to-aspect")
    )
