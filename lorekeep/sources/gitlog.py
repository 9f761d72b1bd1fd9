"""Commits and staged changes, from the text that git prints."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import vault

#: How the log is to be printed: git log --pretty=format:%H%x1f%s%x1f%b%x1e
FIELD, RECORD = "\x1f", "\x1e"
#: The kinds of changes in subjects, and the form of trailers.
SUBJECT = r"^(add|update|prune|archive|consolidate|sync|chore|feat|fix|docs)\(([^)]+)\):\s*(.*)$"
TRAILER = r"^([A-Z][a-zA-Z]+):\s*(.+)$"


#: How changes are printed: a mark and the hash, then raw entries and numbers, all ended by NUL so that any path can be read.
CHANGES = ["-z", "--raw", "--numstat", "-M", "--no-abbrev"]
HEADER = re.compile(r"\x1e([0-9a-f]{40,64})(?:\n(.*))?\Z", re.S)
#: Commits of a partition.
COMMITS = 2000


@dataclass
class Commits(InputPartition):
    """Some commits of a range of revisions, counted from its newest; ``None`` for what is staged."""

    revisions: list[str] | None
    skip: int = 0

    def __post_init__(self):
        super().__init__(None)


def _asked(repo: str, *args: str) -> str | None:
    """What git answers, or None where it has no answer."""
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True)
    return done.stdout.strip() if done.returncode == 0 else None


def _records(repo: str, args: list[str], end: str) -> Iterator[str]:
    """What git prints, record by record; raises if git fails, so that the task is tried again and no commit is lost."""
    with subprocess.Popen(["git", "-C", repo, *args], stdout=subprocess.PIPE) as git:
        rest = b""
        while block := git.stdout.read(1 << 20):
            *whole, rest = (rest + block).split(end.encode())
            yield from (w.decode("utf-8", "replace") for w in whole)
        if git.wait():
            raise RuntimeError(f"git {args[0]} ended with {git.returncode}; what it says is in the worker's log")
        if rest:
            yield rest.decode("utf-8", "replace")


def changes_of(tokens: Iterable[str]) -> Iterator[tuple]:
    """(hash, status, path, old_path, added, deleted) of printed changes; one commit's are held at a time, and the hash of staged ones is empty."""
    tokens, commit, files, numbers = iter(tokens), "", [], {}

    def known():
        for status, path, old in files:
            yield (commit, status, path, old, *numbers.get(path, (0, 0)))

    for token in tokens:
        if head := HEADER.match(token):
            yield from known()
            commit, files, numbers = head[1], [], {}
            token = head[2] or ""
        if token.startswith(":"):
            status = token.rsplit(" ", 1)[-1][:1]
            old = next(tokens) if status in "RC" else None
            files.append((status, next(tokens), old))
        elif token:
            added, deleted, path = token.split("\t", 2)
            if not path:
                next(tokens)
                path = next(tokens)
            numbers[path] = tuple(int(n) if n.isdigit() else 0 for n in (added, deleted))
    yield from known()


class _History:
    """What the readers share: ranges of revisions in partitions of COMMITS, none of whose hashes the driver lists."""

    def __init__(self, options, changes: bool):
        self.repo, self.days, self.changes = options["path"], options.get("days"), changes
        self.staged = changes and (options.get("staged") or "").lower() == "true"

    def head(self) -> str:
        return _asked(self.repo, "rev-parse", "--verify", "-q", "HEAD") or ""

    def dealt(self, revisions: list[str]) -> list[Commits]:
        count = _asked(self.repo, "rev-list", "--count", *revisions)
        if count is None:
            raise RuntimeError(f"git cannot list {' '.join(revisions)} of {self.repo}")
        return [Commits(revisions, skip) for skip in range(0, int(count), COMMITS)]

    def read(self, partition):
        if partition is None:  # what Spark makes of no partitions
            return
        if partition.revisions is None:
            yield from changes_of(_records(self.repo, ["diff", "--cached", *CHANGES], "\0"))
            return
        some = [f"--skip={partition.skip}", f"--max-count={COMMITS}", *partition.revisions]
        if self.changes:
            yield from changes_of(_records(self.repo, ["log", *CHANGES, "--pretty=format:%x1e%H", *some], "\0"))
            return
        for record in _records(self.repo, ["log", "--pretty=format:%H%x1f%s%x1f%b%x1e", *some], RECORD):
            parts = record.strip().split(FIELD)
            if len(parts) >= 2:
                yield parts[0], parts[1], parts[2] if len(parts) > 2 else ""


class _Reader(_History, DataSourceReader):
    def partitions(self):
        if self.staged:
            return [Commits(None)] if _asked(self.repo, "rev-parse", "--git-dir") else []
        head = self.head()
        # the moment is fixed here, so that all partitions count the same commits
        since = [_asked(self.repo, "rev-parse", f"--since={self.days} days ago") or ""] if head and self.days else []
        return self.dealt([*since, head]) if head else []


class _Stream(_History, DataSourceStreamReader):
    """New commits since the last batch; the offset is the commit that HEAD was.  Commits that rewritten history brings are new ones."""

    def initialOffset(self):
        return {"commit": ""}

    def latestOffset(self):
        return {"commit": self.head()}

    def partitions(self, start, end):
        if not end["commit"] or start == end:
            return []
        return self.dealt([end["commit"], *([f"^{start['commit']}"] if start["commit"] else [])])


class GitLog(DataSource):
    """spark.read.format("gitlog").option("days", 7).load(repository), or readStream: commits; no rows where there is no repository.

    The repository is one that all executors reach by its path.
    """

    changes = False

    @classmethod
    def name(cls):
        return "gitlog"

    def schema(self):
        return "hash string, subject string, body string"

    def reader(self, schema):
        return _Reader(self.options, self.changes)

    def streamReader(self, schema):
        if (self.options.get("staged") or "").lower() == "true":
            raise ValueError("what is staged is no stream")
        return _Stream(self.options, self.changes)


class GitChanges(GitLog):
    """Like ``gitlog``, a row for each file that a commit changes; option("staged", True): what is staged, under an empty hash.

    Renames are one row with their old path; of merges there are none, as git shows them.  Lines that git does not count (binary) are 0.
    """

    changes = True

    @classmethod
    def name(cls):
        return "gitchanges"

    def schema(self):
        return "hash string, status string, path string, old_path string, added int, deleted int"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitLog)
    spark.dataSource.register(GitChanges)


def deleted_paths(changes: DataFrame) -> DataFrame:
    """path of files that some commit deleted, which history therefore still holds."""
    return changes.filter("status = 'D'").select("path").distinct()


def log_records(spark: SparkSession, path: str) -> DataFrame:
    """hash, subject, body of printed logs."""
    raw = spark.read.text(path, lineSep=RECORD).select(F.split(F.trim(F.regexp_replace("value", r"^\s+", "")), FIELD).alias("p")).filter(F.size("p") >= 2)
    return raw.select(F.col("p")[0].alias("hash"), F.col("p")[1].alias("subject"), F.coalesce(F.get("p", F.lit(2)), F.lit("")).alias("body"))


def commits(records: DataFrame) -> DataFrame:
    """hash (8 digits), type, scope, subject, trailers; of repeated trailers the last counts."""
    found = F.regexp_extract("subject", SUBJECT, 1)
    lines = F.filter(F.transform(F.split("body", r"\r?\n"), lambda x: F.trim(x)), lambda l: l.rlike(TRAILER))
    pairs = F.transform(lines, lambda l: F.struct(F.regexp_extract(l, TRAILER, 1).alias("key"), F.regexp_extract(l, TRAILER, 2).alias("value")))
    return records.select(F.substring("hash", 1, 8).alias("hash"), F.when(found != "", found).otherwise("other").alias("type"), F.regexp_extract("subject", SUBJECT, 2).alias("scope"), "subject", F.map_from_entries(vault.last_by_key(pairs, "key")).alias("trailers"))


def name_status(lines: DataFrame) -> DataFrame:
    """status (one letter), path of name-status lines; a rename counts for its new path."""
    parts = F.split("value", "\t")
    return lines.filter(F.size(parts) >= 2).select(F.substring(parts[0], 1, 1).alias("status"), F.element_at(parts, -1).alias("path"))


def numstat(lines: DataFrame) -> DataFrame:
    """path, added, deleted; ``-`` (binary) counts as 0."""
    parts = F.split("value", "\t")
    number = lambda i: F.coalesce(parts[i].try_cast("int"), F.lit(0))
    return lines.filter(F.size(parts) >= 3).select(F.element_at(parts, -1).alias("path"), number(0).alias("added"), number(1).alias("deleted"))


def changed_files(status: DataFrame, numbers: DataFrame) -> DataFrame:
    """Changed paths with the lines they gained and lost, 0 where git counts none."""
    return status.join(numbers, "path", "left").fillna(0, ["added", "deleted"])
