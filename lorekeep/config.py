"""Settings: one frozen record with defaults, from dictionaries of any quality; and the choice of a workspace."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    ttl_days: int = 7
    max_journal_bytes: int = 75_000
    archive_after_days: int = 90
    keep_newest: int = 3
    handoff_keep: int = 10
    handoff_stale_days: int = 14
    half_life_days: float = 14.0
    budget_chars: int = 15_000
    per_file_chars: int = 4_000
    head_chars: int = 4_000
    min_keyword_overlap: int = 3
    default_topic: str = "misc"
    dedup_seconds: float = 300.0
    journal_every: int = 10
    review_every: int = 15
    review_floor: int = 10
    sync_minutes: float = 30.0
    max_tags: int = 7
    max_frontmatter_tags: int = 15
    strict_gate: bool = True
    english_only: bool = False
    reflection_enabled: bool = True
    capture_enabled: bool | None = None  # as reflection_enabled

    @property
    def captures(self) -> bool:
        return self.reflection_enabled if self.capture_enabled is None else self.capture_enabled


def as_bool(value: object, default: bool) -> bool:
    """Lenient: words for yes and no in any case, numbers, else the default."""
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return bool(value)
    word = str(value).strip().lower()
    return True if word in ("1", "true", "yes", "on") else False if word in ("0", "false", "no", "off", "") else default


def settings_from(given: object) -> Settings:
    """Defaults, overridden by the values of ``given`` that fit; everything else is ignored."""
    base, found = Settings(), {}
    for f in fields(Settings) if isinstance(given, dict) else ():
        if f.name not in given:
            continue
        default, value = getattr(base, f.name), given[f.name]
        if isinstance(default, bool) or f.name == "capture_enabled":
            found[f.name] = as_bool(value, base.captures if default is None else default)
        else:
            try:
                found[f.name] = type(default)(value)
            except (TypeError, ValueError):
                continue
    return replace(base, **found)


def matches(pattern: str, path: str) -> bool:
    """Whether a folder is covered by a rule: the folder itself, all below it (``**``), or shell wildcards."""
    pattern, path = pattern.rstrip("/"), path.rstrip("/")
    if pattern.endswith("/**"):
        return path == pattern[:-3] or path.startswith(pattern[:-2])
    if any(c in pattern for c in "*?["):
        return fnmatch.fnmatch(path, pattern)
    return path == pattern or path.startswith(pattern + "/")


def active_workspace(environment: str = "", session: str = "", folder: str = "", rules: dict[str, str] | None = None, configured: str = "", default: str = "default") -> str:
    """The first that is set of: environment, session, the rule for the folder, configuration, default."""
    by_folder = next((ws for pattern, ws in (rules or {}).items() if matches(pattern, folder)), "")
    return environment or session or by_folder or configured or default
