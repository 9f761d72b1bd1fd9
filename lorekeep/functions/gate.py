"""The write gate: one CASE over ordered rules; the first that fails names the reason, null passes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LETTERS, col, squeeze

TAGS = ("decision", "exp", "ref", "tool", "reflection", "skill-ref", "secret-ref", "goal", "hypothesis")
MIN_BODY, HEDGE_RATIO, FEW_WORDS = 20, 0.25, 12

#: The patterns of the rules.
TAG_PREFIX = r"^\s*(?:[-*]|#{2,6})?\s*\[([a-zA-Z][a-zA-Z-]*)\]\s*"
HEDGE = r"maybe|i think|i guess|probably|might be|may be|perhaps|possibly|seems like|seems to|kinda|sort of|could be|not sure|dunno"
EVIDENCE = (
    r"(?i)(source:|tried:|fix:|root cause:|https?://|`[^`]+`|"
    r"\b[\w./-]+\.(py|md|js|ts|go|rs|json|yaml|yml|sh|sql|toml)\b|"
    r"\b[0-9a-f]{7,40}\b|:\d+\b|version:)"
)
RATIONALE = (
    r"because|since|so that|so|in order to|rationale|reason:|why:|due to|avoids?|prevents?|ensures?|otherwise|instead( of)?|"
    r"vì|bởi|để|do|tránh|thay vì|đảm bảo"
)
TRADEOFF = r"(?:chose|choose|chọn|prefer[\p{L}\p{N}_]*|pick[\p{L}\p{N}_]*)[^\p{L}\p{N}_](?:[^.\n]{0,79}[^\p{L}\p{N}_.\n])?over"
VERSION = r"(?i)(version:|v?\d+\.\d+|@[\w.-]+)"
COMMAND = r"`[^`]+`|```"
VERIFY = r"verify|verif[\p{L}\p{N}_]+|test|confirm|falsif[\p{L}\p{N}_]+|pending|validate|reproduce|check|expect|kiểm chứng|xác minh"
GOAL_STATUS = r"active|paused|achieved|abandoned|blocked|superseded|done[- ]when|success|criteria|target|objective|mục tiêu|hoàn thành"
PLACEHOLDER = r"(?i)^\s*(todo|tbd|fixme|xxx|wip|misc|random|stuff|note to self|investigate later|placeholder|n/?a|\.\.\.|-+)\s*$"
VIETNAMESE = "[àáảãạăắằẳẵặâấầẩẫậđèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵÀÁẢÃẠĂÂĐÈÉẺẼẸÊÌÍỈĨỊÒÓỎÕỌÔƠÙÚỦŨỤƯỲÝ]"
SECRETS = (
    r"AKIA[A-Z0-9]{16}",
    r"\bsk-[A-Za-z0-9]{32,}",
    r"\bghp_[A-Za-z0-9]{30,}",
    r"\bgho_[A-Za-z0-9]{30,}",
    r"\bghu_[A-Za-z0-9]{30,}",
    r"\bxox[bpsa]-[A-Za-z0-9-]{10,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
)


def whole(words: str) -> str:
    """A pattern of whole words, ready for rlike and for counting: letters of any script bound them."""
    return rf"(?i)(?:^|[^{LETTERS}])(?:{words})(?:$|[^{LETTERS}])"


def tag_of(text: str | Column) -> Column:
    """The entry's tag in lower case, empty for none."""
    return F.lower(F.regexp_extract(col(text), TAG_PREFIX, 1))


def known_tag(text: str | Column) -> Column:
    return F.when(tag_of(text).isin(*TAGS), tag_of(text)).otherwise("")


def body_of(text: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col(text), TAG_PREFIX, ""), r"^\s+|\s+$", "")


def hedge_hits(body: str | Column) -> Column:
    # every hedge is counted once between its own bounds: blanks are doubled so that neighbours do not share one
    spaced = F.concat(F.lit(" "), F.regexp_replace(col(body), rf"([^{LETTERS}])", "$1$1"), F.lit(" "))
    return F.regexp_count(spaced, F.lit(rf"(?i)[^{LETTERS}](?:{HEDGE.replace(' ', '[ ]{2}')})[^{LETTERS}]"))


def word_total(body: str | Column) -> Column:
    return F.size(F.regexp_extract_all(F.lower(col(body)), F.lit(f"[{LETTERS}]+"), 0))


def hedge_ratio(body: str | Column) -> Column:
    return hedge_hits(body) / F.greatest(word_total(body), F.lit(1))


def has_secret(text: str | Column) -> Column:
    found = F.lit(False)
    for pattern in SECRETS:
        found = found | col(text).rlike(pattern)
    return found


def reason(text: str | Column, strict: bool = True, english_only: bool = False) -> Column:
    """Why an entry is rejected, null if it is accepted."""
    raw = F.coalesce(col(text), F.lit(""))
    tag, body = tag_of(raw), body_of(raw)
    evident = raw.rlike(EVIDENCE)
    hits, words = hedge_hits(body), word_total(body)
    hedged = (hits > 0) & ~evident & (tag != "hypothesis") & ((hits / F.greatest(words, F.lit(1)) > HEDGE_RATIO) | (words < FEW_WORDS))
    rule = F.when(squeeze(raw) == "", "empty").when(has_secret(raw), "secret_leak")
    if english_only:
        rule = rule.when(F.regexp_count(raw, F.lit(VIETNAMESE)) > 2, "not_english")
    rule = rule.when(body.rlike(PLACEHOLDER), "placeholder").when(F.length(body) < MIN_BODY, "too_short").when(hedged, "hedged_no_evidence")
    if strict:
        sourced = raw.rlike(r"(?i)source:") | raw.rlike("https?://") | raw.rlike(whole("verified|verify path|xác minh|kiểm chứng")) | evident
        rule = (
            rule.when((tag == "ref") & ~sourced, "ref_without_source")
            .when((tag == "decision") & ~(raw.rlike(whole(RATIONALE)) | raw.rlike(whole(TRADEOFF)) | raw.contains("→")), "decision_without_rationale")
            .when((tag == "tool") & ~(raw.rlike(VERSION) | raw.rlike(COMMAND)), "tool_without_version_or_syntax")
            .when((tag == "hypothesis") & ~raw.rlike(whole(VERIFY)), "hypothesis_without_verify")
            .when((tag == "goal") & ~(raw.rlike(whole(GOAL_STATUS)) | raw.rlike(r"(?i)status:\s*\S")), "goal_without_status")
        )
    return rule


def lesson_reason(symptom: str | Column, others: Column) -> Column:
    """The lesson gate: a secret anywhere, a symptom under 8 characters, a placeholder."""
    s = F.coalesce(col(symptom), F.lit(""))
    return F.when(has_secret(F.concat_ws("\n", s, others)), "secret_leak").when(F.length(F.trim(s)) < 8, "symptom_too_short").when(s.rlike(PLACEHOLDER), "placeholder")
