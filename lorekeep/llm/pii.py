"""Surrogates for personal data.

Detected entities are replaced by others of their kind.  A surrogate is a keyed permutation of the entity within
its own format: letters stay letters of their script and case, digits digits, separators stay where they are,
card and account numbers keep valid check digits, and names take names of the same gender and script, given names and
surnames by maps of their own.  As a permutation it keeps different entities of one format apart, and as a function of
the entity alone it gives an entity the same surrogate wherever it occurs.  What a permutation cannot promise is checked
over the whole corpus: a surrogate that is a real entity of the corpus, or that two entities share, is drawn again under
the next round of the key, until none is left.  Names, whose surrogates are few, are drawn from a larger range in every
round; secrets and addresses leave their format after ``FORMAT_ROUNDS``, as some formats hold too few values.

Detected are: secrets (beside a key word, or keys that show by their format), e-mail addresses, IBANs and card numbers
with valid check digits, IPv4 and IPv6 addresses, telephone numbers, numbers of the form 123-45-6789, and names in Latin,
Cyrillic or Greek letters after a title (and further mentions of the same whole name, or of its surname, in that text).  Out of scope are
names without any title, dates of birth and postal addresses.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from functools import lru_cache
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import privacy
from .common import bound_batches, discard, free_name, materialize, table, text_or_empty

#: Where the key is configured.  Who has it can undo all surrogates but those of names.
KEY_SETTING = "spark.lorekeep.surrogate.key"
#: The key of the queries over synthetic tables, where none is configured; ``pseudonymize`` itself has no default.
SAMPLE_KEY = b"key of the synthetic tables"
#: Entities that needed more than one round, up to which they travel with the code; beyond, they are joined by document.
CLOSURE_ROWS = 50_000
#: Rounds in which secrets and local parts of addresses keep their format.
FORMAT_ROUNDS = 4
#: Rounds without a collision less after which a corpus counts as one whose entities fill their formats.
STALLED_ROUNDS = 32


def _letters_of(category: str) -> str:
    """The inside of a character class: all letters of a category in Latin, Greek or Cyrillic."""
    return "".join(chr(c) for c in range(0x41, 0x2000) if unicodedata.category(chr(c)) == category and unicodedata.name(chr(c)).split()[0] in ("LATIN", "GREEK", "CYRILLIC"))


_UP, _LOW = f"[{_letters_of('Lu')}]", f"[{_letters_of('Ll')}]"
#: What may stand between the parts of one entity: blanks, and the decoration of noisy texts.
_GAP = r"[\s|!#$%&*]*+"
_EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Titles, also in capitals; the Russian ones also in small letters.
_FEMALE = frozenset("Mrs Ms Miss Lady Dame Madame Mme Mademoiselle Herrin Frau Señora Sra Señorita Г-жа Госпожа Κυρία".split())
_ANY = frozenset("Dr Prof Doctor Professor Доктор Профессор".split())
_MALE = frozenset("Mr Sir Lord Monsieur Herr Señor Sr Г-н Господин Κύριος".split())
_FEMALE_SMALL, _MALE_SMALL = frozenset(t.lower() for t in _FEMALE), frozenset(t.lower() for t in _MALE)
#: A title of each gender.
_TITLE_OF = {"f": "Mrs", "m": "Mr", "n": "Dr"}
_RUSSIAN = re.compile("[а-яё]")
_TITLES = {form for t in _FEMALE | _ANY | _MALE for form in (t, t.upper(), *([t.lower()] if _RUSSIAN.search(t) else []))}
_TITLE = "(?:" + "|".join(sorted(_TITLES, key=lambda t: (-len(t), t))) + ")"
_WORD = rf"(?:(?:Mc|Mac|[OD]['’])?{_UP}{_LOW}+(?:[-'’]{_UP}{_LOW}+)*)"
_CAPS = rf"(?:[OD]['’])?{_UP}{{2,}}(?:[-'’]{_UP}+)*"
#: Initials and up to four words, in capitals throughout or not; no title is a part of a name.
_NAME = rf"(?!{_TITLE}\b)(?:{_UP}\.\s*)*(?:{_WORD}(?:\s+(?:{_UP}\.\s*)*(?!{_TITLE}\b){_WORD}){{0,3}}|{_CAPS}(?:\s+(?:{_UP}\.\s*)*(?!{_TITLE}\b){_CAPS}){{0,3}}\b)"
#: What may announce a telephone number that is written with blanks alone.
_CALL = r"(?i:\b(?:call|phone|telephone|tel|fax|mobile|cell|dial|text|ring))\b[.:#]?(?: (?:me|us|at|on|no|number)\b[.:]?){0,2} ?"
#: Without quotes, a word is a secret if it has a digit or is as long as ``functions.privacy`` asks; stops after it are not of it.
_UNQUOTED = r"(?=[^\"'\s,;]*\d)[^\"'\s,;]{5,}[^\"'\s,;.:!?)\]}|#$%&*]|[A-Za-z0-9_\-.+/=]{11,}[A-Za-z0-9_\-+/=]"
#: Keys that show by their own format, in ``functions.privacy``; all but a bot's token begin with one of a few letters.
_KEY_LABELS = frozenset(
    "aws-access-key github-pat github-oauth github-app github-refresh github-fine-grained gitlab-pat npm-token pypi-token openai-proj-key anthropic-key openai-key "
    "slack-token slack-webhook google-api-key stripe-key sendgrid twilio-sid jwt".split()
)
_KEYS = "|".join(p for label, p in privacy.PATTERNS if label in _KEY_LABELS)
_BOT = dict(privacy.PATTERNS)["discord-bot"]
_GROUP = r"[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "secret": rf"(?i:(?:api[_-]?key|secret|token|password|passwd|pwd|access[_-]?key)\b){_GAP}[:=]{_GAP}(?:[\"'](?P<secret>[^\"'\s]{{6,}})[\"']|(?P<unquoted>{_UNQUOTED}))",
    "key": rf"\b(?P<key>(?=[ASeghnprsx])(?:{_KEYS})|{_BOT})",
    "email": rf"(?<![A-Za-z0-9._%+\-])[._%+\-]*+(?P<email>{_EMAIL})",
    "ip6": rf"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?P<ip6>(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}(?::{_GROUP}){{0,6}})?::(?:{_GROUP}(?::{_GROUP}){{0,6}})?)(?![\w:]|\.\w)",
    "iban": r"\b(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b",
    "ip": rf"(?<![\d.])(?P<ip>{_OCTET}(?:\.{_OCTET}){{3}})(?![\d]|\.\d)",
    "card": r"(?<!\d)(?P<card>\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{13,19})(?!\d)",
    "phone": rf"(?P<phone>\+\d{{1,3}}{_GAP}(?:\(\d{{1,4}}\)|\d{{1,4}})(?:{_GAP}[-.]?{_GAP}\d{{2,4}}){{2,4}}|(?<![\d.])\(\d{{3}}\){_GAP}\d{{3}}-\d{{4}}|(?<![\d.\-])(?:\d{{3}}[-.]\d{{3}}[-.]\d{{4}}|0\d{{2,4}}[ -]\d{{3,4}}[ -]\d{{3,4}})|{_CALL}(?P<blanks>\d{{3}} \d{{3}} \d{{4}}))(?!\d)",
    "ssn": r"(?<![\d\-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d\-])",
    "person": rf"\b(?P<title>(?:{_TITLE}\.?\s+){{0,3}}{_TITLE})\.?\s+(?P<person>{_NAME})",
}
#: What stands in every key of ``_KEYS``, and the end of a bot's.
_KEY_MARKS = "AKIA ASIA ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- npm_ pypi- sk- xoxa- xoxb- xoxp- xoxr- xoxs- hooks.slack AIza _live_ _test_ SG. eyJ".split()
_KEY_REST = re.compile(r"(?:SK|AC|AU)[a-f0-9]{32}|\.[A-Za-z0-9_\-]{6}\.")
_KEY_WORDS = "key secret token password passwd pwd".split()


def _hint(pattern: str):
    search = re.compile(pattern).search
    return lambda text: search(text) is not None


def _names_a_secret(text: str) -> bool:
    small = text.casefold()
    return any(w in small for w in _KEY_WORDS)


#: A text without its hint holds no entity of a pattern, and is not searched for it.
HINTS = {
    "secret": _names_a_secret,
    "key": lambda text: any(w in text for w in _KEY_MARKS) or _KEY_REST.search(text) is not None,
    "email": lambda text: "@" in text,
    "ip6": _hint(r":(?::|[0-9A-Fa-f]{1,4}:)"),
    "iban": _hint(r"[A-Z]{2}\d{2}"),
    "ip": _hint(r"\d\.\d{1,3}\."),
    "card": _hint(r"\d{4}[ -]?\d{4}"),
    "phone": _hint(r"\+\d|\(\d|\d\d[-. ]\d{3}"),
    "ssn": _hint(r"\d-\d\d-\d"),
    "person": _hint(_TITLE),
}
KINDS = ("secret", "email", "iban", "ip", "ip6", "card", "phone", "ssn", "person")

#: Given names by script and gender (n: the title does not tell), and the syllables that other names are made of.
GIVEN = {
    ("latin", "f"): "Alma Bea Clara Dora Edda Flora Greta Hanna Ida Jana Klara Lena Mira Nora Olga Petra Rosa Sara Tilda Vera".split(),
    ("latin", "m"): "Adam Boris Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Max Noah Oskar Paul Rolf Simon Theo Viktor".split(),
    ("latin", "n"): "Alex Charlie Eden Jamie Kai Kim Luca Niki Noa Quinn Remy Robin Rory Sage Sam Sascha Toni".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Инна Лидия Мария Нина Ольга Полина Раиса Софья Тамара".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Марк Никита Олег Павел Роман Семён".split(),
    ("cyrillic", "n"): "Валя Женя Саша Слава Шура".split(),
    ("greek", "f"): "Άννα Ελένη Ζωή Μαρία Σοφία".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Κώστας Νίκος Πέτρος".split(),
    ("greek", "n"): "Άλεξ Λου Νίκη".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha ho ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo za ze".split(),
    "cyrillic": "ба бе бо ва ве да де до за зе ка ко ла ле ло ма ме мо на не но па по ра ре ро са се со та те то".split(),
    "greek": "βα βε γα γο δα δε ζα ζε κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε σα σε τα τε το".split(),
}
#: How made-up given names end by gender, and endings of surnames that stay, as gender shows in them.
ENDINGS = {"latin": {"f": "ra", "m": "n", "n": "i"}, "cyrillic": {"f": "ла", "m": "н", "n": "ся"}, "greek": {"f": "λα", "m": "ς", "n": "ι"}}
SURNAME_ENDING = re.compile(r"(?<=..)(?:[оеё]ва|[оеё]в|[иы]на|[иы]н|[сц]кий|[сц]кая)$")
#: A draw has 256 bits, and this many syllables fewer.
MOST_SYLLABLES = 40
_RANGES = [(ord("0"), 10), (ord("a"), 26), (ord("A"), 26), (ord("а"), 32), (ord("А"), 32), (ord("α"), 17), (ord("Α"), 17)]


def _draw(key: bytes, tweak: str, round_: int, i: int, x: int) -> int:
    out, n = b"", 1 + x.bit_length() // 8
    for block in range(n // 32 + 1):
        out += hmac.new(key, f"{tweak}\x00{round_}\x00{i}\x00{block}\x00{x:x}".encode(), hashlib.sha256).digest()
    return int.from_bytes(out, "big")


def _letters(key: bytes, tweak: str, round_: int, n: int) -> str:
    """So many small letters and digits, drawn by ``tweak``."""
    out = ""
    for i in range(0, n, 16):
        x = _draw(key, tweak, round_, i, 0)
        for _ in range(min(16, n - i)):
            x, d = divmod(x, 36)
            out += "abcdefghijklmnopqrstuvwxyz0123456789"[d]
    return out


def permute(x: int, a: int, b: int, key: bytes, tweak: str, round_: int) -> int:
    """A keyed permutation of 0 .. a*b - 1: a Feistel network of eight steps on the two mixed-radix halves."""
    left, right = divmod(x, b)
    for i in range(0, 8, 2):
        left = (left + _draw(key, tweak, round_, i, right)) % a
        right = (right + _draw(key, tweak, round_, i + 1, left)) % b
    return left * b + right


def permute_format(text: str, key: bytes, tweak: str, round_: int) -> str:
    """``text`` permuted among the texts of the same format: class and place of every letter and digit."""
    slots = []
    for i, c in enumerate(text):
        for first, n in _RANGES:
            if first <= ord(c) < first + n:
                slots.append((i, first, n))
                break
    if not slots:
        return text
    shape = "".join(f"{first:x}." if i in {s[0] for s in slots} else c for i, c, first in ((i, c, next((s[1] for s in slots if s[0] == i), 0)) for i, c in enumerate(text)))
    half = (len(slots) + 1) // 2
    a = b = 1
    x = 0
    for j, (i, first, n) in enumerate(slots):
        a, b = (a * n, b) if j < half else (a, b * n)
        x = x * n + ord(text[i]) - first
    x = permute(x, a, b, key, f"{tweak}\x01{shape}", round_)
    out = list(text)
    for i, first, n in reversed(slots):
        x, d = divmod(x, n)
        out[i] = chr(first + d)
    return "".join(out)


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = sum(d if i % 2 else (2 * d) // 10 + (2 * d) % 10 for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def canonical(kind: str, text: str, title: str = "") -> str:
    """What makes two mentions the same entity."""
    if kind == "email":
        return text.lower()
    if kind in ("card", "ssn", "phone"):
        return "+" * text.startswith("+") + re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "ip6":
        return ipaddress.IPv6Address(text).compressed
    if kind == "person":
        # of several titles one that tells the gender counts
        said = {t.strip(".").lower() for t in title.split()}
        gender = "f" if said & _FEMALE_SMALL else "m" if said & _MALE_SMALL else "n"
        words = re.sub(r"[.]", ". ", text).split()
        return f"{gender}:{' '.join(re.sub(r'[^-’' + chr(39) + r']+', lambda m: m[0].capitalize(), w) if len(w) > 1 and w.isupper() and not w.endswith('.') else w for w in words)}"
    return text


def iban_digits(country: str, account: str) -> str:
    """The two check digits of an account number."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in f'{account}{country}00')) % 97:02d}"


def genuine(kind: str, text: str) -> bool:
    """Whether what a pattern found has the check digits or the form that its kind asks for."""
    if kind == "card":
        digits = re.sub(r"\D", "", text)
        return luhn_digit(digits[:-1]) == digits[-1]
    if kind == "iban":
        number = text.replace(" ", "")
        return iban_digits(number[:2], number[4:]) == number[2:4]
    if kind == "ip6":
        try:
            return ipaddress.IPv6Address(text) is not None
        except ValueError:
            return False
    return True


def _script(word: str) -> str:
    first = ord(word[0])
    return "cyrillic" if 0x400 <= first < 0x530 else "greek" if 0x370 <= first < 0x400 or 0x1F00 <= first < 0x2000 else "latin"


def _made_up(key: bytes, tweak: str, round_: int, syllables: list[str], n: int) -> str:
    x, out = _draw(key, tweak, round_, 0, 0), ""
    for _ in range(min(n, MOST_SYLLABLES)):
        x, d = divmod(x, len(syllables))
        out += syllables[d]
    return out


def name_parts(entity: str) -> list[tuple[str, str]]:
    """The parts of a person (gender:name) that have surrogates of their own: (kind, what is mapped) with what stands between as kind ''."""
    gender, _, name = entity.partition(":")
    words = name.split()
    out: list[tuple[str, str]] = []
    for i, word in enumerate(words):
        out += [("", " ")] * (i > 0)
        for part in re.split(r"([-'’])", word):
            if part in ("-", "'", "’"):
                out.append(("", part))
            elif part.endswith(".") or len(part) == 1:
                out.append(("initial", part))
            elif i < len(words) - 1:
                out.append(("given", f"{gender}:{part}"))
            else:
                end = m[0] if (m := SURNAME_ENDING.search(part)) else ""
                out += [("surname", part[: len(part) - len(end)]), *([("", end)] if end else [])]
    return out


def mapped(kind: str, entity: str) -> list[tuple[str, str]]:
    """What of an entity is mapped, and must be told apart in the corpus: the parts of a name, else the entity."""
    return [p for p in name_parts(entity) if p[0] in ("given", "surname")] if kind == "person" else [(kind, entity)]


def name_surrogate(entity: str, round_of, key: bytes) -> str:
    """The surrogate of a person, ``round_of`` being the round of each (kind, part)."""
    gender, out = entity[:1], []
    for kind, part in name_parts(entity):
        new = part if not kind else permute_format(part, key, "initial", 0) if kind == "initial" else surrogate(kind, part, round_of((kind, part)), key)
        out.append(new.partition(":")[2] if kind == "given" else new)
    return f"{gender}:{''.join(out)}"


def surrogate(kind: str, entity: str, round_: int, key: bytes) -> str:
    """The surrogate of a canonical entity, itself canonical and of the same kind, and up to ``FORMAT_ROUNDS`` of the same format."""
    wider = 4 * (round_ - FORMAT_ROUNDS + 1)
    if kind == "secret" and wider > 0:
        return _letters(key, f"secret\x01{entity}", round_, len(entity) + wider)
    if kind == "email":
        local, _, domain = entity.partition("@")
        head, _, top = domain.rpartition(".")
        more = _letters(key, f"local\x01{entity}", round_, wider) if wider > 0 else ""
        return f"{permute_format(local, key, 'local', round_)}{more}@{permute_format(head, key, 'domain', round_)}.{top}"
    if kind == "ip":
        a, b, c, d = map(int, entity.split("."))
        x = permute(((a * 256 + b) * 256 + c) * 256 + d, 1 << 16, 1 << 16, key, "ip", round_)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if kind == "ip6":
        return ipaddress.IPv6Address(permute(int(ipaddress.IPv6Address(entity)), 1 << 64, 1 << 64, key, "ip6", round_)).compressed
    if kind == "card" and luhn_digit(entity[:-1]) == entity[-1]:
        body = permute_format(entity[:-1], key, "luhn", round_)
        return body + luhn_digit(body)
    if kind == "phone" and entity.startswith("+"):
        n = max(0, len(entity) - 10)
        return entity[:n] + permute_format(entity[n:], key, "phone", round_)
    if kind == "phone" and entity.startswith("0"):
        return "0" + permute_format(entity[1:], key, "phone0", round_)
    if kind == "iban":
        account = permute_format(entity[4:], key, f"iban\x01{entity[:2]}", round_)
        return entity[:2] + iban_digits(entity[:2], account) + account
    if kind == "person":
        return name_surrogate(entity, lambda part: round_, key)
    if kind == "given":
        gender, _, name = entity.partition(":")
        script = _script(name)
        if not round_:
            given = GIVEN[script, gender]
            return f"{gender}:{given[_draw(key, f'given\x01{entity}', 0, 1, 0) % len(given)]}"
        return f"{gender}:{(_made_up(key, f'given\x01{entity}', round_, SYLLABLES[script], 1 + round_) + ENDINGS[script][gender]).capitalize()}"
    if kind == "surname":
        return _made_up(key, f"name\x01{entity}", round_, SYLLABLES[_script(entity)], 3 + round_).capitalize()
    return permute_format(entity, key, kind, round_)


def shaped(kind: str, original: str, entity: str, new: str) -> str:
    """The canonical surrogate written as the original was: its case, separators and blanks."""
    if kind == "email":
        return "".join(n.upper() if o.isupper() else n for o, n in zip(original, new)) if len(new) == len(original) else new
    if kind in ("card", "ssn", "phone"):
        digits = iter(re.sub(r"\D", "", new))
        return re.sub(r"\d", lambda _: next(digits), original)
    if kind == "iban":
        letters = iter(new)
        return "".join(c if c == " " else next(letters) for c in original)
    if kind == "person":
        name = new.partition(":")[2]
        return name.upper() if len(original) > 2 and original.isupper() else name
    return new


@lru_cache(1 << len(PATTERNS))
def _detector(names: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(PATTERNS[n] for n in names))


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical entity) of every entity, in order and disjoint; bare mentions of a titled name, and of its surname, count too."""
    searched = tuple(n for n, hint in HINTS.items() if hint(text))
    if not searched:
        return []
    found = []
    for m in _detector(searched).finditer(text):
        group = m.lastgroup
        kind = {"unquoted": "secret", "key": "secret", "blanks": "phone"}.get(group, group)
        if genuine(kind, m[group]):
            found.append((m.start(group), m.end(group), kind, canonical(kind, m[group], m["title"] if kind == "person" else "")))
    titled = {text[a:b]: e for a, b, kind, e in found if kind == "person"}
    names = {}
    for name, e in titled.items():
        given, _, last = name.rpartition(" ")
        if given and len(last) > 2:
            # a surname has a map of its own, so that the bare one gets the whole name's
            names.setdefault(last, canonical("person", last, _TITLE_OF[e[0]]))
    names |= titled
    if names:
        bare = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")\b")
        taken = [(a, b) for a, b, _, _ in found]
        extra, at = [], 0
        for m in bare.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at == len(taken) or taken[at][0] >= m.end():
                extra.append((m.start(), m.end(), "person", names[m[0]]))
        found = sorted(found + extra)
    return found


def replace(text: str, rounds: dict[tuple[str, str], int], key: bytes, cache: dict | None = None) -> tuple[str, int]:
    """``text`` with its entities replaced, and their number.  ``rounds`` has what is mapped and whose round is not 0."""
    out, at, found = [], 0, detect(text)
    cache = {} if cache is None else cache
    for a, b, kind, entity in found:
        new = cache.get((kind, entity))
        if new is None:
            if len(cache) > 100_000:
                cache.clear()
            round_of = lambda part: rounds.get(part, 0)
            new = cache[kind, entity] = name_surrogate(entity, round_of, key) if kind == "person" else surrogate(kind, entity, round_of((kind, entity)), key)
        out += [text[at:a], shaped(kind, text[a:b], entity, new)]
        at = b
    return "".join([*out, text[at:]]), len(found)


def _with_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, round -> with the surrogate under that round."""

    def run(batches):
        for batch in batches:
            kinds, values, rounds = (batch.column(c).to_pylist() for c in ("kind", "entity", "round"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(*x, key) for x in zip(kinds, values, rounds)], pa.string())], names=["kind", "entity", "round", "new"])

    return entities.select("kind", "entity", "round").mapInArrow(run, "kind string, entity string, round int, new string")


def entities_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """kind, entity: what is mapped of the distinct entities of all texts."""

    def run(batches):
        for batch in batches:
            seen = {part for t in batch.column("t").to_pylist() for _, _, kind, e in detect(t) for part in mapped(kind, e)}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([e for _, e in seen], pa.string())], names=["kind", "entity"])

    return docs.select(text_or_empty(text).alias("t")).mapInArrow(run, "kind string, entity string").distinct()


def collision_rounds(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, round of the entities whose surrogate of round 0 is a real entity or another's surrogate.

    Raises ValueError if entities keep colliding: those of the corpus then fill a format that cannot be widened.
    """
    now = materialize(_with_surrogates(entities.withColumn("round", F.lit(0)), key), "pii-round")
    real = entities.select("kind", F.col("entity").alias("new"))
    fewest, since = None, 0
    for round_ in count(1):
        # of those that share a surrogate the least stays, one settled in an earlier round first
        shared = now.groupBy("kind", "new").agg(F.min(F.struct("round", "entity")).alias("m"), F.count("*").alias("c")).filter("c > 1").select("kind", "new", "m")
        taken = now.join(shared, ["kind", "new"]).filter((F.col("round") != F.col("m.round")) | (F.col("entity") != F.col("m.entity"))).select("kind", "entity")
        bad = materialize(now.join(real, ["kind", "new"], "left_semi").select("kind", "entity").unionByName(taken).distinct(), "pii-bad")
        left = bad.count()
        if not left:
            break
        fewest, since = (left, 0) if fewest is None or left < fewest else (fewest, since + 1)
        if since >= STALLED_ROUNDS:
            kinds = ", ".join(sorted(r.kind for r in bad.select("kind").distinct().collect()))
            raise ValueError(f"{left} entities have no surrogate of their own after {round_} rounds, as those of their format are used up: {kinds}")
        again = _with_surrogates(bad.withColumn("round", F.lit(round_)), key)
        before, now = now, materialize(now.join(bad, ["kind", "entity"], "left_anti").unionByName(again), "pii-round")
        discard(before, bad)
    again = materialize(now.filter("round > 0").select("kind", "entity", "round"), "pii-again")
    discard(now, bad)
    return again


def configured_key(spark: SparkSession) -> bytes | None:
    value = spark.conf.get(KEY_SETTING, None)
    return value.encode("utf-8") if value else None


def pseudonymize(docs: DataFrame, key: bytes | None = None, text: str = "text", count: str = "n_entities") -> DataFrame:
    """``docs`` with the entities of ``text`` replaced by surrogates, and their number in ``count``.

    Without ``key`` that of the setting ``KEY_SETTING`` is taken; ValueError if there is none.

    Null texts stay null with 0 entities, and texts without entities stay as they are.  Equal entities get equal
    surrogates in all rows and different ones different surrogates, repeated rows equal texts.  An empty table gives an
    empty result.  An existing column ``count`` is replaced.
    """
    if not (key := key or configured_key(docs.sparkSession)):
        raise ValueError(f"surrogates need a key: give one or set {KEY_SETTING}")
    bound_batches(docs.sparkSession)
    docs = docs.drop(count)
    entities = materialize(entities_of(docs, text), "pii-entities")
    again = collision_rounds(entities, key)
    discard(entities)
    names, schema = docs.columns, T.StructType([*docs.schema.fields, T.StructField(count, T.LongType())])

    def rewrite(batches, rounds_of):
        cache: dict = {}
        for batch in batches:
            texts, counts = [], []
            for row, t in enumerate(batch.column(text).to_pylist()):
                new, n = (None, 0) if t is None else replace(t, rounds_of(batch, row), key, cache if rounds_of is fixed else None)
                texts.append(new)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(i) for i, c in enumerate(names)] + [pa.array(counts, pa.int64())], names=[*names, count])

    rounds = {}
    if again.count() <= CLOSURE_ROWS:
        rounds = {(r.kind, r.entity): r.round for r in again.collect()}  # at most CLOSURE_ROWS
        discard(again)

        def fixed(batch, row):
            return rounds

        return docs.mapInArrow(lambda batches: rewrite(batches, fixed), schema)
    fixed = None
    hash_, found = free_name(docs, "text_hash"), free_name(docs, "rounds")

    def mentions(batches):
        for batch in batches:
            rows = [(h, kind, e) for h, t in zip(batch.column("h").to_pylist(), batch.column("t").to_pylist()) for kind, e in {part for x in detect(t) for part in mapped(x[2], x[3])}]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (list(zip(*rows)) or [(), (), ()])], names=["h", "kind", "entity"])

    held = docs.select(F.sha2(text_or_empty(text), 256).alias("h"), text_or_empty(text).alias("t")).mapInArrow(mentions, "h string, kind string, entity string").distinct()
    held = held.join(again, ["kind", "entity"]).groupBy("h").agg(F.collect_list(F.struct("kind", "entity", "round")).alias(found))  # entities of one text
    joined = docs.withColumn(hash_, F.sha2(text_or_empty(text), 256)).join(held.withColumnRenamed("h", hash_), hash_, "left").select(*names, found)

    def by_row(batch, row):
        return {(r["kind"], r["entity"]): r["round"] for r in batch.column(len(names))[row].as_py() or ()}

    return joined.mapInArrow(lambda batches: rewrite(batches, by_row), schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), configured_key(spark) or SAMPLE_KEY)
