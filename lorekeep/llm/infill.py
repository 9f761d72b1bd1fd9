"""Fill-in-the-middle transformation: a text is cut at two ranks of its units and dealt out as prefix, suffix and middle.

Units are the matches of a pattern, left to right, here lines.  A text is passed over twice: the first pass counts the
units, the second advances a lazy match iterator to the two ranks.  No list of units is ever stored, so that beyond
the text and its output a row takes constant memory, whatever it holds.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, free_name, table, text_or_empty

LINES = r"[^\n]*\n|[^\n]+"
SEED = 7


@dataclass(frozen=True)
class Infill:
    """What ``transform`` does: ``rate`` percent of the texts are dealt out, ``spm_rate`` percent of these suffix first."""

    seed: int = SEED
    rate: int = 100
    spm_rate: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = LINES

    def __post_init__(self):
        marks = [self.prefix, self.suffix, self.middle]
        if not all(marks) or len(set(marks)) < 3 or any(a in b for a in marks for b in marks if a is not b):
            raise ValueError("the marks must be three strings of which none holds another")
        if not (0 <= self.rate <= 100 and 0 <= self.spm_rate <= 100):
            raise ValueError("rates are percentages")
        if re.match(self.unit, ""):
            raise ValueError("a unit must not match the empty string")


def draws(seed: int, key: object) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 from the hex SHA-256 of ``seed:key``; a null key counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def cut_points(text: str, unit: re.Pattern, h1: int, h2: int) -> tuple[int, int, int]:
    """The number of units, and where the prefix and the middle end (code points)."""
    n = sum(1 for _ in unit.finditer(text))
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    matches = unit.finditer(text)
    ends = [0, 0]
    for i, steps in enumerate((first, second - first)):
        ends[i] = ends[i - 1] if i else 0
        if steps:
            ends[i] = next(islice(matches, steps - 1, None)).end()
    return n, ends[0], ends[1]


def rebuild(output: str, form: str, how: Infill = Infill()) -> str:
    """The text that ``output`` was made from."""
    if form == "plain":
        return output
    if form == "psm":
        s = output.index(how.suffix, len(how.prefix))
        m = output.index(how.middle, s + len(how.suffix))
        prefix, suffix = output[len(how.prefix) : s], output[s + len(how.suffix) : m]
    else:
        p = output.index(how.prefix, len(how.suffix))
        m = output.index(how.middle, p + len(how.prefix))
        suffix, prefix = output[len(how.suffix) : p], output[p + len(how.prefix) : m]
    return prefix + output[m + len(how.middle) :] + suffix


def infill(text: str, key: object, how: Infill, unit: re.Pattern) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix length, middle length, output) of one text.

    A text stays plain if it is empty, holds a mark, is not drawn, or if its output would not read back as the text
    (which marks that begin and end alike could bring about).
    """
    h1, h2, h3, h4 = draws(how.seed, key)
    n, a, b = cut_points(text, unit, h1, h2)
    if text and h3 % 100 < how.rate and not (how.prefix in text or how.suffix in text or how.middle in text):
        if h4 % 100 < how.spm_rate:
            form, output = "spm", "".join((how.suffix, text[b:], how.prefix, text[:a], how.middle, text[a:b]))
        else:
            form, output = "psm", "".join((how.prefix, text[:a], how.suffix, text[b:], how.middle, text[a:b]))
        if rebuild(output, form, how) == text:
            return n, form, a, b - a, output
    return n, "plain", None, None, text


def transform(docs: DataFrame, how: Infill = Infill(), key: str = "doc_id", text: str = "text", out: str = "infilled") -> DataFrame:
    """``docs`` with n_units, form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and ``out``.

    Null texts count as empty and come out empty.  Draws depend on seed and key alone: rows that repeat a key are cut
    at the ranks that the same numbers give in their own texts, a null key draws as an empty one.  Existing columns of
    the five names are replaced, others are kept, whatever they are called; an empty table gives an empty result.
    Nothing is shuffled.
    """
    bound_batches(docs.sparkSession)
    made = ["n_units", "form", "prefix_chars", "middle_chars", out]
    kept = docs.drop(*(c for c in made if c.lower() not in (key.lower(), text.lower())))
    body, name = free_name(kept, "body"), free_name(kept, "name")
    rows = kept.withColumns({body: text_or_empty(text), name: F.col(key).cast("string")})
    schema = kept.schema
    for column, kind in zip(made, ("long", "string", "long", "long", "string")):
        schema = schema.add(column, kind)
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        unit = re.compile(how.unit)
        for batch in batches:
            keep = [i for i, n in enumerate(batch.schema.names) if n not in (body, name)]
            texts, keys = batch.column(body), batch.column(name)
            done = [infill(texts[i].as_py(), keys[i].as_py(), how, unit) for i in range(batch.num_rows)]
            columns = zip(*done) if done else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), *(pa.array(c, t) for c, t in zip(columns, types))], names=[*(batch.schema.names[i] for i in keep), *made]
            )

    return rows.mapInArrow(run, schema)


def restore(done: DataFrame, how: Infill = Infill(), form: str = "form", text: str = "infilled", out: str = "restored") -> DataFrame:
    """``done`` with the texts that the outputs were made from; a null output stays null."""

    @F.udf("string", useArrow=True)
    def back(output, form):
        return None if output is None else rebuild(output, form, how)

    return done.withColumn(out, back(F.col(text), F.col(form)))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restore(transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return done.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("infilled", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )


SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), ranks AS (
  SELECT doc_id, t, units, len(units) AS n,
    ('0x' || substr(h, 1, 8))::UBIGINT % (len(units) + 1)::UBIGINT AS r1, ('0x' || substr(h, 9, 8))::UBIGINT % (len(units) + 1)::UBIGINT AS r2,
    ('0x' || substr(h, 25, 8))::UBIGINT % 100 AS d4,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM drawn
), cut AS (
  SELECT doc_id, t, n, CASE WHEN plain THEN 'plain' WHEN d4 < 50 THEN 'spm' ELSE 'psm' END AS form,
    coalesce(array_to_string(units[1:least(r1, r2)::BIGINT], ''), '') AS p,
    coalesce(array_to_string(units[least(r1, r2)::BIGINT + 1:greatest(r1, r2)::BIGINT], ''), '') AS m,
    coalesce(array_to_string(units[greatest(r1, r2)::BIGINT + 1:], ''), '') AS s FROM ranks
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256
FROM cut"""
