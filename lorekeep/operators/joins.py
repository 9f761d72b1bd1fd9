"""Joins between entries, files and links: near copies, contradictions, routing, resolution, deduplication."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType, StructField, StructType

from ..functions import gate, paths, text
from ..session import forget, written
from . import blocks, index

#: Opposite words, words of negation, words that are no topic.
POLARITY = [("enabled", "disabled"), ("enable", "disable"), ("true", "false"), ("added", "removed"), ("add", "remove"), ("allowed", "forbidden"), ("allow", "forbid"), ("recommended", "deprecated"), ("supported", "unsupported"), ("required", "optional"), ("on", "off"), ("works", "broken"), ("fixed", "broken"), ("pass", "fail"), ("passing", "failing")]
NEGATIONS = ("not", "no", "never", "without", "can't", "cannot", "won't", "wont", "isn't", "isnt", "doesn't", "doesnt")
ROUTING_STOPWORDS = (
    "this that with from have been were they them their there would could should about which what when where while into than then some such very "
    "just only your you for the and but not all any are was has had its out via use uses used using"
).split()
STOPWORDS = [*ROUTING_STOPWORDS, *"will must may can ref tool decision".split()]

CLAIM = r"\[(ref|decision|tool|hypothesis)\]"


def keywords(t: str | Column) -> Column:
    return text.word_set(t, 4, STOPWORDS)


def polarity(t: str | Column) -> Column:
    """struct(terms, neg): the polar words of a text, and whether it has any negation."""
    low = F.lower(text.col(t))
    terms = list(dict.fromkeys(w for pair in POLARITY for w in pair))
    # one pass finds all of them: their ends are looked at, not taken, so that neighbours are found too
    found = F.array_intersect(F.array(*map(F.lit, terms)), F.regexp_extract_all(low, F.lit(f"(?<![{text.LETTERS}])(?:{'|'.join(terms)})(?![{text.LETTERS}])"), 0))
    neg = low.rlike(rf"(?:^|[^{text.LETTERS}'])(?:{'|'.join(NEGATIONS)})(?:$|[^{text.LETTERS}'])")
    return F.struct(found.alias("terms"), neg.alias("neg"))


def signature(p: Column) -> Column:
    """Polar words, marked ``:neg`` in a negated text, sorted."""
    return F.array_sort(F.transform(p["terms"], lambda w: F.when(p["neg"], F.concat(w, F.lit(":neg"))).otherwise(w)))


def opposite(a: Column, b: Column) -> Column:
    """Both halves of a pair in plain texts, or one word plain here and negated there."""
    halves = F.lit(False)
    for x, y in POLARITY:
        halves = halves | (F.array_contains(a["terms"], x) & F.array_contains(b["terms"], y)) | (F.array_contains(a["terms"], y) & F.array_contains(b["terms"], x))
    return (~a["neg"] & ~b["neg"] & halves) | ((a["neg"] != b["neg"]) & F.arrays_overlap(a["terms"], b["terms"]))


def claims(docs: DataFrame, path: str = "path", text_col: str = "text") -> DataFrame:
    """path, line, text of the lines that make a claim."""
    return docs.select(F.col(path).alias("path"), F.posexplode(text.lines(text_col)).alias("line", "text")).filter(F.col("text").rlike(CLAIM)).withColumn("line", F.col("line") + 1)


#: Entries or topics of a block, at so many words each.
LIST_ROWS, ROW_WORDS = 1024, 512
#: Words of a block of claims, and of sets; most frequent words of a task, which get bits of their own in maps as far as there are; times all sets that a pass sends.
CLAIM_WORDS, PREFIX_WORDS, FREQUENT, SENT = 8_000_000, 4_000_000, 65_536, 1


def _pairs_schema(id: DataType, *more: str) -> StructType:
    return StructType([StructField("id_a", id), StructField("id_b", id), *(StructField(n, IntegerType()) for n in more)])


def opposed_pairs(claims_: DataFrame, least: int = 3, within: str | None = None) -> DataFrame:
    """id_a < id_b (structs of path, line), n_shared of the claims (of one ``within``, if given) with opposite polarity that share ``least`` or more keywords.

    Claims that have no opposite in their group are out at once; the others meet in blocks, plain ones with negated ones, and plain
    ones with halves of opposite words among themselves.  All pairs that oppose each other and share enough are returned, which is
    the square of the claims where half of them say a word and the others deny it.
    """
    terms = list(dict.fromkeys(w for pair in POLARITY for w in pair))
    bit = {w: 1 << i for i, w in enumerate(terms)}
    partner = {w: sum(bit[y] for y in {p[1 - p.index(w)] for p in POLARITY if w in p}) for w in terms}
    any_of = lambda values: F.aggregate("p.terms", F.lit(0), lambda m, w: m.bitwiseOR(F.element_at(F.create_map(*(F.lit(x) for item in values.items() for x in item)), w)))
    rows = claims_.select(F.struct("path", "line").alias("id"), (F.lit(0) if within is None else F.col(within)).alias("g"), "text")
    rows = text.computed_once(rows, "p", polarity("text")).filter(F.size("p.terms") > 0)
    rows = rows.select("id", "g", keywords("text").alias("kw"), F.col("p.neg").alias("neg"), any_of(bit).alias("says"), any_of(partner).alias("denies")).withColumn("size", F.size("kw"))
    rows = written(rows.filter(F.col("size") >= least).withColumn("kw", F.array_join("kw", " ")), "claims", "zstd")
    of = lambda neg, name: F.bit_or(F.when(F.col("neg") == neg, F.col("says")).otherwise(0)).alias(name)
    said = rows.groupBy(F.xxhash64("g").alias("k")).agg(of(False, "plain"), of(True, "negated"))
    known = rows.withColumn("k", F.xxhash64("g")).join(said, "k").drop("k")
    meets = lambda c, other: F.col(c).bitwiseAND(F.col(other)) != 0
    schema = _pairs_schema(rows.schema["id"].dataType, "n_shared")

    def opposing(ours: str):
        def run(a: pa.Table, b: pa.Table) -> Iterator[pa.Table]:
            ma, mb = a.column(ours).to_numpy(), b.column("says").to_numpy()
            for i, j, c in blocks.shared(*blocks.numbered(a, b, "kw"), lambda x, y: least):
                hit = (c >= least) & ((ma[i] & mb[j]) != 0)
                if hit.any():
                    yield pa.table([a.column("id").take(pa.array(i[hit])), b.column("id").take(pa.array(j[hit])), pa.array(c[hit], pa.int32())], names=schema.names)

        return run

    columns = ["id", "g", "kw", "size", "says", "denies"]
    plain, negated = known.filter(~F.col("neg")), known.filter("neg")
    across = blocks.meet(plain.filter(meets("says", "negated")).select(columns), negated.filter(meets("says", "plain")).select(columns), CLAIM_WORDS, opposing("says"), schema)
    halves = blocks.meet(plain.filter(meets("denies", "plain")).select(columns), None, CLAIM_WORDS, opposing("denies"), schema)
    return blocks.once(across.unionByName(halves))


def contradictions(claims_: DataFrame, least: int = 3, within: str | None = None) -> DataFrame:
    """Both claims, shared keywords (eight at most, and their number) and polarities of the ``opposed_pairs``."""
    pairs = opposed_pairs(claims_, least, within).select(F.col("id_a").alias("ia"), F.col("id_b").alias("ib"), "n_shared").distinct()
    side = lambda s: claims_.select(F.struct("path", "line").alias(f"i{s}"), F.col("path").alias(f"path_{s}"), F.col("line").alias(f"line_{s}"), F.col("text").alias(f"text_{s}"), keywords("text").alias(f"kw_{s}"), signature(polarity("text")).alias(f"polarity_{s}"))
    both = pairs.join(side("a"), "ia").join(side("b"), "ib")
    return both.select("path_a", "line_a", "text_a", "path_b", "line_b", "text_b", F.slice(F.array_sort(F.array_intersect("kw_a", "kw_b")), 1, 8).alias("shared_entities"), "n_shared", "polarity_a", "polarity_b")


def similar_pairs(rows: DataFrame, low: float, high: float = 1.0, key: str = "id", text_col: str = "text", least: int = 4, within: str | None = None) -> DataFrame:
    """id_a < id_b, similarity of the pairs (of one ``within``, if given) with low <= Jaccard of word sets <= high.

    Sets meet in blocks of about a size, as they are written, in passes of a bounded part of them; a task compares bit maps and
    counts the shared words of what may be similar, so that only pairs with their similarity leave it.
    """
    sets = rows.select(F.col(key).alias("id"), (F.lit(0) if within is None else F.col(within)).alias("g"), text.word_set(text_col, least).alias("ws"))
    sets = sets.withColumn("size", F.size("ws")).filter("size > 0")
    sets = written(sets.withColumn("ws", F.array_join("ws", " ")), "sets", "zstd")  # words of an array take twice as much in a shuffle
    schema = _pairs_schema(sets.schema["id"].dataType).add("similarity", DoubleType())

    def run(a: pa.Table, b: pa.Table) -> Iterator[pa.Table]:
        same = b is a
        a = a.sort_by([("g", "ascending"), ("size", "ascending")])
        b = a if same else b.sort_by([("g", "ascending"), ("size", "ascending")])
        m, n = a.column("size").to_numpy(), b.column("size").to_numpy()
        for i, j, c in blocks.alike(a, b, "ws", low, FREQUENT):
            similarity = c / (m[i] + n[j] - c)
            hit = (similarity >= low) & (similarity <= high)
            if hit.any():
                yield pa.table([a.column("id").take(pa.array(i[hit])), b.column("id").take(pa.array(j[hit])), pa.array(similarity[hit])], names=schema.names)

    met = blocks.meet(sets, None, PREFIX_WORDS, run, schema, low, SENT).filter(F.col("id_a") != F.col("id_b"))
    return met.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "similarity")


def lint_pairs(rows: DataFrame, key: str = "id", text_col: str = "text", within: str | None = None) -> DataFrame:
    """Pairs alike enough to be about one thing and too different to be copies: 0.4 to 0.85, and 0.15 apart."""
    return similar_pairs(rows, 0.4, 0.85, key, text_col, within=within).filter(1.0 - F.col("similarity") >= 0.15)


def first_free(edges: DataFrame) -> DataFrame:
    """(g, o): the nodes that are not free when all nodes of a group g are gone through in order.

    ``edges`` has (g, a, b) with a before b, both of one type that orders.  A node is free unless an earlier free node is its
    neighbour.  Done in rounds over edges whose ends are both open: nodes without an earlier open neighbour are free,
    which settles all their later neighbours.  No group is ever in one task; what a round settles is written.  The rounds
    are as many as the longest chain of nodes that wait for each other: few for clusters of like texts, half its
    length for a chain in which each is like the next only.  No edges give no nodes.
    """
    live = written(edges.select("g", "a", "b").distinct(), "edges")
    settled = []
    while not live.isEmpty():
        waiting = live.select("g", F.col("b").alias("a")).distinct()
        gone = written(live.join(waiting, ["g", "a"], "left_anti").select("g", F.col("b").alias("o")).distinct(), "settled")
        settled.append(gone)
        left = live.join(gone.withColumnRenamed("o", "a"), ["g", "a"], "left_anti").join(gone.withColumnRenamed("o", "b"), ["g", "b"], "left_anti")
        after = written(left.select("g", "a", "b"), "edges")
        forget(live)
        live = after
    return reduce(DataFrame.unionByName, settled) if settled else live.select("g", F.col("b").alias("o"))


def greedy_keep(rows: DataFrame, threshold: float = 0.85, group: str = "path", order: str = "line", text_col: str = "text") -> DataFrame:
    """``rows`` with kept: false where an earlier kept entry of the same group is as similar as the threshold.

    Only entries that have a similar one in their group are looked at, over their similar pairs alone, by ``first_free``.
    """
    rows = rows.withColumn("__id", F.struct(group, order))
    pairs = similar_pairs(rows, threshold, 1.0, "__id", text_col, within=group)
    edges = pairs.select(F.col(f"id_a.{group}").alias("g"), F.col(f"id_a.{order}").alias("a"), F.col(f"id_b.{order}").alias("b"))
    gone = first_free(edges).select("g", F.col("o").alias("b"), F.lit(True).alias("gone"))
    return rows.join(gone, (F.col(group) == F.col("g")) & (F.col(order) == F.col("b")), "left").withColumn("kept", F.col("gone").isNull()).drop("g", "b", "gone", "__id")


def themes(candidates: DataFrame, threshold: float = 0.3, id: str = "path", text_col: str = "text", order: str = "ord", within: str = "workspace") -> DataFrame:
    """within, seed, label, members: files of a workspace grouped around the first free one whose keywords are similar.

    Of equal labels the last stays.  Similar pairs are found by join; seeds are what ``first_free`` leaves, every other
    file goes to the first seed it is similar to, files without a similar one are their own themes, and labels are made
    afterwards of each member's three first keywords.
    """
    base = candidates.select(F.struct(F.col(order), F.col(id)).alias("id"), F.col(within).alias("g"), F.col(text_col).alias("t"))
    pairs = similar_pairs(base, threshold, 1.0, "id", "t", 5, "g").filter(F.col("similarity") > threshold)
    nodes = candidates.select(F.col(within).alias("g"), F.col(order).alias("o"), F.col(id).alias("p"), F.slice(F.array_sort(text.word_set(text_col, 5)), 1, 3).alias("kw"))
    edges = written(nodes.select("g", F.col("o").alias("a")).join(pairs.select(F.col(f"id_a.{order}").alias("a"), F.col(f"id_b.{order}").alias("b")), "a").select("g", "a", "b"), "pairs")
    taken = first_free(edges)
    # a taken file's earlier neighbours that are not taken are seeds
    seeds = edges.join(taken.withColumnRenamed("o", "a"), ["g", "a"], "left_anti").groupBy("g", F.col("b").alias("o")).agg(F.min("a").alias("seed"))
    placed = nodes.join(seeds, ["g", "o"], "left").withColumn("seed", F.coalesce("seed", "o"))
    in_order = F.array_sort(F.collect_list(F.struct((F.col("o") != F.col("seed")).alias("later"), "o", "p")))
    grouped = placed.groupBy("g", "seed").agg(F.transform(in_order, lambda m: m["p"]).alias("members"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("kw")))), 1, 3).alias("kw"))
    label = F.when(F.size("kw") > 0, F.array_join("kw", "-")).otherwise("misc")
    last = grouped.groupBy("g", label.alias("label")).agg(F.max_by(F.struct("members"), "seed").alias("m"))
    return last.select(F.col("g").alias(within), F.col("m.members")[0].alias("seed"), "label", F.col("m.members").alias("members"))


def duplicates(new: DataFrame, chunks: DataFrame, mode: str = "entry") -> DataFrame:
    """``new`` (with text) and is_duplicate: an equal (tag, hash) is stored already.

    ``mode="reference"`` takes the tag only from a bare prefix and compares whole chunks; ``"entry"`` sees bullets too.
    """
    pattern = r"^\s*\[([a-z-]+)\]" if mode == "reference" else gate.TAG_PREFIX
    tag = F.lower(F.regexp_extract("text", pattern, 1))
    rows = new.withColumns({"__tag": tag, "__hash": text.chunk_hash("text")})
    known = chunks.filter("tag <> ''").select(F.col("tag").alias("__tag"), F.col("hash").alias("__hash")).distinct().withColumn("__seen", F.lit(True))
    return rows.join(known, ["__tag", "__hash"], "left").withColumn("is_duplicate", F.coalesce("__seen", F.lit(False)) & (F.col("__tag") != "")).drop("__tag", "__hash", "__seen")


def salvage(blocks: DataFrame, stored: DataFrame, least: int = 20, whole: bool = False, order: tuple[str, ...] = ("path", "line")) -> DataFrame:
    """Blocks worth keeping that are not stored yet, each text once (the first by order).

    The least length counts after the prefix, or of the whole block with ``whole``.
    """
    body = F.trim("text") if whole else F.regexp_replace(F.trim("text"), r"(?i)^\s*[-*]\s+\[[a-z-]+\]\s*", "")
    fresh = blocks.filter(F.length(body) >= least).withColumn("hash", text.salvage_hash("text"))
    left = fresh.join(stored.select(text.salvage_hash("text").alias("hash")).distinct(), "hash", "left_anti")
    return index.first_wins(left, ["hash"], *order)


def unreviewed(transcripts: DataFrame, ledger: DataFrame) -> DataFrame:
    return transcripts.join(ledger.select("sid").distinct(), "sid", "left_anti")


# -- wikilinks --------------------------------------------------------------------------------------------------------

WIKILINK = r"\[\[([^\[\]\|#]+)(#[^\[\]\|]+)?(\|[^\[\]]+)?\]\]"


def wikilinks(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, pos, raw, target_ws, slug, section, alias of all links."""
    groups = F.arrays_zip(*(F.regexp_extract_all(text_col, F.lit(WIKILINK), i).alias(str(i)) for i in range(4)))
    rows = docs.select(*keys, F.posexplode(groups).alias("pos", "g"))
    token = text.split_token(F.col("g.1"))
    tail = lambda i: F.nullif(F.substring(F.col(f"g.{i}"), 2, 1 << 20), F.lit(""))
    return rows.select(*keys, "pos", F.col("g.0").alias("raw"), token["ws"].alias("target_ws"), token["slug"].alias("slug"), tail(2).alias("section"), tail(3).alias("alias"))


def resolve(links: DataFrame, slugs: DataFrame, files: DataFrame, current_ws: str = "ws") -> DataFrame:
    """``links`` with path and broken: by files first (README, folder note, flat note; top level before nested), then slug, then alias."""
    links = links.withColumn("__ws", F.coalesce("target_ws", F.col(current_ws)))
    inner, name = paths.inner("path"), paths.name("path")
    stem, folder = F.regexp_replace(name, r"\.md$", ""), paths.folder("path")
    nested = F.size(F.split(inner, "/"))
    places = files.filter(F.col("path").endswith(".md")).select(
        F.col("workspace").alias("__ws"), "path",
        F.when(F.col("workspace") == "shared", stem).when(name == paths.README, folder).otherwise(stem).alias("slug"),
        F.when(F.col("workspace") == "shared", 0).when(name == paths.README, F.when(nested == 2, 0).otherwise(1)).when(folder == stem, F.when(nested == 2, 2).otherwise(3)).otherwise(F.when(nested == 1, 4).otherwise(5)).alias("rank"),
    )
    catalog = slugs.select(F.col("workspace").alias("__ws"), "slug", "path", F.lit(6).alias("rank")).unionByName(slugs.select(F.col("workspace").alias("__ws"), F.explode("aliases").alias("slug"), "path", F.lit(7).alias("rank")))
    best = places.unionByName(catalog).groupBy("__ws", "slug").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    return links.join(best, ["__ws", "slug"], "left").withColumn("broken", F.col("path").isNull()).drop("__ws")


# -- routing ----------------------------------------------------------------------------------------------------------


def most_shared(entries: DataFrame, topics: DataFrame, least: int = 3, below: bool = False) -> DataFrame:
    """id, overlap, slug: for each entry (id, kw) the topic (ord, slug, kw) that shares most of its keywords, if ``least`` or more; of equals the first by ord.

    With ``below``, entries that share fewer with every topic have their largest overlap and no slug.  Blocks of entries meet
    blocks of topics, and a task counts the words of its pairs and keeps each entry's best: neither words nor pairs are rows.
    ``id`` and (ord, slug) are unique; sets are arrays of distinct words, null or empty ones share nothing.
    """
    if least < 1:
        raise ValueError("least must be at least 1")
    sized = lambda rows: rows.filter(F.size("kw") > 0).withColumns({"g": F.lit(0), "size": F.size("kw")})
    e = written(sized(entries.select("id", "kw")), "entry-sets")
    t = written(sized(topics.select(F.xxhash64("ord", "slug").alias("id"), "ord", "slug", "kw")), "topic-sets")
    schema = StructType([StructField("id_a", e.schema["id"].dataType), StructField("c", IntegerType()), StructField("ord", t.schema["ord"].dataType), StructField("slug", t.schema["slug"].dataType)])
    enough = 1 if below else least

    def best(a: pa.Table, b: pa.Table) -> Iterator[pa.Table]:
        b = b.sort_by([("ord", "ascending"), ("slug", "descending")])  # the first of equals is taken
        for i, j, c in blocks.shared(*blocks.numbered(a, b, "kw"), lambda x, y: enough):
            hit = np.flatnonzero(c >= enough)
            i, j, c = i[hit], j[hit], c[hit]
            order = np.lexsort((j, -c, i))
            first = order[np.r_[True, np.diff(i[order]) != 0]] if len(order) else order
            i, j, c = i[first], j[first], c[first]
            yield pa.table([a.column("id").take(pa.array(i)), pa.array(c, pa.int32()), b.column("ord").take(pa.array(j)), b.column("slug").take(pa.array(j))], names=schema.names)

    met = blocks.meet(e, t, LIST_ROWS * ROW_WORDS, best, schema, streamed=False)
    top = met.groupBy(F.col("id_a").alias("id")).agg(F.max(F.struct("c", (-F.col("ord")).alias("o"), "slug")).alias("m"))
    return top.select("id", F.col("m.c").alias("overlap"), F.when(F.col("m.c") >= least, F.col("m.slug")).alias("slug"))


def route(entries: DataFrame, topics: DataFrame, least: int = 3, default: str = "misc", key: str = "id", below: bool = False, guard: bool = True) -> DataFrame:
    """``entries`` (key, text) with slug, section, overlap.

    ``topics`` has ord (order of scanning), slug, text.  Side channels come first, then the topic file with most common
    keywords (the first of equals) if there are ``least``, else a new slug of the two longest keywords; with ``guard``, one that
    looks like a secret or a placeholder is ``default`` instead.  Overlaps under ``least`` are 0, or counted too with ``below``, which no routing needs.
    """
    first = F.split("text", "\n", 2)[0]
    tag = F.when(first.rlike(r"^\s*(?:[-*]|#{2,6})?\s*\[skill-ref:"), "skill-ref").otherwise(gate.tag_of(first))
    rows = entries.withColumns({"__tag": tag, "__kw": text.word_set("text", 4, ROUTING_STOPWORDS)})
    known = topics.filter(F.col("slug").rlike(text.SLUG)).select("ord", "slug", text.word_set("text", 4, ROUTING_STOPWORDS).alias("kw"))
    best = most_shared(rows.select(F.col(key).alias("id"), F.col("__kw").alias("kw")), known, least, below)
    best = best.select(F.col("id").alias(key), "overlap", F.col("slug").alias("__best"))
    new = text.slugify(text.longest("__kw", 2))
    new = text.guard_slug(new, default) if guard else new
    named = F.regexp_extract("text", r"\[skill-ref:([a-z0-9-]+)\]", 1)
    skill = F.coalesce(F.nullif(named, F.lit("")), F.when(F.size("__kw") > 0, text.slugify(text.longest("__kw", 1))), F.lit(default))
    slug = (
        F.when(F.col("__tag") == "secret-ref", "secrets").when(F.col("__tag") == "skill-ref", skill).when(F.size("__kw") == 0, default)
        .when(F.col("overlap") >= least, F.col("__best")).otherwise(new)
    )
    section = F.when(F.col("__tag").isin("exp", "reflection"), "## [exp]").when(F.col("__tag").isin("ref", "tool"), "## [ref]").when(F.col("__tag") == "decision", "## [decision]")
    return rows.join(best, key, "left").withColumns({"slug": slug, "section": section, "overlap": F.coalesce("overlap", F.lit(0))}).drop("__tag", "__kw", "__best")


def append_decisions(entries: DataFrame, topics: DataFrame, chunks: DataFrame, key: str = "id") -> DataFrame:
    """What writing each entry would do: status (written, duplicate, rejected), reason, slug, section, redacted text."""
    from ..functions import privacy

    routed = duplicates(route(entries, topics, key=key), chunks)
    reason = gate.reason("text")
    status = F.when(F.col("is_duplicate"), "duplicate").when(reason.isNotNull(), "rejected").otherwise("written")
    return routed.withColumns({"status": status, "reason": F.when(~F.col("is_duplicate"), reason), "clean": privacy.sanitize("text")}).select(key, "slug", "section", "status", "reason", F.col("clean.text").alias("text"), F.col("clean.n").alias("redactions"))
