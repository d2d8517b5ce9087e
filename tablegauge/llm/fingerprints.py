"""I-Match document fingerprints over randomised lexicons, in DataFrame functions only.

Terms are runs of letters and digits of the lower-cased whole text. The lexicon keeps the terms whose
share of documents lies in a band (a band of inverse document frequency). Each of several random
subsets of the lexicon keeps a term with its own chance, from one in 16 to one in 1,024, so that texts of
any length have subsets that hold a few of their terms. A document's fingerprint is a hash per subset, of its
distinct terms in the subset, sorted. Two documents are alike to the share of equal hashes among the
subsets that hold a term of either; if none does, they are alike if their texts are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablegauge.llm.common import bound_bucket, id_bounds
from tablegauge.session import rewritten

#: Share of documents, as lowest and highest count per 1,000 documents.
BAND = (1, 100)
#: Subsets by chance: a subset keeps a term if the first three hexadecimal digits of the MD5 of
#: `<subset>:<term>` are below its limit, of 4,096.
SUBSETS_BY_LIMIT = {"100": 5, "040": 8, "010": 13, "004": 6}
LIMITS = [limit for limit, n in SUBSETS_BY_LIMIT.items() for _ in range(n)]
SUBSETS = len(LIMITS)
HASH_DIGITS = 8
#: Stands for a subset without a term of the document.
NO_TERM = "." * HASH_DIGITS
#: The empty term, which every text has, is in this subset alone.
NO_SUBSET = -1
RANGE_DOCUMENTS = 2048
#: Up to so many terms the lexicon is broadcast (some 100 bytes each); a larger one is joined by
#: shuffle. A term of the band is in BAND[0] of 1,000 documents at least, so the lexicon has at most
#: 1,000 / BAND[0] times the mean number of distinct terms of a document, whatever the corpus.
BROADCAST_TERMS = 500_000


def terms(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))


def lexicon(docs: DataFrame, band: tuple[int, int] = BAND) -> DataFrame:
    """`term` and the numbers of its `subsets`, if any, plus one empty term in `NO_SUBSET`.

    Callers write it before they join it: a filter or a join on `subsets` of the unwritten frame would be pushed
    to every occurrence of every term.
    """
    rows = docs.count()
    counted = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    kept = counted.where((F.col("n") * 1000 >= band[0] * rows) & (F.col("n") * 1000 <= band[1] * rows))
    limits = F.array(*map(F.lit, LIMITS))
    digits = lambda i: F.substring(F.md5(F.concat(i.cast("string"), F.lit(":"), F.col("term"))), 1, 3)
    inside = F.filter(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda i: digits(i) < F.get(limits, i))
    empty = docs.sparkSession.range(1).select(F.lit("").alias("term"), F.array(F.lit(NO_SUBSET)).alias("subsets"))
    return kept.select("term", inside.alias("subsets")).unionByName(empty)


def _by_subset(hashes: Column) -> Column:
    """A hash by subset, null where no term is in it, of an array of (subset, hash) entries."""
    all_subsets = F.sequence(F.lit(0), F.lit(SUBSETS - 1))
    others = F.transform(F.array_except(all_subsets, hashes["subset"]), lambda i: F.struct(i.alias("subset"), F.lit(None).cast("string").alias("hash")))
    return F.array_sort(F.concat(hashes, others))["hash"]


def _shown(hashes: Column, digest: Column) -> Column:
    """The fingerprint as an array without nulls; a text without any term of the lexicon shows its own digest."""
    filled = F.exists(hashes, lambda h: h.isNotNull())
    return F.when(filled, F.transform(hashes, lambda h: F.coalesce(h, F.lit(NO_TERM)))).otherwise(F.array(digest))


def _likeness(a: Column, b: Column, same_text: Column) -> Column:
    both = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), F.coalesce(x == y, F.lit(False))))
    filled = F.size(F.filter(both, lambda x: x.isNotNull()))
    same = F.size(F.filter(both, lambda x: x))
    return F.when(filled > 0, same / F.greatest(filled, F.lit(1))).otherwise(same_text.cast("double"))


def _lookup(rows: DataFrame, words: DataFrame) -> DataFrame:
    """`rows` of terms, one for each `subset` of theirs; the empty term is in `NO_SUBSET`."""
    words = words.where(F.size("subsets") > 0)
    found = rows.join(F.broadcast(words) if words.count() <= BROADCAST_TERMS else words, "term")
    return found.withColumn("subset", F.explode("subsets")).drop("subsets")


def _hash() -> Column:
    """Hash of the sorted terms of a group."""
    return F.substring(F.md5(F.array_join(F.array_sort(F.collect_list("term")), " ")), 1, HASH_DIGITS)


def _entries(side: Column) -> Column:
    return F.collect_list(F.when(side & (F.col("subset") != NO_SUBSET), F.struct("subset", "hash")))


def fingerprints(docs: DataFrame, band: tuple[int, int] = BAND) -> DataFrame:
    """`text` and `fingerprint` (an array of hashes) per distinct text of `docs`; a null text counts as empty."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    words = rewritten(lexicon(texts, band))
    digested = texts.withColumn("digest", F.sha2("text", 256)).dropDuplicates(["digest"])
    found = _lookup(digested.select("digest", F.explode(F.array_append(terms(F.col("text")), F.lit(""))).alias("term")), words)
    made = found.groupBy("digest", "subset").agg(_hash().alias("hash")).groupBy("digest").agg(_entries(F.lit(True)).alias("found"))
    hashed = made.select("digest", _shown(_by_subset(F.col("found")), F.col("digest")).alias("fingerprint"))
    return digested.join(hashed, "digest").select("text", "fingerprint")


def edited_fingerprints(docs: DataFrame, band: tuple[int, int] = BAND) -> DataFrame:
    """Fingerprint of every text and of its edited text, and the likeness to that and to the next document.

    The edited text has the second half of the characters replaced by the first as many (or all) of
    the next document's, in ascending `doc_id` order (a null id first, rows of one id by text), the
    first document's after the last. Each document goes to one task with its neighbours: documents
    are dealt by ranges of their id; those of a range's first id also visit the range before, and
    those of the first id of all the last range, after all others.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = rewritten(lexicon(base, band))
    bounds = id_bounds(base, "doc_id", RANGE_DOCUMENTS, 1024)
    first = base.agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("none")).first()
    opens = F.col("doc_id").isNull() if first.none else F.col("doc_id") == F.lit(first.low).cast("long")
    place = bound_bucket("doc_id", bounds)
    opens_range = F.col("doc_id").isin(bounds) if bounds else F.lit(False)
    home = lambda range_no, visit: F.struct(range_no.cast("int").alias("range"), F.lit(visit).alias("visit"))
    homes = F.array(home(place, 0), home(F.when(opens_range, place - 1), 1), home(F.when(opens, F.lit(len(bounds))), 2))
    homes = F.filter(homes, lambda h: h["range"].isNotNull())
    order = Window.partitionBy("range").orderBy("visit", F.col("doc_id").asc_nulls_first(), "text")
    rows = (
        base.select("*", F.inline(homes))
        .withColumn("next", F.lead("text").over(order))
        .withColumn("place", F.row_number().over(order))
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("edited", F.expr("left(text, int(n_chars - n_chars div 2)) || left(coalesce(next, ''), int(n_chars div 2))"))
        .withColumn("digest", F.sha2("text", 256))
        .withColumn("edited_sha256", F.sha2("edited", 256))
    )
    facts = ["visit", "doc_id", "n_chars", "digest", "edited_sha256"]
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("text").alias("of")),
        F.struct(F.lit(1).alias("side"), F.when(F.col("visit") == 0, F.col("edited")).otherwise(F.lit("")).alias("of")),
    )
    parts = rows.select("range", "place", *facts, F.inline(sides)).select("range", "place", "side", *facts, F.explode(F.array_append(terms(F.col("of")), F.lit(""))).alias("term"))
    # facts stand on the empty term only; terms are grouped where the ranges of documents are already
    facts_once = F.when((F.col("term") == "") & (F.col("side") == 0), F.struct(*facts)).alias("facts")
    found = _lookup(parts, words).select("range", "place", "side", "subset", "term", facts_once)
    made = (
        found.groupBy("range", "place", "side", "subset")
        .agg(F.first("facts", ignorenulls=True).alias("facts"), _hash().alias("hash"))
        .groupBy("range", "place")
        .agg(F.first("facts", ignorenulls=True).alias("facts"), _entries(F.col("side") == 0).alias("of_text"), _entries(F.col("side") == 1).alias("of_edited"))
        .select("range", "place", "facts.*", _by_subset(F.col("of_text")).alias("a"), _by_subset(F.col("of_edited")).alias("b"))
    )
    following = Window.partitionBy("range").orderBy("place")
    text_of = lambda hashes, digest: F.array_join(_shown(F.col(hashes), F.col(digest)), "")
    return (
        made.withColumn("next_a", F.lead("a").over(following))
        .withColumn("next_digest", F.lead("digest").over(following))
        .where("visit = 0")
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            text_of("a", "digest").alias("fingerprint"),
            text_of("b", "edited_sha256").alias("edited_fingerprint"),
            _likeness(F.col("a"), F.col("b"), F.col("digest") == F.col("edited_sha256")).alias("near_edited"),
            _likeness(F.col("a"), F.col("next_a"), F.col("digest") == F.col("next_digest")).alias("near_next"),
        )
    )


FINGERPRINT_SQL = f"""
WITH base AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents),
paired AS (
    SELECT doc_id, text, length(text) AS n,
           coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST, text),
                    first_value(text) OVER (ORDER BY doc_id NULLS FIRST, text)) AS next,
           row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS place
    FROM base),
edited AS (
    SELECT *, left(text, n - n // 2) || left(next, n // 2) AS edited FROM paired),
sides AS (
    SELECT place, 0 AS side, text AS t FROM edited UNION ALL SELECT place, 1 AS side, edited AS t FROM edited),
parts AS (
    SELECT place, side, unnest(list_distinct(regexp_split_to_array(lower(t), '[^\\pL\\pN]+'))) AS term FROM sides),
words AS (
    SELECT term FROM parts WHERE side = 0 AND term <> '' GROUP BY term
    HAVING count(*) * 1000 >= {BAND[0]} * (SELECT count(*) FROM base)
       AND count(*) * 1000 <= {BAND[1]} * (SELECT count(*) FROM base)),
subsets(i, low) AS (VALUES {", ".join(f"({i}, '{limit}')" for i, limit in enumerate(LIMITS))}),
kept AS (SELECT term, i FROM words JOIN subsets ON substr(md5(i || ':' || term), 1, 3) < low),
found AS (
    SELECT p.place, p.side, k.i, left(md5(string_agg(p.term, ' ' ORDER BY p.term)), {HASH_DIGITS}) AS h
    FROM parts p JOIN kept k ON p.term = k.term GROUP BY p.place, p.side, k.i),
hashes AS (
    SELECT d.place, d.side, sha256(any_value(d.t)) AS digest, count(f.h) AS filled,
           list(coalesce(f.h, '{NO_TERM}') ORDER BY s.i) AS h
    FROM sides d CROSS JOIN subsets s LEFT JOIN found f ON f.place = d.place AND f.side = d.side AND f.i = s.i
    GROUP BY d.place, d.side),
following AS (
    SELECT place, h, digest, filled, coalesce(lead(h) OVER w, first_value(h) OVER w) AS next_h,
           coalesce(lead(digest) OVER w, first_value(digest) OVER w) AS next_digest
    FROM hashes WHERE side = 0 WINDOW w AS (ORDER BY place)),
full_rows AS (
    SELECT e.doc_id, e.n, b.digest AS edited_sha256, CASE WHEN a.filled > 0 THEN array_to_string(a.h, '') ELSE a.digest END AS fingerprint,
           CASE WHEN b.filled > 0 THEN array_to_string(b.h, '') ELSE b.digest END AS edited_fingerprint,
           list_filter(list_zip(a.h, b.h), lambda x: x[1] <> '{NO_TERM}' OR x[2] <> '{NO_TERM}') AS with_edited, a.digest = b.digest AS same_edited,
           list_filter(list_zip(a.h, a.next_h), lambda x: x[1] <> '{NO_TERM}' OR x[2] <> '{NO_TERM}') AS with_next, a.digest = a.next_digest AS same_next
    FROM edited e JOIN following a ON a.place = e.place JOIN hashes b ON b.place = e.place AND b.side = 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN len(with_edited) > 0 THEN len(list_filter(with_edited, lambda x: x[1] = x[2])) / CAST(len(with_edited) AS DOUBLE)
            ELSE CAST(same_edited AS DOUBLE) END AS near_edited,
       CASE WHEN len(with_next) > 0 THEN len(list_filter(with_next, lambda x: x[1] = x[2])) / CAST(len(with_next) AS DOUBLE)
            ELSE CAST(same_next AS DOUBLE) END AS near_next
FROM full_rows
"""
