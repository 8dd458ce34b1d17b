"""Operator 3, document fingerprints [native]: a Merkle tree over sections, paragraphs and phrases.

A section is a run of paragraphs: it ends at a blank line, or at a line break whose next line starts with one of
SECTION_STARTS, so its bounds follow from the text around them and not from positions. A paragraph is a line with its
break. A phrase ends at white space after a letter or sign of PHRASE_ENDS, or after PHRASE_MOST characters. Phrases put
together are the text again. A phrase's digest is its SHA-256; a paragraph's is that of its phrases' digests, a section's
that of its paragraphs', the root's that of its sections'. Cuts depend on the characters around them only, so that an edit
moves none but its neighbours; which letters cut is a matter of grain (some 40 characters a phrase in running text), and
text without any of them is cut by length.

The fingerprint is the tree as text: root, then per section 12 hexadecimal digits of its digest, then per paragraph its
phrases' digests cut to 24 bits in base 64 (four signs each): ``root|section:phrases,phrases|section:...``. Equal roots
mean equal texts; two trees with unlike roots are walked down only where digests differ (`edits`). Likeness is the
Dice coefficient of the two sets of phrase digests, 1 for equal roots.

Everything here is a DataFrame expression; there is no Python on the executors.

Nulls and odd rows: a null text is an empty one, whose tree is a root over one empty section; a table of one row has
itself as its next document; equal ids are put in order by text, so repeated rows follow one another; a null doc_id
comes first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.llm.common import load, shuffle_partitions

SECTION_STARTS = "A-Cnh-i"
PHRASE_ENDS = "dnrst.,!?;:|"
PHRASE_MOST = 64

_SECTION = rf"(?<=\n)(?=[{SECTION_STARTS}\n])"
_PHRASE = rf"(?s).{{0,{PHRASE_MOST - 2}}}?[{PHRASE_ENDS}]\s|.{{1,{PHRASE_MOST}}}"


LEAST = -(1 << 63)  # stands for a null doc_id when rows are put in order


def tree(text: Column) -> Column:
    """array<array<array<string>>>: sections, their paragraphs, their phrases' digests."""
    paragraph = lambda line: F.transform(F.regexp_extract_all(line, F.lit(_PHRASE), F.lit(0)), lambda p: F.sha2(p.cast("binary"), 256))
    section = lambda part: F.transform(F.split(part, r"(?<=\n)"), paragraph)
    return F.transform(F.split(F.coalesce(text, F.lit("")), _SECTION), section)


def _digest(values: Column) -> Column:
    return F.sha2(F.array_join(values, ",").cast("binary"), 256)


def _codes(phrases: Column) -> Column:
    """24 bits of each digest as four signs of base 64."""
    cut = F.transform(phrases, lambda x: F.substring(x, 1, 6))
    return F.translate(F.base64(F.unhex(F.array_join(cut, ""))), "\r\n", "")


def _sections(tree_: Column) -> Column:
    """array<struct(digest, codes)>, one a section."""
    paragraphs = F.transform(tree_, lambda s: F.transform(s, lambda p: F.struct(_digest(p).alias("digest"), _codes(p).alias("codes"))))
    return F.transform(paragraphs, lambda s: F.struct(_digest(F.transform(s, lambda p: p["digest"])).alias("digest"), F.array_join(F.transform(s, lambda p: p["codes"]), ",").alias("codes")))


def _joined(sections: Column) -> Column:
    root = _digest(F.transform(sections, lambda s: s["digest"]))
    return F.concat(root, F.lit("|"), F.array_join(F.transform(sections, lambda s: F.concat(F.substring(s["digest"], 1, 12), F.lit(":"), s["codes"])), "|"))


def with_fingerprint(df: DataFrame, text: str, fingerprint: str) -> DataFrame:
    """Adds the fingerprint of a text column, step by step so that no step is repeated."""
    df = df.withColumn("tempora_tree", tree(F.col(text)))
    df = df.withColumn("tempora_sections", _sections(F.col("tempora_tree"))).drop("tempora_tree")
    return df.withColumn(fingerprint, _joined(F.col("tempora_sections"))).drop("tempora_sections")


def phrase_set(fingerprint: Column) -> Column:
    """The distinct phrase codes that a fingerprint holds."""
    body = F.regexp_replace(F.substring(fingerprint, 66, 1 << 30), "[0-9a-f]{12}:", "")
    return F.array_distinct(F.regexp_extract_all(body, F.lit("[A-Za-z0-9+/]{4}"), F.lit(0)))


def likeness(a: Column, b: Column, set_a: Column, set_b: Column) -> Column:
    """1 for equal roots, else twice the shared phrase codes over all (Dice)."""
    both = F.size(set_a) + F.size(set_b)
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).when(both == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(set_a, set_b)) / both)


def edits(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds `only_a` and `only_b`: the numbers (from 0) of the sections of each fingerprint that the other doesn't hold."""

    def sections(c):
        return F.transform(F.slice(F.split(c, r"\|"), 2, 1 << 30), lambda s: F.substring(s, 1, 12))

    def missing(x, y):
        return F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: ~F.array_contains(y, F.get(x, i)))

    x, y = sections(F.col(a)), sections(F.col(b))
    return pairs.withColumn("only_a", missing(x, y)).withColumn("only_b", missing(y, x))


def _range_of(key: Column, splits: list[int]) -> Column:
    """How many of the sorted splits are at most key, by binary lifting over an array literal."""
    bits = max(1, len(splits).bit_length())
    known = F.array(*[F.lit(s).cast("long") for s in splits]) if splits else F.array().cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.coalesce(F.get(known, at + step - 1) <= key, F.lit(False)), step).otherwise(0))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, text, next_text, range, place, end), next by doc_id, after the last row the first.

    Rows are dealt once into ranges of doc_id between quantiles, and lead() works within a range. A copy of the first
    row of the next range (end = 1) stands at the end of each range, so no text is dealt out twice and no task holds
    all rows; the copies stay in the result, for further leads by (range, place), and have a null next_text.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(LEAST))
    n = ranges or max(2, min(shuffle_partitions(spark) * 4, 4000))
    quantiles = base.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10000)).first()[0] if n > 1 else []
    splits = sorted(set(quantiles or []))
    ranged = base.withColumn("range", _range_of(key, splits))
    starts = sorted((r.start, r.range) for r in ranged.groupBy("range").agg(F.min(key).alias("start")).collect())
    before = {r: starts[i - 1][1] for i, (_, r) in enumerate(starts)}
    first = ranged.where(key.isin([s for s, _ in starts])).groupBy("range").agg(F.min(F.struct(key.alias("k"), "text")).alias("row"))
    earlier = F.get(F.array(*[F.lit(before.get(i, 0)) for i in range(max(before, default=0) + 1)]), F.col("range"))
    ends = first.select(F.lit(None).cast("long").alias("doc_id"), F.col("row.text").alias("text"), earlier.alias("range"), F.lit(1).alias("end"))
    order = Window.partitionBy("range").orderBy("end", F.col("doc_id").asc_nulls_first(), "text")
    rows = ranged.withColumn("end", F.lit(0)).unionByName(ends)
    return rows.withColumn("next_text", F.lead("text").over(order)).withColumn("place", F.row_number().over(order))


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; one row a row of docs.

    Only texts are dealt out; the next fingerprint comes of a second lead over the same ranges.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    moved = F.expr("CAST(n_chars div 4 AS INT)")
    rows = with_fingerprint(rows, "text", "fingerprint")
    rows = rows.withColumn("edited", F.when(F.col("end") == 0, F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - moved), F.col("next_text").substr(F.lit(1), moved)))).drop("text", "next_text")
    rows = with_fingerprint(rows, "edited", "edited_fingerprint").withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")
    rows = rows.withColumn("next_fingerprint", F.lead("fingerprint").over(Window.partitionBy("range").orderBy("place"))).where("end = 0")
    for c in ("fingerprint", "edited_fingerprint", "next_fingerprint"):
        rows = rows.withColumn(f"set_{c}", phrase_set(F.col(c)))
    near = lambda other: likeness(F.col("fingerprint"), F.col(other), F.col("set_fingerprint"), F.col(f"set_{other}"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(load(spark, sf_dir, "documents"))
