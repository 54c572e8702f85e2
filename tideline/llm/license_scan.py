"""Licence scans by canonical digests.

A text's canonical form has lower case, no copyright lines, one spelling for equivalent words, and no
punctuation. Its digest is hash-joined, as a whole, to the digests of known licence texts; so is each of
its lines, for the known one-line notices.

Scale: DataFrame functions alone; everything happens in the row that holds the text, but for
broadcast joins with the known table, which is a constant of the release and whose size is checked."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import DIGESTS, IDENTIFIERS, LICENSES, NOTICES, SPELLINGS, TITLES
from .shared import let

MOST_KNOWN = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: A line is a copyright line if a year, a mark or a blank to fill in follows, or if it stands above the body; it goes
#: on with the next line where it ends with a comma, "and" or "&" and a letter follows.
COPYRIGHT = r"(^|\n)[^a-z0-9\n]*(?:copyright[ \t]*(?:\(c\)|\xA9|[\[<{]|[12][0-9]{3})|\(c\)[ \t]*[12][0-9]{3}|\xA9)(?:[^\n]*(?:,| and|&)[ \t\r]*\n[ \t]*[a-z])*[^\n]*"
FIRST = r"^([^\n]{0,60}licen[sc]e[^\n]{0,60}\n)?\s*copyright[ \t][^\n]*\n"
TITLE = "^(?:(?:the )?(?:" + "|".join((*TITLES, *(f"spdx license identifier {x}" for x in IDENTIFIERS))) + ") )+([a-z0-9])"


def spelled(text: Column) -> Column:
    """Lower case, no copyright lines."""
    t = F.translate(text, _UPPER, _LOWER)
    return F.regexp_replace(F.regexp_replace(t, COPYRIGHT, "$1"), FIRST, "$1")


def bare(text: Column) -> Column:
    """Words alone (letters, marks and digits of any script) in one spelling, one space between them, without titles, identifier
    lines or a reservation of rights."""
    t = F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), r"[^\p{L}\p{M}\p{N}]+", " ")
    for other, word in SPELLINGS:
        t = F.replace(t, F.lit(other), F.lit(word))
    return F.regexp_replace(F.trim(F.replace(t, F.lit(" all rights reserved "), F.lit(" "))), TITLE, "$1")


def digest(canonical: Column) -> Column:
    return F.sha2(canonical.cast("binary"), 256)


def known_licenses(spark: SparkSession, texts=LICENSES, notices=NOTICES, digests=DIGESTS) -> DataFrame:
    """license_id, kind (text or line), digest. Texts given twice count once, by the smallest id."""
    rows = [(n, "text", t, None) for n, t in texts] + [(n, "line", t, None) for n, t in notices] + [(n, "text", None, d) for n, d in digests]
    if len(rows) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known texts; give them as a table and join unbroadcast")
    one = F.array(*[F.struct(*[F.lit(v).cast("string").alias(c) for c, v in zip(("license_id", "kind", "x", "d"), r)]) for r in rows])
    table = spark.range(0, 1, 1, 1).select(F.explode(one).alias("r")).select("r.*")
    return table.groupBy("kind", F.coalesce("d", digest(bare(spelled(F.col("x"))))).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, text_digest, license_id (the whole text's licence or
    null), n_notices (lines that are known notices), notices (their distinct ids, sorted, joined by a comma).

    Whole texts are also held against the notices, so a text that is one notice has its licence. known may be any table
    of license_id, kind and digest; it is broadcast only if it has at most MOST_KNOWN rows.
    Defined cases: null text counts as empty and has no licence; null ids and repeated rows stay; a digest with
    several licences has the smallest id; texts of any length are digested whole, in their row;
    an empty table gives an empty one; other columns are ignored."""
    known = known_licenses(docs.sparkSession) if known is None else known
    whole = known.groupBy("digest").agg(F.min("license_id").alias("license_id")).select(F.col("digest").alias("text_digest"), "license_id")
    small = known.limit(MOST_KNOWN + 1).count() <= MOST_KNOWN
    # digests of lines are looked up in a map of the known ones: a hash join in the row itself
    digests = let(
        spelled(F.coalesce(F.col(text_col), F.lit(""))),
        lambda s: F.struct(digest(bare(s)).alias("whole"), F.transform(F.split(s, "\n"), lambda x: digest(bare(x))).alias("lines")),
    )
    base = docs.select(F.col(id_col).alias("doc_id"), digests.alias("d"))
    lines = known.where("kind = 'line'").limit(MOST_KNOWN + 1).collect()
    if len(lines) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known notices")
    table = F.from_json(F.lit(json.dumps({r.digest: r.license_id for r in lines})), "map<string, string>")
    hits = F.filter(F.transform("d.lines", lambda x: table[x]), lambda x: x.isNotNull())
    rows = base.select("doc_id", F.col("d.whole").alias("text_digest"), hits.alias("hits"))
    return rows.join(F.broadcast(whole) if small else whole, "text_digest", "left").select(
        "doc_id",
        "text_digest",
        "license_id",
        F.size("hits").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("notices"),
    )
