"""Exact duplicates by a tree merge of sorted digest runs.

The rows are dealt into runs, and each run into ranges of the digest.  Within a run every digest keeps one entry: how many rows it stands for and
the best of them.  An entry is a sha-256 digest with a second, independent check (hash and length of the normalised text) that has to agree too.

The runs are merged in binomial rounds.  In a round every second run hands its entries to its neighbour, range by range; the two sorted runs are
merged in order of the digest, and where both have a digest the better row is kept.  The number of runs halves each time until one sorted run,
spread over the ranges, is left.  Only entries travel, one for each digest and run, combined on the sending side first, so a digest of a third of
all rows costs no more than any other, and no task ever holds more than one range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, written

SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """Text without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), SPACES, F.coalesce(text, F.lit("")))


def digests(df: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, _chars, _sha, _check) of every row."""
    plain = normalised(F.col(text))
    out = df.select(F.col(key).alias("doc_id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("_chars"), plain.alias("_plain"))
    return out.select("doc_id", "_chars", F.unhex(F.sha2("_plain", 256)).alias("_sha"), F.struct(F.xxhash64("_plain"), F.octet_length("_plain")).alias("_check"))


def best(chars: str = "_chars", key: str = "doc_id") -> Column:
    """Orders rows: most code points first, then smallest id, null ids last."""
    return F.struct((-F.col(chars)).alias("c"), F.col(key).isNull().alias("n"), F.col(key).alias("id"))


ENTRY = ["_range", "_run", "_sha", "_check"]


def rounds(df: DataFrame, runs: int, ranges: int) -> list[DataFrame]:
    """(_range, _run, _sha, _check, _best, _size) after each round: ``runs`` sorted runs first, half as many every time, one in the end.

    A partition holds whole (range, run) pairs and is sorted by them and the digest, and so the aggregation that follows merges in order.
    """
    best_of = [F.min("_best").alias("_best"), F.sum("_size").alias("_size")]
    share = F.conv(F.substring(F.hex("_sha"), 1, 4), 16, 10).cast("long")  # digests are even, so the first two bytes cut even ranges
    entries = df.select(F.floor(share * ranges / 65536).cast("int").alias("_range"), F.pmod(F.xxhash64("doc_id", "_chars"), F.lit(runs)).cast("int").alias("_run"),
                        "_sha", "_check", best().alias("_best"), F.lit(1).cast("long").alias("_size"))
    out = [entries.groupBy(*ENTRY).agg(*best_of)]
    while True:
        last = out[-1].repartition("_range", "_run").sortWithinPartitions(*ENTRY)
        out[-1] = last.groupBy(*ENTRY).agg(*best_of)
        if runs == 1:
            return out
        runs = -(-runs // 2)
        out.append(out[-1].withColumn("_run", F.expr("_run div 2").cast("int")))


def merge_runs(df: DataFrame, runs: int, ranges: int = 256) -> DataFrame:
    """(_sha, _check, _best, _size): one entry per distinct text, from the last round."""
    return rounds(df, runs, ranges)[-1].drop("_range", "_run")


def mark_duplicates(df: DataFrame, *, runs: int = 16, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row, dropped ones too.

    Rows are equal when their normalised texts are; null and empty texts form a group like any other.  Rows that repeat with the same
    id and text count as rows of the group and are all marked kept if that id is; a null id is kept only where the group has no other of that length.
    An empty table gives no rows; further columns are ignored.
    """
    rows = written(digests(df, text=text, key=key), "digests")
    entries = merge_runs(rows, runs)
    return (rows.join(entries, ["_sha", "_check"])
            .select("doc_id", F.col("_best.id").alias("keep_id"), F.col("_size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("_best.id")).alias("kept"),
                    F.lower(F.hex("_sha")).alias("text_sha256")))


def distinct_texts(df: DataFrame, *, runs: int = 16, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns, one row for each text even where ids repeat.

    Only ids, lengths and digests are written.  Rows come back by id and digest; where rows with one id and text repeat, one of them is taken.
    """
    sha, chars, win, id_, n = (fresh(df, c) for c in ("_sha", "_chars", "_win", "_id", "_n"))
    rows = written(digests(df, text=text, key=key), "digests")
    entries = merge_runs(rows, runs).select(F.col("_sha").alias(win), F.col("_best.id").alias(id_), (-F.col("_best.c")).alias(n))
    best_rows = rows.join(entries, (F.col("_sha") == F.col(win)) & F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col("_chars") == F.col(n)))
    winners = written(best_rows.groupBy(win, id_, n).agg(F.count(F.lit(1)).alias("_ties")), "winners")
    discard(rows)
    plain = normalised(F.col(text))
    marked = df.withColumns({sha: F.unhex(F.sha2(plain, 256)), chars: F.length(F.coalesce(F.col(text), F.lit("")))})
    back = lambda some: marked.join(some.drop("_ties"), (F.col(sha) == F.col(win)) & F.col(key).eqNullSafe(F.col(id_)) & (F.col(chars) == F.col(n)), "left_semi")
    whole = back(winners.filter("_ties = 1")).select(*df.columns)
    if winners.filter("_ties > 1").isEmpty():
        return whole
    return whole.unionByName(back(winners.filter("_ties > 1")).dropDuplicates([sha]).select(*df.columns))


SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents),
r AS (SELECT plain, first(doc_id ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id, count(*) AS group_size FROM t GROUP BY plain)
SELECT t.doc_id, r.keep_id, r.group_size, t.doc_id IS NOT DISTINCT FROM r.keep_id AS kept, sha256(t.plain) AS text_sha256
FROM t JOIN r USING (plain)
"""
