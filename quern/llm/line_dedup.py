"""Line deduplication over overlapping windows of consecutive lines.

Every run of three consecutive lines (blanks, tabs and carriage returns at their ends ignored) is hashed;
a window whose hash was seen at an earlier place in the corpus, in order of document id and line, is a
repeat, and the union of the lines that repeats cover is removed. Built from DataFrame functions only.

Defined results: a null text stays null with no lines; an empty text is one empty line; texts of fewer
than three lines have no window and stay as they are; windows of three blank lines never count; rows that
repeat both id and text are one document and are cleaned alike; ids compare in ascending order with null
first, equal ids by a hash of the text; an empty table gives an empty table. Input columns named n_lines or
n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import free, row_hash, written

WINDOW = 3
_ENDS = " \t\r"


def _windows(lines: Column, size: int) -> Column:
    """(position, two hashes) of every window that holds a line with content."""
    parts = lambda a, i: [a[i + k] for k in range(size)]
    one = lambda a, i: F.struct(i.alias("pos"), F.xxhash64(F.lit(1), *parts(a, i)).alias("h1"), F.xxhash64(F.lit(2), *parts(a, i)).alias("h2"), (F.concat(*parts(a, i)) != "").alias("some"))
    # the outer transform binds the lines, or each window would split the text anew
    made = F.transform(F.array(lines), lambda a: F.when(F.size(a) >= size, F.filter(F.transform(F.sequence(F.lit(0), F.size(a) - size), lambda i: one(a, i)), lambda w: w["some"])))
    return made[0]


def repeated_windows(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = WINDOW) -> DataFrame:
    """One row (_k, _a, _b, at) for each document that loses lines; at lists the 0-based places of its repeated
    windows, ascending.

    Windows are made once and written, a narrow row each. A window found in very many documents is combined before
    the shuffle, and its join side is one that adaptive execution splits when skewed.
    """
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(_ENDS)))
    a, b = row_hash(key, text)
    each = docs.select(F.col(key).alias("_k"), a.alias("_a"), b.alias("_b"), F.explode(_windows(lines, size)).alias("w"))
    each = written(each.select("_k", "_a", "_b", F.col("w.pos").alias("pos"), F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2")))
    place = F.struct("_k", "_a", "_b", "pos")
    first = each.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") != F.col("last"))
    later = each.join(first.select("h1", "h2", "first"), ["h1", "h2"]).where(place != F.col("first"))
    return later.groupBy("_k", "_a", "_b").agg(F.array_sort(F.collect_set("pos")).alias("at"))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = WINDOW) -> DataFrame:
    """docs with repeated windows cut from the text, and n_lines and n_removed.

    Between the places p and q of two neighbouring repeated windows the lines from p + size up to q stay: their
    ranges are merged into the new text at one go, whatever the numbers of lines and windows.
    """
    plain = docs.drop("n_lines", "n_removed")
    at, a, b, k = free(plain, "_at", "_a", "_b", "_k")
    gone = repeated_windows(docs, text, key, size).toDF(k, a, b, at)
    first, second = row_hash(key, text)
    keyed = plain.withColumns({a: first, b: second})
    same = keyed[key].eqNullSafe(gone[k]) & (keyed[a] == gone[a]) & (keyed[b] == gone[b])
    joined = keyed.join(gone, same, "left").select(*(keyed[c] for c in plain.columns), gone[at])
    lines = F.split(text, "\n", -1)
    from_ = F.concat(F.array(F.lit(0)), F.transform(at, lambda p: p + size))
    to = F.concat(F.col(at), F.array(F.size(lines)))
    stay = F.filter(F.zip_with(from_, to, lambda x, y: F.struct(x.alias("at"), (y - x).alias("n"))), lambda r: r["n"] > 0)
    # the outer transform binds the lines, or each range would split the text anew
    left = F.transform(F.array(lines), lambda x: F.flatten(F.transform(stay, lambda r: F.slice(x, r["at"] + 1, r["n"]))))[0]
    kept = F.aggregate(stay, F.lit(0), lambda n, r: n + r["n"])
    return joined.withColumns({
        "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.size(lines) - kept, F.lit(0)).cast("long"),
        text: F.when(F.col(at).isNull(), F.col(text)).otherwise(F.array_join(left, "\n")),
    }).drop(at)


#: The same result in DuckDB SQL over a view `docs` with columns doc_id and text.
SQL = r"""
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN n_removed IS NULL THEN text ELSE coalesce(kept, '') END AS text
FROM (SELECT doc_id, text, coalesce(len(string_split(text, chr(10))), 0) AS n_lines FROM {docs})
LEFT JOIN (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept
  FROM (
    SELECT doc_id, pos, line, coalesce(bool_or(later) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), false) AS gone
    FROM (
      SELECT doc_id, pos, line, b IS NOT NULL AND c IS NOT NULL AND a || b || c <> ''
             AND row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) > 1 AS later
      FROM (
        SELECT doc_id, pos, line, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c
        FROM (SELECT doc_id, pos, line, trim(line, chr(32) || chr(9) || chr(13)) AS a
              FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM {docs}))
        WINDOW w AS (PARTITION BY doc_id ORDER BY pos))))
  GROUP BY doc_id HAVING count(*) FILTER (gone) > 0) USING (doc_id)
"""
