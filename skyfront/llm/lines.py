"""Line dedup over overlapping three-line windows. DataFrame functions only.

A line is what a line end or a sentence end (a full stop, exclamation or question mark and a
blank) closes, so a repeated passage is found also where it stands amid other text. What is
longer than ``LONG`` bytes is cut further, after words chosen by their first character and
length alone, so that a passage without such ends is cut alike wherever it stands. Every three
consecutive lines (trimmed, hashed) are a window; windows of blank lines, or of fewer than
``min_chars`` characters (0: all count), do not count. A window's first occurrence, by doc_id,
then a hash of doc_id and text, then place, stays. Lines that any other occurrence covers are
removed, the rest of the text stays as it is, byte for byte. Occurrences in one text may overlap:
of four equal lines the second window covers the last three, so only the first line stays.

Windows are hashed to 96 bits and written once. Counts and first occurrences, combined before the
shuffle, are written too: one row for each repeated window. Windows are then dealt out anew to
meet them, so that a very frequent one can be split over tasks. No group is ever gathered but
the removed places of one text.

Defined results: a null text stays null and has no lines; a text of fewer than three lines
is left alone; rows with equal doc_id and text are one document and are treated alike; rows
with a null doc_id come first in the order. Other columns, whatever their names, are kept
as they are by :func:`without_repeats`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

WINDOW = 3
MIN_CHARS = 0
#: Bytes of a line beyond which it is cut at chosen words.
LONG = 120
_BLANKS = " \t\r\n"

#: Mark line ends, and words' ends, while a text is split. In a text that has one of them, or rather
#: a sign for it, they are written as _SIGN and a letter meanwhile.
_MARK, _END, _SIGN = "\x1f", "\x1e", "\x1d"
_SIGNED = ((_SIGN, _SIGN + "c"), (_END, _SIGN + "a"), (_MARK, _SIGN + "b"))


def _signed(text: Column) -> Column:
    for mark, sign in _SIGNED:
        text = F.replace(text, F.lit(mark), F.lit(sign))
    return text


def _unsigned(text: Column) -> Column:
    for mark, sign in reversed(_SIGNED):
        text = F.replace(text, F.lit(sign), F.lit(mark))
    return text


def _chosen(word: Column) -> Column:
    n = F.octet_length(word)
    return (n >= 5) & ((F.ascii(word) + 3 * n) % 4 == 0)


def _cut(line: Column, plain: Callable[[Column], Column]) -> Column:
    """A long line in parts that end after a chosen word and its blank."""
    words = F.transform(F.split(line, " ", -1), lambda w: F.when(_chosen(plain(w)), F.concat(w, F.lit(_END))).otherwise(w))
    marked = F.replace(F.array_join(words, " "), F.lit(_END + " "), F.lit(" " + _MARK))
    return F.split(F.replace(marked, F.lit(_END), F.lit("")), _MARK, -1)


def _split(text: Column) -> Column:
    for end in ("\n", ". ", "! ", "? "):
        text = F.replace(text, F.lit(end), F.lit(end + _MARK))
    return F.split(text, _MARK, -1)


def _with_lines(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``_lines``. Literal replacements and splits at one character: patterns give the
    same, but slower. ``_split`` is a column of its own so that it is made once."""
    as_it_is = lambda x: x
    long = lambda plain: lambda x: F.octet_length(plain(x)) > LONG
    parts = lambda lines, plain: F.flatten(F.transform(lines, lambda x: F.when(long(plain)(x), _cut(x, plain)).otherwise(F.array(x))))
    own_marks = F.contains(text, F.lit(_MARK)) | F.contains(text, F.lit(_END))
    signed = F.transform(parts(_split(_signed(text)), _unsigned), _unsigned)
    lines = F.when(own_marks, signed).when(F.exists("_split", long(as_it_is)), parts(F.col("_split"), as_it_is)).otherwise(F.col("_split"))
    return df.withColumn("_split", _split(text)).withColumn("_lines", lines).drop("_split")


def _windows(documents: DataFrame, min_chars: int) -> DataFrame:
    """_id, _key and one row per window: place, h1, h2."""
    bare = lambda x: F.trim(x, F.lit(_BLANKS))
    rows = _with_lines(documents.select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("_key"), F.col("text").alias("_text")), F.col("_text"))
    made = {"v": F.transform("_lines", lambda x: F.xxhash64(bare(x)))} | ({"n": F.transform("_lines", lambda x: F.length(bare(x)))} if min_chars else {})
    hashed = rows.select("_id", "_key", *(c.alias(n) for n, c in made.items()))
    n = F.size("v") - (WINDOW - 1)
    zipped = F.arrays_zip(*(F.slice(c, F.lit(k + 1), n).alias(f"{c}{k}") for c in made for k in range(WINDOW)))
    # an outer explode: from a plain one a filter is made that would split every text once more
    each = hashed.select("_id", "_key", F.posexplode_outer(F.when(F.size("v") >= WINDOW, zipped)).alias("place", "w")).where("place IS NOT NULL")
    if min_chars:
        each = each.where(sum((F.col(f"w.n{k}") for k in range(1, WINDOW)), F.col("w.n0")) >= min_chars)
    three = [F.col(f"w.v{k}") for k in range(WINDOW)]
    blank = F.xxhash64(*[F.xxhash64(F.lit(""))] * WINDOW)
    return each.select("_id", "_key", "place", F.xxhash64(*three).alias("h1"), F.hash(*three).alias("h2")).where(F.col("h1") != blank)


def _removed(documents: DataFrame, min_chars: int) -> DataFrame:
    """_gone_id, _gone_key and the places of the windows that are no first occurrence."""
    windows, path = written(_windows(documents, min_chars), "windows")
    at = F.struct("_id", "_key", "place")
    repeated, repeated_path = written(windows.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first"), "repeated-windows")
    later = windows.join(repeated.hint("shuffle_hash"), ["h1", "h2"]).where(at != F.col("first")).select("_id", "_key", "place")
    gone, _ = written(later.groupBy("_id", "_key").agg(F.collect_set("place").alias("_at")).select(F.col("_id").alias("_gone_id"), F.col("_key").alias("_gone_key"), "_at"), "removed-windows")
    dropped(documents.sparkSession, path, repeated_path)
    return gone


def cut_rows(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Each row as ``row`` (a struct, so no column's name can clash), with ``text`` as it is without
    the removed lines, and ``n_removed``, the number of these."""
    gone = _removed(documents, min_chars)
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    keyed = documents.select(row.alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("_key"))
    both = keyed.join(gone, (keyed["_key"] == gone["_gone_key"]) & keyed["_id"].eqNullSafe(gone["_gone_id"]), "left")
    text, hit = F.col("row.text"), F.col("_at").isNotNull()
    covered = F.array_distinct(F.flatten(F.transform("_at", lambda p: F.sequence(p, p + (WINDOW - 1)))))
    both = _with_lines(both.select("row", covered.alias("_covered"), F.when(hit, text).alias("_text")), F.col("_text"))
    # set difference and lookups by place: time in proportion to the number of lines
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_covered")
    kept = F.array_join(F.transform(places, lambda i: F.get("_lines", i)), "")
    whole = F.col("_covered").isNull()
    return both.select("row", F.when(whole, F.col("row.text")).otherwise(kept).alias("text"), F.when(whole, 0).otherwise(F.size("_covered")).cast("bigint").alias("n_removed"))


def without_repeats(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``documents``, all columns, with ``text`` as it is without the removed lines. A column n_chars,
    where there is one, is the new text's length for rows that lost lines."""
    cut = cut_rows(documents, min_chars)
    made = {c: F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in documents.columns}
    if "n_chars" in made:
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(made["n_chars"])
    return cut.select(*(column.alias(c) for c, column in made.items()))


def line_dedup(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text without the removed lines, and n_removed, for every row of ``documents``."""
    return cut_rows(documents, min_chars).select("row.doc_id", "text", "n_removed")


#: The query's rows over DuckDB's views (documents of one run have distinct doc_ids).
ORACLE = r"""
WITH e AS (SELECT doc_id, replace(replace(replace(text, chr(29), chr(29) || 'c'), chr(30), chr(29) || 'a'), chr(31), chr(29) || 'b') AS text FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, string_split(regexp_replace(text, '(\n|[.!?] )', '\1' || chr(31), 'g'), chr(31)) AS v FROM e),
l AS (SELECT doc_id, list_transform(flatten(list_transform(v, lambda x: CASE WHEN strlen(replace(x, chr(29), '')) <= 120 THEN [x] ELSE
    string_split(replace(replace(array_to_string(list_transform(string_split(x, ' '), lambda w:
      CASE WHEN strlen(replace(w, chr(29), '')) >= 5 AND ((CASE substr(w, 1, 2) WHEN chr(29) || 'a' THEN 30 WHEN chr(29) || 'b' THEN 31 ELSE ascii(w) END) + 3 * strlen(replace(w, chr(29), ''))) % 4 = 0 THEN w || chr(30) ELSE w END), ' '),
      chr(30) || ' ', ' ' || chr(31)), chr(30), ''), chr(31)) END)), lambda x: replace(replace(replace(x, chr(29) || 'b', chr(31)), chr(29) || 'a', chr(30)), chr(29) || 'c', chr(29))) AS v FROM s),
t AS (SELECT doc_id, len(v) AS n, list_transform(v, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))) AS v FROM l),
w AS (SELECT doc_id, i, v[i + 1] AS a, v[i + 2] AS b, v[i + 3] AS c FROM (SELECT doc_id, v, unnest(range(n - 2)) AS i FROM t WHERE n >= 3)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS k FROM w WHERE a <> '' OR b <> '' OR c <> ''),
gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE k > 1),
p AS (SELECT doc_id, x AS line, p FROM (SELECT doc_id, unnest(v) AS x, unnest(range(len(v))) AS p FROM l)),
kept AS (SELECT doc_id, string_agg(line, '' ORDER BY p) AS text, count(*) AS n FROM p WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.p = p.p) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
  CAST(coalesce(len(l.v), 0) - coalesce(kept.n, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
