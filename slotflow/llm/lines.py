"""Line dedup: every three-line window that occurred before is removed.

Windows are hashed over consecutive lines with content, counted over the whole corpus, and
each occurrence but the first (smallest key, then earliest line) is cut out of its text.
Covered spans that overlap merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotflow.llm.common import fresh, quoted

WINDOW = 3
_LAST = 2**63 - 1  # rows without a key come after all others


def dedup_lines(docs: DataFrame, *, text: str = "text", key: str = "doc_id", removed: str | None = None) -> DataFrame:
    """All rows and columns, with repeated windows cut out of ``text``.

    Lines are split at line feeds and compared without surrounding white space; lines without
    content take no part in windows, and go only when they lie inside a removed span. A text
    with fewer than three lines of content has no window and stays as it is, as do NULL and
    empty texts. A removed line always stands at an earlier place that stays. Within a text
    an earlier window counts as the first. Rows with equal key and equal text are one
    document: each of them gets the same result. Rows without a key come last, equal texts
    among them being one document. Of texts that share a key the one whose MD5 begins with the
    smaller number counts as the earlier. A repeat that overlaps its own first occurrence loses
    lines of it: ``a a a a a`` becomes ``a``. ``removed`` names a column for the number of lines cut.
    """
    taken = list(docs.columns)
    k, h, cut, k2, h2 = (fresh(n, taken) for n in ("__key", "__hash", "__cut", "__key2", "__hash2"))
    body = docs[quoted(text)]
    named = docs.withColumns({k: F.coalesce(docs[quoted(key)].cast("long"), F.lit(_LAST)), h: _order(body)})
    windows = _windows(named.select(F.col(k).alias("k"), F.col(h).alias("h"), F.col(quoted(text)).alias("text")))
    first = (
        windows.groupBy("w1", "w2")
        .agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("k", "h", "begin")).alias("first"))
        .where("times > 1")
        .select("w1", "w2", "first")
    )
    later = (
        windows.join(first, ["w1", "w2"])
        .where(F.struct("k", "h", "begin") != F.col("first"))
        # A set: copies of a row add nothing, and are combined before the shuffle.
        .groupBy("k", "h")
        .agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
        .select(F.col("k").alias(k2), F.col("h").alias(h2), F.col("spans").alias(cut))
    )
    # Spans are small beside texts: hashing them saves sorting the texts.
    joined = named.join(later.hint("shuffle_hash"), (F.col(k) == F.col(k2)) & (F.col(h) == F.col(h2)), "left")
    # Only texts that lose lines go through Python.
    done = _without(F.when(F.col(cut).isNotNull(), F.col(quoted(text))), F.col(cut))
    out = [F.when(F.col(cut).isNull(), F.col(quoted(text))).otherwise(done["text"]).alias(c) if c.lower() == text.lower() else F.col(quoted(c)) for c in docs.columns]
    return joined.select(*out, *([done["lines"].alias(removed)] if removed else []))


def _order(text: Column) -> Column:
    """The first 60 bits of the text's MD5: tells texts of one key apart, and orders them."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _windows(rows: DataFrame) -> DataFrame:
    """(k, h, begin, end, w1, w2): first and last line number and a 128-bit hash of every window."""
    rows = rows.where(F.col("text").isNotNull())
    numbered = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(F.trim(line, F.lit(" \t\r\x0b\x0c")).alias("line"), i.alias("at")))
    filled = rows.select("k", "h", F.filter(numbered, lambda x: x["line"] != "").alias("lines")).where(F.size("lines") >= WINDOW)

    def window(i):
        parts = [F.col("lines")[i + j]["line"] for j in range(WINDOW)]
        return F.struct(
            F.col("lines")[i]["at"].alias("begin"),
            F.col("lines")[i + (WINDOW - 1)]["at"].alias("end"),
            F.xxhash64(*parts).alias("w1"),
            F.xxhash64(F.lit("second"), *parts).alias("w2"),
        )

    each = F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - WINDOW), window))
    return filled.select("k", "h", each.alias("w")).select("k", "h", "w.begin", "w.end", "w.w1", "w.w2")


def _without(text: Column, spans: Column) -> Column:
    """The text without the lines of the spans, and the number of those lines."""

    @F.arrow_udf("text string, lines int")
    def cut_lines(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, cuts in batches:
            found = [_cut(t.as_py(), c.as_py()) for t, c in zip(texts, cuts)]
            kept, gone = zip(*found) if found else ((), ())
            yield pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(gone, pa.int32())], ["text", "lines"])

    return cut_lines(text, spans)


def _cut(text: str | None, spans: list[dict] | None) -> tuple[str | None, int]:
    if text is None or not spans:
        return text, 0
    lines, out, at, gone = text.split("\n"), [], 0, 0
    for begin, end in sorted((s["begin"], s["end"]) for s in spans):
        out += lines[at:begin]
        gone += max(0, end + 1 - max(at, begin))
        at = max(at, end + 1)
    return "\n".join(out + lines[at:]), gone


#: The same in DuckDB SQL over ``documents``: the lines that stay, joined again.
SQL = r"""
WITH lined AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
filled AS (
  SELECT doc_id, text, pos, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM lined WHERE trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''),
windows AS (
  SELECT doc_id, text, pos AS b, lead(pos, 2) OVER w AS e, line AS l1, lead(line) OVER w AS l2, lead(line, 2) OVER w AS l3
  FROM filled WINDOW w AS (PARTITION BY doc_id, text ORDER BY pos)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id NULLS LAST, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT), b) AS nth
  FROM windows WHERE e IS NOT NULL),
kept AS (
  SELECT doc_id, text, pos, raw FROM lined l WHERE NOT EXISTS (
    SELECT 1 FROM ranked r WHERE r.nth > 1 AND r.doc_id IS NOT DISTINCT FROM l.doc_id AND r.text = l.text AND l.pos BETWEEN r.b AND r.e)),
joined AS (
  SELECT doc_id, text, string_agg(raw, chr(10) ORDER BY pos) AS deduped, count(*) AS n FROM kept GROUP BY doc_id, text)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.deduped, '') END AS text,
       CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(j.n, 0) END AS INTEGER) AS n_removed
FROM documents d LEFT JOIN joined j ON d.doc_id IS NOT DISTINCT FROM j.doc_id AND d.text = j.text
"""
