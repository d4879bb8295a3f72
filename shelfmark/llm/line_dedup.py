"""Lines that many sites share (distinct-site spread), found with HyperLogLog sketches and removed.

Each line, trimmed, is known by a 128-bit hash.  One aggregation by hash merges a HyperLogLog sketch of the
sites; the estimate settles lines far from the threshold, and lines near it get an exact distinct count.
A line on ``min_sites`` sites or more is boilerplate: its first occurrence, by (id, place), stays and every
other one is cut from its text.  Only column expressions are used, texts are never grouped, and the one
join that meets whole texts carries a list of places per text.

Defined cases: a null site counts as the empty site; blank lines are never boilerplate; a null text stays
null, an empty one empty; a null id sorts first; rows with equal id and text are treated alike, so repeated
rows keep or lose the same lines; an empty table gives an empty one; other columns pass unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.common import BROADCAST_BYTES, fresh, row_key, table
from shelfmark.session import broadcast_if_small, write_through

LOG_K = 12
MIN_SITES = 10


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """One row per line that is not blank: row key, id, place, site, hashes of the line."""
    parts = docs.select(
        *[k.alias(n) for k, n in zip(row_key(id_col, text_col), ("row1", "row2"))],
        F.col(id_col).alias("id"),
        F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"),
        F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("place", "raw"),
    )
    trimmed = parts.withColumn("line", F.expr("btrim(raw, ' \\t\\r')")).where("line != ''")
    return trimmed.select(
        "row1", "row2", "id", "place", "site", *[k.alias(n) for k, n in zip(row_key("line"), ("line1", "line2"))]
    )


def shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES
) -> DataFrame:
    """Hashes of the boilerplate lines with the place of their first occurrence, written to the shared folder."""
    lines = _lines(docs, id_col, text_col, site_col)
    margin = max(1, math.ceil(4 * 1.04 / math.sqrt(2**LOG_K) * min_sites))
    spread = lines.groupBy("line1", "line2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_K))).alias("estimate"),
        F.min(F.struct("id", "row1", "row2", "place")).alias("first"),
    )
    spread = write_through(spread.where(F.col("estimate") >= min_sites - margin), "line-spread")
    far = spread.where(F.col("estimate") > min_sites + margin)
    near = spread.where(F.col("estimate") <= min_sites + margin)
    wanted = broadcast_if_small(near.select("line1", "line2"), BROADCAST_BYTES)
    exact = (
        lines.select("line1", "line2", "site")
        .join(wanted, ["line1", "line2"], "left_semi")
        .distinct()
        .groupBy("line1", "line2")
        .agg(F.count("*").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    confirmed = near.join(exact.select("line1", "line2"), ["line1", "line2"], "left_semi")
    return write_through(far.unionByName(confirmed).select("line1", "line2", "first"), "line-boilerplate")


def remove_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES
) -> tuple[DataFrame, str]:
    """``docs`` with cleaned texts, and the name of an added column with the number of lines removed."""
    boilerplate = broadcast_if_small(shared_lines(docs, id_col, text_col, site_col, min_sites), BROADCAST_BYTES)
    here = F.struct("id", "row1", "row2", "place")
    repeats = (
        _lines(docs, id_col, text_col, site_col)
        .join(boilerplate, ["line1", "line2"])
        .where(here != F.col("first"))
        .select("row1", "row2", "place")
        .distinct()
        .groupBy("row1", "row2")
        .agg(F.sort_array(F.collect_list("place")).alias("places"))
    )
    one, two, places, removed = (fresh(docs, n) for n in ("row1", "row2", "places", "n_removed"))
    repeats = write_through(repeats, "line-repeats").toDF(one, two, places)
    keyed = docs.withColumns(dict(zip((one, two), row_key(id_col, text_col))))
    # The pieces between removed places, each a slice: linear in the number of lines.
    pieces = (
        f"zip_with(concat(array(-1), `{places}`), concat(`{places}`, array(size(lines))),"
        " (a, b) -> slice(lines, a + 2, b - a - 1))"
    )
    kept = f"aggregate(array(split(`{text_col}`, '\\n', -1)), '', (x, lines) -> array_join(flatten({pieces}), '\\n'))"
    joined = keyed.join(broadcast_if_small(repeats, BROADCAST_BYTES), [one, two], "left")
    cleaned = joined.withColumns({
        text_col: F.when(F.col(places).isNull(), F.col(text_col)).otherwise(F.expr(kept)),
        removed: F.when(F.col(places).isNull(), 0).otherwise(F.size(places)).cast("long"),
    })
    return cleaned.select(*docs.columns, removed), removed


def op9_line_dedup(spark, sf_dir):
    """Every document with its cleaned text, its lines and how many of them went."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("original"), "text")
    cleaned, removed = remove_shared_lines(docs)
    n_lines = F.when(F.col("original").isNull(), 0).otherwise(F.size(F.split("original", "\n", -1)))
    return cleaned.select(
        "doc_id", n_lines.cast("long").alias("n_lines"), F.col(removed).alias("n_removed"), "text"
    )


def stage(spark, docs, sf_dir):
    """Pipeline stage: repeated boilerplate lines go, and so does a document that had nothing else."""
    cleaned, removed = remove_shared_lines(docs)
    emptied = (F.col(removed) > 0) & F.col("text").rlike(r"^\s*$")
    return cleaned.where(~emptied | F.col("text").isNull()).select(*docs.columns)


ORACLE = f"""
WITH parts AS (
  SELECT doc_id, text, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents WHERE text IS NOT NULL),
lines AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM parts),
boilerplate AS (
  SELECT line, min({{'id': doc_id, 'place': place}}) AS first FROM lines WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
marked AS (
  SELECT l.*, b.line IS NOT NULL AND NOT (l.doc_id = b.first.id AND l.place = b.first.place) AS removed
  FROM lines l LEFT JOIN boilerplate b USING (line))
SELECT d.doc_id, coalesce(g.n_lines, 0)::BIGINT AS n_lines, coalesce(g.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(g.kept, '') END AS text
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed,
         string_agg(raw, chr(10) ORDER BY place) FILTER (NOT removed) AS kept
  FROM marked GROUP BY doc_id) g USING (doc_id)
"""
