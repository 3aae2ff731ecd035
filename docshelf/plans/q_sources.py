"""Queries: file listing and filters (A1, A2, B3, B8, B9), decoding (B1), part composition (B2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import options as O
from ..functions.text import base_name, parent_dir, stem, suffix
from ..operators import compose as C
from ..sources import files as FS
from ..sources.tables import read_table
from .catalog import query
from .sqltext import q, stem_sql, suffix_sql

ROOT = "tree"

# --------------------------------------------------------------------------
# A file tree derived from the tables: documents under their source folder,
# pages under their language folder (a category: already organised), and
# benchmark items at the top level with an upper-case suffix.
# --------------------------------------------------------------------------

PAGE_LANG = r"^https?://[^/]+/([a-z]+)/"


def tree_listing(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select(
        F.concat(F.lit(ROOT + "/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    p = read_table(spark, sf_dir, "pages").select(
        F.concat(F.lit(ROOT + "/"), F.regexp_extract("url", PAGE_LANG, 1), F.lit("/"),
                 F.col("page_id").cast("string"), F.lit(".txt")).alias("path"))
    b = read_table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit(ROOT + "/"), F.col("item_id").cast("string"), F.lit(".TXT")).alias("path"))
    return d.unionByName(p).unionByName(b)


def categories(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select(F.col("lang").alias("category")).distinct()


TREE_SQL = f"""listing AS (
  SELECT '{ROOT}/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path FROM documents
  UNION ALL SELECT '{ROOT}/' || regexp_extract(url, '{PAGE_LANG}', 1) || '/' || CAST(page_id AS VARCHAR) || '.txt' FROM pages
  UNION ALL SELECT '{ROOT}/' || CAST(item_id AS VARCHAR) || '.TXT' FROM benchmark),
cats AS (SELECT DISTINCT lang AS category FROM documents),
parts AS (SELECT path, string_split(substr(path, {len(ROOT) + 2}), '/') AS p FROM listing)"""

_SUPPORTED_SQL = "[" + ", ".join(q(e) for e in O.SUPPORTED_EXTENSIONS) + "]"


@query("scan_filter", f"""WITH {TREE_SQL}
SELECT 'top' AS mode, path FROM parts
WHERE len(p) = 1 AND list_contains({_SUPPORTED_SQL}, lower({suffix_sql('p[len(p)]')}))
UNION ALL
SELECT 'recursive', path FROM parts
WHERE list_contains({_SUPPORTED_SQL}, lower({suffix_sql('p[len(p)]')}))
  AND NOT (len(p) > 1 AND p[1] IN (SELECT category FROM cats))""")
def scan_filter(spark, sf_dir):
    listing = tree_listing(spark, sf_dir)
    cats = categories(spark, sf_dir)
    top = FS.scan_filter(listing, ROOT, cats, recursive=False).select(F.lit("top").alias("mode"), "path")
    rec = FS.scan_filter(listing, ROOT, cats, recursive=True).select(F.lit("recursive").alias("mode"), "path")
    return top.unionByName(rec)


@query("scan_tree", f"""WITH {TREE_SQL}
SELECT path, p[1] AS category FROM parts
WHERE len(p) > 1 AND p[1] IN (SELECT category FROM cats)
  AND list_contains({_SUPPORTED_SQL}, lower({suffix_sql('p[len(p)]')}))""")
def scan_tree(spark, sf_dir):
    return FS.scan_tree(tree_listing(spark, sf_dir), ROOT, categories(spark, sf_dir)).select("path", "category")


_KIND_SQL = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in FS.EXTRACTOR_KIND.items()) + "}"


@query("dispatch_kind", f"""WITH paths AS (
  SELECT regexp_replace(url, '^https?://', '') AS path FROM pages
  UNION ALL SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' FROM documents),
e AS (SELECT path, CASE WHEN contains(path, '.') THEN lower(regexp_extract(path, '\\.([^.]*)$', 1)) ELSE '' END AS ext
      FROM paths)
SELECT path, ext, coalesce({_KIND_SQL}[ext], 'none') AS kind FROM e""")
def dispatch_kind(spark, sf_dir):
    from ..functions.text import dispatch_extension

    p = read_table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"))
    d = read_table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    paths = p.unionByName(d)
    return paths.select("path", dispatch_extension("path").alias("ext"), FS.extractor_kind("path").alias("kind"))


@query("file_name_parts", f"""WITH paths AS (
  SELECT regexp_replace(url, '^https?://', '') AS path FROM pages
  UNION ALL SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' FROM documents),
n AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent
      FROM paths)
SELECT path, name, {stem_sql('name')} AS stem, {suffix_sql('name')} AS suffix, parent FROM n""")
def file_name_parts(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"))
    d = read_table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    named = p.unionByName(d).withColumn("name", base_name("path"))
    return named.select("path", "name", stem("name").alias("stem"), suffix("name").alias("suffix"),
                        parent_dir("path").alias("parent"))


# --- B1 --------------------------------------------------------------------------
# File bytes: the document text, one malformed byte, then a CRLF line.

@query("decode_text", r"""
SELECT doc_id, CAST(length(t) AS BIGINT) AS chars, md5(t) AS content_md5 FROM (
  SELECT doc_id, regexp_replace(text || chr(13) || chr(10) || 'end' || chr(13) || 'x', '\r\n?', chr(10), 'g') AS t
  FROM documents)""")
def decode_text(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    raw = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("C3")), F.lit("\r\nend\rx").cast("binary"))
    t = FS.decode_text(raw)
    return d.select("doc_id", F.length(t).cast("bigint").alias("chars"), F.md5(t.cast("binary")).alias("content_md5"))


@query("decode_damaged", """
SELECT doc_id, CAST(length(t) AS BIGINT) AS chars, md5(t) AS content_md5
FROM (SELECT doc_id, chr(65533) || text || 'a' || chr(65533) || 'b' || chr(128512) AS t FROM documents)""")
def decode_damaged(spark, sf_dir):
    """Malformed bytes around and inside whole texts go; a U+FFFD that the file holds stays."""
    d = read_table(spark, sf_dir, "documents")
    b = lambda h: F.unhex(F.lit(h))
    # cut sequences, stray continuations, overlong and surrogate forms, beyond the last code point
    raw = F.concat(b("80EFBFBDC0AFED A080".replace(" ", "")), F.col("text").cast("binary"), b("F0908061EFBFBDF5808080"), b("E28262F09F9880F09F98"))
    t = FS.decode_text(raw)
    return d.select("doc_id", F.length(t).cast("bigint").alias("chars"), F.md5(t.cast("binary")).alias("content_md5"))


# --- B2 --------------------------------------------------------------------------
# Conversation turns as the parts of one file per conversation; user and
# assistant turns are the text members, system turns are not.

def conversation_parts(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return c.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path"),
                    F.col("role").alias("kind"), F.col("turn").cast("int").alias("seq"), "text")


@query("compose_parts", f"""
SELECT path, string_agg(t, chr(10) ORDER BY turn) AS text,
       CAST(max(parts) - count(*) AS BIGINT) AS parts_left_out, CAST(sum(cut) AS BIGINT) AS chars_left_out FROM (
  SELECT 'conv/' || CAST(conv_id AS VARCHAR) AS path, turn, substr(text, 1, {O.ARCHIVE_MEMBER_CHARS}) AS t,
         greatest(0, length(text) - {O.ARCHIVE_MEMBER_CHARS}) AS cut,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS parts
  FROM conversations WHERE role IN ('user', 'assistant'))
WHERE n <= {O.ARCHIVE_MAX_MEMBERS} GROUP BY path""")
def compose_parts(spark, sf_dir):
    rule = C.capped(C.ARCHIVE, O.ARCHIVE_MAX_MEMBERS, O.ARCHIVE_MEMBER_CHARS)
    return C.compose(conversation_parts(spark, sf_dir), rule)


def _compose_query(name: str, rule: C.Rule, part_sql: str, keep_sql: str, sep: str) -> None:
    """A preset over all turns; every fifth text is missing and every seventh empty or blank."""
    sql = f"""
SELECT path, string_agg({part_sql}, {sep} ORDER BY turn) AS text, CAST(0 AS BIGINT) AS parts_left_out,
       CAST(0 AS BIGINT) AS chars_left_out
FROM (SELECT 'conv/' || CAST(conv_id AS VARCHAR) AS path, turn,
             CASE WHEN (conv_id + turn) % 5 = 0 THEN NULL WHEN (conv_id + turn) % 7 = 0 THEN repeat(' ', CAST(turn % 2 AS INT))
                  ELSE text END AS text FROM conversations)
WHERE {keep_sql} GROUP BY path"""

    def run(spark, sf_dir):
        at = F.col("conv_id") + F.col("turn")
        c = read_table(spark, sf_dir, "conversations").withColumn(
            "text", F.when(at % 5 == 0, F.lit(None)).when(at % 7 == 0, F.when(F.col("turn") % 2 == 1, " ").otherwise(""))
            .otherwise(F.col("text")))
        parts = c.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path"),
                         F.col("role").alias("kind"), F.col("turn").cast("int").alias("seq"), "text")
        return C.compose(parts, rule)

    query(name, sql)(run)


_compose_query("compose_slides", C.SLIDES, r"regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')",
               r"regexp_matches(text, '[^\s\p{Z}]')", "chr(10)")
_compose_query("compose_cells", C.CELLS, "text", "text IS NOT NULL", "' '")
_compose_query("compose_paragraphs", C.PARAGRAPHS, "text", r"regexp_matches(text, '[^\s\p{Z}]')", "chr(10)")
_compose_query("compose_pages", C.PAGES, "text", "text <> ''", "chr(10)")
_compose_query("compose_message", C.MESSAGE, "text", "text <> ''", "chr(10)")
_compose_query("compose_mail", C.MAIL, "text", "text <> ''", "chr(10)")
