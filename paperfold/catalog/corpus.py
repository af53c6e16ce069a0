"""Queries over content blocks, chunks and scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperfold.catalog import bridge as b
from paperfold.catalog.registry import query
from paperfold.functions import blocks as B
from paperfold.functions import keys as K
from paperfold.functions import text as X
from paperfold.plans import chunking as C
from paperfold.schemas import CONTENT_BLOCK
from paperfold.sources.files import download_plan

WSQ = "'" + X.WS_CHARS + "'"
DASH = "–"


def content_block(kind: Column | str, text=None, items=None, img=None, page=None,
                  bbox=None, table=None) -> Column:
    values = {
        "type": F.lit(kind) if isinstance(kind, str) else kind, "text": text,
        "list_items": items, "img_path": img, "page_idx": page, "bbox": bbox,
        "table_body": table,
    }
    return F.struct(*[
        (values[f.name] if values.get(f.name) is not None else F.lit(None))
        .cast(f.dataType).alias(f.name)
        for f in CONTENT_BLOCK.fields
    ])


def bracket_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a content list of the bracket-label family, as JSON text.

    Every third line opens a part with marks, the next is a list, the last is an
    image (even documents) or plain text.
    """
    d = F.col("doc_id")

    def line_block(line: Column, i: Column) -> Column:
        part = F.floor(i / 3).cast("int")
        label = F.char(part + 97)
        page = F.floor(i / 10).cast("int")
        opening = F.concat(
            F.lit("("), label, F.lit(") "), line, F.lit(" ["), (i % 7 + 1).cast("string"),
            F.lit(" marks]"),
        )
        return (
            F.when((i % 3 == 0) & (part < 26), content_block("text", text=opening, page=page))
            .when(i % 3 == 1, content_block("list", page=page, items=F.array(
                F.concat(F.lit("(ii) "), line), F.lit(" "), F.concat(F.lit("item "), i.cast("string"))
            )))
            .when((i % 3 == 2) & (d % 2 == 0), content_block(
                "image", page=page, img=F.concat(F.lit("images/"), i.cast("string"), F.lit(".png")),
                bbox=F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), i.cast("double")),
            ))
            .otherwise(content_block("text", text=line, page=page))
        )

    head = content_block("header", text=F.concat(
        F.lit(f"COMPUTER SCIENCE TRIPOS Part IA {DASH} "), (d % 25 + 2000).cast("string"),
        F.lit(f" {DASH} Paper "), (d % 9 + 1).cast("string"),
    ))
    first = content_block("text", text=F.concat(
        (d + 1).cast("string"), F.lit(" Topic "), F.col("lang"), F.lit(" (ab"),
        (d % 7).cast("string"), F.lit(")"),
    ))
    docs = b.texts(spark, sf_dir)
    return docs.select(
        F.concat(F.lit("/papers/"), "source", F.lit("/d"), d, F.lit("_content_list.json"))
        .alias("path"),
        F.to_json(F.concat(
            F.array(content_block("page_number", text=F.lit("1")), first),
            F.transform(F.split("text", "\n"), line_block), F.array(head),
        )).alias("value"),
    )


def bare_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a paper of the bare-label family: a cover, a question every 20
    lines, a part every 4, a page header every 10."""
    d = F.col("doc_id")

    def line_blocks(raw: Column, i: Column) -> Column:
        page = F.floor(i / 10).cast("int")
        line = F.concat(raw, F.lit(" p"), page.cast("string"))
        label = F.char(F.floor(i % 20 / 4).cast("int") + 97)
        body = F.when(i % 4 == 0, F.concat(label, F.lit(") L"), line)).when(
            i % 4 == 3, F.concat(line, F.lit(" ("), (i % 9 + 1).cast("string"), F.lit(")"))
        ).otherwise(line)
        return F.filter(F.array(
            F.when(i % 10 == 0, content_block(
                "text", text=F.concat(F.lit("UNIVERSITY EXAM "), F.col("lang")), page=page)),
            F.when(i % 20 == 0, content_block("text", page=page, text=F.concat(
                F.lit("Question "), (F.floor(i / 20) + 1).cast("string")))),
            content_block("text", text=body, page=page),
            F.when(i % 4 == 1, content_block("footer", text=F.lit("Please turn over."), page=page)),
        ), lambda x: x.isNotNull())

    cover = F.array(
        content_block("text", text=F.concat(F.lit("Course title in "), F.col("lang"))),
        content_block("text", text=F.concat(
            F.lit("MECE"), (d % 1000 + 10000).cast("string"))),
        content_block("text", text=F.concat(
            F.lit("Exam diet of "), (d % 25 + 2000).cast("string"))),
    )
    return b.texts(spark, sf_dir).select(
        F.concat(d, F.lit("_X.pdf")).alias("source_pdf"), F.lit("/papers").alias("base_dir"),
        F.concat(
            cover, F.flatten(F.transform(F.split("text", "\n"), line_blocks))
        ).cast(T.ArrayType(CONTENT_BLOCK)).alias("blocks"),
    )


LINES = f"""lines AS (SELECT doc_id, lang, i, line AS raw, trim(line, {WSQ}) AS line, max(i) OVER (PARTITION BY doc_id) + 1 AS n
  FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
               unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS i
        FROM documents))"""

BRACKET_SQL = LINES + f""",
pieces AS (SELECT doc_id, least(i // 3, 25) AS part, i,
    CASE WHEN i % 3 = 0 AND i // 3 < 26 THEN ltrim(line || ' [' || (i % 7 + 1) || ' marks]', {WSQ})
         WHEN i % 3 = 1 THEN trim('(ii) ' || line, {WSQ}) || chr(10) || 'item ' || i
         WHEN i % 3 = 2 AND doc_id % 2 = 0 THEN ''
         ELSE line END AS piece,
    CASE WHEN i % 3 = 0 AND i // 3 < 26 THEN i % 7 + 1 END AS marks
  FROM lines),
subs AS (SELECT doc_id, part, chr(97 + CAST(part AS INTEGER)) AS label, max(marks) AS marks,
    string_agg(piece, chr(10) || chr(10) ORDER BY i) FILTER (WHERE piece <> '') AS text
  FROM pieces GROUP BY doc_id, part),
ids AS (SELECT doc_id, 'cam-' || (doc_id % 25 + 2000) || '-p' || (doc_id % 9 + 1) || '-q' || (doc_id + 1)
    AS qid FROM documents)"""


def bracket_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers, _ = C.parse_content_lists(bracket_papers(spark, sf_dir))
    return C.chunk_papers(papers, "cambridge", "cam")


@query("chunk_bracket_papers", f"WITH {BRACKET_SQL}" + """
SELECT qid AS id, 'question' AS chunk_level, CAST(NULL AS VARCHAR) AS parent_chunk_id,
       CAST(NULL AS BIGINT) AS marks, t.total AS total_marks, md5(t.text) AS digest
FROM ids JOIN (SELECT doc_id, sum(marks) AS total,
       string_agg('(' || label || ') ' || text, chr(10) || chr(10) ORDER BY part) AS text
     FROM subs GROUP BY doc_id) t USING (doc_id)
UNION ALL
SELECT qid || '-' || label, 'sub_question', qid, marks, sum(marks) OVER (PARTITION BY doc_id),
       md5(text) FROM subs JOIN ids USING (doc_id)""")
def chunk_bracket_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-list JSON -> question and sub-question chunks."""
    return bracket_chunks(spark, sf_dir).select(
        "id", "chunk_level", "parent_chunk_id", "marks", "total_marks",
        F.md5("text").alias("digest"),
    )


@query("chunk_media_ownership", f"WITH {BRACKET_SQL}" + """, img AS (
  SELECT qid, chr(97 + CAST(least(i // 3, 25) AS INTEGER)) AS label, i FROM lines JOIN ids USING (doc_id)
  WHERE i % 3 = 2 AND doc_id % 2 = 0)
SELECT qid AS id, 'image_' || i AS media_id, 'visible_from_child' AS relation, label AS owner_label,
       i // 10 + 1 AS page_number FROM img
UNION ALL SELECT qid || '-' || label, 'image_' || i, 'direct', label, i // 10 + 1 FROM img""")
def chunk_media_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bracket_chunks(spark, sf_dir).select("id", F.explode("media").alias("m")).select(
        "id", "m.media_id", "m.relation", "m.owner_label", "m.page_number"
    )


@query("chunk_metadata_enriched", f"WITH {BRACKET_SQL}" + """
SELECT qid AS id, CAST(doc_id % 25 + 2000 AS INTEGER) AS year, CAST(doc_id % 9 + 1 AS INTEGER) AS paper,
  CASE WHEN doc_id % 2 = 0 THEN source ELSE 'Topic ' || lang END AS topic,
  'ab' || (doc_id % 7) AS author, 'Part IA' AS tripos_part,
  doc_id % 2 = 0 AND len(string_split(text, chr(10))) >= 3 AS has_figure
FROM documents JOIN ids USING (doc_id)""")
def chunk_metadata_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloader metadata joined by file name: numbers parser-first, topic theirs first."""
    papers, _ = C.parse_content_lists(bracket_papers(spark, sf_dir))
    meta = b.texts(spark, sf_dir).select(
        F.concat(F.lit("d"), F.col("doc_id"), F.lit(".pdf")).alias("filename"),
        F.lit(1999).alias("year"), F.lit(99).alias("paper"), F.lit(7).alias("question"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("topic"),
        F.lit(None).cast("string").alias("author"),
    )
    rows = C.chunk_papers(papers, "cambridge", "cam", meta)
    return rows.filter("chunk_level = 'question'").select(
        "id", "year", "paper", "topic", "author", "tripos_part", "has_figure"
    )


@query("chunking_run_summary", f"WITH {BRACKET_SQL}" + """
SELECT (SELECT count(*) FROM documents) AS questions, count(*) AS sub_questions, 0 AS warnings
FROM subs""")
def chunking_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunking_summary(bracket_chunks(spark, sf_dir))


BARE_SQL = LINES + f""",
raw AS (
  SELECT doc_id, lang, i // 20 AS q, i % 20 // 4 AS part, i * 2 + 1 AS ord, n, i,
    CASE WHEN i % 4 = 0 THEN 'L' || raw || ' p' || (i // 10)
         ELSE trim(raw || ' p' || (i // 10), """ + WSQ + f""") END AS piece,
    CASE WHEN i % 4 = 3 THEN i % 9 + 1 END AS marks
  FROM lines
  UNION ALL
  SELECT doc_id, lang, 0, 2, 20, n, i, 'UNIVERSITY EXAM ' || lang, NULL FROM lines
  WHERE i = 10 AND n <= 20),
subs AS (SELECT doc_id, q, part, chr(97 + CAST(part AS INTEGER)) AS label, max(marks) AS marks,
    string_agg(piece, chr(10) || chr(10) ORDER BY ord) FILTER (WHERE piece <> '') AS text
  FROM raw GROUP BY doc_id, q, part),
qs AS (SELECT doc_id, q,
    CASE WHEN doc_id = 0 THEN 'uoe-0_X'
         ELSE 'uoe-' || (doc_id % 25 + 2000) || '-p' || doc_id || '-q' || (q + 1) END AS qid,
    CASE WHEN count(*) = count(marks) THEN sum(marks) END AS total,
    string_agg('(' || label || ') ' || text, chr(10) || chr(10) ORDER BY part) AS text
  FROM subs GROUP BY doc_id, q)"""


@query("chunk_bare_papers", f"WITH {BARE_SQL}" + """
SELECT qid AS id, 'question' AS chunk_level, CAST(q + 1 AS INTEGER) AS question_number,
  CAST(NULL AS BIGINT) AS marks, total AS total_marks, md5(text) AS digest,
  'MECE' || (doc_id % 1000 + 10000) AS course_code
FROM qs
UNION ALL
SELECT qid || '-' || label, 'sub_question', CAST(q + 1 AS INTEGER), marks, total, md5(subs.text),
  'MECE' || (doc_id % 1000 + 10000) FROM subs JOIN qs USING (doc_id, q)""")
def chunk_bare_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover fields, question markers, running lines, bare labels, trailing marks."""
    rows = C.chunk_papers(bare_papers(spark, sf_dir), "uoe", "uoe")
    return rows.select(
        "id", "chunk_level", "question_number", "marks", "total_marks",
        F.md5("text").alias("digest"), F.col("metadata")["course_code"].alias("course_code"),
    )


@query("running_lines_removed", f"WITH {LINES}" + """
SELECT doc_id, count(*) AS kept, sum(length(line)) AS chars FROM lines l
WHERE NOT EXISTS (SELECT 1 FROM (
  SELECT doc_id, line FROM lines WHERE line <> '' AND length(line) <= 120
  GROUP BY doc_id, line HAVING count(DISTINCT i // 4) >= 3) r
  WHERE r.doc_id = l.doc_id AND r.line = l.line)
GROUP BY doc_id""")
def running_lines_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines (four to a page) that repeat on three pages are dropped everywhere."""
    docs = b.texts(spark, sf_dir).select("doc_id", F.transform(
        F.split("text", "\n"),
        lambda t, i: content_block("text", text=t, page=F.floor(i / 4).cast("int")),
    ).alias("blocks"))
    kept = C.drop_running_lines(docs)
    chars = F.aggregate(
        F.transform("blocks", lambda x: F.length(C.text_of(x))), F.lit(0), lambda a, x: a + x
    )
    return kept.filter(F.size("blocks") > 0).select(
        "doc_id", F.size("blocks").alias("kept"), chars.alias("chars")
    )


@query("sequential_labels", f"WITH RECURSIVE {LINES}" + """,
cand AS (SELECT doc_id, i, lower(line[1]) AS label FROM lines
         WHERE lower(line[1]) BETWEEN 'a' AND 'z' AND regexp_matches(line[1], '[A-Za-z]')),
acc AS (
  SELECT doc_id, 0 AS step, min(i) AS i FROM cand WHERE label = 'a' GROUP BY doc_id
  UNION ALL
  SELECT a.doc_id, a.step + 1, min(c.i) FROM acc a JOIN cand c
    ON c.doc_id = a.doc_id AND c.i > a.i AND c.label = chr(98 + a.step)
  GROUP BY a.doc_id, a.step)
SELECT doc_id, chr(97 + step) AS label, i AS line_no FROM acc""")
def sequential_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line initials as labels: only a, b, c, ... in order are accepted."""
    docs = b.texts(spark, sf_dir).select("doc_id", F.transform(
        F.split("text", "\n"), lambda t: X.strip(t)
    ).alias("ls"))
    segs = docs.select("doc_id", F.transform("ls", lambda t, i: F.struct(
        t.alias("text"), i.alias("block"), F.lit(0).alias("item"),
        F.when(F.substring(t, 1, 1).rlike("[A-Za-z]"), F.lower(F.substring(t, 1, 1)))
        .alias("label"),
    )).alias("segs"))
    starts = segs.select("doc_id", C.sequential_starts(F.col("segs")).alias("starts"))
    return starts.select("doc_id", F.explode("starts").alias("s")).select(
        "doc_id", "s.label", F.col("s.k").alias("line_no")
    )


@query("inline_math_runs", """
SELECT doc_id, len(regexp_extract_all(t, '\\$[^$\\n]+?\\$')) AS math_runs, md5(t) AS digest
FROM (SELECT doc_id, trim(regexp_replace(text, '([a-z]+ing)', '$\\1$', 'g'), """ + WSQ + """) AS t
      FROM documents)""")
def inline_math_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in -ing as inline math: runs counted, and flattened back unchanged."""
    t = X.strip(F.regexp_replace("text", "([a-z]+ing)", r"\$$1\$"))
    df = b.texts(spark, sf_dir).select("doc_id", t.alias("t"))
    df = df.withColumn("runs", B.inline_runs(F.col("t")))
    return df.select(
        "doc_id", F.size(F.filter("runs", lambda r: r["type"] == "math")).alias("math_runs"),
        F.md5(B.runs_text(F.col("runs"))).alias("digest"),
    )


SPACES = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query("page_fallback_text", f"""
SELECT page_id, length(t) AS chars, md5(t) AS digest FROM (
  SELECT page_id, '[table — see source] ' || trim(regexp_replace(
    replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
      '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'),
    '{SPACES}', ' ', 'g')) AS t FROM pages)""")
def page_fallback_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages through the malformed-table text: tags out, entities in, collapsed."""
    pages = b.texts(spark, sf_dir, "pages").select(
        "page_id", B.unescape_html(B.untagged("html")).alias("t")
    )
    text = B.table_fallback_text("t")
    return pages.select("page_id", F.length(text).alias("chars"), F.md5(text).alias("digest"))


@query("page_link_tables", r"""
SELECT page_id, count(*) AS n_rows, string_agg(label, '|' ORDER BY i) AS labels FROM (
  SELECT page_id, i, replace(trim(label), '&amp;', '&') AS label FROM (
    SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) AS label,
      unnest(generate_series(1, len(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>')))) AS i
    FROM pages)) GROUP BY page_id""")
def page_link_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation lists rewritten as table rows, read back by the table parser."""
    links = F.regexp_extract_all(
        "html", F.lit(r'<li><a href="[^"]*">([^<]*)</a></li>'), F.lit(1)
    )
    body = F.concat(F.lit("<table>"), F.array_join(F.transform(links, lambda t: F.concat(
        F.lit("<tr><th>link</th><td> "), t, F.lit("</td></tr>")
    )), ""), F.lit("</table>"))
    pages = b.texts(spark, sf_dir, "pages").select("page_id", F.array(body).alias("t"))
    rows = F.get(B.table_cells("t"), F.lit(0))["rows"]
    return pages.withColumn("rows", rows).filter(F.size("rows") > 0).select(
        "page_id", F.size("rows").alias("n_rows"),
        F.array_join(F.transform("rows", lambda r: F.get(r, F.lit(1))), "|").alias("labels"),
    )


@query("text_measures", f"""
SELECT doc_id, greatest(1, length(text) // 4) AS tokens, md5(text[1:500]) AS excerpt_digest,
  CASE WHEN length(c) <= 80 THEN c ELSE rtrim(c[1:77], {WSQ}) || '...' END AS preview
FROM (SELECT doc_id, text, trim(regexp_replace(text, '{SPACES}', ' ', 'g')) AS c FROM documents)""")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.texts(spark, sf_dir).select(
        "doc_id", X.token_estimate("text").alias("tokens"),
        F.md5(X.excerpt("text")).alias("excerpt_digest"),
        X.truncate_text("text", 80).alias("preview"),
    )


@query("token_budget_cut", f"""
WITH w AS (SELECT doc_id, text, unnest(string_split(c, ' ')) AS word,
             unnest(generate_series(1, len(string_split(c, ' ')))) AS i
           FROM (SELECT doc_id, text, trim(regexp_replace(text, '{SPACES}', ' ', 'g')) AS c
                 FROM documents)),
cum AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chars FROM w)
SELECT doc_id, md5(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE chars // 4 <= 52),
  rtrim(any_value(text)[1:208], {WSQ})) || ' [...truncated for context budget]') AS digest
FROM cum GROUP BY doc_id""")
def token_budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut to 60 tokens at a word boundary, marker included."""
    return b.texts(spark, sf_dir).select(
        "doc_id", F.md5(X.truncate_to_tokens("text", 60)).alias("digest")
    )


@query("object_keys", r"""
SELECT page_id,
  CASE WHEN k LIKE '%..%' THEN 'parent_segment' WHEN k LIKE '%//%' OR k LIKE '%/' THEN 'empty_segment'
       WHEN k LIKE '%?%' OR k LIKE '%#%' THEN 'url_char' END AS problem,
  'blobs/sha256/' || h[1:2] || '/' || h[3:4] || '/' || h || '.pdf' AS blob_key,
  CASE WHEN length(slug) BETWEEN 1 AND 60 THEN 'run-' || slug END AS run_id,
  CASE WHEN length(slug) BETWEEN 1 AND 60
       THEN 'artifacts/mineru/run-' || slug || '/images/p' || page_id || '.png' END AS image_key
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_replace(url, '^https?://', '') END AS k,
        sha256(html) AS h, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug
      FROM pages)""")
def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as object keys: reject reason, blob key, run id, image key."""
    key = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(
        F.regexp_replace("url", "^https?://", "")
    )
    pages = b.texts(spark, sf_dir, "pages").withColumn("run", K.run_id("url"))
    return pages.select(
        "page_id", K.key_problem(key).alias("problem"),
        K.blob_key(F.sha2("html", 256)).alias("blob_key"), F.col("run").alias("run_id"),
        K.artifact_key("run", F.lit("image"), F.concat(
            F.lit("p"), F.col("page_id"), F.lit(".png")
        )).alias("image_key"),
    )


@query("download_plan", """
SELECT o_orderkey, year, paper, question, topic, filename,
  CASE o_orderkey % 3 WHEN 0 THEN 'https://host.org/a/' || o_orderkey || '.pdf'
       WHEN 1 THEN 'https://exams.example.org/past/sub/' || o_orderkey || '.pdf'
       ELSE 'https://exams.example.org/past/' || filename END AS source_url
FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year,
        CAST(o_orderkey % 9 + 1 AS INTEGER) AS paper, CAST(o_orderkey % 10 AS INTEGER) AS question,
        CAST(o_orderkey AS VARCHAR) AS topic,
        'y' || year(o_orderdate) || 'p' || (o_orderkey % 9 + 1) || 'q' || (o_orderkey % 10) || '.pdf' AS filename
      FROM orders WHERE o_orderkey % 11 <> 0)""")
def download_index_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as CSV index rows with aliased headers; rows without a paper are rejected."""
    k = F.col("o_orderkey")
    rows = b.table(spark, sf_dir, "orders").select(
        F.concat(F.lit(" "), F.year("o_orderdate")).alias("Year"),
        F.when(k % 11 != 0, (k % 9 + 1).cast("string")).otherwise("n/a").alias("PAPER"),
        (k % 10).cast("string").alias("Q"),
        F.concat(k.cast("string"), F.lit(" ")).alias("Subject"),
        F.when(k % 3 == 0, F.concat(F.lit("https://host.org/a/"), k, F.lit(".pdf")))
        .otherwise("").alias("PDF-url"),
        F.when(k % 3 == 1, F.concat(F.lit("sub/"), k, F.lit(".pdf"))).alias("relative url"),
    )
    plan, _ = download_plan(rows, "https://exams.example.org/past/index.csv")
    return plan.select(
        F.col("topic").cast("bigint").alias("o_orderkey"), "year", "paper", "question", "topic",
        "filename", "source_url",
    )


@query("names_and_addresses", """
SELECT c_custkey, lower(trim(c_name)) || '@host.org' AS email, 'host.org' AS domain,
  upper(c_mktsegment) || ' Group ' || c_nationkey AS display_name
FROM customer""")
def names_and_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("\t "), F.col("c_name"), F.lit("@Host.ORG "))
    slug = F.concat(F.col("c_mktsegment"), F.lit("-group_"), F.col("c_nationkey"))
    return b.table(spark, sf_dir, "customer").select(
        "c_custkey", X.normalize_email(raw).alias("email"), X.email_domain(raw).alias("domain"),
        X.display_name(slug).alias("display_name"),
    )
