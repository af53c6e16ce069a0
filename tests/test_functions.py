import hashlib
import hmac
import random

from pyspark.sql import functions as F

from paperfold.functions import blocks as B
from paperfold.functions import keys as K
from paperfold.functions import metadata as M
from paperfold.functions import text as X


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first()["r"]


def test_strip_covers_unicode_whitespace(spark):
    padded = "\t  a b \n\x1f"
    assert one(spark, padded, X.strip("v")) == padded.strip() == "a b"


def test_truncate_text(spark):
    assert one(spark, "a  b\n c", X.truncate_text("v", 10)) == "a b c"
    assert one(spark, "abcdef ghijk", X.truncate_text("v", 10)) == "abcdef..."
    assert one(spark, "abcdef", X.truncate_text("v", 3)) == "..."


def test_token_cut_matches_word_by_word_rule(spark):
    rng = random.Random(3)
    texts = [" ".join("w" * rng.randint(1, 30) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts += ["x" * 500, "  " + "y" * 90 + " z", "a\n\nb " * 40]

    def expected(text, cap=20):
        def est(t):
            return max(1, len(t) // 4)
        target = max(1, cap - est(X.TRUNCATION_MARKER))
        kept = []
        for w in text.split():
            if est(" ".join([*kept, w])) > target:
                break
            kept.append(w)
        body = " ".join(kept) if kept else text[: target * 4]
        return f"{body.rstrip()} {X.TRUNCATION_MARKER}"

    df = spark.createDataFrame([(t,) for t in texts], "v string").select(
        "v", X.truncate_to_tokens("v", 20).alias("a"),
        X.truncate_to_tokens_with("v", 20, X.token_estimate).alias("b"),
    )
    for row in df.collect():
        assert row.a == expected(row.v)
        assert row.b == expected(row.v)


def test_names_and_addresses(spark):
    assert one(spark, "cs-TRIPOS_past papers", X.display_name("v")) == "Cs TRIPOS Past Papers"
    assert one(spark, "--", X.display_name("v")) == "--"
    assert one(spark, " A@B.org@x ", X.email_domain("v")) == "b.org@x"
    assert one(spark, "@b.org", X.email_domain("v")) is None
    assert one(spark, "  ", X.normalize_email("v")) is None
    assert one(spark, "PDF-url 2", X.clean_key("v")) == "pdfurl2"


def test_hmac(spark):
    for secret in ("k", "s" * 100):
        want = hmac.new(secret.encode(), b"user-1", hashlib.sha256).hexdigest()
        assert one(spark, "user-1", K.hmac_sha256(secret, "v")) == want


def test_keys(spark):
    bad = ["", "a" * 1025, "a/../b", "/a", "./a", "a\\b", "a//b", "a/./b", "a/", "a b", "a?b", "a#b"]
    df = spark.createDataFrame([(k,) for k in bad + ["a/b.png"]], "v string")
    got = [r.p for r in df.select(K.key_problem("v").alias("p")).collect()]
    assert all(got[:-1]) and got[-1] is None
    assert one(spark, "Paper 1.b", K.run_id("v")) == "run-paper-1-b"
    assert one(spark, "!!", K.run_id("v")) is None
    assert one(spark, "x" * 70, K.run_id("v")) is None
    assert one(spark, "a.png", K.artifact_key(F.lit("run-1"), F.lit("image"), F.col("v"))) == (
        "artifacts/mineru/run-1/images/a.png"
    )
    assert one(spark, "a/b.png", K.artifact_key(F.lit("run-1"), F.lit("image"), F.col("v"))) is None
    assert one(spark, "", K.artifact_key(F.lit("run-1"), F.lit("markdown"), F.col("v"))) == (
        "artifacts/mineru/run-1/document.md"
    )


def test_inline_math(spark):
    def kinds(text):
        runs = one(spark, text, B.inline_runs(F.col("v")))
        return [(r.type, r.text or r.latex) for r in runs]

    assert kinds("") == []
    assert kinds("a $x$ b") == [("text", "a "), ("math", "x"), ("text", " b")]
    assert kinds("$x$$y$") == [("math", "x"), ("math", "y")]
    assert kinds("cost \\$5 and \\$6") == [
        ("text", "cost \\"), ("math", "5 and \\"), ("text", "6")
    ]
    assert kinds("no $ math") == [("text", "no $ math")]


def test_list_markers(spark):
    rows = [(["1. a", "2. b"],), (["(iv) a", "b"],), (["\u0088 x", " ", "y"],)]
    df = spark.createDataFrame(rows, "v array<string>").select(B.shown_items(F.col("v")).alias("s"))
    df = df.withColumn("m", B.list_marker(F.col("s")))
    got = [
        (r.m, r.t) for r in df.select(
            "m", B.flatten_blocks(F.array(B.list_block(F.col("s"), F.col("m")))).alias("t")
        ).collect()
    ]
    assert got == [("ordered", "a\nb"), ("plain", "(iv) a\nb"), ("bullet", "x\ny")]


def test_table_rows_of_broken_markup(spark):
    bodies = ["<TABLE><tr class='x'><td> a <b>b</b></td><th>c &amp; d</th></tr><tr></tr><tr><td>lost<td>e</td></tr></table>",
              "<tr><td>open row</td>", "<td>no row</td>", None, "<tr><td>1 < 2</td ></tr ><tr><td>x<!-- y --></td></tr>",
              "<track><tr><tdx>no</tdx><td></td></tr>"]
    df = spark.createDataFrame([(bodies,)], "t array<string>").select(B.table_cells("t").alias("c"))
    assert [c.rows for c in df.first().c] == [
        [["a b", "c & d"], ["e"]], [], [], [], [["1 < 2"], ["x"]], [[""]]]
    plain = spark.createDataFrame([(["<tr><td> a </td></tr>"],)], "t array<string>").select(B.table_cells("t").alias("c"))
    assert plain.first().c[0].rows == [["a"]]


def test_equation_and_table_fallback(spark):
    assert one(spark, " $$ a+b $$ ", B.equation_latex(F.col("v"))) == "a+b"
    assert one(spark, "$$$", B.equation_latex(F.col("v"))) == "$$$"
    text = B.table_fallback_text(B.unescape_html(B.untagged("v")))
    assert one(spark, "<b>A &amp;</b>\n B", text) == "[table — see source] A & B"
    assert one(spark, "<b></b>", text) == "[table — see source]"


def test_excerpt_blocks_keep_a_paragraph(spark):
    def cut(spec, budget):
        blocks = F.array(*[
            B.block("paragraph", runs=F.array(B.text_run(F.lit(t)))) if k == "p"
            else B.block("code", code=F.lit(t)) for k, t in spec
        ])
        rows = one(spark, "", B.excerpt_blocks(blocks, budget))
        return [b.type[0] for b in rows]

    assert cut([("p", "x" * 50), ("p", "y")], 10) == ["p"]
    assert cut([("c", "x" * 5), ("c", "y" * 50), ("p", "z" * 50)], 10) == ["c", "p"]
    assert cut([("c", "x" * 50), ("p", "z" * 50)], 10) == ["p"]
    assert cut([("c", "x" * 50), ("c", "z")], 10) == ["c"]
    assert cut([("p", "ab"), ("c", "cd"), ("p", "ef")], 6) == ["p", "c"]


def test_metadata_views(spark):
    schema = [
        {"key": "year", "label": "Year", "type": "integer", "operators": ["eq"], "exposed": True},
        {"key": "ok", "label": "Ok", "type": "boolean", "operators": ["eq"], "exposed": True},
        {"key": "hidden", "label": "H", "type": "string", "operators": ["eq"], "exposed": False},
    ]
    doc = '{"ok":true,"year":2024,"hidden":"h","stray_key":"true"}'
    assert one(spark, doc, M.metadata_summary(schema, "v")) == "Year: 2024 | Ok: true"
    assert one(spark, doc, M.ui_summary(schema, "v")) == "2024 / Yes"
    assert one(spark, doc, M.ui_summary(None, "v")) == (
        "hidden: h / ok: Yes / stray key: true / year: 2024"
    )
    assert one(spark, doc, M.project_result_metadata(schema, "v")) == (
        '{"year":2024,"ok":true,"hidden":"h"}'
    )
    assert one(spark, '{"year":null}', M.has_key("v", "year")) is True
