import json

from pyspark.sql import functions as F

from paperfold.plans import chunking as C

HEADER = {"type": "header", "text": "COMPUTER SCIENCE TRIPOS Part IB – 2023 – Paper 4"}
LINE = {"type": "text", "text": "7 Databases (xy9)"}


def papers(spark, files):
    rows = [(f"/d/{name}_content_list.json", json.dumps(blocks) if not isinstance(blocks, str) else blocks)
            for name, blocks in files.items()]
    return C.parse_content_lists(spark.createDataFrame(rows, "path string, value string"))


def bracket(spark, blocks, meta=None):
    good, _ = papers(spark, {"p": blocks})
    return {r.id: r for r in C.chunk_papers(good, "cambridge", "cam", meta).collect()}


def test_labels_marks_media_and_empty_item(spark):
    rows = bracket(spark, [
        LINE,
        {"type": "text", "text": "Shared start"},
        {"type": "image", "img_path": "images/a.png", "page_idx": 0, "bbox": [1, 2, 3, 4]},
        {"type": "list", "list_items": ["( a ) one [2 marks] [3 marks]", "", "(i) nested"]},
        {"type": "text", "text": "(b) two\u0000 [1 mark]"},
        {"type": "table", "table_body": "<table><tr><td>x &lt; 1</td><th>y</th></tr></table>", "page_idx": 2},
        {"type": "text", "text": "(d) out of order"},
        {"type": "page_number", "text": "9"},
        HEADER,
    ])
    assert set(rows) == {"cam-2023-p4-q7", "cam-2023-p4-q7-a", "cam-2023-p4-q7-b"}
    q, a, b = (rows[k] for k in sorted(rows))
    assert (a.marks, b.marks, q.total_marks, q.marks) == (5, 1, 6, None)
    assert a.text == "one [2 marks] [3 marks]\n(i) nested"
    assert b.text == "two [1 mark]\n\nx < 1\ty\n\n(d) out of order"
    assert q.text.startswith("Shared start\n\n(a) one")
    assert (q.has_figure, q.has_table, q.has_code) == (True, True, False)
    assert [(m.media_id, m.relation) for m in q.media] == [
        ("image_1", "direct"), ("table_4", "visible_from_child")
    ]
    assert [(m.media_id, m.relation) for m in a.media] == [("image_1", "inherited_shared")]
    assert [(m.media_id, m.relation) for m in b.media] == [
        ("image_1", "inherited_shared"), ("table_4", "direct")
    ]
    assert q.media[0].file_path == "/d/images/a.png" and q.media[0].page_number == 1
    assert q.media[1].text_payload.startswith("<table>")
    assert b.parent_chunk_id == q.id and q.topic == "Databases" and q.tripos_part == "Part IB"


def test_missing_marks_leave_no_total_and_fallback_id(spark):
    rows = bracket(spark, [{"type": "text", "text": "(a) x [1 mark]"}, {"type": "text", "text": "(b) y"}])
    assert set(rows) == {"cam-p", "cam-p-a", "cam-p-b"}
    assert rows["cam-p"].total_marks is None
    assert rows["cam-p"].warnings == ["header_parse_failed", "question_line_parse_failed"]


def test_enrichment_precedence(spark):
    meta = spark.createDataFrame(
        [("p.pdf", 1999, 1, 2, "Other", "", None)],
        "filename string, year int, paper int, question int, topic string, author string, source_url string",
    )
    rows = bracket(spark, [LINE, {"type": "text", "text": "body"}], meta)
    q = rows["cam-1999-p1-q7"]
    assert (q.year, q.paper, q.question_number, q.topic, q.author) == (1999, 1, 7, "Other", "xy9")


def test_label_on_math_list_and_code(spark):
    rows = bracket(spark, [
        LINE, HEADER,
        {"type": "text", "text": "(a) $x$ first"},
        {"type": "equation", "text": "$$ e $$"},
        {"type": "code", "code_body": "let y = 1"},
        {"type": "list", "list_items": ["1. p", "2. q", "(b) tail"]},
        {"type": "chart", "text": "odd block"},
    ])
    assert rows["cam-2023-p4-q7-a"].text == "$x$ first\n\ne\n\nlet y = 1\n\np\nq"
    assert rows["cam-2023-p4-q7-b"].text == "tail\n\nodd block"
    assert rows["cam-2023-p4-q7"].text == (
        "(a) $x$ first\n\ne\n\nlet y = 1\n\np\nq\n\n(b) tail\n\nodd block"
    )


def test_bad_file_is_quarantined(spark):
    good, bad = papers(spark, {"ok": [LINE], "broken": "{"})
    assert [r.source_pdf for r in good.collect()] == ["ok.pdf"]
    assert [r.path for r in bad.collect()] == ["/d/broken_content_list.json"]


def bare_blocks():
    blocks = [
        {"type": "text", "text": "Duration of the whole exam"},
        {"type": "text", "text": "MECE10017 diet December 2022"},
        {"type": "text", "text": "Question 1"},
        {"type": "text", "text": "Intro"},
        {"type": "text", "text": "a) first"},
        {"type": "text", "text": "more (6)"},
        {"type": "footer", "text": "Please turn over.."},
        {"type": "text", "text": "b) second (4)"},
        {"type": "text", "text": "Question 2"},
        {"type": "list", "list_items": ["a) only (5)"]},
    ]
    for page in range(3):
        blocks.insert(4 + page, {"type": "text", "text": "RUNNING HEAD", "page_idx": page})
    return blocks


def test_bare_paper_golden(spark):
    good, _ = papers(spark, {"2019_X": bare_blocks()})
    rows = {r.id: r for r in C.chunk_papers(good, "uoe", "uoe").collect()}
    base = "uoe-2022-p2019"
    assert [rows[f"{base}-q1-{x}"].marks for x in "ab"] == [6, 4]
    assert rows[f"{base}-q2-a"].marks == 5
    assert (rows[f"{base}-q1"].total_marks, rows[f"{base}-q2"].total_marks) == (10, 5)
    assert rows[f"{base}-q1"].text == "Intro\n\n(a) first\n\nmore\n\n(b) second"
    assert rows[f"{base}-q1"].metadata == {
        "course_code": "MECE10017", "course_title": "MECE10017 diet December 2022",
        "document_id": "2019",
    }


def test_bare_paper_without_question_one_has_no_questions(spark):
    good, _ = papers(spark, {"1_X": [{"type": "text", "text": "Question 2"}, {"type": "text", "text": "a) b"}]})
    assert C.chunk_papers(good, "uoe", "uoe").count() == 0


def test_sub_question_parents_exist(spark):
    from paperfold.operators.quality import missing_parents

    good, _ = papers(spark, {"2019_X": bare_blocks()})
    rows = C.chunk_papers(good, "uoe", "uoe").select(
        F.lit("c").alias("collection"), F.col("id").alias("chunk_id"), "chunk_level", "parent_chunk_id"
    )
    assert missing_parents(rows).count() == 0
