"""Content blocks -> question / sub-question chunks.

One input row is one paper (one content-list file), so all order-dependent steps
run inside the row with array functions: no window, no shuffle, no Python except
the HTML table cells. At most 26 labels are ever accepted per question, which
keeps every owner lookup and every slice small.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperfold.functions import blocks as B
from paperfold.functions.keys import stem_of
from paperfold.functions.text import U, WS, bind, nonempty, rstrip, strip, strip_nul
from paperfold.schemas import CONTENT_BLOCK, MEDIA_REF, RENDER_BLOCKS

# Layout patterns of the two paper families.
SKIP_TYPES = ("page_number",)
SEGMENT_TYPES = ("text", "equation", "code", "table", "image")
HEADER_LINE = (
    f"{U}COMPUTER SCIENCE TRIPOS{WS}+Part{WS}+([A-Z]+){WS}*[–·\\-]{WS}*(\\d{{4}})"
    f"{WS}*[–·\\-]{WS}*Paper{WS}+(\\d+)"
)
QUESTION_LINE = (
    f"{U}\\A(\\d+){WS}+(.+?){WS}+\\({WS}*([A-Za-z0-9+]+){WS}*\\){WS}*\\z"
)
BRACKET_LABEL = f"{U}\\A\\({WS}*([a-z]){WS}*\\){WS}+"
BRACKET_PREFIX = f"{U}\\A\\({WS}*[a-z]{WS}*\\){WS}*"
BARE_LABEL = f"{U}\\A{WS}*([a-z])\\){WS}+"
BARE_PREFIX = f"{U}\\A{WS}*[a-z]\\){WS}*"
BRACKET_MARKS = f"{U}\\[{WS}*(\\d+){WS}+marks?{WS}*\\]"
TRAILING_MARKS = f"{U}\\((\\d+)\\){WS}*\\z"
QUESTION_MARKER = f"{U}\\A{WS}*Question{WS}+(\\d+){WS}*\\z"
COURSE_CODE = r"\b([A-Z]{3,4}\d{5})\b"
CALENDAR_YEAR = r"\b(20\d{2})\b"
FILE_NUMBER = r"\A(?:.*/)?(\d+)_"
COVER_BOILERPLATE = (
    "Date", "Time", "Duration", "Instructions", "Special Instructions",
    "Special Items Permitted", "Calculator", "Convener", "External Examiner",
)
COVER_NON_TITLES = ("SCHOOL OF ENGINEERING", "THE UNIVERSITY of EDINBURGH")
NON_CONTENT_PHRASES = ("please turn over", "end of paper")
NON_CONTENT_TYPES = ("text", "footer")

QUESTION_COLUMNS = (
    "source_pdf", "base_dir", "year", "paper", "question_number", "topic", "author",
    "tripos_part", "has_code", "has_figure", "has_table", "warnings", "metadata", "body",
)


@dataclass(frozen=True)
class Profile:
    """A paper family: how to find questions, and what labels and marks look like."""

    name: str
    label: str
    prefix: str
    trailing_marks: bool
    questions: Callable[[DataFrame], DataFrame]


def text_of(b: Column) -> Column:
    return strip(F.coalesce(b["text"], F.lit("")))


def plain_text(b: Column) -> Column:
    """A block's text by type."""
    return (
        F.when(b["type"] == "code", strip(F.coalesce(b["code_body"], F.lit(""))))
        .when(b["type"] == "table", strip(F.coalesce(b["table_body"], F.lit(""))))
        .when(b["type"] == "image", "")
        .when(b["type"] == "list", F.array_join(F.transform(b["list_items"], strip), "\n"))
        .otherwise(text_of(b))
    )


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def drop_skipped(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: ~F.coalesce(b["type"].isin(*SKIP_TYPES), F.lit(False)))


def has_type(blocks: Column, kind: str) -> Column:
    return F.exists(blocks, lambda b: F.coalesce(b["type"] == kind, F.lit(False)))


# --- bracket-label family ----------------------------------------------------

def parse_header(blocks: Column) -> Column:
    """part/year/paper from the first matching header block, else any block."""
    def is_hit(b: Column) -> Column:
        return text_of(b).rlike(HEADER_LINE)

    hit = F.coalesce(
        _first(F.filter(blocks, lambda b: (b["type"] == "header") & is_hit(b))),
        _first(F.filter(blocks, is_hit)),
    )
    line = text_of(hit)
    return F.when(hit.isNotNull(), F.struct(
        F.concat(F.lit("Part "), F.regexp_extract(line, HEADER_LINE, 1)).alias("part"),
        F.regexp_extract(line, HEADER_LINE, 2).try_cast("int").alias("year"),
        F.regexp_extract(line, HEADER_LINE, 3).try_cast("int").alias("paper"),
    ))


def parse_question_line(blocks: Column) -> Column:
    """Number, topic, author and position of the first question line."""
    lines = F.transform(
        blocks, lambda b, i: F.struct(i.alias("i"), b["type"].alias("type"), text_of(b).alias("t"))
    )
    hit = _first(F.filter(lines, lambda x: (x["type"] == "text") & x["t"].rlike(QUESTION_LINE)))
    return F.when(hit.isNotNull(), F.struct(
        hit["i"].alias("i"),
        F.regexp_extract(hit["t"], QUESTION_LINE, 1).try_cast("int").alias("number"),
        strip(F.regexp_extract(hit["t"], QUESTION_LINE, 2)).alias("topic"),
        F.regexp_extract(hit["t"], QUESTION_LINE, 3).alias("author"),
    ))


def bracket_questions(papers: DataFrame) -> DataFrame:
    """One question per paper: header, question line, body without headers."""
    df = papers.withColumn("blocks", drop_skipped(F.col("blocks")))
    df = df.withColumn("h", parse_header(F.col("blocks"))).withColumn(
        "q", parse_question_line(F.col("blocks"))
    )
    after = F.slice(
        F.col("blocks"), F.coalesce(F.col("q.i") + 2, F.lit(1)),
        F.greatest(F.size("blocks"), F.lit(1)),
    )
    return df.select(
        "source_pdf",
        "base_dir",
        F.col("h.year").alias("year"),
        F.col("h.paper").alias("paper"),
        F.col("q.number").alias("question_number"),
        F.col("q.topic").alias("topic"),
        F.col("q.author").alias("author"),
        F.col("h.part").alias("tripos_part"),
        has_type(F.col("blocks"), "code").alias("has_code"),
        has_type(F.col("blocks"), "image").alias("has_figure"),
        has_type(F.col("blocks"), "table").alias("has_table"),
        F.filter(
            F.array(
                F.when(F.col("h").isNull(), "header_parse_failed"),
                F.when(F.col("q").isNull(), "question_line_parse_failed"),
            ),
            lambda w: w.isNotNull(),
        ).alias("warnings"),
        F.expr("cast(map() as map<string,string>)").alias("metadata"),
        F.filter(after, lambda b: F.coalesce(b["type"] != "header", F.lit(True))).alias("body"),
    )


# --- bare-label family -------------------------------------------------------

def drop_running_lines(papers: DataFrame, min_pages: int = 3, max_len: int = 120) -> DataFrame:
    """Drop text seen on ``min_pages`` or more distinct pages of the paper.

    Sorted distinct (text, page) pairs: a text is running exactly when the pair
    ``min_pages - 1`` further on still carries it. n log n inside the row.
    """
    df = papers.withColumn("_pairs", F.array_sort(
        F.filter(
            F.transform("blocks", lambda b: F.struct(
                text_of(b).alias("t"), b["page_idx"].alias("p")
            )),
            lambda x: (x["t"] != "") & (F.length(x["t"]) <= max_len) & x["p"].isNotNull(),
        )
    ))
    df = df.withColumn("_pairs", bind(lambda s: F.filter(
        s["_pairs"], lambda x, i: (i == 0) | (F.get(s["_pairs"], i - 1) != x)
    ), "_pairs"))
    df = df.withColumn("_running", bind(lambda s: F.array_distinct(F.filter(
        F.transform(s["_pairs"], lambda x, i: F.when(
            F.get(s["_pairs"], i + (min_pages - 1))["t"] == x["t"], x["t"]
        )),
        lambda t: t.isNotNull(),
    )), "_pairs"))
    kept = bind(lambda s: F.filter(
        s["blocks"], lambda b: ~F.array_contains(s["_running"], text_of(b))
    ), "blocks", "_running")
    return df.withColumn("blocks", kept).drop("_pairs", "_running")


def is_non_content(b: Column) -> Column:
    phrase = F.rtrim(F.lower(text_of(b)), F.lit("."))
    return F.coalesce(
        b["type"].isin(*NON_CONTENT_TYPES) & phrase.isin(*NON_CONTENT_PHRASES), F.lit(False)
    )


def cover_fields(cover: Column) -> Column:
    """Course code, title and year: the first fitting text block of each."""
    texts = F.transform(F.filter(cover, lambda b: b["type"] == "text"), text_of)

    def first_group(pattern: str) -> Column:
        hits = F.filter(texts, lambda t: t.rlike(pattern))
        return nonempty(F.regexp_extract(_first(hits), pattern, 1))

    def is_title(t: Column) -> Column:
        low = F.lower(t)
        boiler = F.lit(False)
        for token in COVER_BOILERPLATE:
            boiler = boiler | low.startswith(token.lower())
        return (
            ~boiler
            & ~F.replace(t, F.lit(" "), F.lit("")).rlike(r"\A[A-Z]{3,4}\d{5}\z")
            & F.length(t).between(10, 160)
            & ~t.rlike(r"\A[\d/:\- ]+\z")
            & ~t.isin(*COVER_NON_TITLES)
            & (F.size(F.split(t, f"{U}{WS}+")) >= 3)
        )

    return F.struct(
        first_group(COURSE_CODE).alias("course_code"),
        _first(F.filter(texts, is_title)).alias("course_title"),
        first_group(CALENDAR_YEAR).try_cast("int").alias("year"),
    )


def explode_marker_groups(papers: DataFrame) -> DataFrame:
    """One row per 'Question N' marker: its number and the blocks up to the next."""
    df = papers.withColumn("_marks", F.filter(
        F.transform("blocks", lambda b, i: F.struct(
            i.alias("i"),
            F.regexp_extract(text_of(b), QUESTION_MARKER, 1).try_cast("int").alias("number"),
        )),
        lambda m: m["number"].isNotNull(),
    ))
    groups = bind(lambda s: F.transform(s["_marks"], lambda m, g: F.struct(
        m["number"].alias("number"),
        F.slice(
            s["blocks"], m["i"] + 2,
            F.coalesce(F.get(s["_marks"], g + 1)["i"], F.size(s["blocks"])) - m["i"] - 1,
        ).alias("body"),
    )), "_marks", "blocks")
    # The outer form: Spark derives no "array not empty" filter from it, which would be
    # pushed below this chain of array columns and evaluate all of it twice.
    df = df.withColumn("g", F.explode_outer(groups)).drop("_marks", "blocks")
    return df.filter(F.col("g").isNotNull())


def bare_questions(papers: DataFrame) -> DataFrame:
    """Many questions per paper, split on 'Question N' markers after the cover.

    A paper without a literal 'Question 1' yields no question.
    """
    df = papers.withColumn("blocks", drop_skipped(F.col("blocks")))
    df = drop_running_lines(df)
    df = df.withColumn("blocks", F.filter(F.col("blocks"), lambda b: ~is_non_content(b)))
    first_q = F.array_position(
        F.transform(F.col("blocks"), lambda b: F.regexp_extract(text_of(b), QUESTION_MARKER, 1)),
        "1",
    )
    df = df.withColumn("q1", first_q).withColumn(
        "cover",
        cover_fields(F.when(F.col("q1") > 0, F.slice("blocks", F.lit(1), F.col("q1").cast("int") - 1))
                     .otherwise(F.col("blocks"))),
    )
    df = explode_marker_groups(df.withColumn("blocks", F.when(
        F.col("q1") > 0, F.slice("blocks", F.col("q1").cast("int"), F.size("blocks"))
    )))
    number = F.regexp_extract(F.col("source_pdf"), FILE_NUMBER, 1).try_cast("int")
    meta = F.map_filter(
        F.create_map(
            F.lit("course_code"), F.col("cover.course_code"),
            F.lit("course_title"), F.col("cover.course_title"),
            F.lit("document_id"), number.cast("string"),
        ),
        lambda _, v: F.coalesce(v, F.lit("")) != "",
    )
    null_text = F.lit(None).cast("string")
    return df.select(
        "source_pdf",
        "base_dir",
        F.col("cover.year").alias("year"),
        number.alias("paper"),
        F.col("g.number").alias("question_number"),
        null_text.alias("topic"),
        null_text.alias("author"),
        null_text.alias("tripos_part"),
        has_type(F.col("g.body"), "code").alias("has_code"),
        has_type(F.col("g.body"), "image").alias("has_figure"),
        has_type(F.col("g.body"), "table").alias("has_table"),
        F.filter(
            F.array(
                F.when(F.col("cover.course_code").isNull(), "uoe_course_code_missing"),
                F.when(F.col("cover.course_title").isNull(), "uoe_course_title_missing"),
                F.when(F.col("cover.year").isNull(), "uoe_year_missing"),
            ),
            lambda w: w.isNotNull(),
        ).alias("warnings"),
        meta.alias("metadata"),
        F.col("g.body").alias("body"),
    )


PROFILES = {
    "cambridge": Profile("cambridge", BRACKET_LABEL, BRACKET_PREFIX, False, bracket_questions),
    "uoe": Profile("uoe", BARE_LABEL, BARE_PREFIX, True, bare_questions),
}


def register_profile(profile: Profile) -> None:
    """Plug in a further paper family."""
    PROFILES[profile.name] = profile


# --- segments and labels -----------------------------------------------------

def segments(body: Column, label_pattern: str) -> Column:
    """Logical lines: each list item on its own, other blocks whole if non-empty."""
    def of_block(b: Column, i: Column) -> Column:
        whole = plain_text(b)
        return (
            F.when(b["type"] == "list", F.transform(
                b["list_items"],
                lambda it, j: F.struct(strip(it).alias("text"), i.alias("block"), j.alias("item")),
            ))
            .when(
                b["type"].isin(*SEGMENT_TYPES) & (whole != ""),
                F.array(F.struct(whole.alias("text"), i.alias("block"), F.lit(0).alias("item"))),
            )
            .otherwise(F.array().cast("array<struct<text:string,block:int,item:int>>"))
        )

    flat = F.flatten(F.filter(F.transform(body, of_block), lambda x: x.isNotNull()))
    return F.transform(flat, lambda s: s.withField(
        "label", nonempty(F.regexp_extract(s["text"], label_pattern, 1))
    ))


def sequential_starts(segs: Column) -> Column:
    """Accept 'a', then 'b', ... strictly in order; other labels stay nested.

    The fold runs over labelled segments only and accepts at most 26 of them.
    """
    labelled = F.filter(
        F.transform(segs, lambda s, k: F.struct(
            k.alias("k"), s["block"].alias("block"), s["item"].alias("item"),
            s["label"].alias("label"),
        )),
        lambda s: s["label"].isNotNull(),
    )
    return F.aggregate(
        labelled,
        F.array().cast("array<struct<k:int,block:int,item:int,label:string>>"),
        lambda acc, s: F.when(
            F.ascii(s["label"]) == F.size(acc) + ord("a"), F.concat(acc, F.array(s))
        ).otherwise(acc),
    )


def _texts(segs: Column, start: Column, count: Column) -> Column:
    return F.transform(F.slice(segs, start, count), lambda s: s["text"])


def preamble_text(segs: Column, starts: Column) -> Column:
    upto = F.coalesce(_first(starts)["k"], F.size(segs))
    return strip(F.array_join(_texts(segs, F.lit(1), upto), "\n"))


def with_sub_questions(df: DataFrame, profile: Profile) -> DataFrame:
    """label, text without label and marks, marks: one per accepted label."""
    df = df.withColumn("_p", bind(lambda s: F.transform(s["starts"], lambda a, i: F.struct(
        a["label"].alias("label"),
        _texts(
            s["segs"], a["k"] + 1,
            F.coalesce(F.get(s["starts"], i + 1)["k"], F.size(s["segs"])) - a["k"],
        ).alias("parts"),
    )), "starts", "segs"))
    if not profile.trailing_marks:
        df = df.withColumn("_p", F.transform("_p", lambda s: F.struct(
            s["label"].alias("label"),
            F.regexp_replace(strip(F.array_join(s["parts"], "\n")), profile.prefix, "").alias("t"),
        )))
        df = df.withColumn("_p", F.transform("_p", lambda s: F.struct(
            s["label"].alias("label"), s["t"].alias("t"),
            F.regexp_extract_all(s["t"], F.lit(BRACKET_MARKS), F.lit(1)).alias("m"),
        )))
        return df.withColumn("subs", F.transform("_p", lambda s: F.struct(
            s["label"].alias("label"),
            strip(F.regexp_replace(s["t"], BRACKET_MARKS, "")).alias("text"),
            F.when(F.size(s["m"]) > 0, F.aggregate(
                s["m"], F.lit(0), lambda acc, m: acc + F.coalesce(m.try_cast("int"), F.lit(0))
            )).alias("marks"),
        ))).drop("_p")
    df = df.withColumn("_p", F.transform("_p", lambda s: F.struct(
        s["label"].alias("label"),
        F.transform(s["parts"], lambda p, i: F.when(
            i == 0, F.regexp_replace(p, profile.prefix, "")
        ).otherwise(p)).alias("parts"),
    )))
    df = df.withColumn("_p", F.transform("_p", lambda s: F.struct(
        s["label"].alias("label"), s["parts"].alias("parts"),
        B._last_true(F.transform(s["parts"], lambda p: p.rlike(TRAILING_MARKS))).alias("at"),
    )))
    return df.withColumn("subs", F.transform("_p", lambda s: F.struct(
        s["label"].alias("label"),
        strip(F.array_join(F.filter(
            F.transform(s["parts"], lambda p, i: F.when(
                i == s["at"], strip(F.regexp_replace(p, TRAILING_MARKS, ""))
            ).otherwise(p)),
            lambda p: p != "",
        ), "\n")).alias("text"),
        F.when(s["at"] >= 0, F.regexp_extract(
            F.get(s["parts"], s["at"]), TRAILING_MARKS, 1
        ).try_cast("int")).alias("marks"),
    ))).drop("_p")


def total_marks(subs: Column) -> Column:
    """NULL without subs or when any sub has no marks, else the sum."""
    return F.when(
        (F.size(subs) > 0) & F.forall(subs, lambda s: s["marks"].isNotNull()),
        F.aggregate(subs, F.lit(0), lambda acc, s: acc + s["marks"]),
    )


def media_blocks(body: Column, starts: Column, base_dir: Column) -> Column:
    """Images and tables of a body with the label that owns them (NULL = shared)."""
    def one(b: Column, i: Column) -> Column:
        path = b["img_path"]
        return F.struct(
            F.concat(b["type"], F.lit("_"), i.cast("string")).alias("media_id"),
            b["type"].alias("kind"),
            F.when(path.startswith("/"), path)
            .otherwise(F.concat(base_dir, F.lit("/"), path)).alias("file_path"),
            (b["page_idx"] + 1).alias("page_number"),
            F.when(F.size(b["bbox"]) == 4, b["bbox"]).alias("bbox"),
            i.alias("order_index"),
            F.when(b["type"] == "table", nonempty(strip(b["table_body"]))).alias("text_payload"),
            F.try_element_at(
                F.filter(starts, lambda s: s["block"] <= i), F.lit(-1)
            )["label"].alias("owner"),
        )

    return F.filter(F.transform(body, one), lambda m: m["kind"].isin("image", "table"))


def media_refs(media: Column, chunk_label: Column, known_labels: Column) -> Column:
    """References of one chunk: the question (label NULL) or one sub-question.

    Shared media: direct on the question, inherited by every sub. Owned: direct on
    its sub, visible from the child on the question. Unknown owner: question only.
    """
    def ref(m: Column) -> Column:
        owned = m["owner"].isNotNull() & F.array_contains(known_labels, m["owner"])
        relation = (
            F.when(chunk_label.isNull() & ~owned, "direct")
            .when(chunk_label.isNull(), "visible_from_child")
            .when(owned, "direct")
            .otherwise("inherited_shared")
        )
        values = {
            "relation": relation,
            "object_key": F.lit(None).cast("string"),
            "owner_level": F.when(owned, "sub_question").otherwise("question"),
            "owner_label": F.when(owned, m["owner"]),
            "text_payload": strip_nul(m["text_payload"]),
            "description": F.lit(None).cast("string"),
        }
        return F.struct(*[
            values.get(f.name, m[f.name] if f.name not in values else None).alias(f.name)
            for f in MEDIA_REF.fields
        ])

    mine = F.filter(
        media,
        lambda m: chunk_label.isNull() | m["owner"].isNull() | (m["owner"] == chunk_label),
    )
    return F.transform(mine, ref)


def with_pieces(df: DataFrame, profile: Profile) -> DataFrame:
    """``pieces``: the body as (owner, render block) in order.

    Owner 0 is the unlabelled preamble, owner k the k-th accepted label. Items of one
    list block with the same owner form one list block again.
    """
    def owner(starts: Column, i: Column, j: Column) -> Column:
        return F.size(F.filter(
            starts, lambda a: (a["block"] < i) | ((a["block"] == i) & (a["item"] <= j))
        ))

    df = df.withColumn("_b", bind(lambda s: F.transform(s["body"], lambda b, i: F.struct(
        b.alias("b"), i.alias("i"), owner(s["starts"], i, F.lit(0)).alias("o"),
        F.when(b["type"] == "list", F.transform(
            b["list_items"], lambda _, j: owner(s["starts"], i, j)
        )).alias("os"),
    )), "body", "starts"))
    plain = F.struct
    df = df.withColumn("_p", F.flatten(F.transform("_b", lambda x: F.when(
        x["b"]["type"] == "list",
        F.transform(F.array_distinct(x["os"]), lambda o: plain(
            o.alias("o"), x["i"].alias("i"), x["b"]["type"].alias("type"),
            F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("code"),
            B.shown_items(F.filter(
                x["b"]["list_items"], lambda _, j: F.get(x["os"], j) == o
            )).alias("shown"),
        )),
    ).otherwise(F.array(plain(
        x["o"].alias("o"), x["i"].alias("i"), x["b"]["type"].alias("type"),
        x["b"]["text"].alias("text"), x["b"]["code_body"].alias("code"),
        F.array().cast("array<string>").alias("shown"),
    ))))))
    df = df.withColumn("_p", bind(lambda s: F.transform(s["_p"], lambda x: F.struct(
        x.alias("x"), B.list_marker(x["shown"]).alias("marker"),
        F.get(
            s["tables"], (F.array_position(s["table_at"], x["i"]) - 1).cast("int")
        ).alias("cells"),
    )), "_p", "tables", "table_at"))
    df = df.withColumn("pieces", F.transform("_p", lambda p: F.struct(
        p["x"]["o"].alias("o"),
        F.when(p["x"]["type"] == "list", B.list_block(p["x"]["shown"], p["marker"]))
        .otherwise(B.render_plain(
            p["x"]["type"], p["x"]["text"], p["x"]["code"],
            F.concat(p["x"]["type"], F.lit("_"), p["x"]["i"].cast("string")), p["cells"],
        )).alias("block"),
    )))
    df = df.withColumn("pieces", F.filter("pieces", lambda p: p["block"].isNotNull()))
    df = edit_pieces(
        df, "pieces",
        lambda b: B.block_hit(b, lambda t: t.rlike(profile.prefix)),
        lambda b, _: B.edit_block(
            b, lambda t: t.rlike(profile.prefix),
            lambda t: F.regexp_replace(t, profile.prefix, ""),
        ),
    )
    if profile.trailing_marks:
        ending = f"{TRAILING_MARKS}|{WS}\\z"
        df = edit_pieces(
            df, "pieces",
            lambda b: B.block_hit(b, lambda t: t.rlike(ending)),
            lambda b, _: B.edit_block(
                b, lambda t: t.rlike(ending),
                lambda t: rstrip(F.regexp_replace(t, TRAILING_MARKS, "")), last=True,
            ),
            last=True,
        )
    return df.drop("_b", "_p")


def edit_pieces(df: DataFrame, name: str, hit, edit, last: bool = False) -> DataFrame:
    """Edit, per labelled owner, the first (or last) piece whose block is a hit.

    Owners never decrease along the array, so "first of its owner" is a comparison
    with the neighbouring hit: linear.
    """
    step = 1 if last else -1
    df = df.withColumn("_h", F.filter(
        F.transform(name, lambda p, i: F.struct(
            p["o"].alias("o"), i.alias("i"), hit(p["block"]).alias("h")
        )),
        lambda x: x["h"] & (x["o"] > 0),
    ))
    df = df.withColumn("_at", bind(lambda s: F.transform(
        F.filter(s["_h"], lambda x, k: F.coalesce(
            F.get(s["_h"], k + step)["o"] != x["o"], F.lit(True)
        )),
        lambda x: x["i"],
    ), "_h"))
    edited = bind(lambda s: F.transform(s[name], lambda p, i: F.when(
        F.array_contains(s["_at"], i),
        F.struct(p["o"].alias("o"), edit(p["block"], p["o"]).alias("block")),
    ).otherwise(p)), name, "_at")
    return df.withColumn(name, edited).drop("_h", "_at")


def label_of(owner: Column) -> Column:
    return F.char(owner + (ord("a") - 1))


# --- the job -----------------------------------------------------------------

def parse_questions(papers: DataFrame, profile: Profile) -> DataFrame:
    """Papers (source_pdf, base_dir, blocks) -> one row per question, parts as arrays."""
    df = profile.questions(papers)
    df = df.withColumn("segs", segments(F.col("body"), profile.label))
    df = df.withColumn("starts", sequential_starts(F.col("segs")))
    table_rows = F.filter(
        F.transform(F.col("body"), lambda b, i: F.struct(
            i.alias("i"), b["type"].alias("type"), b["table_body"].alias("body")
        )),
        lambda x: x["type"] == "table",
    )
    df = df.withColumn("t", table_rows)
    df = df.withColumn("tables", B.table_cells(F.transform("t", lambda x: x["body"])))
    df = df.withColumn("table_at", F.transform("t", lambda x: x["i"]))
    df = with_sub_questions(df, profile)
    df = df.withColumn("preamble", preamble_text(F.col("segs"), F.col("starts")))
    df = df.withColumn("total_marks", total_marks(F.col("subs")))
    df = df.withColumn("media", bind(
        lambda s: media_blocks(s["body"], s["starts"], s["base_dir"]),
        "body", "starts", "base_dir",
    ))
    df = with_pieces(df, profile)
    return df.drop("t", "tables", "table_at", "segs", "starts", "body")


def enrich(questions: DataFrame, download_meta: DataFrame | None) -> DataFrame:
    """Downloader metadata by file name. Numbers: the parser's value first, a missing
    or zero one falls through; topic and author: the downloader's first."""
    if download_meta is None:
        return questions
    meta = download_meta.select(
        F.col("filename").alias("source_pdf"),
        *[F.col(c).alias(f"d_{c}") for c in ("year", "paper", "question", "topic", "author")],
    )
    df = questions.join(meta, "source_pdf", "left")
    numbers = {"year": "d_year", "paper": "d_paper", "question_number": "d_question"}
    for own, other in numbers.items():
        df = df.withColumn(own, F.coalesce(F.nullif(F.col(own), F.lit(0)), F.col(other)))
    for own in ("topic", "author"):
        df = df.withColumn(own, F.coalesce(nonempty(f"d_{own}"), F.col(own)))
    return df.drop(*[c for c in df.columns if c.startswith("d_")])


def chunk_id(university: Column, year: Column, paper: Column, question: Column,
             source_pdf: Column, label: Column | None = None) -> Column:
    """{uni}-{year}-p{paper}-q{question}[-{label}], else {uni}-{file stem}[-{label}]."""
    known = (
        (F.coalesce(year, F.lit(0)) != 0)
        & (F.coalesce(paper, F.lit(0)) != 0)
        & (F.coalesce(question, F.lit(0)) != 0)
    )
    base = F.when(
        known,
        F.concat(university, F.lit("-"), year.cast("string"), F.lit("-p"),
                 paper.cast("string"), F.lit("-q"), question.cast("string")),
    ).otherwise(F.concat(university, F.lit("-"), stem_of(source_pdf)))
    return base if label is None else F.concat(base, F.lit("-"), label)


def build_chunks(questions: DataFrame, university: str | Column) -> DataFrame:
    """Question rows -> chunk rows: the question and its sub-questions (union all
    inside the row, then one explode)."""
    uni = F.lit(university) if isinstance(university, str) else university
    df = questions.withColumn("qid", chunk_id(
        uni, F.col("year"), F.col("paper"), F.col("question_number"), F.col("source_pdf")
    ))
    df = df.withColumn("labels", F.transform("subs", lambda s: s["label"]))
    df = df.withColumn("no_holder", F.array_except(
        F.transform("pieces", lambda p: p["o"]),
        F.transform(
            F.filter("pieces", lambda p: B.takes_label(p["block"])), lambda p: p["o"]
        ),
    ))
    df = df.withColumn("q_pieces", F.col("pieces"))
    df = edit_pieces(
        df, "q_pieces", B.takes_label, lambda b, o: B.put_label(b, label_of(o))
    )
    df = df.withColumn("q_blocks", F.flatten(bind(lambda z: F.transform(
        z["q_pieces"],
        lambda p, i: F.when(
            (p["o"] > 0) & F.array_contains(z["no_holder"], p["o"])
            & ((i == 0) | (F.get(z["q_pieces"], i - 1)["o"] != p["o"])),
            F.array(B.label_paragraph(label_of(p["o"])), p["block"]),
        ).otherwise(F.array(p["block"])),
    ), "q_pieces", "no_holder")))
    df = df.withColumn("sub_rows", bind(lambda z: F.transform(z["subs"], lambda s, k: F.struct(
        s.alias("s"),
        F.transform(
            F.filter(z["pieces"], lambda p: p["o"] == k + 1), lambda p: p["block"]
        ).alias("blocks"),
    )), "subs", "pieces"))
    df = df.withColumn("sub_rows", F.transform("sub_rows", lambda r: F.struct(
        r["s"].alias("s"), r["blocks"].alias("blocks"),
        F.when(F.size(r["blocks"]) > 0, strip(B.flatten_blocks(r["blocks"])))
        .otherwise(r["s"]["text"]).alias("text"),
    )))
    fallback = F.array_join(
        F.filter(
            F.concat(
                F.array(strip("preamble")),
                F.transform("subs", lambda s: F.concat(
                    F.lit("("), s["label"], F.lit(") "), s["text"]
                )),
            ),
            lambda p: p != "",
        ),
        "\n\n",
    )
    q_text = strip(F.when(
        F.size("q_blocks") > 0, B.flatten_blocks("q_blocks")
    ).otherwise(fallback))
    null_text = F.lit(None).cast("string")

    shared = ("year", "paper", "question_number", "topic", "author", "tripos_part",
              "total_marks", "has_code", "has_figure", "has_table", "source_pdf", "metadata")
    for c in ("topic", "author", "tripos_part"):
        df = df.withColumn(c, strip_nul(c))
    df = df.withColumn("metadata", strip_nul(
        F.col("metadata"), T.MapType(T.StringType(), T.StringType())
    ))

    def row(source, **own: Column) -> Column:
        values = {c: source(c) for c in shared} | own
        return F.struct(*[v.alias(k) for k, v in sorted(values.items())])

    df = df.withColumn("q_text", q_text)
    question = row(
        F.col,
        id=F.col("qid"),
        chunk_level=F.lit("question"),
        parent_chunk_id=null_text,
        sub_question_label=null_text,
        text=strip_nul("q_text"),
        marks=F.lit(None).cast("int"),
        media=bind(lambda z: media_refs(z["media"], null_text, z["labels"]), "media", "labels"),
        warnings=F.col("warnings"),
        render_blocks=strip_nul(F.col("q_blocks"), RENDER_BLOCKS),
    )

    def sub(z: Column, r: Column) -> Column:
        s = r["s"]
        return row(
            lambda c: z[c],
            id=F.concat(z["qid"], F.lit("-"), s["label"]),
            chunk_level=F.lit("sub_question"),
            parent_chunk_id=z["qid"],
            sub_question_label=s["label"],
            text=strip_nul(r["text"]),
            marks=s["marks"],
            media=media_refs(z["media"], s["label"], z["labels"]),
            warnings=F.array().cast("array<string>"),
            render_blocks=strip_nul(r["blocks"], RENDER_BLOCKS),
        )

    subs = bind(
        lambda z: F.transform(z["sub_rows"], lambda r: sub(z, r)),
        "sub_rows", "qid", "media", "labels", *shared,
    )
    rows = F.concat(F.array(question), subs)
    return df.select(F.inline_outer(rows))


def chunk_papers(papers: DataFrame, parser: str, university: str | Column,
                 download_meta: DataFrame | None = None) -> DataFrame:
    """The chunking job for one paper family."""
    questions = parse_questions(papers, PROFILES[parser])
    return build_chunks(enrich(questions, download_meta), university)


def chunking_summary(chunks: DataFrame) -> DataFrame:
    """Questions, sub-questions and warnings of a run."""
    return chunks.agg(
        F.count_if(F.col("chunk_level") == "question").alias("questions"),
        F.count_if(F.col("chunk_level") == "sub_question").alias("sub_questions"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings"),
    )


def parse_content_lists(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, value) rows -> (papers, quarantine): bad JSON goes to quarantine."""
    parsed = files.select(
        "path",
        F.regexp_replace("path", r"/[^/]*\z", "").alias("base_dir"),
        F.concat(
            F.regexp_extract("path", r"([^/]*)_content_list\.json\z", 1), F.lit(".pdf")
        ).alias("source_pdf"),
        F.from_json("value", T.ArrayType(CONTENT_BLOCK)).alias("blocks"),
    )
    good = parsed.filter(F.col("blocks").isNotNull())
    bad = parsed.filter(F.col("blocks").isNull()).select(
        "path", F.lit("not_a_block_list").alias("reason")
    )
    return good, bad
