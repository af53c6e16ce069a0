"""Secret scan with corpus-wide ownership frequency.

Candidates are the base spans (assignments, access ids, hex runs) and other long tokens that
mix letters and digits. Their value hashes are counted by distinct repositories and owners:
a value that COPIED_OWNERS owners or more share is a widely copied example; a value that
fewer hold and that looks random is owner-specific and possibly live. Base spans always
stay and carry their verdict; long tokens become spans only if owner-specific.

All expressions are built-in column functions.

Edge cases: a null text is empty; null repositories and owners count as one unknown each;
repeated rows are scanned each by itself and add no new owner; rows without candidates come
back with no span; an empty table gives an empty result; columns besides the four named
ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.llm.native import matches
from paperfold.llm.store import Stages, text_of

# The base patterns, in the order of their kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
LONG_TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "owned")
FEWEST_VALUE = 6
COPIED_OWNERS = 3
FEWEST_SIGNS = 10
SPAN = "array<struct<start: bigint, end: bigint, value: string>>"


def looks_random(value: Column) -> Column:
    """Letters and digits, and at least FEWEST_SIGNS different signs."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= FEWEST_SIGNS)


def candidates(text: Column) -> dict[str, Column]:
    """Spans by kind; cheap tests keep the patterns off texts that can't hold a match."""
    none = F.array().cast(SPAN)
    assign = F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= FEWEST_VALUE)
    return {
        "assign": F.when((text.contains("=") | text.contains(":")) & text.rlike(ASSIGN), assign).otherwise(none),
        "access": F.when(text.contains("AKIA"), matches(text, ACCESS)).otherwise(none),
        "hex": F.when(text.rlike(HEX), matches(text, HEX)).otherwise(none),
        "owned": F.when(text.rlike("[0-9]") & text.rlike(LONG_TOKEN), F.filter(matches(text, LONG_TOKEN), lambda m: looks_random(m["value"]))).otherwise(none),
    }


def tag(rank: int, kind: str):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"),
                              F.sha2(m["value"], 256).alias("value_sha256"), looks_random(m["value"]).alias("random"))


def scan(docs: DataFrame, ident: str = "doc_id", text: str = "text", repository: str = "source", owner: str = "source") -> DataFrame:
    """Per row: id and spans, an array of (start, rank, kind, end, value_sha256,
    repositories, owners, verdict), by start and kind; verdict is example, live or weak."""
    stages = Stages(docs.sparkSession, "secrets")
    body = text_of(docs[text].cast("string"))
    found = docs.select(docs[ident].alias("doc_id"), F.coalesce(docs[repository].cast("string"), F.lit("")).alias("repository"),
                        F.coalesce(docs[owner].cast("string"), F.lit("")).alias("owner"), *[c.alias(k) for k, c in candidates(body).items()])
    tagged = F.concat(*[F.transform(kind, tag(rank, kind)) for rank, kind in enumerate(KINDS)])
    apart = F.filter("all", lambda a: (a["kind"] != "owned") | ~F.exists(
        F.filter("all", lambda x: x["kind"] != "owned"), lambda x: (x["start"] < a["end"]) & (a["start"] < x["end"])))
    rows = stages.put("rows", found.select("doc_id", "repository", "owner", tagged.alias("all"))
                      .withColumn("all", F.when(F.size("all") > 0, apart).otherwise(F.col("all"))).withColumn("row", F.monotonically_increasing_id()))
    spans = rows.where(F.size("all") > 0).select("row", "repository", "owner", F.explode("all").alias("s"))
    places = spans.groupBy(F.col("s.value_sha256").alias("value_sha256"), "owner", "repository").agg(F.lit(1).alias("one"))
    owners = places.groupBy("value_sha256", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    owned = stages.put("owned", owners.groupBy("value_sha256").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners")))
    judged = spans.select("row", "s.*").join(owned, "value_sha256").withColumn(
        "verdict", F.when(F.col("owners") >= COPIED_OWNERS, "example").when(F.col("random"), "live").otherwise("weak"))
    judged = judged.where((F.col("kind") != "owned") | (F.col("verdict") == "live"))
    order = ["start", "rank", "kind", "end", "value_sha256", "repositories", "owners", "verdict"]
    held = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("spans"))
    some = rows.where(F.size("all") > 0).select("row", "doc_id").join(held, "row", "left")
    none = rows.where(F.size("all") == 0).select("doc_id")
    return (some.select("doc_id", "spans").unionByName(none, allowMissingColumns=True)
            .select(F.col("doc_id").alias(ident), F.coalesce("spans", F.array().cast(held.schema["spans"].dataType)).alias("spans")))
