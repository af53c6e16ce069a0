"""Benchmark decontamination by templates.

Texts become tokens (words, numbers); numbers, units after numbers and names become typed
placeholders, the rest is lower-cased. Every window of WINDOW tokens of every text is hashed
and joined with the windows of the benchmark items (an item with fewer tokens is one window
of its own length). Hits of one item on one alignment are put together, and the values that
stand in their placeholders must map consistently: one value of the item always meets the
same value of the text. Windows with an item value that meets several values on the alignment
count only if they are copies (all values equal); the other windows of the alignment count. So
copies are found as well as questions with new numbers and names.
The template of a window that is mostly placeholders says little, so such windows (tables,
arithmetic) are hashed by their lower-cased tokens instead and found as copies only.

Items of fewer than LEAST_TOKENS tokens are too common to speak of a leak: they are found as
copies only, reported in ``short_item_ids``, and contaminate nothing.

Words that start with a capital within a sentence count as names in a second template, which
is made only of texts that have such words.

All expressions are built-in column functions. A first pass hashes the windows of all texts
and keeps the texts that share a hash with an item; positions and values are made for these
only. Benchmark windows are broadcast only if they are at most BROADCAST_WINDOWS (counted
first), keys of texts if at most BROADCAST_KEYS, else they are joined by a shuffle.

Edge cases: null and empty texts hold nothing, nor do items without tokens; a null item id
is a value like any other; repeated rows get the same verdict; items that repeat are hit
together; empty tables give no hit; columns besides id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.functions.text import let
from paperfold.llm import names
from paperfold.llm.store import Stages, row_key, text_of

WINDOW = 13
LEAST_TOKENS = 5
BROADCAST_WINDOWS = 200_000
BROADCAST_KEYS = 1_000_000
TOKEN = r"\d+(?:[.,]\d+)*+|[\p{L}\p{M}]+"
TOKEN_OR_STOP = TOKEN + r"|[.!?\n]"
CAPITAL_INSIDE = r"[\p{Ll},;:] \p{Lu}\p{Ll}"
LEXICON = sorted({n.lower() for group in (names.WOMEN, names.MEN) for n in sum(group.values(), [])})
STOPS = [".", "!", "?", "\n"]


def is_number(token: Column) -> Column:
    return (token < ":") & (token >= "0")  # tokens start with a digit or a letter


def template(tokens: Column, capitals: bool) -> Column:
    """Array of (t, v, raw): the template's token, the value where it is a placeholder, and
    the lower-cased token. The units and names of each token depend on it and on the one before."""

    def one(w: Column, i: Column) -> Column:
        low = F.lower(w)
        before = F.get(tokens, i - 1)
        name = low.isin(LEXICON)
        if capitals:
            name = name | ((low != w) & before.isNotNull() & ~before.isin(STOPS))
        kind = (F.when(is_number(w), "<number>").when(name, "<name>")
                .when(before.isNotNull() & is_number(before) & low.isin(names.UNITS), "<unit>"))
        return F.struct(F.coalesce(kind, low).alias("t"), F.when(kind.isNotNull(), low).alias("v"), low.alias("raw"))

    out = F.transform(tokens, one)
    return F.filter(out, lambda x: ~x["t"].isin(STOPS)) if capitals else out


def windows(made: Column, lengths: list[int]) -> Column:
    """Array of (h, at, values) of all windows of the given lengths; values is null where no
    token of the text is a placeholder. h is the hash of the template, or of the raw tokens
    (no values then) where more than half of the window are placeholders."""

    def of(parts: Column) -> Column:
        def cut(n: int) -> Column:
            starts = F.sequence(F.lit(0), F.size(parts["t"]) - n)
            plain = F.transform(starts, lambda i: F.struct(
                F.xxhash64(F.slice(parts["t"], i + 1, n)).alias("h"), i.alias("at"), F.lit(n).alias("n"), F.lit(None).cast("array<string>").alias("values"), F.lit(False).alias("raw")))
            held = F.transform(starts, lambda i: F.struct(i.alias("at"), F.filter(F.slice(parts["v"], i + 1, n), lambda v: v.isNotNull()).alias("values")))
            slots = F.transform(held, lambda x: F.when(F.size(x["values"]) * 2 <= n, F.struct(
                F.xxhash64(F.slice(parts["t"], x["at"] + 1, n)).alias("h"), x["at"].alias("at"), F.lit(n).alias("n"), x["values"].alias("values"), F.lit(False).alias("raw"))).otherwise(F.struct(
                    F.xxhash64(F.lit("raw"), F.slice(parts["raw"], x["at"] + 1, n)).alias("h"), x["at"].alias("at"), F.lit(n).alias("n"),
                    F.array().cast("array<string>").alias("values"), F.lit(True).alias("raw"))))
            return F.when(F.size(parts["t"]) < n, F.array().cast("array<struct<h: bigint, at: int, n: int, values: array<string>, raw: boolean>>")).when(
                F.exists(parts["v"], lambda v: v.isNotNull()), slots).otherwise(plain)

        return F.concat(*[cut(n) for n in lengths])

    return let(made, lambda m: let(F.struct(m["t"].alias("t"), m["v"].alias("v"), m["raw"].alias("raw")), of))


def hashes(made: Column, lengths: list[int], raw: bool) -> Column:
    """Array of the h that ``windows`` may give, of all windows; those of raw tokens on demand."""

    def of(parts: Column) -> Column:
        def cut(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.size(parts["t"]) - n + 1)
            out = F.transform(starts, lambda i: F.xxhash64(F.slice(parts["t"], i, n)))
            if raw:
                out = F.concat(out, F.transform(starts, lambda i: F.xxhash64(F.lit("raw"), F.slice(parts["raw"], i, n))))
            return F.when(F.size(parts["t"]) < n, F.array().cast("array<bigint>")).otherwise(out)

        return F.concat(*[cut(n) for n in lengths])

    return let(made, lambda m: let(F.struct(m["t"].alias("t"), m["raw"].alias("raw")), of))


def both_templates(text: Column, made_of) -> Column:
    """What ``made_of`` makes of the plain template and, where it may differ, of the one with names."""
    plain = let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: made_of(template(t, False)))
    marked = let(F.regexp_extract_all(text, F.lit(TOKEN_OR_STOP), F.lit(0)), lambda t: made_of(template(t, True)))
    return F.when(text.rlike(CAPITAL_INSIDE), F.concat(plain, marked)).otherwise(plain)


def counted(met: Column) -> Column:
    """The windows (at, n, pairs) of one alignment that count as hits."""

    def of(parts: Column) -> Column:
        return F.filter(parts["met"], lambda m: (m["n"] >= LEAST_TOKENS) & ~F.arrays_overlap(m["pairs"]["item"], parts["unclear"]) | is_copy(m))

    def is_copy(m: Column) -> Column:
        return F.forall(m["pairs"], lambda p: p["item"] == p["own"])

    def with_unclear(pairs: Column) -> Column:  # sorted by the item's value
        return F.filter(F.transform(pairs, lambda p, i: F.when(F.get(pairs, i - 1)["item"] == p["item"], p["item"])), lambda v: v.isNotNull())

    pairs = let(F.array_sort(F.array_distinct(F.flatten(F.transform(met, lambda m: m["pairs"])))), with_unclear)
    return let(F.struct(met.alias("met"), pairs.alias("unclear")), of)


def few(keys: DataFrame) -> DataFrame:
    """Keys of texts, to be broadcast if they are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def hits(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text",
         item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key_id, key_text, item_ids, covered, short_item_ids): the rows that hold benchmark
    items, the items and the most tokens of one item found on one alignment (null if only
    items of fewer than LEAST_TOKENS tokens are there), and the latter items."""
    stages = Stages(docs.sparkSession, "benchmark")
    items = benchmark.select(benchmark[item].alias("item_id"), text_of(benchmark[item_text].cast("string")).alias("text"))
    sizes = items.select(F.size(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("n"))
    short = [r["n"] for r in sizes.where((F.col("n") > 0) & (F.col("n") < window)).distinct().collect()]  # fewer than WINDOW values
    lengths = [*sorted(short), window]
    long_enough = F.size(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))
    asked = (items.withColumn("size", long_enough).select("item_id", "size", F.explode(both_templates(F.col("text"), lambda m: windows(m, lengths))).alias("w"))
             .select("item_id", "w.*", "size").where(F.col("n") == F.least("size", F.lit(window)))
             .select("h", "item_id", F.col("at").alias("item_at"), F.col("values").alias("item_values"), "n", "raw").distinct())
    asked = stages.put("asked", asked)
    n_asked, raw = asked.agg(F.count(F.lit(1)), F.coalesce(F.bool_or("raw"), F.lit(False))).first()
    sent = F.broadcast if n_asked <= BROADCAST_WINDOWS else (lambda df: df)
    source = docs.select(docs[ident].alias("doc_id"), text_of(docs[text].cast("string")).alias("text")).select(*row_key(), "text")
    said = source.select("key_id", "key_text", F.explode(both_templates(F.col("text"), lambda m: hashes(m, lengths, raw))).alias("h"))
    holding = stages.put("holding", said.join(sent(asked.select("h").distinct()), "h", "left_semi").select("key_id", "key_text").distinct())
    shown = source.join(few(holding), ["key_id", "key_text"], "left_semi").select(
        "key_id", "key_text", F.explode(both_templates(F.col("text"), lambda m: windows(m, lengths))).alias("w")).select(
        "key_id", "key_text", F.col("w.h").alias("h"), F.col("w.at").alias("at"), F.col("w.values").alias("values"))
    met = stages.put("met", shown.join(sent(asked.drop("raw")), "h").select("key_id", "key_text", "item_id", "n", (F.col("at") - F.col("item_at")).alias("shift"), "at",
                     F.arrays_zip(F.coalesce("item_values", F.array().cast("array<string>")).alias("item"), F.coalesce("values", F.array().cast("array<string>")).alias("own")).alias("pairs")).distinct())
    # Windows of one alignment; a template with and one without capitals may both be there.
    runs = met.groupBy("key_id", "key_text", "item_id", "shift").agg(F.collect_list(F.struct("at", "n", "pairs")).alias("met"))
    runs = runs.withColumn("met", counted(F.col("met"))).where(F.size("met") > 0).select(
        "key_id", "key_text", "item_id", (F.array_max(F.col("met.n")) >= LEAST_TOKENS).alias("enough"), (F.array_max(F.transform("met", lambda m: m["at"] + m["n"])) - F.array_min(F.col("met.at"))).alias("covered"))
    return runs.groupBy("key_id", "key_text").agg(
        F.array_sort(F.collect_set(F.when(F.col("enough"), F.col("item_id")))).alias("item_ids"), F.max(F.when(F.col("enough"), F.col("covered"))).alias("covered"),
        F.array_sort(F.collect_set(F.when(~F.col("enough"), F.col("item_id")))).alias("short_item_ids"))


def judge(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text", **named) -> DataFrame:
    """Per row: id, contaminated, item_ids, covered (0 if clean) and short_item_ids."""
    rows = docs.select(docs[ident].alias("doc_id"), docs[text].cast("string").alias("text")).select("doc_id", *row_key())
    found = hits(docs, benchmark, ident, text, **named)
    out = rows.join(found, ["key_id", "key_text"], "left")
    no_items = F.array().cast(found.schema["item_ids"].dataType)
    return out.select(F.col("doc_id").alias(ident), F.col("covered").isNotNull().alias("contaminated"),
                      F.coalesce("item_ids", no_items).alias("item_ids"), F.coalesce("covered", F.lit(0)).cast("long").alias("covered"),
                      F.coalesce("short_item_ids", no_items).alias("short_item_ids"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text", **named) -> DataFrame:
    """The rows without benchmark items, with all their columns as they came."""
    found = Stages(docs.sparkSession, "leaks").put("found", hits(docs, benchmark, ident, text, **named).where("covered IS NOT NULL").select("key_id", "key_text"))
    rows = docs.select(F.struct("*").alias("row"), *row_key(ident, text))
    return rows.join(few(found), ["key_id", "key_text"], "left_anti").select("row.*")
