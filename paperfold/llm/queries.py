"""One query an operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperfold.llm import (
    decontaminate,
    near_duplicates,
    oracles,
    packing,
    pieces,
    pii,
    quality_classifier,
    quality_rules,
    ranked,
    repeats,
    secrets,
    toxicity,
    variants,
    warc,
)
from paperfold.llm.registry import query, table


def remainder(n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


@query("op1_warc", oracles.WARC)
def op1_warc(spark, sf_dir):
    index, folder = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


@query("op3_packing")
def op3_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op5_quality_rules", oracles.quality(quality_rules.NGRAM_LIMITS, quality_rules.LINE_LIMIT, quality_rules.LINE_CHARS_LIMIT))
def op5_quality_rules(spark, sf_dir):
    return quality_rules.measure(table(spark, sf_dir, "documents"))


@query("op6_minhash", oracles.NEAR)
def op6_minhash(spark, sf_dir):
    return near_duplicates.group(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def classified(spark, sf_dir, operator, n: int, out: int):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = operator.train(docs, labels, remainder(n) != out)
    return operator.score(docs, model).select(
        "doc_id", (remainder(n) == out).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    return classified(spark, sf_dir, toxicity, 5, 0)


@query("op8_quality_classifier")
def op8_quality_classifier(spark, sf_dir):
    return classified(spark, sf_dir, quality_classifier, 3, 1)


@query("op9_suffix_repeats")
def op9_suffix_repeats(spark, sf_dir):
    out = repeats.cut_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def joined(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op2_secrets")
def op2_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("repository", F.concat_ws("/", "source", "lang"))
    found = secrets.scan(docs, repository="repository", owner="source")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    judged = lambda verdict: F.size(F.filter("spans", lambda s: s["verdict"] == verdict)).cast("long")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "owned")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        judged("live").alias("n_live"), judged("example").alias("n_example"))


@query("op4_decontaminate")
def op4_decontaminate(spark, sf_dir):
    found = decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("item_ids", "short_item_ids")})


@query("op10_pii")
def op10_pii(spark, sf_dir):
    return pii.replaced(table(spark, sf_dir, "documents"), count="n_replaced").select("doc_id", "text", "n_replaced")


@query("op11_spelling_variants", oracles.VARIANTS)
def op11_spelling_variants(spark, sf_dir):
    found = variants.group(table(spark, sf_dir, "documents"), every=31)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query("op12_ranked_search", oracles.RANKED)
def op12_ranked_search(spark, sf_dir):
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_sentencepiece")
def op13_sentencepiece(spark, sf_dir):
    encoded = pieces.encode(table(spark, sf_dir, "documents"))
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    told = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), "ids")
    return pieces.decode(told).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
