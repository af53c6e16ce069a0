"""Declared table constraints, compiled to a few jobs over whole tables.

NOT NULL and CHECK of a table are one aggregate; all its UNIQUE keys (also partial ones) are
one grouping by (constraint, key), whose partial sums absorb a hot key; every foreign key is
one join with the parent's distinct keys. As in SQL, a CHECK holds unless it is false, and
keys with a null are neither duplicates nor orphans.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Unique:
    columns: tuple[str, ...]
    where: str = "true"


@dataclass(frozen=True)
class Foreign:
    columns: tuple[str, ...]
    parent: str
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Rules:
    not_null: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    unique: dict[str, Unique] = field(default_factory=dict)
    foreign: dict[str, Foreign] = field(default_factory=dict)


# The constraints of the stored tables.
DECLARED = {
    "users": Rules(("id", "email", "email_verified"), {"email_lowercase": "email = lower(trim(email))"},
                   {"id": Unique(("id",)), "email": Unique(("email",))}),
    "user_external_identities": Rules(("id", "user_id", "provider", "external_subject"), {},
                                      {"id": Unique(("id",)), "provider_subject": Unique(("provider", "external_subject"))},
                                      {"user": Foreign(("user_id",), "users", ("id",))}),
    "communities": Rules(("id", "name", "slug"), {}, {"id": Unique(("id",)), "name": Unique(("name",)), "slug": Unique(("slug",))}),
    "community_memberships": Rules(("id", "user_id", "community_id", "role", "status"),
                                   {"role_valid": "role IN ('member', 'admin')", "status_valid": "status IN ('active', 'inactive')"},
                                   {"id": Unique(("id",)), "user_community": Unique(("user_id", "community_id"))},
                                   {"user": Foreign(("user_id",), "users", ("id",)), "community": Foreign(("community_id",), "communities", ("id",))}),
    "community_email_domains": Rules(("id", "community_id", "domain", "match_mode", "is_active"),
                                     {"domain_lowercase": "domain = lower(trim(domain))", "match_mode_valid": "match_mode IN ('exact', 'suffix')"},
                                     {"id": Unique(("id",)), "community_domain": Unique(("community_id", "domain"))},
                                     {"community": Foreign(("community_id",), "communities", ("id",))}),
    "manual_access_overrides": Rules(("id", "email", "community_id", "is_active"), {"email_lowercase": "email = lower(trim(email))"},
                                     {"id": Unique(("id",)), "active_email": Unique(("email",), "is_active")},
                                     {"community": Foreign(("community_id",), "communities", ("id",))}),
    "collections": Rules(("id", "name", "embedding_model_id", "embedding_dimension", "metadata_schema"), {"embedding_dimension_positive": "embedding_dimension > 0"},
                         {"id": Unique(("id",)), "name": Unique(("name",))}, {"community": Foreign(("community_id",), "communities", ("id",))}),
    "papers": Rules(("id", "collection_id", "source_pdf"), {}, {"id": Unique(("id",)), "collection_source_pdf": Unique(("collection_id", "source_pdf"))},
                    {"collection": Foreign(("collection_id",), "collections", ("id",))}),
    "chunks": Rules(("id", "chunk_id", "collection_id", "paper_id", "chunk_level", "text", "source_pdf"), {},
                    {"id": Unique(("id",)), "collection_chunk_id": Unique(("collection_id", "chunk_id"))},
                    {"collection": Foreign(("collection_id",), "collections", ("id",)), "paper": Foreign(("paper_id",), "papers", ("id",))}),
    "chunk_embeddings": Rules(("chunk_id", "embedding_model_id", "embedding"), {}, {"chunk_model": Unique(("chunk_id", "embedding_model_id"))},
                              {"chunk": Foreign(("chunk_id",), "chunks", ("id",))}),
    "request_usage_logs": Rules(("id", "request_id", "endpoint", "collection_name", "outcome", "latency_ms"), {},
                                {"id": Unique(("id",)), "request_id": Unique(("request_id",))}, {"user": Foreign(("app_user_id",), "users", ("id",))}),
}


def row_failures(name: str, df: DataFrame, rules: Rules) -> DataFrame:
    """(table, kind, constraint, violations) of NOT NULL and CHECK: one pass, one row."""
    counts = {("not_null", c): F.count_if(F.col(c).isNull()) for c in rules.not_null}
    counts |= {("check", c): F.count_if(~F.coalesce(F.expr(e), F.lit(True))) for c, e in rules.checks.items()}
    summed = df.agg(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("constraint"), n.alias("violations")) for (kind, c), n in counts.items()]).alias("found"))
    return summed.select(F.lit(name).alias("table"), F.inline("found"))


def duplicate_keys(name: str, df: DataFrame, rules: Rules) -> DataFrame:
    """How many rows of each UNIQUE key are too many; all keys of the table in one shuffle."""
    def key(c: str, u: Unique):
        whole = reduce(lambda a, x: a & x, [F.col(x).isNotNull() for x in u.columns], F.coalesce(F.expr(u.where), F.lit(False)))
        return F.when(whole, F.struct(F.lit(c).alias("constraint"), F.to_json(F.struct(*u.columns)).alias("key")))

    keys = df.select(F.explode(F.array_compact(F.array(*[key(c, u) for c, u in rules.unique.items()]))).alias("k"))
    extra = keys.groupBy("k").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0").groupBy("k.constraint").agg(F.sum("n").alias("n"))
    named = df.sparkSession.createDataFrame([(c,) for c in rules.unique], "constraint string")
    return named.join(extra, "constraint", "left").select(F.lit(name).alias("table"), F.lit("unique").alias("kind"), "constraint", F.coalesce("n", F.lit(0)).alias("violations"))


def orphan_rows(name: str, constraint: str, df: DataFrame, foreign: Foreign, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows whose parent is missing, counted by key before the join."""
    whole = reduce(lambda a, x: a & x, [F.col(c).isNotNull() for c in foreign.columns])
    asked = df.where(whole).groupBy(*[F.col(c).alias(f"_{i}") for i, c in enumerate(foreign.columns)]).agg(F.count(F.lit(1)).alias("n"))
    there = tables[foreign.parent].select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(foreign.keys)]).distinct()
    lost = asked.join(there, [f"_{i}" for i in range(len(foreign.keys))], "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
    return lost.select(F.lit(name).alias("table"), F.lit("foreign").alias("kind"), F.lit(constraint).alias("constraint"), "violations")


def violations(tables: dict[str, DataFrame], declared: dict[str, Rules] = DECLARED) -> DataFrame:
    """(table, kind, constraint, violations) of every declared constraint, 0 where it holds."""
    parts = []
    for name, df in tables.items():
        rules = declared[name]
        parts += [row_failures(name, df, rules)] if rules.not_null or rules.checks else []
        parts += [duplicate_keys(name, df, rules)] if rules.unique else []
        parts += [orphan_rows(name, c, df, f, tables) for c, f in rules.foreign.items()]
    return reduce(DataFrame.unionByName, parts)


def as_sql(declared: dict[str, Rules] = DECLARED) -> str:
    """The same constraints as plain SQL over tables of these names, one statement each."""
    out = []
    for table, rules in declared.items():
        def one(kind: str, constraint: str, count: str, table=table) -> str:
            return f"SELECT '{table}' AS \"table\", '{kind}' AS kind, '{constraint}' AS \"constraint\", CAST(({count}) AS BIGINT) AS violations"

        out += [one("not_null", c, f"SELECT count(*) FROM {table} WHERE {c} IS NULL") for c in rules.not_null]
        out += [one("check", c, f"SELECT count(*) FROM {table} WHERE NOT ({e})") for c, e in rules.checks.items()]
        for c, u in rules.unique.items():
            known = " AND ".join(f"{x} IS NOT NULL" for x in u.columns)
            out.append(one("unique", c, f"SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {table} WHERE {u.where} AND {known} GROUP BY {', '.join(u.columns)})"))
        for c, f in rules.foreign.items():
            same = " AND ".join(f"p.{k} = c.{x}" for k, x in zip(f.keys, f.columns, strict=True))
            known = " AND ".join(f"c.{x} IS NOT NULL" for x in f.columns)
            out.append(one("foreign", c, f"SELECT count(*) FROM {table} c WHERE {known} AND NOT EXISTS (SELECT 1 FROM {f.parent} p WHERE {same})"))
    return "\nUNION ALL ".join(out)
