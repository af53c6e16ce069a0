"""Queries over communities, users, memberships and the collection catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperfold.catalog import bridge as b
from paperfold.catalog.bridge import with_ctes
from paperfold.catalog.registry import query
from paperfold.operators import access as A
from paperfold.operators import upsert as U
from paperfold.operators import viewers as V
from paperfold.operators.identity import upsert_identities
from paperfold.plans import search as S


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.users(spark, sf_dir).select("email")


def affiliation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.affiliations(
        emails(spark, sf_dir), b.domain_rules(spark, sf_dir), b.overrides(spark, sf_dir), b.as_of()
    )


def identified_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the affiliation of their user."""
    aff = b.users(spark, sf_dir).join(affiliation_table(spark, sf_dir), "email").select(
        F.col("id").alias("user_id"), F.col("community_id").alias("affiliation_community_id")
    )
    return b.requests(spark, sf_dir).join(aff, "user_id", "left")


@query("domain_matches", with_ctes("acc", body="""
SELECT DISTINCT u.email, r.community_id, r.domain, r.match_mode FROM users u JOIN rules r
ON r.is_active AND (split_part(u.email, '@', 2) = r.domain OR (r.match_mode = 'suffix'
  AND ends_with(split_part(u.email, '@', 2), '.' || r.domain)))"""))
def domain_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.domain_matches(emails(spark, sf_dir), b.domain_rules(spark, sf_dir))


@query("email_affiliations", with_ctes("acc", body="SELECT email, community_id, deny_reason FROM aff"))
def email_affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affiliation_table(spark, sf_dir)


@query("access_states", with_ctes("acc", body="""
SELECT event_id, access_state, CASE access_state
  WHEN 'locked_requires_signin' THEN 'Sign in to access this collection'
  WHEN 'locked_wrong_affiliation'
    THEN 'This collection is restricted to ' || community_name || ' members' END AS lock_reason
FROM states"""))
def access_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.access_states(
        identified_requests(spark, sf_dir), b.collections(spark, sf_dir),
        b.communities(spark, sf_dir), b.memberships(spark, sf_dir),
    ).select("event_id", "access_state", "lock_reason")


@query("authorized_requests", with_ctes("acc", body="""
SELECT collection, count(*) AS requests, count(*) FILTER (WHERE access_state = 'accessible') AS allowed
FROM states GROUP BY collection"""))
def authorized_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = A.authorize(
        identified_requests(spark, sf_dir), b.collections(spark, sf_dir),
        b.communities(spark, sf_dir), b.memberships(spark, sf_dir),
    )
    return decided.groupBy("collection").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("allowed").alias("allowed")
    )


@query("restricted_queries", with_ctes("acc", body="""
SELECT event_id, user_id, collection FROM states
WHERE access_state = 'accessible' AND user_id IS NOT NULL"""))
def restricted_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only queries whose user may read the collection go on to the search."""
    asked = identified_requests(spark, sf_dir)
    allowed = A.authorize(
        asked, b.collections(spark, sf_dir), b.communities(spark, sf_dir),
        b.memberships(spark, sf_dir),
    ).filter("allowed")
    return S.authorized_only(asked, allowed).select("event_id", "user_id", "collection")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents")
    papers = docs.select(F.col("source").alias("collection"), "lang").distinct()
    chunks = b.stored_chunks(spark, sf_dir).withColumn("collection", F.col("source"))
    colls = b.collections(spark, sf_dir).withColumn("metadata_schema", F.lit("{}")).withColumn(
        "display_name", F.when(F.col("name") == "src3", "Third")
    )
    return A.catalogue(colls, b.communities(spark, sf_dir), papers, chunks)


CATALOGUE_SQL = """facts AS (
  SELECT c.name, c.community_id, co.name AS community_name, p.n AS paper_count, y.lo, y.hi,
    CASE WHEN c.name = 'src3' THEN 'Third' ELSE upper(c.name[1]) || c.name[2:] END AS display_name
  FROM colls c LEFT JOIN communities co ON co.id = c.community_id
  LEFT JOIN (SELECT source, count(DISTINCT lang) AS n FROM documents GROUP BY source) p
    ON p.source = c.name
  LEFT JOIN (SELECT source, min(2000 + doc_id % 25) AS lo, max(2000 + doc_id % 25) AS hi
             FROM documents GROUP BY source) y ON y.source = c.name)"""


@query("collection_catalogue", with_ctes("acc", then=CATALOGUE_SQL, body="""
SELECT name, community_id, community_name, display_name, paper_count, CAST(lo AS INTEGER) AS year_start,
       CAST(hi AS INTEGER) AS year_end FROM facts"""))
def collection_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select(
        "name", "community_id", "community_name", "display_name", "paper_count",
        "year_start", "year_end",
    )


@query("viewer_listing", with_ctes("acc", then=CATALOGUE_SQL, body="""
SELECT name, display_name, paper_count, CASE
    WHEN community_id IS NULL THEN 'accessible'
    WHEN community_id = 'c7' AND EXISTS (SELECT 1 FROM memberships
      WHERE user_id = 'u7' AND community_id = 'c7' AND status = 'active') THEN 'accessible'
    ELSE 'locked_wrong_affiliation' END AS access_state,
  CASE WHEN community_id IS NULL OR (community_id = 'c7' AND EXISTS (SELECT 1 FROM memberships
      WHERE user_id = 'u7' AND community_id = 'c7' AND status = 'active')) THEN '{}' END
    AS metadata_schema
FROM facts"""))
def viewer_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.list_collections(
        listing(spark, sf_dir), b.communities(spark, sf_dir), b.memberships(spark, sf_dir),
        "u7", "c7",
    ).select("name", "display_name", "paper_count", "access_state", "metadata_schema")


@query("supported_universities", with_ctes("acc", body="""
SELECT c.id AS community_id, c.name, string_agg(r.domain, ',' ORDER BY r.domain) AS domains
FROM communities c JOIN rules r ON r.community_id = c.id AND r.is_active GROUP BY c.id, c.name"""))
def supported_universities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.supported_universities(
        b.communities(spark, sf_dir), b.domain_rules(spark, sf_dir)
    ).select("community_id", "name", F.array_join("email_domains", ",").alias("domains"))


IDENT_SQL = """idents AS (
  SELECT 'u' || c_custkey AS user_id, 'oidc' AS provider, 's' || c_custkey AS subject
  FROM customer WHERE c_custkey % 2 = 0),
logins AS (
  SELECT o_orderkey, 'oidc' AS provider,
    CASE WHEN o_orderkey % 10 = 1 THEN 'x' || o_orderkey ELSE 's' || o_custkey END AS subject,
    CASE WHEN o_orderkey % 10 = 2 THEN 'new' || o_orderkey || '@mail.org' ELSE u.email END AS email,
    o_orderkey % 10 <> 3 AS email_verified
  FROM orders JOIN users u ON u.id = 'u' || o_custkey),
res AS (
  SELECT l.*, i.user_id AS by_subject, u.id AS by_email,
    coalesce(i.user_id, CASE WHEN l.email_verified THEN u.id END) AS user_id
  FROM logins l LEFT JOIN idents i ON i.provider = l.provider AND i.subject = l.subject
  LEFT JOIN users u ON u.email = l.email)"""


@query("identity_resolution", with_ctes("acc", then=IDENT_SQL, body="""
SELECT o_orderkey, user_id, CASE WHEN NOT email_verified THEN 'email_not_verified'
    WHEN EXISTS (SELECT 1 FROM idents k WHERE k.user_id = res.user_id AND k.provider = res.provider
                 AND k.subject <> res.subject) THEN 'identity_collision' END AS reason,
  CASE WHEN NOT email_verified OR EXISTS (SELECT 1 FROM idents k WHERE k.user_id = res.user_id
          AND k.provider = res.provider AND k.subject <> res.subject) THEN 'reject'
       WHEN by_subject IS NOT NULL THEN 'known' WHEN user_id IS NOT NULL THEN 'link'
       ELSE 'create' END AS action
FROM res"""))
def identity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    people = b.users(spark, sf_dir)
    idents = b.table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 2 == 0).select(
        F.concat(F.lit("u"), F.col("c_custkey")).alias("user_id"), F.lit("oidc").alias("provider"),
        F.concat(F.lit("s"), F.col("c_custkey")).alias("external_subject"),
    )
    logins = b.table(spark, sf_dir, "orders").withColumn(
        "id", F.concat(F.lit("u"), F.col("o_custkey"))
    ).join(people, "id").select(
        "o_orderkey", F.lit("oidc").alias("provider"),
        F.when(k % 10 == 1, F.concat(F.lit("x"), k))
        .otherwise(F.concat(F.lit("s"), F.col("o_custkey"))).alias("external_subject"),
        F.when(k % 10 == 2, F.concat(F.lit("new"), k, F.lit("@mail.org")))
        .otherwise(F.col("email")).alias("email"),
        (k % 10 != 3).alias("email_verified"),
    )
    return A.resolve_identities(logins, people, idents).select(
        "o_orderkey", "user_id", "reason", "action"
    )


@query("membership_upsert", with_ctes("acc", body="""
SELECT coalesce(m.user_id, p.user_id) AS user_id, coalesce(m.community_id, p.community_id) AS community_id,
  CASE WHEN p.user_id IS NOT NULL THEN 'active' ELSE m.status END AS status
FROM memberships m FULL OUTER JOIN
  (SELECT u.id AS user_id, a.community_id FROM users u JOIN aff a ON a.email = u.email
   WHERE a.community_id IS NOT NULL) p
ON p.user_id = m.user_id AND p.community_id = m.community_id"""))
def membership_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = b.users(spark, sf_dir).join(affiliation_table(spark, sf_dir), "email").filter(
        F.col("community_id").isNotNull()
    ).select(F.col("id").alias("user_id"), "community_id")
    return U.ensure_memberships(b.memberships(spark, sf_dir), pairs).select(
        "user_id", "community_id", "status"
    )


@query("domain_rule_upsert", with_ctes("acc", body="""
SELECT community_id, domain, CASE WHEN domain LIKE 'cs.%' THEN match_mode ELSE 'suffix' END
  AS match_mode, CASE WHEN domain LIKE 'cs.%' THEN is_active ELSE TRUE END AS is_active FROM rules
UNION ALL SELECT id, 'alumni.' || lower(name) || '.edu', 'suffix', TRUE FROM communities"""))
def domain_rule_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = b.communities(spark, sf_dir).select(
        F.col("id").alias("community_id"),
        F.explode(F.array(
            F.concat(F.lower("name"), F.lit(".edu")),
            F.concat(F.lit("alumni."), F.lower("name"), F.lit(".edu")),
        )).alias("domain"),
        F.lit("suffix").alias("match_mode"), F.lit(True).alias("is_active"),
    )
    return U.upsert_domain_rules(b.domain_rules(spark, sf_dir), seed)


def all_viewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer, and someone who isn't signed in."""
    signed = b.users(spark, sf_dir).join(affiliation_table(spark, sf_dir), "email").select(
        F.col("id").alias("user_id"), F.col("community_id").alias("affiliation_community_id"))
    nobody = spark.range(1).select(F.lit(None).cast("string").alias("user_id"), F.lit(None).cast("string").alias("affiliation_community_id"))
    return signed.unionByName(nobody)


@query("viewer_listings", with_ctes("acc", body="""
SELECT v.user_id, string_agg(CASE WHEN ok THEN v.name END, ',' ORDER BY v.name) AS accessible, count(*) FILTER (WHERE NOT ok) AS locked,
  CASE WHEN v.user_id IS NULL THEN 'locked_requires_signin' ELSE 'locked_wrong_affiliation' END AS locked_state
FROM (SELECT u.id AS user_id, c.name, c.community_id IS NULL OR (m.user_id IS NOT NULL AND (a.community_id IS NULL OR a.community_id = c.community_id)) AS ok
  FROM (SELECT id, email FROM users UNION ALL SELECT NULL, NULL) u CROSS JOIN colls c LEFT JOIN aff a ON a.email = u.email
  LEFT JOIN (SELECT DISTINCT user_id, community_id FROM memberships WHERE status = 'active') m ON m.user_id = u.id AND m.community_id = c.community_id) v
GROUP BY v.user_id"""))
def viewer_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every customer may read, by classes of viewers."""
    collections = b.collections(spark, sf_dir)
    viewers, classes = V.viewer_classes(all_viewers(spark, sf_dir), b.memberships(spark, sf_dir), collections)
    listings = V.class_listings(classes, collections)
    return viewers.join(listings, "class_id").select("user_id", F.nullif(F.array_join("accessible", ","), F.lit("")).alias("accessible"), "locked", "locked_state")


@query("class_restricted_queries", with_ctes("acc", body="SELECT event_id, user_id, collection FROM states WHERE access_state = 'accessible'"))
def class_restricted_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that may run, decided once per class of viewers."""
    collections = b.collections(spark, sf_dir)
    viewers, classes = V.viewer_classes(all_viewers(spark, sf_dir), b.memberships(spark, sf_dir), collections)
    queries = b.requests(spark, sf_dir).select("event_id", "user_id", "collection").join(collections.select(F.col("name").alias("collection")), "collection", "left_semi")
    return V.allowed_queries(queries.select("event_id", "user_id", "collection"), viewers, V.readable(classes, collections), V.open_to_all(collections))


UPSERT_SQL = """WITH RECURSIVE seq AS (
  SELECT o_orderkey AS seq, o_custkey // 3 AS g, row_number() OVER (PARTITION BY o_custkey // 3 ORDER BY o_orderkey) AS rn,
    CASE WHEN o_orderkey % 4 = 0 THEN 'stub_header' ELSE 'oidc' END AS p,
    CASE WHEN o_orderkey % 13 <> 5 THEN 's' || (o_custkey // 3) || '-' || (o_orderkey % 5) END AS s,
    CASE WHEN o_orderkey % 7 < 3 THEN 'a' || (o_custkey // 3) || '@x.org' WHEN o_orderkey % 7 < 5 THEN 'b' || (o_custkey // 3) || '@x.org'
         WHEN o_orderkey % 7 = 5 THEN 'c' || (o_custkey // 3) || '@x.org' END AS e, o_orderkey % 11 <> 3 AS v
  FROM orders),
groups AS (SELECT DISTINCT o_custkey // 3 AS g FROM orders),
run AS (
  SELECT g, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CASE WHEN g % 2 = 0 THEN ['a' || g || '@x.org'] ELSE CAST([] AS VARCHAR[]) END AS people,
    CASE WHEN g % 8 = 0 THEN [{'p': 'oidc', 's': 's' || g || '-1', 'e': 'a' || g || '@x.org'}, {'p': 'oidc', 's': 's' || g || '-2', 'e': 'a' || g || '@x.org'}]
         WHEN g % 4 = 0 THEN [{'p': 'oidc', 's': 's' || g || '-1', 'e': 'a' || g || '@x.org'}]
         ELSE CAST([] AS STRUCT(p VARCHAR, s VARCHAR, e VARCHAR)[]) END AS ids,
    CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS reason, FALSE AS v
  FROM groups
  UNION ALL
  SELECT g, rn, seq, CASE WHEN reason IS NULL AND NOT list_contains(people, who) THEN list_append(people, who) ELSE people END,
    CASE WHEN reason IS NULL AND own IS NULL THEN list_append(ids, {'p': p, 's': s, 'e': who}) ELSE ids END,
    CASE WHEN reason IS NULL THEN who END,
    CASE WHEN reason IS NOT NULL THEN 'reject' WHEN own IS NOT NULL THEN 'known' WHEN list_contains(people, who) THEN 'link' ELSE 'create' END, reason, v
  FROM (SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN (own IS NOT NULL OR p = 'oidc') AND len(list_filter(ids, lambda x: x.p = p AND x.e = who AND x.s <> s)) > 0
        THEN 'identity_collision' END AS reason
    FROM (SELECT *, coalesce(own, e) AS who FROM (
      SELECT q.*, r.people, r.ids, CASE WHEN q.s IS NULL THEN 'identity_incomplete' WHEN q.p = 'oidc' AND NOT q.v THEN 'email_not_verified' WHEN q.e IS NULL THEN 'email_missing' END AS bad,
        list_filter(r.ids, lambda x: x.p = q.p AND x.s = q.s)[1].e AS own
      FROM run r JOIN seq q ON q.g = r.g AND q.rn = r.rn + 1))))
"""


def upserted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """orders as logins: three customers share subjects and e-mails; some of them are stored."""
    k, g = F.col("o_orderkey"), F.floor(F.col("o_custkey") / 3)
    orders = b.table(spark, sf_dir, "orders")
    mail = lambda letter: F.concat(F.lit(letter), g, F.lit("@x.org"))
    logins = orders.select(
        k.alias("seq"), F.when(k % 4 == 0, "stub_header").otherwise("oidc").alias("provider"),
        F.when(k % 13 != 5, F.concat(F.lit("s"), g, F.lit("-"), k % 5)).alias("external_subject"),
        F.when(k % 7 < 3, mail("a")).when(k % 7 < 5, F.concat(F.lit(" B"), g, F.lit("@X.org"))).when(k % 7 == 5, mail("c")).alias("email"),
        (k % 11 != 3).alias("email_verified"))
    stored = orders.select(g.alias("g")).distinct().where("g % 2 = 0")
    g = F.col("g")
    people = stored.select(F.concat(F.lit("u"), g).alias("id"), mail("a").alias("email"), F.lit(False).alias("email_verified"))
    subjects = F.explode(F.when(g % 8 == 0, F.array(F.lit("-1"), F.lit("-2"))).otherwise(F.array(F.lit("-1"))))
    links = stored.where("g % 4 = 0").select(F.concat(F.lit("u"), g).alias("user_id"), F.lit("oidc").alias("provider"), "g", subjects.alias("x")).select(
        "user_id", "provider", F.concat(F.lit("s"), g, "x").alias("external_subject"))
    return upsert_identities(logins, people, links)


@query("identity_upsert", UPSERT_SQL + "SELECT seq, email, action, reason FROM run WHERE rn > 0")
def identity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each login of a batch comes to, as if taken one by one."""
    return upserted(spark, sf_dir)[0].select("seq", "email", "action", "reason")


@query("identity_upsert_users", UPSERT_SQL + """, last AS (SELECT people, ids FROM run r WHERE rn = (SELECT max(rn) FROM run x WHERE x.g = r.g)),
u AS (SELECT unnest(people) AS email FROM last),
i AS (SELECT i.e AS email, count(*) AS identities FROM (SELECT unnest(ids) AS i FROM last) GROUP BY 1)
SELECT u.email, coalesce(bool_or(r.v), FALSE) AS email_verified, coalesce(any_value(identities), 0) AS identities
FROM u LEFT JOIN run r ON r.email = u.email AND r.action <> 'reject' LEFT JOIN i ON i.email = u.email GROUP BY u.email""")
def identity_upsert_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and the number of their identities after the batch."""
    _, people, links = upserted(spark, sf_dir)
    n = links.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("identities"))
    return people.join(n, "id", "left").select("email", "email_verified", F.coalesce("identities", F.lit(0)).alias("identities"))
