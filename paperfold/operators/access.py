"""Who may read which collection: affiliation, membership, access state, catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.functions.metadata import has_key, typed_value
from paperfold.functions.text import display_name, email_domain, normalize_email


MOST_COLLECTIONS = 100_000  # broadcast up to this count


def domain_matches(emails: DataFrame, rules: DataFrame) -> DataFrame:
    """(email, community_id, domain, match_mode) of active rules that match.

    exact: the domain equals the rule; suffix: it equals it or ends with '.rule'. Each
    domain is exploded into its own dot suffixes, so the theta join becomes an equi
    join: no cross product, a few rows per address.
    """
    parts = F.split(F.col("_domain"), r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
    tails = (
        emails.withColumn("_domain", email_domain("email"))
        .filter(F.col("_domain").isNotNull())
        .withColumn("_tail", F.explode(suffixes))
    )
    active = rules.filter("is_active").select("community_id", "domain", "match_mode")
    return tails.join(active, F.col("_tail") == F.col("domain")).filter(
        (F.col("match_mode") == "suffix") | (F.col("_tail") == F.col("_domain"))
    ).select("email", "community_id", "domain", "match_mode").distinct()


def active_overrides(overrides: DataFrame, as_of: Column | None = None) -> DataFrame:
    now = as_of if as_of is not None else F.current_timestamp()
    return overrides.filter(
        F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    ).select("email", F.col("community_id").alias("override_community"))


def affiliations(emails: DataFrame, rules: DataFrame, overrides: DataFrame,
                 as_of: Column | None = None) -> DataFrame:
    """email -> community_id or deny_reason: a live override wins, then the rules."""
    wanted = emails.select(normalize_email("email").alias("email")).filter(
        F.col("email").isNotNull()
    ).distinct()
    matched = domain_matches(wanted, rules).groupBy("email").agg(
        F.min("community_id").alias("low"), F.max("community_id").alias("high")
    )
    df = wanted.join(active_overrides(overrides, as_of), "email", "left").join(
        matched, "email", "left"
    )
    one = F.col("low") == F.col("high")
    return df.select(
        "email",
        F.coalesce("override_community", F.when(one, F.col("low"))).alias("community_id"),
        F.when(F.col("override_community").isNotNull(), F.lit(None).cast("string"))
        .when(F.col("low").isNull(), "unsupported_email_domain")
        .when(~one, "ambiguous_email_domain").alias("deny_reason"),
    )


def active_memberships(memberships: DataFrame) -> DataFrame:
    return memberships.filter(F.col("status") == "active").select(
        "user_id", "community_id"
    ).distinct()


def access_states(requests: DataFrame, collections: DataFrame, communities: DataFrame,
                  memberships: DataFrame) -> DataFrame:
    """Access state and lock reason of each (user, collection) request.

    requests: collection, user_id (NULL = anonymous), affiliation_community_id.
    Equi joins on collection and on (user, community). Collections are counted and broadcast if
    they are at most MOST_COLLECTIONS, so a popular one doesn't put its requests in one task.
    """
    few = collections.limit(MOST_COLLECTIONS + 1).count() <= MOST_COLLECTIONS
    dims = collections.select(
        F.col("name").alias("collection"), F.col("community_id").alias("collection_community")
    ).join(
        communities.select(
            F.col("id").alias("collection_community"), F.col("name").alias("community_name")
        ),
        "collection_community", "left",
    )
    member = active_memberships(memberships).select(
        "user_id", F.col("community_id").alias("collection_community"),
        F.lit(True).alias("is_member"),
    )
    df = requests.join(F.broadcast(dims) if few else dims, "collection").join(
        member, ["user_id", "collection_community"], "left"
    )
    return df.withColumn("access_state", state_of()).withColumn("lock_reason", lock_reason())


def state_of() -> Column:
    community = F.col("collection_community")
    affiliation = F.col("affiliation_community_id")
    return (
        F.when(community.isNull(), "accessible")
        .when(F.col("user_id").isNull(), "locked_requires_signin")
        .when(affiliation.isNotNull() & (affiliation != community), "locked_wrong_affiliation")
        .when(F.col("is_member"), "accessible")
        .otherwise("locked_wrong_affiliation")
    )


def lock_reason() -> Column:
    state = F.col("access_state")
    named = F.concat(
        F.lit("This collection is restricted to "), F.col("community_name"), F.lit(" members")
    )
    return F.when(state == "locked_requires_signin", "Sign in to access this collection").when(
        state == "locked_wrong_affiliation",
        F.when(F.coalesce(F.col("community_name"), F.lit("")) != "", named).otherwise(
            "This collection is restricted to members of this community"
        ),
    )


def authorize(requests: DataFrame, collections: DataFrame, communities: DataFrame,
              memberships: DataFrame) -> DataFrame:
    """Boolean form of the access state per request."""
    return access_states(requests, collections, communities, memberships).withColumn(
        "allowed", F.col("access_state") == "accessible"
    )


def paper_counts(papers: DataFrame) -> DataFrame:
    return papers.groupBy("collection").agg(F.count(F.lit(1)).alias("paper_count"))


def year_ranges(chunks: DataFrame) -> DataFrame:
    """Lowest and highest year over chunks whose metadata has the key."""
    year = typed_value("metadata", "year", "integer")
    return chunks.filter(has_key("metadata", "year")).groupBy("collection").agg(
        F.min(year).alias("year_start"), F.max(year).alias("year_end")
    )


def catalogue(collections: DataFrame, communities: DataFrame, papers: DataFrame,
              chunks: DataFrame) -> DataFrame:
    """Collections with community name, paper count and year range. Facts are
    aggregated before the join."""
    named = communities.select(
        F.col("id").alias("community_id"), F.col("name").alias("community_name")
    )
    df = collections.join(named, "community_id", "left")
    df = df.join(paper_counts(papers).withColumnRenamed("collection", "name"), "name", "left")
    df = df.join(year_ranges(chunks).withColumnRenamed("collection", "name"), "name", "left")
    return df.withColumn("paper_count", F.coalesce("paper_count", F.lit(0))).withColumn(
        "display_name", F.coalesce("display_name", display_name("name"))
    )


def list_collections(listing: DataFrame, communities: DataFrame, memberships: DataFrame,
                     user_id: str | None, affiliation: str | None) -> DataFrame:
    """The catalogue as one viewer sees it: accessible first, then by name; the
    metadata schema is hidden unless accessible."""
    requests = listing.select(
        F.col("name").alias("collection"),
        F.lit(user_id).cast("string").alias("user_id"),
        F.lit(affiliation).cast("string").alias("affiliation_community_id"),
    )
    states = access_states(
        requests, listing.select("name", "community_id"), communities, memberships
    ).select(F.col("collection").alias("name"), "access_state", "lock_reason")
    df = listing.join(states, "name").withColumn(
        "metadata_schema",
        F.when(F.col("access_state") == "accessible", F.col("metadata_schema")),
    )
    return df.orderBy(
        F.when(F.col("access_state") == "accessible", 0).otherwise(1), F.col("name")
    )


def supported_universities(communities: DataFrame, rules: DataFrame) -> DataFrame:
    """Community and its active domains, both ordered by name."""
    rows = rules.filter("is_active").join(
        communities.select(F.col("id").alias("community_id"), "name"), "community_id"
    )
    return rows.groupBy("community_id", "name").agg(
        F.array_sort(F.collect_list("domain")).alias("email_domains")
    ).orderBy("name")


def resolve_identities(logins: DataFrame, users: DataFrame, identities: DataFrame,
                       local_provider: str = "stub-email") -> DataFrame:
    """Resolve a batch of logins to users; conflicts and unverified ones are rejected.

    logins: provider, external_subject, email, email_verified. Order: known identity,
    then verified e-mail, else a new user. Adds user_id (existing), action, reason.
    """
    clean = logins.withColumn("email", normalize_email("email"))
    by_subject = identities.select(
        "provider", "external_subject", F.col("user_id").alias("identity_user")
    )
    by_email = users.select("email", F.col("id").alias("email_user"))
    df = clean.join(by_subject, ["provider", "external_subject"], "left").join(
        by_email, "email", "left"
    )
    external = F.col("provider") != local_provider
    df = df.withColumn("user_id", F.coalesce(
        "identity_user", F.when(~external | F.col("email_verified"), F.col("email_user"))
    ))
    linked = identities.select(
        F.col("user_id").alias("user_id"), F.col("provider").alias("_p"),
        F.col("external_subject").alias("_s"),
    )
    conflict = df.filter(F.col("user_id").isNotNull()).join(linked, "user_id").filter(
        (F.col("_p") == F.col("provider")) & (F.col("_s") != F.col("external_subject"))
    ).select("provider", "external_subject", "email", F.lit(True).alias("_conflict")).distinct()
    df = df.join(conflict, ["provider", "external_subject", "email"], "left")
    reason = (
        F.when(F.col("email").isNull(), "email_missing")
        .when(external & ~F.col("email_verified"), "email_not_verified")
        .when(F.col("_conflict"), "identity_collision")
    )
    df = df.withColumn("reason", reason)
    return df.withColumn("action", (
        F.when(F.col("reason").isNotNull(), "reject")
        .when(F.col("identity_user").isNotNull(), "known")
        .when(F.col("user_id").isNotNull(), "link")
        .otherwise("create")
    )).drop("identity_user", "email_user", "_conflict")
