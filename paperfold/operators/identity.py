"""Upsert of identities: one batch of logins, with the outcome of taking them one by one.

A user is its e-mail; an identity (provider, subject) belongs to one user. Of an external
provider, a user has at most one subject. Which login attaches a subject to which e-mail is a
greedy choice in the order of the logins: an edge (subject, e-mail) is taken when both its
ends are still free. That is found in rounds: the edges that come first at both their ends
are taken, whatever shares an end with them is dropped. Everything else follows by joins from
the times of attachment, so repeated logins of one subject or e-mail only meet as aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.functions.text import normalize_email
from paperfold.session import materialise

LOCAL_PROVIDER = "stub_header"
BY = ["provider", "external_subject"]


def checked(logins: DataFrame, local: str) -> DataFrame:
    """Logins with a normalised e-mail and the reason that refuses them by themselves."""
    df = logins.withColumn("email", normalize_email("email"))
    external = F.col("provider") != local
    return df.withColumn("external", external).withColumn("reason", (
        F.when(F.col("provider").isNull() | F.col("external_subject").isNull(), "identity_incomplete")
        .when(external & ~F.coalesce("email_verified", F.lit(False)), "email_not_verified")
        .when(F.col("email").isNull(), "email_missing")))


def first_free(edges: DataFrame) -> DataFrame:
    """(provider, external_subject, email, seq): the edges that a greedy pass in the order of
    seq takes, each subject and each (provider, e-mail) once."""
    taken = None
    left = edges
    while True:
        one = left.groupBy("provider", "external_subject").agg(F.min("seq").alias("seq"))
        two = left.groupBy("provider", "email").agg(F.min("seq").alias("seq"))
        now = materialise(left.join(one, [*BY, "seq"], "left_semi").join(two, ["provider", "email", "seq"], "left_semi"), "identity-round")
        if now.isEmpty():
            return edges.limit(0) if taken is None else taken
        taken = now if taken is None else taken.unionByName(now)
        left = materialise(left.join(now.select(*BY), BY, "left_anti").join(now.select("provider", "email"), ["provider", "email"], "left_anti"), "identity-left")


def upsert_identities(logins: DataFrame, users: DataFrame, identities: DataFrame, local: str = LOCAL_PROVIDER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, users, identities) after a batch of logins.

    logins: seq (their order), provider, external_subject, email, email_verified. users: id,
    email (normalised), email_verified. identities: provider, external_subject, user_id.
    Outcomes: seq, user_id, email of the user, action (known, link, create, reject), reason.
    """
    known = identities.join(users.select(F.col("id").alias("user_id"), F.col("email").alias("user_email")), "user_id").select(*BY, "user_email")
    good = materialise(checked(logins, local), "logins")
    valid = good.where("reason IS NULL").select("seq", *BY, "email", "external")
    free = valid.join(known.select(*BY), BY, "left_anti")

    # External subjects: first edge whose ends are free; an e-mail with a stored subject of the provider never is.
    full = known.select("provider", F.col("user_email").alias("email")).distinct()
    edges = free.where("external").groupBy(*BY, "email").agg(F.min("seq").alias("seq")).join(full, ["provider", "email"], "left_anti")
    outer = first_free(materialise(edges, "identity-edges"))
    # Local subjects go to the e-mail of their first login, whoever else has it.
    inner = free.where("NOT external").groupBy(*BY).agg(F.min(F.struct("seq", "email")).alias("m")).select(*BY, "m.email", "m.seq")
    attached = materialise(outer.select(*BY, "email", "seq").unionByName(inner), "attached")

    owner = known.withColumn("at", F.lit(-1).cast("long")).unionByName(attached.select(*BY, F.col("email").alias("user_email"), F.col("seq").cast("long").alias("at")))
    crowd = owner.groupBy("provider", "user_email").agg(F.array_sort(F.collect_list("at")).alias("times")).where(F.size("times") > 1)
    second = crowd.select("provider", "user_email", F.col("times")[1].alias("second"))  # from then on the user has another subject
    owner = owner.join(second, ["provider", "user_email"], "left")

    df = good.join(owner, BY, "left").withColumn("reason", F.coalesce("reason", F.when(
        F.col("at").isNull() | (F.col("seq") < F.col("at")) | ((F.col("seq") > F.col("at")) & (F.col("seq") > F.col("second"))), "identity_collision")))
    born = attached.groupBy("email").agg(F.min("seq").alias("born")).join(users.select("email"), "email", "left_anti")
    df = df.join(born.select(F.col("email").alias("user_email"), "born"), "user_email", "left")
    accepted = F.col("reason").isNull()
    stored = users.select(F.col("email").alias("user_email"), F.col("id").alias("stored_id"))
    new_id = F.sha2(F.concat(F.lit("user\u0001"), F.col("user_email")), 256)
    outcomes = df.join(stored, "user_email", "left").select(
        "seq", F.when(accepted, F.coalesce("stored_id", new_id)).alias("user_id"), F.when(accepted, F.col("user_email")).alias("email"),
        F.when(~accepted, "reject").when(F.col("seq") > F.col("at"), "known").when(F.col("seq") == F.col("born"), "create").otherwise("link").alias("action"),
        "reason", "email_verified")
    outcomes = materialise(outcomes, "outcomes")

    sticky = outcomes.where("action <> 'reject'").groupBy("user_id", "email").agg(F.bool_or(F.coalesce("email_verified", F.lit(False))).alias("seen"))
    people = users.select("id", "email", "email_verified").join(sticky.withColumnRenamed("user_id", "id"), ["id", "email"], "full").select(
        "id", "email", (F.coalesce("email_verified", F.lit(False)) | F.coalesce("seen", F.lit(False))).alias("email_verified"))
    links = identities.select(*BY, "user_id").unionByName(
        attached.join(people.select("email", F.col("id").alias("user_id")), "email").select(*BY, "user_id"))
    return outcomes.drop("email_verified"), people, links
