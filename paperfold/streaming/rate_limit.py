"""Sliding-window request limits.

Counter: floor(previous window's count * the share of it still covered) + this
window's count; a request is allowed while that stays below the limit, and only
allowed requests count. The state per identity is three numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paperfold.functions.keys import hmac_sha256
from paperfold.functions.text import nonempty, strip
from paperfold.session import use_state_store

# Fixed values: (limit, window seconds) per endpoint and scope.
POLICIES = {
    ("search", "user"): (60, 60),
    ("search", "ip"): (20, 60),
    ("study", "user"): (10, 3600),
    ("study", "ip"): (3, 3600),
}
UNKNOWN_CLIENT = "unknown-client"
# Two of the longest windows, and a day for requests that come late.
STATE_TTL_MS = (2 * 3600 + 86_400) * 1000


def with_identity(requests: DataFrame, secret: str) -> DataFrame:
    """scope, policy and hashed identity: user, then edge address, then host."""
    user = nonempty("user_id")
    edge, host = nonempty(strip("edge_ip")), nonempty(strip("client_host"))
    scope = F.when(user.isNotNull(), "user").otherwise("ip")
    raw = F.coalesce(user, edge, host, F.lit(UNKNOWN_CLIENT))
    return requests.select(
        "*",
        scope.alias("scope"),
        F.concat_ws(":", "endpoint", scope).alias("policy"),
        hmac_sha256(secret, raw).alias("identity"),
        F.coalesce(user, edge, host).isNull().alias("client_host_missing"),
    )


def policy_limit(policy: Column) -> Column:
    return F.coalesce(*[
        F.when(policy == f"{e}:{s}", F.lit(n)) for (e, s), (n, _) in POLICIES.items()
    ])


def policy_window(policy: Column) -> Column:
    return F.coalesce(*[
        F.when(policy == f"{e}:{s}", F.lit(w)) for (e, s), (_, w) in POLICIES.items()
    ])


def window_counts(requests: DataFrame) -> DataFrame:
    """Requests per policy, identity and window, with an over-limit flag."""
    size = policy_window(F.col("policy"))
    start = (F.floor(F.unix_timestamp("ts") / size) * size).alias("window_start")
    return requests.groupBy("policy", "identity", start).agg(
        F.count(F.lit(1)).alias("n")
    ).withColumn("over_limit", F.col("n") > policy_limit(F.col("policy")))


class SlidingWindow(StatefulProcessor):
    """Keyed by (policy, identity); one decision per request.

    All requests that a micro-batch brings for a key are put in event-time order before the
    fold, whatever Arrow batches they come in; only their ids and times are held, and the
    trigger's size bounds them. With ``expire`` the counters are dropped after the longest time they can
    matter.
    """

    def __init__(self, expire: bool = False) -> None:
        self.ttl = {"ttlDurationMs": STATE_TTL_MS} if expire else {}

    OUTPUT = (
        T.StructType().add("request_id", T.StringType()).add("policy", T.StringType())
        .add("identity", T.StringType()).add("allowed", T.BooleanType())
        .add("remaining", T.IntegerType()).add("reset_epoch", T.LongType())
        .add("retry_after", T.LongType())
    )

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counter = handle.getValueState(
            "counter", "bucket bigint, prev bigint, curr bigint, clock double", **self.ttl
        )

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        policy, identity = key
        endpoint, scope = policy.split(":")
        limit, size = POLICIES[(endpoint, scope)]
        bucket, prev, curr, clock = self.counter.get() or (-2, 0, 0, 0.0)
        # a missing time or id comes last
        ordered = sorted(((math.inf if r.epoch is None else r.epoch, r.request_id) for r in rows),
                         key=lambda r: (r[0], r[1] is None, r[1] or ""))
        for epoch, request in ordered:
            clock = max(clock, epoch) if epoch < math.inf else clock
            now = int(clock // size)
            if now != bucket:
                prev, curr = (curr if now == bucket + 1 else 0), 0
                bucket = now
            used = math.floor(prev * (1 - (clock - now * size) / size)) + curr
            allowed = used < limit
            curr += allowed
            reset = (now + 1) * size
            yield Row(
                request_id=request, policy=policy, identity=identity, allowed=allowed,
                remaining=max(0, limit - used - allowed), reset_epoch=reset,
                retry_after=0 if allowed else max(1, math.ceil(reset - clock)),
            )
        self.counter.update((bucket, prev, curr, clock))

    def close(self) -> None:
        pass


def decide(requests: DataFrame, expire: bool = False) -> DataFrame:
    """request_id, ts, policy, identity -> allowed, remaining, reset, retry-after.

    ``expire`` is for streams that run on: such state asks for batches without data, so a
    stream that should end by itself (availableNow) leaves it off.
    """
    use_state_store(requests.sparkSession)
    keyed = requests.select(
        F.col("request_id").cast("string").alias("request_id"), "policy", "identity",
        (F.unix_micros("ts") / 1e6).alias("epoch"),
    )
    return keyed.groupBy("policy", "identity").transformWithState(
        statefulProcessor=SlidingWindow(expire), outputStructType=SlidingWindow.OUTPUT,
        outputMode="Append", timeMode="ProcessingTime" if expire else "None",
    )
