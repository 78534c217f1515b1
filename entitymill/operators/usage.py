"""Usage analytics over an event log: decisions per request, ledgers, limits, cache hits and statistics."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import allow, ordered_fold

DAY = 86_400_000_000
LIMIT, WIDTH, TTL, COST = 5, DAY, DAY, 1
OWNERS = (1,)


def access(events: DataFrame) -> DataFrame:
    """Adds ``decision``: unauthorized (no valid user), owner, deny (banned) or allow."""
    u = F.col("user_id")
    owner = u.isin(*OWNERS)
    return events.withColumn("decision", F.when(u.isNull() | (u <= 0), "unauthorized").when(owner, "owner").when(u % 5 == 0, "deny").otherwise("allow"))


def rate_limit(events: DataFrame, limit: int = LIMIT, width: int = WIDTH) -> DataFrame:
    """``allowed`` of each request; one without a valid user is refused."""

    def step(log: deque, r) -> tuple:
        if r.user_id is None or r.user_id <= 0:
            return r.event_id, r.user_id, False
        return r.event_id, r.user_id, r.user_id in OWNERS or allow(log, r.us, limit, width)

    return ordered_fold(events.select("event_id", "user_id", "us"), "user_id", ["us", "event_id"], "event_id long, user_id long, allowed boolean", deque, step)


def cache_entities(looked_up: DataFrame) -> DataFrame:
    """Valid probes with the entity whose cache entries they share, their own key, and the id's key."""
    own, of = F.concat("kind", F.lit(":"), "key"), F.concat(F.lit("id:"), "id")
    return looked_up.where("outcome <> 'invalid'").select("event_id", "us", F.coalesce(of, own).alias("entity"), own.alias("own"), F.coalesce(of, F.lit("")).alias("id_key"))


def ttl_hits(looked_up: DataFrame, ttl: int = TTL) -> DataFrame:
    """Cache classification of routed probes: hit or miss; the first access opens a fixed time to live.

    A fetch by alias also restarts the id's own entry, so entries are folded by
    the id that the probe resolves to (by the probe's own key where it finds
    nothing). Invalid probes never reach the cache.
    """
    rows = cache_entities(looked_up)

    def step(open_: dict, r) -> tuple:
        hit = r.own in open_ and r.us <= open_[r.own]
        if not hit:
            open_[r.own] = r.us + ttl
            if r.id_key and r.id_key != r.own:
                open_[r.id_key] = r.us + ttl
        return r.event_id, r.own, hit

    return ordered_fold(rows, "entity", ["us", "event_id"], "event_id long, key string, cache_hit boolean", dict, step)


def ledger(events: DataFrame) -> DataFrame:
    """Ledger rows with a signed amount; null amounts and types never enter it."""
    return events.where("ledger_type is not null and amount > 0").withColumn("signed", F.when(F.col("ledger_type") == "credit", F.col("amount")).otherwise(-F.col("amount")))


#: Rows of a user from which on its ledger is summed in blocks, ids of a block, and users of that kind that every task is told.
HOT_ROWS, BLOCK_IDS, MOST_HOT = 1_000_000, 65_536, 100_000


def running_balance(events: DataFrame, hot_rows: int = HOT_ROWS, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Balance after each ledger row, in order of event_id.

    A user with very many rows is no one task's window: its rows are summed by
    blocks of ids, the blocks' sums run up, and each block adds up its own rows.
    """
    rows = ledger(events).select("event_id", "user_id", "signed")
    order = lambda *keys: Window.partitionBy(*keys).orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    hot = rows.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select(F.col("user_id").alias("hot_user"))
    n = hot.count()
    if not n:
        return rows.select("event_id", "user_id", "signed", F.sum("signed").over(order("user_id")).alias("balance"))
    hot = F.broadcast(hot) if n <= MOST_HOT else hot
    rows = rows.join(hot, F.col("user_id").eqNullSafe(F.col("hot_user")), "left")
    # the null user may be a hot one, so what is hot is told by the match and not by the value
    rows = rows.withColumn("block", F.when(F.col("hot_user").isNotNull() | F.col("user_id").isNull(), F.floor(F.col("event_id") / block_ids)).otherwise(F.lit(0))).drop("hot_user")
    before = Window.partitionBy("user_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("user_id", "block").agg(F.sum("signed").alias("sum"))
    sums = sums.select(F.col("user_id").alias("su"), F.col("block").alias("sb"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    inside = rows.withColumn("inside", F.sum("signed").over(order("user_id", "block")))
    return inside.join(sums, F.col("user_id").eqNullSafe(F.col("su")) & (F.col("block") == F.col("sb"))).select("event_id", "user_id", "signed", (F.col("base") + F.col("inside")).alias("balance"))


def guarded_debits(events: DataFrame) -> DataFrame:
    """A debit is refused where the balance is smaller; refused rows leave the balance."""

    def step(state: list, r) -> tuple:
        ok = state[0] + r.signed >= 0 or r.signed > 0
        if ok:
            state[0] += r.signed
        return r.event_id, r.user_id, ok, state[0]

    return ordered_fold(ledger(events).select("event_id", "user_id", "signed"), "user_id", ["event_id"], "event_id long, user_id long, applied boolean, balance long", lambda: [0], step)


def metered_lookup(looked_up: DataFrame, limit: int = LIMIT, width: int = WIDTH, cost: int = COST) -> DataFrame:
    """Each request's status, charge and the balance after it, in time order of its user.

    Credits raise the balance; debits are guarded. Other events are lookups:
    banned and over-limit users are refused before anything else, an invalid
    probe is an error without charge, a balance under the cost refuses before
    the lookup, a hit is charged, a miss is free.
    """
    rows = access(looked_up).select("event_id", "user_id", "us", "decision", "outcome", F.when(F.col("ledger_type") == "credit", F.col("amount")).when(F.col("ledger_type") == "debit", -F.col("amount")).otherwise(F.lit(0)).alias("signed"))

    def step(state: list, r) -> tuple:
        balance, log = state
        charge, results = 0, 0
        if r.signed:
            status = "ledger" if r.signed > 0 or balance + r.signed >= 0 else "refused"
            state[0] += r.signed if status == "ledger" else 0
        elif r.decision in ("deny", "unauthorized"):
            status = "denied"
        elif r.decision != "owner" and not allow(log, r.us, limit, width):
            status = "limited"
        elif r.outcome == "invalid":
            status = "invalid"
        elif balance < cost:
            status = "no_credit"
        else:
            status = r.outcome
            if status == "hit":
                charge, results = cost, 1
                state[0] -= cost
        return r.event_id, r.user_id, status, charge, results, state[0]

    return ordered_fold(rows, "user_id", ["us", "event_id"], "event_id long, user_id long, status string, charge long, result_count long, balance long", lambda: [0, deque()], step)


def recent(events: DataFrame, limit: int, cleared: DataFrame) -> DataFrame:
    """Newest ``limit`` rows of each user; the clear time filters after the limit."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    rows = events.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)
    return rows.join(cleared, "user_id", "left").where("cleared_us is null or us > cleared_us").select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))
