"""The queries over the given tables: each builds its inputs and applies one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators import lookup, merge, stats, usage, validate
from ..sources import shared
from ..sources import sorted as sorted_
from ..sources.shared import new_folder
from ..sources.views import raw_entities, table, usage_events


def _accepted(spark: SparkSession, d: str) -> DataFrame:
    return validate.accepted(raw_entities(spark, d))


def indexes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records and both alias indexes; rows are cleaned once for all three, into a folder."""
    at = new_folder(spark, "accepted")
    _accepted(spark, d).select("seq", "id", "name", "alias_a", "alias_b").write.parquet(at)
    rows = spark.read.parquet(at)
    return merge.upsert(rows), merge.alias_index(rows, "alias_a"), merge.alias_index(rows, "alias_b")


#: Folders of kept tables by application, input and the state of its files.
_KEPT: dict[tuple, str] = {}


def kept_tables(spark, d):
    """The three keyed tables, written once in a session for each state of the input; look-ups read them."""
    of = (spark.sparkContext.applicationId, d, shared.state(spark, f"{d}/orders.parquet"))
    if of not in _KEPT:
        path = new_folder(spark, "index")
        lookup.write_indexes(*indexes(spark, d), path)
        _KEPT[of] = path
    return _KEPT[of]


def _looked_up(spark: SparkSession, d: str) -> DataFrame:
    return lookup.routed_lookup(usage_events(spark, d), lookup.search_index(*lookup.read_indexes(spark, kept_tables(spark, d))))


# rows and predicates


def rejects_sink(spark, d):
    return validate.rejects(raw_entities(spark, d))


def reject_reasons(spark, d):
    return validate.rejects(raw_entities(spark, d)).groupBy("reason").agg(F.count("*").alias("n"))


def id_filter(spark, d):
    return validate.validate(raw_entities(spark, d)).select("seq", "id", F.col("reason").isNull().alias("valid"))


def alias_a_clean(spark, d):
    return raw_entities(spark, d).select("seq", C.clean_alias_a("alias_a_raw").alias("alias_a"), ((C.clean_alias_a("alias_a_raw") == "") & (C.trim("alias_a_raw") != "")).alias("cleared"))


def alias_a_canonical(spark, d):
    c = C.canonical_alias_a("alias_a_raw")
    return raw_entities(spark, d).select("seq", c.alias("alias_a"), F.when(C.trim("alias_a_raw") == "", "required").when(c == "", "invalid").otherwise("").alias("reason"))


def alias_b_clean(spark, d):
    return raw_entities(spark, d).select("seq", C.clean_alias_b("alias_b_raw").alias("alias_b"), C.clean_alias_b("alias_b_raw", 32).alias("strict"))


def validate_records(spark, d):
    return validate.validate(raw_entities(spark, d)).select("seq", "source_file", "id", "name", "alias_a", "alias_b", "extras", F.coalesce("reason", F.lit("")).alias("reason"))


def name_combine(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left").select("c_custkey", C.combine_name(F.when(F.col("c_custkey") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" "))), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("n_name"))).alias("full_name"))


def extras_pack(spark, d):
    fields = {"date": F.date_format("o_orderdate", "yyyy-MM-dd"), "priority": F.col("o_orderpriority"), "status": F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus"))}
    packed = F.map_filter(F.create_map(*(x for k in sorted(fields) for x in (F.lit(k), fields[k]))), lambda k, v: v != "")
    return table(spark, d, "orders").select("o_orderkey", F.to_json(packed).alias("extras"))


def record_unpack(spark, d):
    packed = F.when(F.col("c_custkey") % 2 == 0, F.concat_ws("\x00", "c_name", "c_mktsegment")).otherwise(F.concat_ws("\x00", "c_name", "c_mktsegment", F.col("c_nationkey").cast("string"), F.lit('{"a":1}')))
    parts = table(spark, d, "customer").select("c_custkey", F.split(packed, "\x00", 4).alias("p"))
    return parts.select("c_custkey", *(F.coalesce(F.get("p", i), F.lit("")).alias(n) for i, n in enumerate(("alias_a", "alias_b", "name", "extras"))))


def query_route(spark, d):
    return usage_events(spark, d).select("event_id", C.route("probe").alias("kind"))


def probe_validate(spark, d):
    key = C.probe_key("probe")
    return usage_events(spark, d).select("event_id", C.route("probe").alias("kind"), F.coalesce(key, F.lit("")).alias("key"), key.isNull().alias("invalid"))


def text_sanitize(spark, d):
    docs = validate.sanitize_text(table(spark, d, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text"), "text")
    talk = validate.sanitize_text(table(spark, d, "conversations").select(F.lit("conversations").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), "text")
    return docs.unionByName(talk).select("source", "id", F.coalesce("clean", F.lit("")).alias("clean"), F.coalesce("reason", F.lit("")).alias("reason"))


def injection_scan(spark, d):
    texts = table(spark, d, "documents").select("text").unionByName(table(spark, d, "pages").select(F.col("html").alias("text")))
    return validate.injection_counts(texts, "text").select(F.col("pattern").cast("long").alias("pattern"), "matches")


def key_quality(spark, d):
    keys = table(spark, d, "customer").select(F.col("c_name").alias("key")).unionByName(table(spark, d, "pages").select(F.col("url").alias("key")))
    return keys.groupBy(F.coalesce(validate.key_reason("key"), F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def path_hygiene(spark, d):
    path = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    dirty = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("/en/../"), path)).when(F.col("page_id") % 7 == 0, F.lit("")).otherwise(path)
    pages = table(spark, d, "pages").select("page_id", dirty.alias("path"))
    return pages.select("page_id", F.coalesce(validate.path_reason("path", ["/en/", "/de/"]), F.lit("")).alias("reason"))


def constraint_check(spark, d):
    e = usage_events(spark, d)
    return validate.count_violations(e, {"amount_not_negative": "amount >= 0", "amount_at_most_3": "amount <= 3", "type_known": "ledger_type IN ('credit', 'debit')", "latency_at_most_90": "latency_ms <= 90", "user_positive": "user_id > 0"})


def value_range_check(spark, d):
    part = validate.count_violations(table(spark, d, "part"), {"size_1_40": "p_size BETWEEN 1 AND 40", "price_1_1000000": "p_retailprice BETWEEN 1 AND 1000000"})
    supplier = validate.count_violations(table(spark, d, "supplier"), {"balance_not_negative": "s_acctbal >= 0"})
    repeated = table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("violations")).select(F.lit("distinct_names").alias("rule"), "violations")
    return part.unionByName(supplier).unionByName(repeated)


# joins


def key_lookup(spark, d):
    customers = table(spark, d, "customer").where("c_custkey % 3 <> 0")
    return lookup.key_lookup(table(spark, d, "orders"), customers, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey", F.coalesce("c_name", F.lit("")).alias("c_name"), "found")


def alias_lookup(spark, d):
    probes = usage_events(spark, d).select("event_id", C.clean_alias_a("probe").alias("probe_alias")).where("probe_alias <> ''")
    found = lookup.kept_alias_lookup(probes, kept_tables(spark, d), "probe_alias", "alias_a")
    return found.select("event_id", F.col("probe_alias").alias("alias"), F.coalesce("id", F.lit("")).alias("id"), F.coalesce("name", F.lit("")).alias("name"), "found")


def record_lookup(spark, d):
    """Probes of kind id against the kept record table."""
    probes = usage_events(spark, d).where(C.route("probe") == "id").select("event_id", C.probe_key("probe").alias("key"))
    return lookup.kept_key_lookup(probes, kept_tables(spark, d), "key").select("event_id", F.coalesce("key", F.lit("")).alias("key"), F.coalesce("name", F.lit("")).alias("name"), "found")


def routed_lookup(spark, d):
    return _looked_up(spark, d).select("event_id", "kind", F.coalesce("key", F.lit("")).alias("key"), F.coalesce("id", F.lit("")).alias("id"), "outcome")


def new_vs_existing(spark, d):
    rows = _accepted(spark, d)
    old, new = rows.where("source_file = '0'").select("id").distinct(), rows.where("source_file <> '0'")
    known = new.join(old, "id", "left_semi").withColumn("existing", F.lit(True))
    return known.unionByName(new.join(old, "id", "left_anti").withColumn("existing", F.lit(False))).select("seq", "id", "existing")


def access_gate(spark, d):
    return usage.access(usage_events(spark, d)).select("event_id", "user_id", "decision")


def orphan_check(spark, d):
    users = table(spark, d, "customer").where("c_custkey % 4 <> 0")
    orders = table(spark, d, "orders")
    return orders.join(users, orders.o_custkey == users.c_custkey, "left_anti").select("o_orderkey", "o_custkey")


def cascade_delete(spark, d):
    gone = table(spark, d, "customer").where("c_custkey % 10 = 0").select("c_custkey")
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    kept = orders.join(gone, orders.o_custkey == gone.c_custkey, "left_anti")
    lost = orders.join(gone, orders.o_custkey == gone.c_custkey, "left_semi").select("o_orderkey")
    lines = lines.join(lost, lines.l_orderkey == lost.o_orderkey, "left_anti")
    return kept.agg(F.lit("orders").alias("child"), F.count("*").alias("kept")).unionByName(lines.agg(F.lit("lineitem").alias("child"), F.count("*").alias("kept")))


def batch_delete(spark, d):
    part = table(spark, d, "part")
    keys = table(spark, d, "lineitem").where("l_quantity >= 49").select("l_partkey").distinct()
    return part.join(keys, part.p_partkey == keys.l_partkey, "left_anti").select("p_partkey", "p_name")


# merges


def first_wins_dedup(spark, d):
    return merge.first_wins(_accepted(spark, d)).select("id", "seq", "name", "alias_a", "alias_b")


def upsert_merge(spark, d):
    return merge.upsert_with_extras(_accepted(spark, d))


def json_deep_merge(spark, d):
    return merge.merge_json_keys(_accepted(spark, d))


def _nested_extras(spark, d):
    """Rows whose extras are nested, hold nulls and numbers, and disagree at several depths."""
    nested = F.concat(F.lit('{"a":{"n":'), F.col("extras"), F.lit(',"q":'), F.when(F.col("seq") % 2 == 0, "null").otherwise(F.col("source_file")), F.lit(',"w":7.0},"f":"'), F.col("source_file"), F.lit('","z":null}'))
    return _accepted(spark, d).withColumn("extras", nested)


def json_nested_merge(spark, d):
    return merge.merge_json(_nested_extras(spark, d))


def nested_upsert(spark, d):
    """``upsert_merge`` whose extras recurse into objects."""
    return merge.upsert_with_extras(_nested_extras(spark, d))


def alias_index(spark, d):
    rows = _accepted(spark, d)
    out = None
    for kind in ("alias_a", "alias_b"):
        one = merge.alias_index(rows, kind).select(F.lit(kind).alias("kind"), "alias", "id", "is_current")
        out = one if out is None else out.unionByName(one)
    return out


def _part_changes(spark, d):
    part = table(spark, d, "part")
    return part.select("p_partkey", "p_name", "p_retailprice", F.lit(0).alias("batch")).unionByName(part.where("p_partkey % 3 = 0").select("p_partkey", F.concat("p_name", F.lit(" new")).alias("p_name"), "p_retailprice", F.lit(1).alias("batch")))


def batch_put(spark, d):
    return merge.latest(_part_changes(spark, d), "p_partkey", "batch").select("p_partkey", "p_name", "p_retailprice")


def profile_upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    existing = c.where("c_custkey % 2 = 0")
    incoming = c.where("c_custkey % 3 = 0").withColumns({"c_name": F.concat(F.lit("New "), "c_name"), "c_acctbal": F.lit(0.0)})
    return merge.profile_upsert(existing, incoming, "c_custkey", ["c_name", "c_mktsegment"])


def keyed_update(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    changes = table(spark, d, "part").where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("new"))
    updated = s.join(changes, s.s_suppkey == changes.key, "left").select(F.col("s_suppkey").alias("key"), F.coalesce("new", "s_acctbal").alias("balance"), F.when(F.col("new").isNotNull(), "updated").otherwise("unchanged").alias("status"))
    missing = changes.join(s, s.s_suppkey == changes.key, "left_anti").select("key", F.col("new").alias("balance"), F.lit("not_found").alias("status"))
    return updated.unionByName(missing)


def insert_if_absent(spark, d):
    users, c = usage_events(spark, d).select("user_id").distinct(), table(spark, d, "customer").where("c_custkey % 2 = 0")
    fresh = users.join(c, users.user_id == c.c_custkey, "left_anti").select("user_id", F.lit(0.0).alias("points"), F.lit(True).alias("created"))
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("points"), F.lit(False).alias("created")).unionByName(fresh)


def ledger_append(spark, d):
    """Ids go up with event_id: the rank inside a block of ids plus the rows of the blocks before, so no task holds all rows.

    Blocks are summed in groups of 65,536, so the one window without a key has a row for 2^28 ids.
    """
    rows = usage.ledger(usage_events(spark, d)).withColumn("block", F.floor(F.col("event_id") / 4096))
    blocks = rows.groupBy("block").agg(F.count("*").alias("n")).withColumn("group", F.floor(F.col("block") / 65536))
    before = lambda w: F.coalesce(F.sum("n").over(w.orderBy(F.asc_nulls_first("o")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = blocks.groupBy("group").agg(F.sum("n").alias("n")).withColumn("o", F.col("group")).select("group", before(Window.partitionBy()).alias("group_base"))
    blocks = blocks.withColumn("o", F.col("block")).withColumn("inside", before(Window.partitionBy("group"))).join(groups, "group").select("block", (F.col("inside") + F.col("group_base")).alias("base"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("event_id"))
    return rows.withColumn("place", place).join(blocks, "block").select((F.col("base") + F.col("place")).alias("id"), "event_id", "user_id", "amount", F.col("ledger_type").alias("type"))


def index_tables(spark, d):
    path = new_folder(spark, "index")
    lookup.write_indexes(*indexes(spark, d), path)
    return lookup.search_index(*lookup.read_indexes(spark, path))


# aggregates


def ingest_stats(spark, d):
    rows = validate.validate(raw_entities(spark, d))
    modes = [stats.ingest_stats(rows, skip).withColumn("mode", F.lit("skip" if skip else "update")) for skip in (False, True)]
    return modes[0].unionByName(modes[1])


def convert_stats(spark, d):
    """Conversion of the three sources at a given pace: a second and a quarter more for each."""
    raw = raw_entities(spark, d)
    size = sum((F.octet_length(c) + 1 for c in raw.columns if c.endswith("_raw")), F.lit(0))
    rows = validate.validate(raw.withColumn("size", size), "size")
    seconds = rows.select("source_file").distinct().withColumn("seconds", 1.0 + F.col("source_file").cast("int") * 0.25)
    return stats.convert_stats(rows, F.col("size"), seconds)


def lookup_stats(spark, d):
    looked = _looked_up(spark, d)
    cached = usage.ttl_hits(looked).groupBy(F.substring_index("key", ":", 1).alias("kind")).agg(F.count_if("cache_hit").alias("cache_hits"), F.count_if(~F.col("cache_hit")).alias("cache_misses"))
    count = lambda outcome: F.count_if(F.col("outcome") == outcome)
    sums = looked.groupBy("kind").agg(F.count("*").alias("queries"), count("hit").alias("hits"), count("miss").alias("misses"), count("invalid").alias("invalid"), F.round(F.avg("latency_ms"), 4).alias("avg_latency"))
    return sums.join(cached, "kind", "left").na.fill(0, ["cache_hits", "cache_misses"])


def usage_stats(spark, d):
    looked = _looked_up(spark, d)
    today = usage_events(spark, d).agg(F.max("day")).scalar()  # the last day of the log counts as today
    e = looked.where("outcome <> 'invalid'").withColumn("today", today)
    ok = F.col("outcome") == "hit"
    return e.agg(F.count("*").alias("total"), F.count_if(F.col("day") == F.col("today")).alias("today"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"), F.floor(F.avg("latency_ms")).alias("avg_latency"), F.count_if(ok).alias("points_spent"), F.count_distinct("user_id").alias("registered"), F.count_distinct(F.when(F.col("user_id") % 5 == 0, F.col("user_id"))).alias("banned"))


def ops_metrics(spark, d):
    today = usage_events(spark, d).agg(F.max("day")).scalar()  # the last day of the log counts as today
    looked = _looked_up(spark, d).withColumn("latest", today)
    return stats.ops_metrics(looked, F.col("latest"), _accepted(spark, d).count(), 10.0)


def daily_usage(spark, d):
    return usage_events(spark, d).groupBy("day").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def index_counts(spark, d):
    records, a, b = indexes(spark, d)
    return records.agg(F.lit("records").alias("name"), F.count("*").alias("entries")).unionByName(a.agg(F.lit("alias_a").alias("name"), F.count("*").alias("entries"))).unionByName(b.agg(F.lit("alias_b").alias("name"), F.count("*").alias("entries")))


def balances(spark, d):
    e = usage_events(spark, d)
    sums = usage.ledger(e).groupBy("user_id").agg(F.sum("signed").alias("balance"))
    return e.select("user_id").distinct().join(sums, "user_id", "left").select("user_id", F.coalesce("balance", F.lit(0)).alias("balance"), (F.coalesce("balance", F.lit(0)) >= 3).alias("can_afford"))


def known_users(spark, d):
    return usage_events(spark, d).select("user_id").distinct()


def _cleared(e):
    return e.where("user_id % 4 = 0").groupBy("user_id").agg(F.min("us").alias("cleared_us"))


def history_count(spark, d):
    e = usage_events(spark, d)
    rows = e.join(_cleared(e), "user_id", "left").where("cleared_us is null or us > cleared_us")
    return rows.groupBy("user_id").agg(F.count("*").alias("visible"))


# sequential rules


def rate_limit(spark, d):
    return usage.rate_limit(usage_events(spark, d))


def ttl_hits(spark, d):
    return usage.ttl_hits(_looked_up(spark, d))


def ttl_hits_all(spark, d):
    return usage.ttl_hits(_looked_up(spark, d))


def running_balance(spark, d):
    return usage.running_balance(usage_events(spark, d))


def guarded_debits(spark, d):
    return usage.guarded_debits(usage_events(spark, d))


def metered_lookup(spark, d):
    return usage.metered_lookup(_looked_up(spark, d))


def recent_per_user(spark, d):
    e = usage_events(spark, d)
    return usage.recent(e, 10, _cleared(e))


# order, pages and sets


def ordered_sample(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_name").orderBy("key").limit(20)


def range_seek(spark, d):
    path = new_folder(spark, "parts")
    sorted_.write_sorted(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", path)
    return sorted_.seek(spark, path, "p_partkey", 100, 20)


def record_seek(spark, d):
    """The first records whose id is not below a text, in byte order."""
    return sorted_.seek(spark, f"{kept_tables(spark, d)}/records", "id", "11", 50).select("id", "name")


def page_scan(spark, d):
    return table(spark, d, "orders").where("o_custkey = 7").orderBy(F.desc("o_orderkey")).offset(2).limit(5).select("o_orderkey", "o_custkey")


def multi_source_union(spark, d):
    rows = _accepted(spark, d)
    parts = [rows.where(F.col("source_file") == s).withColumn("rank", F.lit(i).cast("long")) for i, s in enumerate(("2", "0", "1"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select("rank", "source_file", "seq", "id")
