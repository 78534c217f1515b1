"""Every query of the library by name, with the DuckDB text that gives the same rows."""

from __future__ import annotations

from . import file_queries, oracles, queries, stream_queries

_NAMES = """
rejects_sink reject_reasons id_filter alias_a_clean alias_a_canonical alias_b_clean validate_records name_combine extras_pack record_unpack query_route probe_validate
text_sanitize injection_scan key_quality path_hygiene constraint_check value_range_check key_lookup record_lookup alias_lookup routed_lookup new_vs_existing access_gate orphan_check
cascade_delete batch_delete first_wins_dedup upsert_merge json_deep_merge json_nested_merge nested_upsert alias_index batch_put profile_upsert keyed_update insert_if_absent ledger_append index_tables
ingest_stats convert_stats lookup_stats usage_stats ops_metrics daily_usage index_counts balances known_users history_count rate_limit ttl_hits ttl_hits_all running_balance
guarded_debits metered_lookup recent_per_user ordered_sample range_seek record_seek page_scan multi_source_union
""".split()

_FILE_NAMES = """
source_discovery delimited_scan file_rejects jsonl_scan format_probe encoding_profile transcode_scan delimiter_profile header_profile schema_report canonical_sink convert_or_pass
header_role_map header_layout_map jsonl_record_map
""".split()

_STREAM_NAMES = "incremental_ingest resumed_ingest stream_upsert stream_alias_index stream_counts stream_rate_limit stream_ttl_hits stream_daily_usage stream_progress stream_progress_totals".split()

QUERIES = {name: getattr(queries, name) for name in _NAMES} | {name: getattr(file_queries, name) for name in _FILE_NAMES} | {name: getattr(stream_queries, name) for name in _STREAM_NAMES}
ORACLES = dict(oracles.ORACLES)
