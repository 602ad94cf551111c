"""High-resolution telemetry analytics as DataFrame-to-DataFrame operators."""

from fleetpulse.functions.h2 import h2_bound, h2_bound_of_index, h2_bucket_total, h2_clamp, h2_index, is_clamped
from fleetpulse.functions.network import (
    artifact_flags, fixed_point, kib_to_bytes, megabytes, ns_to_us, queue_stat_fields, sectors_to_bytes, service_port, to_gbps)
from fleetpulse.functions.percentiles import event_total, percentile_columns, percentiles_from_buckets, percentiles_or_null
from fleetpulse.functions.text import (
    decode_buckets, decode_labels, encode_buckets, encode_labels, label_text, normalize_mask, sanitize_name, series_key)
from fleetpulse.operators.chunks import asof_join, last_known, running_total, with_previous
from fleetpulse.operators.config import (
    attributed_note, change_note, change_rows, change_tags, change_timeline, config_diff, config_values, flatten_config,
    latest_config_snapshot)
from fleetpulse.operators.diagnostics import (
    burst_windows, cpu_contention, fragment_failure, hot_entity, io_error_mix, loss_detection, mtu_regression, offcpu_class,
    receive_ceiling, retransmit_shape, rss_tier, throttle_vs_contention)
from fleetpulse.operators.filters import (
    exclude_virtual, field_map, field_mapping, keep_patterns, label_filter, lookback, name_filter)
from fleetpulse.operators.histograms import (
    bucket_array, dense_to_sparse, expire_stale, gauge_window, rollup_row, slice_histogram, sliding_histogram, subtract_buckets,
    windowed_distribution)
from fleetpulse.operators.joins import (
    alias_fold, annotate, attribute_changes, before_after, enrich_context, multipath_head, sources_side_by_side, stamp_changes)
from fleetpulse.operators.rates import (
    counter_rate, entity_delta, irate, layout_guard, multiplex_scale, queue_delta, queue_delta_guarded, raw_rate)
from fleetpulse.operators.paging import page
from fleetpulse.operators.rollups import (
    bandwidth, busiest_cores, coverage_gate, coverage_tuples, distinct_names, expected_active, first_n_series, flow_health,
    kind_unit_shapes, label_facets, latest_snapshot, metric_catalog, panel_stats, peak_by_label, pivot_percentiles,
    port_retransmits, port_rtt, queue_balance, queue_cv, register_views, session_overview, sum_of_rates_by_label,
    sum_over_label, time_bucket_max)
from fleetpulse.operators.spacing import kept_chain, spaced_rows
from fleetpulse.operators.spans import (
    completion_latency, completion_stats, drop_reasons, latency_histogram, paired_latency, state_durations, time_in_state)
from fleetpulse.session import configure, local_session
from fleetpulse.sinks.exposition import (
    csv_rows, export_csv, export_json, exposition_rows, exposition_text, write_exposition)
from fleetpulse.sinks.tables import apply_retention, recording_rows, sample_rows, write_recording, write_samples
from fleetpulse.sources.captures import (
    exposition_tuples, ingest_entity_table_text, ingest_exposition_text, ingest_header_pair_text, ingest_kv_text, ingest_matrix_text,
    ingest_pair_text, ingest_pressure_load_text, read_captures)
from fleetpulse.sources.recordings import (
    decode_recording, distinct_observations, index_recordings, load_session, read_recording, recording_catalog, validate_recording)
from fleetpulse.streaming.changes import timeline_stream
from fleetpulse.streaming.exports import export_ticks, failure_counter, pending_batches, replay_dead_letters
from fleetpulse.streaming.losses import record_losses, recorded_losses
from fleetpulse.streaming.streams import (
    change_stream, export_stream, failure_rows, loss_metrics, run_to_table, stream_counter_rate, stream_distinct, stream_expire,
    stream_paired_latency, stream_state_durations, stream_window_percentiles)

__all__ = [name for name in dir() if not name.startswith("_") and name not in (
    "functions", "operators", "plans", "sinks", "sources", "streaming", "durations", "schema", "session")]
