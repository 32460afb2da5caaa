"""The registry keeps every query; each SQL-checked query keeps its oracle."""

import __spark_entry__ as entry
from tablewright.plans.registered import ORACLE_SQL, QUERIES

EXPECTED = ['agg_count', 'agg_max', 'agg_mean', 'agg_min', 'agg_nunique', 'agg_sum', 'aggregate_to_binary', 'append', 'bad_flags', 'binary_flag', 'binary_flag_text', 'boosted_classes', 'classification_metrics', 'coalesce_first_non_empty', 'coalesce_keys', 'coalesce_prefer_left', 'coalesce_prefer_right', 'column_profile', 'combine_columns', 'dataset_store', 'delete_rows', 'drop_bad_rows', 'drop_columns', 'feature_importance', 'feature_importance_top', 'group_nulls', 'head_preview', 'histogram', 'holdout_split', 'impute_median', 'impute_mode', 'incremental_classifier', 'incremental_continue', 'incremental_fit', 'kernel_classifier', 'kernel_regressor', 'merge_inner', 'merge_left', 'merge_outer', 'merge_preaggregated', 'merge_right', 'merge_risk', 'merge_risk_lines', 'merge_suffixes', 'merge_workflow', 'missing_flags', 'model_registry_fit', 'model_round_trip', 'model_store', 'multi_rule_aggregate', 'normalize_features', 'one_hot', 'predict', 'read_csv_dirty', 'read_csv_inferred', 'read_csv_orders', 'read_many', 'regression_metrics', 'split_column', 'split_column_name', 'standard_scale', 'stratified_split', 'stream_clean', 'stream_train', 'tail_preview', 'task_type', 'time_range', 'time_range_text', 'top_categories', 'top_values', 'top_values_numeric', 'train_classifier', 'train_regressor', 'training_frame', 'training_frame_text', 'zero_fill', 'zero_flags', 'zero_pad']


def test_registry_complete():
    assert sorted(QUERIES) == EXPECTED
    assert set(EXPECTED) <= set(entry.queries())


def test_every_query_has_its_sql():
    assert set(ORACLE_SQL) == set(EXPECTED)
    assert set(EXPECTED) <= set(entry.oracle_sql())
