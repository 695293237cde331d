"""Survey operator id -> the function that implements it (module:function).

Used by ``tests/test_inventory.py`` to check that every entry resolves.
"""

INVENTORY = {
    # scans, sources, sinks
    "S1": "podium.sources.readers:read_facts",
    "S2": "podium.sources.readers:read_csv_table",
    "S3": "podium.sources.readers:read_first_existing",
    "S4": "podium.sources.readers:read_latest_snapshot",
    "S5": "podium.sources.readers:read_latest_run",
    "S6": "podium.sources.writers:write_award_datasets",
    "S7": "podium.sources.writers:write_predictions",
    "S8": "podium.sources.writers:write_run",
    "S12": "podium.sources.writers:prediction_audit",
    # projections and casts
    "P1": "podium.functions.scalar:to_number",
    "P2": "podium.operators.shaping:normalize_schema",
    "P3": "podium.functions.scalar:parse_season_end",
    "P4": "podium.functions.scalar:season_label",
    "P7": "podium.functions.scalar:as_binary",
    "P8": "podium.operators.shaping:drop_columns",
    "P9": "podium.operators.shaping:one_hot",
    "P10": "podium.operators.shaping:select_numeric",
    "P11": "podium.operators.shaping:align_features",
    "P12": "podium.functions.scalar:inf_to_null",
    "P13": "podium.operators.shaping:to_percent_0_100",
    "P14": "podium.functions.scalar:map_values",
    "P15": "podium.functions.scalar:format_3dp",
    "P16": "podium.operators.shaping:normalize_importance",
    "P17": "podium.functions.scalar:clip_probability",
    # feature-column rules
    "F0": "podium.operators.shaping:select_features",
    "F1": "podium.functions.names:is_leakage_feature",
    "F2": "podium.functions.names:infer_percentile_cols",
    "F3": "podium.functions.names:feature_set",
    "F4": "podium.functions.names:resolve",
    "F5": "podium.functions.names:leak_pattern_filter",
    "F6": "podium.functions.names:external_metric_features",
    "F7": "podium.functions.names:feature_groups",
    "F8": "podium.functions.names:forbidden_substring_audit",
    "F9": "podium.operators.shaping:feature_audit",
    # eligibility
    "E1": "podium.operators.eligibility:per_game_minutes",
    "E2": "podium.operators.eligibility:bench_proxy",
    "E3": "podium.operators.eligibility:min_volume",
    "E4": "podium.operators.eligibility:eligible_mvp",
    "E5": "podium.operators.eligibility:eligible_dpoy",
    "E6": "podium.operators.eligibility:eligible_smoy",
    "E7": "podium.operators.eligibility:eligible_roy",
    "E8": "podium.operators.eligibility:eligible_mip",
    "E9": "podium.operators.eligibility:apply_eligibility",
    "E10": "podium.operators.eligibility:eligible_smoy_strict",
    "E11": "podium.operators.eligibility:eligible_mip_strict",
    "E12": "podium.operators.eligibility:period_between",
    "E13": "podium.operators.eligibility:drop_invalid_periods",
    "E14": "podium.operators.eligibility:complete_cases",
    "E15": "podium.operators.eligibility:missing_rate_filter",
    # joins
    "J1": "podium.operators.joins:prev_period_join",
    "J2": "podium.operators.joins:assert_unique_key",
    "J3": "podium.operators.joins:row_id_join",
    "J4": "podium.operators.joins:flag_members",
    "J5": "podium.operators.joins:semi_filter",
    "J6": "podium.operators.joins:compare_runs",
    "J7": "podium.operators.joins:union_by_name",
    "J8": "podium.operators.joins:audit_alignment",
    # aggregations
    "G1": "podium.operators.aggregate:dedup_most_complete",
    "G2": "podium.operators.aggregate:describe_numeric",
    "G3": "podium.operators.aggregate:rows_per_period",
    "G4": "podium.operators.aggregate:count_wins",
    "G5": "podium.operators.aggregate:count_selections",
    "G6": "podium.operators.aggregate:winners_per_period",
    "G7": "podium.operators.aggregate:label_distribution",
    "G8": "podium.operators.aggregate:describe_split",
    "G9": "podium.operators.aggregate:missing_rate",
    "G10": "podium.operators.aggregate:period_coverage",
    "G11": "podium.operators.aggregate:correlation_matrix",
    "G12": "podium.operators.aggregate:linear_trend",
    "G13": "podium.operators.aggregate:box_summary",
    "G14": "podium.operators.aggregate:winner_loser_profile",
    "G15": "podium.operators.aggregate:class_balance",
    "G16": "podium.operators.aggregate:seed_mean_std",
    # windows
    "W1": "podium.operators.windows:add_prev_features",
    "W2": "podium.operators.windows:add_delta_features",
    "W3": "podium.operators.windows:rank_in_period",
    "W4": "podium.operators.windows:percent_rank_avg",
    "W5": "podium.operators.windows:add_volume_features",
    "W6": "podium.operators.windows:best_per_group",
    "W7": "podium.operators.windows:temporal_split_last_k",
    "W8": "podium.operators.windows:temporal_split_cutoff",
    "W9": "podium.operators.windows:walk_forward_folds",
    "W10": "podium.operators.windows:learning_curve_folds",
    # sorts and top-k
    "K1": "podium.operators.windows:top_k_per_period",
    "K2": "podium.operators.topk:top_k_global",
    "K3": "podium.operators.topk:metrics_table",
    "K4": "podium.operators.topk:worst_periods",
    # reshape
    "R-1": "podium.operators.topk:melt_metrics",
    "R-2": "podium.operators.topk:full_data_points",
    # metrics
    "M1": "podium.operators.metrics:ranking_report",
    "M2": "podium.operators.metrics:topk_accuracy",
    "M3": "podium.operators.metrics:roc_auc",
    "M4": "podium.operators.metrics:average_precision",
    "M5": "podium.operators.metrics:log_loss",
    "M6": "podium.operators.metrics:winner_rank_table",
    "M7": "podium.operators.metrics:winner_rank_summary",
    "M8": "podium.operators.metrics:metrics_by_award",
    "M9": "podium.operators.metrics:generalization_gap",
    # leakage
    "L1": "podium.functions.names:name_leakage",
    "L2": "podium.operators.leakage:corr_leakage",
    "L3": "podium.operators.leakage:check_leakage",
    "L4": "podium.operators.leakage:feature_label_corr",
    # dataset builders
    "B1": "podium.plans.datasets:build_target_matrix",
    "B2": "podium.plans.datasets:build_training_table",
    "B3": "podium.plans.datasets:build_award_dataset",
    "B4": "podium.plans.datasets:build_mip_dataset",
    "B5": "podium.plans.datasets:build_clean",
    "B6": "podium.plans.datasets:build_feature_matrices",
    # models
    "ML1": "podium.plans.models:median_impute",
    "ML2": "podium.plans.models:scale",
    "ML3": "podium.plans.models:logreg_l2",
    "ML4": "podium.plans.models:logreg_elasticnet",
    "ML5": "podium.plans.models:logreg_unweighted",
    "ML6": "podium.plans.models:linear_svm_calibrated",
    "ML7": "podium.plans.models:random_forest",
    "ML8": "podium.plans.models:gradient_boosting",
    "ML9": "podium.plans.models:class_weight_balanced",
    "ML10": "podium.plans.studies:fit_on_split",
    "ML11": "podium.plans.models:score",
    "ML12": "podium.plans.studies:select_family",
    "ML13": "podium.plans.predict:predict_season",
    "ML14": "podium.plans.models:linear_coefficients",
    "ML15": "podium.plans.studies:permutation_importance",
    "ML16": "podium.plans.studies:hparam_sweep",
    "ML17": "podium.plans.studies:feature_ablation",
    "ML18": "podium.plans.studies:learning_curve",
    "ML19": "podium.plans.studies:rolling_eval",
    # upstream steps
    "U1": "podium.operators.matching:entity_match",
    "U2": "podium.operators.matching:merge_sources",
    "U3": "podium.operators.windows:season_percentiles",
    "U4": "podium.operators.windows:group_zscore",
}
