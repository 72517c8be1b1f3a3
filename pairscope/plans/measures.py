"""Columns of registered queries that hold doubles; both engines round them to six places."""

#: Query and columns.
MEASURES = {
    "A01_accuracy_summary": ["accuracy"],
    "A02_grouping_sets_summary": ["accuracy"],
    "A03_metrics_long": ["value"],
    "A05_label_rollup": ["pct_of_labeled"],
    "A06_transition_summary": ["rescue_rate", "regression_rate"],
    "A07_transition_by_label": ["rescue_rate", "regression_rate"],
    "A08_error_asymmetry": ["error_rate"],
    "A11_concordance": ["transition_agreement", "agreement_claim_only", "agreement_with_evidence"],
    "A24_set_size_rates": ["robust", "rescue", "resistant", "regression"],
    "A19_confidence_stats": ["mean_confidence", "sd_confidence"],
    "A21_judge_behavior": ["pct_supported", "pct_refuted", "pct_ambiguous", "mean_confidence"],
    "A23_flag_scope": ["pct"],
    "A28_verdict_change": ["changed_ab", "changed_bc", "changed_ac", "became_decisive", "became_nondecisive", "improved_ab", "improved_bc"],
    "A29_resolution_rates": ["title_resolved", "structure_resolved", "reversed_ac", "lost_ab", "never_decisive"],
    "A30_mechanism_proportions": ["share"],
    "A32_stage_comparison": ["delta_pp"],
    "A33_overlap_subgroups": ["rate"],
    "A34_descriptive_rates": ["rate"],
    "J16_judge_pairs": ["agreement"],
    "T01_pairwise_agreement": ["mean_agreement", "min_agreement"],
    "T02_decisive_agreement": ["mean_agreement", "min_agreement"],
    "T03_fleiss": ["observed", "expected", "kappa"],
    "T04_krippendorff": ["alpha"],
    "T05_cohen_kappa": ["observed", "expected", "kappa"],
    "T22_replication": ["agreement", "decisive_agreement", "agreement_if_decisive"],
    "T07_wilson": ["rate", "ci_low", "ci_high"],
    "T08_rate_contract": ["rate", "ci_low", "ci_high"],
    "T09_mcnemar_cc": ["chi2"],
    "T10_mcnemar_exact": ["p_exact"],
    "T11_binomial": ["p"],
    "T12_fisher": ["p"],
    "T13_odds_ratio": ["odds_ratio", "ci_low", "ci_high", "odds_ratio_floor", "ci_low_floor", "ci_high_floor"],
    "T14_chi2": ["chi2", "phi", "cramers_v"],
    "T15_cramers_v": ["chi2", "phi", "cramers_v"],
    "T16_constant_margin": ["chi2"],
    "W03_avg_rank": ["avg_rank"],
    "T17_kruskal": ["h"],
    "T18_mann_whitney": ["u", "z", "auc"],
    "T27_auc_ap_brier": ["auc", "average_precision", "brier"],
    "T06_bootstrap": ["ci_low", "ci_high"],
    "W02_bh": ["p", "p_bh"],
    "T31_id_neutrality": ["chi2", "phi", "cramers_v"],
    "F13_overlap": ["lexical_overlap", "jaccard", "numeric_overlap", "length_ratio"],
    "F16_cosine": ["cosine"],
    "F17_mad_outlier": ["med", "mad"],
    "P24_argmax_margin": ["margin"],
    "A25_disagreement_by_transition": ["rate"],
    "A26_two_diagnostics": ["disagrees", "weak"],
    "A27_agreement_bucket": ["rate"],
    "A35_balance": ["mean_sets", "supported"],
    "T20_endpoint_battery": ["rate_pct", "wilson_low", "wilson_high", "odds_ratio", "ci_low", "ci_high", "delta_pp", "statistic", "p", "p_bh"],
    "T21_cross_family_battery": ["rate_pct", "wilson_low", "wilson_high", "odds_ratio", "ci_low", "ci_high", "delta_pp", "statistic", "p", "p_bh"],
    "V02_headlines": ["expected", "value"],
}
