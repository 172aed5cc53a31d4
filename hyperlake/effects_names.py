"""Fixed names and constants of the effect, trust and claim tables."""

# fixed values: arm names with the residual weight (alpha) each one ran with
ARMS = {
    "oracle": None,
    "mechanistic_calibrated": 0.0,
    "residual_quarter": 0.25,
    "residual_idcal": 0.5,
    "residual_predictive": 1.0,
}
ORACLE = "oracle"
BASELINE_ARM = "mechanistic_calibrated"

# fixed values: policies, baseline first
POLICIES = ("throughput", "semantic")

# fixed values: the alpha grid, the fallback alpha and the tolerance of the invariance test
GRID = (0.0, 0.25, 0.5, 1.0)
DEFAULT_ALPHA = 0.0
DEFAULT_LAMBDA = 0.1
INVARIANCE_TOL = 1e-12
PRIMARY_ESTIMAND = "goal_utility_ratio"
INTERVENTION = "semantic_vs_throughput"

# fixed values: claim statuses and the notes that go with them
STATUSES = ("admit", "hold_unresolved", "reject", "outcome_unknown")
NOTES = {
    "outcome_unknown": "oracle contrast not expressed",
    "silent": "ensemble silent while oracle expressed",
    "admit": "all hypotheses and oracle agree",
    "against": "ensemble agrees, disagrees with oracle",
    "hold_unresolved": "residual signs disagree",
}
