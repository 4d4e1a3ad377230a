"""Fixed values of the behaviour engine: minimum samples, windows and rule thresholds."""

from __future__ import annotations

WINDOW_DAYS = 30
WINDOW_START = 1704067200  # 2024-01-01T00:00:00Z, the start of the event window
SESSION_GAP = 1800
BURST_GAP = 60
BURST_SIZE = 3
TOLERANCE = 0.05
RAPID, SHORT, LONG = 300, 3600, 86400

#: Least sample of each family.
MINIMUM = {"temporal": 5, "periodicity": 8, "lifecycle": 3, "topology": 3, "templates": 3, "scripts": 1, "typed_assets": 3, "capacity": 1, "lineage": 3}

#: Families of each rule, in the order of the rules.
RULE_FAMILIES = {
    "PERIODIC_EXECUTION": ("temporal", "periodicity"),
    "BATCH_DISTRIBUTION": ("topology", "templates"),
    "FAN_IN_COLLECTION": ("topology", "templates"),
    "BURST_EXECUTION": ("temporal",),
    "CELL_FRAGMENTATION": ("topology",),
    "CELL_CONSOLIDATION": ("topology",),
    "SCRIPT_TEMPLATE_REPETITION": ("templates", "scripts"),
    "RAPID_CELL_TURNOVER": ("lifecycle",),
    "PASS_THROUGH_CANDIDATE": ("lifecycle", "lineage", "capacity"),
    "STATE_MACHINE_ACTIVITY": ("templates",),
    "IRREGULAR_ACTIVITY": ("temporal", "periodicity", "templates"),
}

#: Tokens that keep a column out of the learning matrix.
FORBIDDEN_TOKENS = (
    "wallet", "hash", "label", "stratum", "lifetime", "timestamp", "collection", "support", "coverage", "sample_count", "state", "cluster", "classifier", "prediction",
)
