"""Query definitions; importing a module registers its queries."""

import importlib

MODULES = [
    "q_boxes", "q_scalars", "q_matching", "q_statistics", "q_recovery", "q_profiles", "q_datasets", "q_catalogue", "q_calibration", "q_streaming",
]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"gaugeline.plans.{name}")
