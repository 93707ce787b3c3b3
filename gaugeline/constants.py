"""They must stay as they are for results to agree."""

# Reference lengths in inches.
BASE_CENTRAL_IN = 408.5
LEFT_REFERENCE_IN = 47.75
RIGHT_REFERENCE_IN = 41.0

# Side aliases, lower case.
LEFT_ALIASES = ["151", "cam151", "cam_151", "left", "izq", "izquierda"]
RIGHT_ALIASES = ["152", "cam152", "cam_152", "right", "der", "derecha"]

# Image suffixes of a pool.
IMAGE_SUFFIXES = ["jpg", "jpeg", "png", "bmp", "webp"]

# Box cleaning limits.
OVERLAP_LIMIT = 0.45
CONTAINMENT_RATIO = 0.85
CONTAINED_CHILDREN = 2
VERTICAL_HEIGHT_RATIO = 0.50
VERTICAL_OVERLAP = 0.30
VERTICAL_BAND_OVERLAP = 0.65
MIN_CLUSTER = 3
CLUSTER_GAP_RATIO = 2.8
CLUSTER_MIN_GAP_PX = 55.0
FAR_X_RATIO = 1.8
FAR_X_MIN_PX = 35.0
FAR_X_MIN_CONF = 0.25
FAR_X_EXTRA_CONF = 0.12
DETECTOR_CONF = 0.35

# Gap and edge recovery.
RECOVERY_MIN_RATIO = 1.35
RECOVERY_MAX_RATIO = 4.25
RECOVERY_EMPTY_RATIO = 0.70
RECOVERY_BAND_RATIO = 0.70
RECOVERY_MAX_PER_GAP = 2
EDGE_MIN_RATIO = 1.15
EDGE_SPACE_RATIO = 0.65
EDGE_MAX_MISSING = 3
SYNTHETIC_CONF = 0.025

# Splitting of tall boxes.
SPLIT_HEIGHT_RATIO = 1.65
SPLIT_MAX_PARTS = 4
SPLIT_CLOSE_X_RATIO = 1.10
SPLIT_MIN_CLOSE_X_PX = 10.0

# Flags written on boxes.
FLAG_SAME_BAND = "kept_vertical_y_duplicate"
FLAG_VERTICAL = "kept_vertical_duplicate"
FLAG_FAR_X = "kept_far_x_high_conf"
FLAG_GAP = "gap_recovered"
FLAG_GAP_SYNTH = "gap_pitch_fallback"
FLAG_EDGE_TOP = "edge_gap_top_recovered"
FLAG_EDGE_BOTTOM = "edge_gap_bottom_recovered"
FLAG_EDGE_SYNTH_SUFFIX = "_pitch_fallback"
FLAG_SPLIT = "split_sobel_y"

# Matching.
SLOT_RATIO_LIMIT = 2.30
SLOT_OFFSETS = [-2, -1, 0, 1, 2]
RIGHT_SLOT_HINT = 1
DETACHED_TOP_GAP = 4
ORDER_MIN_COUNT = 8
ORDER_MIN_RATIO = 0.70
MODEL_SOURCE = "yolo_pipe_end"
STRATEGY_BUNDLE = "sam_bundle_normalized_vertical_slots"
STRATEGY_BUNDLE_ORDER = "yolo_vertical_order_balanced_with_sam_bundle_bounds"
STRATEGY_SLOTS = "auto_vertical_slot_alignment_local_box_pitch_cam151_number_anchor"
STRATEGY_ORDER = "yolo_vertical_order_balanced"

# Observation texts of match rows.
OBSERVATION_TEXT = {
    "left_only_manual": "Sin match manual en 151",
    "right_only_manual": "Sin match manual en 152",
    "left_only": "Falta medicion del lado 152",
    "right_only": "Falta medicion del lado 151",
}

# Marker colours.
COLOR_UNMATCHED = "#f2a84b"
COLOR_DEFAULT = "#54b8ff"

# Known distances between labelled points, in inches.
POINT_PAIRS = [
    ("top_03", "top_04", 38.75, "top_03-04"),
    ("mark_05", "mark_06", 38.75, "mark_05-06"),
    ("mark_03", "mark_04", 47.75, "mark_03-04"),
]

# Aliases of camera movement sequences.
SEQUENCE_DEFAULT = "zoom_then_pan_tilt"
SEQUENCE_PRE_ZOOM = "pre_move_zoom_then_pan_tilt_then_zoom"
DEFAULT_SEQUENCE_ALIASES = ["default", "legacy", "zoom_then_pan_tilt"]
PRE_ZOOM_SEQUENCE_ALIASES = [
    "pre_move_zoom_then_pan_tilt_then_zoom",
    "prezoom_pan_tilt_zoom",
    "wide_pan_tilt_zoom",
    "zoom0_pan_tilt_zoom",
]

# Words that mark a detection region.
ROI_NOTE_WORDS = ["lower", "bottom", "tube", "tubos"]
