"""Column sets (as DDL) and defaults of the point, frame, detection and track tables."""

from __future__ import annotations

from dataclasses import dataclass

POINTS = "point_id BIGINT, device_id STRING, sequence_id STRING, scan_idx INT, x DOUBLE, y DOUBLE, z DOUBLE, intensity FLOAT, r SMALLINT, g SMALLINT, b SMALLINT, ring SMALLINT"
_CAMERA = "STRUCT<file_path: STRING, filename: STRING, timestamp: DOUBLE>"
CATALOGUE = (
    "correspondence_frames ARRAY<STRUCT<frame_id: INT, device_id: STRING, sequence_id: STRING, intersection_id: STRING, reference_timestamp: DOUBLE, "
    f"lidar: {_CAMERA}, cam0: {_CAMERA}, cam1: {_CAMERA}, synchronization: STRUCT<sync_quality: STRING>>>"
)
_MATRICES = "STRUCT<intrinsic: ARRAY<ARRAY<DOUBLE>>, extrinsic: ARRAY<ARRAY<DOUBLE>>>"
CALIBRATION = f"cam_0 {_MATRICES}, cam_1 {_MATRICES}"
#: The semantic classes of labelled points.
CLASSES = {0: "ground", 1: "exterior", 2: "interior", 3: "human", 4: "seats", 5: "other"}
#: Synchronisation levels from worst to best.
SYNC_LEVELS = {"poor": 0, "acceptable": 1, "good": 2, "excellent": 3}


@dataclass(frozen=True)
class Params:
    """Default thresholds, in metres, seconds and counts."""

    outlier_quantile: float = 0.95
    ground_band: float = 0.5
    ground_residual: float = 0.1
    ground_height: float = 0.15
    ground_trials: int = 1000
    ground_candidates: int = 100
    fallback_height: float = 0.2
    eps: float = 0.3
    min_samples: int = 50
    vehicle_height: float = 3.0
    interior_low: float = 0.4
    interior_high: float = 1.8
    interior_k: int = 8
    interior_quantile: float = 0.65
    voxel: float = 0.1
    static_radius: float = 0.05
    static_ratio: float = 0.7
    track_distance: float = 5.0
    track_gap: float = 1.0
    track_score: float = 100.0
    model_distance: float = 3.0
    model_gap: float = 1.5
    merge_distance: float = 0.05
    image_width: int = 1920
    image_height: int = 1200
