"""Configuration objects passed explicitly to every operator (nothing global)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Layout:
    """Order of landmark groups inside one frame and the indices of body anchors."""

    groups: tuple[tuple[str, int], ...]
    nose: int
    left_eye: int
    right_eye: int
    left_shoulder: int
    right_shoulder: int
    left_hip: int
    right_hip: int
    axes: int = 3

    def span(self, group: str) -> tuple[int, int]:
        """(first landmark, landmark count) of a group."""
        first = 0
        for name, count in self.groups:
            if name == group:
                return first, count
            first += count
        raise KeyError(f"unknown landmark group: {group}")

    @property
    def landmarks(self) -> int:
        return sum(count for _, count in self.groups)

    @property
    def width(self) -> int:
        return self.landmarks * self.axes


# The 75-point body + hands layout and its anchor indices.
HOLISTIC = Layout(
    groups=(("pose", 33), ("left_hand", 21), ("right_hand", 21)),
    nose=0, left_eye=2, right_eye=5,
    left_shoulder=11, right_shoulder=12, left_hip=23, right_hip=24,
)


@dataclass(frozen=True)
class Settings:
    """Every default below is a fixed value that results depend on."""

    layout: Layout = HOLISTIC
    with_mask: bool = False
    visibility_threshold: float = 0.5
    confidence_point_threshold: float = 0.5
    x_axis_scale: float = 3.1605
    reference_body_ratio: float = 0.6566
    reference_face_ratio: float = 0.5238
    theoretical_axis_scale: float = (1920.0 / 1080.0) ** 2

    sequence_length: int = 30
    window_stride: int = 30
    max_sequence_length: int = 600
    min_valid_frames: int = 5

    seed: int = 42
    val_fraction: float = 0.10
    test_fraction: float = 0.15
    cluster_gap: int = 10

    jitter_sigma: float = 0.01
    frame_repeat_prob: float = 0.10
    group_dropout_prob: float = 0.05
    crop_fraction: float = 0.10
    mirror_prob: float = 0.0
    augment_copies: int = 1

    confidence_threshold: float = 0.38
    smart_min_prob: float = 0.28
    smart_min_margin: float = 0.08
    idle_min_presence: float = 0.18
    idle_min_motion: float = 0.008
    vote_window: int = 3
    min_votes: int = 2
    stable_after: int = 3
    cooldown_seconds: float = 3.0
    suppress_duplicates: bool = True
    uncertain: str = "UNCERTAIN"
    idle: str = "IDLE"

    session_idle_seconds: int = 900
    frame_gap_ms: int = 20
    hand_loss_frames: int = 15
    rate_window_seconds: int = 60
    rate_limit: int = 240
    latency_window: int = 200

    models: tuple[str, ...] = ("lstm", "gru", "gru_mha")
    default_model: str = "gru_mha"
    threshold_delta: float = 0.2
    calibration_min_samples: int = 20
    calibration_val_fraction: float = 0.2

    #: Upper bound on the bytes of a fitted model that travels with the tasks.
    max_model_bytes: int = 268_435_456
    #: Width of the time slices that split a long session over many tasks.
    session_slice_seconds: int = 3600

    @property
    def input_width(self) -> int:
        return self.layout.width + (self.layout.landmarks if self.with_mask else 0)
