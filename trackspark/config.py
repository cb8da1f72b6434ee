"""Settings of both levels, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass

from .schema import positive_fps


@dataclass(frozen=True)
class Level1Config:
    fps: float
    min_track_seconds: float = 0.5
    max_gap_frames: int = 10
    smoothing_window: int = 5
    frame_width: int = 640
    frame_height: int = 480

    def __post_init__(self) -> None:
        positive_fps(self.fps)
        if self.min_track_seconds <= 0:
            raise ValueError("min_track_seconds must be positive")
        if self.max_gap_frames < 0:
            raise ValueError("max_gap_frames must not be negative")
        if self.smoothing_window < 1:
            raise ValueError("smoothing_window must be at least 1")
        if self.frame_width <= 0 or self.frame_height <= 0:
            raise ValueError("frame size must be positive")


@dataclass(frozen=True)
class Level2Config(Level1Config):
    min_track_seconds: float = 1.0
    kinematics_window: int = 31
    stop_speed_m_s: float = 0.5
    display_confidence: float = 0.2
    max_objects_per_frame: int = 12
    trail_length: int = 20

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.kinematics_window < 1:
            raise ValueError("kinematics_window must be at least 1")
