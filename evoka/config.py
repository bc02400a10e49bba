"""Fixed values of an event-locked experiment."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Window:
    """A time window in seconds; closed unless ``half_open``."""

    name: str
    low: float
    high: float
    half_open: bool = False


@dataclass(frozen=True)
class Settings:
    channels: tuple[str, ...] = ("Fz", "F3", "F4")
    sample_rate: float = 256.0
    rail: float = 999.999
    epoch_s: tuple[float, float] = (-0.5, 1.0)
    baseline: Window = Window("baseline", -0.2, 0.0, half_open=True)
    artifact: Window = Window("artifact", -0.2, 0.8)
    mad_scale: float = 1.4826
    mad_multiple: float = 6.0
    least_threshold_trials: int = 20
    filter_order: int = 4
    band_hz: tuple[float, float] = (0.5, 30.0)
    curve_windows: tuple[Window, ...] = (Window("early_250_500ms", 0.25, 0.5), Window("late_550_900ms", 0.55, 0.9), Window("full_200_900ms", 0.2, 0.9))
    compare: Window = Window("compare_0_900ms", 0.0, 0.9)
    coupling_full: Window = Window("full_0_900ms", 0.0, 0.9)
    spectral_baseline: Window = Window("spectral_baseline", -0.5, 0.0, half_open=True)
    huber_c: float = 1.345
    huber_iterations: int = 30
    huber_tolerance: float = 1e-7
    smooth_s: float = 0.12
    smooth_order: int = 3
    n_curve_bootstraps: int = 500
    n_permutations: int = 5000
    n_difference_bootstraps: int = 2000
    n_model_permutations: int = 2000
    n_model_bootstraps: int = 2000
    bands: tuple[tuple[str, float, float], ...] = (("delta_1_4Hz", 1.0, 4.0), ("theta_4_8Hz", 4.0, 8.0), ("alpha_8_13Hz", 8.0, 13.0), ("beta_13_30Hz", 13.0, 30.0))
    pairs: tuple[tuple[str, str], ...] = (("Fz", "F3"), ("Fz", "F4"), ("F3", "F4"))
    max_lag_s: float = 0.080
    penalties: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)
    n_selected: tuple[int, ...] = (10, 20, 30)
    n_folds: int = 5
    epsilon: float = 1e-12
    seed: int = 20260924
    tasks: tuple[str, ...] = field(default=("Task-1", "Task-2"))
    # What a recording's file name holds, and what that says; the
    # first that fits counts, and the last is for all other names.
    subject_marks: tuple[tuple[str, str], ...] = (("CogA", "A"), ("", "B"))
    task_marks: tuple[tuple[str, str], ...] = (("Task-1", "Task-1"), ("", "Task-2"))

    @property
    def epoch_offsets(self) -> tuple[int, int]:
        """First sample of an epoch and the one after its last, by the cue."""
        return round(self.epoch_s[0] * self.sample_rate), round(self.epoch_s[1] * self.sample_rate)

    def times(self) -> list[float]:
        low, high = self.epoch_offsets
        return [k / self.sample_rate for k in range(low, high)]
