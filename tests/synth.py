"""Four recordings with planted cues, events, rails and effects."""

from __future__ import annotations

import numpy as np
import pandas as pd

RATE, SECONDS = 256, 200
N = RATE * SECONDS


def recording(subject: str, task: str, seed: int):
    """(samples, facts): a cue every 5 s, alternating sides; trial 3 has no
    target, trial 5 two, trial 7 one of the wrong side; trials 10 and 11 are
    at the rail; trial 20 has a spike; the first cue is too near to the start."""
    rng = np.random.default_rng(seed)
    t = np.arange(N) / RATE
    signal = {c: 5 * np.sin(2 * np.pi * 10 * t + rng.uniform(0, 6)) + 3 * np.sin(2 * np.pi * 60 * t) + 20 * np.sin(2 * np.pi * 0.05 * t) + rng.normal(0, 2, N) for c in ("Fz", "F3", "F4")}
    cue, event = np.zeros(N), np.zeros(N)
    starts = [60] + [RATE * 5 * k for k in range(1, SECONDS // 5 - 1)]
    for k, s in enumerate(starts, 1):
        side = 1 if k % 2 else -1
        cue[s : s + 64] = side
        if k != 3:
            wrong = -1 if k == 7 else 1
            event[s + 300 : s + 340] = side * wrong
            if k == 5:
                event[s + 360 : s + 380] = side
            if task == "Task-2":
                event[s + 420] = 2 * side * wrong
        bump = np.exp(-((np.arange(256) - 90) ** 2) / 800) * (14 if side > 0 else 6)
        signal["F4"][s : s + 256] += bump
        if k in (10, 11):
            signal["F3"][s + 20 : s + 26] = 1000
        if k == 20:
            signal["Fz"][s + 50 : s + 60] += 600
    rows = {**signal, "cue": cue, "event": event, "timestamp": t}
    name = f"Cog{subject}_{task}.mat"
    samples = pd.concat([pd.DataFrame({"file_name": name, "channel": c, "sample_idx": np.arange(N), "value": v}) for c, v in rows.items()])
    return samples, (name, subject, task, float(RATE), N), len(starts)


def experiment():
    made = [recording(s, t, i) for i, (s, t) in enumerate((s, t) for s in "AB" for t in ("Task-1", "Task-2"))]
    facts = pd.DataFrame([m[1] for m in made], columns=["file_name", "subject", "task", "sample_rate_hz", "n_samples"])
    return pd.concat([m[0] for m in made]), facts, made[0][2]
