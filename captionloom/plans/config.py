"""Configuration: a TOML file, checked whole before anything runs. Driver-side only."""

from __future__ import annotations

import copy
import math
import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from captionloom.operators.cues import Policy

JOB_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}")
SUBTITLE_FORMATS = {"srt", "vtt"}
CONTAINERS = {"mp4", "mkv"}
LANGUAGES = ("pt-BR", "en")

#: (section, key, kind, low, high): numbers that must be finite and within bounds, bounds included unless `above`.
NUMBERS = (
    ("media", "audio_sample_rate", int, 1, None), ("media", "audio_channels", int, 1, None), ("media", "asr_chunk_seconds", int, 1, None), ("media", "representative_clip_seconds", float, "above 0", None), ("translation", "batch_size", int, 1, None),
    *[("quality", k, float, 0, 1) for k in ("min_number_recall", "min_glossary_term_recall", "min_timing_iou", "minimum_translation_coverage", "minimum_confidence", "minimum_burned_frame_difference_ratio")],
    *[("quality", k, float, 0, None) for k in ("max_wer", "max_cer", "max_duration_drift_seconds")], ("quality", "smoke_decode_seconds", float, "above 0", None), ("quality", "frame_sample_count", int, 1, None),
    ("subtitles", "max_chars_per_line", int, 1, 80), ("subtitles", "max_lines", int, 1, 3), ("subtitles", "max_chars_per_second", float, "above 0", None), ("subtitles", "min_cue_seconds", float, "above 0", None), ("subtitles", "max_cue_seconds", float, "above 0", None), ("subtitles", "minimum_gap_seconds", float, 0, None),
)
#: What a key is if the file leaves it out.
DEFAULTS = {("media", "audio_sample_rate"): 16000, ("media", "audio_channels"): 1, ("media", "asr_chunk_seconds"): 600, ("media", "representative_clip_seconds"): 45, ("media", "representative_clip_positions"): [0.12, 0.50, 0.82], ("translation", "batch_size"): 40, ("asr", "mode"): "evaluate", ("render", "soft_container"): "mp4"}


class ConfigError(ValueError):
    """A configuration that cannot be used."""


@dataclass(frozen=True)
class Config:
    path: Path
    jobs_root: Path
    source_language: str
    target_language: str
    policy: Policy
    data: dict[str, Any] = field(repr=False)

    def section(self, name: str) -> dict[str, Any]:
        """A copy of a section; empty if there is none."""
        return copy.deepcopy(self.data.get(name, {}))

    @property
    def single(self) -> bool:
        return self.data["asr"].get("mode", DEFAULTS["asr", "mode"]) == "single"


def resolve(raw: str, config: Path) -> Path:
    """A path with ~ and variables expanded, relative to the configuration's folder."""
    p = Path(os.path.expandvars(raw)).expanduser()
    return (p if p.is_absolute() else config.parent / p).resolve()


def _number(value: Any, kind: type, low: Any, high: float | None, name: str) -> float:
    good = not isinstance(value, bool) and isinstance(value, int if kind is int else int | float) and math.isfinite(value)
    if good and low is not None:
        good = value > 0 if low == "above 0" else value >= low
    if not good or high is not None and value > high:
        raise ConfigError(f"{name} is out of bounds")
    return value


def load_config(path: str | os.PathLike, repo_root: str | os.PathLike | None = None) -> Config:
    """Read and check a configuration; jobs may not live inside `repo_root`."""
    at = Path(path).expanduser().resolve()
    try:
        data = tomllib.loads(at.read_text(encoding="utf-8"))
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise ConfigError("the configuration cannot be read") from e
    if data.get("schema_version", 1) != 1:
        raise ConfigError("unknown schema_version")
    for name in ("paths", "languages", "media", "asr", "translation", "quality", "subtitles", "render"):
        if not isinstance(data.get(name), dict):
            raise ConfigError(f"section {name} is missing")
    get = lambda s, k: data[s].get(k, DEFAULTS.get((s, k)))
    root = resolve(str(data["paths"].get("jobs_root", "")), at)
    if repo_root is not None and root.is_relative_to(Path(repo_root).resolve()):
        raise ConfigError("paths.jobs_root is inside the repository")
    languages = (data["languages"].get("source"), data["languages"].get("target"))
    if languages != LANGUAGES:
        raise ConfigError("languages are not supported")
    for section, key, kind, low, high in NUMBERS:
        _number(get(section, key), kind, low, high, f"{section}.{key}")
    positions = get("media", "representative_clip_positions")
    if not isinstance(positions, list) or not positions or len(set(positions)) != len(positions):
        raise ConfigError("media.representative_clip_positions must be a list of different numbers")
    for p in positions:
        _number(p, float, 0, 1, "media.representative_clip_positions")
    candidates = data["asr"].get("candidates")
    mode = get("asr", "mode")
    if mode not in ("single", "evaluate") or not isinstance(candidates, list) or not all(isinstance(c, str) and c.strip() for c in candidates) or len(set(candidates)) != len(candidates):
        raise ConfigError("asr.mode or asr.candidates is not valid")
    if len(candidates) != 1 if mode == "single" else len(candidates) < 2:
        raise ConfigError("asr.candidates does not suit asr.mode")
    if mode == "evaluate" and data["asr"].get("winner_primary_metric", "wer") != "wer":
        raise ConfigError("asr.winner_primary_metric must be wer")
    providers = data.get("providers", {})
    for name in (*candidates, data["translation"].get("provider")):
        if not isinstance(providers.get(name) if isinstance(name, str) else None, dict):
            raise ConfigError(f"no provider table for {name}")
    s = data["subtitles"]
    if s["min_cue_seconds"] > s["max_cue_seconds"] or set(s.get("formats", [])) != SUBTITLE_FORMATS:
        raise ConfigError("subtitles are not valid")
    if get("render", "soft_container") not in CONTAINERS:
        raise ConfigError("render.soft_container is not valid")
    policy = Policy(**{k: s[k] for k in Policy.__dataclass_fields__})
    return Config(at, root, *languages, policy, data)


def check_job_id(job_id: str) -> str:
    if not JOB_ID.fullmatch(job_id):
        raise ConfigError("the job id is not valid")
    return job_id
