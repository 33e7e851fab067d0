"""Media tools: FFmpeg and FFprobe as external processes, one file at a time, outside the query path.

Each function builds its command first, so that a plan can be read without running anything. Failures
raise MediaError without the tool's output, which may hold paths.
"""

from __future__ import annotations

import json
import subprocess
from pathlib import Path

import numpy as np

from captionloom.plans.engine import MediaError

QUIET = ["-hide_banner", "-loglevel", "error", "-nostdin", "-y"]


def run(command: list[str], timeout: float | None = None) -> str:
    try:
        done = subprocess.run(command, capture_output=True, text=True, timeout=timeout, check=False)
    except (OSError, subprocess.TimeoutExpired) as e:
        raise MediaError(f"{command[0]} could not be run") from e
    if done.returncode:
        raise MediaError(f"{command[0]} failed")
    return done.stdout


def tool_version(tool: str) -> str:
    try:
        return run([tool, "-version"]).splitlines()[0][:160]
    except (MediaError, IndexError):
        return "unavailable"


def probe(path: str) -> dict:
    """FFprobe's JSON for a file; plans.ledger.media_durations() reads it."""
    return json.loads(run(["ffprobe", "-v", "error", "-print_format", "json", "-show_format", "-show_streams", path]))


def probe_summary(value: dict) -> dict:
    """duration and, for each stream, its index, type, codec, size and language."""
    streams = value.get("streams", [])
    lengths = [float(d) for d in (value.get("format", {}).get("duration"), *(s.get("duration") for s in streams)) if d is not None]
    own = value.get("format", {}).get("duration")
    duration = float(own) if own is not None else max(lengths, default=0.0)
    if not np.isfinite(duration) or duration <= 0:
        raise MediaError("the media has no duration")
    keep = ("index", "codec_type", "codec_name", "width", "height")
    return {"duration": duration, "streams": [{k: s[k] for k in keep if k in s} | ({"language": s["tags"]["language"]} if s.get("tags", {}).get("language") else {}) for s in streams]}


def normalize_command(source: str, to: str, rate: int = 16_000, channels: int = 1) -> list[str]:
    """First audio stream as PCM."""
    return ["ffmpeg", *QUIET, "-i", source, "-map", "0:a:0", "-vn", "-ar", str(rate), "-ac", str(channels), "-c:a", "pcm_s16le", to]


def clip_command(source: str, to: str, start: float, length: float) -> list[str]:
    """A stretch of audio as FLAC; the whole of it with start 0 and no length limit is what an extraction is."""
    return ["ffmpeg", *QUIET, "-ss", f"{start:.3f}", *(["-t", f"{length:.3f}"] if length > 0 else []), "-i", source, "-map", "0:a:0", "-vn", "-c:a", "flac", to]


def split_command(source: str, pattern: str, seconds: int) -> list[str]:
    return ["ffmpeg", *QUIET, "-i", source, "-map", "0:a:0", "-vn", "-c:a", "flac", "-f", "segment", "-segment_time", str(seconds), "-reset_timestamps", "1", pattern]


def chunk_files(folder: str, stem: str = "chunk-") -> list[Path]:
    """Chunks in order of their numbers, however many digits those have."""
    return sorted(Path(folder).glob(f"{stem}*.flac"), key=lambda p: int(p.stem.removeprefix(stem)))


def mux_command(source: str, srt: str, to: str, language: str = "eng") -> list[str]:
    """Video and audio copied, captions as a track that players show by default."""
    codec = "mov_text" if to.lower().endswith(".mp4") else "srt"
    return ["ffmpeg", *QUIET, "-i", source, "-i", srt, "-map", "0:v", "-map", "0:a?", "-map", "1:0", "-c", "copy", "-c:s", codec, "-metadata:s:s:0", f"language={language}", "-disposition:s:0", "default", to]


def mux(source: str, srt: str, to: str) -> str:
    """mux_command(), as MKV if the container asked for cannot hold the source's streams."""
    try:
        run(mux_command(source, srt, to))
        return to
    except MediaError:
        Path(to).unlink(missing_ok=True)
        other = str(Path(to).with_suffix(".mkv"))
        if other == to:
            raise
        run(mux_command(source, srt, other))
        return other


def burn_command(source: str, srt: str, to: str, audio: str = "copy") -> list[str]:
    """Captions drawn into the picture."""
    escaped = srt.replace("\\", "\\\\").replace(":", "\\:").replace("'", "\\'")
    return ["ffmpeg", *QUIET, "-i", source, "-vf", f"subtitles='{escaped}'", "-map", "0:v:0", "-map", "0:a?", "-c:v", "libx264", "-c:a", audio, to]


def burn(source: str, srt: str, to: str) -> None:
    """burn_command(), with AAC audio if the source's cannot be copied."""
    try:
        run(burn_command(source, srt, to))
    except MediaError:
        run(burn_command(source, srt, to, "aac"))


def decodes(path: str, seconds: float) -> bool:
    """Whether the first seconds of a file decode without an error."""
    try:
        run(["ffmpeg", *QUIET, "-xerror", "-t", f"{seconds:.3f}", "-i", path, "-f", "null", "-"])
    except MediaError:
        return False
    return True


def frame_command(path: str, at: float, to: str) -> list[str]:
    """One frame; operators.cues.frame_sample() picks the times."""
    return ["ffmpeg", *QUIET, "-ss", f"{at:.3f}", "-i", path, "-frames:v", "1", to]


def lower_difference(a: np.ndarray, b: np.ndarray, above: float = 0.45, least: int = 25) -> float:
    """Share of channel values below the upper `above` of two RGB pictures that differ by `least` or more."""
    if a.shape != b.shape:
        raise MediaError("the frames differ in size")
    rows = slice(int(a.shape[0] * above), None)
    return float((np.abs(a[rows].astype(np.int16) - b[rows].astype(np.int16)) >= least).mean())
