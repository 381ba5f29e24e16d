"""Numeric column functions for levels, frequencies and frame arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE_RATE = 16_000
EPS = 1e-12


def rtf(latency_ms: Column, audio_s: Column) -> Column:
    """Real-time factor: seconds of computing for a second of audio."""
    return (latency_ms / 1000) / F.greatest(audio_s, F.lit(1e-6))


def frame_count(seconds: Column, length: int = 400, hop: int = 160) -> Column:
    """Complete frames of a clip; 0 if it is shorter than one frame."""
    return F.greatest(F.lit(0), 1 + F.floor((F.floor(seconds * SAMPLE_RATE) - length) / hop)).cast("long")


def conv_length(frames: Column) -> Column:
    """Frames after two stride-2 stages of three taps each; never below 0."""
    once = F.floor((frames - 1) / 2)
    return F.greatest(F.lit(0), F.floor((once - 1) / 2)).cast("long")


def half_length(frames: Column) -> Column:
    return F.floor((frames + 1) / 2).cast("long")


def hz_to_mel(hz: Column) -> Column:
    return F.lit(2595.0) * F.log10(1 + hz / 700)


def mel_to_hz(mel: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), mel / 2595) - 1)


def level_db(rms: Column) -> Column:
    return 20 * F.log10(rms + EPS)


def gain(db: Column) -> Column:
    """The factor of an attenuation in dB."""
    return F.pow(F.lit(10.0), -db / 20)


def clip(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def hann_symmetric(i: Column, length: int) -> Column:
    """The window over length - 1 intervals, as features use it."""
    return 0.5 - 0.5 * F.cos(2 * math.pi * i / (length - 1))


def hann_periodic_sqrt(i: Column, length: int) -> Column:
    """The square root of the periodic window, as enhancement uses it twice."""
    return F.sqrt(0.5 - 0.5 * F.cos(2 * math.pi * i / length))
