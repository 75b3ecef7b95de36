"""Run configuration: all knobs, their defaults, validation and the settings hash."""

from __future__ import annotations

import hashlib
import json
import sys
from dataclasses import asdict, dataclass, fields

PROBES = ("measure_gk", "branch_lrs", "adjacency_probe")


@dataclass(frozen=True)
class RunConfig:
    modality: str = "text"
    mode: str = "both"
    model: str = "order0"
    data: str = "documents"
    max_bytes: int = 10_000
    chunk_size: int = 512
    max_seq_len: int | None = None
    batch_chunks: int = 4
    train_interval: int = 4
    epochs_per_train: int = 3
    lr: float = 5e-5
    lora_r: int = 16
    lora_alpha: int = 32
    lora_dropout: float = 0.0
    weight_decay: float = 0.1
    grad_clip: float = 1.0
    base_seed: int = 42
    train_on_all: bool = False
    shuffle_seed: int | None = None
    image_px: int = 32
    image_crop: int = 0
    image_count: int = 1
    chunk_ms: int = 250
    audio_clips: int = 1
    max_chunks: int | None = None
    no_decompress: bool = False
    measure_gk: bool = False
    branch_lrs: tuple[float, ...] = ()
    branch_ref_lr: float | None = None
    ctx_tokens: int = 0
    adjacency_probe: bool = False
    adj_h_max: int = 8
    adj_k: int = 4
    adj_n: int = 128
    adj_seed: int = 0

    def __post_init__(self) -> None:
        problems = []
        if self.modality not in ("text", "image", "audio"):
            problems.append(f"modality {self.modality!r} is none of text, image, audio")
        if self.mode not in ("static", "online", "both"):
            problems.append(f"mode {self.mode!r} is none of static, online, both")
        for name in ("chunk_size", "batch_chunks", "train_interval", "epochs_per_train"):
            if getattr(self, name) < 1:
                problems.append(f"{name} must be positive")
        on = [p for p in PROBES if getattr(self, p)]
        if len(on) > 1:
            problems.append(f"probes exclude each other: {', '.join(on)}")
        if on and self.ctx_tokens:
            problems.append(f"{on[0]} cannot be combined with ctx_tokens")
        if problems:
            raise ValueError("; ".join(problems))

    @property
    def window(self) -> int:
        """Length of training windows: that of a chunk unless set."""
        return self.max_seq_len or self.chunk_size

    @property
    def reference_lr(self) -> float:
        return self.lr if self.branch_ref_lr is None else self.branch_ref_lr

    @classmethod
    def load(cls, text: str, **explicit) -> RunConfig:
        """Defaults, then the JSON object, then explicit options; unknown keys are errors, values take the option's type."""
        given = json.loads(text)
        kinds = {f.name: f.type for f in fields(cls)}
        if unknown := sorted((given.keys() | explicit.keys()) - kinds.keys()):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        out = {}
        for k, v in (given | explicit).items():
            kind = kinds[k]
            if v is not None and kind.startswith("int"):
                v = int(v)
            elif v is not None and kind.startswith("float"):
                v = float(v)
            elif kind == "bool":
                v = v if isinstance(v, bool) else str(v).lower() in ("1", "true", "yes", "on")
            elif kind.startswith("tuple"):
                v = tuple(map(float, v))
            out[k] = v
        return cls(**out)

    def settings(self, role: str) -> dict:
        """What a decoder must share: a static run only its grouping, an online run everything; optional parts only if set."""
        out = {"batch_chunks": self.batch_chunks} if role == "static" else {k: v for k, v in asdict(self).items() if k not in ("shuffle_seed", "ctx_tokens")}
        if self.shuffle_seed is not None:
            out["shuffle_seed"] = self.shuffle_seed
        if self.ctx_tokens:
            out["ctx_tokens"] = self.ctx_tokens
        return out

    @staticmethod
    def environment() -> dict:
        """What can change a coder's arithmetic: the versions that a decoder must share."""
        import platform

        import numpy

        return {"python": platform.python_version(), "numpy": numpy.__version__, "byte_order": sys.byteorder}

    def settings_hash(self, role: str) -> str:
        return settings_hash(self.settings(role))


def settings_hash(settings: dict) -> str:
    """First 16 hex digits of the SHA-256 of key-sorted JSON."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]
