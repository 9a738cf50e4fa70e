"""Parameters of the token streams. Nothing below is hard-coded in an operator."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class StreamConfig:
    """Ids, delays and lengths. Stream 0 is text, the others are audio codebooks; the main speaker's come first."""

    frame_rate: float = 12.5
    text_padding_id: int = 3
    end_of_text_padding_id: int = 0
    text_initial_id: int = 32000
    audio_initial_id: int = 2048
    zero_id: int = -1
    codebooks: int = 8
    delays: tuple[int, ...] = (0, 0, 1, 1, 1, 1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 1, 1)
    max_length: int | None = 64
    min_length: int | None = 16
    batch_size: int = 4
    logging_steps: int = 10
    text_padding_weight: float = 0.5
    semantic_weight: float = 100.0
    acoustic_weight: float = 1.0

    @property
    def frame_seconds(self) -> float:
        return 1.0 / self.frame_rate

    @property
    def initial_ids(self) -> list[int]:
        return [self.text_initial_id] + [self.audio_initial_id] * (len(self.delays) - 1)

    @property
    def padding_ids(self) -> list[int]:
        return [self.text_padding_id] + [self.audio_initial_id] * (len(self.delays) - 1)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> StreamConfig:
        data = json.loads(text)
        known = {f.name for f in fields(cls)}
        if unknown := set(data) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})

    def differs_from(self, saved: StreamConfig, ignore: tuple[str, ...] = ()) -> list[str]:
        """Settings that a resumed run has changed; ``ignore`` may change."""
        mine, theirs = asdict(self), asdict(saved)
        return sorted(k for k in mine if k not in ignore and mine[k] != theirs[k])


DEFAULT = StreamConfig()
