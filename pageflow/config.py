"""Settings, their derived thresholds, and their file."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields

DERIVED = {"correct_size", "fit_char_ratio", "char_weight", "shrink", "growth", "fallback", "low_confidence", "low_margin", "least_expressive", "views"}


@dataclass
class Settings:
    """Derived values follow from the modes and are never stored."""

    input_dir: str = "input"
    output_dir: str = "output"
    confidence: float = 0.35
    merge_overlap: float = 0.2
    batch_pages: int = 50
    history: int = 6
    edge_margin: int = 10
    bubble_padding: float = 0.10
    attached_margin: int = 5
    free_confidence: float = 0.70
    context_padding: int = 50
    mask_padding: int = 3
    bubble_mask_padding: int = 8
    size_mode: str = "strong"
    tolerance: float = 0.2
    fallback_mode: str = "strict"
    view_mode: str = "accurate"
    least_size: int = 5
    most_size: int = 80
    fill_colour: tuple[int, int, int] = (0, 0, 0)
    stroke_colour: tuple[int, int, int] = (255, 255, 255)
    api_key: str = ""
    correct_size: bool = field(init=False)
    fit_char_ratio: bool = field(init=False)
    char_weight: float = field(init=False)
    shrink: float = field(init=False)
    growth: float = field(init=False)
    fallback: bool = field(init=False)
    low_confidence: float = field(init=False)
    low_margin: float = field(init=False)
    least_expressive: float = field(init=False)
    views: int = field(init=False)

    def __post_init__(self):
        if self.least_size >= self.most_size:
            raise ValueError("least_size must be under most_size")
        self.derive()

    def derive(self) -> None:
        mode = (self.size_mode or "strong").lower()
        self.correct_size = self.fit_char_ratio = mode != "off"
        self.char_weight = 25.0 if mode == "light" else 42.0
        t = max(0.05, min(0.5, float(self.tolerance)))
        self.shrink, self.growth = round(1 - t, 3), round(1 + t, 3)
        mode = (self.fallback_mode or "strict").lower()
        self.fallback = mode != "off"
        self.low_confidence, self.low_margin, self.least_expressive = (0.15, 0.02, 0.40) if mode == "loose" else (0.24, 0.04, 0.55)
        self.views = {"off": 1, "fast": 2}.get((self.view_mode or "accurate").lower(), 3)

    def stored(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items() if k not in DERIVED}

    def update(self, values: dict) -> None:
        """Takes known settings; derived and unknown names are left out, lists become tuples."""
        for f in fields(self):
            if f.name in values and f.name not in DERIVED:
                value = values[f.name]
                setattr(self, f.name, tuple(value) if isinstance(value, list) else value)
        self.derive()

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as file:
            json.dump(self.stored(), file, ensure_ascii=False, indent=2)

    def key(self, variable: str = "PAGEFLOW_API_KEY") -> str:
        """The key of the environment, else the stored one, without outer blanks."""
        return os.environ.get(variable, "").strip() or self.api_key.strip()


def load(path: str) -> Settings:
    settings = Settings()
    if os.path.exists(path):
        with open(path, encoding="utf-8") as file:
            settings.update(json.load(file))
    return settings
