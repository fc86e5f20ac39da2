"""Parameters of a run, validated once."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from tessera.functions.cost import COSTS
from tessera.functions.pixel import image_type


#: Names that parameter files use for some of the fields (fixed values).
NAMES = {"resampleTo": "resample_to", "trueBits": "true_bits", "StartLetter": "first_letter"}


@dataclass(frozen=True)
class Params:
    """``res`` and ``pan_res`` in map units; ``true_bits`` the sensor's depth; ``kernel`` the erosion's
    size; ``resample_to`` the factor of the search grid."""

    path_method: str = "a6c_int"
    resample_to: int = 5
    res: float = 6.0
    pan_res: float = 1.5
    true_bits: int = 12
    kernel: int = 61
    canvas_crs: str = "EPSG:3826"
    canvas_x_max: float = 406000.0
    canvas_y_min: float = 2400000.0
    ssim_threshold: float = 0.75
    cloud_tolerance: float = 0.25
    feather: int = 57
    first_letter: str = "a"

    def __post_init__(self) -> None:
        if self.path_method not in COSTS:
            raise ValueError(f"unknown seam cost {self.path_method!r}")
        image_type(self.true_bits)
        if self.res <= 0 or self.pan_res <= 0 or self.resample_to < 1 or self.kernel < 1:
            raise ValueError("sizes must be positive")

    @property
    def pan_factor(self) -> int:
        return int(self.res / self.pan_res)

    @classmethod
    def load(cls, text: str) -> "Params":
        """From a JSON object; values may be strings, unknown keys are ignored."""
        given = {NAMES.get(k, k): v for k, v in json.loads(text).items()}
        kinds = {f.name: type(getattr(cls(), f.name)) for f in fields(cls)}
        return cls(**{k: kinds[k](v) for k, v in given.items() if k in kinds})
