"""Settings of a forecast run, and the command line's way to give them."""

from __future__ import annotations

import argparse
import random
from dataclasses import dataclass, field

HILBERT, ZORDER, GRAY = "hilbert", "zorder", "gray"
CLASSIFY, REGRESS = "classify", "regress"
#: Default scale of each feature, and the largest scale that the search may try.
SCALE = (10, 9, 5, 5, 8, 3, 17, 8, 29, 5)
SCALE_DOMAIN = (10, 10, 10, 10, 10, 50, 50, 50, 10, 10)


@dataclass(frozen=True)
class KnnConfig:
    k: int = 15
    shifts: int = 2
    dimension: int = 10
    classes: int = 2
    epsilon: float = 0.003
    buckets: int = 8
    curve: str = ZORDER
    mode: str = REGRESS
    scale: tuple[int, ...] = SCALE
    scale_domain: tuple[int, ...] = SCALE_DOMAIN
    folds: int = 10
    seed: int = 1
    search: bool = False
    exact: bool = False
    single_file: bool = False
    base_path: str = ""
    vectors: tuple[tuple[int, ...], ...] = field(default=())

    def __post_init__(self):
        if len(self.scale) != self.dimension or len(self.scale_domain) != self.dimension:
            raise ValueError(f"scale and scale_domain need {self.dimension} values each")
        if min(self.k, self.shifts, self.dimension, self.buckets, self.classes, self.folds) < 1 or not 0 < self.epsilon < 1:
            raise ValueError("k, shifts, dimension, buckets, classes and folds are 1 or more, epsilon is between 0 and 1")
        if self.curve not in (HILBERT, ZORDER, GRAY) or self.mode not in (CLASSIFY, REGRESS):
            raise ValueError("unknown curve or mode")
        if not self.vectors:
            object.__setattr__(self, "vectors", shift_vectors(self.shifts, self.dimension, self.seed))


def shift_vectors(shifts: int, dimension: int, seed: int, most: int = 10_000) -> tuple[tuple[int, ...], ...]:
    """The first is zero, the others are uniform in 0..most."""
    rng = random.Random(seed)
    return tuple(tuple(0 if s == 0 else rng.randint(0, most) for _ in range(dimension)) for s in range(shifts))


def parse(argv: list[str]) -> KnnConfig:
    p = argparse.ArgumentParser(prog="tideline")
    d = KnnConfig()
    for name, kind in (("k", int), ("shifts", int), ("dimension", int), ("classes", int), ("epsilon", float), ("buckets", int), ("folds", int), ("seed", int)):
        p.add_argument(f"--{name}", type=kind, default=getattr(d, name))
    p.add_argument("--curve", choices=(HILBERT, ZORDER, GRAY), default=d.curve)
    p.add_argument("--mode", choices=(CLASSIFY, REGRESS), default=d.mode)
    p.add_argument("--scale", type=lambda s: tuple(map(int, s.split(","))))
    for name in ("search", "exact", "single-file"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--base-path", default="")
    a = vars(p.parse_args(argv))
    n = a["dimension"]
    a["scale"] = a["scale"] or (SCALE if n == len(SCALE) else (10,) * n)
    return KnnConfig(**a, scale_domain=SCALE_DOMAIN if n == len(SCALE_DOMAIN) else (50,) * n)
