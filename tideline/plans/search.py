"""Genetic search for the features' scales. A generation is scored together by one callable, so one Spark job can serve it."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass

Genes = tuple[int, ...]


@dataclass(frozen=True)
class SearchConfig:
    population: int = 20
    step: int = 2
    mutation: float = 0.3
    elite: float = 0.3
    generations: int = 10
    maximise: bool = True
    seed: int = 1
    floor_from: int = 6  # genes from this one on start at `floor` or more
    floor: int = 10


def initial(domain: Sequence[int], config: SearchConfig, rng: random.Random) -> list[Genes]:
    low = lambda j: 0 if j < config.floor_from else min(config.floor, domain[j])
    return [tuple(rng.randint(low(j), domain[j]) for j in range(len(domain))) for _ in range(config.population)]


def mutate(genes: Genes, domain: Sequence[int], step: int, rng: random.Random) -> Genes:
    """One gene a step down (half of the time, if it can) or up, kept within 0..domain."""
    out, j = list(genes), rng.randrange(len(genes))
    down = rng.random() < 0.5 and out[j] >= step
    out[j] = out[j] - step if down else min(domain[j], out[j] + step)
    return tuple(out)


def crossover(a: Genes, b: Genes, rng: random.Random) -> Genes:
    """The first genes of a and the rest of b, cut once inside."""
    cut = rng.randint(1, max(1, len(a) - 2))
    return a[:cut] + b[cut:]


def ranked(scored: Sequence[tuple[float, Genes]], maximise: bool) -> list[tuple[float, Genes]]:
    return sorted(scored, key=lambda x: (-x[0] if maximise else x[0], x[1]))


def next_generation(scored: Sequence[tuple[float, Genes]], domain: Sequence[int], config: SearchConfig, rng: random.Random) -> list[Genes]:
    best = [g for _, g in ranked(scored, config.maximise)][: max(1, round(config.elite * config.population))]
    out = list(best)
    while len(out) < config.population:
        if rng.random() < config.mutation:
            out.append(mutate(rng.choice(best), domain, config.step, rng))
        else:
            out.append(crossover(rng.choice(best), rng.choice(best), rng))
    return out


def search(score: Callable[[list[Genes]], list[float]], domain: Sequence[int], config: SearchConfig = SearchConfig()) -> list[tuple[float, Genes]]:
    """The last generation's scores and genes, best first. An error in score ends the search."""
    rng = random.Random(config.seed)
    population = initial(domain, config, rng)
    known: dict[Genes, float] = {}
    for k in range(config.generations):
        new = [g for g in dict.fromkeys(population) if g not in known]
        known |= dict(zip(new, score(new), strict=True)) if new else {}
        if k + 1 < config.generations:
            population = next_generation([(known[g], g) for g in population], domain, config, rng)
    return ranked([(known[g], g) for g in dict.fromkeys(population)], config.maximise)
