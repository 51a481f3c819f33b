"""Synthetic response sets with known diversity, for tests and experiments. Same seed, same texts."""

from __future__ import annotations

import random
import re
import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SUBJECTS = "baker pilot nurse poet miner sailor judge clerk guard tailor".split()
VERBS = "paints follows repairs praises hides counts lifts sells weighs names".split()
THINGS = "lantern bridge orchard engine violin ledger anchor kettle ladder compass".split()
PLACES = "harbour valley market tower meadow station cellar island garden quarry".split()

#: Sentence frames with slots; each is one mode.
FRAMES = [
    "The {s} {v} the {t} near the {p}.", "Near the {p}, a {s} {v} one {t}.", "Why the {s} {v} a {t}, nobody at the {p} knows.", "List: {t}, {p}, {s}.",
    "If a {t} breaks, the {s} {v} it by the {p}.", "Dear {s}, bring the {t} to the {p}.", "{t}? The {s} of the {p} {v} it daily.", "No {t} without a {s}; no {s} without a {p}.",
    "Step one: find the {p}. Step two: see how the {s} {v} the {t}.", "Rumour says the {p} has a {t} that the {s} {v}.", "{s} plus {t} equals {p}.", "Once, at the {p}, a {s} lost a {t}.",
    "The price of a {t} at the {p} worries the {s}.", "A {s} never {v} a {t} twice.", "Q: who {v} the {t}? A: the {s} of the {p}.",
]


def fill(frame: str, rng: random.Random) -> str:
    """A frame with every slot filled; an unknown slot is an error."""
    pools = {"s": SUBJECTS, "v": VERBS, "t": THINGS, "p": PLACES}
    out = re.sub(r"\{(\w+)\}", lambda m: rng.choice(pools[m[1]]), frame)
    return out[0].upper() + out[1:]


def noise(n: int, seed: int) -> list[str]:
    """Random printable text of 60 to 100 characters."""
    rng = random.Random(seed)
    letters = string.ascii_letters + string.digits + string.punctuation + " "
    return ["".join(rng.choices(letters, k=rng.randint(60, 100))) for _ in range(n)]


def incoherent_modes(n: int, seed: int) -> list[str]:
    """Four kinds of garbage in turn: digits, one repeated word, symbols, shuffled words."""
    rng = random.Random(seed)
    kinds: list[Callable[[], str]] = [
        lambda: "".join(rng.choices(string.digits, k=70)),
        lambda: " ".join([rng.choice(THINGS)] * 12),
        lambda: "".join(rng.choices(string.punctuation, k=70)),
        lambda: " ".join(rng.choices(SUBJECTS + VERBS + PLACES, k=12)),
    ]
    return [kinds[i % 4]() for i in range(n)]


def mode_count(m: int, n: int, seed: int) -> list[str]:
    """n texts of m random frames, each at least once, in random order; more modes than texts or frames is an error."""
    if not 1 <= m <= min(n, len(FRAMES)):
        raise ValueError(f"{m} modes for {n} texts of {len(FRAMES)} frames")
    rng = random.Random(seed)
    frames = rng.sample(FRAMES, m)
    picked = frames + [rng.choice(frames) for _ in range(n - m)]
    rng.shuffle(picked)
    return [fill(f, rng) for f in picked]


def unique_templates(n: int, seed: int, frames: int = len(FRAMES), tries: int = 1000) -> list[str]:
    """n different texts over the first `frames` frames in turn; an error if there are not so many."""
    rng = random.Random(seed)
    out: dict[str, None] = {}
    for i in range(n):
        for _ in range(tries):
            text = fill(FRAMES[i % frames], rng)
            if text not in out:
                out[text] = None
                break
        else:
            raise ValueError(f"no {n} different texts of {frames} frames")
    return list(out)


def scrambled(texts: list[str], seed: int) -> list[str]:
    """The control: each text's words in random order."""
    rng = random.Random(seed)
    out = []
    for text in texts:
        words = text.split()
        rng.shuffle(words)
        out.append(" ".join(words))
    return out


def grid(spark: SparkSession, conditions: dict[str, Callable[[int], list[str]]], draws: int, prompt: str = "") -> DataFrame:
    """condition, draw, k (from 1), prompt, response: every condition drawn several times, the draw being its seed."""
    rows = [(name, d, k + 1, prompt, text) for name, make in conditions.items() for d in range(draws) for k, text in enumerate(make(d))]
    return spark.createDataFrame(rows, "condition string, draw long, k long, prompt string, response string")
