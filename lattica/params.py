"""Command-line parameters."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields

COMMANDS = ("walkEmbedding", "randomwalk", "embedding", "linkPredict", "partition")


@dataclass
class Params:
    iter: int = 10
    lr: float = 0.025
    dim: int = 128
    window: int = 10
    minCount: int = 0
    walkLength: int = 80
    numWalks: int = 10
    p: float = 1.0
    q: float = 1.0
    weighted: bool = True
    directed: bool = False
    indexed: bool = True
    nodePath: str | None = None
    input: str | None = None
    output: str | None = None
    partitions: int = 10
    cmd: str = "walkEmbedding"
    partitioner: str = "lpt"


def _truth(x: str) -> bool:
    if x.lower() not in ("true", "false"):
        raise argparse.ArgumentTypeError("true or false")
    return x.lower() == "true"


def parse(args: list[str]) -> Params:
    """input, output and cmd are required."""
    at = argparse.ArgumentParser(prog="lattica")
    choices = {"cmd": COMMANDS, "partitioner": ("ldg", "lpt")}
    for f in fields(Params):
        kind = _truth if isinstance(f.default, bool) else type(f.default) if f.default is not None else str
        at.add_argument(f"--{f.name}", type=kind, default=f.default, choices=choices.get(f.name), required=f.name in ("input", "output", "cmd"))
    return Params(**vars(at.parse_args(args)))
