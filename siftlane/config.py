"""Settings of a run, checked when they are made."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

#: How a record's distance is found: from its tag; from its tag, else anew; always anew; anew with bisulfite rules.
MODES = ("tag", "tag_or_recompute", "recompute", "bisulfite")
_UNITS = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}
#: Sorting needs so much memory for a worker.
LEAST_MEMORY = 8 << 20


@dataclass(frozen=True)
class Config:
    threshold: int = 4
    unmapped_penalty: int = 8
    nm_tag: str = "NM"
    mode: str = "tag"
    graft_reference: str | None = None
    host_reference: str | None = None

    def __post_init__(self) -> None:
        if self.threshold < 0:
            raise ValueError("the mismatch threshold must not be negative")
        if self.unmapped_penalty < 0:
            raise ValueError("the unmapped penalty must not be negative")
        if not self.nm_tag:
            raise ValueError("the tag's name must not be empty")
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.mode != "tag" and not (self.graft_reference and self.host_reference):
            raise ValueError("recomputing distances needs both reference genomes")


def parse_memory(text: str) -> int:
    """Bytes of a size such as 512M; binary units K, M, G, T in either case. Under 8 MiB is an error."""
    m = re.fullmatch(r"\s*(-?\d+)\s*([KMGT]?)B?\s*", text, re.IGNORECASE)
    if not m:
        raise ValueError(f"not a memory size: {text!r}")
    size = int(m[1]) * _UNITS[m[2].upper()]
    if size < 0:
        raise ValueError(f"a memory size must not be negative: {text!r}")
    if size < LEAST_MEMORY:
        raise ValueError(f"a memory size must be 8 MiB at least: {text!r}")
    return size


def workers_for(memory: int, wanted: int) -> tuple[int, int]:
    """(workers, bytes for each): as many as wanted, one at least, while each has 8 MiB."""
    workers = max(1, min(max(1, wanted), memory // LEAST_MEMORY))
    return workers, memory // workers


def output_name(graft_path: str, custom: str | None = None) -> str:
    """The custom name with .bam, or the input's name with _Filtered.bam."""
    if custom is not None:
        return custom if custom.endswith(".bam") else custom + ".bam"
    return os.path.basename(graft_path).removesuffix(".bam") + "_Filtered.bam"


def output_path(folder: str, name: str) -> str:
    """The place of an output; names that are empty, absolute or lead out of the folder are errors."""
    if not name or not name.strip():
        raise ValueError("an output needs a name")
    if os.path.isabs(name):
        raise ValueError(f"an output's name must be relative: {name}")
    path = os.path.normpath(os.path.join(folder, name))
    if os.path.relpath(path, folder).split(os.sep)[0] == "..":
        raise ValueError(f"an output must stay in its folder: {name}")
    return path


def check_outputs(folder: str, names: list[str]) -> list[str]:
    """Places of all outputs; two that are equal are an error."""
    paths = [output_path(folder, n) for n in names]
    twice = sorted({p for p in paths if paths.count(p) > 1})
    if twice:
        raise ValueError(f"outputs share a place: {', '.join(twice)}")
    return paths


def pair_samples(grafts: list[str], hosts: list[str]) -> list[tuple[str, str]]:
    """Graft and host inputs by position; both lists need one length, not nought."""
    if not grafts:
        raise ValueError("there are no samples")
    if len(grafts) != len(hosts):
        raise ValueError(f"{len(grafts)} graft inputs and {len(hosts)} host inputs")
    return list(zip(grafts, hosts, strict=True))
