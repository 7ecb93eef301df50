"""Settings of the three jobs, the folders of a project, and the timing report."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from routescope.functions.duration import printed

# The layout of a project.
PASS_FOLDERS = ("causal", "rerouted", "paper_causal", "paper_rerouted")


@dataclass(frozen=True)
class ProjectFolders:
    """The folders of a project under one root; ``made`` creates them on the local file system."""

    root: str

    @property
    def data(self) -> str:
        return f"{self.root}/data"

    @property
    def results(self) -> str:
        return f"{self.root}/results"

    @property
    def embeddings(self) -> str:
        return f"{self.root}/embeddings"

    @property
    def cache(self) -> str:
        return f"{self.root}/representations"

    def of_pass(self, name: str) -> str:
        if name not in PASS_FOLDERS:
            raise ValueError(f"unknown pass {name}")
        return f"{self.embeddings}/{name}"

    def made(self) -> ProjectFolders:
        for folder in (self.data, self.results, self.cache, *map(self.of_pass, PASS_FOLDERS)):
            Path(folder).mkdir(parents=True, exist_ok=True)
        return self


@dataclass(frozen=True)
class ExtractionPlan:
    """What the planning of an extraction needs; the model itself runs elsewhere."""

    folders: ProjectFolders
    max_length: int = 512
    query_batch: int = 8
    limit_docs: int | None = None
    limit_queries: int | None = None
    layer_sample: int = 1000
    reroute_bias: float = 1.0


@dataclass(frozen=True)
class EvaluationSettings:
    folders: ProjectFolders
    doc_block: int = 2048
    query_block: int = 256
    top: int = 100
    rebuild: bool = False


@dataclass(frozen=True)
class RoutingSettings:
    folders: ProjectFolders
    examples: int = 10
    seed: str = "7"


@dataclass
class Timings:
    """Seconds of each pass over so many texts; ``lines`` is the report."""

    seconds: dict[str, float] = field(default_factory=dict)
    texts: dict[str, int] = field(default_factory=dict)
    peak_bytes: float = 0.0

    def add(self, name: str, seconds: float, texts: int) -> None:
        self.seconds[name] = self.seconds.get(name, 0.0) + seconds
        self.texts[name] = self.texts.get(name, 0) + texts

    def lines(self) -> list[str]:
        out = [f"{n}: total {printed(s)}" for n, s in self.seconds.items()]
        out += [f"{n}: mean {s / max(self.texts[n], 1):.4f}s a text over {self.texts[n]} texts" for n, s in self.seconds.items()]
        return [*out, f"peak memory: {self.peak_bytes / 1024**3:.2f} GB", f"end to end: {printed(sum(self.seconds.values()))}"]
