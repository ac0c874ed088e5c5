"""Settings of a run, checked before anything is read or computed."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from typing import Any

from groundwork.functions.text import CLASSES
from groundwork.operators.chunking import check_window
from groundwork.operators.index import config_key
from groundwork.sources.files import checked_key

#: Versions of the system's prompt.
PROMPTS = ("v1", "v2")


def drop_types(text: str | None) -> tuple[str, ...]:
    """Types to leave out, from a list with commas; unknown ones are an error, and so is leaving out the rules."""
    types = tuple(dict.fromkeys(t.strip().lower() for t in (text or "").split(",") if t.strip()))
    if unknown := [t for t in types if t not in CLASSES]:
        raise ValueError(f"unknown types: {unknown}; there are {list(CLASSES)}")
    if "regel" in types:
        raise ValueError("the rules themselves cannot be left out")
    return types


@dataclass(frozen=True)
class Settings:
    """What decides the results of a run; every field is checked when it is made."""

    collection: str | None = None
    model: str = "quell-32"
    size: int = 400
    overlap: int = 150
    top_k: int = 4
    candidates: int = 20
    drop: tuple[str, ...] = ()
    prompt: str = "v1"
    decision: str = "0"
    golden: str = "golden_set.json"

    def __post_init__(self) -> None:
        check_window(self.size, self.overlap)
        if self.collection is not None:
            checked_key(self.collection)
        if self.prompt not in PROMPTS:
            raise ValueError(f"unknown prompt {self.prompt!r}; there are {list(PROMPTS)}")
        if self.decision not in ("0", "1"):
            raise ValueError(f"the decision step is on (1) or off (0), not {self.decision!r}")
        if not re.fullmatch(r"[A-Za-z0-9][\w.-]*\.json", self.golden):
            raise ValueError(f"the golden set is a bare file name: {self.golden!r}")
        if not 0 < self.top_k <= self.candidates:
            raise ValueError("top_k is at least 1 and at most the candidates")
        drop_types(",".join(self.drop))

    @property
    def index_key(self) -> str:
        return config_key(self.model, self.size, self.overlap)


def run_meta(settings: Settings, start: dt.datetime, end: dt.datetime, answers: int, **more: Any) -> dict[str, Any]:
    """Description of a run with times as ISO text and the seconds between; an end before its start is an error."""
    if end < start:
        raise ValueError("the run ends before it starts")
    return {"konfiguration": dict(settings.__dict__, drop=list(settings.drop)), "start": start.isoformat(timespec="seconds"), "ende": end.isoformat(timespec="seconds"), "sekunden": (end - start).total_seconds(), "antworten": answers, **more}
