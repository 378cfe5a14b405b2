"""Settings of a run: where models answer, how long they may take, and where replies and tables are kept."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from folio.operators import plugins


@dataclass(frozen=True)
class Settings:
    """What the environment says as FOLIO_URL, FOLIO_MODEL and so on; the command line comes before it."""

    url: str = "http://localhost:11434"
    model: str | None = None
    timeout: float = plugins.TIMEOUT
    log: str | None = None
    tail_policy: str = "reference"

    @classmethod
    def of(cls, environment: Mapping[str, str] | None = None, **given: object) -> Settings:
        """Defaults, then the environment, then what is given and not None."""
        known = os.environ if environment is None else environment
        told = {f.name: known[f"FOLIO_{f.name.upper()}"] for f in fields(cls) if known.get(f"FOLIO_{f.name.upper()}")}
        own = replace(cls(), **told | {k: v for k, v in given.items() if v is not None})
        return replace(own, timeout=float(own.timeout))

    def client(self) -> plugins.ChatClient | None:
        return plugins.ChatClient(self.url, self.model) if self.model else None
