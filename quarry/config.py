"""Settings from the environment, under the prefix QUARRY_."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from quarry.functions import fixed
from quarry.sources.policy import Policy


@dataclass(frozen=True)
class Settings:
    store: str = "quarry-store"
    ingest_root: str | None = None
    ingest_hosts: tuple[str, ...] = fixed.ALLOWED_HOSTS
    embedding_dim: int = 64
    #: local: deterministic stand-ins; server: models behind model_url; hosted: the same with a key.
    provider: str = "local"
    model_url: str = "http://localhost:11434"
    embedding_model: str = "bge-m3"
    chat_model: str = "qwen2.5:7b-instruct"
    api_key: str | None = None

    def __post_init__(self):
        if self.embedding_dim <= 0:
            raise ValueError("embedding_dim must be positive")

    def require_key(self) -> str:
        """The key of a remote provider: missing keys show at once."""
        if self.provider == "local":
            raise ValueError("the local provider has no key")
        if not self.api_key:
            raise ValueError(f"QUARRY_API_KEY is needed for {self.provider}")
        return self.api_key

    def __repr__(self) -> str:
        return "Settings(" + ", ".join(f"{f.name}={getattr(self, f.name)!r}" for f in fields(self) if f.name != "api_key") + ")"

    @property
    def policy(self) -> Policy:
        return Policy(self.ingest_root, self.ingest_hosts)

    @classmethod
    def load(cls, env=None) -> Settings:
        env = os.environ if env is None else env
        kinds = {"ingest_hosts": lambda v: tuple(h.strip() for h in v.split(",") if h.strip()), "embedding_dim": int}
        return cls(**{f.name: kinds.get(f.name, str)(v) for f in fields(cls) if (v := env.get(f"QUARRY_{f.name.upper()}"))})
