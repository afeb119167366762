"""Settings of a conversion."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from doclake.operators.cleaning import Rules


@dataclass(frozen=True)
class CaptionSettings:
    """The service that describes images; nothing is asked unless it is enabled and complete."""

    enabled: bool = False
    provider: str = "openai"
    base_url: str = ""
    api_key: str = ""
    model: str = ""
    prompt: str = ""
    timeout: float = 30.0
    max_concurrency: int = 3

    def key_ok(self) -> bool:
        """A local server needs no key."""
        return bool(self.api_key) or self.provider.lower() == "ollama"

    def sent_key(self) -> str:
        """The key that goes out; a placeholder where none is needed."""
        return self.api_key or ("ollama" if self.provider.lower() == "ollama" else "")

    def usable(self) -> bool:
        return self.enabled and bool(self.base_url) and bool(self.model) and self.key_ok()


@dataclass(frozen=True)
class ChunkSettings:
    enabled: bool = False
    strategy: str = "fixed"
    chunk_size: int = 512
    chunk_overlap: int = 64
    max_chunk_size: int = 0

    def issues(self) -> list[str]:
        """What is wrong with the numbers, for the strategy that they belong to."""
        if self.strategy.lower() in ("markdown", "md"):
            return ["max_chunk_size must not be negative"] if self.max_chunk_size < 0 else []
        found = [] if self.chunk_size > 0 else ["chunk_size must be positive"]
        if not 0 <= self.chunk_overlap < max(1, self.chunk_size):
            found.append("chunk_overlap must be at least 0 and less than chunk_size")
        return found


@dataclass(frozen=True)
class Settings:
    output: str = "md"
    enhanced_md: bool = False
    output_dir: str | None = None
    sheets: tuple[str, ...] = ()
    deep_first: bool = True
    allow_fallback: bool = True
    offline: bool = False
    cleaning: bool = True
    rules: Rules = field(default_factory=Rules)
    chunking: ChunkSettings = field(default_factory=ChunkSettings)
    captions: CaptionSettings = field(default_factory=CaptionSettings)

    def flat(self) -> dict:
        """All settings in one level of keys, nested ones with their group's name in front."""
        out: dict = {}
        for name, value in asdict(self).items():
            if isinstance(value, dict):
                out |= {f"{name}.{k}": v for k, v in value.items()}
            else:
                out[name] = value
        return out
