"""Parameters of the engine. Names and hosts of a site are always parameters, never constants."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

# Words that a question's terms leave out.
STOPWORDS: tuple[str, ...] = tuple(
    "a an the and or of for to in on at is are was were be can i my me we our you your what which who whom how where "
    "when why do does did please tell about from with this that it".split()
)


def hybrid_stopwords(label: str) -> tuple[str, ...]:
    """STOPWORDS without `whom` and with the words of the source label."""
    return tuple(w for w in STOPWORDS if w != "whom") + tuple(label.lower().split())


@dataclass(frozen=True)
class SiteConfig:
    source_label: str = "Knowledge Base"
    default_title: str = "Knowledge Base"
    start_url: str = "https://hub.example.com/"
    allowed_hosts: tuple[str, ...] = ("hub.example.com",)

    @staticmethod
    def hosts_from(raw: str | None, start_url: str) -> tuple[str, ...]:
        """A comma list of hosts in lower case, or the start URL's host if there is none."""
        from urllib.parse import urlsplit

        hosts = tuple(h.strip().lower() for h in (raw or "").split(",") if h.strip())
        return hosts or tuple(h for h in [(urlsplit(start_url).hostname or "").lower()] if h)


@dataclass(frozen=True)
class ChunkConfig:
    size: int = 1000
    overlap: int = 150
    least: int = 40

    def __post_init__(self) -> None:
        if self.overlap >= self.size:
            raise ValueError("overlap must be smaller than size")

    def warnings(self) -> list[str]:
        out = []
        if not 800 <= self.size <= 1200:
            out.append("size is outside 800 to 1200")
        if not 100 <= self.overlap <= 200:
            out.append("overlap is outside 100 to 200")
        return out


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 5
    candidates: int = 12
    terms_searched: int = 4
    keyword_limit: int = 8
    rrf_k: int = 60
    min_relevance: float = 0.28
    strong_relevance: float = 0.55
    context_chars: int = 12_000
    history_turns: int = 4
    answer_chars: int = 500
    max_iterations: int = 5
    discover_limit: int = 5
    query_time_pages: int = 3
    temperature: float = 0.1
    max_output_tokens: int = 800
    hybrid: bool = True


@dataclass(frozen=True)
class CrawlConfig:
    max_pages: int = 200
    max_depth: int = 8
    delay_seconds: float = 0.75
    retries: int = 3
    timeout_seconds: float = 60.0
    mode: str = "incremental"

    def __post_init__(self) -> None:
        if self.mode.strip().lower() not in {"full", "incremental"}:
            raise ValueError("mode must be full or incremental")


# Elements of a page that only a signed-in user sees.
AUTH_SELECTORS = (
    "#O365_MainLink_Me",
    "#meInitialsButton",
    "#SuiteNavWrapper",
    "#O365_Header",
    "#spSiteHeader",
    "#sp-appBar",
    "[data-automationid='SiteHeader']",
    "button[aria-label*='Account' i]",
    "a[aria-label*='Sign out' i]",
    "a[href*='logout' i]",
    "a[href*='signout' i]",
    "#mectrl_main_trigger",
    ".o365sx-navbar",
    "[data-automation-id='SimpleSiteHeader']",
)


def auth_selectors(raw: str | None) -> tuple[str, ...]:
    """A comma list of selectors, or AUTH_SELECTORS if it names none."""
    return tuple(filter(None, map(str.strip, (raw or "").split(",")))) or AUTH_SELECTORS


def utc_now(at: datetime | None = None) -> str:
    return (at or datetime.now(timezone.utc)).isoformat(timespec="seconds")


def run_name(prefix: str, at: datetime | None = None) -> str:
    """A run's folder: prefix_YYYYmmdd_HHMMSS in UTC."""
    return f"{prefix}_{(at or datetime.now(timezone.utc)).strftime('%Y%m%d_%H%M%S')}"


@dataclass(frozen=True)
class ModelConfig:
    """A deployment's name wins over the model's where the provider is a hosted deployment."""

    provider: str = "hash"
    model: str = "hash-32"
    deployment: str = ""

    def embedding_model(self) -> str:
        return (self.deployment or self.model) if self.provider == "azure" else self.model


def read_env(text: str) -> dict[str, str]:
    """NAME=value lines of a .env file; quotes round a value go, and so do blank lines and comments."""
    out = {}
    for line in text.splitlines():
        name, equals, value = line.strip().removeprefix("export ").partition("=")
        if equals and not name.lstrip().startswith("#"):
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def from_environment(cls, prefix: str, env: dict[str, str]):
    """A config with fields overridden by PREFIX_FIELD entries of env; bad numbers raise."""
    from dataclasses import fields

    values = {}
    for f in fields(cls):
        raw = env.get(f"{prefix}_{f.name}".upper())
        if raw is not None:
            default = f.default
            values[f.name] = raw.lower() in {"1", "true", "yes", "on"} if isinstance(default, bool) else tuple(x.strip() for x in raw.split(",") if x.strip()) if isinstance(default, tuple) else type(default)(raw)
    return cls(**values)
