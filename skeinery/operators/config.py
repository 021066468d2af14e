"""Layered configuration: defaults, then global, domain and subdomain profiles."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from typing import Any

# Defaults of a crawl and of embedding.
CRAWL_DEFAULTS = {"max_depth": 2, "max_pages": 100, "requests_per_second": 2.0, "concurrency": 4, "timeout_secs": 15, "settle_ms": 2000, "respect_robots": True, "same_origin": True, "use_sitemap": False, "format": "markdown"}
EMBED_DEFAULTS = {"chunk_size": 512, "chunk_overlap": 50, "concurrency": 4}


def load(path: str | None) -> dict[str, Any]:
    """A TOML file as a dict; a missing file is empty."""
    import tomllib

    if not path or not os.path.exists(path):
        return {}
    with open(path, "rb") as f:
        return tomllib.load(f)


def overlay(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``over`` wins for every value it sets; nested tables are replaced whole."""
    return dict(base) | {k: v for k, v in over.items() if v is not None}


def resolve(config: Mapping[str, Any], host: str) -> dict[str, Any]:
    """Profile of a host: global, then matching domains from the shortest to the longest, then the exact subdomain."""
    out = overlay(CRAWL_DEFAULTS, config.get("global", {}))
    domains = config.get("domains", {})
    host = host.lower()
    for d in sorted((d for d in domains if host == d or host.endswith("." + d)), key=lambda d: (len(d), d)):
        out = overlay(out, {k: v for k, v in domains[d].items() if k != "subdomains"})
        sub = domains[d].get("subdomains", {})
        if host in sub:
            out = overlay(out, sub[host])
        elif host[: -len(d) - 1] in sub:
            out = overlay(out, sub[host[: -len(d) - 1]])
    return out


def interpolate_env(text: str, env: Mapping[str, str] | None = None) -> str:
    """``${NAME}`` and ``$NAME`` replaced by their values, unknown ones by nothing."""
    values = os.environ if env is None else env
    return re.sub(r"\$\{(\w+)\}|\$([A-Za-z_]\w*)", lambda m: values.get(m.group(1) or m.group(2), ""), text)


def embedding_config(raw: Mapping[str, Any], env: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Embedding settings with defaults; ``endpoints`` override ``endpoint``; texts are interpolated."""
    out = overlay(EMBED_DEFAULTS, raw)
    out["endpoints"] = [interpolate_env(e, env) for e in (raw.get("endpoints") or ([raw["endpoint"]] if raw.get("endpoint") else []))]
    if raw.get("api_key"):
        out["api_key"] = interpolate_env(raw["api_key"], env)
    return out


def store_url(env: Mapping[str, str], config: Mapping[str, Any], default: str = "skein-store") -> str:
    """Where the store lies: environment, then ``db_url``, then ``db_path`` of the file, then the default."""
    return env.get("SKEIN_STORE") or config.get("db_url") or config.get("db_path") or default
