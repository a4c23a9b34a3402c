"""YAML configuration: global options and sites; an absent or empty file gives the defaults."""

from __future__ import annotations

from dataclasses import asdict, fields
from pathlib import Path

from ..model import AppConfig, LLMConfig, Options, SiteConfig


def _pick(kind: type, data: dict | None) -> dict:
    known = {f.name for f in fields(kind)}
    return {k: v for k, v in (data or {}).items() if k in known}


def load(path: str) -> AppConfig:
    import yaml

    file = Path(path)
    data = (yaml.safe_load(file.read_text(encoding="utf-8")) or {}) if file.exists() else {}
    top = _pick(Options, data.get("global"))
    if isinstance(top.get("llm"), dict):
        top["llm"] = LLMConfig(**_pick(LLMConfig, top["llm"]))
    sites = {name: SiteConfig(**_pick(SiteConfig, s)) for name, s in (data.get("sites") or {}).items()}
    return AppConfig(Options(**top), sites)


def save(config: AppConfig, path: str) -> None:
    import yaml

    Path(path).write_text(yaml.safe_dump({"global": asdict(config.options), "sites": {n: asdict(s) for n, s in config.sites.items()}}, allow_unicode=True, sort_keys=False), encoding="utf-8")
