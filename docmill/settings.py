"""Settings of runs from a TOML file: sections for chapters, units, screening and extraction, and for the models of each."""

from __future__ import annotations

import os
import tomllib
from dataclasses import fields
from pathlib import Path
from typing import Any

from docmill.operators.cleaner import ChapterSettings, UnitSettings
from docmill.operators.extraction import Recovery
from docmill.operators.provider import EngineProvider, HttpProvider, LocalProvider, Retry
from docmill.operators.replies import json_schema


class Settings:
    """The sections of a file; what it doesn't set has the operators' defaults. Paths are taken from the folder above the file's."""

    def __init__(self, data: dict[str, Any], root: Path) -> None:
        self.data, self.root = data, root

    @classmethod
    def load(cls, path: str | Path, root: str | Path | None = None) -> Settings:
        file = Path(path).resolve()
        return cls(tomllib.loads(file.read_text("utf-8")), Path(root).resolve() if root else file.parent.parent)

    def section(self, *names: str) -> dict[str, Any]:
        """A section by its names, empty if there is none."""
        at: Any = self.data
        for name in names:
            at = at.get(name) if isinstance(at, dict) else None
        return at if isinstance(at, dict) else {}

    def path(self, name: str) -> str:
        value = self.section("paths").get(name)
        if not value:
            raise KeyError(f"paths.{name} is not set")
        return str(self.root / value)

    def chapters(self) -> ChapterSettings:
        s, d = self.section("preprocess"), ChapterSettings()
        return ChapterSettings(int(s.get("min_chapter_chars", d.min_chapter_chars)), tuple(s.get("target_chapter_keywords", d.target_keywords)))

    def units(self) -> UnitSettings:
        s, d = self.section("main_regression"), UnitSettings()
        return UnitSettings(int(s.get("text_unit_min_chars", d.min_chars)), int(s.get("text_unit_max_chars", d.max_chars)))

    def retry(self, stage: str) -> Retry:
        s, d = self.section(stage), Retry()
        return Retry(int(s.get("max_retries", d.attempts)), float(s.get("retry_min_seconds", d.least)), float(s.get("retry_max_seconds", d.most)))

    def workers(self, stage: str) -> int | None:
        """Calls made at once, if it is set."""
        return int(n) if (n := self.section(stage).get("workers")) else None

    def recovery(self) -> Recovery:
        s = self.section("stage2", "safe_recovery")
        names = {"enabled": "enabled", "attempts": "max_generation_attempts", "structured_output": "structured_output", "repair_once": "repair_once", "detect_repetition": "detect_repetition", "retry_on_parse_failure": "retry_on_parse_failure", "retry_on_repetition": "retry_on_repetition", "min_bytes": "repetition_min_chars", "max_ratio": "repetition_compression_ratio"}
        mode = s.get("grounding_mode", "audit")
        if mode not in ("audit", "off"):
            raise ValueError("grounding_mode must be audit or off")
        return Recovery(**({"enabled": False} | {mine: s[theirs] for mine, theirs in names.items() if theirs in s}), grounding=mode == "audit")

    def http(self, stage: str, api_key: str | None = None) -> HttpProvider:
        """The endpoint of a stage; its key, address and model may come from environment variables that the section names."""
        s = self.section(stage, "api")
        given = lambda name, default=None: os.environ.get(s.get(f"{name}_env", f"DOCMILL_{name.upper()}")) or s.get(name, default)
        key = api_key or given("api_key")
        if not key:
            raise ValueError(f"no API key for {stage}")
        return HttpProvider(given("base_url", ""), given("model", ""), key, temperature=float(s.get("temperature", 0.0)), json_object=bool(s.get("json_response_format", True)), max_tokens=int(s.get("max_tokens") or 0) or None, extra_body=s.get("extra_body") if isinstance(s.get("extra_body"), dict) else None)

    def _model_path(self, s: dict[str, Any], stage: str, given: str | None) -> str:
        path = given or os.environ.get(s.get("model_path_env", "LOCAL_MODEL_PATH")) or s.get("model_path")
        if not path:
            raise ValueError(f"no model path for {stage}")
        return str(path)

    def local(self, stage: str, model_path: str | None = None) -> LocalProvider:
        s = self.section(stage, "local")
        known = {f.name for f in fields(LocalProvider)} - {"model_path", "max_input_chars"}
        return LocalProvider(self._model_path(s, stage, model_path), max_input_chars=int(s.get("max_input_chars") or 0) or None, **{k: s[k] for k in known if k in s})

    def engine(self, stage: str, model_path: str | None = None) -> EngineProvider:
        s = self.section(stage, "vllm_batch")
        known = {f.name for f in fields(EngineProvider)} - {"model_path", "chunk", "lora_path", "structured_output"}
        schema = json_schema() if stage == "stage2" and self.recovery().structured_output and self.recovery().enabled else None
        return EngineProvider(self._model_path(s, stage, model_path), int(s.get("chunk_size", s.get("batch_size", 64))), lora_path=s.get("lora_path") or None, structured_output=schema, **{k: s[k] for k in known if k in s})

    def provider(self, stage: str, kind: str | None = None, **given: str | None) -> HttpProvider | LocalProvider | EngineProvider:
        """The model of a stage: api, local or vllm_batch."""
        kind = kind or self.section(stage).get("provider") or self.section("extract").get("provider", "api")
        if kind not in ("api", "local", "vllm_batch"):
            raise ValueError(f"unknown provider {kind}")
        return self.http(stage, given.get("api_key")) if kind == "api" else self.local(stage, given.get("model_path")) if kind == "local" else self.engine(stage, given.get("model_path"))
