"""Options of a scan, with their defaults, from TOML text or keyword arguments."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path

from credsieve.plans import values as V
from credsieve.plans.catalog import RANKS, Rule, builtin, spelt_out


@dataclass
class ScanOptions:
    max_file_size_bytes: int = V.FILE_BYTES
    workers: int = 0
    follow_symlinks: bool = False
    max_decode_depth: int = 2
    ignore_paths: list[str] = field(default_factory=lambda: list(V.DEFAULT_IGNORED))


@dataclass
class EntropyOptions:
    enabled: bool = True
    alpha: float = 2.0
    min_length: int = 20
    max_length: int = 512
    threshold: float = 0.88
    threshold_no_context: float = 0.95
    require_digit: bool = True


@dataclass
class RuleOptions:
    disable: list[str] = field(default_factory=list)
    custom: list[dict] = field(default_factory=list)


@dataclass
class AllowOptions:
    paths: list[str] = field(default_factory=list)
    regexes: list[str] = field(default_factory=list)
    fingerprints: list[str] = field(default_factory=list)
    stopwords: list[str] = field(default_factory=list)
    markers: list[str] = field(default_factory=lambda: list(V.ALLOW_MARKERS))


@dataclass
class JudgeOptions:
    """Who judges findings; `command` is a program that reads requests as JSON and answers with results."""

    mode: str = "auto"
    provider: str = ""
    command: list[str] = field(default_factory=list)
    max_batch: int = 8
    max_concurrency: int = 4
    timeout_seconds: int = 45
    on_error: str = "keep"
    filter_false_positives: bool = True
    min_confidence: float = 0.6
    send_secret: bool = True
    max_context_lines: int = 3
    cache_path: str = ""
    # For judges behind an address; a Judge that is passed to the engine reads them.
    model: str = ""
    reasoning_effort: str = ""
    base_url: str = ""
    api_key_env: str = ""


@dataclass
class ReportOptions:
    format: str = "text"
    redact: bool = True
    show_suppressed: bool = False


@dataclass
class HookOptions:
    fail_open: bool = True
    block_on: str = "low"
    decision: str = "deny"


@dataclass
class BaselineOptions:
    path: str = ".credsieve-baseline.json"


@dataclass
class Config:
    scan: ScanOptions = field(default_factory=ScanOptions)
    entropy: EntropyOptions = field(default_factory=EntropyOptions)
    rules: RuleOptions = field(default_factory=RuleOptions)
    allowlist: AllowOptions = field(default_factory=AllowOptions)
    ai: JudgeOptions = field(default_factory=JudgeOptions)
    report: ReportOptions = field(default_factory=ReportOptions)
    hook: HookOptions = field(default_factory=HookOptions)
    baseline: BaselineOptions = field(default_factory=BaselineOptions)

    def __post_init__(self) -> None:
        self.checked()

    def checked(self) -> Config:
        """Values brought into their bounds; wrong ones refused."""
        self.scan.max_decode_depth = min(5, max(0, self.scan.max_decode_depth))
        self.entropy.min_length = max(16, self.entropy.min_length)
        self.ai.max_batch = max(1, self.ai.max_batch)
        for name, value, known in (
            ("ai.mode", self.ai.mode, ("on", "off", "auto")),
            ("ai.on_error", self.ai.on_error, ("keep", "fail")),
            ("report.format", self.report.format, ("text", "json", "sarif", "junit", "gitlab")),
            ("hook.decision", self.hook.decision, ("deny", "ask")),
            ("hook.block_on", self.hook.block_on, tuple(RANKS)),
        ):
            if value not in known:
                raise ValueError(f"{name}: {value!r} is none of {', '.join(known)}")
        for pattern in self.allowlist.regexes:
            re.compile(pattern)
        return self

    def active_rules(self) -> list[Rule]:
        """Catalog and custom rules, without disabled ones."""
        own = [
            Rule(
                id=c["id"],
                pattern=spelt_out(c["regex"]),
                group=c.get("secret_group", 0),
                keywords=tuple(x.lower() for x in c.get("keywords", ())),
                floor=c.get("entropy") or None,
                severity=c.get("severity", "low") if c.get("severity", "low") in RANKS else "low",
                tags=tuple(c.get("tags", ())),
                description=c.get("description", c["id"]),
                least=c.get("min_len", 0),
                most=c.get("max_len", 0),
            )
            for c in self.rules.custom
        ]
        return [r for r in builtin() + own if r.id not in self.rules.disable]


#: Fixed value: what a discovered file may not set, since it decides what leaves the machine.
OPERATOR_ONLY = (("ai", "command"), ("ai", "cache_path"))


def _laid_over(options: object, given: dict, place: str) -> None:
    known = {f.name for f in fields(options)}
    for name, value in given.items():
        if name not in known:
            raise ValueError(f"unknown key {place}{name}")
        now = getattr(options, name)
        if is_dataclass(now):
            _laid_over(now, value, f"{place}{name}.")
        else:
            setattr(options, name, value)


def from_toml(text: str, discovered: bool = False) -> Config:
    """Defaults with the file's values laid over them; a list replaces the default list."""
    given = tomllib.loads(text)
    if discovered:
        for section, key in OPERATOR_ONLY:
            if key in given.get(section, {}):
                raise ValueError(f"{section}.{key} can't be set by a discovered file")
    config = Config()
    _laid_over(config, given, "")
    return config.checked()


def discover(start: str = ".", variable: str = "CREDSIEVE_CONFIG") -> Config:
    """From the file that the environment names, else the nearest one above `start`, else the defaults."""
    if named := os.environ.get(variable):
        return from_toml(Path(named).read_text())
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        for name in (".credsieve.toml", "credsieve.toml"):
            if (folder / name).is_file():
                return from_toml((folder / name).read_text(), discovered=True)
    return Config()
