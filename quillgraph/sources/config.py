"""Vault configuration: TOML to dataclasses, checks, and the hash that decides on a rebuild."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

SCHEMA_VERSION = 2
#: Where a configuration is looked for, in order; ``discover`` takes other names.
NAMES = ("vault.toml", ".vault/config.toml")
EDGE_NAME = re.compile(r"^[A-Z][A-Z0-9_]{0,30}$")
SKIP = ("**/.obsidian/**", "**/.vault/**", "**/.git/**", "**/node_modules/**")


@dataclass(frozen=True)
class Vault:
    notes: tuple[str, ...] = ("**/*.md",)
    exclude: tuple[str, ...] = SKIP
    id_strip_prefix: str = ""


@dataclass(frozen=True)
class Resources:
    paths: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    date_fields: dict = field(default_factory=lambda: {"captured": "captured_at", "source": "source_date"})
    url_fields: tuple[str, ...] = ("source", "url", "origin", "source_ref")


@dataclass(frozen=True)
class Edge:
    name: str
    source: str = "wikilinks"
    field: str | None = None
    target: str = "note"


@dataclass(frozen=True)
class Diagnostics:
    broken_link: str = "warn"
    ambiguous_link: str = "warn"
    required_fields: dict = field(default_factory=dict)
    stale_after_days: int | None = None


@dataclass(frozen=True)
class Embeddings:
    enabled: bool = False
    provider: str = "local"
    model: str = ""
    dim: int = 768
    endpoint: str = ""
    char_cap: int = 7000
    exclude_kinds: tuple[str, ...] = ()
    embed_resources: bool = True
    api_key_env: str = ""
    query_instruction: str = ""


@dataclass(frozen=True)
class Config:
    vault: Vault = Vault()
    resources: Resources | None = None
    fields: dict = field(default_factory=dict)
    kinds: tuple[str, ...] = ()
    unknown_kind: str = "allow"
    edges: tuple[Edge, ...] = (Edge("LINKS_TO"),)
    markdown_paths: bool = False
    tag_field: str = "tags"
    inline_tags: bool = True
    diagnostics: Diagnostics = Diagnostics()
    embeddings: Embeddings = Embeddings()
    llm: dict = field(default_factory=dict)
    ingest: dict = field(default_factory=dict)
    server: dict = field(default_factory=dict)

    def content_hash(self) -> str:
        """Changes with anything that changes the graph; model, ingest and server settings do not."""
        body = dataclasses.asdict(self)
        for k in ("llm", "ingest", "server"):
            body.pop(k)
        return hashlib.sha256(SCHEMA_VERSION.to_bytes(4, "little") + json.dumps(body, sort_keys=True).encode()).hexdigest()

    def for_task(self, task: str) -> dict:
        """The model settings with a task's own laid over them."""
        base = {k: v for k, v in self.llm.items() if not isinstance(v, dict)}
        return base | {k: v for k, v in self.llm.get(task, {}).items() if v is not None}


def _make(cls, values: dict, where: str):
    known = {f.name for f in dataclasses.fields(cls)}
    if odd := set(values) - known:
        raise ValueError(f"unknown keys in {where}: {', '.join(sorted(odd))}")
    return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def parse(text: str) -> Config:
    raw = tomllib.loads(text)
    known = {"vault", "resources", "notes", "kinds", "edges", "links", "tags", "diagnostics", "embeddings", "llm", "ingest", "server"}
    if odd := set(raw) - known:
        raise ValueError(f"unknown sections: {', '.join(sorted(odd))}")
    kinds, tags = raw.get("kinds", {}), raw.get("tags", {})
    cfg = Config(
        vault=_make(Vault, raw.get("vault", {}), "vault"),
        resources=_make(Resources, raw["resources"], "resources") if "resources" in raw else None,
        fields=raw.get("notes", {}).get("fields", {}),
        kinds=tuple(kinds.get("values", ())),
        unknown_kind=kinds.get("unknown", "allow"),
        edges=tuple(_make(Edge, e, "edges") for e in raw.get("edges", [{"name": "LINKS_TO"}])),
        markdown_paths=raw.get("links", {}).get("markdown_paths", False),
        tag_field=tags.get("field", "tags"),
        inline_tags=tags.get("inline", True),
        diagnostics=_make(Diagnostics, raw.get("diagnostics", {}), "diagnostics"),
        embeddings=_make(Embeddings, raw.get("embeddings", {}), "embeddings"),
        llm=raw.get("llm", {}), ingest=raw.get("ingest", {}), server=raw.get("server", {}),
    )
    check(cfg)
    return cfg


def check(cfg: Config) -> None:
    names = [e.name for e in cfg.edges]
    if len(set(names)) < len(names):
        raise ValueError("edge names must be unique")
    if sum(e.source == "wikilinks" for e in cfg.edges) > 1:
        raise ValueError("at most one edge may come from wikilinks")
    for e in cfg.edges:
        if not EDGE_NAME.match(e.name) or e.name == "TAGGED":
            raise ValueError(f"bad edge name {e.name}")
        if e.source == "frontmatter" and not e.field:
            raise ValueError(f"edge {e.name} needs a field")
        if e.source == "wikilinks" and e.target != "note":
            raise ValueError(f"edge {e.name}: wikilinks lead to notes")
        if e.target == "resource" and cfg.resources is None:
            raise ValueError(f"edge {e.name} needs a resources section")


def discover(start: str, names: tuple[str, ...] = NAMES) -> tuple[str, Config]:
    """(root, configuration) of the nearest folder upwards that has one, else start and the defaults."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        for name in names:
            if (folder / name).is_file():
                return str(folder), parse((folder / name).read_text())
    return str(here), Config()


def glob_regex(pattern: str) -> str:
    """A path glob ('**' crosses folders) as an anchored regular expression for rlike."""
    out, i = "^", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
            i += 1
    return out + "$"
