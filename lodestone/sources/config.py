"""Settings from TOML or JSON files and from the environment, with defaults and bounds.

Defined cases: a missing file gives the defaults; unknown keys are ignored; a value of a wrong kind
falls back to its default.
"""

from __future__ import annotations

import dataclasses
import json
import os
import tomllib


@dataclasses.dataclass(frozen=True)
class Retrieval:
    candidates: int = 80
    min_score: float = 0.50
    relative_cutoff: float = 0.72
    lexical_weight: float = 0.20
    context_fraction: float = 0.25


@dataclasses.dataclass(frozen=True)
class Chunking:
    target_tokens: int = 400
    overlap_tokens: int = 40
    max_tokens: int = 512
    window: int = 1


@dataclasses.dataclass(frozen=True)
class Index:
    kind: str = "ivf_pq"
    least_rows: int = 50_000
    most_lists: int = 1024
    probes: int = 50
    refine: int = 20
    sub_vectors: int = 16
    bits: int = 8
    metric: str = "l2"
    retrain_share: float = 0.01


@dataclasses.dataclass(frozen=True)
class Embedding:
    model: str = "nomic-embed-text"
    dim: int = 768
    batch: int = 128
    hosts: tuple[str, ...] = ("http://localhost:11434",)


@dataclasses.dataclass(frozen=True)
class Ocr:
    backend: str = "auto"
    languages: tuple[str, ...] = ()
    full_page: bool = False
    area: float = 0.05


@dataclasses.dataclass(frozen=True)
class Settings:
    retrieval: Retrieval = Retrieval()
    chunking: Chunking = Chunking()
    index: Index = Index()
    embedding: Embedding = Embedding()
    ocr: Ocr = Ocr()


#: Kinds of indexes, metrics and OCR back ends (fixed values).
INDEX_KINDS, METRICS = ("ivf_pq", "ivf_flat"), ("l2", "cosine")
OCR_BACKENDS = ("auto", "rapidocr", "easyocr", "tesseract", "tesseract_cli", "ocrmac")


def _fitting(default: object, given: object) -> object:
    """A given value in the kind of its default, or the default."""
    try:
        if isinstance(default, bool):
            return given if isinstance(given, bool) else default
        if isinstance(default, tuple):
            return tuple(str(x) for x in given) if isinstance(given, (list, tuple)) else default
        if isinstance(default, (int, float)):
            return default if isinstance(given, bool) else type(default)(given)
        return str(given)
    except (TypeError, ValueError):
        return default


def merged(default, given: dict):
    """A settings object with what a mapping states of it."""
    known = {f.name: getattr(default, f.name) for f in dataclasses.fields(default)}
    out = {}
    for name, value in known.items():
        if name not in given or given[name] is None:
            continue
        out[name] = merged(value, given[name]) if dataclasses.is_dataclass(value) and isinstance(given[name], dict) else value if dataclasses.is_dataclass(value) else _fitting(value, given[name])
    return dataclasses.replace(default, **out)


def load(path: str | None) -> Settings:
    if not path or not os.path.exists(path):
        return Settings()
    with open(path, "rb") as f:
        given = tomllib.load(f) if path.endswith(".toml") else json.load(f)
    return checked(merged(Settings(), given if isinstance(given, dict) else {}))


def checked(s: Settings) -> Settings:
    """Settings within their bounds; unknown kinds of index, metric and OCR take the defaults."""
    known = Settings()
    index = dataclasses.replace(
        s.index, kind=s.index.kind if s.index.kind in INDEX_KINDS else known.index.kind, metric=s.index.metric if s.index.metric in METRICS else known.index.metric,
        probes=max(1, s.index.probes), refine=max(1, s.index.refine), most_lists=max(1, s.index.most_lists), bits=min(8, max(1, s.index.bits)),
    )
    ocr = dataclasses.replace(s.ocr, backend=s.ocr.backend if s.ocr.backend in OCR_BACKENDS else known.ocr.backend, area=min(1.0, max(0.0, s.ocr.area)))
    return dataclasses.replace(s, index=index, ocr=ocr, embedding=dataclasses.replace(s.embedding, batch=max(1, s.embedding.batch), hosts=hosts(",".join(s.embedding.hosts)) or known.embedding.hosts))


def hosts(listed: str) -> tuple[str, ...]:
    """Hosts of a comma-separated list, with a scheme, without a slash at the end, each once."""
    clean = (h.strip().rstrip("/") for h in listed.split(","))
    return tuple(dict.fromkeys(h if "://" in h else f"http://{h}" for h in clean if h))


def search_tools(web: bool) -> list[dict]:
    """The tools that a chat model may call, as JSON schemas."""
    text, number = {"type": "string"}, {"type": "integer"}
    made = lambda name, about, fields, need: {"type": "function", "function": {"name": name, "description": about, "parameters": {"type": "object", "properties": fields, "required": need}}}
    local = made("search_local_context", "Search the local index for passages.", {"query": text, "exclude_ids": {"type": "array", "items": text}}, ["query"])
    return [local, made("web_search", "Search the web.", {"query": text, "max_results": number}, ["query"])] if web else [local]
