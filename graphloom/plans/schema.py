"""Schemas of the log and of the state derived from it, and requests checked before planning."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

LOG = (
    "seq bigint, version int, timestamp bigint, event_type string, id string, label string, from_id string,"
    " to_id string, relationship string, direction string, properties string"
)
NODES = (
    "id string, label string, entity_type string, status string, description string, last_modified bigint,"
    " created_at bigint, closed_at bigint, name string, content string, metadata string,"
    " embedding array<array<float>>, seq bigint"
)
EDGES = "from_id string, to_id string, relationship string, properties string, seq bigint"
CHUNKS = "node_id string, chunk_idx int, vec array<float>"

MAX_DEPTH = 5
MAX_ROWS = 1000
RETURNABLE = ("id", "name", "line", "label", "content", "metadata")
MODES = ("name", "preview", "full")


class RequestError(ValueError):
    """A request that lacks a required field or holds a value of the wrong kind."""


def _take(raw: Mapping, where: str, known: Mapping[str, type | tuple], required: tuple[str, ...] = ()) -> dict:
    if not isinstance(raw, Mapping):
        raise RequestError(f"{where} must be an object")
    for key in raw:
        if key not in known:
            raise RequestError(f"{where}: unknown field {key!r}")
    for key in required:
        if raw.get(key) is None:
            raise RequestError(f"{where}: missing field {key!r}")
    for key, value in raw.items():
        if value is not None and (not isinstance(value, known[key]) or isinstance(value, bool) and known[key] is int):
            raise RequestError(f"{where}.{key} has the wrong type")
    return {k: v for k, v in raw.items() if v is not None}


@dataclass(frozen=True)
class EdgeRule:
    id: str
    relationship: str


@dataclass(frozen=True)
class Query:
    """A request of the query language: match, where, traverse, then aggregate or limit and return."""

    match: Mapping[str, str] = field(default_factory=dict)
    edge_to: EdgeRule | None = None
    edge_from: EdgeRule | None = None
    relationship: str | None = None
    direction: str = "outbound"
    max_depth: int = 1
    group_by: str | None = None
    limit: int = MAX_ROWS
    fields: tuple[str, ...] = RETURNABLE
    mode: str = "full"

    @staticmethod
    def of(raw: Mapping) -> Query:
        top = _take(raw, "query", {"match": Mapping, "where": Mapping, "traverse": Mapping, "aggregate": Mapping, "limit": int, "return": (list, tuple), "return_fields": (list, tuple), "retrieval_mode": str})
        text = ("id", "label", "entity_type", "status", "name_contains")
        match = _take(top.get("match", {}), "match", dict.fromkeys(text, str))
        where = _take(top.get("where", {}), "where", {"edge_to": Mapping, "edge_from": Mapping})
        rules = {k: EdgeRule(**_take(v, k, {"id": str, "relationship": str}, ("id", "relationship"))) for k, v in where.items()}
        walk = _take(top["traverse"], "traverse", {"relationship": str, "direction": str, "max_depth": int}, ("relationship",)) if "traverse" in top else {}
        group = _take(top["aggregate"], "aggregate", {"group_by": str, "count": bool}, ("group_by",)) if "aggregate" in top else {}
        fields = top.get("return", top.get("return_fields", RETURNABLE))
        mode = top.get("retrieval_mode", "full")
        if mode not in MODES:
            raise RequestError(f"retrieval_mode must be one of {MODES}")
        limit, depth = top.get("limit", MAX_ROWS), walk.get("max_depth", 1)
        if limit < 0 or depth < 0:
            raise RequestError("limit and max_depth can't be negative")
        return Query(match, rules.get("edge_to"), rules.get("edge_from"), walk.get("relationship"), walk.get("direction", "outbound"), depth, group.get("group_by"), min(limit, MAX_ROWS), tuple(f for f in RETURNABLE if f in fields), mode)


@dataclass(frozen=True)
class Search:
    """A search request."""

    text: str
    top_k: int = 10
    entity_types: tuple[str, ...] | None = None
    include_paths: tuple[str, ...] | None = None
    exclude_paths: tuple[str, ...] = ()
    workspace_id: str | None = None
    diversity: float | None = None
    mode: str = "full"
    snippet: bool = False
    neighbors: int | None = None
    relationships: tuple[str, ...] | None = None
    direction: str = "both"

    @staticmethod
    def of(raw: Mapping) -> Search:
        lists = (list, tuple)
        top = _take(raw, "search", {"text": str, "top_k": int, "entity_types": lists, "include_paths": lists, "exclude_paths": lists, "workspace_id": str, "diversity": (int, float), "retrieval_mode": str, "snippet": str, "traverse": Mapping}, ("text",))
        walk = _take(top["traverse"], "traverse", {"resolve_top_k": int, "relationships": lists, "direction": str}) if "traverse" in top else None
        if top.get("snippet", "auto") != "auto":
            raise RequestError("snippet must be 'auto'")
        mode = top.get("retrieval_mode", "full")
        if mode not in MODES:
            raise RequestError(f"retrieval_mode must be one of {MODES}")
        many = {k: tuple(top[k]) if k in top else None for k in ("entity_types", "include_paths", "exclude_paths")}
        return Search(
            top["text"],
            top.get("top_k", 10),
            many["entity_types"],
            many["include_paths"],
            many["exclude_paths"] or (),
            top.get("workspace_id"),
            top.get("diversity"),
            mode,
            "snippet" in top,
            None if walk is None else walk.get("resolve_top_k", 3),
            None if walk is None or "relationships" not in walk else tuple(walk["relationships"]),
            "both" if walk is None else walk.get("direction", "both"),
        )
