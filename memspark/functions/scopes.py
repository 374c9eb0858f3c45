"""Predicates on scopes, times, lifecycle and grants."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from memspark.sources.model import SCOPE_DIMS, T_INVALID_OPEN


def _all(parts: list[Column]) -> Column:
    return reduce(and_, parts, F.lit(True)) if not parts else reduce(and_, parts)


def exact(scope: dict[str, str], dims: tuple[str, ...] = SCOPE_DIMS, prefix: str = "") -> Column:
    """Every dimension equal; a missing one has to be empty. Leave session out of dims for documents."""
    return _all([F.col(prefix + d) == scope.get(d, "") for d in dims])


def hierarchical(scope: dict[str, str], dims: tuple[str, ...] = SCOPE_DIMS, prefix: str = "") -> Column:
    """Only dimensions that are given; the space is bound whenever the organisation is."""
    bound = [d for d in dims if scope.get(d) or (d == "space" and scope.get("org"))]
    return _all([F.col(prefix + d) == scope.get(d, "") for d in bound])


def covered_by(parent: dict[str, Column], child: dict[str, Column], require_empty: tuple[str, ...] = (), require_nonempty: tuple[str, ...] = ()) -> Column:
    """Each dimension of the parent is empty or the child's; some of the child's have to be empty, or not."""
    parts = [(parent[d] == "") | (parent[d] == child[d]) for d in parent]
    return _all(parts + [child[d] == "" for d in require_empty] + [child[d] != "" for d in require_nonempty])


def scope_covers(outer: dict[str, Column], inner: dict[str, Column]) -> Column:
    """Ordered dimensions: the outer scope's are a prefix of the inner's; after its first empty one it names none."""
    dims, ok, open_ = [*outer], F.lit(True), F.lit(False)
    for d in dims:
        ok = ok & F.when(outer[d] == "", True).otherwise(~open_ & (outer[d] == inner[d]))
        open_ = open_ | (outer[d] == "")
    return ok


def granted(action: str, now: Column) -> Column:
    """A grant row that is in force for an action at a moment."""
    return (F.col("action") == action) & F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def valid_at(at: Column, t_valid: str = "t_valid", t_invalid: str = "t_invalid") -> Column:
    """Half-open validity; open where a bound is missing."""
    return (F.col(t_valid).isNull() | (F.col(t_valid) <= at)) & (F.col(t_invalid).isNull() | (at < F.col(t_invalid)))


def engine_valid_at(at: Column, t_valid: str = "t_valid", t_invalid: str = "t_invalid") -> Column:
    """As valid_at; a window that is not positive is valid before its end."""
    empty = F.coalesce(F.col(t_invalid) <= F.col(t_valid), F.lit(False))
    return F.when(empty, at < F.col(t_invalid)).otherwise(valid_at(at, t_valid, t_invalid))


def system_predicate(as_of: int | None = None, include_archived: bool = False) -> Column:
    """What search may see: by state now, or by validity (epoch milliseconds) at a moment."""
    if as_of is None:
        return F.col("lifecycle").isin("active", "archived") if include_archived else F.col("lifecycle") == "active"
    at = F.lit(as_of)
    return (F.col("lifecycle") != "forgotten") & (F.col("t_valid").isNull() | (F.col("t_valid") <= at)) & (F.coalesce(F.col("t_invalid"), F.lit(T_INVALID_OPEN)) > at)


def event_window(start: int | None, end: int | None, event: str = "t_event") -> Column:
    """Event time in [start, end), or unknown."""
    parts = ([F.col(event) >= start] if start is not None else []) + ([F.col(event) < end] if end is not None else [])
    return F.col(event).isNull() | _all(parts)


def passes_lifecycle(at: Column | None, include_archived: bool, now: Column) -> Column:
    """State and validity: with a moment anything not forgotten that was valid then; without, what is live and valid now."""
    if at is not None:
        return (F.col("lifecycle") != "forgotten") & valid_at(at)
    live = F.col("lifecycle").isin("active", "archived") if include_archived else F.col("lifecycle") == "active"
    return live & valid_at(now)


def hierarchy_hit(kind: str | None, roles: tuple[str, ...], start: Column | None, end: Column | None) -> Column:
    """Tree nodes asked for; without a kind, everything but generated time parents."""
    if kind is None:
        return not_generated()
    parts = [F.col("h_kind") == kind, F.col("h_status") == "active"]
    if roles:
        parts.append(F.col("h_role").isin(*roles))
    if end is not None:
        parts.append(F.col("span_start") <= end)
    if start is not None:
        parts.append(F.col("span_end") >= start)
    return _all(parts)


GENERATED = ("time_span", "scene", "event")
LADDER = ("leaf", "time_span", "scene", "event")


def not_generated() -> Column:
    return ~F.coalesce((F.col("h_kind") == "time") & F.col("h_role").isin(*GENERATED), F.lit(False))


def roles_up_to(role: str) -> tuple[str, ...]:
    """A target role and all lower ones."""
    return LADDER[: LADDER.index(role) + 1]


def selected(ids: list[str] | None = None, tags: list[str] | None = None, before: int | None = None, after: int | None = None, extra: Column | None = None) -> Column:
    """What a delete or update names: ids, any of the tags, message time strictly before and after, a filter. Nothing named is an error."""
    parts = []
    if ids:
        parts.append(F.col("unit_id").isin(*ids))
    if tags:
        parts.append(F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, tags))), F.lit(False)))
    if before is not None:
        parts.append(F.col("t_message") < before)
    if after is not None:
        parts.append(F.col("t_message") > after)
    if extra is not None:
        parts.append(extra)
    if not parts:
        raise ValueError("a selector has to name something")
    return _all(parts)


def in_shards(labels: list[str]) -> Column:
    """Rows whose present or next shard is among the labels."""
    return reduce(or_, [F.col("shard").isin(*labels), F.coalesce(F.col("shard_next").isin(*labels), F.lit(False))])


def shard_labels(text: str | None, known: tuple[str, ...]) -> list[str] | None:
    """A shard argument: None if missing; an empty or unknown one is an error."""
    if text is None:
        return None
    labels = [x.strip() for x in text.split(",") if x.strip()]
    if not labels:
        raise ValueError("an empty shard argument")
    if unknown := [x for x in labels if x not in known]:
        raise ValueError(f"unknown shards {unknown}")
    return labels


def project_default(has_project: bool) -> Column:
    """Without a predicate on projects only rows of no project are meant."""
    return F.lit(True) if has_project else F.coalesce(F.col("project"), F.lit("")) == ""


def text_facets(needle: str | None = None, **equal: str | None) -> Column:
    """Facets of a personal list: equal columns, and a substring of content and tags in any case."""
    parts = [F.col(k) == v for k, v in equal.items() if v]
    if needle:
        parts.append(F.instr(F.lower(F.concat_ws(" ", "content", F.concat_ws(" ", "tags"))), needle.lower()) > 0)
    return _all(parts)


def route(rules: list[tuple[Column, str]], default: str | None) -> Column:
    """The first rule that holds names the shard; without a default an unmatched row is an error."""
    if not rules:
        raise ValueError("no rules")
    out = F.when(*rules[0])
    for cond, shard in rules[1:]:
        out = out.when(cond, shard)
    return out.otherwise(F.lit(default) if default is not None else F.raise_error(F.lit("no shard rule matches")).cast("string"))
