"""The public verbs over tables of units. Every verb returns plans; writing is the caller's."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import predicates as p
from memspark.functions import scopes as s
from memspark.functions import text as t
from memspark.operators import fuse, govern, lifecycle, recall
from memspark.operators.postings import NAMED, TextIndex
from memspark.sources.connectors import inserted, paged
from memspark.sources.scratch import written


#: Pipelines by name: the options of a search. A search's own options come before them.
PIPELINES: dict[str, dict] = {
    "keyword": {"channels": ("keyword",), "fuser": "comb_max"},
    "hybrid": {"channels": ("keyword", "bm25"), "fuser": "rrf"},
    "vector": {"channels": ("vector",), "fuser": "comb_max"},
}


def channels_of(asked: tuple[str, ...] | None, pipeline: tuple[str, ...] | None, default: tuple[str, ...]) -> tuple[str, ...]:
    """The query's channels, else the pipeline's, else the default ones; a given empty list is an error."""
    chosen = next(c for c in (asked, pipeline, default) if c is not None)
    if not chosen:
        raise ValueError("no channel")
    return tuple(dict.fromkeys(chosen))


@dataclass(frozen=True)
class Engine:
    """units has unit_id, content, lifecycle, tier, tags, t_event, t_ingest, t_valid, t_invalid, t_message (epoch milliseconds), importance, provenance, supersedes and the scope's columns; vectors: unit_id, vector; index: a full-text index of these units, from which searches are answered if there is one."""

    units: DataFrame
    vectors: DataFrame | None = None
    scope_dims: tuple[str, ...] = ("space", "user_id")
    index: TextIndex | None = None

    def _filter(self, filters: dict | list | None) -> Column:
        return F.lit(True) if filters is None else p.predicate(p.parse(filters), p.resolver(self.units.dtypes))

    def add(self, new: DataFrame) -> Engine:
        """Units appended; an id that is there already fails."""
        return replace(self, units=inserted(self.units, new, ["unit_id"]))

    def batch_add(self, items: DataFrame, spaces: DataFrame | None = None) -> tuple[Engine, DataFrame]:
        """The engine with the items that can be added, and each item with its outcome: added, conflict (an id that is there, or a second time), empty content or unknown space. No item stops the others."""
        known = self.units.select("unit_id", F.lit(True).alias("_there"))
        first = Window.partitionBy("unit_id").orderBy("content")
        j = items.withColumn("_n", F.row_number().over(first)).join(known, "unit_id", "left")
        good = F.lit(True)
        if spaces is not None:
            j = j.join(spaces.select("space", F.lit(True).alias("_space")).distinct(), "space", "left")
            good = F.coalesce("_space", F.lit(False))
        outcome = F.when(F.trim(F.coalesce("content", F.lit(""))) == "", "empty content").when(~good, "unknown space").when(F.coalesce("_there", F.lit(False)) | (F.col("_n") > 1), "conflict").otherwise("added")
        report = j.withColumn("outcome", outcome).select(*items.columns, "outcome")
        new = report.where("outcome = 'added'").drop("outcome")
        if "lifecycle" not in new.columns:
            new = new.withColumn("lifecycle", F.lit("active"))
        return replace(self, units=self.units.unionByName(new, allowMissingColumns=True)), report

    def batch_update(self, patch: dict[str, Column], limit: int | None = None, mode: str = "overwrite", at: int | None = None, **selector) -> Engine:
        """What a selector names (the oldest first, up to a limit) patched: overwrite sets fields in place; supersede closes active units at a moment and adds versions named unit_id + "+"."""
        chosen = self.units.where(s.selected(**selector))
        if mode == "supersede":
            chosen = chosen.where("lifecycle = 'active'")
        if limit is not None:
            chosen = chosen.orderBy("t_ingest", "unit_id").limit(limit)
        marked = self.units.join(chosen.select("unit_id", F.lit(True).alias("_hit")), "unit_id", "left")
        hit = F.coalesce("_hit", F.lit(False))
        if mode == "overwrite":
            return replace(self, units=marked.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in patch.items()}).select(*self.units.columns))
        if mode != "supersede":
            raise ValueError(mode)
        moment = F.lit(at).cast("long")
        old = marked.withColumn("lifecycle", F.when(hit, "superseded").otherwise(F.col("lifecycle"))).withColumn("t_invalid", F.when(hit, moment).otherwise(F.col("t_invalid"))).select(*self.units.columns)
        new = chosen.withColumns(patch).withColumn("supersedes", F.col("unit_id")).withColumn("unit_id", F.concat("unit_id", F.lit("+"))).withColumn("t_valid", moment).select(*self.units.columns)
        return replace(self, units=old.unionByName(new))

    def usage(self, by: str = "space") -> DataFrame:
        """Memories, characters and active ones of each space."""
        return self.units.groupBy(by).agg(F.count("*").alias("memories"), F.sum(F.length("content")).alias("chars"), F.count_if(F.col("lifecycle") == "active").alias("active"))

    def search(self, query: str | list[str], scope: dict[str, str], top_k: int = 10, filters: dict | None = None, as_of: int | None = None, include_archived: bool = False, channels: tuple[str, ...] = ("keyword", "bm25"), fuser: str = "rrf", vector: list[float] | None = None, ratio: float = 0.0, level: str = "l0") -> DataFrame:
        """Recall by channels, fuse, re-check, cut and disclose: unit_id, score, text. Predicates hold before any channel's top k.

        With an index the lexical channels read postings and the narrow columns
        of the units that the predicates let through, and of the texts only the
        row groups of the hits; the rows are the same as without.
        """
        words = query if isinstance(query, list) else t_words(query)
        if not channels:
            raise ValueError("no channel")
        seen = (self.units if self.index is None else self.index.texts()).where(s.hierarchical(scope, self.scope_dims) & s.system_predicate(as_of, include_archived) & self._filter(filters))
        k = recall.width(top_k)
        hits = []
        lexical = {"keyword", "bm25"}.intersection(channels)
        counts = None
        if lexical:
            counts = recall.term_counts(seen, words) if self.index is None else self.index.pool_counts(words, seen)
        if len(lexical) > 1:
            counts = written(counts, "term-counts")  # the texts are read once for both
        for channel in channels:
            if channel == "keyword":
                hits.append(recall.best(recall.keyword_of(counts, words), k))
            elif channel == "bm25":
                own = recall.bm25_of(counts, words) if self.index is None else self.index.pool_bm25(counts, words, seen)
                hits.append(recall.best(own, k).withColumn("channel", F.lit("bm25")))
            elif channel == "vector":
                if vector is None or self.vectors is None:
                    raise ValueError("the vector channel needs a vector")
                hits.append(recall.vector(self.vectors.join(seen.select("unit_id"), "unit_id", "left_semi"), vector, k))
            else:
                raise ValueError(f"unknown channel {channel}")
        all_hits = hits[0]
        for h in hits[1:]:
            all_hits = all_hits.unionByName(h)
        fused = {"rrf": lambda: fuse.rrf(all_hits).drop("evidence"), "comb_max": lambda: fuse.comb_max(all_hits)}[fuser]()
        cut = fuse.threshold(fused, ratio).orderBy(F.desc("score"), "unit_id").limit(top_k)
        body = {"l0": t.first_sentence(F.col("content")), "l1": F.substring("content", 1, 200), "l2": F.col("content")}[level]
        if self.index is not None and top_k <= NAMED:
            cut = written(cut, "search-hits")
            places = [r.place for r in seen.select("unit_id", "place").join(F.broadcast(cut), "unit_id").select("place").collect()]  # top_k rows
            seen = self.index.contents(places)
        return seen.select("unit_id", body.alias("text")).join(F.broadcast(cut), "unit_id").select("unit_id", "score", "text").orderBy(F.desc("score"), "unit_id")

    def named(self, pipeline: str, query: str | list[str], scope: dict[str, str], **options) -> DataFrame:
        """A search by a named pipeline."""
        if pipeline not in PIPELINES:
            raise ValueError(f"no pipeline named {pipeline}; there are {sorted(PIPELINES)}")
        preset = PIPELINES[pipeline]
        channels = channels_of(options.pop("channels", None), preset.get("channels"), ("keyword", "bm25"))
        return self.search(query, scope, **{**preset, **options, "channels": channels})

    def list(self, scope: dict[str, str], offset: int = 0, limit: int = 50, filters: dict | None = None) -> DataFrame:
        rows = self.units.where(s.exact(scope, self.scope_dims) & self._filter(filters))
        return paged(rows, [F.coalesce("t_ingest", F.lit(-(2**63))).desc(), F.desc("unit_id")], offset, limit)

    def get(self, unit_id: str, as_of: int | None = None) -> DataFrame:
        """A unit; with a moment the version of its family that was valid then, with the greatest start."""
        own = self.units.where(F.col("unit_id") == unit_id)
        if as_of is None:
            return own
        links = self.units.where("supersedes IS NOT NULL").select(F.col("unit_id").alias("a"), F.col("supersedes").alias("b"))
        family = recall.bfs(links, own.select(F.col("unit_id").alias("node"))).select(F.col("node").alias("unit_id"))
        valid = self.units.join(family, "unit_id", "left_semi").where(s.engine_valid_at(F.lit(as_of)))
        return valid.orderBy(F.desc_nulls_last("t_valid"), "unit_id").limit(1)

    def update(self, patch: DataFrame) -> Engine:
        """Overwrite fields that the patch has."""
        return replace(self, units=lifecycle.overlay(self.units, patch, "unit_id"))

    def supersede(self, new: DataFrame, key: str) -> Engine:
        return replace(self, units=lifecycle.supersede(self.units, new, key))

    def delete(self, mode: str, **selector) -> Engine:
        """purge (with all that was derived), archive, forget or downweight what a selector names; superseded units only for purge."""
        chosen = s.selected(**selector)
        if mode == "purge":
            links = self.units.select(F.explode("provenance").alias("src"), F.col("unit_id").alias("dst"))
            gone = recall.reached(links, self.units.where(chosen).select(F.col("unit_id").alias("node")))
            return replace(self, units=self.units.join(gone.select(F.col("node").alias("unit_id")), "unit_id", "left_anti"))
        chosen = chosen & (F.col("lifecycle") != "superseded")
        if mode == "downweight":
            return replace(self, units=self.units.withColumn("importance", F.when(chosen, lifecycle.downweight(F.col("importance"))).otherwise(F.col("importance"))))
        target = {"archive": "archived", "forget": "forgotten"}[mode]
        return replace(self, units=self.units.withColumn("lifecycle", F.when(chosen, lifecycle.transitioned(F.col("lifecycle"), target)).otherwise(F.col("lifecycle"))))

    def evolve(self, mode: str, **options) -> DataFrame:
        """associate: pairs that share tokens; dedup: newest of equal contents; sweep: superseded and expired units go where the policy says."""
        if mode == "associate":
            return recall.token_pairs(self.units.where("lifecycle = 'active'"), t.terms(F.col("content")), options.get("least", 3), [*self.scope_dims])
        if mode == "dedup":
            return lifecycle.newest_of_equal(self.units, [*self.scope_dims], "content", [F.desc("t_ingest"), F.desc("unit_id")])
        if mode == "sweep":
            return lifecycle.sweep(self.units, F.lit(options["now"]), options.get("superseded", "forgotten"), options.get("expired", "forgotten"))
        raise ValueError(mode)

    def candidates(self, kind: str, **options) -> DataFrame:
        """Units for evolution: by predicate, ids, recall, or fan_out over scopes with a cap for each."""
        if kind == "predicate":
            return self.units.where(self._filter(options["filters"]))
        if kind == "ids":
            return self.units.where(F.col("unit_id").isin(*options["ids"]))
        if kind == "recall":
            return self.units.join(self.search(**options).select("unit_id"), "unit_id", "left_semi")
        if kind == "fan_out":
            return govern.top_by(self.units, [*self.scope_dims], [F.asc("t_ingest"), F.asc("unit_id")], options["cap"])
        raise ValueError(kind)

    def trace(self, unit_id: str, depth: int | None = None) -> DataFrame:
        """What a unit was derived from, with the number of steps; all of it unless a depth is asked for."""
        links = self.units.select(F.col("unit_id").alias("src"), F.explode("provenance").alias("dst"))
        return recall.reached(links, self.units.where(F.col("unit_id") == unit_id).select(F.col("unit_id").alias("node")), depth)


def t_words(query: str) -> list[str]:
    """A query's tokens, in order, by the rule that texts follow."""
    import re

    return re.findall(r"[0-9a-z]+|[一-鿿]", query.lower())
