"""Moves of units between shards that survive a failure between any two steps, and values kept under tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.sources.manifest import Manifest

PLACEMENT = "unit_id string, shard string, target string, digest string"
STEPS = ("mark", "copy", "verify", "switch", "retire")


class Lost(RuntimeError):
    """Another writer has committed first: read again and go on from there."""


def digest(columns: list[str]) -> Column:
    """A row's digest; null and empty differ."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


class Shards:
    """Units (unit_id and other columns) in shard tables, with a placement that says which copy counts.

    A move goes by STEPS: mark its units with their target and digest, copy them
    into the target's table, verify the copies by digest, switch the placement
    of those that have not changed since, retire the old copies. Each step makes
    new tables and commits one version, so a step that fails leaves the version
    before it, and resume() does the next step of what was begun. Readers join
    with the placement: a copy is seen nowhere before the switch, the old one
    not after it.
    """

    def __init__(self, manifest: Manifest, schema: str):
        self.log, self.schema = manifest, schema
        self.columns = [c.split()[0] for c in schema.split(", ")]

    def load(self, units: DataFrame, shard: Column) -> None:
        """The first version, from units and their shards."""
        rows = units.select(*self.columns, shard.alias("shard"))
        own = rows.select("unit_id", "shard", F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("digest"))
        tables = {f"shard:{r.shard}": [self.log.stage(rows.where(F.col("shard") == r.shard).drop("shard"), "shard")] for r in rows.select("shard").distinct().collect()}  # shards are a few names
        self._commit(0, tables | {"placement": [self.log.stage(own, "placement")]}, {})

    def _commit(self, seen: int, tables: dict, notes: dict) -> None:
        if not self.log.commit(seen, tables, notes):
            raise Lost(seen)

    def placement(self, version: int | None = None) -> DataFrame:
        return self.log.table("placement", PLACEMENT, version)

    def shard(self, name: str, version: int | None = None) -> DataFrame:
        return self.log.table(f"shard:{name}", self.schema, version)

    def rows(self, version: int | None = None) -> DataFrame:
        """Every unit once, with the shard that counts."""
        version = self.log.version() if version is None else version
        out = None
        for name in self.log.read(version)["tables"]:
            if name.startswith("shard:"):
                own = self.shard(name[6:], version).withColumn("shard", F.lit(name[6:]))
                out = own if out is None else out.unionByName(own)
        return out.join(self.placement(version).select("unit_id", "shard"), ["unit_id", "shard"])

    def begin(self, which: Column, target: str) -> None:
        """Mark the units for which the condition holds and that are elsewhere. One move at a time."""
        seen = self.log.version()
        state = self.log.read(seen)
        if state["notes"].get("step"):
            raise ValueError("a move is under way: resume it first")
        own = self.rows(seen).where(which & (F.col("shard") != target)).select("unit_id", digest(self.columns).alias("_d"))
        marked = self.placement(seen).join(own, "unit_id", "left").select("unit_id", "shard", F.when(F.col("_d").isNotNull(), target).alias("target"), F.col("_d").alias("digest"))
        self._commit(seen, state["tables"] | {"placement": [self.log.stage(marked, "placement")]}, {"step": "mark", "target": target})

    def update(self, rows: DataFrame) -> None:
        """Replace units in the shard that counts, also while a move is under way."""
        seen = self.log.version()
        state, tables = self.log.read(seen), {}
        new = rows.select(*self.columns).join(self.placement(seen).select("unit_id", "shard"), "unit_id")
        for name, paths in state["tables"].items():
            tables[name] = paths
            if name.startswith("shard:"):
                own = new.where(F.col("shard") == name[6:]).drop("shard")
                kept = self.shard(name[6:], seen).join(own.select("unit_id"), "unit_id", "left_anti")
                tables[name] = [self.log.stage(kept.unionByName(own), "shard")]
        self._commit(seen, tables, state["notes"])

    def resume(self) -> str | None:
        """Do the next step of the move under way; returns it, or None if there is none."""
        seen = self.log.version()
        state = self.log.read(seen)
        notes, tables = state["notes"], dict(state["tables"])
        step, target = notes.get("step"), notes.get("target")
        if not step:
            return None
        marked = self.placement(seen).where("target is not null").select("unit_id", "digest")
        name = f"shard:{target}"
        if step == "mark":
            copies = self.rows(seen).drop("shard").join(marked.select("unit_id"), "unit_id").select(*self.columns)
            tables[name] = [*tables.get(name, []), self.log.stage(copies, "shard")]
            notes = notes | {"step": "copy"}
        elif step == "copy":
            copies = self.shard(target, seen).select("unit_id", digest(self.columns).alias("_d"))
            missing = marked.join(copies, (marked.unit_id == copies.unit_id) & (marked.digest == F.col("_d")), "left_anti").count()
            notes = notes | {"step": "verify", "changed": missing}
        elif step == "verify":
            # compared and swapped: only units whose row is still the one that was marked and copied
            now = self.rows(seen).select("unit_id", digest(self.columns).alias("_now"))
            same = marked.join(now, "unit_id").where("digest = _now").select("unit_id", F.lit(True).alias("_ok"))
            copied = self.shard(target, seen).select("unit_id", digest(self.columns).alias("_c")).join(marked, "unit_id").where("digest = _c").select("unit_id").distinct()
            moved = self.placement(seen).join(same.join(copied, "unit_id", "left_semi"), "unit_id", "left")
            shard = F.when(F.col("_ok") & F.col("target").isNotNull(), F.col("target")).otherwise(F.col("shard"))
            none = F.lit(None).cast("string")
            tables["placement"] = [self.log.stage(moved.select("unit_id", shard.alias("shard"), none.alias("target"), none.alias("digest")), "placement")]
            notes = notes | {"step": "switch"}
        else:
            # copies that do not count go, the old ones and those of units that stayed
            for key in [k for k in tables if k.startswith("shard:")]:
                own = self.placement(seen).where(F.col("shard") == key[6:]).select("unit_id")
                tables[key] = [self.log.stage(self.shard(key[6:], seen).join(own, "unit_id", "left_semi"), "shard")]
            notes = {}
        self._commit(seen, tables, notes)
        return {"mark": "copy", "copy": "verify", "verify": "switch", "switch": "retire"}[step]

    def move(self, which: Column, target: str) -> None:
        """A whole move; after a failure call resume() until it returns None."""
        self.begin(which, target)
        while self.resume():
            pass


FRAGMENTS = "scope string, token string, value binary, level int"
SNAPSHOTS = "scope string, snapshot string, tokens array<string>"


class PrivacyStore:
    """Values under tokens and snapshots of tokens, encrypted with their scope and token as context.

    What is staged is seen by nobody; commit() adds the staged rows of all
    tables in one version, so readers see all of a transaction or nothing of it,
    and one that stops before its commit leaves no trace. A read is of one
    version.
    """

    def __init__(self, manifest: Manifest, key: str):
        self.log, self.key = manifest, F.lit(key)

    def _context(self) -> Column:
        return F.concat_ws("\0", "scope", "token")

    def begin(self) -> dict:
        return {"seen": self.log.version(), "fragments": [], "snapshots": []}

    def stage_fragments(self, work: dict, rows: DataFrame) -> None:
        """rows: scope, token, value (string), level. A token that the scope has, or twice in the rows, is an error."""
        own = rows.select("scope", "token")
        if own.count() != own.distinct().count() or own.join(self.fragments(work["seen"]), ["scope", "token"], "left_semi").limit(1).count():
            raise ValueError("a token is used once in a scope")
        sealed = F.aes_encrypt(F.col("value").cast("binary"), self.key, F.lit("GCM"), F.lit("DEFAULT"), F.expr("cast('' as binary)"), self._context().cast("binary"))
        work["fragments"].append(self.log.stage(rows.select("scope", "token", sealed.alias("value"), F.col("level").cast("int").alias("level")), "fragments"))

    def stage_snapshots(self, work: dict, rows: DataFrame) -> None:
        work["snapshots"].append(self.log.stage(rows.select("scope", "snapshot", "tokens"), "snapshots"))

    def commit(self, work: dict) -> bool:
        """False if another transaction came first: nothing of this one is seen."""
        tables = self.log.read(work["seen"])["tables"]
        new = {k: [*tables.get(k, []), *work[k]] for k in ("fragments", "snapshots")}
        return self.log.commit(work["seen"], tables | new)

    def fragments(self, version: int | None = None) -> DataFrame:
        """The tables as they are stored."""
        return self.log.table("fragments", FRAGMENTS, version)

    def opened(self, scope: str, most: int, version: int | None = None) -> DataFrame:
        """token and value of a scope's fragments up to a level."""
        own = self.fragments(version).where((F.col("scope") == scope) & (F.col("level") <= most))
        return own.select("token", F.aes_decrypt("value", self.key, F.lit("GCM"), F.lit("DEFAULT"), self._context().cast("binary")).cast("string").alias("value"))

    def snapshot(self, scope: str, name: str, version: int | None = None) -> DataFrame:
        """The stored fragments of a snapshot: both tables of one version."""
        version = self.log.version() if version is None else version
        own = self.log.table("snapshots", SNAPSHOTS, version).where((F.col("scope") == scope) & (F.col("snapshot") == name))
        return self.fragments(version).join(own.select("scope", F.explode("tokens").alias("token")), ["scope", "token"], "left_semi")
