"""Fusion of channels, thresholds, bands, budgets and disclosure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as t
from memspark.operators.recall import RRF_K

#: The width of a score band, and by how much rounding may miss its closed edge.
BAND, BAND_EPSILON = 0.05, 1e-9

def merge_layers(hits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Within a channel the best hit of each unit across its layers."""
    keys = keys or []
    return hits.groupBy(*keys, "channel", "unit_id").agg(F.max("score").alias("score"))


def ranked(hits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """0-based rank in each channel, ties by id."""
    w = Window.partitionBy(*(keys or []), "channel").orderBy(F.desc("score"), "unit_id")
    return hits.withColumn("rank", F.row_number().over(w) - 1)


def _weight(weights: dict[str, float] | None) -> Column:
    if not weights:
        return F.lit(1.0)
    out = None
    for k, v in weights.items():
        out = F.when(F.col("channel") == k, v) if out is None else out.when(F.col("channel") == k, v)
    return out.otherwise(1.0)


def rrf(hits: DataFrame, k: int = RRF_K, weights: dict[str, float] | None = None, keys: list[str] | None = None, first_rank: int = 0) -> DataFrame:
    """Sum of weight / (k + place) over channels, places counted from 1, with the evidence; first_rank says from which number the evidence counts ranks."""
    keys = keys or []
    r = ranked(merge_layers(hits, keys), keys)
    part = _weight(weights) / (k + F.col("rank") + 1)
    each = r.withColumn("contribution", part).withColumn("rank", F.col("rank") + first_rank)
    return each.groupBy(*keys, "unit_id").agg(F.sum("contribution").alias("score"), F.array_sort(F.collect_list(F.struct("channel", "rank", F.col("score").alias("raw"), "contribution"))).alias("evidence"))


def comb_max(hits: DataFrame, weights: dict[str, float] | None = None, keys: list[str] | None = None) -> DataFrame:
    """The best over channels of the weighted score divided by the channel's maximum (0 if that is not positive)."""
    keys = keys or []
    m = merge_layers(hits, keys)
    top = m.groupBy(*keys, "channel").agg(F.max("score").alias("_top"))
    norm = m.join(top, [*keys, "channel"]).withColumn("norm", F.when(F.col("_top") > 0, F.col("score") / F.col("_top")).otherwise(0.0) * _weight(weights))
    return norm.groupBy(*keys, "unit_id").agg(F.max("norm").alias("score"))


def comb_max_bm25(hits: DataFrame, lexical: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """comb_max raised, never lowered, by bm25 divided by its maximum in the pool."""
    base = comb_max(hits, weights)
    lex = lexical.join(base.select("unit_id"), "unit_id", "left_semi")
    top = lex.agg(F.max("score").alias("_top"))
    lifted = lex.crossJoin(F.broadcast(top)).select("unit_id", F.when(F.col("_top") > 0, F.col("score") / F.col("_top")).otherwise(0.0).alias("lex"))  # one row
    return base.join(lifted, "unit_id", "left").select("unit_id", F.greatest("score", F.coalesce("lex", F.lit(0.0))).alias("score"))


def threshold(hits: DataFrame, ratio: float, absolute: float | None = None, min_results: int = 0) -> DataFrame:
    """Positive hits at or over ratio times the best (and an absolute floor for calibrated scores); the best ones are kept up to min_results."""
    good = hits.where("score > 0")
    top = good.agg(F.max("score").alias("_top"))
    ok = F.col("score") >= F.col("_top") * ratio
    if absolute is not None:
        ok = ok & (F.col("score") >= absolute)
    out = good.crossJoin(F.broadcast(top)).where(ok).drop("_top")  # one row
    if min_results:
        out = out.unionByName(good.orderBy(F.desc("score"), "unit_id").limit(min_results)).dropDuplicates(["unit_id"])
    return out


def fixed_disclosure(rows: DataFrame, text: str, budget: int, order: list[Column], keys: list[str] | None = None) -> DataFrame:
    """The first rows by order whose token estimates fit the budget together."""
    w = Window.partitionBy(*(keys or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cost = rows.withColumn("cost", t.token_estimate(F.col(text)).cast("long"))
    return cost.withColumn("spent", F.sum("cost").over(w)).where(F.col("spent") <= budget)


def adaptive_disclosure(rows: DataFrame, budget: int, key: str = "query_id") -> DataFrame:
    """key, unit_id, level: for each row in rank order the fullest of l2, l1, l0 that the rest of the budget holds; the first that fits in none ends the list.

    A fold over the few rows of each query (at most its top_k).
    """

    def run(pdf):
        left, out = budget, []
        for r in pdf.sort_values("rank").itertuples():
            for level in ("l2", "l1", "l0"):
                body = getattr(r, level) or ""
                cost = max(1, (len(body) + 3) // 4) if body else 0
                if body and cost <= left:
                    left -= cost
                    out.append((getattr(r, key), r.unit_id, level, cost))
                    break
            else:
                break
        import pandas as pd

        return pd.DataFrame(out, columns=[key, "unit_id", "level", "cost"])

    return rows.groupBy(key).applyInPandas(run, f"{key} string, unit_id string, level string, cost long")


def banded(rows: DataFrame, band: float, key: str = "query_id") -> DataFrame:
    """Order within score bands by a secondary score. A band, closed at both edges, begins where a score falls below the band's first by more than its width; a fold over one query's few rows."""

    def run(pdf):
        pdf = pdf.sort_values(["score", "unit_id"], ascending=[False, True]).reset_index(drop=True)
        first, number, bands = None, -1, []
        for s in pdf["score"]:
            if first is None or s < first - band - BAND_EPSILON:
                first, number = s, number + 1
            bands.append(number)
        pdf["band"] = bands
        pdf = pdf.sort_values(["band", "secondary", "score", "unit_id"], ascending=[True, False, False, True])
        pdf["position"] = range(len(pdf))
        return pdf[[key, "unit_id", "band", "position"]]

    return rows.groupBy(key).applyInPandas(run, f"{key} string, unit_id string, band long, position long")


def round_robin(rows: DataFrame, quota: int, total: int, key: str = "query_id") -> DataFrame:
    """One hit from each space in turn; a space skips contents that are out already within its turn. A fold over at most `total` rows and quota a space."""

    def run(pdf):
        import pandas as pd

        spaces = {s: g.sort_values("rank").to_dict("records") for s, g in pdf.groupby("priority", sort=True)}
        at, taken, seen, out = dict.fromkeys(spaces, 0), dict.fromkeys(spaces, 0), set(), []
        moved = True
        while moved and len(out) < total:
            moved = False
            for s, items in spaces.items():
                while at[s] < len(items) and taken[s] < quota and len(out) < total:
                    r = items[at[s]]
                    at[s] += 1
                    if r["digest"] in seen:
                        continue
                    seen.add(r["digest"])
                    taken[s] += 1
                    out.append((r[key], r["unit_id"], len(out)))
                    moved = True
                    break
        return pd.DataFrame(out, columns=[key, "unit_id", "position"])

    return rows.groupBy(key).applyInPandas(run, f"{key} string, unit_id string, position long")


def scatter_merge(parts: list[DataFrame], key: str, k: int, higher: bool = True) -> DataFrame:
    """Answers of several shards: the best of each id, then the top k."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    agg = F.max("score") if higher else F.min("score")
    m = out.groupBy(key).agg(agg.alias("score"))
    return m.orderBy(F.desc("score") if higher else F.asc("score"), key).limit(k)


def interleaved(a: DataFrame, b: DataFrame, ratio: float) -> DataFrame:
    """Two ranked lists in one: a row of b whenever its credit, ratio for each row of a, reaches one. The lists are those of one query, cut to their recall width before."""
    x = a.withColumn("slot", F.col("rank") * 1.0)
    y = b.withColumn("slot", F.ceil((F.col("rank") + 1) / ratio) - 0.5)
    both = x.unionByName(y)
    return both.withColumn("position", F.row_number().over(Window.orderBy("slot", "rank", "unit_id")) - 1).drop("slot")


def must_not_exceed(rows: DataFrame, cap: int) -> DataFrame:
    """The rows; fails when there are more than the cap."""
    n = rows.limit(cap + 1).count()
    if n > cap:
        raise ValueError(f"more than {cap} rows")
    return rows


def entity_scores(hits: DataFrame, entity: str, member: str = "unit_id") -> DataFrame:
    """entity, score, units: hits of an entity's properties as one hit of the entity: its best score, and how many different members bring it."""
    return hits.groupBy(F.col(entity).alias("entity")).agg(F.max("score").alias("score"), F.countDistinct(member).alias("units"))


def post_filtered(hits: DataFrame, truth: DataFrame, keep: Column, columns: list[str] | None = None) -> DataFrame:
    """Hits whose record is there and passes, with the record's columns asked for. What has no record is no hit."""
    return hits.join(truth.where(keep).select("unit_id", *(columns or [])), "unit_id")


def projected(entities: DataFrame, mentions: DataFrame, entity: str, unit: str) -> DataFrame:
    """unit_id, score: units that mention scored entities, each with the best score of its entities. entities: entity, score."""
    return mentions.select(entity, unit).join(entities.select(entity, "score"), entity).groupBy(F.col(unit).alias("unit_id")).agg(F.max("score").alias("score"))
