"""Joins that tie units to each other: coreference, similarity, duplicates, entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as t
from memspark.operators.govern import top_by
from memspark.sources.scratch import written


#: Vectors of a block that one task holds, from each side.
CHUNK = 4096
#: Rows whose blocks are broadcast, and over how many parts a key is dealt beyond that, in by_blocks().
HELD, DEALT = 1 << 22, 64
#: Rows of a block of blocked() at most, about.
BLOCK = 1 << 16
#: Of the blocks over that size, the largest ones, with their numbers of parts, are broadcast; no more than these.
HOT_BLOCKS = 50_000
#: The same for sets of tokens, and pairs that a task has at a time, about.
TOKEN_CHUNK, SLAB = 8192, 1 << 20
#: Rows of one side whose pairs are made one after the other: short runs that come again for each row of the other side, so written pairs stay small.
TILE = 64


def _ranker():
    """A function of both sides' ids: the ids in their order, and each side's places there. Made anew, so tasks get it by value."""

    def ranked(x: list, y: list):
        import numpy as np
        import pyarrow as pa

        both = sorted({*x, *y})
        place = {key: k for k, key in enumerate(both)}
        return pa.array(both), [np.array([place[key] for key in side]) for side in (x, y)]

    return ranked


def _products(left: DataFrame, right: DataFrame, block: list[str], emit, schema: str, half: bool = False, limit: int | None = None, place: str | None = None) -> DataFrame:
    """emit(left ids, left vectors, right ids, right vectors) -> iterator of Arrow columns, for all of left (id, block, v) against all of right in the same block.

    A block over CHUNK (limit) rows is cut on both sides and its parts are dealt out in
    pairs, so a task holds two parts of CHUNK rows, however large a block or
    the table is. The largest blocks' numbers of parts are broadcast; a block
    that is not among them has a small share of all rows, and meets its number
    by a shuffle. With ``half`` (left and right are the same rows) each pair of
    parts is taken once. Rows are dealt to parts by a hash of their id, or by
    their place in the block (a column, from 0) where like ones are to lie together.
    """
    limit = limit or CHUNK
    sizes = left.select(*block, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*block, F.lit(0).alias("l"), F.lit(1).alias("r"))).groupBy(*block).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    cuts = lambda c: F.ceil(F.col(c) / limit).cast("int")
    large = written(sizes.where((F.col("l") > limit) | (F.col("r") > limit)).select(*block, "l", "r", F.greatest(F.lit(1), cuts("l")).alias("_l"), F.greatest(F.lit(1), cuts("r")).alias("_r")), "block-parts")
    bound = None
    if large.count() > HOT_BLOCKS:
        bound = large.select((F.col("l") + F.col("r")).alias("n")).orderBy(F.desc("n")).limit(HOT_BLOCKS).agg(F.min("n")).first()[0]
    drop = lambda rows: rows.select(*block, "_l", "_r")
    hot = F.broadcast(drop(large if bound is None else large.where(F.col("l") + F.col("r") > bound)))
    mild = None if bound is None else drop(large.where(F.col("l") + F.col("r") <= bound))

    def parted(rows: DataFrame) -> DataFrame:
        out = rows.join(hot, block, "left")
        if mild is None:
            return out
        rest = out.where("_l is null").drop("_l", "_r").join(mild, block, "left")
        return out.where("_l is not null").unionByName(rest)

    def placed(rows: DataFrame, own: str, other: str, side: int) -> DataFrame:
        part = (F.pmod(F.xxhash64("id"), F.coalesce(F.col(own), F.lit(1))) if place is None else F.floor(F.col(place) / limit)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
        rows = parted(rows).select("id", "v", *block, part.alias(f"{own}p"), each.alias(f"{other}p"))
        return rows.select(*block, "_lp", "_rp", F.lit(side).alias("side"), "id", "v")

    def run(batches):
        import pyarrow as pa

        group, ids, vs = None, ([], []), ([], [])

        def out():
            for cols in emit(ids[0], vs[0], ids[1], vs[1]) if ids[0] and ids[1] else ():
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names)

        width = len(block) + 2
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(width + 3)]
            for row in zip(*columns, strict=True):
                if row[:width] != group:
                    yield from out()
                    group, ids, vs = row[:width], ([], []), ([], [])
                side, key, v = row[width:]
                ids[side].append(key)
                vs[side].append(v)
        yield from out()

    names = [f.split()[0] for f in schema.split(", ")]
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = placed(left, "_l", "_r", 0).unionByName(placed(right, "_r", "_l", 1))
    if half:
        both = both.where("_lp <= _rp")
    return both.repartition(n, *block, "_lp", "_rp").sortWithinPartitions(*block, "_lp", "_rp", "side").mapInArrow(run, schema)


def by_blocks(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of left with each block of the right's rows of the same key: right_key and block, an array of structs of its other columns.

    What holds for a key is asked of a block, and F.inline("block") makes the
    pairs. Left's rows are dealt out by all their columns, so a frequent key is
    no single task. Blocks are broadcast after a count; beyond HELD rows they
    are shuffled to DEALT parts of their key. Null keys meet nothing.
    """
    n, others = right.count(), [c for c in right.columns if c != right_key]
    block = F.pmod(F.xxhash64(*others), F.lit(max(1, n // CHUNK)))
    blocks = right.groupBy(right_key, block.alias("_block")).agg(F.collect_list(F.struct(*others)).alias("block")).drop("_block")
    same = F.col(left_key) == F.col(right_key)
    if n <= HELD:
        parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return left.repartition(parts, *left.columns).join(F.broadcast(blocks), same)
    own = left.withColumn("_part", F.pmod(F.xxhash64(*left.columns), F.lit(DEALT)).cast("int"))
    every = blocks.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    return own.join(every, same & (F.col("_part") == F.col("_to"))).drop("_part", "_to")


def blocked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows of the same keys in blocks: the keys, and an array of structs of the other columns. There are as many blocks of frequent keys as tasks, and more where these would pass BLOCK rows."""
    others, parts = [c for c in rows.columns if c not in keys], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.pmod(F.xxhash64(*others), F.lit(max(parts, rows.count() // BLOCK)))
    return rows.groupBy(*keys, block.alias("_block")).agg(F.collect_list(F.struct(*others)).alias(name)).drop("_block")


def tiled(met: DataFrame, left: str, right: str) -> DataFrame:
    """The pairs of two arrays of structs: TILE rows of the right with each of the left, then the next ones, so written pairs are short runs that come again."""
    starts = F.sequence(F.lit(1), F.size(right), F.lit(TILE))
    tiles = met.select(left, F.explode(F.transform(starts, lambda at: F.slice(right, at, TILE))).alias("_tile"))
    return tiles.select("_tile", F.inline(left)).select(*met.schema[left].dataType.elementType.names, F.inline("_tile"))


def coreferences(mentions: DataFrame) -> DataFrame:
    """a, b, score: units that share an entity; the mean over shared entities of the two mean confidences. mentions: unit_id, entity, confidence.

    Units of an entity are paired in blocks, each with all of its entities, and
    a pair is passed on in the block of the first entity that it shares: what is
    shuffled are mentions, never pairs, which are as many as the result. Parts
    of a block have mentions of like confidence, and their pairs come in tiles.
    """
    m = mentions.where("unit_id IS NOT NULL AND entity IS NOT NULL").groupBy("unit_id", "entity").agg(F.avg("confidence").alias("c"))
    all_ = m.groupBy("unit_id").agg(F.collect_list(F.struct("entity", "c")).alias("all"))
    other = F.filter("all", lambda x: x["entity"] != F.col("entity"))
    # a block's mentions are sorted by one task, which is little beside its pairs
    place = F.row_number().over(Window.partitionBy("entity").orderBy("c", "unit_id")) - 1
    ranked, tile, slab = _ranker(), TILE, SLAB // 4
    v = written(m.withColumn("place", place).join(all_, "unit_id").select(F.col("unit_id").alias("id"), "entity", "place", F.struct("entity", "c", other.alias("rest")).alias("v")), "mentions")

    def emit(x, vx, y, vy):
        import numpy as np
        import pyarrow as pa

        own, first = sorted(x) == sorted(y), vx[0]["entity"]
        names, (rx, ry) = ranked(x, y)

        def numbers(cs):
            return np.array([0.0 if c is None else c for c in cs]), np.array([c is not None for c in cs])

        def rest(vs, order):
            found = {}
            for i, k in enumerate(order):
                for r in vs[k]["rest"]:
                    found.setdefault(r["entity"], ([], []))[0].append(i)
                    found[r["entity"]][1].append(r["c"])
            return {e: (np.array(at), *numbers(cs)) for e, (at, cs) in found.items()}

        def means(a, ka, b, kb):
            both = ka[:, None] & kb[None, :]
            return np.where(both, (a[:, None] + b[None, :]) / 2, 0.0), both

        # one side by id, so that few rows of a tile change sides from one to the next; the other by confidence, so that equal scores follow each other
        (cx, kx), (cy, ky) = numbers([v["c"] for v in vx]), numbers([v["c"] for v in vy])
        by_x, by_y = np.argsort(rx), np.lexsort((ry, cy, ~ky))
        rx, cx, kx, ry, cy, ky = rx[by_x], cx[by_x], kx[by_x], ry[by_y], cy[by_y], ky[by_y]
        fx, fy = rest(vx, by_x), rest(vy, by_y)
        shared, step = sorted(fx.keys() & fy.keys()), max(tile, slab // len(x))
        for low in range(0, len(y), step):
            r = ry[low : low + step]
            total, n = means(cx, kx, cy[low : low + step], ky[low : low + step])
            keep, n = rx[:, None] != r[None, :], n.astype(np.int32)
            for e in shared:
                (i, ci, ki), (j, cj, kj) = fx[e], fy[e]
                some = slice(*np.searchsorted(j, (low, low + step)))
                if some.start < some.stop:
                    at = np.ix_(i, j[some] - low)
                    more, both = means(ci, ki, cj[some], kj[some])
                    total[at] += more
                    n[at] += both
                    if e < first:
                        keep[at] = False
            score, none = total / np.maximum(n, 1), n == 0
            before = rx[:, None] < r[None, :]
            for way in (before, ~before)[: 1 if own else 2]:
                i, j = np.nonzero(keep & way)
                if len(i):
                    a, b = (rx[i], r[j]) if way is before else (r[j], rx[i])
                    yield [names.take(pa.array(a)), names.take(pa.array(b)), pa.array(score[i, j], mask=none[i, j])]

    kind = dict(mentions.dtypes)["unit_id"]
    return _products(v, v, ["entity"], emit, f"a {kind}, b {kind}, score double", half=True, place="place")


def token_pairs(units: DataFrame, token: Column, least: int, block: list[str] | None = None, share: float | None = None) -> DataFrame:
    """a, b, common: pairs of units, a before b, that share so many distinct tokens; with ``share`` a, b, score: those whose Jaccard similarity reaches it.

    Units of a block are paired in parts of TOKEN_CHUNK; equal sets of tokens
    are compared once in a task, and only pairs of the result leave it, in
    tiles: what is shuffled are units, never pairs or candidates for them.
    """
    own = units.where("unit_id IS NOT NULL").withColumn("_t", token)
    if block:
        own = own.where(" AND ".join(f"`{c}` IS NOT NULL" for c in block))
    else:
        block, own = ["_all"], own.withColumn("_all", F.lit(0))
    sets = own.groupBy("unit_id", *block).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_t")))).alias("v")).where(F.size("v") >= least)
    v = written(sets.select(F.col("unit_id").alias("id"), *block, "v"), "token-sets")
    ranked, tile, most = _ranker(), TILE, SLAB // 4

    def emit(x, vx, y, vy):
        import numpy as np
        import pyarrow as pa

        own = sorted(x) == sorted(y)
        names, (rx, ry) = ranked(x, y)

        def classes(rows):
            found: dict[tuple, int] = {}
            return np.array([found.setdefault(tuple(r), len(found)) for r in rows]), list(found)

        def places(sets):
            found: dict[str, list[int]] = {}
            for k, tokens in enumerate(sets):
                for word in tokens:
                    found.setdefault(word, []).append(k)
            return found

        def spans(starts, sizes):
            ends = np.cumsum(sizes)
            return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)

        def tiles(rows, n):
            full = len(rows) // tile * tile
            for part, width in ((slice(full), tile), (slice(full, None), len(rows) - full)):
                if len(rows[part]):
                    yield rows[part].reshape(-1, width), n[part].reshape(-1, width)

        (cx, sx), (cy, sy) = classes(vx), classes(vy)
        lx, ly = (np.array([len(tokens) for tokens in side]) for side in (sx, sy))
        px, py = places(sx), places(sy)
        common = np.zeros((len(sx), len(sy)), np.int32)
        for word in px.keys() & py.keys():
            common[np.ix_(px[word], py[word])] += 1
        order_x, order_y = np.lexsort((rx, cx)), np.lexsort((ry, cy))
        (nx, ny), (rx, ry) = (np.bincount(cx, minlength=len(sx)), np.bincount(cy, minlength=len(sy))), (rx[order_x], ry[order_y])
        from_x, from_y = np.cumsum(nx) - nx, np.cumsum(ny) - ny
        held, size = [], 0

        def out():
            a, b, c = (np.concatenate(cs) for cs in zip(*held, strict=True))
            yield [names.take(pa.array(a)), names.take(pa.array(b)), pa.array(c)]

        for p in range(len(sx)):
            q = np.flatnonzero(common[p] >= least)
            said = common[p, q]
            if share is not None:
                said = said / (lx[p] + ly[q] - said)
                q, said = q[said >= share], said[said >= share]
            if not len(q):
                continue
            # the rows of class p with a tile of the other side's rows, then with the next ones; both by id, so that most are on one side of a whole tile
            own_rows = rx[from_x[p] : from_x[p] + nx[p]]
            others, n = ry[spans(from_y[q], ny[q])], np.repeat(said, ny[q])
            by_id = np.argsort(others)
            others, n = others[by_id], n[by_id]
            step = max(tile, most // len(own_rows) // tile * tile)
            for low in range(0, len(others), step):
                for r, c in tiles(others[low : low + step], n[low : low + step]):
                    shape = (len(r), len(own_rows), r.shape[1])
                    r, c = np.broadcast_to(r[:, None, :], shape), np.broadcast_to(c[:, None, :], shape)
                    i = np.broadcast_to(own_rows[None, :, None], shape)
                    before = i < r
                    held.append((i[before], r[before], c[before]))
                    if not own:
                        held.append((r[~before], i[~before], c[~before]))
                    size += i.size
                if size >= most:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    kind = dict(units.dtypes)["unit_id"]
    return _products(v, v, block, emit, f"a {kind}, b {kind}, " + ("common int" if share is None else "score double"), half=True, limit=TOKEN_CHUNK)


def _unit(vectors: DataFrame, key: str, block: list[str]) -> DataFrame:
    return vectors.select(F.col(key).alias("id"), *block, t.normalised(F.col("vector")).alias("v"))


def similar_pairs(vectors: DataFrame, least: float, block: list[str]) -> DataFrame:
    """a, b, score: pairs within a block (scope, tier, label) whose cosine reaches a bound."""

    def emit(x, vx, y, vy):
        import numpy as np

        scores = np.array(vx) @ np.array(vy).T
        i, j = np.nonzero(scores >= least)
        # a part with itself has each pair twice, two parts have it once, in either order
        own = sorted(x) == sorted(y)
        keep = [k for k, (p, q) in enumerate(zip(i.tolist(), j.tolist(), strict=True)) if (x[p] < y[q] if own else x[p] != y[q])]
        i, j = i[keep], j[keep]
        a, b = [x[k] for k in i], [y[k] for k in j]
        yield [min(p) for p in zip(a, b, strict=True)], [max(p) for p in zip(a, b, strict=True)], scores[i, j]

    v, kind = _unit(vectors, "unit_id", block), dict(vectors.dtypes)["unit_id"]
    return _products(v, v, block, emit, f"a {kind}, b {kind}, score double", half=True)


def duplicates_of(candidates: DataFrame, vectors: DataFrame, block: list[str], k: int, least: float) -> DataFrame:
    """The k nearest existing units of each candidate in its block, itself left out, at or over a bound. A task passes on k for each of its candidates."""

    def emit(x, vx, y, vy):
        import numpy as np

        scores = (np.array(vx) @ np.array(vy).T).round(9)
        names = np.array(y)
        out = ([], [], [])
        for p, row in enumerate(scores):
            ok = (row >= least) & (names != x[p])
            best = np.flatnonzero(ok)[np.lexsort((names[ok], -row[ok]))[:k]]
            out[0].extend([x[p]] * len(best))
            out[1].extend(names[best].tolist())
            out[2].extend(row[best].tolist())
        yield out

    kinds = dict(candidates.dtypes)["query_id"], dict(vectors.dtypes)["unit_id"]
    s = _products(_unit(candidates, "query_id", block), _unit(vectors, "unit_id", block), block, emit, f"query_id {kinds[0]}, unit_id {kinds[1]}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")
    return s.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def merge_candidates(existing: DataFrame, new: DataFrame, block: list[str], k: int) -> DataFrame:
    """The k existing entries of each block that are nearest to any new one."""

    def emit(x, vx, y, vy):
        import numpy as np

        scores = np.array(vx) @ np.array(vy).T
        scores[np.array(x)[:, None] == np.array(y)[None, :]] = -np.inf
        best = scores.max(1)
        some = np.flatnonzero(np.isfinite(best))
        yield [x[p] for p in some], best[some]

    kind = dict(existing.dtypes)["unit_id"]
    near = _products(_unit(existing, "unit_id", block), _unit(new, "query_id", block), block, emit, f"unit_id {kind}, score double")
    s = near.groupBy("unit_id").agg(F.max("score").alias("score")).join(existing.select("unit_id", *block), "unit_id")
    return top_by(s, block, [F.desc(F.round("score", 9)), F.asc("unit_id")], k)


def linked(links: DataFrame, mentions: DataFrame) -> DataFrame:
    """The reverse index with new mentions; known entities gain units, new ones are added."""
    return links.unionByName(mentions).distinct()


def unlinked(links: DataFrame, deleted: DataFrame) -> DataFrame:
    """Without the links of deleted units; entities without links are gone with them."""
    return links.join(deleted.select("unit_id").distinct(), "unit_id", "left_anti")


def source_fallback(hits: DataFrame, properties: DataFrame, policy: str) -> DataFrame:
    """Source hits that stay beside properties: none, those without a property, without a complete one, or always all. properties: provenance, complete."""
    if policy == "none":
        return hits.limit(0)
    if policy == "always":
        return hits
    if policy not in ("missing", "missing_or_incomplete"):
        raise ValueError(policy)
    covering = properties if policy == "missing" else properties.where("complete")
    return hits.join(covering.select(F.explode("provenance").alias("unit_id")).distinct(), "unit_id", "left_anti")


def fuzzy_names(names: DataFrame, block: list[str], most: int) -> DataFrame:
    """a, b: for each entity the earliest one of its block whose name is within some edits.

    A name cut into one piece more than there may be edits keeps one piece
    whole, at most so many places away. Distinct names meet at pieces of the
    longer than ``most`` ones, and only those that do are compared; names no
    longer than that are all within the edits of each other, so the earliest of
    them stands for all.
    """
    n = names.select("id", *block, t.entity_key(F.col("name")).alias("k"))
    keys = written(n.groupBy(*block, "k").agg(F.min("id").alias("id")), "fuzzy-keys")
    count = most + 1
    at = lambda size, i: F.floor(size * i / count).cast("int")
    own = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.struct(F.length("k").alias("n"), i.alias("i"), F.substring("k", at(F.length("k"), i) + 1, at(F.length("k"), i + 1) - at(F.length("k"), i)).alias("piece")))

    def places(size, i):
        start, width = at(size, i), at(size, i + 1) - at(size, i)
        low, high = F.greatest(F.lit(0), start - most), F.least(F.length("k") - width, start + most)
        found = F.transform(F.sequence(low, F.greatest(low, high)), lambda p: F.struct(size.alias("n"), i.alias("i"), F.substring("k", p + 1, width).alias("piece")))
        return F.when(high >= low, found).otherwise(F.slice(found, 1, 0))

    sizes = F.sequence(F.greatest(F.lit(count), F.length("k") - most), F.length("k") + most)
    met = F.when(F.length("k") + most >= count, F.array_distinct(F.flatten(F.transform(sizes, lambda size: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: places(size, i)))))))
    x = keys.select(*block, F.col("k").alias("ka"), F.col("id").alias("ia"), F.explode(met).alias("m"))
    y = keys.where(F.length("k") > most).select(*block, F.col("k").alias("kb"), F.col("id").alias("ib"), F.explode(own).alias("m"))
    near = x.join(y, [*block, "m"]).where(F.levenshtein("ka", "kb") <= most).select(*block, "ka", "ia", "kb", "ib")
    short = keys.where(F.length("k") <= most)
    least = short.join(short.groupBy(*block).agg(F.min("id").alias("b")), block).select(*block, "k", "b") if block else short.crossJoin(F.broadcast(short.agg(F.min("id").alias("b")))).select("k", "b")
    either = near.select(*block, F.col("ka").alias("k"), F.col("ib").alias("b")).unionByName(near.select(*block, F.col("kb").alias("k"), F.col("ia").alias("b"))).unionByName(least)
    best = either.groupBy(*block, "k").agg(F.min("b").alias("b"))
    return n.join(best, [*block, "k"]).where(F.col("id") > F.col("b")).select(F.col("id").alias("a"), "b")


def role_step(frontier: DataFrame, edges: DataFrame, rules: DataFrame, depth: int) -> DataFrame:
    """One hop of a role view: (root, node, duties, hops) along confirmed edges whose type is allowed for duties that are still valid; a state that another dominates (no fewer duties in no more hops) goes."""
    r = rules.groupBy("edge_type").agg(F.collect_set("duty").alias("allowed"))
    j = frontier.where(F.col("hops") < depth).join(edges.where("confirmed").select(F.col("src").alias("node"), "dst", "edge_type"), "node").join(r, "edge_type")
    s = j.select("root", F.col("dst").alias("node"), F.array_sort(F.array_intersect("duties", "allowed")).alias("duties"), (F.col("hops") + 1).alias("hops")).where(F.size("duties") > 0).distinct()
    o = s.select("root", "node", F.col("duties").alias("d2"), F.col("hops").alias("h2"))
    better = (F.size(F.array_except("duties", "d2")) == 0) & (F.col("h2") <= F.col("hops")) & ((F.size("d2") > F.size("duties")) | (F.col("h2") < F.col("hops")))
    worse = s.join(o, ["root", "node"]).where(better).select("root", "node", "duties", "hops").distinct()
    return s.join(worse, ["root", "node", "duties", "hops"], "left_anti")


def hydrated(properties: DataFrame, units: DataFrame) -> DataFrame:
    """property_id with each source unit that is still there, in the order of its provenance. properties: property_id, provenance."""
    p = properties.select("property_id", F.posexplode("provenance").alias("pos", "unit_id"))
    return p.join(units, "unit_id")


def property_index(properties: DataFrame, entities: DataFrame) -> DataFrame:
    """The property units of the entities asked for. properties: entity, property_id; each name is folded to its key."""
    key = lambda d: d.withColumn("entity", t.entity_key(F.col("entity")))
    return key(properties).join(key(entities).select("entity").distinct(), "entity").select("entity", "property_id").distinct()


def supported(relations: DataFrame, supports: DataFrame, on: list[str]) -> DataFrame:
    """Relations with the number of confirmed supports that hold under the same conditions."""
    n = supports.where("confirmed").groupBy(*on).agg(F.count("*").alias("supports"))
    return relations.join(n, on, "left").withColumn("supports", F.coalesce("supports", F.lit(0).cast("long")))


def duty_budget(steps: DataFrame, rules: DataFrame) -> DataFrame:
    """Steps (root, edge_type, direction, hops) that some duty's rule allows, with the least depth any of those duties leaves. rules: duty, edge_type, direction, max_depth."""
    r = rules.groupBy("edge_type", "direction").agg(F.min("max_depth").alias("budget"))
    return steps.join(r, ["edge_type", "direction"]).where("hops <= budget")


def permitted(requests: DataFrame, members: DataFrame, facts: DataFrame) -> DataFrame:
    """Requests (request_id, user_id, resource, action) that a fact grants to the user or one of the user's groups."""
    direct = requests.select("request_id", "user_id", F.col("user_id").alias("subject"), "resource", "action")
    by_group = requests.join(members, "user_id").select("request_id", "user_id", F.col("group_id").alias("subject"), "resource", "action")
    hit = direct.unionByName(by_group).join(facts.where("revoked_at IS NULL"), ["subject", "resource", "action"], "left_semi")
    return requests.join(hit.select("request_id").distinct(), "request_id", "left_semi")


def combined_paths(a: DataFrame, b: DataFrame, key: str = "unit_id") -> DataFrame:
    """Scores of two recall paths added; a hit of one path alone keeps its score."""
    j = a.withColumnRenamed("score", "_a").join(b.withColumnRenamed("score", "_b"), key, "full")
    return j.select(key, (F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))).alias("score"))


def hierarchy_candidates(home: DataFrame, tree: DataFrame) -> DataFrame:
    """Units without a parent that may get one: no tree claims them as a child either. home: unit_id, parent_id; tree: unit_id, child_ids."""
    claimed = tree.select(F.explode("child_ids").alias("unit_id")).distinct()
    return home.where("parent_id IS NULL").join(claimed, "unit_id", "left_anti")


def role_view(seeds: DataFrame, edges: DataFrame, rules: DataFrame, depth: int) -> DataFrame:
    """root, node, duties, hops: all states that the seeds (root, node, duties) lead to. A state goes when one reached before has all of its duties.

    Each hop is written to the shared folder, so a lost executor costs one hop.
    """
    front = written(seeds.select("root", "node", F.array_sort("duties").alias("duties"), F.lit(0).alias("hops")).distinct(), "role")
    seen = front
    for _ in range(depth):
        new = role_step(front, edges, rules, depth)
        known = seen.select("root", "node", F.col("duties").alias("had")).distinct()
        old = new.join(known, ["root", "node"]).where(F.size(F.array_except("duties", "had")) == 0).select(*new.columns).distinct()
        front = written(new.join(old, new.columns, "left_anti"), "role")
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen
