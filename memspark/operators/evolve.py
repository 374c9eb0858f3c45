"""Evolution of properties: conflict plans, merges of property names, parents in time, routes to spaces, relative times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import text as t
from memspark.operators import temporal

ACTIONS = ("create", "merge", "update", "archive")


def open_clusters(units: DataFrame, by: list[str], least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Members of clusters (rows of the same keys) that have something to settle, and exact repeats among them, which retire.

    A cluster whose members are all done is skipped; of equal contents the
    newest stays; a cluster of fewer than ``least`` contents needs no plan.
    units: by, unit_id, content, t_ingest, done.
    """
    open_ = units.groupBy(*by).agg(F.min(F.coalesce("done", F.lit(False)).cast("int")).alias("_done"), F.count("*").alias("_n")).where("_done = 0").where(F.col("_n") >= least)
    own = units.join(open_.select(*by), by, "left_semi")
    best = own.groupBy(*by, F.sha2("content", 256).alias("_h")).agg(F.max(F.struct("t_ingest", "unit_id")).alias("_b"))
    marked = own.withColumn("_h", F.sha2("content", 256)).join(best, [*by, "_h"]).withColumn("_keep", F.col("_b.unit_id") == F.col("unit_id")).drop("_h", "_b")
    kept, repeats = marked.where("_keep").drop("_keep"), marked.where("NOT _keep").drop("_keep")
    many = kept.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return kept.join(many.select(*by), by, "left_semi"), repeats


def consolidated(units: DataFrame, actions: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """The plan of a model's actions on open clusters: by, op (retire, addition, replacement), unit_id, content, sources.

    actions: by, seq (each number once in a cluster), type, unit_id, content, unit_ids. They count in their
    order: an action on a unit that an earlier one has retired is void, and so
    is one that names no member. A merge needs two sources; a create needs
    evidence. Exact repeats retire without any action. What is carried from
    action to action is one cluster's retired units.
    """
    members, repeats = open_clusters(units, by, least)
    named = actions.where(F.lower("type").isin(*ACTIONS)).withColumn("_ids", F.array_distinct(F.when(F.lower("type").isin("update", "archive"), F.array("unit_id")).otherwise(F.coalesce("unit_ids", F.array().cast("array<string>")))))
    each = named.select(*by, "seq", F.posexplode("_ids").alias("_pos", "unit_id"))
    known = each.join(members.select(*by, "unit_id"), [*by, "unit_id"], "left_semi").groupBy(*by, "seq").agg(F.array_sort(F.collect_list(F.struct("_pos", "unit_id"))).alias("_k"))
    rows = named.drop("_ids").join(known, [*by, "seq"]).select(*by, "seq", F.lower("type").alias("type"), F.trim(F.coalesce("content", F.lit(""))).alias("content"), F.transform("_k", lambda x: x["unit_id"]).alias("ids"))

    width = len(by)
    names = [*by, "op", "unit_id", "content", "sources"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for *key, actions in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                retired: set[str] = set()
                for a in actions:
                    kind, content, ids = a["type"], a["content"], a["ids"]
                    gone = ids if kind == "merge" else ids[:1] if kind in ("update", "archive") else []
                    if (kind != "archive" and not content) or (kind == "merge" and len(ids) < 2) or retired.intersection(gone):
                        continue
                    retired.update(gone)
                    out.extend((*key, "retire", unit, None, []) for unit in gone)
                    if kind in ("create", "merge"):
                        out.append((*key, "addition", None, content, ids))
                    elif kind == "update":
                        out.append((*key, "replacement", ids[0], content, ids))
            types = [*(batch.schema.field(k).type for k in range(width)), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    kinds = dict(units.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "op string, unit_id string, content string, sources array<string>"])
    # a row for each cluster, many in a batch: a call of Python for each would cost more than its work
    clusters = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", "type", "content", "ids"))).alias("_actions"))
    planned = clusters.mapInArrow(run, schema)
    gone = repeats.select(*by, F.lit("retire").alias("op"), "unit_id", F.lit(None).cast("string").alias("content"), F.array().cast("array<string>").alias("sources"))
    return gone.unionByName(planned)


def merge_plan(candidates: DataFrame, least: float) -> DataFrame:
    """property, into: each property name with the one that it is merged into. candidates: property, other, score.

    A property goes to its best candidate at or over the bound that comes before
    it by name, ties by name; chains are followed to their end.
    """
    good = candidates.where((F.col("score") >= least) & (F.col("other") < F.col("property")))
    best = good.groupBy("property").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("other"))).alias("b")).select(F.col("property").alias("unit_id"), F.col("b.other").alias("supersedes"))
    ends = best.select(F.col("supersedes").alias("unit_id")).distinct().join(best.select("unit_id"), "unit_id", "left_anti").withColumn("supersedes", F.lit(None).cast("string"))
    found = temporal.families(best.unionByName(ends))
    return found.where("unit_id <> family").select(F.col("unit_id").alias("property"), F.col("family").alias("into"))


def merged_properties(units: DataFrame, plan: DataFrame) -> DataFrame:
    """Units with their property's new name, and merged_from where it has changed."""
    j = units.join(plan, "property", "left")
    return j.withColumn("merged_from", F.when(F.col("into").isNotNull(), F.col("property"))).withColumn("property", F.coalesce("into", "property")).drop("into")


def composed(leaves: DataFrame, user: str, seconds: float, meta: str) -> DataFrame:
    """Parents of leaves in time: user, span_start, span_end, child_ids, n, and meta where all children agree on it. leaves: user, unit_id, session, at, end, meta."""
    spans = temporal.span_groups(leaves.select(user, "unit_id", "session", "at"), user, seconds)
    j = leaves.select(user, "unit_id", "at", "end", meta).join(spans.select("unit_id", F.col("start")), "unit_id")
    up = temporal.parents(j, [user, "start"])
    same = j.groupBy(user, "start").agg(F.when((F.countDistinct(meta) == 1) & (F.count(meta) == F.count("*")), F.min(meta)).alias(meta))
    return up.join(same, [user, "start"]).drop("start")


def checked_routes(classes: list[dict]) -> list[dict]:
    """A table of routes (name, owner, space_template, cross_user, members, sanitized, record_only, tag_key, fallback) that breaks no rule; ValueError otherwise."""
    templates: dict[str, str] = {}
    for c in classes:
        name, template = c["name"], c.get("space_template", "")
        if c.get("cross_user") and c.get("owner") == "user":
            raise ValueError(f"{name}: what a user owns is never seen by others")
        if c.get("cross_user") and not (c.get("members") or c.get("sanitized")):
            raise ValueError(f"{name}: needs members or has to be sanitized")
        if c.get("record_only"):
            if not (c.get("tag_key") or c.get("owner")):
                raise ValueError(f"{name}: a record needs a tag key or an owner")
            continue
        if not c.get("owner") or "{" + c["owner"] + "}" not in template:
            raise ValueError(f"{name}: the template has to name the owner")
        if template in templates.values():
            raise ValueError(f"{name}: another class has the same template")
        templates[name] = template
    fallbacks = [c for c in classes if c.get("fallback")]
    if len(fallbacks) != 1 or fallbacks[0].get("cross_user") or fallbacks[0].get("record_only"):
        raise ValueError("one fallback class, with a space of its own that no other user sees")
    return classes


def routed(units: DataFrame, classes: list[dict], coords: dict[str, Column], allowed: DataFrame) -> DataFrame:
    """unit_id, space, memory_class, record_tag, reason: where each unit (unit_id, memory_class, coordinates) goes.

    A class's template is filled from the coordinates; a class that is unknown,
    cannot be filled, or leads to a space that is not among the allowed ones
    falls back. A record class stays in the fallback space under its own name.
    """
    classes = checked_routes(classes)
    back = next(c for c in classes if c.get("fallback"))
    filled = lambda c: t.rendered(c["space_template"], {k: F.trim(v) for k, v in coords.items() if "{" + k + "}" in c["space_template"]})
    whole = lambda c: F.forall(F.array(*(F.trim(F.coalesce(v, F.lit(""))) for k, v in coords.items() if "{" + k + "}" in c["space_template"])), lambda x: x != "")
    space = tag = F.lit(None).cast("string")
    for c in classes:
        if not c.get("record_only"):
            space = F.when((F.col("memory_class") == c["name"]) & whole(c), filled(c)).otherwise(space)
        if c.get("owner") and c.get("record_only"):
            key = c.get("tag_key") or f"{c['owner']}_id"
            value = F.trim(F.coalesce(coords.get(c["owner"], F.lit("")), F.lit("")))
            tag = F.when((F.col("memory_class") == c["name"]) & (value != ""), F.concat(F.lit(f"{key}="), value)).otherwise(tag)
    known = F.coalesce(F.col("memory_class").isin(*(c["name"] for c in classes)), F.lit(False))
    record = F.coalesce(F.col("memory_class").isin(*(c["name"] for c in classes if c.get("record_only"))), F.lit(False))
    rows = units.withColumn("_space", space).withColumn("_tag", tag).withColumn("_back", filled(back))
    j = rows.join(allowed.select(F.col("space").alias("_space"), F.lit(True).alias("_ok")), "_space", "left")
    own = F.coalesce(F.col("_ok"), F.lit(False))
    return j.select(
        "unit_id",
        F.when(own, F.col("_space")).otherwise(F.col("_back")).alias("space"),
        F.when(own | record, F.col("memory_class")).otherwise(back["name"]).alias("memory_class"),
        F.col("_tag").alias("record_tag"),
        F.when(~known, "unknown class").when(~own & ~record, "space not allowed").otherwise("").alias("reason"),
    )


#: The words of relative times. Beside each what it means: the unit and how many of it to move (null: as the phrase says, back or on), how a day is picked there, how much of it is known, and what else a given time may be: its month, a day of that month which the text states, or a day of that week or weekend.
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_DAYS = "|".join(WEEKDAYS)
RELATIVE = (
    ("weekday of week", rf"\b(?:last|next) week(?:\s+on)?\s+(?:{_DAYS})\b|(?:上周|上个星期|下周|下个星期)[一二三四五六日天]", "week", None, "weekday", 10, "month"),
    ("weekday before", rf"\blast\s+(?:{_DAYS})\b", "day", 0, "before", 10, "month"),
    ("weekend before", r"\blast weekend\b|上周末|上个星期末", "week", -1, "saturday", 7, "weekend"),
    ("weekend after", r"\bnext weekend\b|下周末|下个星期末", "week", 1, "saturday", 7, "weekend"),
    ("day of month", r"(?:上个月|下个月)\s*[0-9]{1,2}[号日]", "month", None, "number", 10, "month"),
    ("this day", r"\bjust now\b|\btoday\b|刚刚|刚才|今天", "day", 0, "day", 10, ""),
    ("day before", r"\byesterday\b|昨天", "day", -1, "day", 10, ""),
    ("day after", r"\btomorrow\b|明天", "day", 1, "day", 10, ""),
    ("week before", r"\blast week\b|(?:上周|上个星期)(?![一二三四五六日天末])", "week", -1, "day", 7, "week"),
    ("week after", r"\bnext week\b|(?:下周|下个星期)(?![一二三四五六日天末])", "week", 1, "day", 7, "week"),
    ("month before", r"\blast month\b|上个月", "month", -1, "day", 7, "stated"),
    ("month after", r"\bnext month\b|下个月", "month", 1, "day", 7, "stated"),
    ("year before", r"\blast year\b|去年", "year", -1, "day", 4, ""),
    ("year after", r"\bnext year\b|明年", "year", 1, "day", 4, ""),
)
#: A date or time of its own in a property's value.
TIME_TOKEN = r"(?<![0-9-])([0-9]{4}-[0-9]{2}-[0-9]{2}(?:[Tt ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:[Zz]|[+-][0-9]{2}:[0-9]{2})?)?|[0-9]{4}-[0-9]{2}|[0-9]{4})(?![0-9-])"


def relative_mentions(text: Column) -> Column:
    """Array of struct(kind, phrase): a text's relative times in their order, none within another; of two at one place the more particular kind, which stands before the other in RELATIVE."""
    every = "|".join(f"(?i:{pattern})" for _, pattern, *_ in RELATIVE)
    kind = lambda x: F.coalesce(*(F.when(x.rlike(f"^(?i:{pattern})$"), F.lit(name)) for name, pattern, *_ in RELATIVE))
    return F.transform(F.regexp_extract_all(text, F.lit(every), F.lit(0)), lambda x: F.struct(kind(x).alias("kind"), x.alias("phrase")))


def relative_mention(text: Column) -> Column:
    """struct(kind, phrase) of a text's first relative time; null without one."""
    return F.get(relative_mentions(text), F.lit(0))


def _meaning(kind: Column) -> Column:
    """What a kind of relative time means, as a row of RELATIVE."""
    rows = [(F.lit(name), F.struct(F.lit(unit).alias("unit"), F.lit(steps).cast("int").alias("steps"), F.lit(pick).alias("pick"), F.lit(shown).alias("shown"), F.lit(also).alias("also"))) for name, _, unit, steps, pick, shown, also in RELATIVE]
    return F.try_element_at(F.create_map(*(x for row in rows for x in row)), kind)


def _meant(mention: Column, said: Column) -> tuple[Column, Column, Column]:
    """The meaning of a mention, the place that it moves to from the day on which it was said, and the day that it picks there (null if there is none)."""
    phrase, day, own = mention["phrase"], said.cast("date"), _meaning(mention["kind"])
    on = F.when(F.lower(phrase).rlike("^(?:last|上)"), -1).otherwise(1)
    n = F.coalesce(own["steps"], on)
    place = F.when(own["unit"] == "day", F.date_add(day, n)).when(own["unit"] == "week", F.date_add(day, 7 * n)).when(own["unit"] == "month", F.add_months(F.trunc(day, "month"), n)).otherwise(F.add_months(day, 12 * n))
    # the weekday that the phrase ends with, from 0
    word, last = F.lower(F.regexp_substr(phrase, F.lit("[A-Za-z]+$"))), F.right(phrase, F.lit(1))
    wanted = (F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, WEEKDAYS)), word), F.lit(0)), F.nullif(F.position(last, F.lit("一二三四五六日")), F.lit(0)), F.lit(7)) - 1).cast("int")
    monday = F.date_sub(place, F.weekday(place))
    number = F.regexp_extract(phrase, "([0-9]{1,2})[号日]$", 1).try_cast("int")
    picked = (
        F.when(own["pick"] == "weekday", F.date_add(monday, wanted))
        .when(own["pick"] == "before", F.date_sub(day, 1 + F.pmod(F.weekday(day) - 1 - wanted, F.lit(7))))
        .when(own["pick"] == "saturday", F.date_add(monday, 5))
        .when(own["pick"] == "number", F.when(number.between(1, F.dayofmonth(F.last_day(place))), F.date_add(place, number - 1)))
        .otherwise(place)
    )
    return own, monday, picked


def relative_anchor(mention: Column, said: Column) -> Column:
    """The date that a relative time means, seen from the day on which it was said, as far as it is known: a day, a month or a year; null for a day that is not there."""
    own, _, picked = _meant(mention, said)
    return F.left(F.date_format(picked, "yyyy-MM-dd"), own["shown"])


def relative_fit(given: Column, mention: Column, said: Column, text: Column) -> Column:
    """Whether a property's given time can be what a mention in its text means.

    It can be the anchor itself; beside that, by the mention's kind: the month
    of a known day; a day of a known month, if the text states it; a day of a
    week that the text states, or of a weekend, one that the text states if it
    states any; a month of a day which the text states there, or a weekend's.
    """
    own, monday, picked = _meant(mention, said)
    anchor, own_time = relative_anchor(mention, said), F.trim(given)
    stated = F.filter(F.regexp_extract_all(text, F.lit(TIME_TOKEN), F.lit(1)), lambda x: F.length(x) == 10)
    begin = F.when(own["also"] == "weekend", picked).otherwise(monday)
    within = lambda x: F.coalesce((x.try_cast("date") >= begin) & (x.try_cast("date") < F.date_add(monday, 7)), F.lit(False))
    there = F.filter(stated, within)
    n, some = F.length(own_time), F.size(there) > 0
    month = F.date_format(picked, "yyyy-MM")
    days = (
        F.when((n == 10) & (own["also"] == "week"), within(own_time) & F.array_contains(there, own_time))
        .when(n == 10, within(own_time) & (~some | F.array_contains(there, own_time)))
        .when((n == 7) & some, F.exists(there, lambda x: x.startswith(own_time)))
        .when((n == 7) & (own["also"] == "weekend"), (own_time == month) | (own_time == F.date_format(F.date_add(picked, 1), "yyyy-MM")))
        .otherwise(own_time == anchor)
    )
    other = F.when((own["also"] == "month") & (n == 7), anchor.startswith(own_time)).when((own["also"] == "stated") & (n == 10), own_time.startswith(anchor) & F.array_contains(stated, own_time)).otherwise(False)
    return F.coalesce(F.when(own["also"].isin("week", "weekend"), days).otherwise((own_time == anchor) | other), F.lit(False))


def relative_times_fit(given: Column, text: Column, said: Column) -> Column:
    """Whether a given time fits all relative times of its text; true for a text without any."""
    return F.forall(relative_mentions(text), lambda m: relative_fit(given, m, said, text))


def time_precision(value: Column) -> Column:
    n = F.length(value)
    return F.when(n == 4, "year").when(n == 7, "month").when(n == 10, "date").otherwise("datetime")


def property_time(given: Column, value: Column) -> Column:
    """struct(time, error): a property's time, which has to be one of the ISO times in its value; without a given one the only one there.

    given null: no time was given; an empty one says that the value has none.
    """
    there = F.array_distinct(F.regexp_extract_all(value, F.lit(TIME_TOKEN), F.lit(1)))
    own = F.trim(given)
    full = F.try_to_timestamp(F.regexp_replace(own, "[Tt]", " "))
    valid = own.rlike("^[0-9]{4}$") | (own.rlike("^[0-9]{4}-[0-9]{2}$") & F.try_to_timestamp(own, F.lit("yyyy-MM")).isNotNull()) | (own.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}") & full.isNotNull())
    fits = F.exists(there, lambda x: (time_precision(x) == time_precision(own)) & F.when(F.length(own) > 10, F.coalesce(F.try_to_timestamp(F.regexp_replace(x, "[Tt]", " ")) == full, F.lit(False))).otherwise(x == own))
    out = lambda time, error: F.struct(time.alias("time"), error.alias("error"))
    none, text = F.lit(None).cast("string"), lambda e: F.lit(e)
    return (
        F.when(given.isNull() & (F.size(there) == 1), out(there[0], none))
        .when(given.isNull() & (F.size(there) > 1), out(F.lit(""), text("several times")))
        .when(given.isNull(), out(F.lit(""), text("no time")))
        .when((own == "") & (F.size(there) > 0), out(F.lit(""), text("empty time")))
        .when(own == "", out(F.lit(""), none))
        .when(~F.coalesce(valid, F.lit(False)), out(F.lit(""), text("invalid time")))
        .when(F.size(there) == 0, out(F.lit(""), text("no time in value")))
        .when(~fits, out(F.lit(""), text("inconsistent time")))
        .otherwise(out(own, none))
    )


def dynamic(units: DataFrame, by: list[str], size: int = 120, each: int = 50, most: int = 8) -> DataFrame:
    """What evolution derives from units (unit_id, user_id, content): kind, unit_id, user_id, content, provenance.

    Three steps with deterministic hooks: extract makes a fact of each chunk;
    consolidate keeps the first of equal facts of a user by id and retires the
    others; reflect makes one abstract of each user's first facts.
    """
    from memspark.operators import plugins

    facts = plugins.extracted(units, size)
    first = facts.groupBy(*by, F.sha2("content", 256).alias("_h")).agg(F.min("unit_id").alias("_first"))
    told = facts.withColumn("_h", F.sha2("content", 256)).join(first, [*by, "_h"])
    kept = told.where("unit_id = _first").select(F.lit("fact").alias("kind"), "unit_id", "user_id", "content", "provenance")
    gone = told.where("unit_id <> _first").select(F.lit("retired").alias("kind"), "unit_id", "user_id", "content", "provenance")
    short = plugins.get("abstractor", "concat")(kept, by, "unit_id", "content", each, most)
    abstract = short.select(F.lit("abstract").alias("kind"), F.concat(F.lit("abstract:"), F.concat_ws("/", *by)).alias("unit_id"), F.col("user_id"), F.col("abstract").alias("content"), F.array().cast("array<string>").alias("provenance"))
    return kept.unionByName(gone).unionByName(abstract)
