"""Text and vector functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[0-9a-z]+|[\x{4e00}-\x{9fff}]"
#: Words that carry no meaning in a query; negations and question words are kept.
STOP = ("的", "了", "在", "是", "这", "也", "和", "就", "都", "而", "及", "与", "着", "或")
SENTENCE_END = "[。！？.!?\n]"
DIM = 64


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def rounded(x: Column, digits: int) -> Column:
    """Doubles rounded half away from zero by double arithmetic, as DuckDB has it; F.round makes a decimal of each."""
    by = 10.0**digits
    scaled, whole = x * by, F.rint(x * by)
    half = F.when((scaled > 0) & (scaled - whole >= 0.5), 1.0).when((scaled < 0) & (scaled - whole <= -0.5), -1.0).otherwise(0.0)
    return F.when(F.abs(scaled) < float("inf"), (whole + half) / by).otherwise(x)


def tokens(text: Column) -> Column:
    """Lower-case runs of Latin letters and digits, and single CJK characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def occurrences(low: Column, words: list[str]) -> Column:
    """How many tokens of a lower-case text are among the words. A Latin token is a whole run, so one pattern counts them without building the list of tokens."""
    latin = [w for w in words if re.fullmatch("[0-9a-z]+", w)]
    single = [w for w in words if re.fullmatch("[\u4e00-\u9fff]", w)]
    parts = ([f"(?<![0-9a-z])(?:{'|'.join(latin)})(?![0-9a-z])"] if latin else []) + single
    return F.regexp_count(low, F.lit("|".join(parts))) if parts else F.lit(0)


def found(low: Column, words: list[str]) -> Column:
    """The tokens of a lower-case text that are among the words, in order, without building the list of all tokens."""
    latin = [w for w in words if re.fullmatch("[0-9a-z]+", w)]
    single = [w for w in words if re.fullmatch("[\u4e00-\u9fff]", w)]
    parts = ([f"(?<![0-9a-z])(?:{'|'.join(latin)})(?![0-9a-z])"] if latin else []) + single
    return F.regexp_extract_all(low, F.lit("|".join(parts)), F.lit(0)) if parts else F.array().cast("array<string>")


def terms(text: Column) -> Column:
    """Distinct tokens that are no stop words, in order."""
    return F.array_distinct(F.array_except(tokens(text), F.array(*map(F.lit, STOP))))


def entities(text: Column) -> Column:
    """Distinct ASCII tokens of three letters and more."""
    return F.filter(F.array_distinct(tokens(text)), lambda t: (F.length(t) >= 3) & t.rlike(r"^[\x00-\x7f]+$"))


def fts_terms(text: Column) -> Column:
    """Quoted phrases for a full-text query; parts of punctuation alone are dropped."""
    parts = F.filter(F.split(text, r"\s+"), lambda t: t.rlike(r"[A-Za-z0-9\x{4e00}-\x{9fff}]"))
    return F.transform(parts, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"')))


def overlap(tokens_: Column, query: list[str]) -> Column:
    """The share of a text's tokens that are in the query; 0 without tokens."""
    q = F.array(*map(F.lit, sorted(set(query)))) if query else F.array().cast("array<string>")
    hits = F.size(F.filter(tokens_, lambda t: F.array_contains(q, t)))
    return F.when(F.size(tokens_) == 0, 0.0).otherwise(hits / F.size(tokens_))


def rerank_overlap(tokens_: Column, query: list[str]) -> Column:
    q = F.array(*map(F.lit, query)) if query else F.array().cast("array<string>")
    return F.size(F.filter(q, lambda t: F.array_contains(tokens_, t))) / (F.size(tokens_) + 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths or a vector of zeros."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), 0.0).when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def l2_score(a: Column, b: Column) -> Column:
    return -F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def normalised(v: Column) -> Column:
    """Unit length; a vector with NaN, infinity or no length becomes zeros."""
    d = F.transform(v, lambda x: x.cast("double"))
    bad = F.exists(d, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return let(F.sqrt(dot(v, v)), lambda n: F.when(bad | (n == 0), F.transform(d, lambda _: F.lit(0.0))).otherwise(F.transform(d, lambda x: x / n)))


def bucket(token: Column, dim: int = DIM) -> Column:
    """A token's place in the hashing embedder: h = (31 h + code point) mod 2^32, mod dim."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(4_294_967_295))) % dim


def embedded(text: Column, dim: int = DIM) -> Column:
    """Counts of token buckets, of unit length."""
    places = F.transform(tokens(text), lambda t: bucket(t, dim))
    counts = let(places, lambda p: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(p, lambda x: x == i)).cast("double")))
    return let(counts, normalised)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap_coefficient(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def token_estimate(text: Column) -> Column:
    n = F.length(text)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor((n + 3) / 4).cast("int")))


def importance(value: Column) -> Column:
    """A number clamped to [0, 1]; 0.5 for anything else."""
    x = value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def recency(age_days: Column, tau: float = 30.0) -> Column:
    """1 for now and the future, falling softly with age; 0 for an unknown time."""
    return F.when(age_days.isNull(), 0.0).otherwise(1 / (1 + F.greatest(F.lit(0.0), age_days) / tau))


def secondary(importance_: Column, age_days: Column, w_i: float = 0.5, w_r: float = 0.5, tau: float = 30.0) -> Column:
    return w_i * importance_ + w_r * recency(age_days, tau)


def entity_key(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def entity_hash(name: Column) -> Column:
    return F.sha2(entity_key(name), 256)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def first_sentence(text: Column, most: int = 80) -> Column:
    """Up to and with the first sentence end; without one the first characters."""
    at = F.regexp_instr(text, F.lit(SENTENCE_END))
    return F.when(at > 0, F.substring(text, F.lit(1), at)).otherwise(F.substring(text, 1, most))


def layer_l1(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def layer_l0(text: Column, tags: Column, short: int = 80) -> Column:
    """A short text itself, else its first three tags and first sentence."""
    return F.when(F.length(text) <= short, text).otherwise(F.concat_ws(" ", F.concat_ws(" ", F.slice(tags, 1, 3)), first_sentence(text)))


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, n)), F.lit("…")))


def window_around(text: Column, word: str, n: int, lead: int = 30) -> Column:
    """n characters from a little before the first place of a word; from the start without it."""
    at = F.instr(F.lower(text), word.lower())
    return F.substring(text, F.greatest(F.lit(1), at - lead), F.lit(n))


def best_snippet(text: Column, words: list[str], n: int) -> Column:
    """The window of n characters, beginning at a word's first place, with most distinct words; the earliest of the best."""
    low = F.lower(text)
    starts = F.filter(F.array(*(F.instr(low, w) for w in words)), lambda i: i > 0)
    scored = F.transform(starts, lambda i: F.struct((-sum((F.instr(F.substring(low, i, F.lit(n)), w) > 0).cast("int") for w in words)).alias("m"), i.alias("i")))
    return F.when(F.size(starts) == 0, F.substring(text, 1, n)).otherwise(F.substring(text, F.array_min(scored)["i"], F.lit(n)))


def folded(text: Column, n: int) -> Column:
    """The first n lines with something in them, trimmed, on one line."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.slice(lines, 1, n), " / ")


def chunks(text: Column, size: int = 120) -> Column:
    """Array of (start, text) windows; an empty text has one empty chunk."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text), F.lit(1)) - 1, F.lit(size))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("text")))


def first_date(text: Column) -> Column:
    """The first valid year-month-day date of a text."""
    found = F.regexp_extract_all(text, F.lit(r"(?:19|20)[0-9]{2}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}"), F.lit(0))
    dates = F.transform(found, lambda d: F.try_make_timestamp(*(F.regexp_extract(d, r"([0-9]{4})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})", k).cast("int") for k in (1, 2, 3)), F.lit(0), F.lit(0), F.lit(0)))
    return F.get(F.filter(dates, lambda x: x.isNotNull()), F.lit(0))


def partial_date(text: Column) -> Column:
    """struct(at, precision) of YYYY, YYYY-MM, YYYY-MM-DD or a full time; null if it is none."""
    full = F.try_to_timestamp(text)
    return (
        F.when(text.rlike("^[0-9]{4}$"), F.struct(F.try_to_timestamp(text, F.lit("yyyy")).alias("at"), F.lit("year").alias("precision")))
        .when(text.rlike("^[0-9]{4}-[0-9]{2}$"), F.struct(F.try_to_timestamp(text, F.lit("yyyy-MM")).alias("at"), F.lit("month").alias("precision")))
        .when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.struct(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).alias("at"), F.lit("day").alias("precision")))
        .when(full.isNotNull(), F.struct(full.alias("at"), F.lit("datetime").alias("precision")))
    )


def exclusive_end(at: Column, precision: Column) -> Column:
    months = lambda n: F.add_months(at, n).cast("timestamp")
    return F.when(precision == "year", months(12)).when(precision == "month", months(1)).when(precision == "day", at + F.expr("interval 1 day")).otherwise(at + F.expr("interval 1 microsecond"))


def sanitised(text: Column) -> Column:
    """Without bracketed UTC stamps, sender lines and control characters; white space runs become one space. Code fences stay."""
    clean = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\[[^\]]*UTC[^\]]*\]", ""), r"(?m)^Sender:[^\n]*\n?", ""), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"\s+", " ")
    parts = F.split(text, "```")
    return F.trim(F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, clean(p)).otherwise(p)), "```"))


def masked(text: Column) -> Column:
    """Mail addresses, phone numbers and long digit groups behind their kind."""
    out = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    out = F.regexp_replace(out, r"\+[0-9][0-9 ().-]{7,}[0-9]", "[phone]")
    return F.regexp_replace(out, r"[0-9]{12,19}", "[number]")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10 == 0


def classified(text: Column, rules: list[tuple[tuple[str, ...], str]], default: str) -> Column:
    """The first rule any of whose words the text contains."""
    low, out = F.lower(text), None
    for words, label in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def model_json(text: Column) -> Column:
    """The first JSON object of a model's answer, inside or outside a fence; null if there is none."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))


def answer_key(text: Column) -> Column:
    """An answer for comparison: lower case, no articles and punctuation, single spaces."""
    out = F.regexp_replace(F.lower(text), r"\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[!-/:-@\[-`{-~]", ""), r"\s+", " "))


def resource_id(*parts: Column) -> Column:
    return F.concat_ws("/", *(F.regexp_replace(F.lower(F.trim(p)), r"[^a-z0-9_.-]+", "-") for p in parts))


def rendered(template: str, values: dict[str, Column]) -> Column:
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v, F.lit("")))
    return out


def negation_differs(a: Column, b: Column, pattern: str = r"\b(?:not|no|never|none)\b") -> Column:
    return F.lower(a).rlike(pattern) != F.lower(b).rlike(pattern)


def seconds(clock: Column) -> Column:
    """HH:MM:SS or MM:SS as seconds."""
    parts = F.split(clock, ":")
    return F.aggregate(F.transform(parts, lambda p: p.cast("long")), F.lit(0).cast("long"), lambda s, p: s * 60 + p)


#: How much each category of memory matters by default.
IMPORTANCE = {"identity": 0.95, "rule": 0.90, "preference": 0.85, "knowledge": 0.80, "relation": 0.75, "default": 0.50, "transient": 0.30}
#: Fields that hold ids of units, the only values that a log may show.
UNIT_ID_FIELDS = (
    "candidate_id", "candidate_ids", "child_clm_source_ids", "created_id", "created_ids", "dedup_merged_from", "dedup_superseded",
    "existing_unit_id", "existing_unit_ids", "forgotten_id", "forgotten_ids", "memory_unit_id", "memory_unit_ids", "new_id", "new_ids", "old_id",
    "old_ids", "provenance", "source_id", "source_ids", "source_unit_id", "source_unit_ids", "superseded_id", "superseded_ids", "target_id",
    "target_ids", "target_unit_id", "target_unit_ids", "unit_id", "unit_ids", "updated_id", "updated_ids",
)
#: Words that tell a unit's tier, category and topic.
SEMANTIC_WORDS = ("喜欢", "偏好", "讨厌", "习惯", "总是", "喜爱")
PROCEDURAL_WORDS = ("步骤", "流程", "先", "然后", "如何", "怎么", "方法")
RULE_WORDS = ("永远不要", "必须", "禁止", "一律")
TOPIC_WORDS = {"coffee": ("咖啡", "拿铁", "美式", "燕麦奶"), "meeting": ("评审", "会议", "团队"), "project": ("项目", "系统", "agent")}


def category_importance(category: Column, default: float = 0.5) -> Column:
    known = F.create_map(*(x for k, v in IMPORTANCE.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(category))), F.lit(default))


def redacted(details: Column, visible: list[str] | None = None) -> Column:
    """A map of details for a log: keys stay, values become *, but for ids of units that are named as visible and stand in a field for such ids."""
    leaf = lambda k: F.lower(F.trim(F.element_at(F.split(k, r"\."), -1)))
    return F.transform_values(details, lambda k, v: F.when(leaf(k).isin(*UNIT_ID_FIELDS) & v.isin(*(visible or [])), v).otherwise("*"))


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def keyword_tier(text: Column) -> Column:
    """semantic, procedural or episodic, by the words that a unit has."""
    return F.when(any_word(text, SEMANTIC_WORDS), "semantic").when(any_word(text, PROCEDURAL_WORDS), "procedural").otherwise("episodic")


def keyword_category(text: Column) -> Column:
    """rule, preference or default: the category that sets a unit's importance."""
    return F.when(any_word(text, RULE_WORDS), "rule").when(any_word(text, SEMANTIC_WORDS), "preference").otherwise("default")


def keyword_topic(text: Column) -> Column:
    """The first topic any of whose words the unit has; empty without one."""
    out = None
    for topic, words in TOPIC_WORDS.items():
        out = F.when(any_word(text, words), topic) if out is None else out.when(any_word(text, words), topic)
    return out.otherwise("")


def fingerprint(values: Column) -> Column:
    """SHA-256 of a map of strings as compact JSON with its keys in order; the order of insertion does not count."""
    entries = F.array_sort(F.map_entries(values))
    return F.sha2(F.to_json(F.map_from_entries(entries)), 256)


def guarded(text: Column, most: int, note: str = "…[cut]") -> Column:
    """A prompt of at most so many characters, with a note where it was cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - len(note)), F.lit(note)))


def sentences(text: Column) -> Column:
    """Trimmed sentences, each with its end mark; empty ones are left out."""
    parts = F.regexp_extract_all(text, F.lit(r"[^。！？.!?\n]+[。！？.!?]*"), F.lit(0))
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def with_context(parts: Column, before: int, most: int) -> Column:
    """struct(context, text) for each part: the last `most` characters of up to `before` parts ahead of it."""

    def one(p: Column, i: Column) -> Column:
        head = F.array_join(F.slice(parts, F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before))), " ")
        return F.struct(F.when(i == 0, "").otherwise(F.right(head, F.lit(most))).alias("context"), p.alias("text"))

    return F.transform(parts, one)


def humanised(at: Column, precision: Column) -> Column:
    """A date in words, as far as it is known."""
    year, month, day = F.date_format(at, "yyyy"), F.date_format(at, "MMMM yyyy"), F.date_format(at, "d MMMM yyyy")
    return F.when(precision == "year", year).when(precision == "month", month).when(precision == "day", day).otherwise(F.concat(day, F.date_format(at, " HH:mm")))


def scalar_metadata(values: Column) -> Column:
    """Whether all values of a JSON object are scalars; null for a text that is no object."""
    kinds = F.map_values(F.from_json(values, "map<string,string>"))
    return F.when(F.try_parse_json(values).isNull() | ~values.rlike(r"^\s*\{"), None).otherwise(~F.exists(kinds, lambda v: F.coalesce(v.rlike(r"^\s*[\[{]"), F.lit(False))))


#: Relative phrases with the days from the anchor's day to the window's first day, and its length.
RELATIVE_DAYS = (("the day before yesterday", -2, 1), ("yesterday", -1, 1), ("today", 0, 1), ("tomorrow", 1, 1), ("last week", -7, 7), ("前天", -2, 1), ("昨天", -1, 1), ("今天", 0, 1), ("明天", 1, 1))
RELATIVE_MONTHS = (("last month", -1, 1), ("this month", 0, 1), ("last year", -12, 12), ("上个月", -1, 1), ("这个月", 0, 1), ("去年", -12, 12))


def time_window(text: Column, anchor: Column) -> Column:
    """struct(start, end) that a question asks about, as half-open times; null if it names none.

    An absolute date comes before relative phrases, a longer phrase before one
    that it contains. Months and years are whole ones of the calendar.
    """
    low, day = F.lower(text), F.date_trunc("day", anchor)
    window = lambda a, b: F.struct(a.cast("timestamp").alias("start"), b.cast("timestamp").alias("end"))
    found = first_date(text)
    out = F.when(found.isNotNull(), window(found, found + F.expr("interval 1 day")))
    for phrase, first, n in RELATIVE_DAYS:
        start = F.date_add(day, first)
        out = out.when(low.contains(phrase), window(start, F.date_add(start, n)))
    for phrase, first, n in RELATIVE_MONTHS:
        start = F.add_months(F.trunc(anchor, "year" if n == 12 else "month"), first)
        out = out.when(low.contains(phrase), window(start, F.add_months(start, n)))
    return out


#: Phrases of questions with their unit of the calendar, how many of it the window begins from the anchor's own, and how many it has; without a number it lasts until the anchor.
ASKED = (
    (("前天",), "day", -2, 1),
    (("昨天", "昨日"), "day", -1, 1),
    (("今天", "今日"), "day", 0, 1),
    (("上周", "上星期"), "week", -1, 1),
    (("本周", "这周", "这星期"), "week", 0, None),
    (("上个月", "上月"), "month", -1, 1),
    (("本月", "这个月"), "month", 0, None),
    (("去年",), "year", -1, 1),
    (("今年",), "year", 0, None),
)
#: Spans until now, months of a named year, and questions about what something is, which ask for no time.
RECENT = r"(最近|过去|近)\s*([0-9]+)\s*(天|日|周|星期)"
YEAR_MONTH = r"(去年|今年|明年)\s*([0-9]{1,2})\s*月"
ATTRIBUTE = "多大|几岁|多少岁|爱好|是谁|叫什么|名字|住址|住哪|住在哪|地址|生日|年龄|岁数"


def moved(start: Column, unit: str, n: int) -> Column:
    """The beginning of a calendar unit n units on."""
    days = {"day": 1, "week": 7}
    out = F.date_add(start, n * days[unit]) if unit in days else F.add_months(start, n * (12 if unit == "year" else 1))
    return out.cast("timestamp")


def question_window(text: Column, anchor: Column) -> Column:
    """struct(start, end) that a question asks about, half-open; null if it asks for no time or for what something is.

    A span until now comes first, then named days, weeks, months, a month of a
    named year, years, and a date at last, with the anchor's year if it has
    none; then the English phrases of time_window(). A span that would begin
    before the calendar does, and a month that there is not, count for nothing.
    """
    window = lambda a, b: F.struct(a.cast("timestamp").alias("start"), b.cast("timestamp").alias("end"))
    now = anchor.cast("timestamp")
    digits = F.regexp_extract(text, RECENT, 2)
    days = F.when((digits != "") & (F.length(F.ltrim(digits, F.lit("0"))) <= 7), digits.cast("decimal(38,0)").cast("long") * F.when(F.regexp_extract(text, RECENT, 3).isin("周", "星期"), 7).otherwise(1))
    begin = F.unix_micros(now) - days * 86_400_000_000
    out = F.when(text.rlike(ATTRIBUTE), None).when(begin >= -62_135_596_800_000_000, window(F.timestamp_micros(begin), now))
    year, month = F.regexp_extract(text, YEAR_MONTH, 1), F.try_to_number(F.regexp_extract(text, YEAR_MONTH, 2), F.lit("99")).cast("int")
    first = F.add_months(F.trunc(now, "year"), F.when(year == "去年", -12).when(year == "明年", 12).otherwise(0) + month - 1)
    for phrases, unit, offset, length in ASKED:
        if unit == "year" and offset == -1:
            out = out.when(month.between(1, 12), window(first, F.add_months(first, 1)))
        own = F.date_trunc(unit, now)
        start = moved(own, unit, offset)
        said = any_word(text, phrases)
        out = out.when(said, window(start, moved(start, unit, length) if length else now))
    short = [F.regexp_extract(text, "([0-9]{1,2})月([0-9]{1,2})[日号]", k).try_cast("int") for k in (1, 2)]
    day = F.coalesce(first_date(text), F.try_make_timestamp(F.year(now), short[0], short[1], F.lit(0), F.lit(0), F.lit(0)))
    out = out.when(day.isNotNull(), window(day, day + F.expr("interval 1 day")))
    return out.otherwise(time_window(text, anchor))


def widened(window: Column, least_seconds: int) -> Column:
    """A window made long enough, evenly on both sides."""
    a, b = F.unix_micros(window["start"]), F.unix_micros(window["end"])
    pad = F.greatest(F.lit(0).cast("long"), (F.lit(least_seconds * 1_000_000) - (b - a)) / 2).cast("long")
    return F.struct(F.timestamp_micros(a - pad).alias("start"), F.timestamp_micros(b + pad).alias("end"))


def overlapping_chunks(text: Column, size: int, overlap: int) -> Column:
    """Array of (start, text): windows of `size` that look back `overlap` characters; an empty text has one empty chunk."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap, F.lit(1)) - 1, F.lit(step))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("text")))


def merged_segments(parts: Column, least: float) -> Column:
    """Segments (start, end, text) in order; one shorter than the least joins the one before it, the first one the next."""
    empty = F.array().cast("array<struct<start:double,end:double,text:string>>")

    def add(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        short = ((p["end"] - p["start"]) < least) | ((last["end"] - last["start"]) < least)
        both = F.struct(last["start"].alias("start"), p["end"].alias("end"), F.concat_ws(" ", last["text"], p["text"]).alias("text"))
        own = F.struct(p["start"].cast("double").alias("start"), p["end"].cast("double").alias("end"), p["text"].alias("text"))
        return F.when(F.size(done) == 0, F.array(own)).when(short, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(own)))

    return F.aggregate(parts, empty, add)
