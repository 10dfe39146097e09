"""Response filters: each maps an array of responses to an array; a pipeline chains them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Filter = Callable[[Column], Column]
REGISTRY: dict[str, Callable[..., Filter]] = {}


def register(name: str):
    def put(make: Callable[..., Filter]) -> Callable[..., Filter]:
        REGISTRY[name] = make
        return make

    return put


@register("take_first")
def take_first() -> Filter:
    return lambda r: F.try_element_at(r, F.lit(1))


@register("take_first_k")
def take_first_k(k: int) -> Filter:
    return lambda r: F.slice(r, 1, k)


@register("remove_whitespace")
def remove_whitespace() -> Filter:
    """Drops one leading space."""
    return lambda r: F.transform(r, lambda x: F.when(x.startswith(" "), F.substring(x, 2, 2147483647)).otherwise(x))


@register("lowercase")
def lowercase() -> Filter:
    return lambda r: F.transform(r, F.lower)


@register("uppercase")
def uppercase() -> Filter:
    return lambda r: F.transform(r, F.upper)


@register("map")
def mapped(mapping: dict[str, str], default: str | None = None) -> Filter:
    known = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return lambda r: F.transform(r, lambda x: F.coalesce(F.try_element_at(known, x), F.lit(default)))


@register("regex")
def regex(pattern: str, group_select: int = 0, fallback: str = "[invalid]", groups: int = 0) -> Filter:
    """Match number ``group_select`` (negative: from the end), of several groups the first that isn't empty, trimmed."""
    at = F.lit(group_select + 1 if group_select >= 0 else group_select)

    def one(x: Column) -> Column:
        found = [F.nullif(F.try_element_at(F.regexp_extract_all(x, F.lit(pattern), F.lit(g)), at), F.lit("")) for g in (range(1, groups + 1) if groups else [0])]
        return F.coalesce(F.trim(F.coalesce(*found)), F.lit(fallback))

    return lambda r: F.transform(r, one)


@register("majority_vote")
def majority_vote() -> Filter:
    """The most frequent response, of equally frequent ones the first, as an array of one."""

    def vote(r: Column) -> Column:
        times = F.transform(F.array_distinct(r), lambda x: F.struct((-F.size(F.filter(r, lambda y: y == x))).alias("n"), F.array_position(r, x).alias("first"), x.alias("value")))
        return F.when(F.size(r) > 0, F.array(F.array_min(times)["value"])).otherwise(r)

    return vote


def extended(x: Column, ignore_case: bool, ignore_punctuation: bool, ignored: tuple[str, ...]) -> Column:
    """``x`` without what the extended filters don't look at: patterns, case, punctuation and surrounding blanks."""
    for pattern in ignored:
        x = F.regexp_replace(x, pattern, "")
    x = F.lower(x) if ignore_case else x
    return F.trim(F.regexp_replace(x, r"\p{P}", "") if ignore_punctuation else x)


@register("multi_choice_regex")
def multi_choice_regex(
    choices: str = "choices", pattern: str = r"\(([A-Z])\)", fallback: str = "[invalid]", group_select: int = 0, ignore_case: bool = True, ignore_punctuation: bool = True, ignored: tuple[str, ...] = ()
) -> Filter:
    """The letter of the chosen option: what ``pattern`` finds (match number ``group_select``), else the first option whose text
    occurs, else a letter after a colon that is one of the options' letters.

    choices: the column with the options' texts. Case, punctuation and ``ignored`` patterns don't count where it is said so.
    """
    plain = lambda x: extended(x, ignore_case, ignore_punctuation, tuple(ignored))
    at = F.lit(group_select + 1 if group_select >= 0 else group_select)
    bracketed = lambda letter: F.concat(F.lit("("), F.nullif(letter, F.lit("")), F.lit(")"))

    def one(x: Column) -> Column:
        options = F.transform(F.col(choices), lambda c, i: F.struct(F.nullif(F.position(plain(c), plain(x)), F.lit(0)).alias("at"), i.alias("i"), plain(c).alias("text")))
        seen = F.array_min(F.filter(options, lambda o: o["at"].isNotNull() & (o["text"] != "")))
        direct = F.trim(F.try_element_at(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), at))
        letters = F.filter(F.regexp_extract_all(x, F.lit(r":\s*([A-Z])\b"), F.lit(1)), lambda v: F.ascii(v) - 65 < F.size(F.col(choices)))
        return F.coalesce(bracketed(direct), bracketed(F.chr(seen["i"] + 65)), bracketed(F.try_element_at(letters, F.lit(1))), F.lit(fallback))

    return lambda r: F.transform(r, one)


def pipeline(steps: list[tuple[str, dict]]) -> Filter:
    """The filters of ``steps`` (registered name, arguments) one after the other."""
    made = [REGISTRY[name](**arguments) for name, arguments in steps]

    def run(r: Column) -> Column:
        for f in made:
            r = f(r)
        return r

    return run


def filtered(responses: DataFrame, column: str, pipelines: dict[str, list[tuple[str, dict]]]) -> DataFrame:
    """``responses`` with a column for each named pipeline over the array ``column``."""
    return responses.withColumns({name: pipeline(steps)(F.col(column)) for name, steps in pipelines.items()})


def grouped_responses(responses: DataFrame, keys: list[str], order: list[str], text: str = "response") -> DataFrame:
    """The responses of each key in order, as an array ``resps``; the requests of one document are few."""
    item = F.struct(*order, text)
    return responses.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x[text]).alias("resps"))


def majority(responses: DataFrame, keys: list[str], order: str, text: str = "response") -> DataFrame:
    """The majority response of each key without collecting it: ties go to the first by ``order``."""
    counts = responses.groupBy(*keys, text).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank", "first")
