"""Scalar functions, Column to Column. Regular expressions take Unicode classes where Python's do: (?U)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from braid.config import COUNTRIES, OTHER_CONFIDENCE, OTHER_WEIGHT, REGIONS, FusionConfig, aliases

DEFAULT = FusionConfig()
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
TIME = r"(?:[t ]|(?<= ))[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?: [0-9]+)?)?(?: ?[ap]m)?(?: ?(?:z|utc|gmt|[+-][0-9]{2}:?[0-9]{2}))?$"
WEEKDAY = r"^(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday) (?=.)"
EMAIL_FORM = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def let(x: Column, f) -> Column:
    """f(x), with x evaluated once: where f uses x more than once, a plan would otherwise repeat the whole expression."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def trimmed(x: Column) -> Column:
    """Without white space of any kind at the ends; trim() knows the space only."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def truthy(x: Column) -> Column:
    """Null where the text is empty."""
    return F.nullif(x, F.lit(""))


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[truthy(c) for c in columns])


def sql_literal(x) -> str:
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{x!r}D" if isinstance(x, float) else repr(x)


def lookup(table: dict, key: Column, otherwise: Column | None = None) -> Column:
    # one expression to parse, instead of a call into the JVM for each entry
    literal = F.expr(f"map({', '.join(sql_literal(x) for pair in table.items() for x in pair)})")
    found = F.try_element_at(literal, key)
    return found if otherwise is None else F.coalesce(found, otherwise)


def normalize_phone(raw: Column, cfg: FusionConfig = DEFAULT, need_plus: bool = False) -> Column:
    """E.164, or null. Numbers without + are read as dialled in the configured region, with its trunk or international prefix."""
    code, international = REGIONS[cfg.region]
    anywhere = "|".join(f"{c}(?:{national})" for c, national in cfg.phones.items())

    def from_digits(v: Column) -> Column:
        digits, plus = v["digits"], v["plus"]
        abroad = F.when(plus, digits).when(F.lit(not need_plus) & digits.startswith(international), F.substring(digits, len(international) + 1, 20))
        number = let(abroad, lambda n: F.when(n.rlike(f"^(?:{anywhere})$"), F.concat(F.lit("+"), n)))
        if not need_plus:
            home = truthy(F.regexp_extract(digits, f"^(?:{code}|0)?({cfg.phones[code]})$", 1))
            number = F.coalesce(number, F.when(~plus, F.concat(F.lit("+" + code), home)))
        return F.when(~v["letters"], number)

    return let(trimmed(raw), lambda t: let(F.struct(F.regexp_replace(t, "[^0-9]", "").alias("digits"), t.rlike(r"^[(\s]*\+").alias("plus"), t.rlike("[A-Za-z]").alias("letters")), from_digits))


def normalize_date(raw: Column) -> Column:
    """YYYY-MM, 'present', or null. Month first unless that can't be; parts that are missing count as January and 2000. Weekdays,
    ordinals and times beside a date are passed over; years of two digits are those within 50 years of the current one."""

    def plain(x: Column) -> Column:
        z = F.lower(F.trim(F.regexp_replace(x, r"[.,\s]+", " ")))
        for what, to in ((TIME, ""), (WEEKDAY, ""), (r"(?<=[0-9])(?:st|nd|rd|th)\b", ""), (r"(?<=[0-9]) of ", " ")):
            z = F.regexp_replace(z, what, to)
        return F.trim(z)

    return let(trimmed(raw), lambda x: let(plain(x), lambda z: _month(x, z)))


def full_year(two: Column) -> Column:
    near, now = two + 2000, F.year(F.current_date())
    return F.when(near >= now + 50, near - 100).otherwise(near)


def _month(x: Column, z: Column) -> Column:
    named = ((F.instr(F.lit(MONTHS), F.substring(F.regexp_extract(z, MONTH, 1), 1, 3)) + 2) / 3).cast("int")

    def part(pattern: str, group: int) -> Column:
        return F.try_to_number(F.regexp_extract(z, pattern, group), F.lit("9999")).cast("int")

    def made(year: Column, month: Column, day: Column | None = None) -> Column:
        ok = month.between(1, 12)
        return F.when(ok if day is None else ok & day.between(1, 31), F.format_string("%04d-%02d", year, month))

    iso, month_year, numbers = r"^([0-9]{4})[-/]([0-9]{1,2})(?:[-/]([0-9]{1,2}))?$", r"^([0-9]{1,2})[-/]([0-9]{4})$", r"^([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})$"
    named_forms = [
        (rf"^{MONTH} ([0-9]{{4}})$", 2, None),
        (rf"^{MONTH}$", None, None),
        (rf"^{MONTH} ([0-9]{{1,2}})$", None, 2),
        (rf"^{MONTH} ([0-9]{{1,2}}) ([0-9]{{4}})$", 3, 2),
        (rf"^([0-9]{{1,2}}) {MONTH} ([0-9]{{4}})$", 3, 1),
        (rf"^([0-9]{{4}}) {MONTH}$", 1, None),
    ]
    out = F.when(x.rlike(r"^[0-9]{4}-[0-9]{2}$"), x).when(x.rlike("^[0-9]{4}$"), F.concat(x, F.lit("-01"))).when(F.lower(x).isin("present", "current", "now", "–"), F.lit("present"))
    for pattern, year, day in named_forms:
        out = out.when(z.rlike(pattern), made(F.lit(2000) if year is None else part(pattern, year), named, None if day is None else part(pattern, day)))
    for pattern, year, day in ((rf"^{MONTH} ([0-9]{{1,2}}) '?([0-9]{{2}})$", 3, 2), (rf"^([0-9]{{1,2}}) {MONTH} '?([0-9]{{2}})$", 3, 1)):
        out = out.when(z.rlike(pattern), made(full_year(part(pattern, year)), named, part(pattern, day)))
    short = r"^([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{2})$"
    p, q, r = (part(short, k) for k in (1, 2, 3))
    out = out.when(z.rlike(short), F.when(p > 31, made(full_year(p), q, r)).when(p > 12, made(full_year(r), q, p)).otherwise(made(full_year(r), p, q)))
    out = out.when(z.rlike(iso), F.when((part(iso, 3).isNull()) | part(iso, 3).between(1, 31), made(part(iso, 1), part(iso, 2))))
    out = out.when(z.rlike(month_year), made(part(month_year, 2), part(month_year, 1)))
    a, b = part(numbers, 1), part(numbers, 2)
    out = out.when(z.rlike(numbers), made(part(numbers, 3), F.when(a > 12, b).otherwise(a), F.when(a > 12, a).otherwise(b)))
    return out.when(z.rlike("^[0-9]{1,2}$"), made(F.lit(2000), F.lit(1), part("^([0-9]{1,2})$", 1)))


def normalize_country(raw: Column) -> Column:
    return lookup({a: c for c, names in COUNTRIES.items() for a in names}, F.lower(trimmed(raw)))


def canonical_skill(raw: Column, cfg: FusionConfig = DEFAULT) -> Column:
    return lookup(aliases(cfg.skills), F.lower(trimmed(raw)), trimmed(raw))


def canonical_skills(raw: Column, cfg: FusionConfig = DEFAULT) -> Column:
    """Canonical names in the order of their first spelling."""
    return F.array_distinct(F.transform(raw, lambda s: canonical_skill(s, cfg)))


def parse_location(raw: Column, spaces_only: bool = False) -> Column:
    """struct<city, region, country>; null for blank text. Two parts are a US place if the second is two capitals. spaces_only: other
    white space than spaces stays at the ends of parts."""
    strip = F.trim if spaces_only else trimmed
    return let(strip(raw), lambda text: let(F.filter(F.transform(F.split(text, ","), lambda p: strip(p)), lambda p: p != ""), lambda parts: _place(text, parts)))


def _place(text: Column, parts: Column) -> Column:
    n, at = F.size(parts), lambda i: F.try_element_at(parts, F.lit(i))
    capital = (F.length(at(2)) == 2) & (F.upper(at(2)) == at(2)) & (F.lower(at(2)) != at(2))

    def place(city, region, country):
        return F.struct(city.alias("city"), region.cast("string").alias("region"), country.cast("string").alias("country"))

    null = F.lit(None)
    return F.when(text != "", F.when(n >= 3, place(at(1), at(2), at(3))).when(n == 2, place(at(1), at(2), F.when(capital, "US"))).otherwise(place(text, null, null)))


def candidate_id(full_name: Column, emails: Column, phones: Column) -> Column:
    basis = F.coalesce(F.try_element_at(emails, F.lit(1)), F.try_element_at(phones, F.lit(1)), full_name)
    return F.when(basis != "", F.concat(F.lit("cand_"), F.substring(F.sha2(trimmed(F.lower(basis)).cast("binary"), 256), 1, 12)))


def year_of(date: Column) -> Column:
    return F.substring(date, 1, 4).try_cast("int")


def years_experience(experience: Column, as_of: int | None = None) -> Column:
    """How many calendar years the entries cover, both ends included; null without any."""
    now = F.lit(as_of) if as_of else F.year(F.current_date())

    def covered(e: Column) -> Column:
        start = year_of(e["start_date"])
        end = F.when((e["end_date"] == "present") | truthy(e["end_date"]).isNull(), now).otherwise(F.coalesce(year_of(e["end_date"]), start))
        return F.sequence(start, F.greatest(start, end))

    dated = F.filter(experience, lambda e: year_of(e["start_date"]).isNotNull())
    return F.nullif(F.size(F.array_distinct(F.flatten(F.transform(dated, covered)))).cast("double"), F.lit(0.0))


def dedupe_ci(values: Column) -> Column:
    """Trimmed, without blanks; of spellings that differ by case the first stays."""
    clean = F.filter(F.transform(values, trimmed), lambda v: v != "")
    both = F.struct(clean.alias("v"), F.transform(clean, F.lower).alias("low"))
    return let(both, lambda b: F.filter(b["v"], lambda v, i: F.array_position(b["low"], F.lower(v)) == i + 1))


def email_valid(x: Column) -> Column:
    return F.coalesce(trimmed(x).rlike(EMAIL_FORM), F.lit(False))


def phone_valid(x: Column, cfg: FusionConfig = DEFAULT) -> Column:
    return normalize_phone(x, cfg, need_plus=True).isNotNull()


def phones_match(a: Column, b: Column, cfg: FusionConfig = DEFAULT) -> Column:
    return F.coalesce(normalize_phone(a, cfg) == normalize_phone(b, cfg), F.lit(False))


def sorted_tokens(x: Column) -> Column:
    return F.array_join(F.array_sort(F.split(trimmed(F.lower(x)), r"(?U)\s+")), " ")


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: a fold over a's characters of a row of lengths over b's."""
    chars = F.split(b, "")

    def grown(row: Column, c: Column) -> Column:
        return F.aggregate(
            F.transform(chars, lambda x, j: F.struct(x.alias("x"), j.alias("j"))),
            F.array(F.lit(0)),
            lambda acc, e: F.array_append(acc, F.when(e["x"] == c, row[e["j"]] + 1).otherwise(F.greatest(row[e["j"] + 1], F.element_at(acc, -1)))),
        )

    lengths = F.aggregate(F.split(a, ""), F.array_repeat(F.lit(0), F.length(b) + 1), grown)
    return F.when((a == "") | (b == ""), 0).otherwise(F.element_at(lengths, -1))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """200 * common subsequence / both lengths, of the words in sorted order. Meant for pairs that are already matched or grouped."""
    def ratio(v: Column) -> Column:
        x, y = v["x"], v["y"]
        return F.when(F.length(x) + F.length(y) > 0, 200.0 * common_subsequence(x, y) / (F.length(x) + F.length(y))).otherwise(100.0)

    return let(F.struct(sorted_tokens(a).alias("x"), sorted_tokens(b).alias("y")), ratio)


def names_match(a: Column, b: Column, cfg: FusionConfig = DEFAULT) -> Column:
    return F.coalesce((truthy(a).isNotNull() & truthy(b).isNotNull()) & (token_sort_ratio(a, b) >= cfg.name_threshold), F.lit(False))


def confidence(source: Column, name: str, cfg: FusionConfig = DEFAULT) -> Column:
    return lookup({s: cfg.confidence(s, name) for s in {*cfg.priority, *cfg.source_confidence, *cfg.field_confidence}}, source, F.lit(OTHER_CONFIDENCE))


def priority(source: Column, cfg: FusionConfig = DEFAULT) -> Column:
    return lookup({s: i for i, s in enumerate(cfg.priority)}, source, F.lit(99))


def rounded(x: Column, digits: int = 4) -> Column:
    """Half-even on the exact binary value, as format() does; round() would round its decimal form."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit("")).cast("double")


def overall_confidence(by_field: Column, cfg: FusionConfig = DEFAULT) -> Column:
    """Weighted mean of a map of confidences; 0 for none."""
    entries = F.transform(F.map_entries(by_field), lambda e: F.struct(lookup(cfg.weights, e["key"], F.lit(OTHER_WEIGHT)).alias("w"), e["value"].alias("v")))
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("w"))
    sums = F.aggregate(entries, zero, lambda acc, e: F.struct((acc["n"] + e["w"] * e["v"]).alias("n"), (acc["w"] + e["w"]).alias("w")))
    return let(sums, lambda t: F.when(t["w"] > 0, rounded(t["n"] / t["w"])).otherwise(0.0))


def concatenated(columns: list[Column]) -> Column:
    return reduce(lambda a, b: F.concat(a, b), columns)
