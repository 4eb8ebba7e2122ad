"""Raw payloads -> parsed records, all formats in one pass.

A raw frame has id, source_id, raw_content, trace_id, fetched_at and
parser_profile (map<string,string>).  `as_of` fixes 'today' for the date window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltmap import constants as K, schemas
from voltmap.functions import rules as R
from voltmap.functions.hashing import content_hash, content_id
from voltmap.functions.text import blank_to_null, split_locality, strip
from voltmap.operators.running import keep

def read_raw(
    spark: SparkSession, path: str, source_type: str, fetched_at: Column, max_bytes: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(payload files, one row each; refused files with their length and the reason).

    Nothing is refused unless `max_bytes` is given.
    """
    files = spark.read.format("binaryFile").load(path)
    content = F.decode("content", "UTF-8")
    over = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    refused = files.filter(over).select(
        F.col("path").alias("source_url"), "length", F.lit(f"payload over {max_bytes} bytes").alias("error")
    )
    return files.filter(~over).select(
        content_id(F.col("path"), content_hash(content)).alias("id"),
        F.lit(None).cast("string").alias("source_id"),
        F.col("path").alias("source_url"),
        F.lit(source_type).alias("source_type"),
        content.alias("raw_content"),
        content_hash(content).alias("content_hash"),
        fetched_at.alias("fetched_at"),
        content_id(F.lit("trace"), F.col("path")).alias("trace_id"),
    ), refused


def profile_int(key: str, default: int) -> Column:
    value = F.try_element_at(F.col("parser_profile"), F.lit(key))
    return F.coalesce(value.try_cast("int"), F.lit(default))


def json_elements(text: Column) -> Column:
    """Elements of a JSON array; null for anything else.

    The parser stops at the end of the first value, so what follows it must be looked for.
    """
    ended = F.when(text.rlike(r"\]\s*$"), text)
    whole = F.try_variant_get(F.try_parse_json(ended), "$", "array<variant>")
    return F.transform(whole, lambda e: F.struct(e.alias("json"), F.lit(None).cast("string").alias("html")))


def table_rows(text: Column) -> Column:
    """Rows of the table of outages; null if there is no such table."""
    table = F.regexp_extract(text, r'(?is)<table[^>]*class="[^"]*shuthown_table[^"]*"[^>]*>.*?</table>', 0)
    rows = F.regexp_extract_all(F.nullif(table, F.lit("")), F.lit(r"(?is)(<tr[^>]*>.*?</tr>)"), F.lit(1))
    return F.transform(rows, lambda r: F.struct(F.lit(None).cast("variant").alias("json"), r.alias("html")))


_STRINGS = ("external_id", "location_city", "location_district", "location_street", "location_region_code", "reason")


def _fields(day: Column, **columns: Column) -> Column:
    """A record as a struct of one type for all formats."""
    null = F.lit(None).cast("string")
    texts = [columns.get(c, null).alias(c) for c in _STRINGS]
    rest = [columns[c].alias(c) for c in ("start_time", "end_time", "extra")]
    return F.struct(day.alias("day"), *texts, *rest)


def _json_text(key: str) -> Column:
    return F.try_variant_get("_json", f"$.{key}", "string")


def _one_day() -> Column:
    return F.to_date(F.try_to_timestamp(blank_to_null(_json_text("date_start")), F.lit("d.M.yyyy")))


def format_one(rows: DataFrame, mine: Column, out: str) -> DataFrame:
    """Objects with local dates 'dd.MM.yyyy' and times 'HH:mm'."""
    text = {k: blank_to_null(_json_text(k)) for k in ("date_start", "date_finish", "time_start", "time_finish")}
    rows = rows.withColumn("_one_day", F.when(mine, text["date_start"]))
    finish = text["time_finish"]
    fields = _fields(
        F.to_date(F.try_to_timestamp("_one_day", F.lit("d.M.yyyy"))),
        external_id=blank_to_null(_json_text("id")),
        start_time=R.local_timestamp(F.col("_one_day"), F.coalesce(text["time_start"], F.lit("00:00"))),
        end_time=F.when(
            finish.isNotNull(), R.local_timestamp(F.coalesce(text["date_finish"], F.col("_one_day")), finish)
        ),
        location_city=blank_to_null(_json_text("gorod")),
        location_district=blank_to_null(_json_text("raion")),
        location_street=blank_to_null(_json_text("street")),
        location_region_code=blank_to_null(_json_text("region")),
        reason=blank_to_null(_json_text("res")),
        extra=F.create_map(F.lit("f_otkl"), _json_text("f_otkl")),
    )
    return rows.withColumn(out, F.when(mine & F.col("_json").isNotNull(), fields)).drop("_one_day")


def _two_day() -> Column:
    return F.to_date(F.from_utc_timestamp(R.iso_timestamp(_json_text("shutdownDate"), K.SOURCE_ZONE), K.SOURCE_ZONE))


def format_two(rows: DataFrame, mine: Column, out: str) -> DataFrame:
    """Objects with ISO times; naive times are in the source zone."""
    rows = rows.withColumn("_two_start", F.when(mine, R.iso_timestamp(_json_text("shutdownDate"), K.SOURCE_ZONE)))
    houses = blank_to_null(_json_text("commaSeparatedHouses"))
    empty = F.create_map().cast("map<string,string>")
    fields = _fields(
        F.to_date(F.from_utc_timestamp("_two_start", K.SOURCE_ZONE)),
        start_time=F.col("_two_start"),
        end_time=R.iso_timestamp(_json_text("restoreDate"), K.SOURCE_ZONE),
        location_city=blank_to_null(_json_text("city")),
        location_street=blank_to_null(_json_text("street")),
        location_region_code=blank_to_null(_json_text("region")),
        reason=blank_to_null(_json_text("type")),
        extra=F.when(houses.isNotNull(), F.create_map(F.lit("houses"), houses)).otherwise(empty),
    )
    return rows.withColumn(out, F.when(mine & F.col("_json").isNotNull(), fields)).drop("_two_start")


def _paragraphs(row: Column) -> Column:
    return F.regexp_extract_all(row, F.lit(r'(?is)<p[^>]*class="[^"]*"[^>]*>.*?</p>'), F.lit(0))


def _three_day() -> Column:
    return F.to_date(F.try_to_timestamp(_paragraph(_paragraphs(F.col("_element.html")), "t3"), F.lit("d.M.yyyy")))


def _paragraph(found: Column, css: str, index: int = 1) -> Column:
    """Text of the index-th <p class="css"> among the paragraphs found, without its label."""
    own = F.filter(found, lambda p: p.rlike(rf'(?is)^<p[^>]*class="[^"]*{css}[^"]*"'))
    inner = F.regexp_extract(F.try_element_at(own, F.lit(index)), r"(?is)^<p[^>]*>(.*)</p>$", 1)
    bare = F.regexp_replace(F.regexp_replace(inner, r"(?is)<label[^>]*>.*?</label>", ""), r"<[^>]+>", "")
    return strip(F.coalesce(bare, F.lit("")))


def format_three(rows: DataFrame, mine: Column, out: str) -> DataFrame:
    """Table rows with five classes of paragraphs."""
    found = F.col("_three_p")
    rows = rows.withColumn("_three_p", _paragraphs(F.when(mine, F.col("_element.html")))).withColumns(
        {
            "_three_day": F.to_date(F.try_to_timestamp(_paragraph(found, "t3", 1), F.lit("d.M.yyyy"))),
            "_three_where": split_locality(_paragraph(found, "t1")),
            "_three_time": _paragraph(found, "t3", 2),
        }
    ).withColumn("_three_when", R.time_range(F.col("_three_day"), F.col("_three_time")))
    fields = _fields(
        F.col("_three_day"),
        external_id=blank_to_null(F.regexp_extract("_element.html", r'(?is)<td[^>]*\bid="([^"]*)"', 1)),
        start_time=F.col("_three_when.start"),
        end_time=F.col("_three_when.end"),
        location_city=F.col("_three_where.city"),
        location_district=F.col("_three_where.district"),
        location_street=blank_to_null(_paragraph(found, "t2")),
        location_region_code=F.col("_three_where.region"),
        reason=blank_to_null(_paragraph(found, "t4")),
        extra=F.create_map(F.lit("equipment"), _paragraph(found, "t5")),
    )
    return rows.withColumn(out, F.when(mine & F.col("_element.html").isNotNull(), fields)).drop(
        "_three_p", "_three_day", "_three_where", "_three_time", "_three_when"
    )


#: name -> (payload text to its elements, elements to records[, the day of an element])
PARSERS: dict[str, tuple] = {
    "format_one": (json_elements, format_one, _one_day),
    "format_two": (json_elements, format_two, _two_day),
    "format_three": (table_rows, format_three, _three_day),
}


def dispatch(raw: DataFrame, as_of: Column, parsers: dict | None = None, only: str | None = None) -> DataFrame:
    """Payloads of all formats in one pass: a row per record, and one per refused payload with its `error`.

    The profile key 'parser' names the format, unless `only` does.  A payload whose format is
    not known, or that is not what its format asks for (a JSON array, a table of outages), is
    refused whole; an element that is no object gives no record and keeps its position.
    """
    parsers = parsers or PARSERS
    name = F.lit(only) if only else F.coalesce(F.try_element_at("parser_profile", F.lit("parser")), F.lit(""))
    staged = raw.withColumn("_format", name)
    elements = F.lit(None).cast("array<struct<json:variant,html:string>>")
    for split_up in dict.fromkeys(e for e, *_ in parsers.values()):
        names = [k for k, (e, *_) in parsers.items() if e is split_up]
        elements = F.coalesce(F.when(F.col("_format").isin(*names), split_up(F.col("raw_content"))), elements)
    error = F.when(
        ~F.col("_format").isin(*parsers), F.concat(F.lit("no parser registered for: "), F.col("_format"))
    ).when(F.col("_elements").isNull(), F.concat(F.lit("malformed payload for: "), F.col("_format")))
    staged = staged.withColumn("_elements", elements).withColumn("error", error)
    own = ["id", "source_id", "trace_id", "fetched_at", "parser_profile", "_format", "error"]
    each = staged.select(*own, F.posexplode_outer("_elements").alias("pos", "_element"))
    an_object = F.schema_of_variant("_element.json").startswith("OBJECT")
    each = each.withColumn("_json", F.when(an_object, F.col("_element.json")))
    days = profile_int("date_filter_days", K.DEFAULT_DATE_FILTER_DAYS)
    # Where the format can tell an element's day, those out of the window are not taken apart.
    wanted = F.lit(True)
    for key, (_, _, *day) in parsers.items():
        for own in day:
            wanted = F.when(F.col("_format") == key, F.coalesce(R.in_date_window(own(), as_of, days), F.lit(False))).otherwise(wanted)
    each = keep(each, F.col("error").isNotNull() | wanted)
    for key, (_, record, *_) in parsers.items():
        each = record(each, F.col("_format") == key, f"_r_{key}")
    each = each.withColumn("_r", F.coalesce(*[F.col(f"_r_{key}") for key in parsers])).drop(*[f"_r_{key}" for key in parsers])
    timely = F.col("_r").isNotNull() & R.in_date_window(F.col("_r.day"), as_of, days)
    kept = keep(each, F.col("error").isNotNull() | F.coalesce(timely, F.lit(False)))
    made = {
        "raw_record_id": F.col("id"), "source_id": F.col("source_id"), "trace_id": F.col("trace_id"),
        "extracted_at": F.col("fetched_at"), "id": content_id(F.lit("parsed"), F.col("id"), F.col("pos")),
    }
    names = [f.name for f in schemas.schema("parsed_records")]
    return kept.select(*[made.get(n, F.col(f"_r.{n}")).alias(n) for n in names], "pos", "parser_profile", "error")


def split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed records, refused payloads: id, source_id, error) of `dispatch`."""
    refused = found.filter("error IS NOT NULL").select(F.col("raw_record_id").alias("id"), "source_id", "error")
    return found.filter("error IS NULL").drop("error"), refused


def parse(raw: DataFrame, as_of: Column, parsers: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(parsed records, refused payloads); `dispatch` gives both in one pass."""
    return split(dispatch(raw, as_of, parsers))


def parse_format_one(raw: DataFrame, as_of: Column) -> DataFrame:
    return split(dispatch(raw, as_of, only="format_one"))[0]


def parse_format_two(raw: DataFrame, as_of: Column) -> DataFrame:
    return split(dispatch(raw, as_of, only="format_two"))[0]


def parse_format_three(raw: DataFrame, as_of: Column) -> DataFrame:
    return split(dispatch(raw, as_of, only="format_three"))[0]


def with_profile(raw: DataFrame, sources: DataFrame, override: dict[str, str] | None = None) -> DataFrame:
    """Raw rows with their source's profile; override keys win."""
    profiles = sources.select(F.col("id").alias("source_id"), "parser_profile")
    empty = F.create_map().cast("map<string,string>")
    extra = F.create_map(*[F.lit(x) for kv in (override or {}).items() for x in kv]) if override else empty
    joined = raw.join(profiles, "source_id", "left")
    return joined.withColumn(
        "parser_profile", F.map_concat(F.coalesce("parser_profile", empty), extra)
    )


def crawl_frontier(
    sources: DataFrame, as_of: Column, max_pages: int | None = None, max_days: int | None = None
) -> DataFrame:
    """One row per active source and page, with date and page parameters added.

    Profile keys that begin with 'date_param.' name date parameters of any kind, next to
    'date_start' and 'date_end'; page settings may stand under 'paginate.' too.  Pages and
    days are as the profile says, unless bounded by the arguments.
    """
    profile = F.col("parser_profile")

    def setting(key):
        return F.try_element_at(profile, F.lit(key))

    def page_setting(key):
        return F.coalesce(setting(key), setting(f"paginate.{key}"))

    window = R.bounded_int(setting("date_filter_days"), K.DEFAULT_DATE_FILTER_DAYS, 0, max_days)
    pages = R.bounded_int(page_setting("max_pages"), K.DEFAULT_MAX_PAGES, 1, max_pages)
    paged = F.coalesce(page_setting("page_param"), page_setting("max_pages")).isNotNull()
    day = F.to_date(as_of)

    def param(url, name, value):
        pair = F.concat(F.url_encode(name), F.lit("="), F.url_encode(value))
        base, fragment = F.regexp_extract(url, "^([^#]*)", 1), F.regexp_extract(url, "(#.*)$", 1)
        mark = F.when(base.endswith("?"), "").when(base.contains("?"), "&").otherwise("?")
        return F.when(value.isNotNull(), F.concat(base, mark, pair, fragment)).otherwise(url)

    def date_value(template):
        return (
            F.when(template == "today", F.date_format(day, "dd.MM.yyyy"))
            .when(template == "today+window", F.date_format(F.date_add(day, window), "dd.MM.yyyy"))
            .otherwise(template)
        )

    dated = param(F.col("url"), F.lit("date_start"), date_value(setting("date_start")))
    dated = param(dated, F.lit("date_end"), date_value(setting("date_end")))
    prefix = "date_param."
    named = F.array_sort(F.filter(F.map_entries(profile), lambda e: e["key"].startswith(prefix)))
    dated = F.aggregate(
        named, dated, lambda url, e: param(url, F.substr(e["key"], F.lit(len(prefix) + 1)), date_value(e["value"]))
    )
    expanded = sources.filter("is_active").withColumns({"_url": dated, "_paged": paged}).withColumn(
        "page", F.explode(F.sequence(F.lit(1), F.when(F.col("_paged"), pages).otherwise(1)))
    )
    page_param = F.coalesce(page_setting("page_param"), F.lit(K.DEFAULT_PAGE_PARAM))
    url = F.when(F.col("_paged"), param(F.col("_url"), page_param, F.col("page").cast("string"))).otherwise(
        F.col("_url")
    )
    return expanded.select(F.col("id").alias("source_id"), "source_type", "page", url.alias("url"))
