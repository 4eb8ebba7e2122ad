"""Time, status and severity rules as Column expressions.  `as_of` is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltmap import constants as K
from voltmap.functions.text import blank_to_null, contains_any, percent_encode


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def is_active(start: Column, end: Column, now: Column, until: Column) -> Column:
    """start <= until and the end is open or not before now."""
    return (start <= until) & (end.isNull() | (end >= now))


def in_date_window(day: Column, as_of: Column, days: Column | int) -> Column:
    """Local calendar day within [today, today + days] of the source zone."""
    today = F.to_date(F.from_utc_timestamp(as_of, K.SOURCE_ZONE))
    return day.between(today, F.date_add(today, days))


def since(ts: Column, as_of: Column, hours: int) -> Column:
    return ts >= as_of - F.expr(f"INTERVAL {hours} HOURS")


def not_system_failure(status: Column, error: Column) -> Column:
    return (status != "failed") | error.isNull() | (error != K.ABANDONED_TASK_ERROR)


def impact_level(start: Column, end: Column, now: Column) -> Column:
    lead_hours = seconds_between(start, now) / 3600
    return (
        F.when((start <= now) & (end.isNull() | (end >= now)), "high")
        .when(lead_hours <= K.HIGH_LEAD_HOURS, "high")
        .when(lead_hours <= K.MEDIUM_LEAD_HOURS, "medium")
        .otherwise("low")
    )


def local_timestamp(day_text: Column, time_text: Column) -> Column:
    """'d.M.yyyy' + 'H:mm' in the source zone -> UTC, null when malformed."""
    local = F.try_to_timestamp(F.concat_ws(" ", day_text, time_text), F.lit("d.M.yyyy H:mm"))
    return F.to_utc_timestamp(local, K.SOURCE_ZONE)


def iso_timestamp(c: Column, zone: str = "+00:00") -> Column:
    """ISO-8601 text -> UTC; a text without offset is in `zone`."""
    text = blank_to_null(c)
    # An offset follows a time of day; a date alone ends in '-dd' as well.
    aware = text.rlike(r"[T ]\d{1,2}:\d{2}.*(?:Z|[+-]\d{2}(?::?\d{2})?)$")
    parsed = F.regexp_replace(text, r"([T ]\d{1,2}:\d{2}.*[+-]\d{2})$", "$1:00").try_cast("timestamp")
    return F.when(aware, parsed).otherwise(F.to_utc_timestamp(parsed, zone))


def time_range(day: Column, text: Column) -> Column:
    """'с 10:00 до 16:00' on a local day -> struct(start, end); overnight adds a day."""
    pattern = r"с\s*(\d{1,2}):(\d{2})\s*до\s*(\d{1,2}):(\d{2})"

    def moment(hour_group):
        h = F.regexp_extract(text, pattern, hour_group).try_cast("int")
        m = F.regexp_extract(text, pattern, hour_group + 1).try_cast("int")
        clock = F.when((h < 24) & (m < 60), F.concat_ws(":", h.cast("string"), F.lpad(m.cast("string"), 2, "0")))
        return F.to_utc_timestamp(
            F.try_to_timestamp(
                F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), clock), F.lit("yyyy-MM-dd H:mm")
            ),
            K.SOURCE_ZONE,
        )

    start, end = moment(1), moment(3)
    return F.struct(
        start.alias("start"),
        F.when(end < start, end + F.expr("INTERVAL 1 DAY")).otherwise(end).alias("end"),
    )


# --- dedup ----------------------------------------------------------------------

def type_group(event_type: Column) -> Column:
    return F.when(event_type.isin(*K.COMPATIBLE_EVENT_TYPES), "outage").otherwise(event_type)


def windows_overlap(a_start, a_end, b_start, b_end) -> Column:
    tolerance = F.expr(f"INTERVAL {K.DEDUP_TOLERANCE_SECONDS} SECONDS")
    return (a_start <= F.coalesce(b_end, b_start) + tolerance) & (
        b_start <= F.coalesce(a_end, a_start) + tolerance
    )


def windows_close(a_start, a_end, b_start, b_end) -> Column:
    def near(x, y):
        return F.abs(seconds_between(x, y)) <= K.DEDUP_TOLERANCE_SECONDS

    ends = F.when(a_end.isNull() | b_end.isNull(), a_end.isNull() & b_end.isNull()).otherwise(
        near(a_end, b_end)
    )
    return near(a_start, b_start) & ends


# --- statuses --------------------------------------------------------------------

def coerce(c: Column, allowed, default: str) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(default)


def severity(level: Column) -> Column:
    return coerce(F.lower(F.trim(F.coalesce(level, F.lit("")))), K.SEVERITIES, "unknown")


def rank_of(c: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, value in ranks.items():
        out = F.when(c == name, value).otherwise(out)
    return out


def means_outage(event_type, reason, raw, normalized) -> Column:
    texts = [F.coalesce(c, F.lit("")) for c in (event_type, reason, raw, normalized)]
    return contains_any(F.lower(F.concat_ws(" ", *texts)), K.OUTAGE_TERMS)


def reason_text(event_type: Column, reason: Column, outage: Column) -> Column:
    kind = F.lower(F.trim(F.coalesce(event_type, F.lit(""))))
    label = (
        F.when(kind == "infrastructure_failure", "Аварийное отключение электроэнергии")
        .when(kind.isin("power_outage", "maintenance"), "Плановое отключение электроэнергии")
        .when(outage, "Отключение электроэнергии")
        .otherwise("Возможное влияние на работу офиса")
    )
    detail = blank_to_null(reason)
    lowered = F.lower(detail)
    return (
        F.when(detail.isNull(), label)
        .when(contains_any(lowered, K.GRID_UNIT_TERMS), F.concat(label, F.lit(". Участок: "), detail))
        .when(contains_any(lowered, K.DESCRIBES_OUTAGE_TERMS), F.concat(label, F.lit(": "), detail))
        .otherwise(F.concat(label, F.lit(". Детали источника: "), detail))
    )


def record_url(url: Column, external_id: Column, fragment_host: str = K.FRAGMENT_LINK_HOST) -> Column:
    """Link to one record: hosts with in-page anchors get '#<external id>'."""
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1))
    anchor = blank_to_null(external_id)
    base = F.regexp_replace(url, "#.*$", "")
    linked = anchor.isNotNull() & host.contains(fragment_host)
    return F.when(
        F.coalesce(linked, F.lit(False)), F.concat(base, F.lit("#"), percent_encode(anchor))
    ).otherwise(F.nullif(url, F.lit("")))


def delta(current: Column, previous: Column) -> Column:
    """KPI change: struct(pct, label, status); neutral without a previous value."""
    pct = (current - previous) / previous.cast("double") * 100.0
    known = previous != 0
    return F.struct(
        F.when(known, F.round(pct, 1)).alias("pct"),
        F.when(known, F.format_string("%+.1f%% vs prev", pct)).alias("label"),
        F.when(~known, "neutral").when(pct >= 0, "success").otherwise("warning").alias("status"),
    )


def stage_status(failed, running, pending, done) -> Column:
    return (
        F.when((failed > 0) & (failed >= (done + running) / F.lit(4)), "failed")
        .when(running > 0, "running")
        .when(pending > 0, "pending")
        .when(done > 0, "healthy")
        .otherwise("pending")
    )


def source_status(active, last_fetch, records) -> Column:
    return (
        F.when(~active, "inactive")
        .when(last_fetch.isNull(), "pending")
        .when(records == 0, "warning")
        .otherwise("healthy")
    )


def backoff_seconds(attempt: Column) -> Column:
    return F.least(F.pow(F.lit(K.BACKOFF_BASE), attempt), F.lit(K.BACKOFF_MAX_SECONDS)).cast("int")


def bounded_int(c: Column, default: int, low: int, high: int | None) -> Column:
    """At least `low`; at most `high` where one is given."""
    value = F.coalesce(c.try_cast("int"), F.lit(default))
    return F.greatest(F.lit(low), value if high is None else F.least(F.lit(high), value))


def token_cost(prompt: Column, completion: Column, prompt_price: float, completion_price: float) -> Column:
    p, c = prompt / F.lit(1000.0) * prompt_price, completion / F.lit(1000.0) * completion_price
    return F.struct(
        F.round(p, 4).alias("prompt"), F.round(c, 4).alias("completion"), F.round(p + c, 4).alias("total")
    )


def rate(part: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(F.round(part / total, 4))


def _iso(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def summary_text(office, location, start, end, strategy) -> Column:
    return F.concat(
        office, F.lit(": отключение затрагивает "), location, F.lit(". Окно: "), _iso(start),
        F.lit(" - "), F.coalesce(_iso(end), F.lit("без окончания")),
        F.lit(". Матчинг: "), strategy, F.lit("."),
    )


def alert_text(office, location, reason, start, end, level, strategy, event_id) -> Column:
    def line(label, value):
        return F.concat(F.lit(label), value)

    return F.concat_ws(
        "\n",
        F.lit("Отключение электроэнергии"),
        F.lit(""),
        line("Офис: ", office),
        line("Локация: ", location),
        line("Причина: ", F.coalesce(F.nullif(reason, F.lit("")), F.lit("не указана"))),
        line("Начало: ", _iso(start)),
        line("Окончание: ", F.coalesce(_iso(end), F.lit("не указано"))),
        line("Уровень: ", level),
        line("Матчинг: ", strategy),
        line("Event ID: ", event_id),
    )
