"""Data-quality checks on the corpus user-days."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.calendar import lenient_day
from riskloom.operators import quality
from riskloom.operators.declared import days_since_last_usb
from riskloom.operators.daily import connects
from riskloom.registry import views
from riskloom.registry.core import CHECKS, query, rounded
from riskloom.registry.features import corpus
from riskloom.registry.sql_views import with_steps

# The columns that the checks are made for.
ZSCORES = ["logon_count_zscore", "usb_count_zscore"]
FLAGS = ["weekend_session_flag", "usb_after_hours_flag", "usb_on_weekend_flag", "job_site_visits_flag",
         "job_search_plus_usb_week"]
COUNTS = ["after_hours_session_count", "total_active_minutes_day", "usb_device_diversity_monthly"]
REQUIRED = [*ZSCORES, "email_daily_z_score", *FLAGS, "upload_activity_flag"]
PADDING = [*ZSCORES, *FLAGS, "total_active_minutes_day", "usb_device_diversity_monthly"]


def _line(check: str, column: str, metric: str, value: str, status: str = "'INFO'") -> str:
    return (f"""select '{check}' as "check", '{column}' as "column", '{metric}' as metric,
    round(cast({value} as double), 6) as value, {status} as status""")


def _bad(condition: str, label: str) -> str:
    return f"case when coalesce({condition}, false) then '{label}' else 'PASS' end"


def _share(condition: str) -> str:
    return f"avg(case when {condition} then 100.0 else 0 end)"


def _report(lines: list[str], source: str = "corpus") -> str:
    return with_steps(" union all ".join(f"{line} from {source}" for line in lines), "corpus")


@query(_report([
    _line("shape", "", "rows", "sum(n)"), _line("shape", "", "columns", "max(15)"),
    _line("shape", "user", "users", "count(*)"),
    _line("shape", "user", "rows_per_user_min", "min(n)", _bad("min(n) < 3", "WARN")),
    _line("shape", "user", "rows_per_user_median", "median(n)"),
    _line("shape", "user", "rows_per_user_max", "max(n)"),
], "(select usr, count(*) as n from corpus group by usr)"))
def quality_shape(spark, sf):
    """Rows, columns and rows per user."""
    return rounded(quality.check_shape(corpus(spark, sf)))


@query(_report([
    _line("columns", c, "filled_rows", f"count({c})", "'PASS'") if c in (*ZSCORES, *FLAGS)
    else _line("columns", c, "filled_rows", "max(0)", "'FAIL'") for c in REQUIRED
]))
def quality_required_columns(spark, sf):
    """Columns a validator expects and the table may lack."""
    return quality.check_columns(corpus(spark, sf), REQUIRED)


@query(_report([
    _line("dates", "day", "unparseable", "count(*) filter (day is null)", _bad("count(*) filter (day is null) > 0", "FAIL")),
    *[_line("dates", "day", f"weekday_{w}", f"count(*) filter (isodow(day) - 1 = {w})") for w in range(7)],
    _line("dates", "day", "off_day_percent", _share("isodow(day) in (6, 7)"),
          _bad(f"{_share('isodow(day) in (6, 7)')} > 0.05", "INFO")),
]))
def quality_dates(spark, sf):
    """Days written as text and parsed, and the rows per weekday."""
    table = corpus(spark, sf).withColumn("day", F.date_format("day", "MM/dd/yyyy"))
    return rounded(quality.check_dates(table, lenient_day(F.col("day"))))


@query(_report([line for c in ZSCORES for line in (
    _line("zscore", c, "mean", f"avg({c})", _bad(f"abs(avg({c})) > 0.5", "WARN")),
    _line("zscore", c, "std", f"stddev_samp({c})", _bad(f"stddev_samp({c}) < 0.5 or stddev_samp({c}) > 2", "WARN")),
    _line("zscore", c, "p99", f"quantile_cont({c}, 0.99)"),
    _line("zscore", c, "zero_percent", _share(f"{c} = 0"), _bad(f"{_share(f'{c} = 0')} > 60", "WARN")),
)]))
def quality_zscores(spark, sf):
    """Shape of the z-scores."""
    return rounded(quality.check_zscores(corpus(spark, sf), ZSCORES))


@query(_report([line for c in FLAGS for line in (
    _line("flag", c, "outside_domain", f"count(*) filter ({c} not in (0, 1))",
          _bad(f"count(*) filter ({c} not in (0, 1)) > 0", "FAIL")),
    _line("flag", c, "rate_percent", f"avg({c}) * 100", _bad(f"avg({c}) = 0 or avg({c}) * 100 > 80", "WARN")),
)]))
def quality_flags(spark, sf):
    """Domain and rate of the flags."""
    return rounded(quality.check_flags(corpus(spark, sf), FLAGS))


_RECENCY = """recency as (select d.usr, d.day, coalesce(d.day - max(u.day), 999) as days_since_last_usb
    from corpus d left join usb_day u on u.usr = d.usr and u.day <= d.day group by d.usr, d.day)"""


def _recency(spark, sf):
    return days_since_last_usb(
        corpus(spark, sf).select("user", "day"), connects(views.devices(spark, sf))
    )


@query(with_steps(f"""select * from (with {_RECENCY} {' union all '.join(f'{line} from recency' for line in (
    _line("recency", "days_since_last_usb", "negative", "count(*) filter (days_since_last_usb < 0)",
          _bad("count(*) filter (days_since_last_usb < 0) > 0", "FAIL")),
    _line("recency", "days_since_last_usb", "zero_percent", _share("days_since_last_usb = 0"),
          _bad(f"{_share('days_since_last_usb = 0')} > 50", "FAIL"))))})""", "corpus", "usb_day"))
def quality_recency(spark, sf):
    """Negative values and zeros of the recency signal."""
    return rounded(quality.check_recency(_recency(spark, sf), "days_since_last_usb"))


@query(with_steps("""select cast(usb_count as double) as value, count(*) as n from corpus group by 1
    order by n desc, value limit 5""", "corpus"))
def most_common_usb_counts(spark, sf):
    """Five most frequent connect counts."""
    return quality.most_common(corpus(spark, sf), "usb_count")


@query(with_steps("""select cast(after_hours_session_count as double) as value, count(*) as n from corpus group by 1
    order by value limit 10""", "corpus"))
def after_hours_distribution(spark, sf):
    """Ten smallest after-hours counts."""
    return quality.first_values(corpus(spark, sf), "after_hours_session_count")


@query(_report([_line("padding", "", "all_zero_percent",
                      _share(" and ".join(f"coalesce({c} = 0, false)" for c in PADDING)),
                      _bad(f"{_share(' and '.join(f'coalesce({c} = 0, false)' for c in PADDING))} > 50", "WARN"))]))
def quality_padding(spark, sf):
    """Rows in which every feature is 0."""
    return rounded(quality.check_padding(corpus(spark, sf), PADDING))


@query(with_steps(" union all ".join(
    f"""select 'constant' as "check", '{c}' as "column", 'top_value_percent' as metric,
    round(100.0 * max(n) / sum(n), 6) as value, case when 1.0 * max(n) / sum(n) > 0.95 then 'WARN' else 'PASS' end as status
    from (select round({c}, {8 if 'minutes' in c else 6}), count(*) as n from corpus where {c} is not null group by 1)""" for c in [*ZSCORES, *FLAGS, *COUNTS]
), "corpus"))
def quality_constant_columns(spark, sf):
    """Columns dominated by one value."""
    return rounded(quality.check_constant(rounded(corpus(spark, sf)), [*ZSCORES, *FLAGS, *COUNTS]))


# Every numeric column of the table.
NUMERIC = [*ZSCORES, *FLAGS, *COUNTS, "usb_count", "logon_count_zscore_has_baseline", "usb_count_zscore_has_baseline"]


@query(with_steps(" union all ".join(
    f"""select 'constant' as "check", '{c}' as "column", 'top_value_percent' as metric,
    round(100.0 * max(n) / sum(n), 6) as value, case when 1.0 * max(n) / sum(n) > 0.95 then 'WARN' else 'PASS' end as status
    from (select round({c}, {8 if 'minutes' in c else 6}), count(*) as n from corpus where {c} is not null group by 1)""" for c in NUMERIC
), "corpus"))
def quality_constant_numeric_columns(spark, sf):
    """Columns dominated by one value, among all numeric columns of the table."""
    table = rounded(corpus(spark, sf))
    return rounded(quality.check_constant(table, quality.numeric_columns(table)))


@query(with_steps("""select c.usr as "user", cast(row_number() over (partition by c.usr order by c.day) as integer) as row,
    c.day, c.usb_count, c.job_site_visits_flag, u.first_day, u.last_day, u.user_rows
    from corpus c join (select usr, min(day) as first_day, max(day) as last_day, count(*) as user_rows from corpus
      group by usr order by md5('42:' || usr), usr limit 3) u on u.usr = c.usr
    qualify row_number() over (partition by c.usr order by c.day) <= 6""", "corpus"))
def sampled_users(spark, sf):
    """First days of three users drawn by a seeded hash."""
    return quality.user_sample(corpus(spark, sf), ["usb_count", "job_site_visits_flag"])


@query(" union all ".join(
    f"select * from ({CHECKS[name]})" for name in (
        "quality_shape", "quality_required_columns", "quality_dates", "quality_zscores", "quality_flags",
        "quality_padding", "quality_constant_numeric_columns",
    )
))
def quality_report(spark, sf):
    """All checks as one report."""
    roles = {
        "zscores": ZSCORES, "flags": FLAGS, "required": REQUIRED, "padding": PADDING,
    }
    return rounded(quality.quality_report(rounded(corpus(spark, sf)), roles))
