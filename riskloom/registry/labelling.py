"""Incidents, labels, weights and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import labels
from riskloom.registry import views
from riskloom.registry.core import query, rounded
from riskloom.registry.features import corpus
from riskloom.registry.sql_views import with_steps

U = 'usr as "user"'


def labelled(spark, sf):
    """The corpus user-days with their labels."""
    return labels.with_labels(corpus(spark, sf), views.incidents(spark, sf), views.VERSION)


@query(with_steps(f"select {U}, dataset, scenario from v_insiders where dataset = '4.2'", "v_insiders"))
def incidents_of_version(spark, sf):
    """Incidents of one corpus version."""
    return labels.of_version(views.incidents(spark, sf), views.VERSION).select("user", "dataset", "scenario")


@query(with_steps(f"select distinct {U} from v_insiders where dataset = '4.2'", "v_insiders"))
def insider_user_list(spark, sf):
    """Distinct users with an incident."""
    return labels.distinct_insiders(views.incidents(spark, sf), views.VERSION)


@query(with_steps("""select scenario, count(*) as incidents from v_insiders where dataset = '4.2'
    group by scenario order by scenario""", "v_insiders"))
def incidents_per_scenario(spark, sf):
    """Incidents per scenario."""
    return labels.scenario_counts(views.incidents(spark, sf), views.VERSION)


@query(with_steps(f"select {U}, day from incident_day", "incident_day"))
def incident_user_days(spark, sf):
    """Every day inside an incident."""
    return labels.incident_days(views.incidents(spark, sf), views.VERSION)


@query(with_steps(f"select {U}, day, insider_label from labelled", "labelled"))
def labelled_days(spark, sf):
    """Day labels from the incident intervals."""
    return labelled(spark, sf).select("user", "day", "insider_label")


@query(with_steps(f"""select c.usr as "user", c.day, case when i.usr is null then 0 else 1 end as insider_label
    from corpus c left join incident_day i on i.usr = c.usr and i.day - 1 = c.day""", "corpus", "incident_day"))
def labelled_days_shifted(spark, sf):
    """Day labels moved along with the shifted features."""
    table = labels.with_labels(
        corpus(spark, sf), views.incidents(spark, sf), views.VERSION, views.CORPUS_VIEW.calendar.shift_days
    )
    return table.select("user", "day", "insider_label")


@query(with_steps("""select count(*) filter (insider_label = 1) as insider_days,
    count(*) filter (insider_label = 0) as normal_days,
    count(*) filter (insider_label = 0) // greatest(count(*) filter (insider_label = 1), 1) as normal_per_insider
    from labelled""", "labelled"))
def label_balance(spark, sf):
    """Rows per class."""
    return labels.label_balance(labelled(spark, sf))


def _weight_sql(power: int) -> str:
    return with_steps(f"""select {U}, day, round(pow(n / (2 * case when insider_label = 1 then p else n - p end), {power}), 6)
    as weight from labelled, (select cast(count(*) as double) as n, count(*) filter (insider_label = 1) as p from labelled)""",
                      "labelled")


@query(_weight_sql(1))
def class_weights(spark, sf):
    """Balanced class weights."""
    return rounded(labels.with_class_weights(labelled(spark, sf), 1).select("user", "day", "weight"))


@query(_weight_sql(2))
def class_weights_applied_twice(spark, sf):
    """Balanced class weights applied twice, as the forest uses them."""
    return rounded(labels.with_class_weights(labelled(spark, sf), 2).select("user", "day", "weight"))


_SPLIT = """select usr, is_insider, case when row_number() over (partition by is_insider order by md5('3:' || usr), usr)
    <= case when is_insider = 1 then greatest(floor(n * 0.2), 1) else floor(n * 0.2) end then 1 else 0 end as is_test
    from insider_user join (select is_insider, count(*) as n from insider_user group by 1) using (is_insider)"""


@query(with_steps(f"select {U}, is_insider, is_test from ({_SPLIT})", "insider_user"))
def holdout_split(spark, sf):
    """A user-level test split for one seed."""
    users = labels.insider_users(labelled(spark, sf))
    return labels.holdout_users(users, seed=3).select("user", "is_insider", "is_test")


@query(with_steps(f"""select l.usr as "user", l.day, l.insider_label from labelled l
    join ({_SPLIT}) s on s.usr = l.usr where s.is_test = 1""", "labelled", "insider_user"))
def holdout_days(spark, sf):
    """User-days of the test users."""
    table = labelled(spark, sf)
    test = labels.holdout_users(labels.insider_users(table), seed=3).where(F.col("is_test") == 1)
    return labels.of_users(table, test).select("user", "day", "insider_label")


@query(with_steps(f"""select {U}, day, insider_label, cast((row_number() over (partition by insider_label
    order by md5('42:' || key), key) - 1) % 5 as integer) as fold
    from (select usr, day, insider_label, usr || '|' || cast(day as varchar) as key from labelled)""", "labelled"))
def stratified_folds(spark, sf):
    """Five folds with equal shares of each class."""
    keyed = labelled(spark, sf).select(
        "user", "day", "insider_label", F.concat_ws("|", "user", F.col("day").cast("string")).alias("__key")
    )
    return labels.stratified_folds(keyed, "__key", 5, 42).drop("__key")
