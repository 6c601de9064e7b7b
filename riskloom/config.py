"""Settings that change results, grouped by the flow that uses them."""

from __future__ import annotations

from dataclasses import dataclass

# Career-site keywords, matched case-insensitively anywhere in a URL.
JOB_PATTERN = "indeed|linkedin|monster|career|glassdoor|job"

# Device ids that belong to removable USB storage.
USB_DEVICE_PATTERN = r"^(USB\\VID_|SWD\\WPDBUSENUM)"

# Host-log event ids and the activity each one stands for.
SECURITY_LABELS = {4624: "LOGON", 4800: "LOCK", 4801: "UNLOCK"}
SYSTEM_LABELS = {1074: "LOGOFF(shutdown)", 42: "SLEEP", 107: "WAKE", 6005: "LOGON(STARTUP)"}
DEVICE_CONNECT_ID = 2003

# Activities that open and close a host session.
SESSION_OPENERS = ("LOGON(STARTUP)", "UNLOCK", "WAKE")
SESSION_CLOSERS = ("LOGOFF(shutdown)", "LOCK", "SLEEP")
STARTUP_LABEL = "LOGON(STARTUP)"

# Columns of the unified host log, in file order.
UNIFIED_COLUMNS = (
    "timestamp", "source", "event_id", "activity", "category", "device",
    "user", "logon_id", "browser", "url", "title", "visit_count",
)

# Columns of the host user-day table, in file order.
HOST_DAY_COLUMNS = (
    "date", "user", "day",
    "total_active_minutes_day", "after_hours_session_count", "weekend_session_flag",
    "logon_count_zscore", "logon_count_zscore_has_baseline",
    "usb_count", "usb_after_hours_flag", "usb_on_weekend_flag",
    "usb_device_diversity_monthly", "usb_count_zscore", "usb_count_zscore_has_baseline",
    "job_site_visits_flag", "job_search_plus_usb_week",
)

# Columns that identify a row or carry no signal for the models.
NON_FEATURES = (
    "user", "date", "day", "total_active_minutes_day", "usb_count_zscore_has_baseline",
    "is_synthetic", "insider_label", "scenario",
)

# Model inputs, in order.
MODEL_FEATURES = tuple(c for c in HOST_DAY_COLUMNS if c not in NON_FEATURES)

# Every per-day feature, in order, for population profiles.
PROFILE_FEATURES = HOST_DAY_COLUMNS[4:]


@dataclass(frozen=True)
class CalendarSettings:
    """How a timestamp becomes a day, an hour class and a weekend flag."""

    shift_days: int = 0
    weekend_days: tuple[int, ...] = (4, 5)  # 0 is Monday; read after the shift
    work_start_hour: int = 7
    work_end_hour: int = 19


@dataclass(frozen=True)
class FeatureSettings:
    """User-day feature settings."""

    calendar: CalendarSettings = CalendarSettings()
    job_pattern: str = JOB_PATTERN
    min_baseline_days: int = 5


CORPUS = FeatureSettings(calendar=CalendarSettings(shift_days=-1))
HOST = FeatureSettings()


@dataclass(frozen=True)
class CleaningSettings:
    """Host-log noise filters, in seconds."""

    duplicate_seconds: float = 1.5
    bounce_seconds: float = 1.0
    startup_seconds: float = 60.0
    # Rows of a slice, and slices whose maps one task composes; neither changes the result.
    slice_rows: int = 65_536
    slice_fan: int = 64


@dataclass(frozen=True)
class ForestSettings:
    """Supervised forest. ``weight_power`` 2 applies the class balance twice.

    A fit reads every day. Only a caller that sets ``fit_rows`` has at most so many days that are no insider's fitted;
    scores cover all days.
    """

    trees: int = 300
    depth: int = 5
    min_leaf: int = 50
    feature_subset: str = "all"
    weight_power: int = 2
    seed: int = 42
    fit_rows: int | None = None
    # Whether each tree draws its rows with replacement.
    bootstrap: bool = True


# The holdout estimate uses smaller leaves and a feature subset per split.
HOLDOUT_FOREST = ForestSettings(min_leaf=10, feature_subset="sqrt")


@dataclass(frozen=True)
class DetectorSettings:
    """Unsupervised detectors."""

    contamination: float = 0.02
    isolation_trees: int = 200
    isolation_sample: int = 256
    support: float = 0.9
    seed: int = 42


@dataclass(frozen=True)
class FusionSettings:
    """Score fusion. A bonus applies where both detectors flag a row."""

    supervised_weight: float = 0.7
    unsupervised_weight: float = 0.3
    consensus_bonus: float = 1.15


TRAINING_FUSION = FusionSettings()
DEPLOY_FUSION = FusionSettings(0.0, 1.0, 1.0)
DEPLOY_THRESHOLD = 0.3793
FALLBACK_THRESHOLD = 0.5
RANK_WEIGHTS = (0.7, 0.3)
EXPLAINED_DAYS = 3
REPORT_ROWS = 20
