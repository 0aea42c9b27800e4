"""The reports over one set of input tables, sharing their base frames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame

from promolift.config import LiftConfig
from promolift.operators import attribution, base, checks, departments, exports, intensity, measures
from promolift.operators import reconcile, scorecard
from promolift.sources import files
from promolift.sources.refresh import WeeklyPairs
from promolift.sources.staging import materialize

VIEWS = {
    "v_window_store_week": "spend_store_week",
    "v_markdown_long": "spend_long",
    "v_yoy_pair": "yoy_pair",
    "v_store_week_lift": "lift_store_week",
    "v_dept_week_lift": "lift_dept_week",
}


@dataclass
class Tables:
    """The inputs of a model; the others take the place of what is derived from them:
    the year-on-year pairs, their store-week sums and their store x department sums."""

    train: DataFrame
    features: DataFrame
    stores: DataFrame
    pair: DataFrame | None = None
    lift: DataFrame | None = None
    store_dept: DataFrame | None = None


class LiftModel:
    """Lazy frames over the tables. Nothing runs until a frame is acted on."""

    def __init__(self, tables, config: LiftConfig = LiftConfig()):
        self.tables = tables
        self.config = config

    @property
    def train(self) -> DataFrame:
        return self.tables.train

    @property
    def features(self) -> DataFrame:
        return self.tables.features

    @property
    def stores(self) -> DataFrame:
        return self.tables.stores

    def with_stored_pairs(self) -> LiftModel:
        """The same model over pairs, and the sums over them that most reports
        share, written once to the shared folder. For several reports on large sales."""
        stored = Tables(self.train, self.features, self.stores)
        stored.pair = materialize(self.yoy_pair, "yoy_pair", base.clustered)
        over_pairs = LiftModel(stored, self.config)
        lift = materialize(over_pairs.lift_store_week, "lift_store_week")
        store_dept = materialize(over_pairs.store_dept, "store_dept")
        return LiftModel(Tables(self.train, self.features, self.stores, stored.pair, lift, store_dept), self.config)

    def with_refreshed_pairs(self, folder: str) -> LiftModel:
        """The same model over pairs kept in ``folder``, of which only weeks with changed sales are built anew."""
        weekly = WeeklyPairs(self.train.sparkSession, folder, self.config)
        weekly.refresh(self.train)
        found = weekly.frames(self.train)
        tables = Tables(self.train, self.features, self.stores, found["yoy_pair"], found["lift_store_week"])
        return LiftModel(tables, self.config)

    # Base frames

    @cached_property
    def spend_store_week(self) -> DataFrame:
        return base.spend_store_week(self.features, self.config)

    @cached_property
    def spend_long(self) -> DataFrame:
        return base.spend_long(self.spend_store_week, self.config)

    @cached_property
    def yoy_pair(self) -> DataFrame:
        stored = self.tables.pair
        return base.yoy_pair(self.train, self.config) if stored is None else stored

    @cached_property
    def lift_store_week(self) -> DataFrame:
        stored = self.tables.lift
        return base.lift_store_week(self.yoy_pair) if stored is None else stored

    @cached_property
    def lift_dept_week(self) -> DataFrame:
        return base.lift_dept_week(self.yoy_pair)

    @cached_property
    def effect(self) -> DataFrame:
        return base.store_week_effect(self.spend_store_week, self.lift_store_week, self.config)

    @cached_property
    def store_sums(self) -> DataFrame:
        return attribution.type_sums(self.effect, ["store"], self.config)

    @cached_property
    def store_dept(self) -> DataFrame:
        stored = self.tables.store_dept
        if stored is not None:
            return stored
        return attribution.store_dept_sums(self.yoy_pair, self.spend_store_week, self.config)

    def create_views(self) -> None:
        """The input tables and the base frames as temporary views, for SQL users."""
        for name in files.TABLES:
            getattr(self.tables, name).createOrReplaceTempView(name)
        for view, frame in VIEWS.items():
            getattr(self, frame).createOrReplaceTempView(view)

    # Coverage checks

    def check_window_shape(self) -> DataFrame:
        return checks.window_shape(self.features, self.config)

    def check_null_rate_by_month(self) -> DataFrame:
        return checks.null_rate_by_month(self.features, self.config)

    def check_null_rate_overall(self) -> DataFrame:
        return checks.null_rate_overall(self.features, self.config)

    def check_coactivity(self) -> DataFrame:
        return checks.coactivity(self.features, self.config)

    def check_zero_spend_weeks(self) -> DataFrame:
        return checks.zero_spend_weeks(self.features, self.config)

    def check_activity_by_type(self) -> DataFrame:
        return checks.activity_by_type(self.features, self.config)

    def check_negative_spend(self) -> DataFrame:
        return checks.negative_spend(self.features, self.config)

    def check_baseline_weeks(self) -> DataFrame:
        return checks.baseline_weeks(self.train, self.config)

    def check_holiday_alignment(self) -> DataFrame:
        return checks.holiday_alignment(self.train, self.config)

    def check_pair_coverage(self) -> DataFrame:
        return checks.pair_coverage(self.train, self.config)

    def check_drift_zero_spend(self) -> DataFrame:
        return checks.drift_zero_spend(self.effect)

    def check_growth_full(self) -> DataFrame:
        return checks.growth_full(self.yoy_pair)

    def check_baseline_spend(self) -> DataFrame:
        return checks.baseline_spend(self.features, self.config)

    def check_join_integrity(self) -> DataFrame:
        return checks.join_integrity(self.train, self.features)

    def check_holiday_consistency(self) -> DataFrame:
        return checks.holiday_consistency(self.train, self.config)

    def check_key_uniqueness(self) -> DataFrame:
        return checks.key_uniqueness({"train": self.train, "features": self.features, "stores": self.stores})

    def profile_tables(self) -> DataFrame:
        return checks.profile_tables(self.train, self.features, self.stores)

    def profile_formats(self) -> DataFrame:
        return checks.profile_formats(self.stores)

    def load_report(self) -> DataFrame:
        return files.load_report({"train": self.train, "features": self.features, "stores": self.stores})

    # Scorecards

    def measured_drift(self) -> Column:
        """The drift estimate as a value computed when the report runs; NULL without such weeks."""
        return self.check_drift_zero_spend().select("yoy_drift_rate").scalar()

    def scorecard_by_type(self, drift: Column | None = None, with_validity: bool = False) -> DataFrame:
        return scorecard.scorecard_by_type(self.effect, self.config, drift, with_validity)

    def scorecard_measured_drift(self) -> DataFrame:
        """The scorecard with the drift measured in weeks without spend, and its index marked valid or not."""
        return self.scorecard_by_type(self.measured_drift(), with_validity=True)

    def scorecard_by_type_holiday(self) -> DataFrame:
        return scorecard.scorecard_by_type_holiday(self.effect, self.config)

    def store_league(self) -> DataFrame:
        return scorecard.store_league(self.effect, self.stores, self.config)

    def type_by_format(self) -> DataFrame:
        return scorecard.type_by_format(self.store_sums, self.stores, self.config)

    def type_by_store(self) -> DataFrame:
        return scorecard.type_by_store(self.store_sums, self.stores, self.config)

    def dept_league(self) -> DataFrame:
        return departments.dept_league(self.store_dept, self.config)

    def dept_by_type_top(self) -> DataFrame:
        return departments.dept_by_type_top(self.store_dept, self.config)

    def dept_cut_list(self) -> DataFrame:
        return departments.dept_cut_list(self.store_dept, self.config)

    # Spend intensity

    def marginal_lift(self) -> DataFrame:
        return intensity.marginal_lift(self.effect, self.config)

    def marginal_lift_ex_holiday(self) -> DataFrame:
        return intensity.marginal_lift_ex_holiday(self.effect, self.config)

    def intensity_confound(self) -> DataFrame:
        return intensity.intensity_confound(self.spend_store_week, self.config)

    def method_comparison(self) -> DataFrame:
        return reconcile.method_comparison(intensity.both_contrasts(self.effect, self.config))

    # Additive facts and measures over them

    @cached_property
    def fact_type_lift(self) -> DataFrame:
        return exports.fact_type_lift(self.store_dept, self.config)

    @cached_property
    def fact_dept_sales(self) -> DataFrame:
        return exports.fact_dept_sales(self.yoy_pair)

    @cached_property
    def fact_type_spend(self) -> DataFrame:
        return exports.fact_type_spend(self.store_sums, self.config)

    @cached_property
    def dim_store(self) -> DataFrame:
        return exports.dim_store(self.stores, self.config)

    def exports(self) -> dict[str, DataFrame]:
        """The four exported tables under their file names, in their reporting order."""
        return {
            "fact_markdown_lift": self.fact_type_lift.orderBy("store", "dept", "type_no"),
            "fact_dept_sales": self.fact_dept_sales.orderBy("store", "dept"),
            "fact_markdown_spend": self.fact_type_spend.orderBy("store", "type_no"),
            "dim_store": self.dim_store.orderBy("store"),
        }

    def measure_type(self, dims=("markdown_type",), filters=None) -> DataFrame:
        return measures.type_measures(self._spend_by_store(), list(dims), filters)

    def measure_index(self, dims=("store_format", "markdown_type"), filters=None) -> DataFrame:
        return measures.index_measure(self._spend_by_store(), list(dims), filters)

    def measure_dept(self, dims=("dept",), filters=None) -> DataFrame:
        return measures.dept_measures(self._lift_by_store(), list(dims), filters)

    def measure_yoy(self, dims=("dept",), filters=None) -> DataFrame:
        fact = measures.with_store(self.fact_dept_sales, self.dim_store)
        return measures.yoy_measures(fact, list(dims), filters)

    def measure_format_type(self, filters=None) -> DataFrame:
        return measures.format_type_matrix(self.fact_type_spend, self.dim_store, filters)

    def measure_holiday_share(self, dims=("markdown_type",), filters=None) -> DataFrame:
        return measures.holiday_share(self._spend_by_store(), list(dims), filters)

    def measure_holiday_split(self, dims=("markdown_type",), filters=None) -> DataFrame:
        return measures.holiday_split(self._lift_by_store(), list(dims), filters)

    def _spend_by_store(self) -> DataFrame:
        return measures.with_store(self.fact_type_spend, self.dim_store)

    def _lift_by_store(self) -> DataFrame:
        return measures.with_store(self.fact_type_lift, self.dim_store)

    # Reconciliation

    def reconcile_spend(self) -> DataFrame:
        return reconcile.reconcile_spend(self.features, self.spend_long, self.fact_type_spend, self.config)

    def reconcile_lift(self) -> DataFrame:
        return reconcile.reconcile_lift(self.fact_type_spend, self.store_dept, self.fact_type_lift, self.config)

    def reconcile_alloc(self) -> DataFrame:
        return reconcile.reconcile_alloc(self.fact_type_spend, self.fact_type_lift)

    def reconcile_decomposition(self) -> DataFrame:
        return reconcile.reconcile_decomposition(self.spend_store_week, self.lift_store_week)

    def drift_charge(self) -> DataFrame:
        return checks.drift_charge(self.yoy_pair, self.config)
