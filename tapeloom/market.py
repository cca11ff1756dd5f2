"""The market tables and operator results of one data set, as DataFrames built on demand."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import backtest, candidates, factors, ledger, research, signals, versions
from tapeloom.oracles import OVERRIDES
from tapeloom.sources import store
from tapeloom.sources.adapters import VIEWS, view

SPLIT, AS_OF = "1996-01-01", "1997-06-20"


class Market:
    """Every attribute is a plan on the ones before it.  With *keep*, tables that others start from are stored when first asked for and
    read back, which cuts lineage and survives lost executors; bars, money flow and trades are stored in buckets by code, so windows over
    a code and joins by date and code need no exchange of them.  Reviews and performance of trades are as many rows as trades, and wider; they
    are computed from these buckets each time, without a shuffle, and not stored."""

    KEPT = ("enriched", "regime", "signals", "results", "evaluation", "named_signals", "named_evaluation", "validation", "default_validation", "signal_pool", "plans", "plan_results")
    LANDED = {"bars": "code", "moneyflow": "code", "stock_basic": None, "actual_trades": "code"}
    #: Nearly as many rows as lines: the lines are dealt by code before they are summed, so sums and buckets need one shuffle together.
    FINE = ("actual_trades",)

    def __init__(self, spark: SparkSession, sf_dir: str, keep: bool = False) -> None:
        self.spark, self.sf_dir, self.keep, self.kept = spark, sf_dir, keep, {}

    def __getattribute__(self, name: str):
        value = object.__getattribute__(self, name)
        return self._stored(name, lambda: value) if name in Market.KEPT and self.keep else value

    def _stored(self, name: str, build: Callable[[], DataFrame], key: str | None = None) -> DataFrame:
        if name not in self.kept:
            path, df = store.scratch(self.spark), build()
            if key:
                self.kept[name] = path, store.bucketed(df, path, key)
            else:
                with store.shuffles_removed(self.spark):
                    df.write.option("compression", "zstd").parquet(path)
                self.kept[name] = path, self.spark.read.schema(df.schema).parquet(path)
        return self.kept[name][1]

    def release(self) -> None:
        """Remove what is stored; plans made before cannot run any more."""
        for path, _ in self.kept.values():
            store.remove(self.spark.sparkContext, path)
        self.kept.clear()
        for name in [k for k in self.__dict__ if isinstance(getattr(Market, k, None), cached_property)]:
            del self.__dict__[name]

    def table(self, name: str) -> DataFrame:
        if not self.keep or name not in VIEWS or name == "px":
            return view(self.spark, self.sf_dir, name)
        key = Market.LANDED.get(name)
        dealt = lambda u: self.table(u).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key)
        build = lambda: view(self.spark, self.sf_dir, name, dealt if name in Market.FINE else self.table)
        return self._stored(name, build, key) if name in Market.LANDED else build()

    @cached_property
    def bars(self) -> DataFrame:
        return self.table("bars")

    @cached_property
    def basic(self) -> DataFrame:
        return self.table("stock_basic")

    @cached_property
    def factors(self) -> DataFrame:
        return factors.daily_factors(self.bars)

    @cached_property
    def flow(self) -> DataFrame:
        return factors.moneyflow_factors(self.table("moneyflow"))

    @cached_property
    def industry(self) -> DataFrame:
        return factors.industry_strength(self.table("sw_daily"))

    @cached_property
    def regime(self) -> DataFrame:
        return factors.market_regime(self.table("index_daily"), self.table("limit_list_daily"))

    @cached_property
    def enriched(self) -> DataFrame:
        return factors.enrich_factors(self.factors, self.table("daily_basic"), self.table("stock_limits"), self.table("suspend_daily"), self.flow, self.table("industry_map"), self.industry)

    @cached_property
    def signals(self) -> DataFrame:
        return signals.run_strategies(self.enriched, list(signals.RULES), OVERRIDES)

    @cached_property
    def results(self) -> DataFrame:
        return backtest.signal_backtest(self.signals, self.bars)

    @cached_property
    def evaluation(self) -> DataFrame:
        return research.evaluate_versions(backtest.signal_performance(self.results))

    @cached_property
    def named(self) -> DataFrame:
        return versions.version_table(self.spark, versions.named_versions(OVERRIDES))

    @cached_property
    def grid(self) -> DataFrame:
        return versions.version_table(self.spark, versions.grid(overrides=OVERRIDES))

    @cached_property
    def named_signals(self) -> DataFrame:
        return signals.all_versions(self.enriched, self.named)

    @cached_property
    def named_evaluation(self) -> DataFrame:
        return research.evaluate_versions(backtest.signal_performance(backtest.signal_backtest(self.named_signals, self.bars)))

    @cached_property
    def searched(self) -> DataFrame:
        found = signals.all_versions(self.enriched, self.grid)
        return research.evaluate_versions(backtest.signal_performance(backtest.signal_backtest(found, self.bars)))

    @cached_property
    def validation(self) -> DataFrame:
        return research.walk_forward(self.named_signals, self.bars, self.named, SPLIT)

    @cached_property
    def default_validation(self) -> DataFrame:
        return research.walk_forward(self.signals, self.bars, self.signals.select("strategy_name", "strategy_version").distinct(), SPLIT)

    @cached_property
    def pool(self) -> DataFrame:
        return candidates.select_candidates(self.enriched, self.basic, self.regime)

    @cached_property
    def signal_pool(self) -> DataFrame:
        return candidates.select_candidates_from_signals(self.signals, self.enriched, self.basic, self.regime, self.evaluation)

    @cached_property
    def plans(self) -> DataFrame:
        return candidates.generate_trade_plan(self.signal_pool)

    @cached_property
    def expanded(self) -> DataFrame:
        key = F.concat_ws("-", "trade_date", "code", "max_holding_days")
        return backtest.expand_holding_days(self.plans).withColumn("plan_id", key)

    @cached_property
    def plan_results(self) -> DataFrame:
        keep = ["plan_id", "trade_date", "code", "action", "strategy_names", "strategy_versions", "strategy_type", "max_holding_days", "entry_low", "entry_high", "stop_loss", "take_profit_1", "take_profit_2"]
        return backtest.plan_backtest(self.expanded.select(*keep), backtest.bars_for_plans(self.bars, self.plans))

    @cached_property
    def plan_performance(self) -> DataFrame:
        return backtest.plan_performance(self.plan_results)

    @cached_property
    def trades(self) -> DataFrame:
        return self.table("actual_trades")

    @cached_property
    def review(self) -> DataFrame:
        plans = self.plans  # before the trades, the largest table stored: what plans need is shuffled while little is stored
        return ledger.execution_review(self.trades, plans)

    @cached_property
    def performance(self) -> DataFrame:
        """A trade's key is unique here, so its review holds all of it and is not joined with it again."""
        own = self.review.select(*self.trades.columns, "plan_match_status", "execution_status", "execution_flags")
        return ledger.reviewed_performance(own, self.bars)

    @cached_property
    def positions(self) -> DataFrame:
        return ledger.positions(self.trades, self.bars, AS_OF)

    @cached_property
    def reviewed(self) -> DataFrame:
        return ledger.position_review(self.positions, self.plans, AS_OF)


def state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the files of a data set: other files, another state."""
    jvm, found = spark.sparkContext._jvm, []
    root = jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


_latest: dict[tuple[str, str], tuple[tuple, Market]] = {}


def shared(spark: SparkSession, sf_dir: str) -> Market:
    """One Market per application and data set, so that queries run one after another share stored tables.  Other files in the data
    set make another Market; what the one before has stored stays for plans still to run, and goes when the driver ends."""
    key, now = (spark.sparkContext.applicationId, sf_dir), state(spark, sf_dir)
    if key not in _latest or _latest[key][0] != now:
        _latest.clear()
        _latest[key] = now, Market(spark, sf_dir, keep=True)
    return _latest[key][1]
