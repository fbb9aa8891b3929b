"""Commands over a data folder: python -m tickloom.cli COMMAND ...

  queries                         names of all queries
  query NAME --data D [--out P]   run one, show it or write it as Parquet
  pipeline --data D --out R       bars to the CLEAN and FEATURES layers with manifests, after the quality gate
  backtest --config C --features F --out P [--folds N] [--sweep name=a,b,...]
  report --trades P --out R       every report table of a trade log
  leaderboard --trials P [--by calmar] [--filter k=v ...] [--limit N]
  inventory --root R | tail-log --root R [--run-id I] [--field k=v ...] [--errors-only] [--since T]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.runtime import prepare



def _session() -> SparkSession:
    return prepare(SparkSession.builder.appName("tickloom").config("spark.sql.session.timeZone", "UTC").getOrCreate())


def _pairs(texts: list[str]) -> dict[str, str]:
    return dict(t.split("=", 1) for t in texts)


def load_config(path: str) -> dict:
    """A strategy file: JSON, or YAML where its library is installed."""
    with open(path) as f:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise SystemExit("reading YAML needs PyYAML; the same document as JSON works without") from e
            return yaml.safe_load(f)
        return json.load(f)


def pipeline(spark: SparkSession, data: str, out: str, minutes: tuple[int, ...] = (5, 15, 60, 240), feature_minutes: tuple[int, ...] = (5, 15), most_removed: float = 0.05) -> list[str]:
    """Gate, clean, resample and build features for all symbols; returns the layers' paths.

    The gate stands before the cleaning: it fails if more than ``most_removed`` of a contract's delivered bars cannot be used.
    """
    from tickloom.operators import features, quality, resample
    from tickloom.runtime import table
    from tickloom.schema import clean_bars
    from tickloom.sources.broker import write_layer

    delivered = table(spark, data, "bars")
    bad = quality.removed_share(delivered).where(F.col("share") > most_removed)
    failed = [f"{r['contract']} ({r['removed']} of {r['delivered']})" for r in bad.orderBy(F.desc("share"), "contract").limit(20).collect()]
    if failed:
        raise SystemExit("the quality gate failed for " + ", ".join(failed))
    paths = [write_layer(clean_bars(delivered), out, "clean_1m", {"minutes": 1})]
    clean = spark.read.parquet(paths[0])
    paths.append(write_layer(resample.resample_many(clean, list(minutes)), out, "clean_resampled", {"minutes": list(minutes)}, [{"path": paths[0]}], ("timeframe",)))
    paths.append(write_layer(resample.resample_daily(clean), out, "clean_daily", {}, [{"path": paths[0]}]))
    for m in feature_minutes:
        spec = features.BASE_V1
        paths.append(write_layer(features.build(clean, m, spec), out, f"features_{m}m", {"minutes": m, "featureset": spec["name"], "hash": features.feature_hash(spec)}, [{"path": paths[0]}]))
    return paths


def backtest(spark: SparkSession, config: dict, feature_path: str, folds: int = 0, sweep: dict[str, list] | None = None) -> DataFrame:
    """Trades of a configuration over a feature table: one run, contiguous folds, or all variants of a sweep."""
    from tickloom.operators import strategies, walkforward
    from tickloom.operators.simulate import Rules, simulate

    f = spark.read.parquet(feature_path)
    known = Rules.__dataclass_fields__
    rules = Rules(**{k: v for k, v in (config.get("backtest") or {}).items() if k in known and v is not None})
    if sweep:
        return walkforward.sweep(f, walkforward.expand(sweep), lambda b, k: strategies.dispatch(b, config | {"knobs": (config.get("knobs") or {}) | k}), rules)
    s = strategies.dispatch(f, config)
    return simulate(walkforward.contiguous_folds(s, folds, 20, 10) if folds else s, rules)


def report(trades: DataFrame) -> dict[str, DataFrame]:
    """The tables of a report over simulated trades, by name."""
    from tickloom.operators import metrics, resampling

    t = trades.withColumns({"root": F.col("symbol"), "hold_minutes": (F.unix_micros("exit_ts") - F.unix_micros("entry_ts")) / 60_000_000})
    local = F.from_utc_timestamp("entry_ts", "America/New_York")
    t = t.withColumns({"entry_dow": F.weekday(local), "entry_hour": F.hour(local)})
    k = ["run_id"]
    return {
        "summary": metrics.summary(t, k), "risk": metrics.extended_risk(t, k), "equity": metrics.equity(t, k).select("run_id", "trade_id", "exit_ts", "equity", "drawdown"), "drawdowns": metrics.drawdowns(t, k), "under_water": metrics.time_under_water(t, k),
        "exit_reasons": metrics.exit_reasons(t, k), "heatmap": metrics.heatmap(t, k), "calendar": metrics.calendar(t, k), "costs": metrics.cost_scenarios(t, k), "distribution": metrics.distribution(t, k), "autocorrelation": metrics.autocorrelation(t, k),
        "quantiles": metrics.quantile_plot(t, k), "hold_times": metrics.histogram(t, k, "hold_minutes", 0.0, 200.0, 40), "bootstrap": resampling.intervals(resampling.samples(t, k, 1000), k), "shuffle": resampling.shuffle_ranks(t, k),
    }


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tickloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple) -> None:
        s = sub.add_parser(name)
        for flags, kw in options:
            s.add_argument(*flags.split(), **kw)

    need = {"required": True}
    add("queries")
    add("query", ("name", {}), ("--data", need), ("--out", {}))
    add("pipeline", ("--data", need), ("--out", need))
    add("backtest", ("--config", need), ("--features", need), ("--out", need), ("--folds", {"type": int, "default": 0}), ("--sweep", {"action": "append", "default": []}))
    add("report", ("--trades", need), ("--out", need))
    add("leaderboard", ("--trials", need), ("--by", {"default": "calmar"}), ("--filter", {"action": "append", "default": []}), ("--limit", {"type": int, "default": 20}))
    add("inventory", ("--root", need))
    add("tail-log", ("--root", need), ("--run-id", {}), ("--field", {"action": "append", "default": []}), ("--errors-only", {"action": "store_true"}), ("--since", {}))
    a = p.parse_args(argv)
    from tickloom.operators import registry
    from tickloom.sources import broker

    if a.command == "queries" or a.command == "query":
        from tickloom.plans import backtest as b
        from tickloom.plans import market, problems, trading

        every = problems.queries() | market.queries() | trading.queries() | b.queries()
        if a.command == "queries":
            print("\n".join(every))
            return
        if a.name not in every:
            raise SystemExit(f"no query {a.name!r}")
        df = every[a.name](_session(), a.data)
        df.write.mode("overwrite").parquet(a.out) if a.out else df.show(50, truncate=False)
        return
    spark = _session()
    if a.command == "pipeline":
        print("\n".join(pipeline(spark, a.data, a.out)))
    elif a.command == "backtest":
        number = lambda t: float(t) if t.replace(".", "", 1).lstrip("-").isdigit() else t
        grid = {k: [number(x) for x in v.split(",")] for k, v in _pairs(a.sweep).items()}
        backtest(spark, load_config(a.config), a.features, a.folds, grid).write.mode("overwrite").parquet(a.out)
    elif a.command == "report":
        for name, df in report(spark.read.parquet(a.trades)).items():
            df.write.mode("overwrite").parquet(f"{a.out}/{name}")
    elif a.command == "leaderboard":
        registry.leaderboard(spark.read.parquet(a.trials), _pairs(a.filter), a.by, True, a.limit).show(a.limit, truncate=False)
    elif a.command == "inventory":
        broker.read_manifests(spark, f"{a.root}/*.manifest").select("layer", "path", "row_count", "date_range", "built_at").orderBy("layer").show(1000, truncate=False)
    else:
        registry.read_logs(broker.read_logs(spark, a.root), run_id=a.run_id, equal=_pairs(a.field), errors_only=a.errors_only, since=a.since).orderBy("timestamp").show(1000, truncate=False)


if __name__ == "__main__":
    main()
