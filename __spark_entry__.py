
from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import sql  # noqa: E402
from upliftlens import schemas  # noqa: E402
from upliftlens.config import DEFAULT  # noqa: E402
from upliftlens.functions.hashing import hash_bucket, uniform_draw  # noqa: E402
from upliftlens.functions.numbers import coerce_price, money_sum, money_value, rounded_ratio  # noqa: E402
from upliftlens.functions.statistics import normal_cdf  # noqa: E402
from upliftlens.operators import assignment, clean, kpis, quality, segments, sessions, treatment  # noqa: E402
from upliftlens.plans import pipeline  # noqa: E402
from upliftlens.plans.reports import REPORTS  # noqa: E402
from upliftlens.sources import storage  # noqa: E402
from upliftlens.sources.adapters import INPUTS, SOURCES, TIE_BREAKERS  # noqa: E402
from upliftlens.sources.events import load_raw  # noqa: E402
from upliftlens.sources.sizing import sized_session  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

# The operators of the training-data pipeline, where they are installed.
LLM_QUERIES: dict[str, Query] = {}
LLM_SQL: dict[str, str] = {}
try:
    import corpus_pipeline
    from upliftlens.llm.oracle import ORACLE
    from upliftlens.llm.queries import QUERIES
except ModuleNotFoundError as missing:
    if not (missing.name or "").startswith(("corpus_pipeline", "upliftlens.llm")):
        raise
else:
    LLM_QUERIES = {**QUERIES, "pipeline": corpus_pipeline.run}
    LLM_SQL = dict(ORACLE)


class Tables:
    """The pipeline's relations over one source. Lazy: a query computes only what it asks for.

    Shuffles are as wide as the source's tables need; the caller's session is not changed.
    """

    def __init__(self, source: str, spark: SparkSession, sf_dir: str) -> None:
        self.source, self.sf_dir = source, sf_dir
        self.spark = sized_session(spark, *[f"{sf_dir}/{name}.parquet" for name in INPUTS[source]])

    def raw(self) -> DataFrame:
        return SOURCES[self.source](self.spark, self.sf_dir)

    def events(self) -> DataFrame:
        return clean.clean_events(self.raw())

    def base(self) -> DataFrame:
        return sessions.session_build(self.events(), TIE_BREAKERS[self.source])

    def features(self) -> DataFrame:
        return sessions.session_features(self.base())

    def sessions(self) -> DataFrame:
        """Without the first event's texts, which only the segments and the full table use."""
        return pipeline.run_etl(self.raw(), order_by=TIE_BREAKERS[self.source], texts=False)

    def full_sessions(self) -> DataFrame:
        return pipeline.run_etl(self.raw(), order_by=TIE_BREAKERS[self.source])

    def assigned(self) -> DataFrame:
        return assignment.assign_groups(self.base())

    def treated(self) -> DataFrame:
        return pipeline.treat(self.sessions())

    def full_treated(self) -> DataFrame:
        return pipeline.treat(self.full_sessions())

    def segments(self) -> DataFrame:
        return segments.segment_results(self.full_treated())

    def profit(self) -> DataFrame:
        return segments.profit_impact(self.segments())

    def all(self) -> dict[str, DataFrame]:
        """The four tables, lazy: an audit computes the columns that it reads."""
        return {
            "sessions": self.full_treated(),
            "ab_results": kpis.ab_results(self.treated()),
            "segment_results": self.segments(),
            "profit_impact": self.profit(),
        }

    def files(self) -> dict[str, DataFrame]:
        """The four tables as stored files give them: names and types are read back, not declared."""
        out = {}
        for name, df in self.stored().items():
            path = storage.scratch_dir(self.spark, f"{name}_files")
            storage.write_parquet(df, path)
            out[name] = self.spark.read.parquet(path)
        return out

    def stored_treated(self) -> DataFrame:
        """The treated sessions, stored; the events are aggregated once, as their sessions are stored on the way."""
        full = pipeline.run_etl(self.raw(), order_by=TIE_BREAKERS[self.source], stage=storage.materialise)
        return storage.materialise(pipeline.treat(full), "sessions")

    def stored(self) -> dict[str, DataFrame]:
        """The four tables, computed from one pass over the events and stored."""
        treated = self.stored_treated()
        parts = storage.materialise(segments.segment_results(treated), "segment_results")
        return {
            "sessions": treated,
            "ab_results": kpis.ab_results(treated),
            "segment_results": parts,
            "profit_impact": segments.profit_impact(parts),
        }


def compare_rounded(df: DataFrame, *columns: str) -> DataFrame:
    """exp() differs between engines in the last bit; its results are compared rounded."""
    return df.withColumns({c: rounded_ratio(F.col(c), sql.P_PLACES) for c in columns})


# --- queries that show one operator ---------------------------------------------------------------


def load_raw_events(t: Tables) -> DataFrame:
    path = storage.scratch_dir(t.spark, "raw_events")
    storage.write_csv(t.raw().select(*schemas.RAW_EVENTS.names), path)
    back = load_raw(t.spark, path).select(*schemas.RAW_EVENTS.names)
    return back.withColumn("price", F.col("price").cast("double"))


def stage_reentry(t: Tables) -> DataFrame:
    """Every stage restarts from what the stage before it stored."""
    stored = storage.materialise(t.full_sessions(), "untreated_sessions")
    treated = storage.materialise(pipeline.treat(stored), "sessions")
    return pipeline.run_segments(treated)[1]


def sink_roundtrip(t: Tables) -> DataFrame:
    """Every table through both sinks; all columns are compared by a digest, names and types as the files have them."""
    rows = []
    for name, df in t.stored().items():
        schema = schemas.TABLES[name]
        csv_path, table_path = (storage.scratch_dir(t.spark, f"{name}_{k}") for k in ("csv", "table"))
        storage.write_csv(df, csv_path)
        table = os.path.basename(table_path).replace("-", "_")
        storage.write_table(df, table, table_path)
        storage.drop_table(t.spark, table)  # the files stay, as they belong to the path
        header = t.spark.read.option("header", True).csv(csv_path).columns
        types = storage.stored_types(t.spark.read.parquet(table_path))
        for sink, back, schema_ok in (
            ("csv", storage.read_csv(t.spark, csv_path, schema), header == schema.names),
            ("table", t.spark.read.parquet(table_path), types == storage.stored_types(t.spark.createDataFrame([], schema))),
        ):
            rows.append(compared_sink(df, back, name, sink, schema_ok))
    return reduce(DataFrame.unionByName, rows)


def compared_sink(df: DataFrame, back: DataFrame, name: str, sink: str, schema_ok: bool) -> DataFrame:
    """One row: whether what was read back has the rows of `df`, in any order, in all columns."""
    amount = "net_revenue_b" if name == "profit_impact" else "net_revenue"
    written = df.agg(storage.multiset_digest(df.columns).alias("digest")).scalar()
    read = back.agg(
        F.count(F.lit(1)).alias("n_rows"),
        money_value(money_sum(F.col(amount))).alias("total"),
        storage.multiset_digest(back.columns).alias("digest"),
    )
    return read.select(
        F.lit(name).alias("table_name"),
        F.lit(sink).alias("sink"),
        F.lit(len(back.columns)).alias("n_columns"),
        "n_rows",
        "total",
        F.lit(int(schema_ok)).alias("schema_ok"),
        (F.col("digest") == written).cast("int").alias("same_rows"),
    )


def apply_defaults(t: Tables) -> DataFrame:
    gaps = t.treated().withColumns(
        {c: F.nullif(F.col(c), F.lit(0).cast(t_.dataType)) for c, t_ in _defaulted().items()}
    )
    return schemas.apply_defaults(gaps).select("user_session", "user_id", *schemas.DEFAULTS)


def _defaulted() -> dict:
    return {c: schemas.TREATED_SESSIONS[c] for c in schemas.DEFAULTS}


def declared(t: Tables, df: DataFrame, schema, defaults: dict) -> DataFrame:
    """`df` inserted by name into a new table that declares types and defaults, read back from it."""
    path = storage.scratch_dir(t.spark, "declared")
    name = os.path.basename(path).replace("-", "_")
    storage.declare_table(t.spark, name, schema, defaults, path)
    storage.insert_by_name(df, name)
    back = t.spark.table(name)
    types = storage.stored_types(t.spark.read.parquet(path))
    storage.drop_table(t.spark, name)  # the files stay, as they belong to the path
    if types != storage.stored_types(t.spark.createDataFrame([], schema)):
        raise ValueError(f"the files of {name} have other types than it declares")
    return back


def declared_defaults(t: Tables) -> DataFrame:
    """Rows without the eight columns that declare a default get it from the table."""
    given = t.treated().drop(*schemas.DEFAULTS)
    full = declared(t, given, schemas.TREATED_SESSIONS, schemas.DEFAULTS)
    return full.select("user_session", "user_id", "brand", "ab_group", *schemas.DEFAULTS)


def declared_profit(t: Tables) -> DataFrame:
    narrow = t.profit().select(*schemas.PROFIT_IMPACT_DECLARED.names)
    return declared(t, narrow, schemas.PROFIT_IMPACT_DECLARED, {})


def text_log(t: Tables) -> DataFrame:
    """The log with user ids of every form: numbers, numbers with decimals, texts, spaces around them, none."""
    user = F.col("user_id").cast("string")
    form = (
        F.when(F.col("product_id") % 31 == 0, "")
        .when(F.col("user_id") % 7 == 3, F.concat(F.when(F.col("product_id") % 2 == 0, "  ").otherwise(""), F.lit("u-"), user))
        .when(F.col("product_id") % 5 == 1, F.concat(user, F.lit(".0")))
        .otherwise(user)
    )
    path = storage.scratch_dir(t.spark, "text_log")
    storage.write_csv(t.raw().select(*schemas.RAW_EVENTS.names).withColumn("user_id", form), path)
    return load_raw(t.spark, path, ids="text")


def text_id_events(t: Tables) -> DataFrame:
    """Every event with its user's key; kept and rejected ones add up to the log."""
    raw = text_log(t)
    columns = ["user_session", "event_time", "event_type", "product_id", "user_id"]
    kept = clean.clean_events(raw).select(*columns, F.lit(1).alias("kept"))
    return kept.unionByName(clean.rejected_events(raw).select(*columns, F.lit(0).alias("kept")))


def text_id_sessions(t: Tables) -> DataFrame:
    treated = pipeline.treat(pipeline.run_etl(text_log(t), texts=False, stage=storage.materialise))
    return treated.drop("hour", "is_weekend", "week_num")


def damaged(full: DataFrame) -> dict[str, DataFrame]:
    """The four tables with rows that break every declared rule, some rows two, of the treated sessions."""
    n, none = F.col("user_id") % 29, F.lit(None)

    def broken(column: str, value: Column, *when: int) -> Column:
        return F.when(n.isin(*when), value).otherwise(F.col(column))

    treated, segment_kind = full.drop(*schemas.FIRST_TEXTS), F.col("segment_type")
    changes = {
        "user_session": broken("user_session", none, 1),
        "user_id": broken("user_id", none, 2),
        "is_weekend": broken("is_weekend", F.lit(7), 3),
        "converted": broken("converted", F.lit(2), 4, 10),
        "cart_abandon": broken("cart_abandon", F.lit(9), 5),
        "is_new_user": broken("is_new_user", F.lit(-1), 6),
        "coupon_triggered": broken("coupon_triggered", F.lit(3), 7),
        "user_type": broken("user_type", F.lit("Lapsed"), 8),
        "ab_group": broken("ab_group", F.lit("C"), 9, 10),
    }
    results, parts = kpis.ab_results(treated), segments.segment_results(full)
    group_a = F.col("ab_group") == "A"
    return {
        "sessions": treated.withColumns(changes),
        "ab_results": results.withColumns(
            {
                "is_significant": F.when(group_a, 5).otherwise(F.col("is_significant")),
                "profit_pass": F.when(~group_a, 7).otherwise(F.col("profit_pass")),
            }
        ),
        "segment_results": parts.withColumn("ab_group", F.when(segment_kind == "user_type", "X").otherwise(F.col("ab_group"))),
        "profit_impact": segments.profit_impact(parts).withColumn(
            "verdict", F.when(segment_kind == "price_bucket", "Maybe").otherwise(F.col("verdict"))
        ),
    }


def gated(t: Tables, full: DataFrame, names: tuple[str, ...]) -> dict[str, tuple]:
    tables = damaged(full)
    return {name: quality.gate(tables[name], name, storage.scratch_dir(t.spark, f"gate_{name}")) for name in names}


def quality_gate(t: Tables) -> DataFrame:
    """What the gate before the sinks counts and sets aside, over tables that break every rule."""
    found = gated(t, t.stored_treated(), tuple(schemas.TABLES))
    stored = {name: (accepted.count(), broken.count()) for name, (accepted, broken, _) in found.items()}
    for name, (_, _, counts) in found.items():
        if stored[name] != (counts["accepted"], counts["checked"] - counts["accepted"]):
            raise ValueError(f"the gate of {name} counted other rows than it stored")
    return quality.gate_report({name: counts for name, (_, _, counts) in found.items()}, t.spark)


def quarantined_rows(t: Tables) -> DataFrame:
    broken = gated(t, t.full_treated(), ("sessions",))["sessions"][1]
    return broken.select("user_session", "user_id", "broken_rules", "rules")


def price_text() -> Column:
    """Prices with junk in them, chosen by product."""
    kind, price = F.col("product_id") % 8, F.col("price").cast("string")
    return (
        F.when(kind == 0, "abc")
        .when(kind == 1, "1d")
        .when(kind == 2, "")
        .when(kind == 3, "NaN")
        .when(kind == 4, F.concat(F.lit("-"), price))
        .when(kind == 5, F.lit(None))
        .otherwise(price)
    )


def coerced(t: Tables) -> DataFrame:
    text = t.raw().withColumn("price_text", price_text())
    return text.select(
        "user_session",
        "user_id",
        "product_id",
        "event_time",
        "price_text",
        coerce_price(F.col("price_text"), text.schema["price_text"].dataType).alias("price"),
    )


def price_buckets(t: Tables) -> DataFrame:
    return (
        t.features()
        .groupBy("price_bucket")
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.min("max_price").alias("lowest"),
            F.max("max_price").alias("highest"),
        )
    )


def hash_buckets(t: Tables) -> DataFrame:
    users = sessions.user_session_counts(t.base())
    return users.select("user_id", hash_bucket(F.col("user_id"), DEFAULT.experiment_name).alias("bucket"))


def hash_bernoulli(t: Tables) -> DataFrame:
    keys = [F.col(k) for k in sessions.SESSION_KEY]
    scored = t.sessions().withColumn("u", uniform_draw(keys, DEFAULT.experiment_name))
    drawn = treatment.hash_bernoulli(
        scored, treatment.lift_probability(), DEFAULT.experiment_name, "hit"
    )
    return drawn.select(*sessions.SESSION_KEY, "u", "hit")


def lift_probability(t: Tables) -> DataFrame:
    return t.sessions().select(
        *sessions.SESSION_KEY, "max_price", treatment.lift_probability().alias("probability")
    )


def discount_policy(t: Tables) -> DataFrame:
    return t.features().select(
        *sessions.SESSION_KEY,
        "gross_revenue",
        treatment.discount(F.col("gross_revenue")).alias("discount"),
    )


def cdf_of_prices(t: Tables) -> DataFrame:
    z = (F.col("price") - 50) / 20
    scored = t.events().select(
        "user_session", "event_time", "product_id", z.alias("z"), normal_cdf(z).alias("cdf")
    )
    return compare_rounded(scored, "cdf")


def segment_kpis(t: Tables) -> DataFrame:
    return segments.segment_kpis(t.full_treated(), ["category_top", "user_type"])


def quality_duplicates(t: Tables) -> DataFrame:
    tables = {"sessions": t.treated(), "ab_results": kpis.ab_results(t.treated()), "events": t.events()}
    return quality.quality_duplicates(tables, {**quality.UNIQUE, "events": "user_session"})


EVENT_COLUMNS = [*schemas.RAW_EVENTS.names, "category_top", "hour", "weekday", "is_weekend", "week_num"]

# Query -> (source, function of its tables)
OPERATORS: dict[str, tuple[str, Callable[[Tables], DataFrame]]] = {
    # sources and sinks
    "load_raw_events": ("events", load_raw_events),
    "stage_reentry": ("orders", stage_reentry),
    "sink_roundtrip": ("orders", sink_roundtrip),
    "table_schemas": ("events", lambda t: quality.table_schemas(t.files())),
    "declared_defaults": ("orders", declared_defaults),
    "declared_profit": ("orders", declared_profit),
    "text_id_events": ("dirty", text_id_events),
    "text_id_metrics": ("dirty", lambda t: clean.clean_metrics(text_log(t))),
    "text_id_sessions": ("orders", text_id_sessions),
    "apply_defaults": ("orders", apply_defaults),
    # cleaning
    "clean_events": ("dirty", lambda t: t.events().select(*EVENT_COLUMNS)),
    "coerce_price": ("events", coerced),
    "normalise_brand": (
        "events",
        lambda t: t.events().groupBy("brand").agg(F.count(F.lit(1)).alias("events")),
    ),
    "category_top": (
        "events",
        lambda t: t.events()
        .groupBy("category_code", "category_top")
        .agg(F.count(F.lit(1)).alias("events")),
    ),
    "time_features": (
        "events",
        lambda t: t.events().select(
            "user_session", "event_time", "hour", "weekday", "is_weekend", "week_num"
        ),
    ),
    "clean_metrics": ("dirty", lambda t: clean.clean_metrics(t.raw())),
    "rejected_events": (
        "dirty",
        lambda t: clean.rejected_events(t.raw()).select(*schemas.RAW_EVENTS.names, "missing"),
    ),
    # sessions
    "session_build": ("orders", Tables.base),
    "session_first": (
        "events",
        lambda t: sessions.session_first(t.events(), TIE_BREAKERS[t.source]),
    ),
    "session_features": ("orders", Tables.features),
    "price_bucket": ("orders", price_buckets),
    "user_session_counts": ("events", lambda t: sessions.user_session_counts(t.base())),
    "user_type": ("events", Tables.full_sessions),
    "run_summary": ("events", lambda t: sessions.run_summary(t.sessions())),
    # experiment
    "hash_bucket": ("events", hash_buckets),
    "assign_groups": (
        "orders",
        lambda t: t.assigned().select(*sessions.SESSION_KEY, "ab_group"),
    ),
    "group_sizes": ("events", lambda t: assignment.group_sizes(t.assigned())),
    "srm_check": (
        "events",
        lambda t: compare_rounded(assignment.srm_check(t.assigned()), "p_value"),
    ),
    "lift_probability": ("orders", lift_probability),
    "hash_bernoulli": ("events", hash_bernoulli),
    "discount_policy": ("orders", discount_policy),
    "apply_treatment": ("orders", Tables.full_treated),
    "treatment_summary": ("orders", lambda t: treatment.treatment_summary(t.treated())),
    "normal_cdf": ("events", cdf_of_prices),
    "z_test": (
        "orders",
        lambda t: compare_rounded(kpis.z_test(t.treated()), "p_value", "p_value_tail", "log10_p"),
    ),
    "group_kpis": ("orders", lambda t: kpis.group_kpis(t.treated())),
    "ab_results": ("orders", lambda t: compare_rounded(kpis.ab_results(t.treated()), "p_value")),
    "guardrail_report": ("orders", lambda t: kpis.guardrail_report(t.treated())),
    # segments
    "segment_kpis": ("orders", segment_kpis),
    "segment_results": ("orders", Tables.segments),
    "profit_impact": ("orders", Tables.profit),
    "verdict_counts": ("orders", lambda t: segments.verdict_counts(t.profit())),
    # quality
    "quality_audit": ("events", lambda t: quality.quality_audit(t.all())),
    "quality_duplicates": ("events", quality_duplicates),
    "quality_gate": ("orders", quality_gate),
    "quarantined_rows": ("orders", quarantined_rows),
}

REPORT_SOURCE = {
    "report_user_type": "events",
    "report_cart_abandon": "events",
    "report_hourly": "events",
    "report_weekend": "events",
    "report_cross": "events",
    "report_user_type_profit": "events",
}


def _report(name: str, t: Tables) -> DataFrame:
    table, report = REPORTS[name]
    if table == "sessions":
        return report(t.treated())
    if table == "ab_results":
        return report(kpis.ab_results(t.treated()))
    return report(t.profit())


def definitions() -> dict[str, tuple[str, Callable[[Tables], DataFrame]]]:
    reports = {
        name: (REPORT_SOURCE.get(name, "orders"), partial(_report, name)) for name in REPORTS
    }
    return {**OPERATORS, **reports}


def _bind(source: str, make: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(Tables(source, spark, sf_dir))


def queries() -> dict[str, Query]:
    own = {name: _bind(source, make) for name, (source, make) in definitions().items()}
    return {**own, **LLM_QUERIES}


def oracle_sql() -> dict[str, str]:
    own = {name: sql.oracle(name, source) for name, (source, _) in definitions().items()}
    return {**own, **LLM_SQL}


def entry(spark: SparkSession) -> DataFrame:
    """The KPI table of the experiment on the order lines."""
    return queries()["ab_results"](spark, "/root/testdata/sf0.001")
